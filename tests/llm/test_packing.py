"""Ids against the tokenizers library, pieces and packing by exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textscope.llm import packing

from .samples import EDGES, docs_of, edge_docs, prose

TEXTS = ["", " ", "a  b   c", "x \n y\n\n  z ", "<|endoftext|> hi", "tab\t x\x1cfoo bar", "it's we'll 'S don't", "é 日本語 テスト ｘ　y   z", "\n", "end \n", prose(random.Random(1), 300)]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(tokenizer):
    ids = packing.ids_for(packing.default_vocabulary())
    for t in TEXTS:
        assert np.frombuffer(ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_the_query_takes_added_tokens_and_endless_space_as_the_library_does(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.ids_for(packing.default_vocabulary(), ordinary=False)
    texts = TEXTS + ["a <|endoftext|> hi", "<|endoftext|><|endoftext|>", "<|endoftext", *(f"a{s * 1_200_000}{end}" for s in (" ", "\n") for end in ("x", ""))]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    docs = [(1, "a <|endoftext|> hi"), (2, texts[-1])]
    docs_of(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    held(packing.op2_packing(spark, str(tmp_path)).collect(), docs, library, 1024)


def test_pieces_put_the_short_one_first():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(20, 10) == [(0, 10), (10, 10)]
    assert packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


def held(rows, docs, tokenizer, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    want = []
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(d, p, a, n, zlib.crc32(ids[a : a + n].tobytes())) for p, (a, n) in enumerate(packing.cut(len(ids), capacity))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(by), -(-sum(w[3] for w in want) // capacity)


def test_round_trip(spark, tokenizer):
    r = random.Random(2)
    docs = [(k, prose(r, r.randint(1, 200))) for k in range(200)] + list(enumerate(TEXTS, 1000))
    used, least = held(packing.packed(docs_of(spark, docs), capacity=256).collect(), docs, tokenizer, 256)
    assert used <= least + 2


def test_groups_cost_one_sequence_each(spark, tokenizer):
    docs = [(k, prose(random.Random(k), 30)) for k in range(100)]
    used, least = held(packing.packed(docs_of(spark, docs), capacity=512, group=20).collect(), docs, tokenizer, 512)
    assert used <= least + 8


def test_local_search_empties_bins_without_breaking_them():
    # the start leaves four bins where three can hold all
    lengths = [6, 4, 5, 5, 3, 3, 2, 2]
    bins = packing.improve([[0, 4], [1, 2], [3, 5], [6, 7]], lengths, 10)
    assert len(bins) == 3 and sorted(sum(bins, [])) == list(range(8))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_local_search_never_loses_pieces():
    r = random.Random(5)
    for _ in range(30):
        lengths = [r.randint(1, 100) for _ in range(r.randint(0, 80))]
        start = packing.best_fit(lengths, 100)
        n = len(start)
        bins = packing.improve(start, lengths, 100)
        assert len(bins) <= n and sorted(sum(bins, [])) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)


def test_edges(spark, tokenizer):
    docs = edge_docs(spark)
    held(packing.packed(docs).collect(), EDGES, tokenizer, 1024)
    assert packing.packed(docs.limit(0)).count() == 0
