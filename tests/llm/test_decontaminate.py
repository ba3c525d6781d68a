"""Benchmark leaks against brute force."""

import random

import numpy as np
import pytest

from textscope.llm import decontaminate as d
from textscope.llm.common import words_of

from .samples import EDGES, docs_of, edge_docs, prose


def brute(docs, items):
    out = set()
    for i, text in docs:
        own = d.shingles(words_of((text or "").encode()))
        for j, item in items:
            parts = [words_of(x.encode()) for x in d.question_and_answer(item)]
            some = [words_of(item.encode()), *(parts if min(map(len, parts)) >= 8 else [])]
            if any(len(p) >= 5 and len(d.shingles(p) & own) >= 0.8 * len(d.shingles(p)) for p in some):
                out.add((i, j))
    return out


def sample():
    r = random.Random(8)
    items = [(k, prose(r, r.randint(12, 45))) for k in range(60)]
    docs = [(k, prose(r, r.randint(5, 400))) for k in range(80)]
    for k in range(30):
        words = prose(r, 150).split()
        leak = items[k][1].split()
        if k % 3 == 1:
            leak = [w.upper() + "," for w in leak]
        if k % 3 == 2:
            leak = leak[: len(leak) // 2]
        at = r.randrange(len(words))
        docs.append((200 + k, " ".join(words[:at] + leak + words[at:])))
    for k in range(30, 60):  # the question alone, or the answer alone
        docs.append((200 + k, f"{prose(r, 60)} {d.question_and_answer(items[k][1])[k % 2]} {prose(r, 60)}"))
    return docs, items


@pytest.mark.parametrize("chunk", [20_000, 15])
def test_hits_equal_brute_force(spark, monkeypatch, chunk):
    """Also where the benchmark is indexed in several chunks."""
    monkeypatch.setattr(d, "CHUNK_ITEMS", chunk)
    docs, items = sample()
    found = d.annotate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, h.item_id) for r in found.collect() for h in r.hits}
    assert got == brute(docs, items) and len(got) >= 20


def test_wand_finds_all_above_the_threshold():
    docs, items = sample()
    words = {k: set(words_of(t.encode())) for k, t in items}
    df = {w: sum(w in s for s in words.values()) for s in words.values() for w in s}
    index = d.Index(items, len(items), 28.0, df)
    for _, text in docs:
        terms = sorted({t for w in words_of(text.encode()) if (t := index.vocabulary.get(w)) is not None})
        for block in range(index.blocks):
            got = dict(index.wand(block, np.array(terms, np.int64)))
            score = {}
            for t in terms:
                for item, w in index.posting(block, t):
                    score[item] = score.get(item, 0) + w
            assert set(got) == {k for k, s in score.items() if s >= d.MIN_SCORE - 1e-6}


def test_question_or_answer_alone_is_a_leak():
    q, a = "what is the tallest tower in the old town", "it is the bell tower built of red stone by the river"
    item = f"{q.capitalize()}? {a.capitalize()}."
    index = d.Index([(1, item)], 1, 21.0, {})
    assert [h["item_id"] for h in index.search(f"they asked {q} and left".encode())] == [1]
    assert [h["item_id"] for h in index.search(f"so {a} they said".encode())] == [1]
    assert index.search(b"it is the bell tower of what town") == []
    short = d.Index([(1, "What is the tallest tower in the old town? The bell tower.")], 1, 12.0, {})
    assert short.search(b"the bell tower") == []


def test_a_large_benchmark_stays_small_in_memory():
    """20,000 items: arrays of what occurs, no terms-by-blocks matrix."""
    r = random.Random(5)
    items = [(k, prose(r, 40)) for k in range(20_000)]
    index = d.Index(items, len(items), 40.0, {})
    held = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    assert held < 100 << 20
    assert [h["item_id"] for h in index.search(items[77][1].encode())] == [77]


def test_question_and_answer():
    assert d.question_and_answer("What is it? It is this.") == ("What is it?", "It is this.")
    assert d.question_and_answer("One sentence") == ("One sentence", "")


def test_edges(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "?!"), (4, "word"), (4, "word"), (5, "no id here")], "item_id long, text string")
    found = d.annotate(docs, items)
    assert found.count() == len(EDGES)
    hits = {(r.doc_id, h.item_id) for r in found.collect() for h in r.hits}
    assert hits == {(4, 4), (None, 5)}
    assert d.clean(docs, items.limit(0)).count() == len(EDGES)
    assert d.clean(docs.limit(0), items).count() == 0
    assert d.clean(docs, items).columns == docs.columns
