"""Fingerprints, the trie join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from textscope.llm import common, components, simhash
from textscope.llm.common import hub_join

from .samples import EDGES, docs_of, edge_docs, prose


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(d, low.get(find(k), d))
    return {(d, f"{fps[k]:016x}", low.get(find(k))) for k, (d, _) in enumerate(rows)}


def rows_with_copies(seed=3):
    r = random.Random(seed)
    rows = [(k, prose(r, r.randint(1, 120))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(20)]
    for k in range(40):  # one word changed in a longer text: a few bits differ
        words = rows[k][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((200 + k, " ".join(words)))
    return rows + [(300, ""), (301, None), (302, " \t"), (None, rows[0][1]), (0, rows[0][1])]


def test_classes_equal_brute_force(spark):
    rows = rows_with_copies()
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got} == brute_components(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=60, unique=True), st.integers(0, 4))
def test_trie_finds_all_pairs_within_the_budget(values, most):
    v = np.array(sorted(values), np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 12, most) for a, b in zip(i, j)}
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if (int(v[a]) ^ int(v[b])).bit_count() <= most}
    assert got == want


def test_trie_splits_large_nodes(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 1)
    monkeypatch.setattr(simhash, "FRONTIER", 8)
    r = np.random.default_rng(1)
    v = np.unique(r.integers(0, 1 << 16, 400).astype(np.uint64))
    got = sum(len(i) for i, _ in simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 16, 3))
    assert got == sum((int(a) ^ int(b)).bit_count() <= 3 for k, a in enumerate(v) for b in v[:k])


@pytest.mark.parametrize("hot_rows", [1 << 20, 3])
def test_links_connect_what_is_near(spark, hot_rows):
    """Also where every trie node counts as hot and is cut again."""
    r = random.Random(4)
    centre = r.getrandbits(63)
    fps = {centre}
    for _ in range(60):
        fps.add(centre ^ sum(1 << b for b in r.sample(range(63), r.randint(1, 4))))
    fps |= {r.getrandbits(63) for _ in range(40)}
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot_rows=hot_rows)
    got = {x.node: x.root for x in components.components(links).collect()}
    near = {f for f in fps if (f ^ centre).bit_count() <= 4}
    assert len({got.get(f) for f in near}) == 1
    assert all((links_.u ^ links_.v).bit_count() <= 64 for links_ in links.take(1))
    alone = [f for f in fps if all((f ^ g).bit_count() > 4 for g in fps if g != f)]
    assert not set(alone) & set(got)


def test_a_dense_group_is_linked_without_its_square():
    """Linked pairs fall away: the leaf pairs looked at stay far below n * n / 2."""
    r = np.random.default_rng(6)
    flips = r.integers(0, 64, (20_000, 2)).astype(np.uint64)
    v = np.unique(np.uint64(0x1234567890ABCDEF) ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1]) ^ (r.integers(0, 256, 20_000).astype(np.uint64) << np.uint64(56)))
    groups, seen = simhash.Groups(len(v)), 0
    for i, j in simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 64, 4, groups):
        seen += len(i)
        groups.join(i, j)
    assert (groups.root == 0).all() and seen < len(v) ** 2 / 20
    assert (simhash._stars(v, np.array([0]), np.array([len(v)]), 64, 4) == 0).all()


def test_hubs_give_the_same_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_ROWS", 256)
    rows = spark.createDataFrame([(1, k) for k in range(700)] + [(k, k) for k in range(2, 400)], "u long, v long")
    values = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, hub_join(rows, values, "u", "n", rows.count()).collect())) == sorted((u, v, 0 if u == 1 else v) for u, v in map(tuple, rows.collect()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_very_long_text_is_counted_in_parts():
    text = " ".join(str(k % 977) for k in range(140_000))
    assert int(simhash.fingerprints_of([text.encode()])[0]) == brute_fingerprint(text)


def test_edges(spark):
    docs = edge_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got} == brute_components(EDGES)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
