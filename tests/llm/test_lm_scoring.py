"""Unigram base against brute force; the model against the base on held-out text."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from textscope.llm import lm_scoring as lm

from .samples import EDGES, docs_of, edge_docs, prose


def brute(rows):
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(w := split(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows]


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_base_equals_brute_force_and_the_model_beats_it(spark, monkeypatch, head):
    """Also where most words are joined rather than sent."""
    monkeypatch.setattr(lm, "HEAD", head)
    r = random.Random(9)
    rows = []
    for k in range(300):
        words = prose(r, r.randint(20, 120)).split()
        rows.append((k, " ".join(w if k % 2 else w + "en" for w in words)))
    rows += [(300, None), (301, ""), (5, rows[5][1]), (None, "a null id")]
    got = lm.score(docs_of(spark, rows)).collect()
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=key) == sorted(brute(rows), key=key)
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown word a class, after some histories."""
    r = random.Random(10)
    docs = docs_of(spark, [(k, prose(r, 40)) for k in range(200)])
    model, counts, n, v = lm.train(docs)
    assert any(w.any() for w in model.weights)
    known = [bytes(row.word) for row in counts.collect()]
    assert set(known) == set(model.rank) and len(known) == v
    for history in (b"er on", b"", b"unseen words"):
        texts = [history + b" " + w if w else history for w in known]
        t = model.encode(texts)
        at = np.cumsum(t.sizes) - np.where([bool(w) for w in known], 2, 1)
        assert [t.words[k] for k in at] == known
        p = 10 ** (model.log_part(t)[at] + model.log_count[t.rank[at]])
        # an unknown word of each class takes one part of the last slot
        first, second = model.probabilities(t)
        unknown = 0.0
        for c in range(lm.CLASSES):
            k = np.flatnonzero(t.cls[at] == c)
            if len(k):
                unknown += first[at[k[0]], c] * second[at[k[0]], -1] * 10 ** -model.log_rest[c]
            else:
                unknown += first[at[0], c]
        assert abs(p.sum() + unknown - 1) < 1e-3


def test_endings_are_grouped_by_all_texts(spark):
    """An ending of one text only stands with the one that follows the same word."""
    head = [f"w{k:02d}".encode() for k in range(30)]
    letter = lambda k: chr(97 + k // 10) + chr(97 + k % 10)
    rows = [(k, f"w{k % 30:02d} common{letter(k % 30)}") for k in range(8400)]
    rows += [(9000 + j, f"Unled w{j:02d} rare{letter(j).upper()[0]}{'qrstuvwxyz'[j % 10]}") for j in range(30)] + [(9100, None), (9101, "w01")]
    docs = docs_of(spark, rows)
    m = lm._ending_counts(docs, head)
    want = Counter()
    for _, t in rows:
        near = None
        for w in lm.tokens_of((t or "").encode()):
            if w in head:
                near = head.index(w)
            elif near is not None:
                want[lm._ending(w), near] += 1
    assert {(int(e), int(k)): int(m[e, k]) for e, k in zip(*np.nonzero(m))} == want
    group = lm._ending_groups(docs, head)
    for j in range(30):
        assert group[lm._ending(rows[8400 + j][1].lower().encode())] == group[lm._ending(rows[j][1].encode())]


def plain_softmax(weights, features, bias):
    z = sum(weights[features[:, k]] for k in range(features.shape[1])) + bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(axis=1, keepdims=True)


def plain_update(weights, seen, met, features, error, rate):
    for k in range(features.shape[1]):
        order = np.argsort(features[:, k].astype(np.uint16), kind="stable")
        rows = features[order, k]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g, at = np.add.reduceat(error[order], starts, axis=0), rows[starts]
        seen[at] += (g * g).sum(axis=1)
        met[at] += np.diff(np.append(starts, len(rows)))
        g *= (rate / np.sqrt(seen[at] + 1))[:, None]
        weights[at] += g


def step_of(softmax, update):
    """A training step of one chunk, and what it leaves."""
    r = np.random.default_rng(11)
    features = np.stack([np.minimum(r.zipf(1.2, lm.CHUNK), 6000), 6144 + r.integers(0, 6000, lm.CHUNK), 12_288 + r.integers(0, lm.PAIRS, lm.CHUNK)], axis=1)
    weights = r.normal(0, 0.5, (2 * lm.WORDS + lm.PAIRS, lm.CLASSES)).astype(np.float32)
    seen, met = np.zeros(len(weights), np.float32), np.zeros(len(weights), np.float32)
    bias = np.log(r.random((1, lm.CLASSES))).astype(np.float32)
    began = time.thread_time()
    error = -softmax(weights, features, bias)
    error[np.arange(len(error)), features[:, 0] % lm.CLASSES] += 1
    update(weights, seen, met, features, error, lm.RATE)
    return time.thread_time() - began, error, weights, seen, met


def test_a_step_is_the_plain_one_for_less_time():
    """A chunk's step takes about half of the plain form's time."""
    own, plain = ([step_of(*f) for _ in range(9)] for f in ((lm._softmax, lm._update), (plain_softmax, plain_update)))
    for x, y in zip(own[0][1:], plain[0][1:]):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-5)
    assert min(x[0] for x in own) < 0.8 * min(x[0] for x in plain)


@pytest.mark.parametrize("high", [0.0, 95.0, -120.0, 5000.0])
def test_softmax_of_extreme_weights(high):
    r = np.random.default_rng(12)
    weights = r.normal(0, 1, (50, lm.CLASSES)).astype(np.float32)
    weights[7] += np.float32(high)
    weights[9, 3] += np.float32(high)
    features = np.array([[7, 8], [9, 7], [1, 2], [9, 3]])
    got = lm._softmax(weights, features, np.zeros((1, lm.CLASSES), np.float32))
    assert np.isfinite(got).all() and np.allclose(got, plain_softmax(weights, features, 0), atol=1e-5)


def test_edges(spark):
    docs = edge_docs(spark)
    got = lm.score(docs).collect()
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=key) == sorted(brute(EDGES), key=key)
    assert all(math.isfinite(x.score) for x in got)
    assert lm.score(docs.limit(0)).count() == 0
