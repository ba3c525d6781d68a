"""Quality rules, the classifier and toxicity on labelled samples."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textscope.llm import quality_classifier, quality_rules, toxicity

from .samples import EDGES, docs_of, edge_docs, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def measured(docs):
    made = quality_rules.measure(docs)
    return {r.k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in made.collect()}


@pytest.mark.parametrize("short", [1 << 20, 4])
def test_measures_equal_brute_force(spark, monkeypatch, short):
    """Also where every text counts as too long for the packed windows."""
    monkeypatch.setattr(quality_rules, "SHORT", short)
    r = random.Random(1)
    texts = [t for _, t in EDGES] + ["a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "a b c d a b c d b c d", "#*$%&|<> #", "\x0b\x0c a\x0bb"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 60))) + "\nline one\nline one" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert measured(docs) == {k: brute(t) for k, t in enumerate(texts)}


def test_rules_keep_prose_and_drop_junk(spark):
    r = random.Random(2)
    good = [(k, prose(r, r.randint(60, 300))) for k in range(120)]
    junk = [(500 + k, " ".join(f"{w}***" for w in prose(r, 120).split())) for k in range(15)] + [(600 + k, " ".join(["same words again"] * 60)) for k in range(15)]
    got = {x.doc_id: x for x in quality_rules.judge(docs_of(spark, good + junk + [(900, "too short")])).collect()}
    assert all(got[k].kept for k, _ in good)
    assert sum(got[k].kept for k, _ in junk) == 0
    assert got[900].base_failed and not got[900].kept


def test_accuracies_are_learned_from_the_corpus():
    """The start shares fade: on a large corpus a rule that condemns at random
    loses its say, whatever they are; on a small one they hold."""
    rules = {"gg": 700_000, "gb": 70_000, "bb": 20_000, "bg": 2_000}
    found = quality_rules.posteriors({k + x: n // 2 for k, n in rules.items() for x in "gb"})
    assert abs(found["ggg"] - found["ggb"]) < 0.05 and found["bbg"] < 0.1 and found["bbb"] < 0.1
    assert quality_rules.posteriors({"ggg": 3, "bbb": 2})["bbb"] < 0.5


def test_posteriors_learn_from_agreement():
    found = quality_rules.posteriors({"ggg": 900, "bbb": 80, "-bb": 10, "g--": 10})
    assert found["ggg"] > 0.9 > 0.1 > found["bbb"] and found["-bb"] < 0.5 < found["g--"]
    assert quality_rules.posteriors({}) == {}


def test_rule_edges(spark):
    docs = edge_docs(spark)
    assert quality_rules.judge(docs).count() == len(EDGES)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def labelled(r, n=300):
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        text = prose(r, r.randint(30, 200))
        if bad:
            text = " ".join(f"{w}!!" for w in text.upper().split()) if k % 2 else " | ".join(text.split())
        rows.append((k, text))
        if k % 3:
            labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_classifier_ranks_held_out_texts(spark):
    rows, labels = labelled(random.Random(3), 900)
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in quality_classifier.classify(docs, quality_classifier.train(docs, known)).collect()}
    held = [(got[k], k % 5 != 0) for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_classifier_never_sees_the_held_out_fold(spark):
    rows, labels = labelled(random.Random(4), 200)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    docs = docs_of(spark, rows)
    a, b = (quality_classifier.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_prior_comes_from_positive_and_unlabelled_scores():
    r = np.random.default_rng(5)
    hist = lambda x: np.bincount(np.clip((x * 1000).astype(int), 0, 999), minlength=1000).astype(float)
    good, bad = (lambda n: r.beta(6, 2, n)), (lambda n: r.beta(2, 6, n))
    for share in (0.3, 0.8):
        n = 20_000
        mixed = np.concatenate([good(int(n * share)), bad(n - int(n * share))])
        assert abs(quality_classifier.prior_of(hist(good(5_000)), hist(mixed)) - share) < 0.06


def test_repeated_labels_have_a_defined_result(spark):
    rows, labels = labelled(random.Random(7), 120)
    docs = docs_of(spark, rows)
    kind = "doc_id long, quality int, toxic int"
    doubled = labels + [(k, 1, 0) for k, q, _ in labels if q == 0] + [(k, 1, 1) for k, _, _ in labels[:30]]
    a, b = (quality_classifier.train(docs, spark.createDataFrame(x, kind)) for x in (labels, doubled))
    assert np.allclose(a.weights, b.weights)
    a, b = (toxicity.train(docs, spark.createDataFrame(x, kind)) for x in (doubled, [(k, 1, int(k in {i for i, _, _ in labels[:30]})) for k, _, _ in labels]))
    assert a.weights == b.weights and a.theta == b.theta


def test_grades_are_thirds_of_cross_fitted_odds():
    r = random.Random(3)
    rows = [(int(k % 3 == 0), {0: float(r.randint(1, 9)), 1: 1.0} if k % 3 == 0 else {1: 1.0}) for k in range(300)]
    found = toxicity.graded(rows, 2)
    assert all((g > 0) == (y == 1) for (g, _), (y, _) in zip(found, rows))
    by = {g: [x[0] for h, x in found if h == g] for g in (1, 2, 3)}
    assert max(by[1]) <= min(by[2]) + 1 and max(by[2]) <= min(by[3]) + 1 and all(len(v) >= 20 for v in by.values())


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, None, None), (None, 1, 1), (4, 0, 0)]])
def test_model_edges(spark, labels):
    docs = edge_docs(spark)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs.select("doc_id", "text"), known)
    scored = quality_classifier.classify(docs, model)
    assert all(0 <= x.score <= 1 for x in scored.collect()) and scored.count() == len(EDGES)
    assert quality_classifier.classify(docs.limit(0), model).count() == 0
    graded = toxicity.grade(docs, toxicity.train(docs, known))
    assert graded.count() == len(EDGES)
    assert toxicity.reject_toxic(docs, known).columns == docs.columns
    assert toxicity.reject_toxic(docs.limit(0), known).count() == 0


def test_severity_is_ordered_and_finds_held_out_toxic_texts(spark):
    r = random.Random(6)
    insults = ["idiot", "clown", "scum", "moron"]
    rows, labels = [], []
    for k in range(400):
        words = prose(r, r.randint(30, 120)).split()
        toxic = k % 4 == 0
        for _ in range(r.choice([1, 3, 8]) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(insults))
        rows.append((k, " ".join(words)))
        if k < 300:
            labels.append((k, 1, int(toxic)))
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.theta == sorted(model.theta)
    got = {x.doc_id: x for x in toxicity.grade(docs, model).collect()}
    held = range(300, 400)
    assert sum(got[k].toxic for k in held if k % 4 == 0) >= 23
    assert sum(got[k].toxic for k in held if k % 4) <= 2
    mild, hard = model.severity(b"well idiot said"), model.severity(b"idiot clown scum moron idiot clown scum moron idiot")
    assert mild[1] < hard[1] <= toxicity.GRADES - 1
