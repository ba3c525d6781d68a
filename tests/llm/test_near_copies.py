"""Near copies by real similarity: against brute force, and rows kept."""

import random
import re

from textscope.llm import near_copies

from .samples import docs_of, edge_docs, prose


def brute_similarity(a, b):
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(r, text, edits):
    words = text.split()
    for k in r.sample(range(len(words)), edits):
        words[k] = "".join(r.choice("qwxyz") for _ in range(6))
    return " ".join(words)


def family(r, words, copies, edits):
    """A text and copies of it with some words changed, each 0.8 similar to it at least."""
    base = prose(r, words)
    return [base] + [edited(r, base, edits) for _ in range(copies)]


def test_pairs_at_the_similarity_are_linked_and_others_are_not(spark):
    r = random.Random(8)
    texts, of = [], []
    for k in range(60):
        for t in family(r, r.randint(150, 400), 1, r.randint(1, 4)):
            texts.append(t), of.append(k)
    for k in range(40):  # half of the text is another's: far below 0.8
        own = prose(r, 200)
        texts.append(own), of.append(100 + k)
        texts.append(" ".join(own.split()[:100]) + " " + prose(r, 100)), of.append(200 + k)
    found, seed = near_copies.classes(docs_of(spark, list(enumerate(texts))))
    named = {x.id: x["class"] for x in found.collect()}
    ids = [x[0] for x in docs_of(spark, list(enumerate(texts))).orderBy("doc_id").select(near_copies._named(near_copies.normal_text("text"), seed)).collect()]
    want = right = 0
    for i in range(len(texts)):
        for j in range(i):
            linked = named[ids[i]] == named[ids[j]]
            if of[i] == of[j] and brute_similarity(texts[i], texts[j]) >= 0.8:
                want += 1
                right += linked
            else:
                assert not linked
    assert want >= 50 and right >= 0.95 * want


def test_a_large_group_is_one_class_with_few_pairs(spark):
    r = random.Random(9)
    group = family(r, 300, 400, 1)
    docs = docs_of(spark, list(enumerate(group + [prose(r, 100) for _ in range(100)])))
    kept = sorted(x.doc_id for x in near_copies.keep_one_each(docs).collect())
    assert kept == [0, *range(401, 501)]


def test_rows_are_kept_by_text_not_by_id(spark):
    r = random.Random(10)
    a, b, c = prose(r, 80), prose(r, 80), prose(r, 80)
    rows = [(7, a), (7, b), (7, a), (3, a.upper()), (None, b), (None, c), (None, c), (9, None), (8, " \n"), (10, "")]
    kept = sorted((x.doc_id is None, x.doc_id, x.text) for x in near_copies.keep_one_each(docs_of(spark, rows)).collect())
    assert kept == [(False, 3, a.upper()), (False, 7, b), (False, 8, " \n"), (True, None, c)]


def test_edges(spark):
    docs = edge_docs(spark)
    kept = near_copies.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert ids.count(4) == 1 and 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 1
    assert near_copies.keep_one_each(docs.limit(0)).count() == 0
    assert near_copies.keep_one_each(docs_of(spark, [(1, "a " * 300_000), (2, "a " * 300_001)])).count() == 1
