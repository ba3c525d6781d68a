"""Benchmark decontamination by a BM25 index of the test items.

The test items are indexed, the corpus is the query set: every passage of
every text is a query, and all entries that score at least ``MIN_SCORE`` of
their own full score are retrieved. An item has an entry for the whole and,
where both have ``PART_WORDS`` words, one for its question and one for its
answer. Entries are held in blocks of similar length, each with the largest
contribution of every term (block-max). A passage's terms bound what any entry
of a block can reach; blocks below the threshold are skipped, in the others a
WAND walk finds the entries whose bounds reach it and scores them. A retrieved
item is confirmed by the share of five-word shingles that stand in the text:
``MIN_OVERLAP`` of the whole item, of its question or of its answer.

The index goes to the workers, so its size is bounded: a benchmark beyond
``CHUNK_ITEMS`` items (or ``CHUNK_WORDS`` words) is indexed in chunks with the
statistics of the whole. Each chunk is read, indexed, sent out and dropped
before the next one, in a pass over the texts of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import as_bytes, as_text, materialize, small_batches, table, words_of

SHINGLE_WORDS = 5
MIN_OVERLAP = 0.8
#: Words from which a question or an answer counts by itself: shorter ones are no proof.
PART_WORDS = 8
MIN_SCORE = 0.55
K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
CHUNK_ITEMS = 20_000
CHUNK_WORDS = 2_000_000

HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,overlap:double>>"


def shingles(words: list[bytes]) -> set[bytes]:
    n = SHINGLE_WORDS
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({b" ".join(words)} if words else set())


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, if there are several."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _csr(keys: np.ndarray, size: int) -> np.ndarray:
    """Where each key of 0..size-1 starts in sorted keys."""
    return np.searchsorted(keys, np.arange(size + 1))


class Index:
    """BM25 contributions of terms to entries, each entry's sum scaled to 1. Arrays
    hold only what occurs, so the size goes with the items' words."""

    def __init__(self, items: list[tuple[int, str]], total: int, average: float, df: dict[bytes, int]):
        entries: list[tuple[int, list[bytes]]] = []
        self.items: list[tuple[int, list[list[bytes]]]] = []
        for i, text in items:
            words = words_of(text.encode())
            if not words:
                continue
            parts = [words_of(x.encode()) for x in question_and_answer(text)]
            own = [words, *(p if min(map(len, parts)) >= PART_WORDS else [] for p in parts)]
            entries += [(len(self.items), p) for p in own if p]
            # question and answer as they are too: their overlaps are reported
            self.items.append((i, [words, *parts, *own[1:]]))
        entries.sort(key=lambda x: (len(x[1]), x[0]))
        self.item_of = np.array([k for k, _ in entries], np.int32)
        self.longest = max((len(w) for _, w in entries), default=1)
        self.vocabulary: dict[bytes, int] = {}
        terms, owners, weights = [], [], []
        for k, (_, words) in enumerate(entries):
            own_weights = []
            for term, tf in Counter(words).items():
                n = df.get(term, 1)
                idf = math.log(1 + (total - n + 0.5) / (n + 0.5))
                terms.append(self.vocabulary.setdefault(term, len(self.vocabulary)))
                owners.append(k)
                own_weights.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average)))
            full = sum(own_weights)
            weights += [w / full for w in own_weights]
        t, e, w = np.array(terms, np.int64), np.array(owners, np.int64), np.array(weights, np.float64)
        self.blocks = -(-len(entries) // BLOCK_ITEMS)
        # postings by (block, term), then entry
        order = np.lexsort((e, t, e // BLOCK_ITEMS))
        key = (e // BLOCK_ITEMS * len(self.vocabulary) + t)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.lists, self.list_at = key[first], np.append(first, len(key))
        self.entries, self.weights = e[order].astype(np.int32), w[order]
        # the largest weight in each block, by term
        most = np.maximum.reduceat(w[order], first) if len(key) else np.zeros(0)
        block, term = np.divmod(self.lists, max(1, len(self.vocabulary)))
        by_term = np.lexsort((block, term))
        self.block_of, self.most = block[by_term].astype(np.int32), most[by_term]
        self.term_at = _csr(term[by_term], len(self.vocabulary))
        self.list_most = most

    def posting(self, block: int, term: int) -> list[tuple[int, float]]:
        """(entry, weight) of a term in a block."""
        key = block * len(self.vocabulary) + term
        k = int(np.searchsorted(self.lists, key))
        if k == len(self.lists) or self.lists[k] != key:
            return []
        a, b = self.list_at[k : k + 2]
        return list(zip(self.entries[a:b].tolist(), self.weights[a:b].tolist()))

    def wand(self, block: int, terms: np.ndarray) -> list[tuple[int, float]]:
        """All entries of the block whose score over the terms reaches MIN_SCORE."""
        keys = block * len(self.vocabulary) + terms
        at = np.searchsorted(self.lists, keys)
        at = at[(at < len(self.lists)) & (self.lists[np.minimum(at, len(self.lists) - 1)] == keys)]
        lists = []
        for k in at.tolist():
            a, b = self.list_at[k : k + 2]
            post = list(zip(self.entries[a:b].tolist(), self.weights[a:b].tolist()))
            lists.append([post[0][0], 0, post, float(self.list_most[k])])
        lists.sort(key=lambda x: x[0])
        found = []
        while lists:
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= MIN_SCORE - 1e-6:
                    pivot = k
                    break
            if pivot is None:
                break
            entry = lists[pivot][0]
            if lists[0][0] == entry:  # all before the pivot stand on it: score
                score = sum(x[2][x[1]][1] for x in lists if x[0] == entry)
                if score >= MIN_SCORE - 1e-6:
                    found.append((entry, score))
                target = entry + 1
            else:
                target = entry
            for x in lists:  # on to the pivot, or past it
                while x[0] < target:
                    x[1] += 1
                    x[0] = x[2][x[1]][0] if x[1] < len(x[2]) else 1 << 60
            lists = sorted((x for x in lists if x[0] < 1 << 60), key=lambda x: x[0])
        return found

    def _open_blocks(self, passage: np.ndarray, term: np.ndarray, passages: int):
        """(passage, block) pairs whose bounds reach the threshold."""
        counts = self.term_at[term + 1] - self.term_at[term]
        at = np.repeat(self.term_at[term] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        code = np.repeat(passage, counts) * self.blocks + self.block_of[at]
        bounds = np.bincount(code, self.most[at], passages * self.blocks)
        return np.divmod(np.flatnonzero(bounds >= MIN_SCORE - 1e-6), self.blocks)

    def search(self, raw: bytes) -> list[dict]:
        """Confirmed items of one text, whose passages overlap by half."""
        words = words_of(raw)
        terms = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return []
        half = max(32, self.longest)
        near = terms[at]
        window = at // half
        size = len(self.vocabulary) + 1
        # each word lies in the passage that starts in its half, and in the one before
        keys = np.unique(np.concatenate([window * size + near, np.maximum(window - 1, 0) * size + near]))
        passage, term = keys // size, keys % size
        starts = np.flatnonzero(np.concatenate([[True], np.diff(passage) > 0]))
        stops = np.append(starts[1:], len(keys))
        best: dict[int, float] = {}
        step = max(1, (1 << 21) // self.blocks)
        for lo in range(0, len(starts), step):  # a very long text in parts
            hi = min(lo + step, len(starts))
            a, b = starts[lo], stops[hi - 1]
            number = np.repeat(np.arange(hi - lo), stops[lo:hi] - starts[lo:hi])
            for p, block in zip(*self._open_blocks(number, term[a:b], hi - lo)):
                for entry, score in self.wand(int(block), term[starts[lo + p] : stops[lo + p]]):
                    item = int(self.item_of[entry])
                    best[item] = max(best.get(item, 0.0), score)
        if not best:
            return []
        own = shingles(words) if len(words) >= SHINGLE_WORDS else set()
        joined = b" " + b" ".join(words) + b" "
        out = []
        for item, score in sorted(best.items()):
            whole, question, answer, own_question, own_answer = (self._share(p, own, joined) for p in self._shingles(item))
            # an empty part has a share of 1 where it is reported, of 0 where it decides
            if max(whole, *(x for x, p in zip((own_question, own_answer), self.items[item][1][3:]) if p), 0.0) >= MIN_OVERLAP:
                out.append({"item_id": self.items[item][0], "score": min(1.0, score), "question_overlap": question, "answer_overlap": answer, "overlap": whole})
        return out

    @staticmethod
    def _share(part: set[bytes], own: set[bytes], joined: bytes) -> float:
        return sum(s in own or (s.count(b" ") < SHINGLE_WORDS - 1 and b" " + s + b" " in joined) for s in part) / len(part) if part else 1.0

    def _shingles(self, item: int) -> list[set[bytes]]:
        return [shingles(p) for p in self.items[item][1]]


def _chunks(benchmark: DataFrame) -> tuple[int, list[DataFrame]]:
    """The number of usable items, and the items in chunks by hash."""
    items = benchmark.select("item_id", as_text("text").alias("text")).where("item_id is not null and trim(text) <> ''")
    count, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(count / CHUNK_ITEMS), math.ceil(chars / 6 / CHUNK_WORDS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return count, [items.where(part == k) for k in range(parts)] if parts > 1 else [items]


def _document_frequencies(benchmark: DataFrame, chunk: list[tuple[int, str]], whole: bool) -> tuple[dict[bytes, int], float]:
    """How many items of the whole benchmark hold each term of the chunk, and the
    mean number of words of an item; terms of other chunks stay on the cluster."""
    if whole:
        split = [words_of(t.encode()) for _, t in chunk]
        return Counter(w for words in split for w in set(words)), sum(map(len, split)) / max(1, len(split))
    spark = benchmark.sparkSession
    words = F.expr(r"filter(split(regexp_replace(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' '), ' +'), w -> w <> '')")
    split = benchmark.where("item_id is not null").select(words.alias("w")).where("size(w) > 0")
    mine = spark.createDataFrame([(w.decode("utf-8", "replace"),) for w in sorted({w for _, t in chunk for w in words_of(t.encode())})], "term string")
    counted = split.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").count().join(mine, "term", "left_semi")
    mean = split.agg(F.avg(F.size("w"))).first()[0]
    return {r.term.encode(): r["count"] for r in counted.toLocalIterator()}, mean


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "hits") -> DataFrame:
    """docs with ``name``, an array of the items found in each text.

    A row keeps its place and columns (one of that name is replaced). Null, empty
    and wordless texts have no hit. Items with null id or without a word are left
    out; repeated items give a hit each; items of fewer than five words count as
    one shingle, found where they stand word for word. No item: no hit."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    count, chunks = _chunks(benchmark)
    if len(chunks) == 1:
        return _one_pass(docs, _index(benchmark, chunks[0], count, True), name, text)
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = None
    for chunk in chunks:
        shared = _index(benchmark, chunk, count, False)
        hits = _one_pass(rows.select("__row", F.col(text).alias("__text")), shared, name, "__text").where(F.size(name) > 0).select("__row", name)
        hits = materialize(hits, "chunk-hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list(name))).alias(name))
    return rows.join(merged, "__row", "left").withColumn(name, F.coalesce(name, F.array().cast(HITS))).select(*docs.columns, name)


def _index(benchmark: DataFrame, chunk: DataFrame, count: int, whole: bool):
    """The broadcast index of a chunk: one chunk's items and index at a time are
    all that the driver holds."""
    items = [(r.item_id, r.text) for r in chunk.collect()]
    df, average = _document_frequencies(benchmark, items, whole)
    return benchmark.sparkSession.sparkContext.broadcast(Index(items, count, average, df))


def _one_pass(docs: DataFrame, shared, name: str, text: str) -> DataFrame:
    kind = _parse_datatype_string(HITS)
    arrow = to_arrow_type(kind)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            found = pa.array([shared.value.search(t) for t in batch.column(batch.num_columns - 1).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*columns, name])

    return docs.select("*", as_bytes(text).alias("__raw")).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item."""
    return annotate(docs, benchmark, name="__hits").where("size(__hits) = 0").drop("__hits")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("hit"))
    return found.select("doc_id", "hit.*")
