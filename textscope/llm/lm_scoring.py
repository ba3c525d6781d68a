"""Language-model scores by a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot).
Classes are groups of word endings. The first factor is a softmax over the
classes that adds up weights of the previous word, of the word before it (a
skip feature) and of the hashed pair; the second one a softmax over the class's
``SLOTS`` slots with weights of the same two words, hashed with the class. The
most frequent words of a class have a slot each. All others share the last one,
where a word's part is its smoothed unigram share, with one part kept for
unknown words.

Training counts cover every training text. The weights are learned by
distributed gradient updates: in each of ``ROUNDS`` rounds tasks take that
round's share of the training texts, so that one epoch sees each text once. A
task updates its own copy of the weights every ``CHUNK`` tokens, with a rate
that falls by what a feature has seen, and the copies are averaged on the
cluster, each feature by how often a task has met it. A task takes about
``TASK_TOKENS`` tokens whatever the corpus. Scoring runs in numpy batches. Words
outside the ``HEAD`` most frequent ones get their counts by a join, so what is
sent to the workers has a fixed bound.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, MapType, StructField, StructType

from .common import as_bytes, bucket_of_id, materialize, small_batches, table

FOLDS, HELD_OUT = 7, 2
#: Words sent to the workers with their counts; all others are joined.
HEAD = 1 << 18
CLASSES, SLOTS = 32, 32
#: Frequent words by which endings are grouped.
NEAR = 40
#: Feature rows: own ones of frequent words, endings, and hashed pairs; and those
#: hashed with a class, the most frequent words without sharing.
OWN, ENDINGS, PAIRS = 4096, 2048, 1 << 14
WORDS = OWN + ENDINGS
JOINT = 1 << 15
ROUNDS, RATE = 4, 1.0
#: Tokens worked on at a time: their probabilities stay in a core's cache.
CHUNK = 1 << 13
#: Training tokens of a task and round.
TASK_TOKENS = 3_000_000
#: Feature rows that are averaged together.
BLOCK = 1 << 9
END = b""
SLICE = 1 << 20


def tokens_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _ending(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


def _slices(batch: pa.RecordBatch, column: int):
    """(rows, their texts) of a batch, about ``SLICE`` bytes of text at a time: a
    token takes far more room as an object than in the text."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for k, text in enumerate(texts, 1):
        size += len(text)
        if size >= SLICE or k == len(texts):
            yield batch.slice(start, k - start), texts[start:k]
            start, size = k, 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over the texts' words and one end each."""
    small_batches(docs.sparkSession)
    names = ["word", "c"]

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.update(tokens_of(raw))
                held[END] += 1
                if len(held) > 150_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=names)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=names)

    return docs.select(as_bytes("text").alias("raw")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _raised(weights: np.ndarray, features: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A softmax before its division: the numerators, and each row's sum."""
    z = weights.take(features[:, 0], axis=0)
    for k in range(1, features.shape[1]):
        z += weights.take(features[:, k], axis=0)
    z += bias
    ones = np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        out = np.exp(z)
        total = out @ ones
    if not (total.min(initial=1) > 1e-6 and total.max(initial=1) < 1e30):  # only then it takes the rows' maxima
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=out)
        total = out @ ones
    return out, total


def _softmax(weights: np.ndarray, features: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out, total = _raised(weights, features, bias)
    out /= total[:, None]
    return out


class Tokens:
    """Encoded texts: ranks (-1 unknown to the head), classes, slots, feature rows of
    both factors, and the number of tokens of each text."""

    def __init__(self, words, rank, cls, slot, first, second, sizes):
        self.words, self.rank, self.cls, self.slot, self.first, self.second, self.sizes = words, rank, cls, slot, first, second, sizes


class Model:
    """What workers need to score; its size does not depend on the corpus.

    by_ending: for each two-byte ending, the count and the number of its words."""

    def __init__(self, words: list[bytes], counts: list[int], ending_class: np.ndarray, by_ending: np.ndarray):
        self.rank = {w: k for k, w in enumerate(words)}
        self.end = self.rank[END]
        c = np.array(counts, np.float64)
        self.log_count = np.log10(c + 1)
        endings = np.array([_ending(w) for w in words])
        order = np.arange(len(words))
        self.ending_class = ending_class
        self.cls = ending_class[endings]
        self.fid = np.where(order < OWN, order, OWN + endings % ENDINGS).astype(np.int64)
        # a slot each for the first words of a class, in the order of their counts
        by = np.argsort(self.cls, kind="stable")
        first = np.searchsorted(self.cls[by], np.arange(CLASSES))
        place = np.empty(len(words), np.int64)
        place[by] = order - first[self.cls[by]]
        self.slot = np.minimum(place, SLOTS - 1)
        own = self.slot < SLOTS - 1
        total = np.zeros(CLASSES)
        np.add.at(total, ending_class, by_ending.sum(axis=1))
        rest = total.copy()
        np.subtract.at(rest, self.cls[own], c[own] + 1)
        self.log_rest = np.log10(np.maximum(rest, 0) + 1)
        shares = np.zeros((CLASSES, SLOTS))
        shares[self.cls[own], self.slot[own]] = c[own]
        shares[:, -1] = np.maximum(rest, 0)
        shares += 0.1
        self.bias = [np.log(np.maximum(total, 1) / np.maximum(total, 1).sum())[None].astype(np.float32), np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)]
        self.weights = [np.zeros((2 * WORDS + PAIRS, CLASSES), np.float32), np.zeros((2 * JOINT, SLOTS), np.float32)]

    def encode(self, texts: list[bytes]) -> Tokens:
        words: list[bytes] = []
        sizes = np.empty(len(texts), np.int64)
        for k, raw in enumerate(texts):
            own = tokens_of(raw)
            own.append(END)
            words += own
            sizes[k] = len(own)
        rank = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))
        cls, fid, slot = self.cls[rank], self.fid[rank], self.slot[rank]
        tail = np.flatnonzero(rank < 0)
        if len(tail):
            ending = np.fromiter((_ending(words[k]) for k in tail.tolist()), np.int64, len(tail))
            cls[tail], fid[tail], slot[tail] = self.ending_class[ending], OWN + ending % ENDINGS, SLOTS - 1
        end = self.fid[self.end]
        one = np.concatenate([[end], fid[:-1]])
        two = np.concatenate([[end], one[:-1]])
        two[np.cumsum(sizes)[:-1]] = end
        pair = (two * 7919 + one * 31) % PAIRS
        half = JOINT // 2
        joint = lambda f: np.where(f < half // CLASSES, f * CLASSES + cls, half + (f * 31 + cls * 7919) % half)
        return Tokens(words, rank, cls, slot, np.stack([one, WORDS + two, 2 * WORDS + pair], axis=1), np.stack([joint(one), JOINT + joint(two)], axis=1), sizes)

    def probabilities(self, t: Tokens, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """P(class | history), and P(slot | class, history) of each token's class."""
        return _softmax(self.weights[0], t.first[at], self.bias[0]), _softmax(self.weights[1], t.second[at], self.bias[1][t.cls[at]])

    def log_part(self, t: Tokens) -> np.ndarray:
        """log10 P(token | history) - log10 (its count + 1), by token."""
        out = np.empty(len(t.cls))
        for a in range(0, len(t.cls), CHUNK):
            at = slice(a, a + CHUNK)
            c, s = t.cls[at], t.slot[at]
            (p, all_p), (q, all_q) = _raised(self.weights[0], t.first[at], self.bias[0]), _raised(self.weights[1], t.second[at], self.bias[1].take(c, axis=0))
            k = np.arange(len(p))
            found = np.log10(np.maximum(p[k, c] / all_p, 1e-30)) + np.log10(np.maximum(q[k, s] / all_q, 1e-30))
            out[at] = found - np.where(s == SLOTS - 1, self.log_rest[c], self.log_count[t.rank[at]])
        return out


def _row_sums(error: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows order[start : start + size]. Most segments are of one row,
    which is taken as it is; the others are added two columns at a time."""
    out = error.take(order[starts], axis=0)
    many = sizes > 1
    if many.any():
        n = sizes[many]
        rows = error.take(order[np.repeat(many, sizes)], axis=0).view(np.complex64)
        out[many] = np.add.reduceat(rows, np.cumsum(n) - n, axis=0).view(np.float32)
    return out


def _update(weights: np.ndarray, seen: np.ndarray, met: np.ndarray, features: np.ndarray, error: np.ndarray, rate: float) -> None:
    """A gradient step of some tokens: error is seen - expected by token. ``seen``
    holds each row's sum of squared gradients, ``met`` how often it occurred."""
    for k in range(features.shape[1]):
        row = features[:, k].astype(np.uint16)
        order = np.argsort(row, kind="stable")  # two bytes: sorted by radix
        rows = row[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        sizes = np.diff(starts, append=len(rows))
        g, at = _row_sums(error, order, starts, sizes), rows[starts].astype(np.int64)
        now = seen[at] + np.einsum("ij,ij->i", g, g)
        seen[at] = now
        met[at] += sizes
        g *= (rate / np.sqrt(now + 1))[:, None]
        g += weights.take(at, axis=0)
        weights[at] = g


def _ending_counts(docs: DataFrame, head: list[bytes]) -> np.ndarray:
    """How often each two-byte ending follows each single word, counted over all
    texts; the last single word before it in the text counts. A task holds one
    table of 65,536 x NEAR counts, and so does the driver."""
    single = {w: k for k, w in enumerate(head[:NEAR])}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(single)
    cells = (1 << 16) * NEAR
    names = ["k", "n"]

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, texts in _slices(batch, 0):
                words: list[bytes] = []
                firsts = []
                for raw in texts:
                    firsts.append(len(words))
                    words += tokens_of(raw)
                if not words:
                    continue
                near = np.fromiter(map(shared.value.get, words, repeat(-1)), np.int64, len(words))
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                letters = np.frombuffer(b" ".join(words), np.uint8)
                stop = np.cumsum(lengths + 1) - 1
                ending = letters[stop - 1].astype(np.int64)
                long = lengths > 1
                ending[long] += letters[stop[long] - 2].astype(np.int64) << 8
                at = np.arange(len(words))
                start = np.zeros(len(words), np.int64)
                firsts = [k for k in firsts if k < len(words)]
                start[firsts] = firsts
                last = np.maximum.accumulate(np.where(near >= 0, at, -1))
                fine = (near < 0) & (last >= np.maximum.accumulate(start))
                seen, times = np.unique(ending[fine] * NEAR + near[last[fine]], return_counts=True)
                total[seen] += times
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=names)

    held = docs.select(as_bytes("text").alias("raw")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(cells)
    m[held.column("k").to_numpy()] = held.column("n").to_numpy()
    return m.reshape(1 << 16, NEAR)


def _ending_groups(docs: DataFrame, head: list[bytes]) -> np.ndarray:
    """Group of each two-byte ending: endings that follow the same frequent words
    stand together (k-means on square-rooted shares, counted over all texts)."""
    m = _ending_counts(docs, head)
    group = np.arange(1 << 16) % CLASSES
    mass = m.sum(axis=1)
    live = np.flatnonzero(mass > 0)
    if len(live) > CLASSES:
        x = np.sqrt(m[live] / mass[live, None])
        weight = mass[live]
        first = np.argsort(-weight, kind="stable")
        centers = [x[first[0]]]
        for _ in range(CLASSES - 1):  # farthest first, weighed by how common
            far = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0) * np.sqrt(weight)
            centers.append(x[int(far.argmax())])
        centers = np.array(centers)
        for _ in range(20):
            near = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(CLASSES):
                if (near == k).any():
                    centers[k] = np.average(x[near == k], axis=0, weights=weight[near == k])
        group[live] = near
    return group.astype(np.int64)


def _round(docs: DataFrame, model: Model, tokens: float) -> list[np.ndarray]:
    """The weights after one round over docs of about so many tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    parts = max(1, math.ceil(tokens / TASK_TOKENS))
    merged = max(1, math.isqrt(parts))

    def run(batches):
        m = shared.value
        weights = [w.copy() for w in m.weights]
        seen, met = ([np.zeros(len(w), np.float32) for w in weights] for _ in range(2))
        for batch in batches:
            for _, texts in _slices(batch, 0):
                t = m.encode(texts)
                for a in range(0, len(t.cls), CHUNK):
                    at = slice(a, a + CHUNK)
                    for k, (features, bias, y) in enumerate(((t.first, m.bias[0], t.cls), (t.second, m.bias[1].take(t.cls[at], axis=0), t.slot))):
                        error, total = _raised(weights[k], features[at], bias)
                        error /= -total[:, None]
                        error[np.arange(len(error)), y[at]] += 1
                        _update(weights[k], seen[k], met[k], features[at], error, RATE)
        group = TaskContext.get().partitionId() % merged
        for k, w in enumerate(weights):
            for a in range(0, len(w), BLOCK):
                n = met[k][a : a + BLOCK]
                if n.any():
                    moved = (w[a : a + BLOCK] - m.weights[k][a : a + BLOCK]) * n[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([k], pa.int32()), pa.array([a], pa.int32()), pa.array([np.column_stack([moved, n]).tobytes()])], names=["part", "factor", "at", "sums"])

    def merge(batches):
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                now = np.frombuffer(raw, np.float32).astype(np.float64)
                held[tuple(key)] = held[tuple(key)] + now if tuple(key) in held else now
        for key, x in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in key), pa.array([x.astype(np.float32).tobytes()])], names=["part", "factor", "at", "sums"])

    kind = "part int, factor int, at int, sums binary"
    made = docs.select(as_bytes("text").alias("raw")).coalesce(parts).mapInArrow(run, kind)
    if merged > 8:  # in two steps, so that no task takes a block of every task
        made = made.repartition(8 * merged, "part", "factor", "at").mapInArrow(merge, kind)
    found = made.withColumn("part", F.lit(0)).repartition(8, "factor", "at").mapInArrow(merge, kind)
    out = [w.copy() for w in model.weights]
    for r in found.toLocalIterator():
        w = out[r.factor]
        x = np.frombuffer(r.sums, np.float32).reshape(-1, w.shape[1] + 1)
        w[r.at : r.at + len(x)] += x[:, :-1] / np.maximum(x[:, -1:], 1)
    shared.unpersist()
    return out


def _frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The words down to a count that at most ``most`` words reach, most frequent
    first. The count comes from a histogram with at most some 70,000 steps, so
    that only the words asked for are sent, whatever the number of tasks."""
    step = F.when(F.col("c") < 65_536, F.col("c")).otherwise(65_536 + F.floor(F.log2("c") * 16)).cast("long")
    above, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        above += r.n
        if above > most:
            break
        least = r.step
    if least is None:
        return [], []
    held = counts.where(step >= least).select("word", "c").toArrow()
    pairs = sorted(zip(held.column("c").to_pylist(), held.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    return [w for _, w in pairs], [c for c, _ in pairs]


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame, int, int]:
    """(model, counts (word, c), N, V) from docs (doc_id, text)."""
    counts = materialize(word_counts(docs), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words, totals = _frequent(counts, HEAD)
    if END not in words:
        words.append(END)
        totals.append((counts.where(F.length("word") == 0).select("c").first() or [0])[0])
    groups = _ending_groups(docs, words)
    by_ending = np.zeros((1 << 16, 2))
    ending = F.conv(F.hex(F.expr("substring(word, -least(2, length(word)), 2)")), 16, 10).cast("int")
    for r in counts.groupBy(F.coalesce(ending, F.lit(0)).alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        by_ending[r.e] = r.c, r.v
    model = Model(words, totals, groups, by_ending)
    for k in range(rounds if n else 0):
        share = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k)
        model.weights = _round(share, model, n / rounds)
    return model, counts, n, v


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigrams), score (the model), both log10.

    Null and empty texts are the end token alone; repeated rows are scored each;
    a null doc_id is a training row. Empty docs: empty. No training row: counts
    are zero, scores finite."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held_out = bucket_of_id("doc_id", FOLDS) == HELD_OUT
    model, counts, n, v = train(docs.where(~held_out))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    tail_kind = pa.map_(pa.binary(), pa.int64())

    def run(batches):
        m = shared.value
        for batch, texts in (x for whole in batches for x in _slices(whole, 2)):
            t = m.encode(texts)
            words, rank, sizes = t.words, t.rank, t.sizes
            stops = np.cumsum(sizes)
            starts = stops - sizes
            part = m.log_part(t)
            known = np.where(rank >= 0, m.log_count[rank], 0.0)
            tails: list[list] = []
            places = np.flatnonzero(rank < 0)
            edges = np.searchsorted(places, np.concatenate([starts, stops[-1:]]))
            for a, b in zip(edges[:-1], edges[1:]):
                tails.append(list(Counter(words[k] for k in places[a:b].tolist()).items()))
            hit = (rank >= 0) & (m.log_count[rank] > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(np.add.reduceat(hit.astype(np.int64), starts)), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(part, starts)), pa.array(tails, tail_kind)],
                names=["row", "doc_id", "n_tokens", "known", "log_counts", "class_part", "tail"],
            )

    fields = [StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("log_counts", DoubleType()), StructField("class_part", DoubleType()), StructField("tail", MapType(BinaryType(), LongType()))]
    schema = StructType([StructField("row", LongType()), docs.schema["doc_id"], *fields])
    made = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", as_bytes("text").alias("raw")).mapInArrow(run, schema), "scored")
    rare = made.select("row", F.explode("tail").alias("word", "tf")).join(counts, "word")
    sums = rare.groupBy("row").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_logs"))
    logs = F.col("log_counts") + F.coalesce("tail_logs", F.lit(0.0))
    return made.drop("tail").join(sums, "row", "left").select(
        "doc_id",
        (bucket_of_id("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (logs + F.col("class_part")).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
