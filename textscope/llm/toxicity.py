"""Toxicity severity by cumulative-link ordinal regression.

Severity has ordered grades: 0 for texts labelled clean, and 1 to 3 for toxic
ones by how clearly others tell them to be toxic: the labelled sample is dealt
into ``FOLDS`` folds, each text gets the log odds of a model fitted on the other
folds, and the toxic texts' thirds by those odds are the grades. One weight per
word is shared by all grades, ordered thresholds part them:
P(grade > k) = sigmoid(weights . x - theta_k), and the expected severity is the
sum of those. Features are log word counts of the ``FEATURES`` words that part
the labelled sample best, counted on the cluster.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import as_bytes, materialize, sampled, small_batches, table, words_of

#: Labelled texts that the model is fitted on.
SAMPLE = 24_000
FEATURES = 384
GRADES = 4
FOLDS = 2
#: Log odds from which a word enters at its full weight.
TELLING_ODDS = 3.0
REJECT_FROM = 0.5


def _word_sets(docs: DataFrame) -> DataFrame:
    """(toxic, counts): each text's words with their counts."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            maps = [list(Counter(w.decode("utf-8", "replace") for w in words_of(raw)).items()) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.map_(pa.string(), pa.int32()))], names=["toxic", "counts"])

    return docs.select("toxic", as_bytes("text").alias("raw")).mapInArrow(run, "toxic int, counts map<string,int>")


class Ordinal:
    def __init__(self, weights: dict[bytes, float], theta: list[float]):
        self.weights, self.theta = weights, theta

    def severity(self, raw: bytes) -> tuple[float, float]:
        """(P(grade > 0), expected grade)."""
        get = self.weights.get
        seen = Counter(w for w in words_of(raw) if w in self.weights)
        margin = sum(get(w) * math.log2(1 + n) for w, n in seen.items())
        above = [1 / (1 + math.exp(-max(-60.0, min(60.0, margin - t)))) for t in self.theta]
        return above[0], sum(above)


def fit_ordinal(rows: list[tuple[int, dict[int, float]]], width: int, grades: int = GRADES, ridge: float = 0.02, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by full-batch Adam on the negative log
    likelihood; thresholds are a first one and positive steps."""
    y = np.array([g for g, _ in rows])
    at = np.concatenate([np.full(len(x), k) for k, (_, x) in enumerate(rows)] or [np.zeros(0)]).astype(np.int64)
    col = np.array([c for _, x in rows for c in x], np.int64)
    val = np.array([v for _, x in rows for v in x.values()], float)
    p = np.concatenate([np.zeros(width), [2.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, theta = p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
        s = np.bincount(at, val * w[col], len(y))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            up, low = 1 / (1 + np.exp(s - edge[y + 1])), 1 / (1 + np.exp(s - edge[y]))
        mass = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / mass, low * (1 - low) / mass
        g_s = (d_up - d_low) / len(y)
        g_t = np.array([(-(d_up * (y == k)).sum() + (d_low * (y == k + 1)).sum()) / len(y) for k in range(grades - 1)])
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([np.bincount(col, val * g_s[at], width) + ridge * w / max(1, len(y)) * 10, tail[:1], tail[1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))


def graded(rows: list[tuple[int, dict[int, float]]], width: int, folds: int = FOLDS, grades: int = GRADES) -> list[tuple[int, dict[int, float]]]:
    """rows (toxic, features) as (grade, features): toxic ones in equal parts by the
    log odds that models of the other folds give them; equal odds, equal grades."""
    odds = np.zeros(len(rows))
    for k in range(folds):
        rest = [r for i, r in enumerate(rows) if i % folds != k]
        w, theta = fit_ordinal(rest, width, grades=2)
        for i in range(k, len(rows), folds):
            odds[i] = sum(w[c] * v for c, v in rows[i][1].items()) - theta[0]
    toxic = np.array([y for y, _ in rows]) == 1
    cuts = np.quantile(odds[toxic], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, odds, side="left"), 0)
    return [(int(g), x) for g, (_, x) in zip(grade, rows)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Ordinal:
    """Fit on texts whose label is 0 or 1, ``sample`` at most; none, or no toxic
    one: a model that finds nothing. Of several labels of an id the highest counts."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    some = sampled(known, "__id", sample)
    texts = docs.select("doc_id", "text").where("text is not null").join(some, F.col("doc_id") == F.col("__id"))
    held = materialize(_word_sets(texts), "toxic-words")
    total = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    yes, no = total.get(1, 0), total.get(0, 0)
    if not yes or not no:
        return Ordinal({}, [30.0, 31.0, 32.0])
    counts = held.select("toxic", F.explode(F.map_keys("counts")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (yes + 1)) - F.log((F.col("b") + 0.5) / (no + 1))
    # a G-like score: how surprising the split of the word's texts is
    chosen = counts.where("a + b >= 3").select("word", "a", odds.alias("odds"), ((F.col("a") + 0.5) * F.abs(odds)).alias("rank")).orderBy(F.desc("rank"), "word").limit(features).collect()
    place = {r.word: k for k, r in enumerate(chosen)}
    # words that hardly part the sample enter small, so that the penalty holds them down
    trust = {r.word: min(1.0, abs(r.odds) / TELLING_ODDS) ** 2 for r in chosen}
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(set(place))

    def run(batches):
        for batch in batches:
            maps = [[(w, n) for w, n in x if w in wanted.value] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.map_(pa.string(), pa.int32()))], names=["toxic", "counts"])

    rows = []
    for r in held.mapInArrow(run, held.schema).toLocalIterator():
        rows.append((r.toxic, {place[w]: trust[w] * math.log2(1 + n) for w, n in r.counts.items()}))
    rows.sort(key=lambda x: (x[0], sorted(x[1].items())))  # partitions come in any order
    w, theta = fit_ordinal(graded(rows, len(place)), len(place))
    return Ordinal({word.encode(): float(w[k]) * trust[word] for word, k in place.items()}, theta.tolist())


def grade(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """docs with p_toxic, severity (expected grade), grade (int, nearest) and toxic
    (p_toxic of at least REJECT_FROM); columns of these names are replaced.

    Null, empty and wordless texts get the severity of no evidence. Rows keep
    their other columns and are judged one by one; an empty table stays empty."""
    spark = docs.sparkSession
    small_batches(spark)
    new = [StructField("p_toxic", DoubleType()), StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType())]
    kept = docs.drop(*(f.name for f in new))
    shared = spark.sparkContext.broadcast(model)
    names = [*kept.columns, *(f.name for f in new)]

    def run(batches):
        for batch in batches:
            found = np.array([shared.value.severity(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, 2)
            made = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.rint(found[:, 1]).astype(np.int32)), pa.array(found[:, 0] >= REJECT_FROM)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return kept.select("*", as_bytes(text).alias("__raw")).mapInArrow(run, StructType([*kept.schema.fields, *new]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't reject, with their columns."""
    marked = grade(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text"), train(docs, labels))
    return marked.where("not toxic").select("__row.*")
