"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; the unlabelled set is every other
text, whose label, if it has one, is never seen. The model minimises the
non-negative unbiased risk
    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))
with the logistic loss, for which it is convex; a step that would turn the
second part negative is shortened until it doesn't. The class prior, the share
of good texts among the unlabelled, comes from positive and unlabelled scores
alone: where a threshold parts off few bad texts, the share of unlabelled texts
above it is the prior's part of the share of positives above it, so the prior
is the least ratio of the two, each moved by its standard error. Features are
shares that describe a text's form, cut into bins; lang, source and ids are
never used. Every text outside the held-out fold takes part: bins, risks and
their derivatives are sums over the cluster, of a fixed size.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import as_bytes, bucket_of_id, materialize, small_batches, table

CUTS = [0.002, 0.01, 0.03, 0.08, 0.2, 0.5, 0.8, 0.92, 0.97, 0.99, 0.998]
BINS = len(CUTS) + 1
FOLDS = 5
ACCEPT_FROM = 0.3

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#*$%&<>@^~=+_\\/{}[]"
N_FEATURES = 14
ROUNDS, RIDGE = 12, 6e-3
#: The fit whose scores give the prior is held back more, so that it doesn't learn single texts.
PRIOR_RIDGE = 3e-2
#: The prior is sought among thresholds that leave this share of the positives.
LEAST_POSITIVES = 0.3


def form_of(raw: bytes) -> list[float]:
    """The shares that describe a text's form; all zero for a wordless one."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    chars = sum(map(len, words))
    without = lambda signs: (len(raw) - len(raw.translate(None, signs))) / chars
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, islice(words, 1, None))))
    return [
        np.log1p(n),
        chars / n,
        distinct / n**0.8,
        pairs / max(1, n - 1),
        sum(map(eq, words, islice(words, 1, None))) / n,
        without(_UPPER),
        without(_SYMBOLS),
        without(b"|"),
        without(b"!"),
        without(b".,;?") * chars / n,
        without(b"0123456789"),
        len(set(lines)) / len(lines),
        n / len(lines) / 100,
        max(map(len, words)) / 50,
    ]


def with_form(docs: DataFrame, text: str = "text", name: str = "__form") -> DataFrame:
    """docs without the text, with the array column ``name``."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, name)]
    schema = StructType([*docs.select(*kept).schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            forms = pa.array([form_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], forms], names=[*kept, name])

    return docs.select(*kept, as_bytes(text).alias("__raw")).mapInArrow(run, schema)


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def binned(self, forms: np.ndarray) -> np.ndarray:
        """Index of each feature's bin, as places in one weight vector."""
        out = np.empty(forms.shape, np.int64)
        for f in range(forms.shape[1]):
            out[:, f] = np.searchsorted(self.edges[f], forms[:, f], side="right") + f * BINS
        return out

    def score(self, forms: np.ndarray) -> np.ndarray:
        margin = self.weights[self.binned(forms)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _binned(forms: DataFrame, model: Model) -> DataFrame:
    """(good, places): the bins of each text as places in the weight vector."""

    def run(batches):
        for batch in batches:
            places = model.binned(np.asarray(batch.column(1).flatten()).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(places.astype(np.int16)), pa.list_(pa.int16()))], names=["good", "places"])

    return forms.select("good", "form").mapInArrow(run, "good int, places array<smallint>")


def _sums(texts: DataFrame, weights: np.ndarray, curvature: bool = True) -> dict[str, np.ndarray]:
    """Sums over all texts at the weights (bias last): for positives (p_) and the
    others (u_) the count n, the bins x, the loss of a negative verdict and a
    histogram of scores; of the others also the slope and the curvature."""
    size = N_FEATURES * BINS + 1
    names = {"p_n": 1, "u_n": 1, "p_x": size, "p_loss": 1, "u_loss": 1, "u_slope": size, "p_scores": 1000, "u_scores": 1000, "u_curve": size * size if curvature else 0}
    starts = dict(zip(names, np.cumsum([0, *names.values()]).tolist()))

    def run(batches):
        total = np.zeros(sum(names.values()))
        at = {k: total[starts[k] : starts[k] + n] for k, n in names.items()}
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False) == 1
            places = np.asarray(batch.column(1).flatten()).reshape(-1, N_FEATURES).astype(np.int64)
            p = 1 / (1 + np.exp(-np.clip(weights[places].sum(axis=1) + weights[-1], -40, 40)))
            loss = -np.log(np.maximum(1 - p, 1e-18))
            x = np.zeros((len(p), size), np.float32)
            x[np.arange(len(p))[:, None], places] = 1
            x[:, -1] = 1
            for k, some in (("p", good), ("u", ~good)):
                at[f"{k}_n"] += some.sum()
                at[f"{k}_loss"] += loss[some].sum()
                at[f"{k}_scores"] += np.bincount(np.minimum((p[some] * 1000).astype(np.int64), 999), minlength=1000)
            at["p_x"] += x[good].sum(axis=0)
            u = x[~good]
            at["u_slope"] += p[~good] @ u
            if curvature:
                at["u_curve"] += (u.T @ (u * (p * (1 - p))[~good, None])).ravel()
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "v"])

    held = texts.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    whole = np.zeros(sum(names.values()))
    whole[held.column("k").to_numpy()] = held.column("v").to_numpy()
    return {k: whole[starts[k] : starts[k] + n] for k, n in names.items()}


def fit(texts: DataFrame, prior: float, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(weights with the bias last, the sums at them): Newton steps on the risk,
    each shortened while the part that mustn't be negative would be."""
    size = N_FEATURES * BINS + 1
    hold = np.append(np.full(size - 1, ridge), 1e-9)
    weights = np.append(np.zeros(size - 1), np.log(prior / (1 - prior)))
    sums = _sums(texts, weights)
    for _ in range(rounds):
        n_p, n_u = sums["p_n"][0], sums["u_n"][0]
        slope = -prior * sums["p_x"] / n_p + sums["u_slope"] / n_u + hold * weights
        step = np.linalg.solve(sums["u_curve"].reshape(size, size) / n_u + np.diag(hold + 1e-6), slope)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        for _ in range(6):
            new = _sums(texts, weights - step)
            if new["u_loss"][0] / n_u - prior * new["p_loss"][0] / n_p >= 0:
                break
            step = step / 2
        else:
            break
        weights, sums = weights - step, new
        if np.abs(step).max() < 1e-2:
            break
    return weights, sums


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among the unlabelled, from histograms of scores."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    error = lambda share, n: np.sqrt((share * (1 - share) + 1 / n) / n)
    fine = above_p - error(above_p, n_p) >= LEAST_POSITIVES
    if not fine.any():
        return 0.5
    return float(np.clip(np.min((above_u + error(above_u, n_u))[fine] / (above_p - error(above_p, n_p))[fine]), 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all texts outside the held-out fold. No positive or no other text:
    every score is 0.5. Null texts and ids teach nothing; of repeated labels of an
    id, the lowest counts."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("quality"))
    good = known.where("quality = 1").where(bucket_of_id("__id", FOLDS) != 0).select("__id")
    open_docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null").where(bucket_of_id("doc_id", FOLDS) != 0)
    marked = with_form(open_docs.select("doc_id", "text"), name="form").join(good.withColumn("good", F.lit(1)), F.col("doc_id") == F.col("__id"), "left")
    forms = materialize(marked.select(F.coalesce("good", F.lit(0)).alias("good"), "form"), "forms")
    # the tails, where junk stands, get finer bins than equal counts would give
    quantiles = [F.percentile_approx(F.col("form")[k], CUTS, 10_000).alias(f"q{k}") for k in range(N_FEATURES)]
    row = forms.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n"), *quantiles).first()
    if not 0 < row.p < row.n:
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros(N_FEATURES * BINS), 0.0)
    model = Model(np.array([row[f"q{k}"] for k in range(N_FEATURES)]), np.zeros(N_FEATURES * BINS), 0.0)
    texts = materialize(_binned(forms, model), "binned-forms")
    _, sums = fit(texts, 0.5, ridge=PRIOR_RIDGE)  # any prior ranks the texts; its scores give the prior
    prior = prior_of(sums["p_scores"], sums["u_scores"])
    weights, sums = fit(texts, prior)
    n_p, n_u = sums["p_n"][0], sums["u_n"][0]
    of_all = float(np.clip((prior * n_u + n_p) / (n_u + n_p), 0.02, 0.98))
    model.weights = weights[:-1]
    # from the unlabelled set's share to that of all texts
    model.bias = float(weights[-1] + np.log(of_all / (1 - of_all)) - np.log(prior / (1 - prior)))
    return model


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with score and predicted (replaced if there).

    Null, empty and wordless texts have the score of an all-zero form. Rows are
    judged one by one, repeated ones alike; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = with_form(docs.drop("score", "predicted"), text)
    kept = [c for c in held.columns if c != "__form"]
    schema = StructType([*held.select(*kept).schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        for batch in batches:
            forms = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(-1, N_FEATURES)
            score = shared.value.score(forms)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= ACCEPT_FROM).astype(np.int32))], names=[*kept, "score", "predicted"])

    return held.mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = classify(docs, model)
    return found.select("doc_id", (bucket_of_id("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
