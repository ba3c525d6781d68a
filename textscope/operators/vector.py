"""Cosine search over unit vectors kept as array<float>."""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import not_excluded


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(query: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in query))
    return [float(x) / norm for x in query] if norm > 0 else [float(x) for x in query]


def search(vectors: DataFrame, meta: DataFrame, query: list[float], *, limit: int = 50, axes: DataFrame | None = None, axis: str | None = None) -> DataFrame:
    """(article_id, cosine_score) of the nearest rows that aren't excluded; ties go
    by article_id. A vector of another dimension than the query is an error."""
    q = unit(query)
    checked = F.when(F.size("vec") != len(q), F.raise_error(F.lit(f"vector dimension differs from {len(q)}")).cast("double")).otherwise(
        dot(F.col("vec"), F.array(*[F.lit(x) for x in q]))
    )
    some = vectors
    if axis is not None:
        some = some.join(axes.where(F.col("axis_id") == axis).select("article_id").distinct(), "article_id", "left_semi")
    kept = some.join(meta.select("article_id", "category"), "article_id", "left").where(not_excluded())
    return kept.select("article_id", checked.alias("cosine_score")).orderBy(F.round("cosine_score", 6).desc(), "article_id").limit(limit)


def encode(df: DataFrame, embedder, text: str, name: str = "vec") -> DataFrame:
    """df with vectors of a text column; the embedder has DIM and encode_batch."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.encode_batch(s.fillna("").tolist())))

    return df.withColumn(name, run(F.col(text)))


class HashEmbedder:
    """Deterministic vectors from hashes of character pairs, for tests and demos."""

    def __init__(self, dim: int = 64):
        self.DIM = dim

    def encode_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.DIM
            for a, b in zip(t, t[1:]):
                h = zlib.crc32((a + b).encode("utf-8", "replace"))
                v[h % self.DIM] += 1.0 if h & (1 << 20) else -1.0
            out.append(unit(v))
        return out
