"""Corpus statistics, consistency and query traces."""

from __future__ import annotations

import os
import platform
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import lexical

#: Values of the opt-out variable that count as yes; fixed values.
TRUTHY = {"1", "true", "yes", "on"}


def corpus_stats(articles: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: articles, chunks, vectors, dimensions, last_indexed."""
    last = F.max("indexed_at") if "indexed_at" in articles.columns else F.lit(None).cast("string")
    a = articles.agg(F.count(F.lit(1)).alias("articles"), last.alias("last_indexed"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    v = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("vec")).alias("dimensions"))
    return a.crossJoin(c).crossJoin(v)


@dataclass
class Consistency:
    ok: bool
    counts: dict[str, int]
    matches: dict[str, int] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)


class InconsistentCorpus(RuntimeError):
    pass


def consistency_row(index: DataFrame, chunk_index: DataFrame, vectors: DataFrame, keywords: list[str]) -> DataFrame:
    """One row of counts, and of matches of each sample keyword in both indexes."""
    own = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"n_{name}"), *[F.count_if(lexical.matches(df, X.phrases(k))).alias(f"{name}_{i}") for i, k in enumerate(keywords)])
    return own(index, "articles").crossJoin(own(chunk_index, "chunks")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("n_vectors")))


def check_consistency(index: DataFrame, chunk_index: DataFrame, vectors: DataFrame, keywords: list[str]) -> Consistency:
    row = consistency_row(index, chunk_index, vectors, keywords).first().asDict()
    a, c, v = row["n_articles"], row["n_chunks"], row["n_vectors"]
    problems = []
    if a and not c:
        problems.append("articles without chunks")
    if a and not v:
        problems.append("articles without vectors")
    if c and not a:
        problems.append("chunks without articles")
    for name in ("articles", "chunks"):
        if a and keywords and not any(row[f"{name}_{i}"] for i in range(len(keywords))):
            problems.append(f"no sample keyword matches the {name} index")
    return Consistency(not problems, {"articles": a, "chunks": c, "vectors": v}, {k: x for k, x in row.items() if k[:2] != "n_"}, problems)


def startup_gate(report: Consistency, variable: str = "TEXTSCOPE_SKIP_STARTUP_CHECK") -> None:
    """Refuse to serve an inconsistent corpus, unless the variable says so."""
    if not report.ok and os.environ.get(variable, "").strip().lower() not in TRUTHY:
        raise InconsistentCorpus("; ".join(report.problems))


def environment(spark: SparkSession, embedder: str = "") -> dict[str, str]:
    return {"spark": spark.version, "python": platform.python_version(), "embedder": embedder}


def environment_drift(built: dict[str, str], now: dict[str, str]) -> dict[str, tuple[str | None, str | None]]:
    return {k: (built.get(k), now.get(k)) for k in sorted({*built, *now}) if built.get(k) != now.get(k)}


def trace(query: str, index: DataFrame) -> dict:
    """What a query is turned into, and the plan that serves it."""
    terms = X.phrases(query)
    plan = lexical.search(index, query)._jdf.queryExecution().toString() if terms else ""
    return {"query": query, "phrases": terms, "plan": plan}


def format_stats(stats: dict, counts: dict[str, int]) -> str:
    lines = [f"{k}: {v}" for k, v in stats.items()]
    return "\n".join([*lines, *(f"  {n:>8}  {name}" for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))])
