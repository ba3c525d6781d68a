"""Linear hybrid of two score lists, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.25
RRF_K = 60
FALLBACK_BOOST = 0.15


def hybrid(bm25: DataFrame, vector: DataFrame, *, alpha: float = ALPHA, limit: int = 50) -> DataFrame:
    """(article_id, bm25_score, cosine_score, hybrid_score); a missing side is 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in 0..1")
    both = bm25.select("article_id", "bm25_score").join(vector.select("article_id", "cosine_score"), "article_id", "full_outer").fillna(0.0, ["bm25_score", "cosine_score"])
    scored = both.withColumn("hybrid_score", alpha * F.col("bm25_score") + (1 - alpha) * F.col("cosine_score"))
    return scored.orderBy(F.round("hybrid_score", 6).desc(), "article_id").limit(limit)


def rrf(main: DataFrame, chunk: DataFrame | None, boost_types: list[str] | None = None, *, k: int = RRF_K, limit: int = 50, chunk_rank_order: str = "weakest_first") -> DataFrame:
    """main (article_id, source_type, ranking_score), chunk (article_id, chunk_raw).

    Adds 1 / (k + rank) over both lists and 1 / (k + 1) for boosted types, keeps
    ``limit`` rows, then those that the main list has. Chunks are ranked from the
    weakest raw score unless chunk_rank_order is "best_first". Without chunks the
    scores stay, and boosted types gain FALLBACK_BOOST. The lists are short
    (a candidate pool), so one task ranks them."""
    boosted = F.coalesce(F.col("source_type").isin(list(boost_types or [])), F.lit(False)) if boost_types else F.lit(False)
    if chunk is None:
        out = main.withColumn("rrf_score", F.col("ranking_score") + F.when(boosted, FALLBACK_BOOST).otherwise(0.0))
        return out.orderBy(F.round("rrf_score", 9).desc(), "article_id").limit(limit)
    order = F.round("chunk_raw", 6).desc() if chunk_rank_order == "weakest_first" else F.round("chunk_raw", 6).asc()
    a = main.withColumn("main_rank", F.row_number().over(Window.orderBy(F.round("ranking_score", 6).desc(), "article_id")))
    b = chunk.select("article_id", F.row_number().over(Window.orderBy(order, "article_id")).alias("chunk_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + k), F.lit(0.0))
    fused = a.join(b, "article_id", "full_outer").withColumn("rrf_score", part("main_rank") + part("chunk_rank") + F.when(boosted, 1.0 / (k + 1)).otherwise(0.0))
    top = fused.orderBy(F.round("rrf_score", 9).desc(), F.col("main_rank").asc_nulls_last(), "article_id").limit(limit)
    return top.where(F.col("main_rank").isNotNull())
