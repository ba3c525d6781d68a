"""The search pipeline: lexical and vector pools, hybrid, rank fusion, entities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fusion, lexical, vector
from ..operators.entity import EntityScorer, IntentDetector


@dataclass
class Searcher:
    """index: lexical.article_index(articles); chunks: lexical.chunk_index(chunks).

    Write both once (or persist them): every search scans them."""

    index: DataFrame
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    axes: DataFrame | None = None
    embedder: object | None = None
    entities: EntityScorer | None = None
    intents: IntentDetector | None = None
    alpha: float = fusion.ALPHA
    pool: int = 50
    chunk_rank_order: str = "weakest_first"
    meta_columns: tuple[str, ...] = field(default=("title", "source_type", "category", "pub_year", "tags"))

    def hybrid_pool(self, query: str, query_vector: list[float] | None, axis: str | None) -> DataFrame:
        spark = self.index.sparkSession
        none = lambda name: spark.createDataFrame([], self.index.select("article_id").schema).withColumn(name, F.lit(0.0))
        use_vector = query_vector is not None and self.vectors is not None and self.alpha < 1
        terms = X.phrases(query)
        # the index folds its texts for whatever is read of it; the counts serve both sides
        counts = lexical.article_counts(self.index, terms) if self.alpha > 0 and terms else None
        a = lexical.search(self.index, query, limit=self.pool, axes=self.axes, axis=axis, counts=counts) if self.alpha > 0 else none("bm25_score")
        b = vector.search(self.vectors, self.index if counts is None else counts, query_vector, limit=self.pool, axes=self.axes, axis=axis) if use_vector else none("cosine_score")
        return fusion.hybrid(a, b, alpha=self.alpha, limit=self.pool)

    def search(self, query: str, *, axis: str | None = None, limit: int = 10, query_vector: list[float] | None = None) -> DataFrame:
        """Hits by falling score, each with its best chunks. A blank query: none."""
        found = self.entities.detect(query) if self.entities and query.strip() else []
        boost = self.intents.boost_types(self.intents.detect(query)) if self.intents else None
        wide = self.entities.expand(query, found) if found else query
        if query_vector is None and self.embedder is not None and self.alpha < 1:
            query_vector = self.embedder.encode_batch([query])[0]
        pool = lexical.shared(self.hybrid_pool(wide if query.strip() else "", query_vector if query.strip() else None, axis), "article_id")
        # the pool's rows alone, so that the texts of the others stay where they are
        meta = self.index.select("article_id", *self.meta_columns, "content").join(F.broadcast(pool.select("article_id")), "article_id", "left_semi")
        main = pool.join(meta, "article_id", "left").withColumn("ranking_score", F.col("hybrid_score"))
        terms = X.phrases(wide)
        counts = lexical.chunk_counts(self.chunks, terms, X.phrases(query)) if self.chunks is not None and terms else None
        signal = lexical.chunk_signal(self.chunks, wide, limit=self.pool, counts=counts) if self.chunks is not None and query.strip() else None
        fused = fusion.rrf(main, signal, boost, limit=self.pool, chunk_rank_order=self.chunk_rank_order)
        out = fused.withColumn("ranking_score", F.col("rrf_score"))
        if found:
            out = self.entities.score(out, found).withColumn("ranking_score", F.col("entity_score"))
        top = lexical.shared(out.orderBy(F.round("ranking_score", 9).desc(), "article_id").limit(limit), "article_id")
        top = top.withColumn("content_snippet", X.snippet(F.col("content"), query.split())).withColumn("content_full", F.left("content", F.lit(500))).drop("content")
        if self.chunks is None:
            return top.withColumn("chunk_hits", F.lit(0).cast("long")).orderBy(F.round("ranking_score", 9).desc(), "article_id")
        hits = lexical.chunk_hits(self.chunks, query, top, counts=counts)
        best = hits.groupBy("article_id").agg(
            F.max("chunk_hits").alias("chunk_hits"),
            F.array_sort(F.collect_list(F.struct("chunk_rank", "chunk_index", "chunk_text", F.col("bm25_raw").alias("score")))).alias("matched_chunks"),
        )
        return top.join(best, "article_id", "left").withColumn("chunk_hits", F.coalesce("chunk_hits", F.lit(0).cast("long"))).orderBy(F.round("ranking_score", 9).desc(), "article_id")
