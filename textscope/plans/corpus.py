"""The engine's tables over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import fixed_window
from ..operators import lexical
from ..sources.axes import AxesConfig, parse_axes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles; toxic ones are excluded."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("__id")).distinct()
    return d.join(labels, d.doc_id == labels["__id"], "left").select(
        F.col("doc_id").alias("article_id"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("source_type"),
        F.col("lang").alias("subtype"),
        F.when(F.col("__id").isNotNull(), "excluded").otherwise("").alias("category"),
        F.array("lang", "source", F.concat(F.lit("len"), F.least(F.expr("n_chars div 1000"), F.lit(9)).cast("string"))).alias("tags"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("pub_year"),
        F.format_string("%d-%02d-01", (2000 + F.col("doc_id") % 25), (1 + F.col("doc_id") % 12)).alias("pub_date"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.article_index(articles(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    flat = a.select("article_id", "title", "tags", "source_type", F.posexplode(fixed_window(F.col("content"))).alias("chunk_index", "chunk_text"))
    return flat.withColumn("chunk_id", F.format_string("%d-%04d", "article_id", "chunk_index"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.chunk_index(chunks(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def axes_config() -> AxesConfig:
    """Axes by language over every source type."""
    every = [f"src{k}" for k in range(20)]
    rules = lambda langs, primary: [{"source_type": s, "subtype": lang, "primary": primary} for s in every for lang in langs]
    return parse_axes(
        {
            "axes": [
                {"id": "european", "name": "European", "order": 3, "rules": []},
                {"id": "romance", "name": "Romance", "order": 1, "parent": "european", "rules": rules(["fr", "es"], True)},
                {"id": "germanic", "name": "Germanic", "order": 2, "parent": "european", "rules": rules(["de"], True)},
                {"id": "first_sources", "name": "First sources", "order": 4, "rules": [{"source_type": f"src{k}", "primary": False} for k in range(5)]},
            ]
        }
    )
