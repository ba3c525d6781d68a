"""Building and changing a corpus snapshot of parquet tables."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.chunking import chunk_by_type, explode_chunks
from ..functions.text import content_hash
from ..operators import lexical


def diff(new: DataFrame, old: DataFrame, key: str = "path", hash_column: str = "content_hash") -> DataFrame:
    """(key, state): added, changed, unchanged or removed. One join of two columns."""
    n, o = new.select(key, F.col(hash_column).alias("__n")), old.select(key, F.col(hash_column).alias("__o"))
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__n") == F.col("__o"), "unchanged").otherwise("changed")
    return n.join(o, key, "full_outer").select(key, state.alias("state"))


def upsert(new: DataFrame, old: DataFrame, key: str = "path", hash_column: str = "content_hash", hash_metadata: bool = False) -> DataFrame:
    """The articles after ingest: unchanged rows keep their fields and take only the
    new indexed_at; added and changed rows are the new ones; others stay."""
    if hash_metadata:
        whole = lambda df: df.withColumn("__h", content_hash(F.to_json(F.struct(*sorted(set(new.columns) & set(old.columns) - {"indexed_at"})))))
        new, old, hash_column = whole(new), whole(old), "__h"
    stamp = new.select(F.col(key), F.col(hash_column).alias("__new"), F.col("indexed_at").alias("__at"))
    kept = old.join(stamp, key, "left").where(F.col("__new").isNull() | (F.col("__new") == F.col(hash_column)))
    kept = kept.withColumn("indexed_at", F.coalesce("__at", "indexed_at")).drop("__new", "__at")
    fresh = new.join(kept.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).drop("__h")


def trim(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the listed articles, and how many went by source_type.

    ids: (kind, value) with kind article_id or hash (16 or 64 digits)."""
    a = tables["articles"]
    by_id = ids.where("kind = 'article_id'").select(F.col("value").alias("article_id"))
    by_hash = ids.where("kind = 'hash'").select(F.lower(F.left("value", F.lit(16))).alias("content_hash"))
    gone = a.join(by_id, a.article_id.cast("string") == by_id.article_id, "left_semi").unionByName(a.join(by_hash, "content_hash", "left_semi")).select("article_id", "source_type").distinct()
    kept = {name: t.join(gone.select("article_id"), "article_id", "left_anti") for name, t in tables.items()}
    manifest = gone.groupBy(F.coalesce("source_type", F.lit("(unknown)")).alias("source_type")).agg(F.count(F.lit(1)).alias("removed"))
    return kept, manifest


def derived(articles: DataFrame, by_type: dict[str, tuple[str, dict]] | None = None, embedder=None) -> dict[str, DataFrame]:
    """The text and chunk indexes of articles, and vectors where an embedder is given."""
    out = {"texts": lexical.article_index(articles)}
    chunked = chunk_by_type(articles, by_type or {})
    out["chunks"] = lexical.chunk_index(explode_chunks(chunked))
    if embedder is not None:
        from ..operators.vector import encode

        out["vectors"] = encode(articles.select("article_id", "content"), embedder, "content").select("article_id", "vec")
    return out


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_snapshot(tables: dict[str, DataFrame], root: str, meta: dict[str, str] | None = None) -> str:
    """Write a new version folder, then a pointer to it that gets its name by one
    rename; returns the version's path. Readers take the newest pointer, so they
    always find a whole one, and a failed write changes nothing."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v{datetime.now(UTC):%Y%m%d%H%M%S%f}"
    path = f"{root}/{version}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    held = {"schema_version": schema.SCHEMA_VERSION, "path": path, **(meta or {})}
    spark.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/_writing-{version}")
    fs, made = _folder(spark, f"{root}/_writing-{version}")
    fs.mkdirs(_folder(spark, f"{root}/pointers")[1])
    if not fs.rename(made, _folder(spark, f"{root}/pointers/{version}")[1]):
        raise OSError(f"no pointer could be set to {path}")
    return path


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest version's tables; FileNotFoundError where none is."""
    fs, pointers = _folder(spark, f"{root}/pointers")
    found = sorted(s.getPath().getName() for s in fs.listStatus(pointers)) if fs.exists(pointers) else []
    if not found:
        raise FileNotFoundError(f"no snapshot in {root}")
    held = json.loads(spark.read.text(f"{root}/pointers/{found[-1]}").first()[0])
    schema.check_version(held.get("schema_version"))
    fs, path = _folder(spark, held["path"])
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {n: spark.read.parquet(f"{held['path']}/{n}") for n in sorted(names)}
