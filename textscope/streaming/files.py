"""Incremental ingest of Markdown files as a stream (an extension).

New files are taken once each: the checkpoint remembers them. Every batch is
parsed like a batch ingest and merged into the snapshot by path; tables that
come from the articles are made anew from the merged ones. Files that can't be
parsed are kept in the snapshot's ``errors``.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import ingest
from ..sources import markdown


def start(spark: SparkSession, folder: str, root: str, checkpoint: str, directory_map: dict[str, str] | None = None, by_type: dict[str, tuple[str, dict]] | None = None, embedder=None) -> StreamingQuery:
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1]
    named = files.select(F.regexp_replace(F.url_decode(F.input_file_name()), f"^.*?\\Q{base}\\E/", "").alias("path"), F.col("value").alias("text"))

    def merge(batch: DataFrame, _: int) -> None:
        parsed = markdown.parse(batch, directory_map)
        new = parsed.where("error is null").drop("error").withColumn("indexed_at", F.lit(datetime.now(UTC).isoformat()))
        errors = parsed.where("error is not null").select("path", "error")
        try:
            held = ingest.read_snapshot(spark, root)
        except FileNotFoundError:  # the first batch
            held = {}
        if "articles" in held:
            new = ingest.upsert(new, held["articles"])
        if "errors" in held:
            errors = held["errors"].join(parsed.select("path"), "path", "left_anti").unionByName(errors)
        made = ingest.derived(new, by_type, embedder) if {"article_id", "content"} <= set(new.columns) else {}
        ingest.write_snapshot({"articles": new, "errors": errors, **made}, root)

    return named.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
