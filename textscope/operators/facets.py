"""Facet counts, tag browsing and related tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import not_excluded


def tag_counts(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """(tag, count): a tag that an article repeats counts each time."""
    out = articles.where(not_excluded()).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag")
    return out.limit(limit) if limit else out


def query_tag_counts(articles: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """(tag, count, query_count), most of the query's articles first. One pass:
    the query's articles are marked, then both counts are one aggregate."""
    marked = articles.where(not_excluded()).join(ids.select("article_id").distinct().withColumn("__in", F.lit(1)), "article_id", "left")
    out = marked.select(F.explode("tags").alias("tag"), "__in").groupBy("tag").agg(F.count(F.lit(1)).alias("count"), F.count("__in").alias("query_count"))
    out = out.orderBy(F.desc("query_count"), F.desc("count"), "tag")
    return out.limit(limit) if limit else out


def value_counts(articles: DataFrame, column: str, excluded: bool = False) -> DataFrame:
    """(column, count) of non-empty values."""
    some = articles if excluded else articles.where(not_excluded())
    return some.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def distribution(articles: DataFrame, column: str) -> DataFrame:
    """(value, count) with 'unknown' for null and empty."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown"))
    return articles.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def axis_counts(axes: DataFrame, labels: DataFrame | None = None, articles: DataFrame | None = None) -> DataFrame:
    """(axis_id, count[, label]) without the unclassified; unlabelled axes drop out."""
    some = axes.where("axis_id <> 'unclassified'")
    if articles is not None:
        some = some.join(articles.select("article_id"), "article_id")
    out = some.groupBy("axis_id").agg(F.count(F.lit(1)).alias("count"))
    return out.join(F.broadcast(labels), "axis_id") if labels is not None else out


def browse(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first, for an empty query."""
    return articles.where(not_excluded()).orderBy(F.coalesce(F.col("pub_date"), F.lit("")).desc(), "article_id").limit(limit)


def post_filter(results: DataFrame, articles: DataFrame, *, source_type: str | None = None, tag: str | None = None, year: int | None = None) -> DataFrame:
    """results whose article passes the facets; all of those given hold."""
    some = articles
    if source_type:
        some = some.where(F.col("source_type") == source_type)
    if tag:
        some = some.where(F.array_contains("tags", F.lit(tag)))
    if year is not None:
        some = some.where(F.col("pub_year") == year)
    return results.join(some.select("article_id"), "article_id", "left_semi")


def tag_list(articles: DataFrame) -> DataFrame:
    """(tag, count) over all articles, each tag once an article."""
    return articles.select("article_id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.countDistinct("article_id").alias("count")).orderBy(F.desc("count"), "tag")


def tag_articles(articles: DataFrame, tag: str) -> DataFrame:
    return articles.where(F.array_contains("tags", F.lit(tag))).orderBy(F.coalesce(F.col("pub_date"), F.lit("")).desc(), "article_id")


def related_tags(articles: DataFrame, tag: str, k: int = 10) -> DataFrame:
    """(tag, jaccard) of the tags that share most articles. The given tag's articles
    are marked in the row, so no self-join is needed."""
    rows = articles.where(F.size("tags") > 0).select(F.array_distinct("tags").alias("t"))
    marked = rows.withColumn("__in", F.array_contains("t", F.lit(tag)).cast("int"))
    by = marked.select("__in", F.explode("t").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("__in").alias("both"))
    own = by.where(F.col("tag") == tag).select(F.col("n").alias("own"))
    out = by.where((F.col("tag") != tag) & (F.col("both") > 0)).crossJoin(F.broadcast(own))
    return out.select("tag", (F.col("both") / (F.col("n") + F.col("own") - F.col("both"))).alias("jaccard")).orderBy(F.desc(F.round("jaccard", 6)), "tag").limit(k)
