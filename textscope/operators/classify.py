"""Rule classification of articles on several axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.axes import AxesConfig

UNCLASSIFIED = "unclassified"


def matched_rules(articles: DataFrame, config: AxesConfig) -> DataFrame:
    """(article_id, axis_id, ord, is_primary, retag): the first rule of each axis
    that an article matches. Rules are a configuration file, so their table is
    small; it joins on source_type, the rest of a rule is tested on the pairs."""
    spark = articles.sparkSession
    rules = F.broadcast(config.rules_frame(spark))
    a = articles.select("article_id", "source_type", "subtype", "title", "tags")
    hit = (
        (F.col("r_subtype").isNull() | (F.col("r_subtype") == F.coalesce("subtype", F.lit(""))))
        & (F.col("r_title").isNull() | F.coalesce(F.regexp_like(F.coalesce("title", F.lit("")), F.col("r_title")), F.lit(False)))
        & (F.col("r_tag").isNull() | F.coalesce(F.array_contains("tags", F.col("r_tag")), F.lit(False)))
    )
    pairs = a.join(rules, a.source_type == rules.r_source_type).where(hit)
    first = Window.partitionBy("article_id", "axis_id").orderBy("rule_no")
    return pairs.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("article_id", "axis_id", "ord", "is_primary", "retag")


def classify(articles: DataFrame, config: AxesConfig) -> DataFrame:
    """(article_id, axis_id, is_primary): matched axes, the first one with a primary
    rule being primary; their ancestors; ``unclassified`` where nothing matches."""
    found = matched_rules(articles, config)
    ranked = found.withColumn("__first", F.min(F.when(F.col("is_primary"), F.col("ord"))).over(Window.partitionBy("article_id")))
    own = ranked.select("article_id", "axis_id", (F.col("is_primary") & (F.col("ord") == F.col("__first"))).alias("is_primary"))
    above = found.join(F.broadcast(config.ancestors_frame(articles.sparkSession)), "axis_id").select("article_id", F.col("ancestor").alias("axis_id"), F.lit(False).alias("is_primary"))
    got = own.unionByName(above).groupBy("article_id", "axis_id").agg(F.bool_or("is_primary").alias("is_primary"))
    rest = articles.select("article_id").join(got, "article_id", "left_anti").select("article_id", F.lit(UNCLASSIFIED).alias("axis_id"), F.lit(True).alias("is_primary"))
    return got.unionByName(rest)


def retag(articles: DataFrame, config: AxesConfig) -> DataFrame:
    """articles with the source_type of the first matched rule that renames it."""
    moved = matched_rules(articles, config).where("retag is not null").groupBy("article_id").agg(F.min_by("retag", "ord").alias("__to"))
    return articles.join(moved, "article_id", "left").withColumn("source_type", F.coalesce("__to", "source_type")).drop("__to")


@dataclass
class Report:
    passed: bool
    metrics: dict[str, float]
    failures: list[str]


def metrics(articles: DataFrame, axes: DataFrame) -> DataFrame:
    """One row: totals, unclassified, rows, several primaries, articles without any."""
    by = axes.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_primary").alias("p"), F.max((F.col("axis_id") == UNCLASSIFIED).cast("int")).alias("u")
    )
    all_ = articles.select("article_id").distinct().join(by, "article_id", "left")
    return all_.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("n").alias("classified_rows"),
        F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("unclassified"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("axis_rows"),
        F.count_if(F.col("p") > 1).alias("multi_primary"),
        F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("no_primary"),
    )


#: Bounds of a configuration's ``validation`` block, each with a lowest and a highest value; fixed names.
BOUNDS = ("total_rows", "avg_axes_per_article", "unclassified", "per_axis")


def axis_sizes(axes: DataFrame, config: AxesConfig) -> dict[str, int]:
    """Articles of each configured axis, 0 where there are none."""
    found = {r.axis_id: r["count"] for r in axes.where(F.col("axis_id").isin([a.id for a in config.axes])).groupBy("axis_id").count().collect()}
    return {a.id: found.get(a.id, 0) for a in config.axes}


def validate(articles: DataFrame, axes: DataFrame, config: AxesConfig | None = None, *, max_unclassified_pct: float = 100.0, min_avg_axes: float = 0.0, max_avg_axes: float = float("inf")) -> Report:
    """Metrics and what is wrong with them: articles without a primary axis, or with
    several unless ``primary_uniq_required`` is false, values outside the arguments'
    bounds and, with a configuration, outside those of its ``validation`` block
    (``{name}_min``, ``{name}_max`` of BOUNDS), and axes without an article."""
    row = metrics(articles, axes).first().asDict()
    n = max(1, row["total"])
    m = {**row, "unclassified_pct": 100.0 * row["unclassified"] / n, "avg_axes": row["axis_rows"] / n}
    failures = []
    if m["unclassified_pct"] > max_unclassified_pct:
        failures.append(f"unclassified {m['unclassified_pct']:.2f} % > {max_unclassified_pct} %")
    if not min_avg_axes <= m["avg_axes"] <= max_avg_axes:
        failures.append(f"average axes {m['avg_axes']:.2f} outside {min_avg_axes}..{max_avg_axes}")
    rules = config.validation if config else {}
    once = ("multi_primary",) if rules.get("primary_uniq_required", True) else ()
    failures += [f"{m[k]} articles: {k}" for k in (*once, "no_primary") if m[k]]
    if config:
        m["per_axis"] = axis_sizes(axes, config)
        measured = [("total_rows", "rows", m["axis_rows"]), ("avg_axes_per_article", "average axes", m["avg_axes"]), ("unclassified", "unclassified", m["unclassified"])]
        measured += [("per_axis", f"axis {name}", size) for name, size in m["per_axis"].items()]
        for name, what, value in measured:
            low, high = rules.get(f"{name}_min"), rules.get(f"{name}_max")
            if low is not None and value < low or high is not None and value > high:
                failures.append(f"{what}: {value:.4g} outside {'' if low is None else low}..{'' if high is None else high}")
        failures += [f"axis {name} has no article" for name, size in m["per_axis"].items() if not size]
    return Report(not failures, m, failures)


def classify_one(spark: SparkSession, articles: DataFrame, config: AxesConfig, article_id) -> DataFrame:
    return classify(articles.where(F.col("article_id") == article_id), config)
