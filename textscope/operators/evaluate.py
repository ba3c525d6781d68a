"""Retrieval evaluation as DataFrame operations over all questions at once.

hits: (id, article_id, rank, score, content_full, title, content_hash)
paths: (id, path_tag, keywords array<string>), one row a gold path
"""

from __future__ import annotations

import difflib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import computed, shared

OVERLAP_GATE = 0.70
TOP_KEYS = 10
#: Articles of a question that count.
TOP_K = 20
FUZZY = 0.6
#: Groups of articles that ``first_chunks`` takes the least of.
GROUPS = 64


def keyword_hits(content: Column, keywords: Column) -> Column:
    """How many keywords the content holds, in any case."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))


def path_grade(content: Column, keywords: Column) -> Column:
    """'full' for all keywords, 'partial' for some, 'none' for none or no keyword."""
    n = keyword_hits(content, keywords)
    return F.when((F.size(keywords) > 0) & (n == F.size(keywords)), "full").when(n > 0, "partial").otherwise("none")


def fuzzy_ratio(title: Column, hint: Column) -> Column:
    """difflib's ratio, which no built-in equals: Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    return run(title, hint)


def first_chunks(chunks: DataFrame, words: DataFrame, n: int = TOP_K) -> DataFrame:
    """(k, article_id, chunk_index, rank): of each word the first ``n`` chunks, by
    article and place, that hold it in any case. words: (k), lower case; they are
    broadcast.

    Texts don't move, only the numbers of the words that a chunk holds. Of each word
    the least article of each of GROUPS groups is kept; ``n`` articles with the word
    come no later than the n-th least of these, so only hits up to it are sorted. A
    word in fewer groups has few hits, which are all sorted."""
    listed = words.agg(F.array_sort(F.collect_set("k")).alias("__words"))
    low = chunks.select("article_id", "chunk_index", F.lower("chunk_text").alias("__low")).crossJoin(F.broadcast(listed))
    numbers = F.array_compact(F.transform("__words", lambda w, i: F.when(F.contains("__low", w), i)))
    held = shared(computed(low, {"__held": numbers}).select("article_id", "chunk_index", "__held"), "article_id")
    each = held.select("article_id", "chunk_index", F.explode("__held").alias("__w"))
    least = each.groupBy("__w", F.pmod(F.hash("article_id"), F.lit(GROUPS)).alias("__g")).agg(F.min("article_id").alias("__a"))
    bound = least.groupBy("__w").agg(F.get(F.array_sort(F.collect_list("__a")), F.lit(n - 1)).alias("__last"))
    near = each.join(F.broadcast(bound), "__w").where(F.col("__last").isNull() | (F.col("article_id") <= F.col("__last")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("__w").orderBy("article_id", "chunk_index"))).where(F.col("rank") <= n)
    return ranked.crossJoin(F.broadcast(listed)).select(F.get("__words", F.col("__w")).alias("k"), "article_id", "chunk_index", "rank")


def rollup(hits: DataFrame, top_k: int | None = None) -> DataFrame:
    """One row an article and question: its best-scored hit (the earlier at a tie),
    the contents joined in rank order, and the number of hits. first_rank is that
    hit's own rank, rank the article's place by it; ``top_k`` articles stay."""
    best = F.max_by(F.struct("rank", "score", "title", "content_hash"), F.struct("score", -F.col("rank")))
    by = hits.groupBy("id", "article_id").agg(
        best.alias("b"),
        F.count(F.lit(1)).alias("n_hits"),
        F.array_sort(F.collect_list(F.struct("rank", "content_full"))).alias("__c"),
    )
    out = by.select(
        "id", "article_id", F.col("b.rank").alias("first_rank"), F.col("b.score").alias("score"), F.col("b.title").alias("title"),
        F.col("b.content_hash").alias("content_hash"), "n_hits", F.array_join(F.transform("__c", lambda x: x["content_full"]), "\n").alias("content_union"),
    )
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("first_rank", "article_id")))
    return out.where(F.col("rank") <= top_k) if top_k else out


def path_results(rolled: DataFrame, paths: DataFrame, top_k: int | None = TOP_K) -> DataFrame:
    """(id, path_tag, rank_full, any_partial) over the first ``top_k`` articles: the
    least hit rank of those that meet a path in full."""
    some = rolled.where(F.col("rank") <= top_k) if top_k else rolled
    graded = some.join(paths, "id").withColumn("grade", path_grade(F.col("content_union"), F.col("keywords")))
    found = graded.groupBy("id", "path_tag").agg(F.min(F.when(F.col("grade") == "full", F.col("first_rank"))).alias("rank_full"), F.bool_or(F.col("grade") == "partial").alias("any_partial"))
    return paths.select("id", "path_tag").join(found, ["id", "path_tag"], "left").withColumn("any_partial", F.coalesce("any_partial", F.lit(False)))


def path_metrics(results: DataFrame) -> DataFrame:
    """results with hit1, hit3, hit5 and rr of each path (long form)."""
    at = lambda k: (F.coalesce(F.col("rank_full") <= k, F.lit(False))).cast("int")
    return results.withColumns({"hit1": at(1), "hit3": at(3), "hit5": at(5), "rr": F.coalesce(1.0 / F.col("rank_full"), F.lit(0.0))})


def question_metrics(results: DataFrame) -> DataFrame:
    """(id, passed, n_paths, n_passing, partial_only, rr_at_5)."""
    by = results.groupBy("id").agg(F.count(F.lit(1)).alias("n_paths"), F.count("rank_full").alias("n_passing"), F.bool_or("any_partial").alias("p"), F.min("rank_full").alias("m"))
    return by.select("id", (F.col("n_passing") > 0).alias("passed"), "n_paths", "n_passing", ((F.col("n_passing") == 0) & F.col("p")).alias("partial_only"), F.when(F.col("m") <= 5, 1.0 / F.col("m")).otherwise(0.0).alias("rr_at_5"))


def summary(questions: DataFrame) -> DataFrame:
    """One row; the mean number of passing paths is over passed questions."""
    ok = F.count_if("passed")
    total = F.count(F.lit(1))
    return questions.agg(
        total.alias("total"),
        ok.alias("pass_count"),
        F.coalesce(F.round(100.0 * ok / F.nullif(total, F.lit(0)), 1), F.lit(0.0)).alias("pass_rate_pct"),
        F.count_if("partial_only").alias("partial_pass_count"),
        F.coalesce(F.round(F.avg(F.when(F.col("passed"), F.col("n_passing"))), 3), F.lit(0.0)).alias("mean_passing_path_count"),
        F.coalesce(F.round(F.avg("rr_at_5"), 4), F.lit(0.0)).alias("mrr_at_5"),
    )


def summary_by(questions: DataFrame, column: str, empty: str = "(uncategorised)") -> DataFrame:
    key = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty)).alias(column)
    return questions.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.count_if("passed").alias("pass_count"), F.round(100.0 * F.count_if("passed") / F.count(F.lit(1)), 2).alias("pass_rate_pct"))


def overlap(run: DataFrame, baseline: DataFrame, top: int = TOP_KEYS) -> DataFrame:
    """(id, overlap_rate): of the run's distinct keys (content_hash, title without
    blanks and case) up to rank ``top``, how many the baseline has too. Questions
    that only one side has are left out."""

    def keys(df: DataFrame, name: str) -> DataFrame:
        key = F.concat_ws("\u0001", F.coalesce("content_hash", F.lit("")), F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", "")))
        return df.where(F.col("rank") <= top).groupBy("id").agg(F.collect_set(key).alias(name))

    both = keys(run, "a").join(keys(baseline, "b"), "id")
    return both.select("id", F.when(F.size("a") > 0, F.size(F.array_intersect("a", "b")) / F.size("a")).otherwise(0.0).alias("overlap_rate"))


def objective_gate(overlaps: DataFrame, threshold: float = OVERLAP_GATE) -> DataFrame:
    return overlaps.agg(F.coalesce(F.avg("overlap_rate"), F.lit(0.0)).alias("mean_overlap")).withColumn("passed", F.round("mean_overlap", 9) >= threshold)


def histogram(overlaps: DataFrame) -> DataFrame:
    """(bin, count) over ten bins of 0..1, the last closed."""
    return overlaps.groupBy(F.least(F.floor(F.col("overlap_rate") * 10 + 1e-9), F.lit(9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def sample_questions(ids: list, n: int = 8, seed: int | None = 0) -> list:
    ids = sorted(ids)
    return ids if len(ids) <= n else random.Random(seed).sample(ids, n)


def subjective_gate(flags: list[bool], most: int = 1) -> bool:
    return sum(map(bool, flags)) <= most
