"""Exact phrase search with BM25 over folded text.

A phrase matches where its folded form is a substring of a folded column, so
there is no token index: one scan counts every phrase, one aggregate gives the
corpus statistics, and the score is a closed expression. Statistics cover all
rows, before any filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import not_excluded

K1, B = 1.2, 0.75
#: Queries that one scan serves; more are run block by block.
QUERY_BLOCK = 32


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are evaluated once a row: a generator stands between
    them and what refers to them, so the optimiser can't repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def shared(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by ``key`` and computed once for all that a query makes of it:
    rows move packed, so no filter and no choice of columns gets below the exchange
    and Spark finds the same one each time. Choose columns before; all of them move."""
    packed = df.select(F.col(key).alias("__key"), F.array(F.struct(*df.columns)).alias("__rows"))
    return packed.repartition("__key").select(F.inline("__rows"))


def folded(articles: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """articles with a folded column ``{name}_f`` for each of columns (name ->
    source) and doc_len, their total length. Write it once, search it often."""
    made = {f"{n}_f": X.fold(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for n, c in columns.items()}
    out = computed(articles, made)
    return out.withColumn("doc_len", reduce(lambda a, b: a + b, (F.length(c) for c in made)))


def article_index(articles: DataFrame) -> DataFrame:
    return folded(articles, {"title": "title", "content": "content", "tags": X.join_tags(F.col("tags"))})


def chunk_index(chunks: DataFrame) -> DataFrame:
    return folded(chunks, {"title": "title", "content": "chunk_text", "tags": X.join_tags(F.col("tags"))})


def _columns(index: DataFrame, column: str | None) -> list[str]:
    return [f"{column}_f"] if column else [c for c in ("title_f", "content_f", "tags_f") if c in index.columns]


def term_counts(index: DataFrame, terms: list[str], column: str | None = None) -> Column:
    """array<int>: occurrences of each phrase over the searched columns."""
    return F.array(*[reduce(lambda a, b: a + b, (X.occurrences(F.col(c), t) for c in _columns(index, column))) for t in terms])


def matches(index: DataFrame, terms: list[str], column: str | None = None, any_term: bool = False) -> Column:
    """Whether a row holds all phrases (or any), in whichever column."""
    held = [reduce(lambda a, b: a | b, (F.contains(F.col(c), F.lit(t)) for c in _columns(index, column))) for t in terms]
    return reduce(lambda a, b: (a | b) if any_term else (a & b), held) if held else F.lit(False)


def statistics(counted: DataFrame, n_terms: int, tf: str = "__tf") -> DataFrame:
    """One row: rows, their mean length, and how many hold each term."""
    return counted.agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg("doc_len").alias("__avg"),
        F.array(*[F.count_if(F.col(tf)[k] > 0) for k in range(n_terms)]).alias("__df"),
    )


def rated(counted: DataFrame, stats: DataFrame, n_terms: int, any_term: bool = False) -> DataFrame:
    """The rows of counted (__tf, doc_len) that match, with bm25_raw."""
    hit = [F.col("__tf")[k] > 0 for k in range(n_terms)]
    # a match on the scan side first, so that only hits meet the one-row statistics
    found = counted.where(reduce(lambda a, b: (a | b) if any_term else (a & b), hit)).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for k in range(n_terms):
        df, tf = F.col("__df")[k], F.col("__tf")[k].cast("double")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        total = total + F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("__avg")))
    return found.withColumn("bm25_raw", -total).drop("__tf", "__n", "__avg", "__df")


def scored(index: DataFrame, query: str | list[str], column: str | None = None, any_term: bool = False) -> DataFrame:
    """The matching rows of index with bm25_raw; lower is better. The texts are folded
    twice, for the statistics and for the scores, unless index is written."""
    terms = X.phrases(query) if isinstance(query, str) else list(query)
    if not terms:
        return index.where(F.lit(False)).withColumn("bm25_raw", F.lit(0.0))
    counted = computed(index, {"__tf": term_counts(index, terms, column)})
    return rated(counted, statistics(counted, len(terms)), len(terms), any_term)


def search(index: DataFrame, query: str, *, limit: int = 50, axes: DataFrame | None = None, axis: str | None = None, column: str | None = None, any_term: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Best ``limit`` rows: bm25_raw, and bm25_score in 0..1 relative to the best
    returned. Excluded rows are left out; ties go by article_id. counts: article_counts
    of the query's phrases; their columns come back, and no text is folded again."""
    n = len(X.phrases(query))
    found = rated(counts, statistics(counts, n), n, any_term) if counts is not None and n else scored(index, query, column, any_term)
    found = found.where(not_excluded())
    if axis is not None:
        found = found.join(axes.where(F.col("axis_id") == axis).select("article_id").distinct(), "article_id", "left_semi")
    top = found.orderBy(F.round("bm25_raw", 6), "article_id").limit(limit)
    return normalized(top)


def normalized(top: DataFrame) -> DataFrame:
    """bm25_score = |raw| / largest |raw| over the rows (all 0 if that is 0)."""
    most = top.agg(F.max(F.abs("bm25_raw")).alias("__most"))
    return top.crossJoin(F.broadcast(most)).withColumn("bm25_score", F.when(F.col("__most") > 0, F.abs("bm25_raw") / F.col("__most")).otherwise(0.0)).drop("__most")


def article_counts(index: DataFrame, terms: list[str]) -> DataFrame:
    """(article_id, category, doc_len, __tf) of all rows, computed once."""
    return shared(computed(index, {"__tf": term_counts(index, terms)}).select("article_id", "category", "doc_len", "__tf"), "article_id")


def chunk_counts(chunks: DataFrame, terms: list[str], content_terms: list[str] = ()) -> DataFrame:
    """(article_id, chunk_index, doc_len, __tf, __ctf), computed once: how often each
    chunk holds terms in any column, and content_terms in its content."""
    counted = computed(chunks, {"__tf": term_counts(chunks, terms), "__ctf": term_counts(chunks, list(content_terms), "content").cast("array<int>")})
    return shared(counted.select("article_id", "chunk_index", "doc_len", "__tf", "__ctf"), "article_id")


def chunk_signal(chunks: DataFrame, query: str, *, limit: int = 50, over_fetch: int = 5, any_term: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """(article_id, chunk_raw): the best chunk of each article among the best
    limit * over_fetch chunks, then the best ``limit`` articles. counts: chunk_counts
    of the query's phrases, if they serve others too."""
    terms = X.phrases(query)
    if counts is None and terms:
        counts = chunk_counts(chunks, terms)
    found = rated(counts.drop("__ctf"), statistics(counts, len(terms)), len(terms), any_term) if terms else scored(chunks, query)
    top = found.orderBy(F.round("bm25_raw", 6), "article_id", "chunk_index").limit(limit * over_fetch)
    return top.groupBy("article_id").agg(F.min("bm25_raw").alias("chunk_raw")).orderBy(F.round("chunk_raw", 6), "article_id").limit(limit)


def chunk_hits(chunks: DataFrame, query: str, ids: DataFrame, top: int = 3, any_term: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """The best ``top`` matching chunks of each given article, with chunk_rank and
    chunk_hits, the number of all that match. With counts, chunk_counts whose
    content_terms are the query's phrases, ids must be few: they are broadcast, and
    the other articles' chunks are not folded again."""
    terms = X.phrases(query)
    if counts is not None and terms:
        some = chunks.join(F.broadcast(ids.select("article_id").distinct()), "article_id", "left_semi")
        counted = computed(some, {"__tf": term_counts(some, terms, "content")})
        found = rated(counted, statistics(counts, len(terms), "__ctf"), len(terms), any_term)
    else:
        found = scored(chunks, query, column="content", any_term=any_term).join(ids.select("article_id").distinct(), "article_id", "left_semi")
    by = Window.partitionBy("article_id")
    ranked = found.withColumn("chunk_rank", F.row_number().over(by.orderBy(F.round("bm25_raw", 6), "chunk_index"))).withColumn("chunk_hits", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("chunk_rank") <= top)


def match_count(index: DataFrame, query: str) -> DataFrame:
    return index.agg(F.count_if(matches(index, X.phrases(query))).alias("n"))


def search_many(index: DataFrame, queries: list[tuple[int, str]], *, limit: int = 10, any_term: bool = False) -> DataFrame:
    """(query_id, article_id, bm25_raw, rank) for many queries: one scan and one
    statistics row for each block of QUERY_BLOCK."""
    blocks = []
    for a in range(0, len(queries), QUERY_BLOCK):
        some = [(q, t) for q, text in queries[a : a + QUERY_BLOCK] if (t := X.phrases(text))]
        if not some:
            continue
        terms = list(dict.fromkeys(x for _, t in some for x in t))
        place = {t: k for k, t in enumerate(terms)}
        counted = computed(index, {"__tf": term_counts(index, terms)})
        stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("doc_len").alias("__avg"), F.array(*[F.count_if(F.col("__tf")[k] > 0) for k in range(len(terms))]).alias("__df"))
        joined = counted.where(not_excluded()).select("article_id", "doc_len", "__tf").where(F.exists("__tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))

        def weight(k: int) -> Column:
            df, tf = F.col("__df")[k], F.col("__tf")[k].cast("double")
            idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
            return F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("__avg")))

        joined = computed(joined, {"__w": F.array(*[weight(k) for k in range(len(terms))])})
        rows = []
        for q, t in some:
            hit = reduce(lambda x, y: (x | y) if any_term else (x & y), (F.col("__tf")[place[x]] > 0 for x in t))
            rows.append(F.when(hit, F.struct(F.lit(q).cast("long").alias("query_id"), (-reduce(lambda x, y: x + y, (F.col("__w")[place[x]] for x in t))).alias("bm25_raw"))))
        found = joined.select("article_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")).select("r.query_id", "article_id", "r.bm25_raw")
        by = Window.partitionBy("query_id").orderBy(F.round("bm25_raw", 6), "article_id")
        blocks.append(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit))
    if not blocks:
        return index.where(F.lit(False)).select(F.lit(0).cast("long").alias("query_id"), "article_id", F.lit(0.0).alias("bm25_raw"), F.lit(0).alias("rank"))
    return reduce(DataFrame.unionByName, blocks)
