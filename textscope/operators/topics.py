"""Topic summaries and concept perspectives over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import lexical
from .facets import distribution
from .filters import Filter, not_excluded

SOURCE_BUDGET, LEAST_CHUNK = 9_000, 200


def topic_hits(index: DataFrame, tag: str, filter: Filter | None = None) -> DataFrame:
    """All matching rows that aren't excluded and pass the filter, with bm25_raw."""
    found = lexical.scored(index, tag).where(not_excluded())
    return filter.apply(found) if filter else found


def topic_sources(index: DataFrame, tag: str, filter: Filter | None = None, k: int = 5) -> DataFrame:
    top = topic_hits(index, tag, filter).orderBy(F.round("bm25_raw", 6), "article_id").limit(k)
    return lexical.normalized(top)


def topic_statistics(index: DataFrame, tag: str, filter: Filter | None = None) -> DataFrame:
    """(dimension, value, count): source_type and pub_year over all matches, and
    their number; one pass."""
    some = topic_hits(index, tag, filter).select(
        F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("unknown")).alias("source_type"),
        F.coalesce(F.nullif(F.col("pub_year").cast("string"), F.lit("")), F.lit("unknown")).alias("pub_year"),
    )
    pair = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    pairs = some.select(F.explode(F.array(pair("source_type", F.col("source_type")), pair("pub_year", F.col("pub_year")), pair("total_hits", F.lit("")))).alias("p"))
    return pairs.groupBy(F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def topic_chunks(chunks: DataFrame, sources: DataFrame, tag: str, per_source: int = 2) -> DataFrame:
    """(article_id, chunk_rank, text): the best chunks of each source by any term, or
    the whole content where none matches."""
    best = lexical.chunk_hits(chunks, tag, sources, per_source, any_term=True).select("article_id", "chunk_rank", F.col("chunk_text").alias("text"))
    rest = sources.join(best.select("article_id").distinct(), "article_id", "left_anti").select("article_id", F.lit(1).alias("chunk_rank"), F.col("content").alias("text"))
    return best.unionByName(rest)


def concept_excerpts(index: DataFrame, concept: str, filter: Filter | None = None, top_sources: int = 4, per_source: int = 3) -> DataFrame:
    """(source_type, article_id, place, score, excerpt): the best articles of the
    source types with the best articles."""
    found = topic_hits(index, concept, filter)
    place = Window.partitionBy("source_type").orderBy(F.round("bm25_raw", 6), "article_id")
    ranked = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_source)
    first = ranked.where("place = 1").orderBy(F.round("bm25_raw", 6), "source_type").limit(top_sources).select("source_type")
    kept = ranked.join(F.broadcast(first), "source_type", "left_semi")
    return kept.select("source_type", "article_id", "place", F.abs("bm25_raw").alias("score"), X.snippet(F.col("content"), [concept]).alias("excerpt"))


def source_blocks(items: list[tuple[str, list[str]]], budget: int = SOURCE_BUDGET, least: int = LEAST_CHUNK) -> str:
    """The prompt's list of sources within ``budget`` characters, headings included.

    Headings always stand. Texts are served in turns, the first of every source
    before any second one: each takes what it needs, up to an even part of what
    is left for the texts still waiting, so that a short text's room goes to
    those after it. A text that would be cut below ``least`` is left out."""
    lines = [[f"Source {k}: {title}"] for k, (title, _) in enumerate(items, 1)]
    left = budget - sum(len(x[0]) + 2 for x in lines)
    queue = sorted(((turn, k, t.strip()) for k, (_, texts) in enumerate(items) for turn, t in enumerate(t for t in texts if t and t.strip())), key=lambda x: x[:2])
    waiting = max(1, min(len(queue), left // (least + 4)))
    for _, k, text in queue:
        room = left // waiting - 4  # a line's end, its bullet and the sign of a cut
        if room < min(least, len(text)):
            continue
        line = f"- {text if len(text) <= room else text[:room] + '…'}"
        lines[k].append(line)
        left -= len(line) + 1
        waiting = max(1, waiting - 1)
    return "\n\n".join("\n".join(x) for x in lines)


def consensus_and_disagreements(text: str) -> tuple[list[str], list[str]]:
    """Bullets under the two second-level headings of a narrative."""
    out: list[list[str]] = []
    for line in text.splitlines():
        if line.startswith("## "):
            out.append([])
        elif out and line.strip()[:2] in ("- ", "* "):
            out[-1].append(line.strip()[2:].strip())
    return (out + [[], []])[0], (out + [[], []])[1]


__all__ = ["concept_excerpts", "consensus_and_disagreements", "distribution", "source_blocks", "topic_chunks", "topic_hits", "topic_sources", "topic_statistics"]
