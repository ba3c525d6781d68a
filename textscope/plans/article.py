"""One article's page, and the chunks of an article that a query meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexical

PREVIEW_CHARS = 36
#: Columns of a page's head, as far as the articles have them.
HEAD = ("article_id", "title", "source_type", "author", "pub_date", "category", "tags", "source_url", "description")


def article_chunks(chunks: DataFrame, article_id, query: str = "") -> DataFrame:
    """(chunk_index, chunk_text, preview, matched) of one article in order. chunks:
    lexical.chunk_index; the id is a filter that reaches a written snapshot's scan.
    A blank query matches nothing."""
    own = chunks.where(F.col("article_id") == article_id)
    text = F.coalesce("chunk_text", F.lit(""))
    return own.select(
        F.col("chunk_index").cast("long").alias("chunk_index"),
        text.alias("chunk_text"),
        X.plain_preview(text, PREVIEW_CHARS).alias("preview"),
        F.coalesce(lexical.matches(own, X.phrases(query)), F.lit(False)).alias("matched"),
    ).orderBy("chunk_index")


def matched_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """(article_id, matched array<long>) of every article with a chunk that holds all
    of the query's phrases. Chunks are filtered before they are grouped, and a
    group is one article's chunk numbers."""
    found = chunks.where(lexical.matches(chunks, X.phrases(query)))
    return found.groupBy("article_id").agg(F.sort_array(F.collect_list(F.col("chunk_index").cast("long"))).alias("matched"))


def article_view(articles: DataFrame, chunks: DataFrame, article_id, query: str = "") -> dict | None:
    """The page's data: head, content, chunks in order, numbers of those that match;
    None for an unknown id."""
    row = articles.where(F.col("article_id") == article_id).limit(1).collect()
    if not row:
        return None
    row = row[0].asDict(recursive=True)
    parts = [r.asDict() for r in article_chunks(chunks, article_id, query).collect()]
    head = {k: row.get(k) for k in HEAD}
    return head | {
        "tags": head["tags"] or [],
        "content": row.get("content") or "",
        "chunks": [{k: p[k] for k in ("chunk_index", "chunk_text", "preview")} for p in parts],
        "matched": [p["chunk_index"] for p in parts if p["matched"]],
        "query": query,
    }


def view_markdown(view: dict) -> str:
    """The page as Markdown, for clients that ask for that."""
    facts = "".join(f"- **{name}**: {view[key]}\n" for name, key in (("Date", "pub_date"), ("Author", "author"), ("Source", "source_type")))
    return f"# {view['title']}\n\n{facts}\n{view['content']}"
