"""Chunk strategies: name -> array<string> column of a text."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line patterns that start a chunk; fixed values.
MARKERS = {
    "bible-chapter": r"(?m)^第[0-9一二三四五六七八九十百]+[章篇]",
    "bible-verses": r"(?m)^[0-9]+:[0-9]+",
    "numbered-entries": r"(?m)^[0-9]+[.、]",
    "markdown-heading": r"(?m)^#{1,6} ",
}


def fixed_window(c: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the one before; the
    last reaches the end. Empty text: no chunk."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - overlap - 1), F.lit(size - overlap))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: What Python's strip() takes off.
BLANKS = "".join(x for x in map(chr, range(0x3001)) if x.isspace())


def by_marker(c: Column, pattern: str, size: int = 1000, overlap: int = 100, blanks: str = BLANKS) -> Column:
    """A chunk from each match to the next, without ``blanks`` at its ends; text
    before the first is dropped, and a text without a match is cut into fixed
    windows. A line starts after \\n alone, as in Python's patterns."""
    body = pattern.removeprefix("(?m)")
    parts = F.filter(F.split(c, f"(?md)(?={body})"), lambda x: x.rlike(f"^{body.removeprefix('^')}"))
    kept = F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(blanks))), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(fixed_window(c, size, overlap))


def _pieces(text: str, most: int) -> Iterator[str]:
    """Paragraphs between blank lines; one above ``most`` as overlapping windows."""
    step = max(1, most - max(most // 10, 50))
    for part in map(str.strip, re.split(r"\n\s*\n", text)):
        windows = 1 + max(0, math.ceil((len(part) - most) / step))
        yield from (part[k * step : k * step + most] for k in range(windows) if part)


def paragraphs(text: str, least: int = 200, most: int = 1500) -> list[str]:
    """Pieces joined to chunks. A chunk is done once it reaches ``least``; one that
    the next piece would take beyond ``most`` is done as it is, and that piece
    waits for another even if it is long enough. A short rest joins the last."""
    done: list[str] = []
    held = ""
    for piece in _pieces(text, most):
        grown = f"{held}\n\n{piece}" if held else piece
        if held and len(grown) > most:
            done.append(held)
            held = piece
        elif len(grown) < least:
            held = grown
        else:
            done.append(grown)
            held = ""
    if held and done and len(held) < least:
        done[-1] += f"\n\n{held}"
    elif held:
        done.append(held)
    return done


def paragraph(c: Column, least: int = 200, most: int = 1500) -> Column:
    """A running merge can't be said in column expressions: Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: paragraphs(t or "", least, most))

    return run(c)


STRATEGIES: dict[str, Callable[..., Column]] = {
    "paragraph": paragraph,
    "fixed-window": fixed_window,
    **{name: (lambda c, p=p, **kw: by_marker(c, p, **kw)) for name, p in MARKERS.items()},
}


def chunk(c: Column, strategy: str, **options) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](c, **options)


def chunk_by_type(articles: DataFrame, by_type: dict[str, tuple[str, dict]], text: str = "content") -> DataFrame:
    """articles with ``chunks``: the row's own chunk_strategy (without options),
    else that of its source_type, else none."""
    out = F.array().cast("array<string>")
    for kind, (name, options) in by_type.items():
        out = F.when(F.col("source_type") == kind, chunk(F.col(text), name, **options)).otherwise(out)
    if "chunk_strategy" in articles.columns:
        for name in STRATEGIES:
            out = F.when(F.col("chunk_strategy") == name, chunk(F.col(text), name)).otherwise(out)
    return articles.withColumn("chunks", out)


def explode_chunks(articles: DataFrame) -> DataFrame:
    """One row a chunk, with its id ``{article_id}-{index:04d}``."""
    flat = articles.select("*", F.posexplode("chunks").alias("chunk_index", "chunk_text")).drop("chunks")
    return flat.withColumn("chunk_id", F.format_string("%s-%04d", F.col("article_id").cast("string"), F.col("chunk_index")))
