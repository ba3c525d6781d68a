"""Markdown articles with YAML front matter."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from datetime import date, datetime
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as X


class IngestError(ValueError):
    pass


def split_front_matter(text: str) -> tuple[dict[str, Any], str]:
    """(metadata, body); a text without a front matter has none."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    if not text.startswith("---\n"):
        return {}, text
    head, found, body = text[4:].partition("\n---")
    if not found:
        raise IngestError("front matter isn't closed")
    try:
        data = yaml.safe_load(head) or {}
    except yaml.YAMLError as e:
        raise IngestError(f"front matter: {e}") from e
    if not isinstance(data, dict):
        raise IngestError("front matter must be a mapping")
    return data, body.split("\n", 1)[1] if "\n" in body else ""


def _strings(value: Any) -> list[str]:
    if value is None or value == "":
        return []
    return [str(x) for x in value if x is not None] if isinstance(value, (list, tuple)) else [str(value)]


def _url(value: Any) -> str:
    if isinstance(value, dict):
        value = value.get("url")
    if isinstance(value, (list, tuple)):
        return next((u for x in value if (u := _url(x))), "")
    return value.strip() if isinstance(value, str) else ""


def fields_of(text: str) -> dict[str, Any]:
    """Typed fields of one file; ``error`` instead where it can't be parsed."""
    try:
        meta, body = split_front_matter(text)
    except IngestError as e:
        return {"error": str(e)}
    day = meta.get("pubDate") or meta.get("pub_date")
    day = day.isoformat()[:10] if isinstance(day, (date, datetime)) else (str(day) if day is not None else None)
    year = meta.get("pub_year")
    return {
        "error": None, "body": body, "fm_title": str(meta["title"]) if meta.get("title") else None, "fm_source_type": str(meta["source_type"]) if meta.get("source_type") else None,
        "subtype": str(meta.get("subtype") or ""), "category": str(meta.get("category") or ""), "author": str(meta.get("author") or ""), "description": str(meta.get("description") or ""),
        "pub_date": day, "fm_year": str(year) if year is not None else None, "tags": _strings(meta.get("tags")), "chunk_strategy": meta.get("chunk_strategy"),
        "source_url": next((u for k in ("source_url", "source", "link") if (u := _url(meta.get(k)))), ""), "source_urls": [u for x in _strings(meta.get("source_urls")) if (u := x.strip())],
    }


_FIELDS = (
    "error string, body string, fm_title string, fm_source_type string, subtype string, category string, author string, description string, pub_date string, fm_year string, "
    "tags array<string>, chunk_strategy string, source_url string, source_urls array<string>"
)


def read_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path relative to root, text) of the *.md files."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).option("wholetext", "true").format("text").load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    path = F.regexp_replace(F.url_decode(F.input_file_name()), f"^.*?\\Q{base}\\E/", "")
    return files.select(path.alias("path"), F.col("value").alias("text"))


def parse(files: DataFrame, directory_map: dict[str, str] | None = None, front_matter_first: bool = True) -> DataFrame:
    """files with their fields, title, source_type, hash and id. YAML needs Python
    (Arrow batches of JSON); all else is column expressions. Rows with ``error``
    stay, for quarantine; see ``accepted``. Files without a body drop out."""

    @F.pandas_udf("string")
    def fields(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(fields_of(t or ""), default=str))

    got = files.withColumn("f", F.from_json(fields("text"), _FIELDS)).select("path", "f.*")
    got = got.withColumn("content", X.normalize("body")).where("error is not null or content <> ''")
    parent = F.element_at(F.split("path", "/"), -2)
    mapped = F.lit(None).cast("string")
    for name, kind in (directory_map or {}).items():
        mapped = F.when(F.when(F.size(F.split("path", "/")) > 1, parent) == name, kind).otherwise(mapped)
    order = [F.col("fm_source_type"), mapped] if front_matter_first else [mapped, F.col("fm_source_type")]
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    out = got.withColumn("source_type", F.coalesce(*order)).withColumn("content_hash", X.content_hash(F.col("content")))
    out = out.withColumn("error", F.coalesce("error", F.when(F.col("source_type").isNull(), "no source_type")))
    return out.withColumns(
        {
            "title": F.coalesce("fm_title", X.first_heading(F.col("content")), stem),
            "article_id": F.concat_ws("-", stem, F.left("content_hash", F.lit(8))),
            "pub_year": X.pub_year(F.col("fm_year"), F.col("pub_date")),
            "content_length": F.length("content"),
        }
    ).drop("body", "fm_title", "fm_source_type", "fm_year")


def accepted(parsed: DataFrame) -> DataFrame:
    """Rows without an error; raises IngestError naming the first that has one."""
    bad = parsed.where("error is not null").select("path", "error").orderBy("path").limit(1).collect()
    if bad:
        raise IngestError(f"{bad[0].path}: {bad[0].error}")
    return parsed.drop("error")


def to_markdown(articles: DataFrame) -> DataFrame:
    """(article_id, markdown): export with the title as heading."""
    return articles.select("article_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "content", F.lit("\n")).alias("markdown"))


def with_strategy(text: str, strategy: str) -> str:
    """text with chunk_strategy in its front matter, all other lines as they are; a
    front matter whose value runs over several lines is written anew."""
    plain = text.replace("\r\n", "\n")
    meta, body = split_front_matter(plain)
    line = f"chunk_strategy: {strategy}"
    if not meta and not plain.removeprefix("\ufeff").startswith("---\n"):
        out = f"---\n{line}\n---\n{body}"
    else:
        start, head, rest = re.match(r"(\ufeff?---\n)(.*?)(\n---.*)", plain, re.DOTALL).groups()
        put, n = re.subn(r"(?m)^chunk_strategy[ \t]*:.*$", lambda _: line, head)
        out = f"{start}{put if n else head + chr(10) + line}{rest}"
        try:
            same = split_front_matter(out)[0] == meta | {"chunk_strategy": strategy}
        except IngestError:
            same = False
        if not same:
            out = f"{start}{yaml.safe_dump(meta | {'chunk_strategy': strategy}, allow_unicode=True, sort_keys=False).rstrip()}{rest}"
    return out.replace("\n", "\r\n") if "\r\n" in text else out


def set_chunk_strategy(target: str | Path, strategy: str, *, recursive: bool = True, keep: bool = False, dry_run: bool = False) -> list[tuple[Path, str]]:
    """Set the strategy of a Markdown file, or of a folder's. Returns each file's
    outcome: changed, unchanged, kept (it has another one and ``keep`` is set) or
    failed. Files are replaced whole, by one rename; a dry run writes none."""
    if strategy not in chunking.STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}; known: {', '.join(sorted(chunking.STRATEGIES))}")
    target = Path(target)
    out = []
    for path in [target] if target.is_file() else sorted(target.glob("**/*.md" if recursive else "*.md")):
        try:
            text = path.read_bytes().decode("utf-8")
            now = split_front_matter(text)[0].get("chunk_strategy")
        except (IngestError, UnicodeDecodeError) as e:
            out.append((path, f"failed: {e}"))
            continue
        what = "unchanged" if now == strategy else "kept" if now and keep else "changed"
        if what == "changed" and not dry_run:
            with tempfile.NamedTemporaryFile("wb", dir=path.parent, suffix=".tmp", delete=False) as f:
                f.write(with_strategy(text, strategy).encode("utf-8"))
            shutil.copymode(path, f.name)
            os.replace(f.name, path)
        out.append((path, what))
    return out


def preview_chunks(spark: SparkSession, path: str | Path, strategy: str = "paragraph", head: int = 80) -> DataFrame:
    """(chunk_index, length, head) of the chunks that ingest would make of one file,
    by its own strategy if it names one; nothing is written."""
    meta, body = split_front_matter(Path(path).read_text(encoding="utf-8"))
    made = chunking.chunk(F.col("body"), str(meta.get("chunk_strategy") or strategy))
    flat = spark.createDataFrame([(X.normalize_str(body),)], "body string").select(F.posexplode(made).alias("chunk_index", "t"))
    cut = F.concat(F.replace(F.left("t", F.lit(head)), F.lit("\n"), F.lit(" / ")), F.when(F.length("t") > head, "...").otherwise(""))
    return flat.select("chunk_index", F.length("t").alias("length"), cut.alias("head"))
