"""Table layouts of a corpus snapshot, with a version that is checked on reading."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "3"


class SchemaVersionError(RuntimeError):
    """The snapshot was written with another layout."""


def _fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


ARTICLES = (
    "article_id string, path string, title string, source_type string, subtype string, pub_date string, pub_year int, content_length int, chunk_count int, "
    "content_hash string, indexed_at string, category string, author string, source_url string, source_urls array<string>, tags array<string>, description string"
)
TEXTS = "article_id string, title string, content string, tags array<string>, title_f string, content_f string, tags_f string, doc_len int"
CHUNKS = "chunk_id string, article_id string, chunk_index int, chunk_text string, title string, tags array<string>"
VECTORS = "article_id string, vec array<float>"
AXES = "article_id string, axis_id string, is_primary boolean"
TABLES = {"articles": ARTICLES, "texts": TEXTS, "chunks": CHUNKS, "vectors": VECTORS, "axes": AXES}


def check_version(found: str | None) -> None:
    if found != SCHEMA_VERSION:
        raise SchemaVersionError(f"snapshot version {found!r}, expected {SCHEMA_VERSION!r}")
