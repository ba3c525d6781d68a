"""Text functions as column expressions.

``fold`` is what full-text search compares: lower case, Latin letters without
diacritics, everything but letters, numbers and private-use characters gone.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DROP = r"[^\p{L}\p{N}\p{Co}]"


def _latin() -> tuple[str, str]:
    """Latin letters whose decomposition starts with an ASCII letter, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b.lower()) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LATIN_FROM, LATIN_TO = _latin()
_TABLE = str.maketrans(LATIN_FROM, LATIN_TO)


def fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), LATIN_FROM, LATIN_TO), _DROP, "")


def fold_str(text: str) -> str:
    """The same for a query on the driver."""
    kept = text.lower().translate(_TABLE)
    return "".join(ch for ch in kept if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co")


def phrases(query: str, limit: int = 64) -> list[str]:
    """Folded phrases of the white-space separated terms, empty ones dropped."""
    return [f for t in query.replace('"', "").split()[:limit] if (f := fold_str(t))]


def spaced_chars(c: Column) -> Column:
    """Characters that aren't white space, joined by spaces."""
    return F.array_join(F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", ""), ""), lambda x: x != ""), " ")


def bordered(p: str) -> bool:
    """Whether occurrences of p can overlap: a proper prefix is also a suffix."""
    return any(p[:k] == p[-k:] for k in range(1, len(p)))


def occurrences(c: Column, p: str) -> Column:
    """Overlapping occurrences of a folded phrase."""
    if not bordered(p):
        return ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("int")
    return F.when(F.contains(c, F.lit(p)), F.regexp_count(c, F.lit(f"(?=\\Q{p}\\E)"))).otherwise(0)


def content_hash(c: Column) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(16))


def collapse(c: Column) -> Column:
    """Tags out, line ends and blanks collapsed: the part of ``normalize`` after
    entities are decoded."""
    for pattern, put in ((r"<[a-zA-Z/!][^>]*>", ""), (r"\r\n?", "\n"), (r"(?m)[ \t　]+$", ""), (r"[ \t　]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(c, pattern, put)
    return c


#: Entities that the column form decodes, the ampersand last; fixed values.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def normalize_known(c: Column) -> Column:
    """``normalize`` for text that is NFC and has no entity but ``ENTITIES``."""
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return collapse(F.coalesce(c, F.lit("")))


#: An entity with its semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def _decoded(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]


def normalize_str(text: str | None, bare: bool = True) -> str:
    """bare: entities that lack their semicolon are decoded too, as browsers do."""
    t = unicodedata.normalize("NFC", text or "")
    t = html.unescape(t) if bare else _CLOSED.sub(_decoded, t)
    t = re.sub(r"<[a-zA-Z/!][^>]*>", "", t)
    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub(r"(?m)[ \t　]+$", "", t)
    t = re.sub(r"[ \t　]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@F.pandas_udf(StringType())
def normalize(s: pd.Series) -> pd.Series:
    """NFC and any entity need Python; batches of rows by Arrow."""
    return s.map(normalize_str)


@F.pandas_udf(StringType())
def normalize_closed(s: pd.Series) -> pd.Series:
    """``normalize`` that leaves an entity without its semicolon, such as one cut off
    at the end of a title, as it is."""
    return s.map(lambda t: normalize_str(t, bare=False))


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def snippet(content: Column, terms: list[str], window: int = 200) -> Column:
    """Text around the first of the terms that occurs (any case), half a window to
    each side, escaped and with all terms marked; the text's start if none does."""
    terms = [t for t in terms if t]
    half = window // 2
    c = F.coalesce(content, F.lit(""))
    cut, hit = F.left(c, F.lit(window)), F.lit(False)
    for t in reversed(terms):
        at = F.instr(F.lower(c), t.lower())
        start = F.greatest(F.lit(1), at - half)
        cut = F.when(at > 0, F.substring(c, start, at + len(t) + half - start)).otherwise(cut)
        hit = hit | (at > 0)
    out = marked = escape_html(cut)
    for t in terms:
        marked = F.replace(marked, F.lit(html.escape(t)), F.lit(f"<mark>{html.escape(t)}</mark>"))
    return F.when(hit, marked).otherwise(out)


def highlight_html(c: Column, terms: list[str]) -> Column:
    """Marks terms outside tags, for up to 5,000 characters and 32 terms."""
    some = [re.escape(html.escape(t)) for t in terms[:32] if t]
    if not some:
        return c
    return F.when(F.length(c) > 5000, c).otherwise(F.regexp_replace(c, f"(?i)({'|'.join(some)})(?![^<]*>)", "<mark>$1</mark>"))


def strip_markdown(c: Column) -> Column:
    """Plain text of Markdown; images dropped. Regular expressions, not a parser."""
    for pattern, put in ((r"```[\s\S]*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|[0-9]+[.])\s+", ""), (r"[*_`~]{1,3}", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


def plain_preview(c: Column, n: int = 36) -> Column:
    """The first n characters without the leading marker and signs of emphasis."""
    return F.left(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s*[#>*\-_`]*\s*", ""), "[*_`]", ""), F.lit(n))


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, "")


def sanitize_prompt(c: Column, limit: int = 10_000) -> Column:
    """Escaped text without control signs, of ``limit`` characters (0: any number)."""
    out = escape_html(strip_control(c))
    return F.left(out, F.lit(limit)) if limit > 0 else out


def sanitize_prompt_str(text: str, limit: int = 10_000) -> str:
    out = html.escape(re.sub(_CONTROL, "", text))
    return out[:limit] if limit > 0 else out


def normalize_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def truncate(c: Column, n: int = 1200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def join_tags(tags: Column) -> Column:
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")


def pub_year(explicit: Column, pub_date: Column) -> Column:
    """An integer given, else the first four digits of the date's text."""
    text = pub_date.cast("string")
    return F.coalesce(explicit.try_cast("int"), F.when(text.rlike("^[0-9]{4}"), F.left(text, F.lit(4)).try_cast("int")))


def first_heading(body: Column) -> Column:
    """Text of the first level-one heading, ATX or underlined; null if none."""
    atx = F.nullif(F.regexp_extract(body, r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1), F.lit(""))
    lined = F.nullif(F.regexp_extract(body, r"(?m)^([^\n#>\-=][^\n]*)\n=+[ \t]*$", 1), F.lit(""))
    return strip_markdown(F.coalesce(atx, lined))
