"""Spans of regular expressions, in SQL expressions only.

A span is a struct (s start, k rank of its kind, e end, kind, p score) with
code point offsets, end exclusive; base spans have score 1.
"""

from __future__ import annotations

SPAN = "array<struct<s:int,k:int,e:int,kind:string,p:double>>"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> str:
    """array<struct<s,e,v>>: leftmost non-overlapping matches. Splitting gives what
    stands between the matches, so lengths add up to positions."""
    p = literal(pattern)
    return f"""aggregate(arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1)),
      named_struct('p', 0, 'o', cast(array() as array<struct<s:int,e:int,v:string>>)),
      (a, x) -> if(x.`0` is null, a, named_struct('p', a.p + length(x.`1`) + length(x.`0`),
        'o', concat(a.o, array(named_struct('s', a.p + length(x.`1`), 'e', a.p + length(x.`1`) + length(x.`0`), 'v', x.`0`))))),
      a -> a.o)"""


def kind_spans(text: str, gate: str, pattern: str, keep: str, kind: str, rank: int) -> str:
    """Spans of one kind; ``gate`` spares texts without a match the work, ``keep``
    is a condition on the match m (m.v its text)."""
    return f"""if({gate}, transform(filter({matches(text, pattern)}, m -> {keep}),
      m -> named_struct('s', m.s, 'k', {rank}, 'e', m.e, 'kind', '{kind}', 'p', 1D)), cast(array() as {SPAN}))"""


def ordered(spans: str) -> str:
    """kind:start:end of each span by start, then kind, comma-joined."""
    return f"array_join(transform(array_sort({spans}), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def count(spans: str, kind: str) -> str:
    return f"cast(size(filter({spans}, x -> x.kind = '{kind}')) as bigint)"


def replaced(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping
    spans one bracket, the first span's, stands for all."""
    return f"""aggregate(array_sort({spans}), named_struct('p', 0, 'o', ''),
      (a, x) -> if(x.s >= a.p, named_struct('p', x.e, 'o', concat(a.o, substring({text}, a.p + 1, x.s - a.p), '[', upper(x.kind), ']')),
        named_struct('p', greatest(a.p, x.e), 'o', a.o)),
      a -> concat(a.o, substring({text}, a.p + 1)))"""
