"""Secrets: fixed formats, and character Markov models of long tokens.

Everything on the path of the documents is a SQL expression of the text. Three
exact formats are always reported. Long tokens that mix letters with digits or
cases are scored by the log-likelihood ratio, per character, of two first-order
character models: one of random strings, one of ordinary identifiers. Tokens at
or above the calibrated threshold are added where they meet no exact span. Both
models are counted from ``SAMPLE`` labelled strings each, made from rules.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import as_text, table
from .spans import SPAN, count, kind_spans, literal, matches, ordered, replaced

KINDS = ["assign", "access", "hex", "random"]
#: Labelled strings of each class; a quarter sets the threshold.
SAMPLE = 4000
PRECISION = 0.999
MIN_CHARS = 20

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+"
_VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[a-z0-9+/_.=-]{6}"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
_TOKEN = "[A-Za-z0-9+/_=-]"
LONG = rf"(?:\G|(?<!{_TOKEN})){_TOKEN}{{{MIN_CHARS},}}+"


def base_spans(text: str) -> str:
    """SQL of the exact spans of a text column."""
    return "concat({})".format(
        ", ".join(
            [
                kind_spans(text, f"{text} rlike {literal(_VALUE.replace('^', ''))}", ASSIGN, f"m.v rlike {literal(_VALUE)}", "assign", 0),
                kind_spans(text, f"contains({text}, 'AKIA')", ACCESS, "true", "access", 1),
                kind_spans(text, f"{text} rlike '[0-9a-f]{{24}}'", HEX, "true", "hex", 2),
            ]
        )
    )


def candidates(text: str) -> str:
    """SQL of the long tokens worth scoring: array<struct<s,e,v>>."""
    found = f"filter({matches(text, LONG)}, m -> m.v rlike '[A-Za-z]' and (m.v rlike '[0-9]' or m.v rlike '[a-z][A-Z]'))"
    return f"if({text} rlike '[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]', {found}, cast(array() as array<struct<s:int,e:int,v:string>>))"


ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Index of any other character; 0 stands before the first one.
OTHER, SIZE = len(ALPHABET) + 1, len(ALPHABET) + 2

#: Words that ordinary identifiers are put together from, fixed values.
WORDS = (
    "get set user name value index count list item data file path page node type size time date start end next prev first last open close read write load save find make init main test base core util view model query table column row cell key map hash code text line word char string number total "
    "result error message request response server client session config option default handler manager factory service controller component render update delete insert select create remove check valid parse format convert encode decode"
).split()
SYLLABLES = "er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve te al ra la el ci que ment tion ung lich keit sch ver ent".split()


def labelled_strings(n: int = SAMPLE, seed: int = 11) -> tuple[list[str], list[str]]:
    """n random strings and n ordinary ones."""
    r = random.Random(seed)
    sets = ["0123456789abcdef", ALPHABET, ALPHABET + "+/", ALPHABET + "_-", ALPHABET[:26] + ALPHABET[52:], ALPHABET[26:]]
    made = ["".join(r.choice(sets[k % len(sets)]) for _ in range(r.randint(MIN_CHARS, 64))) for k in range(n)]

    def ordinary(k: int) -> str:
        pool = SYLLABLES if k % 3 == 0 else WORDS
        parts = [r.choice(pool) for _ in range(r.randint(4, 7))]
        while sum(map(len, parts)) < MIN_CHARS:
            parts.append(r.choice(pool))
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(1, len(parts)), str(r.choice([r.randint(0, 99), r.randint(1990, 2030)])))
        style = r.randint(0, 5)
        if style == 0:
            return "".join([parts[0], *(x.capitalize() for x in parts[1:])])
        if style == 1:
            return "".join(x.capitalize() for x in parts)
        joined = r.choice("_-/").join(parts) if style < 5 else "".join(parts)
        return joined.upper() if r.random() < 0.2 else joined

    return made, [ordinary(k) for k in range(n)]


def _codes(text: str) -> np.ndarray:
    return np.array([0, *(ALPHABET.find(c) + 1 or OTHER for c in text)])


def _log_model(strings: list[str]) -> np.ndarray:
    seen = np.full((SIZE, SIZE), 0.5)
    for s in strings:
        c = _codes(s)
        np.add.at(seen, (c[:-1], c[1:]), 1)
    return np.log(seen / seen.sum(axis=1, keepdims=True))


_fitted: dict[int, tuple[np.ndarray, float]] = {}


def model(n: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(log ratio by previous and present character, threshold of its mean)."""
    if n not in _fitted:
        yes, no = labelled_strings(n)
        cut = 3 * n // 4
        ratio = _log_model(yes[:cut]) - _log_model(no[:cut])
        held = yes[cut:] + no[cut:]
        mean = np.array([ratio[(c := _codes(s))[:-1], c[1:]].mean() for s in held])
        least = boosting.threshold_for(mean, np.array([1.0] * (n - cut) + [0.0] * (n - cut)), PRECISION)
        _fitted[n] = np.round(ratio, 4), max(0.0, round(least, 4))
    return _fitted[n]


def _score(value: str, n: int) -> str:
    """SQL of a token's mean log ratio."""
    ratio, _ = model(n)
    table_ = "array(" + ",".join(f"{x:.4f}D" for x in ratio.ravel()) + ")"
    code = "(x -> if(locate(x, '{0}') > 0, locate(x, '{0}'), {1}))".format(ALPHABET, OTHER)
    codes = f"concat(array(0), transform(filter(split({value}, ''), x -> x <> ''), {code[1:-1]}))"
    return f"""element_at(transform(array({codes}), c -> aggregate(sequence(1, size(c) - 1), 0D,
      (a, i) -> a + {table_}[c[i - 1] * {SIZE} + c[i]]) / (size(c) - 1)), 1)"""


def find(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs with ``base`` and ``spans``, both arrays of spans (see spans.SPAN).

    Null text counts as empty and has no spans. Columns of docs named base or
    spans are replaced, all others stay, row by row; an empty table stays empty."""
    _, least = model(sample)
    held = docs.drop("base", "spans").withColumn("__t", as_text(text))
    held = held.withColumn("base", F.expr(base_spans("__t")))
    held = held.withColumn("__c", F.expr(f"filter({candidates('__t')}, c -> not exists(base, b -> b.s < c.e and c.s < b.e))"))
    scored = f"transform(__c, c -> named_struct('s', c.s, 'k', 3, 'e', c.e, 'kind', 'random', 'p', {_score('c.v', sample)}))"
    held = held.withColumn("spans", F.expr(f"array_sort(concat(base, if(size(__c) = 0, cast(array() as {SPAN}), filter({scored}, x -> x.p >= {least}D))))"))
    return held.drop("__t", "__c")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, same rows and columns, each span of the text replaced by its kind in
    brackets; n_chars, where there is one, follows the text."""
    found = find(docs.withColumn("__text", as_text(text)), "__text")
    found = found.withColumn(text, F.expr(f"if(size(spans) = 0, {text}, {replaced('__text', 'spans')})"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.expr(f"if(size(spans) = 0, n_chars, length({text}))").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.expr(count("base", k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.expr(f"sha2(cast({ordered('base')} as binary), 256)").alias("base_sha256"),
        F.expr(ordered("spans")).alias("spans"),
        F.expr("cast(size(spans) as bigint)").alias("n_spans"),
    )
