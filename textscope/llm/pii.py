"""Personal data: fixed formats, and boosted trees over proposed spans.

Everything on the path of the documents is a SQL expression of the text. Four
exact formats are always reported. High-recall generators propose further
spans (local phone formats, identity and account numbers, spelled-out
addresses); boosted trees score each by its format and what stands before it,
and those at or above the calibrated threshold are added where they meet no
exact span. The trees are fitted on ``SAMPLE`` labelled sentences made from
rules, whose features come from the same expressions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import as_text, table
from .spans import SPAN, count, kind_spans, literal, matches, ordered, replaced

KINDS = ["email", "ip", "card", "phone", "id"]
#: Labelled sentences that the trees are fitted on; a quarter sets the threshold.
SAMPLE = 4000
PRECISION = 0.995

# Forms without nested repeats and without starts inside a run already tried,
# so that very long texts neither overflow the matcher nor cost a square.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_LUHN = """element_at(transform(array(regexp_replace(m.v, '[^0-9]', '')), d -> length(d) between 14 and 19 and
  aggregate(sequence(1, length(d)), 0, (a, i) -> a + if((length(d) - i) % 2 = 0, int(substring(d, i, 1)),
  int(substring('0246813579', int(substring(d, i, 1)) + 1, 1)))) % 10 = 0), 1)"""


def base_spans(text: str) -> str:
    """SQL of the exact spans of a text column."""
    return "concat({})".format(
        ", ".join(
            [
                kind_spans(text, f"contains({text}, '@')", EMAIL, "true", "email", 0),
                kind_spans(text, f"{text} rlike {literal(r'[0-9]\.[0-9]')}", IP, "forall(split(m.v, '[.]'), x -> double(x) <= 255)", "ip", 1),
                kind_spans(text, f"{text} rlike {literal(r'[0-9](?:[ -]?[0-9]){13}')}", CARD, _LUHN, "card", 2),
                kind_spans(text, f"contains({text}, '+')", PHONE, "length(regexp_replace(m.v, '[^0-9]', '')) between 10 and 15", "phone", 3),
            ]
        )
    )


#: (kind, gate, pattern) of the span generators.
GENERATORS = [
    ("phone", r"[0-9][\x20().-]{1,2}[0-9]", r"(?<![0-9+])[(]?[0-9]{2,4}[)]?(?:[\x20.-]{1,2}[0-9]{2,4}){1,4}(?![0-9])"),
    ("id", r"[0-9]{3}-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("id", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"),
    ("email", r"(?i)[(\[]at[)\]]|\x20at\x20[a-z0-9-]+\x20dot\x20", r"(?i)[a-z0-9._%+-]{1,64}(?:\x20?[(\[]at[)\]]\x20?[a-z0-9-]{1,63}\x20?(?:[(\[]dot[)\]]|\.)|\x20at\x20[a-z0-9-]{1,63}\x20dot\x20)\x20?[a-z]{2,24}"),
]

#: Context words, fixed values.
PHONE_WORDS = "phone|tel|call|fax|mobile|cell|contact|telefon|téléphone|llame"
ID_WORDS = "ssn|social|security|passport|iban|account|konto|compte|cuenta|national id"
MAIL_WORDS = "mail|write|contact|reach|address"

#: Features of a candidate c (c.v its text, c.k its generator) after context c.b, before c.a.
FEATURES = [
    "double(length(c.v))",
    "double(length(regexp_replace(c.v, '[^0-9]', '')))",
    "double(length(regexp_replace(c.v, '[^ .()-]', '')))",
    "double(c.k)",
    "if(contains(c.v, '('), 1D, 0D)",
    "double(length(regexp_replace(c.v, '[^A-Za-z]', '')))",
    f"if(c.b rlike '{PHONE_WORDS}', 1D, 0D)",
    f"if(c.b rlike '{ID_WORDS}', 1D, 0D)",
    f"if(c.b rlike '{MAIL_WORDS}', 1D, 0D)",
    "if(c.v rlike '^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$', 1D, 0D)",
    "if(c.v rlike '^[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}$|^[0-9]{2}[.-][0-9]{2}[.-][0-9]{2,4}$', 1D, 0D)",
    "if(c.b rlike '[0-9a-z$€#.-]$', 1D, 0D)",
    "if(c.a rlike '^[0-9A-Za-z%-]', 1D, 0D)",
    "if(c.v rlike '(?i)[(\\\\[](at|dot)[)\\\\]]', 1D, 0D)",
    "if(c.v rlike '(?i)dot[)\\\\] ]', 1D, 0D)",
]


def _candidates(text: str) -> str:
    """SQL: array<struct<s,e,v,k,kind,b,a>> of all proposed spans."""
    parts = []
    for k, (kind, gate, pattern) in enumerate(GENERATORS):
        parts.append(
            f"""if({text} rlike {literal(gate)}, transform({matches(text, pattern)}, m -> named_struct('s', m.s, 'e', m.e, 'v', m.v, 'k', {k}, 'kind', '{kind}',
            'b', lower(substring({text}, greatest(1, m.s - 23), least(24, m.s))), 'a', substring({text}, m.e + 1, 1))),
            cast(array() as array<struct<s:int,e:int,v:string,k:int,kind:string,b:string,a:string>>))"""
        )
    return f"concat({', '.join(parts)})"


def labelled_sentences(n: int = SAMPLE, seed: int = 7) -> list[tuple[str, int]]:
    """n sentences with one proposed span each, label 1 for personal data."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    sep = lambda: r.choice("-. ")

    def phone():
        s = sep()
        return r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", s.join((digits(3), digits(3), digits(4))), s.join(("0" + digits(1), *(digits(2) for _ in range(4))))])

    def mail():
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", ".")])
        return f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    def iban():
        return f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)}" + "".join(r.choice(["", " "]) + digits(4) for _ in range(r.randint(3, 5)))

    yes = [(phone, PHONE_WORDS, 0.7), (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ID_WORDS, 0.7), (iban, ID_WORDS, 0.6), (mail, MAIL_WORDS, 0.7)]
    no = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}",
        lambda: f"{digits(2)} {digits(3)}",
        lambda: f"{digits(3)} {digits(3)} {digits(3)}",
        lambda: f"{digits(3)}-{digits(3)}",
        lambda: f"{digits(2)}.{digits(2)}",
        lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        lambda: f"978-{digits(2)}-{digits(3)}-{digits(4)}",
        lambda: f"{r.choice(['AB', 'XK', 'NO'])}{digits(2)}{''.join(r.choice('ABCDEFGHJK0123456789') for _ in range(8))}",
        lambda: f"{word()} at {word()}. {word()}",
        lambda: f"{word()} at {word()} {word()}. {word()}",
        lambda: f"[at] {word()} {word()}.{word()}",
    ]
    out = []
    for k in range(n):
        lead = " ".join(word() for _ in range(r.randint(1, 5)))
        if k % 2:
            make, words, often = yes[k // 2 % len(yes)]
            key = r.choice(words.split("|")) if r.random() < often else word()
            out.append((f"{lead} {key}{r.choice([': ', ' '])}{make()}{r.choice([' ', '. ', ', '])}{word()}", 1))
        else:
            key = r.choice((PHONE_WORDS + "|" + ID_WORDS).split("|")) if r.random() < 0.05 else word()
            out.append((f"{lead} {key} {no[k // 2 % len(no)]()}{r.choice([' ', '. ', ', '])}{word()}", 0))
    return out


_fitted: dict[int, tuple[str, float]] = {}


def model(spark: SparkSession, n: int = SAMPLE) -> tuple[str, float]:
    """(SQL of a candidate's probability from features f[0..], threshold). The
    sample is fixed by n, so the model is too."""
    if n not in _fitted:
        rows = spark.createDataFrame(labelled_sentences(n), "t string, y int").select("y", F.expr(f"explode({_candidates('t')})").alias("c"))
        made = rows.select("y", F.expr(f"array({', '.join(FEATURES)})").alias("f")).collect()
        x, y = np.array([r.f for r in made]), np.array([r.y for r in made], float)
        held = np.arange(len(y)) % 4 == 0
        trees = boosting.fit(x[~held], y[~held])
        p = 1 / (1 + np.exp(-trees.margin(x[held])))
        _fitted[n] = trees.sql([f"f[{k}]" for k in range(len(FEATURES))]), max(0.5, boosting.threshold_for(p, y[held], PRECISION))
    return _fitted[n]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``, both arrays of spans (see spans.SPAN).

    Null text counts as empty and has no spans. Columns of docs named base or
    spans are replaced, all others stay, row by row; an empty table stays empty."""
    p, least = model(docs.sparkSession)
    held = docs.drop("base", "spans").withColumn("__t", as_text(text))
    held = held.withColumn("base", F.expr(base_spans("__t"))).withColumn("__c", F.expr(f"filter({_candidates('__t')}, c -> not exists(base, b -> b.s < c.e and c.s < b.e))"))
    scored = f"""transform(__c, c -> element_at(transform(array(array({', '.join(FEATURES)})), f -> named_struct('s', c.s,
      'k', if(c.kind = 'email', 0, if(c.kind = 'phone', 3, 4)), 'e', c.e, 'kind', c.kind, 'p', {p})), 1))"""
    held = held.withColumn("__c", F.expr(f"filter(if(size(__c) = 0, cast(array() as {SPAN}), {scored}), x -> x.p >= {least!r}D)"))
    alone = "filter(__c, c -> not exists(__c, d -> d.s < c.e and c.s < d.e and (d.p > c.p or d.p = c.p and (d.e - d.s > c.e - c.s or d.e - d.s = c.e - c.s and (d.s < c.s or d.s = c.s and d.k < c.k)))))"
    return held.withColumn("spans", F.expr(f"array_sort(concat(base, {alone}))")).drop("__t", "__c")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets."""
    found = find(docs.withColumn("__text", as_text(text)), "__text")
    return found.withColumn(text, F.expr(f"if({text} is null, null, {replaced('__text', 'spans')})")).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.expr(count("base", k)).alias(f"n_{k}") for k in KINDS[:4]],
        F.expr(f"sha2(cast({ordered('base')} as binary), 256)").alias("base_sha256"),
        F.expr(ordered("spans")).alias("spans"),
        F.expr("cast(size(spans) as bigint)").alias("n_spans"),
    )
