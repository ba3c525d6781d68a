"""License scans by a trained paragraph classifier.

Everything on the path of the documents is a SQL expression of the text.
A paragraph is a run of lines between blank ones. Notices are often wrapped, and
a long run can hold more than a notice, so every line and every window of up to
``WINDOW`` neighbouring lines of a run is judged; of overlapping windows of one
family the one that holds most of a template counts, the smallest of equals. Those that mention a licensing word are cut into word one- and
two-grams; a sparse multinomial logistic regression gives each family's
probability. A family is reported where its probability reaches the calibrated
threshold and a template of the family confirms it: enough of the template's
two-grams stand in the paragraph. Paragraphs that the model holds for licensing
but can't attribute are ``unknown``. The model is fitted on ``SAMPLE``
paragraphs varied by rules from the templates and from ordinary sentences that
use the same words.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, table
from .spans import literal

#: Family -> short public licence wordings, fixed values.
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "BSD": ["released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC0": ["released under cc0 1.0 universal", "dedicated to the public domain under the creative commons zero dedication", "this is free and unencumbered software released into the public domain"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license"],
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license 2.0"],
    "Proprietary": ["all rights reserved no part may be reproduced without written permission", "confidential and proprietary all rights reserved", "all rights reserved"],
}
FAMILIES = ["none", "unknown", *TEMPLATES]
#: Ordinary sentences with licensing words, and wordings of no listed family; fixed values.
ORDINARY = [
    "she renewed her driver license at the office", "the copyright law lecture starts at noon", "he asked for permission to leave the room", "the pilot lost his license last year",
    "creative work is common in the public domain of ideas", "a license plate was found near the road", "the warranty on the car expired", "freedom of the software market and public opinion",
    "general public interest in the version grew", "the apache helicopter landed", "students at mit won the prize", "attribution of the painting is unclear",
]
OTHER_LICENSES = [
    "licensed under the terms of the vendor agreement", "released under the community source license version 1", "this file is distributed under the artistic license", "licensed under the eclipse public license",
    "use is subject to the license terms of the publisher", "provided under a custom license see the license file", "distributed under the academic free license",
]
SAMPLE = 3000
GATE = r"(?i)licen[cs]|copyright|permission|redistribut|all rights reserved|creative commons|public domain|\bcc[- ]?(?:by|0)\b"
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
MIN_TEMPLATE = 0.6
#: Lines that are judged together at most: the longest template takes four, wrapped at 60 columns from anywhere in a line.
WINDOW = 5
PRECISION = 0.995


def grams(text: str) -> list[str]:


    words = re.findall(WORD, text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def grams_sql(text: str) -> str:
    """SQL of the same: distinct one- and two-grams of a paragraph."""
    words = f"regexp_extract_all(lower({text}), {literal(WORD)}, 0)"
    return f"element_at(transform(array({words}), w -> array_distinct(concat(w, if(size(w) < 2, cast(array() as array<string>), transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])))))), 1)"


def labelled_paragraphs(n: int = SAMPLE, seed: int = 5) -> list[tuple[str, int]]:
    r = random.Random(seed)
    noise = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    filler = "this work file text document page is by the author and in of content".split()
    out = []
    for k in range(n):
        label = k % len(FAMILIES)
        base = r.choice([ORDINARY, OTHER_LICENSES][label] if label < 2 else TEMPLATES[FAMILIES[label]])
        words = base.split()
        if len(words) > 8 and r.random() < 0.3:
            words = words[: r.randint(len(words) * 2 // 3, len(words))]
        lead = [r.choice([r.choice(filler), noise()]) for _ in range(r.choice([0, 0, 2, 6]))]
        tail = [noise() for _ in range(r.choice([0, 0, 3, 10]))]
        out.append((" ".join(lead + words + tail), label))
    return out


class Model:
    """weights[gram] per family, the least probability, all from labelled paragraphs."""

    def __init__(self, n: int = SAMPLE, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3):
        rows = [(grams(t), y) for t, y in labelled_paragraphs(n)]
        held = [k % 4 == 3 for k in np.random.default_rng(3).permutation(len(rows))]
        seen: dict[str, int] = {}
        for (g, _), h in zip(rows, held):
            for x in g if not h else ():
                seen[x] = seen.get(x, 0) + 1
        self.grams = sorted(x for x, c in seen.items() if c >= max(3, n // 300))
        place = {x: k for k, x in enumerate(self.grams)}
        x = np.zeros((len(rows), len(self.grams) + 1))
        x[:, -1] = 1
        for k, (g, _) in enumerate(rows):
            x[k, [place[w] for w in g if w in place]] = 1
        y = np.array([c for _, c in rows])
        train = ~np.array(held)
        w = np.zeros((x.shape[1], len(FAMILIES)))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            p = self._softmax(x[train] @ w)
            p[np.arange(len(p)), y[train]] -= 1
            g = x[train].T @ p / len(p) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = np.round(w, 3)
        p = self._softmax(x[~train] @ self.weights)
        best, true = p[:, 2:].max(axis=1), y[~train]
        right = p[:, 2:].argmax(axis=1) + 2 == true
        order = np.argsort(-best)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(share >= PRECISION)
        self.least = float(round(max(0.5, best[order][fine[-1]] if len(fine) else 1.0), 4))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sql(self, held: str) -> str:
        """SQL of the families' probabilities of a paragraph with these grams."""
        rows = lambda ws: "array(" + ",".join(f"{x:.3f}D" for x in ws) + ")"
        table_ = "map(" + ",".join(f"{literal(g)},{rows(self.weights[k])}" for k, g in enumerate(self.grams)) + ")"
        found = f"filter(transform({held}, g -> try_element_at({table_}, g)), w -> w is not null)"
        margins = f"aggregate({found}, {rows(self.weights[-1])}, (a, w) -> zip_with(a, w, (p, q) -> p + q))"
        return f"""element_at(transform(array({margins}), z -> element_at(transform(array(transform(z, x -> exp(x - array_max(z)))),
          e -> transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))), 1)), 1)"""


_fitted: dict[int, Model] = {}


def model(n: int = SAMPLE) -> Model:
    if n not in _fitted:
        _fitted[n] = Model(n)
    return _fitted[n]


def _template_share(held: str, family: str) -> str:
    """SQL: the largest share of a template's two-grams that the grams hold."""
    cases = []
    for name, texts in TEMPLATES.items():
        shares = []
        for t in texts:
            own = [g for g in grams(t) if " " in g]
            shares.append(f"size(array_intersect(array({','.join(map(literal, own))}), {held})) / {len(own)}D")
        cases.append(f"when {literal(name)} then greatest({', '.join([*shares, '0D'])})")
    return f"case {family} {' '.join(cases)} else 0D end"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``licenses``: array<struct<line int, family, probability, template_share>>
    of the licensing notices, line being the first of a wrapped one; ``unknown``
    where no family is sure or confirmed, for a line or a run of WINDOW lines at most.

    Null and empty texts have none. Rows keep their other columns (one named
    licenses is replaced); repeated paragraphs are reported each."""
    fitted = model()
    names = "array(" + ",".join(map(literal, FAMILIES)) + ")"
    gate = literal(GATE)
    blank = lambda l: f"not({l} rlike '[^\\\\s]')"
    held = docs.drop("licenses").withColumn("__t", as_text(text))
    held = held.withColumn("__l", F.expr(f"if(translate(__t, '\n', ' ') rlike {gate}, split(__t, '\n'), null)"))
    spans = f"flatten(transform(__l, (l, i) -> transform(sequence(1, least({WINDOW}, size(__l) - i)), n -> named_struct('line', i, 'n', n, 'part', slice(__l, i + 1, n)))))"
    spans = f"filter({spans}, x -> x.n = 1 or not exists(x.part, l -> {blank('l')}))"
    spans = f"filter(transform({spans}, x -> named_struct('line', x.line, 'n', x.n, 'l', array_join(x.part, ' '))), x -> x.l rlike {gate})"
    edge = lambda i: f"coalesce({blank(f'get(__l, {i})')}, true)"
    held = held.withColumn("__p", F.expr(f"transform({spans}, x -> named_struct('line', x.line, 'n', x.n, 'whole', {edge('x.line - 1')} and {edge('x.line + x.n')}, 'held', {grams_sql('x.l')}))"))
    scored = f"transform(__p, x -> named_struct('line', x.line, 'n', x.n, 'whole', x.whole, 'held', x.held, 'p', {fitted.sql('x.held')}))"
    held = held.withColumn("__q", F.expr(f"if(size(__p) = 0, null, {scored})"))
    best = f"transform(filter(__q, x -> x.p[0] < 0.5), x -> named_struct('line', x.line, 'n', x.n, 'whole', x.whole, 'held', x.held, 'family', {names}[int(array_position(slice(x.p, 3, {len(FAMILIES) - 2}), array_max(slice(x.p, 3, {len(FAMILIES) - 2}))) + 1)], 'probability', array_max(slice(x.p, 3, {len(FAMILIES) - 2}))))"
    held = held.withColumn("__b", F.expr(best))
    held = held.withColumn("__b", F.expr(f"transform(transform(__b, x -> named_struct('x', x, 'share', {_template_share('x.held', 'x.family')})), y -> named_struct('o', -y.share, 'n', y.x.n, 'line', y.x.line, 'whole', y.x.whole, 'family', y.x.family, 'probability', y.x.probability, 'template_share', y.share))"))
    sure = f"x.probability >= {fitted.least}D and x.template_share >= {MIN_TEMPLATE}D"
    kind = "array<struct<o:double,n:int,line:int,whole:boolean,family:string,probability:double,template_share:double>>"
    over = "o.line < x.line + x.n and x.line < o.line + o.n"
    # by falling share, then the smallest; one that overlaps a taken one of its family is left
    held = held.withColumn("__s", F.expr(f"aggregate(array_sort(filter(__b, x -> {sure})), cast(array() as {kind}), (a, x) -> if(exists(a, o -> o.family = x.family and {over}), a, concat(a, array(x))))"))
    other = f"array_sort(filter(__b, x -> (x.n = 1 or x.whole) and not({sure}) and not exists(__s, o -> {over})))"
    held = held.withColumn("__u", F.expr(f"aggregate({other}, cast(array() as {kind}), (a, x) -> if(exists(a, o -> {over}), a, concat(a, array(x))))"))
    row = lambda family: f"x -> named_struct('line', x.line, 'family', {family}, 'probability', x.probability, 'template_share', x.template_share)"
    out = f"array_sort(concat(transform(__s, {row('x.family')}), transform(__u, {row(literal('unknown'))})))"
    return held.withColumn("licenses", F.expr(f"coalesce({out}, cast(array() as array<struct<line:int,family:string,probability:double,template_share:double>>))")).drop("__t", "__l", "__p", "__q", "__b", "__s", "__u")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.expr("bigint(size(licenses))").alias("n_paragraphs"),
        F.expr("bigint(size(filter(licenses, x -> x.family = 'unknown')))").alias("n_unknown"),
        F.expr("array_join(array_sort(array_distinct(transform(filter(licenses, x -> x.family <> 'unknown'), x -> x.family))), ',')").alias("families"),
        F.expr("array_join(transform(licenses, x -> concat(x.line, ':', x.family)), ',')").alias("found"),
    )
