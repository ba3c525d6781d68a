"""Small tables for the tests of the training-data operators."""

import random

SYLLABLES = "er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(r: random.Random, words: int) -> str:
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(words)]
    out = []
    for k in range(0, words, 9):
        out.append(" ".join(made[k : k + 9]).capitalize() + ".")
    return " ".join(out)


#: Null and repeated ids, null, empty, blank, wordless and very long texts.
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (None, None), (5, "é" * 3000 + " 日本語  x"), (6, "7" * 20_000 + "a" * 20_000),
    (7, "token = abc123def456 mail me@host.example.org +1 (974) 555-3436 10.0.0.1"), (8, "x y " * 3000), (9, "a\x00b \x1c c\r\nd"),
]
CLASHES = ["base", "spans", "fp", "component_id", "hits", "toxic", "severity", "p_toxic", "grade", "score", "predicted", "quality", "votes", "kept", "row", "grp", "word", "c", "length", "piece", "licenses", "n_words", "text_", "u", "v", "key", "form", "good", "places", "id", "normal", "label", "n_runs", "__none"]


def edge_docs(spark, rows=EDGES):
    """The edge rows with extra columns whose names operators use themselves."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], f"doc_id long, text string, {extra}")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
