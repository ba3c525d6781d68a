"""Queries beside their SQL on texts that the driver's small tables don't hold."""

import re
from collections import Counter

import duckdb

from textscope.functions import text as X
from textscope.operators import evaluate
from textscope.plans import queries


def differ(spark, d, name: str, **tables) -> tuple[list, list]:
    """Rows that only the query or only its SQL has. tables: name -> (schema, rows)."""
    db = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    out = queries.QUERIES[name](spark, str(d))
    want = db.execute(queries.SQL[name])
    at = [[x[0] for x in want.description].index(c) for c in out.columns]
    a, b = Counter(map(tuple, out.collect())), Counter(tuple(r[i] for i in at) for r in want.fetchall())
    return sorted((a - b).elements(), key=repr), sorted((b - a).elements(), key=repr)


def test_chunk_markers_on_odd_texts(spark, tmp_path):
    texts = ["", None, " ", "x\rAlpha", "x Beta\u0085Cee", "Alpha\x0b\nBeta\f", "Dee \u0085", "pre\nAlpha\r\nBeta \n\n Cee\nKay　", "é" * 2500, "A", "zed"]
    assert differ(spark, tmp_path, "chunk_markers", documents=("doc_id long, text string", list(enumerate(texts)))) == ([], [])


def test_normalize_any_html_on_entities_that_are_cut_off(spark, tmp_path):
    pages = ["<title>a &amp;&amp</title> b &amp;c &ampc; &copy", "&quot;x&quot &amp;quot; &middot;", "<p>\t a  \r\n\r\n\r\n\r\n b </p>"]
    assert differ(spark, tmp_path, "normalize_any_html", pages=("page_id long, html string", list(enumerate(pages)))) == ([], [])
    assert X.normalize_str("a &amp;&amp &copy") == "a && ©"  # the reference's form, unchanged
    assert X.normalize_str("&eacute; &#39; &#x41; &nosuch; &amp", bare=False) == "é ' A &nosuch; &amp"


def moved(df, capsys) -> str:
    """The columns that the exchanges of a query move, by its plan."""
    df.explain("formatted")
    blocks = capsys.readouterr().out.split("\n\n")
    return "\n".join(line for b in blocks if re.match(r"\(\d+\) Exchange\b", b.strip()) for line in b.splitlines() if line.startswith("Input"))


def test_first_chunks_by_hand_and_without_moving_texts(spark, tmp_path, capsys, monkeypatch):
    words = ["aab", "abb", "bba", "zzz"]
    rows = [(a, c, "".join("Ab"[(a * 7 + c * 3 + i * i) % 5 % 2] for i in range(4 + (a + c) % 3))) for a in range(40) for c in range(3)]
    want = [(w, *place, k) for w in words for k, place in enumerate([(a, c) for a, c, t in rows if w in t.lower()][:7], 1)]
    chunks, asked = spark.createDataFrame(rows[::-1], "article_id long, chunk_index int, chunk_text string"), spark.createDataFrame([(w,) for w in words * 2], "k string")
    for groups in (64, 3):  # with 3 no word has a bound
        monkeypatch.setattr(evaluate, "GROUPS", groups)
        assert sorted(map(tuple, evaluate.first_chunks(chunks, asked, 7).collect())) == want
    assert evaluate.first_chunks(chunks, asked.limit(0)).collect() == []
    for t, schema, n in (("documents", "doc_id long, text string, source string, lang string, n_chars long", 5), ("labels", "doc_id long, quality int, toxic int", 3), ("benchmark", "item_id long, text string", 2)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    columns = moved(queries._hits(spark, str(tmp_path)), capsys)
    assert columns and "chunk_text" not in columns and "content" not in columns


def test_search_cuts_and_folds_each_chunk_once(spark, tmp_path):
    texts = ["The and of. The and", "and the. of the and so", "Nothing here. At all", "the and. " * 300]
    tables = {
        "documents": ("doc_id long, text string, source string, lang string, n_chars long", [(k, t, f"src{k}", "en", len(t)) for k, t in enumerate(texts)]),
        "labels": ("doc_id long, quality int, toxic int", [(2, 1, 1)]),
        "embeddings": ("vec_id long, embedding array<float>", [(k, [0.6, 0.8 if k else -0.8]) for k in range(3)]),
    }
    assert differ(spark, tmp_path, "rrf_merge", **tables) == ([], [])
    df = queries.rrf_merge(spark, str(tmp_path))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("posexplode") == 1
