"""Article pages, evaluation runs with their files, and strategy rewriting."""

import json

import pytest

from textscope.functions import text as X
from textscope.operators import entity, lexical
from textscope.plans import article, evaluation
from textscope.sources import files, markdown


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame(
        [("a", "Law", "the law of grace", ["t"], "s", ""), ("b", "Sea", "the sea and the law", None, "s", ""), ("c", None, None, [], None, None)],
        "article_id string, title string, content string, tags array<string>, source_type string, category string",
    )
    c = spark.createDataFrame(
        [("a", 1, "second law", "Law"), ("a", 0, "## *first* part", "x"), ("a", 2, None, None), ("b", 0, "law", "Sea"), ("b", 10, "sea law", ""), ("b", 9, "sea", "")],
        "article_id string, chunk_index int, chunk_text string, title string",
    ).selectExpr("*", "cast(array() as array<string>) AS tags")
    return lexical.article_index(a), lexical.chunk_index(c)


def test_article_view(tables):
    a, c = tables
    view = article.article_view(a, c, "a", "law")
    assert [x["chunk_index"] for x in view["chunks"]] == [0, 1, 2] and view["matched"] == [1]
    assert [x["preview"] for x in view["chunks"]] == ["first part", "second law", ""]
    assert article.article_view(a, c, "a", " ")["matched"] == [] and article.article_view(a, c, "zz") is None
    bare = article.article_view(a, c, "c", "law")
    assert bare["chunks"] == [] and bare["content"] == "" and bare["tags"] == [] and bare["author"] is None
    assert article.view_markdown(view).startswith("# Law\n\n- **Date**: None\n")


def test_matched_chunks(tables):
    got = {r.article_id: r.matched for r in article.matched_chunks(tables[1], "law").collect()}
    assert got == {"a": [1], "b": [0, 10]}
    assert article.matched_chunks(tables[1], "").count() == 0


def test_plain_preview(spark):
    rows = ["  ## a *b*", "- - c", "\n> `d`e_f", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(X.plain_preview("t", 4)).collect()]
    assert got == ["a b", "- c", "def", "", None]


def test_detect_all_equals_detect(spark):
    scorer = entity.EntityScorer({"ab": "person", "abc": "work", "c": "org"})
    texts = ["abc ab c", "", None, "xx", "cabab"]
    got = [r.entities for r in scorer.detect_all(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, query string")).orderBy("k").collect()]
    assert [[(e.name, e.type, e.weight) for e in x] for x in got] == [[(e.name, e.type, e.weight) for e in scorer.detect(t or "")] for t in texts]


CANDIDATES = [
    files.Candidate(1, "law", "x", "", (files.GoldPath("p", ("grace",)), files.GoldPath("q", ("sea", "law")))),
    files.Candidate(2, "nothing", "", "", (files.GoldPath("p", ("grace",)),)),
    files.Candidate(3, "the sea", "x|y", "", (files.GoldPath("p", ("sea", "moon")),)),
]


def test_run_files_and_report(spark, tables, tmp_path):
    made = evaluation.run(spark, CANDIDATES, evaluation.hits(tables[0], CANDIDATES), run_id="r")
    one, two, three = made["questions"]
    assert one["pass"] and one["passing_paths"] == ["p", "q"] and {h["article_id"] for h in one["article_results"]} == {"a", "b"}
    assert not two["pass"] and two["article_results"] == [] and three["partial_only"]
    assert made["summary"]["pass_count"] == 1 and made["summary"]["total"] == 3 and made["summary"]["by_category"]["x"]["pass_count"] == 1
    whole, digest = evaluation.write_run(made, tmp_path / "new" / "run.json")
    assert digest.name == "run.json.summary.json" and json.loads(digest.read_text()) == json.loads(whole.read_text())["summary"]
    assert files.load_baseline(whole)["run_id"] == "r"
    text = evaluation.report(made, overlaps=[{"overlap_rate": x} for x in (0.3, 0.7, 0.7, 1.0)], corpus_size=1234)
    assert text.count("\n## ") == 6 and "1,234 articles" in text and "x\\|y" in text and "_Not promoted" in text
    assert "| 0.7 | 0.8 | 2 | " + "#" * 40 in text and "| 0.3 | 0.4 | 1 |" in text and "| 0.9 | 1.0 | 1 |" in text
    trimmed = evaluation.report(made, trimmed={"removed_count": 2, "removed_by_source_type": {"b": 1, "a": 1}})
    assert trimmed.count("\n## ") == 7 and trimmed.index("| a | 1 |") < trimmed.index("| b | 1 |")
    assert evaluation.report({}).count("\n## ") == 6


def test_promotion_needs_both_gates(tmp_path):
    path = tmp_path / "m" / "marker.json"
    for overlap, flagged in ((0.69, ()), (0.9, (1, 2))):
        with pytest.raises(evaluation.GateError):
            evaluation.write_promotion(path, "run.json", overlap, evaluation.Review((1, 2, 3), flagged))
    assert not path.exists()
    marker = json.loads(evaluation.write_promotion(path, "run.json", 0.7, evaluation.Review((1, 2, 3), (2,))).read_text())
    assert marker["objective_gate"]["passed"] and marker["subjective_gate"]["flagged_qids"] == [2]
    assert "Promoted at" in evaluation.report({}, promotion=marker)


def test_set_chunk_strategy(tmp_path):
    (tmp_path / "sub").mkdir()
    texts = {
        "a.md": "---\ntitle: A  # kept\nchunk_strategy: fixed-window\n---\nbody\n",
        "b.md": "body --- only\n",
        "sub/c.md": "---\r\ntitle: C\r\n---\r\nbody\r\n",
        "d.md": "---\ntitle: [\n---\n",
        "e.md": "---\nchunk_strategy: >\n  fixed-window\ntitle: E\n---\nx",
        "f.md": "---\nchunk_strategy: paragraph\n---\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    read = lambda: {n: (tmp_path / n).read_bytes().decode() for n in texts}
    outcome = lambda **kw: {p.relative_to(tmp_path).as_posix(): o.split(":")[0] for p, o in markdown.set_chunk_strategy(tmp_path, "paragraph", **kw)}
    want = {"a.md": "changed", "b.md": "changed", "sub/c.md": "changed", "d.md": "failed", "e.md": "changed", "f.md": "unchanged"}
    assert outcome(dry_run=True) == want and read() == texts
    assert outcome(keep=True, recursive=False, dry_run=True) == {k: "kept" if k in ("a.md", "e.md") else v for k, v in want.items() if k != "sub/c.md"}
    assert outcome() == want
    got = read()
    assert got["a.md"] == texts["a.md"].replace("fixed-window", "paragraph") and got["d.md"] == texts["d.md"]
    assert got["sub/c.md"] == "---\r\ntitle: C\r\nchunk_strategy: paragraph\r\n---\r\nbody\r\n"
    assert markdown.split_front_matter(got["b.md"]) == ({"chunk_strategy": "paragraph"}, texts["b.md"])
    assert markdown.split_front_matter(got["e.md"])[0] == {"chunk_strategy": "paragraph", "title": "E"}
    assert not list(tmp_path.rglob("*.tmp"))
    with pytest.raises(ValueError):
        markdown.set_chunk_strategy(tmp_path, "none")


def test_preview_chunks(spark, tmp_path):
    f = tmp_path / "a.md"
    f.write_text("---\nchunk_strategy: fixed-window\n---\n" + "ab\n" * 500)
    got = markdown.preview_chunks(spark, f, head=5).collect()
    assert [r.chunk_index for r in got] == [0, 1] and got[0].length == 1000 and got[0].head == "ab / ab..."
