"""Search, fusion, entities, classification, facets and evaluation by hand-computed cases."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from textscope.functions import text as X
from textscope.operators import classify, entity, evaluate, facets, fusion, lexical, observe, topics, vector
from textscope.operators.filters import Filter
from textscope.sources.axes import ConfigError, parse_axes

ROWS = [
    ("a1", "Grace and law", "信心 是 恩典。Grace upon grace", ["信仰", "law"], "sermon", "weekday", "", 2020, "2020-01-01"),
    ("a2", "Law of the land", "The law, the law! ÉTAT of law", ["law"], "law", "", "", 2021, "2021-05-01"),
    ("a3", "Hidden", "grace law", ["law"], "sermon", "", "excluded", None, None),
    ("a4", "Aaa", "aaaa 恩典之路", [], "classical", "", None, 1520, "1520-01-01"),
    ("a5", "", "nothing here", None, None, None, "", 2022, ""),
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ROWS, "article_id string, title string, content string, tags array<string>, source_type string, subtype string, category string, pub_year int, pub_date string").cache()


@pytest.fixture(scope="module")
def index(articles):
    return lexical.article_index(articles).cache()


def ids(df):
    return [r.article_id for r in df.collect()]


def test_fold_equals_the_driver_form(spark):
    texts = ["É à ñ Ü", "ＡＢ", "が ά ё ß", "② ² 3", "a_b-c!", "İstanbul", "信心 是"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(X.fold(F.col("t")).alias("f")).collect()]
    assert got == [X.fold_str(t) for t in texts]
    assert got[0] == "eanu" and got[3] == "②²3" and got[4] == "abc" and got[6] == "信心是"


def test_bm25_equals_sqlite_fts5(spark, articles, index):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, content, tags)")
    spaced = lambda s: " ".join(c for c in s or "" if not c.isspace())
    for r in ROWS:
        db.execute("INSERT INTO t VALUES (?,?,?,?)", (r[0], spaced(r[1]), spaced(r[2]), spaced(" ".join(r[3] or []))))
    for query in ["law", "grace law", "恩典", "aa", "etat", "law ! of", "the the"]:
        match = " ".join(f'"{" ".join(t)}"' for t in query.split())
        want = dict(db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        got = {r.article_id: r.bm25_raw for r in lexical.scored(index, query).collect()}
        assert got.keys() == want.keys(), query
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), query


def test_search_leaves_out_excluded_and_scales(index):
    got = lexical.search(index, "law").collect()
    assert [r.article_id for r in got] == ["a2", "a1"] and got[0].bm25_score == 1.0
    assert ids(lexical.search(index, "!?")) == [] and ids(lexical.search(index, "  ")) == []
    assert ids(lexical.search(index, "law", column="title")) == ["a1", "a2"] or ids(lexical.search(index, "law", column="title")) == ["a2", "a1"]
    assert set(ids(lexical.search(index, "恩典 etat", any_term=True))) == {"a1", "a2", "a4"}


def test_many_queries_equal_single_ones(index):
    many = lexical.search_many(index, [(1, "law"), (2, "grace law"), (3, "")], limit=5).collect()
    for q, text in ((1, "law"), (2, "grace law")):
        one = [(r.article_id, round(r.bm25_raw, 9)) for r in lexical.search(index, text, limit=5).collect()]
        assert [(r.article_id, round(r.bm25_raw, 9)) for r in sorted(many, key=lambda r: r["rank"]) if r.query_id == q] == one
    assert {r.query_id for r in many} == {1, 2}


def test_rank_fusion_scores(spark):
    main = spark.createDataFrame([("a1", 0.9, "x"), ("a2", 0.7, "y"), ("a3", 0.5, "x")], "article_id string, ranking_score double, source_type string")
    chunk = spark.createDataFrame([("a3", -2.0), ("a2", -3.0), ("a1", -4.0), ("z", -1.0)], "article_id string, chunk_raw double").where("article_id <> 'z'")
    got = {r.article_id: r.rrf_score for r in fusion.rrf(main, chunk).collect()}
    assert got == pytest.approx({"a1": 1 / 61 + 1 / 63, "a2": 2 / 62, "a3": 1 / 63 + 1 / 61})
    boosted = {r.article_id: r.rrf_score for r in fusion.rrf(main, chunk, ["y"]).collect()}
    assert boosted["a2"] == pytest.approx(2 / 62 + 1 / 61)
    assert {r.article_id: r.rrf_score for r in fusion.rrf(main, None, ["y"]).collect()} == pytest.approx({"a1": 0.9, "a2": 0.85, "a3": 0.5})


def test_rank_fusion_cuts_before_it_drops(spark):
    main = spark.createDataFrame([("m", 0.1, "x")], "article_id string, ranking_score double, source_type string")
    chunk = spark.createDataFrame([(f"c{k}", -float(k + 1)) for k in range(5)], "article_id string, chunk_raw double")
    assert fusion.rrf(main, chunk, limit=1).count() + fusion.rrf(main, chunk, limit=6).count() in (1, 2)


def test_hybrid(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "article_id string, bm25_score double")
    b = spark.createDataFrame([("y", 0.8), ("z", -0.2)], "article_id string, cosine_score double")
    got = {r.article_id: r.hybrid_score for r in fusion.hybrid(a, b).collect()}
    assert got == pytest.approx({"x": 0.25, "y": 0.725, "z": -0.15})
    with pytest.raises(ValueError):
        fusion.hybrid(a, b, alpha=1.5)


def test_vectors(spark, articles):
    v = spark.createDataFrame([("a1", [1.0, 0.0]), ("a2", [0.6, 0.8]), ("a3", [1.0, 0.0])], "article_id string, vec array<float>")
    got = vector.search(v, articles, [2.0, 0.0]).collect()
    assert [(r.article_id, round(r.cosine_score, 6)) for r in got] == [("a1", 1.0), ("a2", 0.6)]
    with pytest.raises(Exception, match="dimension"):
        vector.search(v, articles, [1.0, 0.0, 0.0]).collect()
    e = vector.HashEmbedder(16)
    assert math.isclose(sum(x * x for x in e.encode_batch(["some text"])[0]), 1.0)


def test_entities(spark):
    s = entity.EntityScorer({"恩典": "concept", "保羅": "person", "恩典之約": "concept"}, {"保羅": ["使徒保羅"], "Grace": "恩典"})
    found = s.detect("保羅論恩典之約與恩典")
    assert [(e.name, e.weight) for e in found] == [("保羅", 1.0), ("恩典之約", 0.3), ("恩典", 0.3)]
    assert found[2].aliases == ("Grace",) and s.expand("保羅", found[:1]) == "保羅 使徒保羅"
    rows = spark.createDataFrame([("a", "論恩典", "", 0.5), ("b", "其他", "", 0.5)], "article_id string, title string, content string, ranking_score double")
    got = {r.article_id: r.entity_score for r in s.score(rows, s.detect("恩典")).collect()}
    assert got == pytest.approx({"a": 0.75, "b": 0.275})
    assert ids(s.score(rows, s.detect("保羅"))) == []
    assert s.score(rows, []).count() == 2


def test_intents(spark):
    d = entity.IntentDetector({"law": ["statute", "act"], "pray": ["pray"]}, {"law": ["law"]})
    assert d.detect("pray and act") == "law" and d.detect("x") == "general"
    assert d.boost_types("law") == ["law"] and d.boost_types("general") is None
    got = spark.createDataFrame([("pray and act",), ("pray",), ("x",)], "q string").select(d.column(F.col("q")).alias("i")).collect()
    assert [r.i for r in got] == ["law", "pray", "general"]


AXES = {"axes": [
    {"id": "root", "name": "Root", "order": 3},
    {"id": "faith", "name": "Faith", "order": 1, "parent": "root", "rules": [{"source_type": "sermon", "primary": True, "tag": "信仰"}, {"source_type": "sermon", "primary": False, "retag_source_type_to": "talk"}]},
    {"id": "legal", "name": "Legal", "order": 2, "rules": [{"source_type": "law", "primary": True, "title_regex": "^Law"}]},
]}


def test_classify(articles):
    config = parse_axes(AXES)
    got = {(r.article_id, r.axis_id, r.is_primary) for r in classify.classify(articles, config).collect()}
    assert got == {("a1", "faith", True), ("a1", "root", False), ("a2", "legal", True), ("a3", "faith", False), ("a3", "root", False), ("a4", "unclassified", True), ("a5", "unclassified", True)}
    assert {r.article_id: r.source_type for r in classify.retag(articles, config).collect()}["a3"] == "talk"
    report = classify.validate(articles, classify.classify(articles, config), max_unclassified_pct=10)
    assert not report.passed and report.metrics["unclassified"] == 2 and report.metrics["no_primary"] == 1


@pytest.mark.parametrize("change", [{"id": "unclassified"}, {"order": 1}, {"parent": "none"}, {"parent": "faith"}, {"rules": [{"source_type": "x", "primary": "yes"}]}, {"rules": [{"source_type": "x", "primary": True, "title_regex": "("}]}, {"name": ""}])
def test_bad_axes(change):
    with pytest.raises(ConfigError):
        parse_axes({"axes": [{**AXES["axes"][0], **change}, *AXES["axes"][1:]]})


def test_filters(articles):
    assert ids(Filter.of(tag="law", pub_year__gte=2020).apply(articles)) == ["a1", "a2"]
    assert ids(Filter.of(source_type__not_in=["law"]).apply(articles)) == ["a1", "a3", "a4"]
    assert ids(Filter.of(tag__in=["信仰", "zz"]).apply(articles)) == ["a1"]
    assert Filter.of().apply(articles).count() == 5
    with pytest.raises(TypeError):
        Filter.of(colour="red")


def test_facets(articles, index):
    assert {r.tag: r["count"] for r in facets.tag_counts(articles).collect()} == {"law": 2, "信仰": 1}
    assert {r.tag: r["count"] for r in facets.tag_list(articles).collect()} == {"law": 3, "信仰": 1}
    got = facets.query_tag_counts(articles, lexical.search(index, "恩典")).collect()
    assert [(r.tag, r["count"], r.query_count) for r in got] == [("law", 2, 1), ("信仰", 1, 1)]
    assert [(r.tag, round(r.jaccard, 6)) for r in facets.related_tags(articles, "law").collect()] == [("信仰", round(1 / 3, 6))]
    assert {r.value: r["count"] for r in facets.distribution(articles, "pub_year").collect()}["unknown"] == 1
    assert ids(facets.browse(articles, 2)) == ["a2", "a1"]
    assert ids(facets.tag_articles(articles, "law")) == ["a2", "a1", "a3"]


def test_consistency(spark, index):
    v = spark.createDataFrame([("a1", [1.0])], "article_id string, vec array<float>")
    assert observe.check_consistency(index, index, v, ["law"]).ok
    bad = observe.check_consistency(index, index.limit(0), v, ["zzzz"])
    assert not bad.ok and len(bad.problems) == 3
    with pytest.raises(observe.InconsistentCorpus):
        observe.startup_gate(bad)


def test_gate_can_be_switched_off(monkeypatch):
    monkeypatch.setenv("TEXTSCOPE_SKIP_STARTUP_CHECK", "Yes")
    observe.startup_gate(observe.Consistency(False, {}, {}, ["x"]))


def test_topics(index):
    got = {(r.dimension, r.value): r["count"] for r in topics.topic_statistics(index, "law").collect()}
    assert got[("total_hits", "")] == 2 and got[("source_type", "law")] == 1 and got[("pub_year", "2021")] == 1
    assert ids(topics.topic_sources(index, "law", Filter.of(pub_year__lte=2020))) == ["a1"]
    assert {r.source_type for r in topics.concept_excerpts(index, "law").collect()} == {"law", "sermon"}


@pytest.mark.parametrize("n", [0, 1, 3, 60, 400])
def test_source_blocks_stay_within_budget(n):
    text = topics.source_blocks([("t" * 10, ["x" * 5000, "y" * 5000]) for _ in range(n)])
    heads = sum(len(f"Source {k}: {'t' * 10}") + 2 for k in range(1, n + 1))
    assert len(text) <= max(topics.SOURCE_BUDGET, heads) and text.count("Source ") == n


def test_validation_block_and_tenant_filter(spark):
    from textscope.sources.axes import ConfigError, parse_axes

    schema = "article_id string, source_type string, subtype string, title string, tags array<string>"
    articles = spark.createDataFrame([("1", "s", None, "t", []), ("2", "s", None, "t", []), ("3", "z", None, "t", [])], schema)
    axes = lambda **bounds: parse_axes({"axes": [{"id": "a", "name": "A", "order": 1, "rules": [{"source_type": "s", "primary": True}]}, {"id": "b", "name": "B", "order": 2, "rules": []}], "validation": bounds})
    rows = classify.classify(articles, axes())
    report = classify.validate(articles, rows, axes(total_rows_min=4, unclassified_max=0, per_axis_min=1, avg_axes_per_article_max=1))
    assert not report.passed and report.metrics["per_axis"] == {"a": 2, "b": 0}
    assert [f.split(":")[0] for f in report.failures] == ["rows", "unclassified", "axis b", "axis b has no article"]
    assert classify.validate(articles, rows, axes(total_rows_max=3)).failures == ["axis b has no article"]
    with pytest.raises(ConfigError):
        axes(per_axis_min="1")
    own = Filter.of(source_type="z").within(source_type="s")
    assert own.apply(articles).count() == 0 and Filter.of(tag__in=["x"]).within(source_type="s").canonical() == {"source_type": "s", "tag__in": ["x"]}
    assert own.canonical() == {"source_type": ["s", "z"]} and Filter().within(source_type="s").apply(articles).count() == 2


def test_source_blocks_serve_every_source_first():
    text = topics.source_blocks([("a", ["x" * 400, "y" * 400]), ("b", ["z" * 30]), ("c", ["  ", None])], 700)
    assert "x" * 200 in text and "z" * 30 in text and "x" * 400 not in text and "y" * 200 in text and len(text) <= 700


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.5, "one", "A", "h"), (1, "a", 3, 0.9, "two", "A2", "h"), (1, "b", 2, 0.8, "one two", "B", "i")], "id long, article_id string, rank int, score double, content_full string, title string, content_hash string")
    rolled = {r.article_id: r for r in evaluate.rollup(hits).collect()}
    assert (rolled["a"].first_rank, rolled["a"].title, rolled["a"].content_union, rolled["a"].n_hits) == (3, "A2", "one\ntwo", 2)
    paths = spark.createDataFrame([(1, "p", ["one", "TWO"]), (1, "q", ["one", "zz"]), (2, "r", ["x"])], "id long, path_tag string, keywords array<string>")
    results = evaluate.path_results(evaluate.rollup(hits), paths)
    got = {r.path_tag: r for r in evaluate.path_metrics(results).collect()}
    assert got["p"].rank_full == 2 and got["q"].rank_full is None and got["q"].any_partial and got["r"].rr == 0
    q = {r.id: r for r in evaluate.question_metrics(results).collect()}
    assert q[1].passed and q[1].n_passing == 1 and not q[2].passed and q[1].rr_at_5 == 0.5
    s = evaluate.summary(evaluate.question_metrics(results)).first()
    assert (s.total, s.pass_count, s.pass_rate_pct, s.mrr_at_5) == (2, 1, 50.0, 0.25)
    assert evaluate.summary(evaluate.question_metrics(results).limit(0)).first().pass_rate_pct == 0.0
    ratio = spark.createDataFrame([("abcd", "abcf")], "a string, b string").select(evaluate.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).first().r
    assert ratio == 0.75
    # a path's rank is its hit's own: a second hit of the first article takes a rank
    more = spark.createDataFrame([(1, "a", 1, 0.9, "x", "A", "h"), (1, "a", 2, 0.8, "y", "A", "h"), (1, "b", 3, 0.7, "one", "B", "i")], hits.schema)
    one = paths.where("path_tag = 'p'").withColumn("keywords", F.array(F.lit("one")))
    assert evaluate.path_results(evaluate.rollup(more), one).first().rank_full == 3
    assert evaluate.question_metrics(evaluate.path_results(evaluate.rollup(more), one)).first().rr_at_5 == 1 / 3
    assert evaluate.path_results(evaluate.rollup(more), one, top_k=1).first().rank_full is None


def test_overlap_gate(spark):
    schema = "id long, rank int, content_hash string, title string"
    a = spark.createDataFrame([(1, 1, "h", "T t"), (1, 2, "i", "U"), (2, 1, "h", "x"), (1, 11, "z", "z")], schema)
    b = spark.createDataFrame([(1, 5, "h", "tt"), (3, 1, "h", "x")], schema)
    assert [(r.id, r.overlap_rate) for r in evaluate.overlap(a, b).collect()] == [(1, 0.5)]
    assert not evaluate.objective_gate(evaluate.overlap(a, b)).first().passed
    assert evaluate.objective_gate(evaluate.overlap(a, a)).first().mean_overlap == 1.0
    assert {r["bin"]: r["count"] for r in evaluate.histogram(evaluate.overlap(a, a)).collect()} == {9: 2}
    assert evaluate.subjective_gate([True, False]) and not evaluate.subjective_gate([True, True])
    assert evaluate.sample_questions(range(20), 8, 1) == evaluate.sample_questions(range(20), 8, 1)
