"""Markdown, files, chunking, ingest, cache, questions and the stream."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textscope.functions import chunking
from textscope.functions import text as X
from textscope.plans import ingest
from textscope.plans.ask import Aggregator, Asker, ModelError
from textscope.plans.cache import ResultCache
from textscope.plans.searcher import Searcher
from textscope.operators import lexical
from textscope.operators.filters import Filter
from textscope.operators.vector import HashEmbedder
from textscope.schema import SchemaVersionError, check_version
from textscope.sources import files, markdown

FILES = {
    "sermons/one.md": "---\ntitle: One\ntags: [a, b]\npubDate: 2020-03-01\nsource: {url: ' http://x '}\n---\n\nFirst paragraph about grace.\n\nSecond &amp; last paragraph.\n",
    "sermons/two.md": "---\nsource_type: law\ncategory: excluded\ntags: solo\n---\n# The *heading*\n\nLaw text.",
    "empty.md": "---\nsource_type: x\n---\n   \n",
    "bad.md": "---\ntitle: [unclosed\n---\nbody",
    "lost.md": "no type here",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path / "docs")


def parsed(spark, root):
    return markdown.parse(markdown.read_files(spark, root), {"sermons": "sermon"})


def test_markdown(spark, root):
    got = {r.path: r for r in parsed(spark, root).collect()}
    one, two = got["sermons/one.md"], got["sermons/two.md"]
    assert (one.title, one.source_type, one.tags, one.pub_year, one.pub_date, one.source_url) == ("One", "sermon", ["a", "b"], 2020, "2020-03-01", "http://x")
    assert one.content == "First paragraph about grace.\n\nSecond & last paragraph."
    assert one.article_id == f"one-{one.content_hash[:8]}" and len(one.content_hash) == 16
    assert (two.title, two.source_type, two.category, two.tags) == ("The heading", "law", "excluded", ["solo"])
    assert "empty.md" not in got and "front matter" in got["bad.md"].error and got["lost.md"].error == "no source_type"
    with pytest.raises(markdown.IngestError, match="bad.md"):
        markdown.accepted(parsed(spark, root))


def test_snapshot_and_incremental(spark, root, tmp_path):
    good = parsed(spark, root).where("error is null").drop("error").withColumn("indexed_at", F.lit("t0"))
    path = ingest.write_snapshot({"articles": good, **ingest.derived(good, {"sermon": ("paragraph", {"least": 1, "most": 30})}, HashEmbedder(8))}, str(tmp_path / "snap"))
    tables = ingest.read_snapshot(spark, str(tmp_path / "snap"))
    assert path.startswith(str(tmp_path)) and set(tables) == {"articles", "texts", "chunks", "vectors"}
    assert tables["chunks"].count() == 2 and tables["vectors"].where(F.size("vec") == 8).count() == 2
    old = tables["articles"]
    new = old.withColumn("content_hash", F.when(F.col("path") == "sermons/two.md", F.lit("f" * 16)).otherwise(F.col("content_hash"))).withColumn("indexed_at", F.lit("t1")).withColumn("title", F.lit("new"))
    assert {r.path: r.state for r in ingest.diff(new, old).collect()} == {"sermons/one.md": "unchanged", "sermons/two.md": "changed"}
    got = {r.path: (r.title, r.indexed_at) for r in ingest.upsert(new, old).collect()}
    assert got == {"sermons/one.md": ("One", "t1"), "sermons/two.md": ("new", "t1")}
    assert {r.title for r in ingest.upsert(new, old, hash_metadata=True).collect()} == {"new"}
    hashes = spark.createDataFrame([("hash", old.where("path = 'sermons/one.md'").first().content_hash)], "kind string, value string")
    kept, manifest = ingest.trim(tables, hashes)
    assert [r.path for r in kept["articles"].collect()] == ["sermons/two.md"] and kept["chunks"].count() == 0
    assert [(r.source_type, r.removed) for r in manifest.collect()] == [("sermon", 1)]
    with pytest.raises(SchemaVersionError):
        check_version("2")


def test_stream_takes_each_file_once(spark, root, tmp_path):
    from textscope.streaming import files as stream

    for _ in range(2):
        q = stream.start(spark, root, str(tmp_path / "snap"), str(tmp_path / "check"), {"sermons": "sermon"})
        q.awaitTermination(120)
        assert q.exception() is None
    (tmp_path / "docs" / "sermons" / "three.md").write_text("third", encoding="utf-8")
    stream.start(spark, root, str(tmp_path / "snap"), str(tmp_path / "check"), {"sermons": "sermon"}).awaitTermination(120)
    tables = ingest.read_snapshot(spark, str(tmp_path / "snap"))
    assert sorted(r.path for r in tables["articles"].collect()) == ["sermons/one.md", "sermons/three.md", "sermons/two.md"]
    # derived tables follow, and files that failed are kept apart
    assert tables["texts"].count() == 3 and {r.path for r in tables["errors"].collect()} == {"bad.md", "lost.md"}
    with pytest.raises(FileNotFoundError):
        ingest.read_snapshot(spark, str(tmp_path / "none"))


def chunks_of(spark, text, strategy, **options):
    return spark.createDataFrame([(text,)], "t string").select(chunking.chunk(F.col("t"), strategy, **options).alias("c")).first().c


def test_chunkers(spark):
    assert chunks_of(spark, "abcdefghij", "fixed-window", size=4, overlap=1) == ["abcd", "defg", "ghij"]
    assert chunks_of(spark, "", "fixed-window") == [] and chunks_of(spark, "ab", "fixed-window") == ["ab"]
    assert chunks_of(spark, "intro\n# A\ntext\n## B\nmore", "markdown-heading") == ["# A\ntext", "## B\nmore"]
    assert chunks_of(spark, "1:1 a\n1:2 b", "bible-verses") == ["1:1 a", "1:2 b"]
    assert chunks_of(spark, "no marker", "numbered-entries") == ["no marker"]
    assert chunks_of(spark, "a\n\nb\n\n" + "c" * 12, "paragraph", least=3, most=6)[:2] == ["a\n\nb", "cccccc"]
    assert chunking.paragraphs("x" * 10 + "\n\ny", 5, 11) == ["x" * 10 + "\n\ny"]
    assert chunking.paragraphs("a" * 300 + "\n\n" + "b" * 300) == ["a" * 300, "b" * 300]
    assert [len(x) for x in chunking.paragraphs("c" * 1520)] == [1672] and [len(x) for x in chunking.paragraphs("c" * 3000)] == [1500, 1500, 300]
    assert chunking.paragraphs(" \n\n ") == [] and chunking.paragraphs("a\n\nb") == ["a\n\nb"]
    with pytest.raises(ValueError):
        chunking.chunk(F.col("t"), "unknown")
    with pytest.raises(ValueError):
        chunking.fixed_window(F.col("t"), 10, 10)


def test_text_functions(spark):
    row = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert row("<p>a &amp; b</p>\r\n\r\n\r\n\r\nc  \t d ", X.normalize_known) == "a & b\n\nc d"
    assert X.normalize_str("é &eacute; &lt;b&gt; 3 < 4") == "é é 3 < 4"
    assert row("one <two> three", lambda c: X.snippet(c, ["TWO"], 10)).count("&lt;") == 1
    assert row("ab\x00<'x'>\x7f", X.sanitize_prompt) == "ab&lt;&#x27;x&#x27;&gt;\x7f" == X.sanitize_prompt_str("ab\x00<'x'>\x7f")
    assert len(X.sanitize_prompt_str("x" * 20_000, 0)) == 20_000 == len(row("x" * 20_000, lambda c: X.sanitize_prompt(c, 0)))
    assert row("aa bb cc dd ee", lambda c: X.snippet(c, ["dd", "bb"], 6)) == "cc <mark>dd</mark> ee"
    assert row(None, lambda c: X.snippet(c, ["x"])) == "" and row("abcdef", lambda c: X.snippet(c, ["x"], 4)) == "abcd"
    assert row("信 心\nx", X.spaced_chars) == "信 心 x"
    assert row("# T\n\n![i](u) [l](u) **b** `c`", X.strip_markdown) == "T l b c"
    assert row("Title\n=====\nbody", X.first_heading) == "Title"
    assert row("<a title='x'>x</a> x", lambda c: X.highlight_html(c, ["x"])) == "<a title='x'><mark>x</mark></a> <mark>x</mark>"
    assert row("abc", lambda c: X.truncate(c, 2)) == "ab…"
    assert row("hello", X.content_hash) == "2cf24dba5fb0a30e"


def test_eval_files(tmp_path):
    line = {"id": 1, "query": "q", "category": "c", "source": "s", "gold_paths": [{"path_tag": "p", "keywords": ["k"]}]}
    p = tmp_path / "e.jsonl"
    p.write_text("# note\n\n" + json.dumps(line), encoding="utf-8")
    assert files.load_candidates(p)[0].gold_paths[0].keywords == ("k",)
    for bad in ({**line, "expected_keywords": []}, {**line, "gold_paths": []}, {**line, "id": "1"}):
        p.write_text(json.dumps(bad), encoding="utf-8")
        with pytest.raises(files.InputError, match="line 1"):
            files.load_candidates(p)
    p.write_text(json.dumps(line) + "\n" + json.dumps(line), encoding="utf-8")
    with pytest.raises(files.InputError, match="repeated id"):
        files.load_candidates(p)
    snap = {"source_commit": "abc", "categories": [{"name": "n", "questions": [{"id": 3, "query": "q", "gold_paths": line["gold_paths"]}]}]}
    p.write_text(json.dumps(snap), encoding="utf-8")
    assert files.load_snapshot(p)[0].category == "n"
    moved = files.migrate_legacy({"id": 1, "expected_keywords": "ab", "expected_article_hints": ["h"]})
    assert moved == {"id": 1, "gold_paths": [{"path_tag": "default", "keywords": ["ab"], "article_hints": ["h"]}]}
    with pytest.raises(files.InputError):
        files.migrate_legacy({"id": 1})
    p.write_text(json.dumps({**line, "gold_paths": [{"keywords": "k"}, {"keywords": ["l"]}]}), encoding="utf-8")
    assert [(g.path_tag, g.keywords) for g in files.load_candidates(p)[0].gold_paths] == [("path_0", ("k",)), ("path_1", ("l",))]


def test_small_inputs(tmp_path, monkeypatch):
    assert files.parse_id_list("# c\n\nabc-1\n" + "a" * 64 + "\n" + "0" * 16) == [("article_id", "abc-1"), ("hash", "a" * 64), ("hash", "0" * 16)]
    with pytest.raises(files.InputError):
        files.parse_id_list("a b")
    d = tmp_path / "d.json"
    d.write_text('{"x": "concept"}', encoding="utf-8")
    assert files.merge_dictionaries([{"x": "a", "y": "b"}, d, "example:e"], {"e": {"z": "c"}}) == {"x": "concept", "y": "b", "z": "c"}
    with pytest.raises(files.InputError):
        files.merge_dictionaries(["https://example.org/x.json"])
    c = tmp_path / "c.yaml"
    c.write_text("search: {alpha: 0.5}", encoding="utf-8")
    monkeypatch.setenv("TEXTSCOPE_CONFIG", str(c))
    assert files.load_config()["search"] == {"alpha": 0.5, "candidate_pool": 50, "entities": [], "intents": []}
    run = tmp_path / "run.json"
    run.write_text('{"questions": []}', encoding="utf-8")
    assert files.load_baseline(run) == {"questions": []}
    run.write_text('{"questions": [{"q": "' + "x" * 70_000 + '"}]}', encoding="utf-8")
    with pytest.raises(files.InputError):
        files.load_baseline(run)


def test_cache(tmp_path):
    now = [datetime(2024, 1, 1, tzinfo=UTC)]
    c = ResultCache(tmp_path / "c", now=lambda: now[0])
    key = c.key("f", {"b": 1, "a": 2})
    assert key == c.key("f", {"a": 2, "b": 1}) and c.get(key) is None
    c.put(key, {"x": "é"})
    assert c.get(key) == {"x": "é"}
    now[0] += timedelta(days=31)
    assert c.get(key) is None and c.clear() == 1


@pytest.fixture(scope="module")
def searcher(spark):
    rows = [(k, f"Title {k}", f"grace and law number {k}. " + ("grace " * k), ["t"], "s1" if k % 2 else "s2", "", 2000 + k) for k in range(8)]
    a = spark.createDataFrame(rows, "article_id long, title string, content string, tags array<string>, source_type string, category string, pub_year int")
    chunks = a.select("article_id", "title", "tags", F.posexplode(chunking.fixed_window(F.col("content"), 20, 5)).alias("chunk_index", "chunk_text"))
    vectors = a.select("article_id", F.array(F.lit(1.0), F.col("article_id").cast("double")).cast("array<float>").alias("vec"))
    return Searcher(lexical.article_index(a).cache(), lexical.chunk_index(chunks).cache(), vectors)


def test_search_and_ask(searcher, tmp_path):
    hits = searcher.search("grace", query_vector=[1.0, 3.0], limit=3).collect()
    assert len(hits) == 3 and all(h.chunk_hits > 0 for h in hits) and hits[0].ranking_score >= hits[-1].ranking_score
    assert searcher.search("  ", query_vector=[1.0, 3.0]).count() == 0
    said = []

    def model(messages):
        said.append(messages)
        return "an answer [1]"

    asker = Asker(searcher, model, ResultCache(tmp_path / "a"))
    first = asker.ask("grace", k=2, filter=Filter.of(pub_year__gte=2002))
    assert first.text == "an answer [1]" and 0 < len(first.citations) <= 2 and not first.cached
    assert asker.ask("grace", k=2, filter=Filter.of(pub_year__gte=2002)).cached and len(said) == 1
    events = list(asker.ask_stream("grace", lambda m: iter(["a", "b"]), k=1))
    assert [e["event"] for e in events] == ["meta", "delta", "delta", "done"] and events[-1]["text"] == "ab"

    def broken(messages):
        raise ModelError("down")

    turns = [{"role": "user", "content": "about law"}, {"role": "assistant", "content": "yes"}]
    assert Asker(searcher, broken).standalone("and grace?", turns) == "about law and grace?"
    assert Asker(searcher, lambda m: " \n").standalone("and grace?", turns) == "about law and grace?"
    assert Asker(searcher, lambda m: "\n law and grace \n").standalone("and grace?", turns) == "law and grace"


def test_aggregator(searcher, tmp_path):
    cache = ResultCache(tmp_path / "b")
    made = Aggregator(searcher, lambda m: "## C\n- agree\n## D\n- differ", cache)
    topic = made.topic_summary("grace", k=2)
    assert topic["total_hits"] == 8 and len(topic["sources"]) == 2 and topic["narrative"] and made.topic_summary("grace", k=2) == topic
    view = made.concept_perspectives("law", per_source=1)
    assert set(view["per_source"]) == {"s1", "s2"} and (view["consensus"], view["disagreements"]) == (["agree"], ["differ"])

    def broken(messages):
        raise ModelError("down")

    n = len(list((tmp_path / "b").iterdir()))
    assert Aggregator(searcher, broken, cache).topic_summary("law")["narrative"] is None
    assert len(list((tmp_path / "b").iterdir())) == n
