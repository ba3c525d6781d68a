"""The pipeline's stages hold together and keep clean documents."""

import random

import corpus_pipeline

from .samples import prose


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(12)
    rows = [(k, prose(r, 80), "en", "src0") for k in range(120)]
    toxic = []
    for k in range(40):
        words = prose(r, 60).split()
        words[5:5] = ["idiot", "scum", "clown"]
        toxic.append((200 + k, " ".join(words), "en", "src1"))
    copies = [(300 + k, rows[k][1], "en", "src2") for k in range(10)]
    item = prose(r, 25)
    leaks = [(400, rows[30][1] + " " + item, "en", "src3"), (401, item, "en", "src3")]
    secret = [(500, prose(r, 30) + " token = abcdef123456 end", "en", "src4")]
    all_rows = [(*x, len(x[1])) for x in rows + toxic + copies + leaks + secret]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(all_rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(100)] + [(200 + k, 1, 1) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append({x.doc_id for x in docs.select("doc_id").collect()})
    clean = {k for k, *_ in rows}
    assert all(clean <= s for s in seen)
    assert seen[0] == clean | {300 + k for k in range(10)} | {400, 401, 500}
    assert seen[1] == clean | {400, 401, 500}
    assert seen[2] == seen[3] == seen[4] == clean | {500}
    redacted = spark.read.parquet(f"{tmp_path}/secret_scan").where("doc_id = 500").first()
    assert "abcdef123456" not in redacted.text and redacted.n_chars == len(redacted.text)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(docs.columns).collect()))
