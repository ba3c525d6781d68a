"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Search latencies are
those of one question against an index that is built once (build_index);
batch_all_questions searches all benchmark items in one job.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from textscope.operators import lexical
    from textscope.plans import corpus, queries
    from textscope.plans.searcher import Searcher

    times: dict[str, float] = {}

    def timed(name, run, repeat: int = 1) -> None:
        best = float("inf")
        for _ in range(repeat):
            began = time.time()
            run()
            best = min(best, time.time() - began)
        times[name] = round(best, 3)

    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    index = corpus.index(spark, sf_dir).repartition(int(cpus)).cache()
    chunks = corpus.chunk_index(spark, sf_dir).repartition(int(cpus)).cache()
    vectors = corpus.vectors(spark, sf_dir).cache()
    timed("build_index", lambda: (index.count(), chunks.count(), vectors.count()))
    searcher, vector = Searcher(index, chunks, vectors), corpus.query_vector(spark, sf_dir)
    timed("question_lexical", lambda: lexical.search(index, "theand", limit=10).collect(), 3)
    timed("question_hybrid_rrf", lambda: searcher.search("theand", query_vector=vector).collect(), 3)
    questions = [(r.item_id, " ".join(r.text.split()[:2])) for r in corpus.table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull()).collect()]
    timed("batch_all_questions", lambda: drain(lexical.search_many(index, questions, limit=10)))
    for name in ("bm25_topk", "chunk_fixed_window", "chunk_bm25_rollup", "vector_topk", "rrf_merge", "facet_tags", "facet_query_aware", "related_tags_jaccard", "classify_axes", "corpus_stats", "topic_statistics", "incremental_diff", "question_metrics", "fold_text", "normalize_html"):
        timed(name, lambda: drain(queries.QUERIES[name](spark, sf_dir)))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "n_questions": len(questions), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
