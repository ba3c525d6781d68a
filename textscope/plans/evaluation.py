"""Evaluation runs over all questions in one job, their files and their report."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..operators import evaluate, lexical
from ..sources.files import Candidate, gold_frame

#: Hits of a question that the report shows.
SHOWN_HITS = 3
BAR = 40


class GateError(RuntimeError):
    pass


def hits(index: DataFrame, candidates: Sequence[Candidate], top_k: int = evaluate.TOP_K, any_term: bool = False) -> DataFrame:
    """The hits of all questions, as ``evaluate`` takes them. index:
    lexical.article_index; a question without a hit has no row."""
    found = lexical.search_many(index, [(c.id, c.query) for c in candidates], limit=top_k, any_term=any_term)
    mark = F.col("content_hash") if "content_hash" in index.columns else X.content_hash(F.col("content"))
    meta = index.select("article_id", "title", F.col("content").alias("content_full"), mark.alias("content_hash"))
    return found.join(meta, "article_id").select(F.col("query_id").alias("id"), "article_id", "rank", (-F.col("bm25_raw")).alias("score"), "content_full", "title", "content_hash")


def run(spark: SparkSession, candidates: Sequence[Candidate], found: DataFrame, top_k: int = evaluate.TOP_K, **about: Any) -> dict[str, Any]:
    """A run's output: ``about``, questions with their best articles, summary. found:
    ``hits`` of any searcher. What is collected is bounded by top_k hits a question."""
    began = time.time()
    rolled = evaluate.rollup(found, top_k).persist()
    try:
        results = evaluate.path_results(rolled, gold_frame(spark, list(candidates)), top_k).persist()
        asked = spark.createDataFrame([(c.id, c.category) for c in candidates], "id long, category string")
        metrics = evaluate.question_metrics(results).join(asked, "id").persist()
        best: dict[int, list[dict]] = {}
        for r in rolled.select("id", "rank", "article_id", "title", "score", "content_hash").orderBy("id", "rank").collect():
            best.setdefault(r.id, []).append({k: v for k, v in r.asDict().items() if k != "id"})
        passing: dict[int, list[str]] = {}
        for r in results.where("rank_full is not null").orderBy("id", "path_tag").collect():
            passing.setdefault(r.id, []).append(r.path_tag)
        by_id = {r.id: r for r in metrics.collect()}
        summary = evaluate.summary(metrics).first().asDict()
        summary["by_category"] = {r.category: {k: r[k] for k in ("count", "pass_count", "pass_rate_pct")} for r in evaluate.summary_by(metrics, "category").collect()}
        results.unpersist(), metrics.unpersist()
    finally:
        rolled.unpersist()
    questions = [
        asdict(c)
        | {"pass": by_id[c.id].passed, "partial_only": by_id[c.id].partial_only, "rr_at_5": by_id[c.id].rr_at_5}
        | {"passing_paths": passing.get(c.id, []), "article_results": best.get(c.id, [])}
        for c in candidates
    ]
    summary["elapsed_total_sec"] = round(time.time() - began, 2)
    head = {"date": datetime.now(UTC).isoformat(), "schema_version": schema.SCHEMA_VERSION, "top_k_requested": top_k}
    return head | about | {"questions": questions, "summary": summary}


def _write_json(path: Path, data: Any) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return path


def write_run(made: dict[str, Any], path: str | Path) -> tuple[Path, Path]:
    """The run, and beside it its summary alone (``.summary.json`` added)."""
    path = Path(path)
    return _write_json(path, made), _write_json(path.with_name(path.name + ".summary.json"), made["summary"])


@dataclass(frozen=True)
class Review:
    """A person's look at sampled questions."""

    sampled: tuple[int, ...]
    flagged: tuple[int, ...] = ()
    most: int = 1

    @property
    def passed(self) -> bool:
        return evaluate.subjective_gate([True] * len(self.flagged), self.most)


def write_promotion(path: str | Path, run_path: str | Path, mean_overlap: float, review: Review, threshold: float = evaluate.OVERLAP_GATE) -> Path:
    """The marker that a run is the new baseline; raises unless both gates pass."""
    gates = {
        "objective_gate": {"mean_overlap": mean_overlap, "threshold": threshold, "passed": round(mean_overlap, 9) >= threshold},
        "subjective_gate": {"sampled_qids": list(review.sampled), "flagged_qids": list(review.flagged), "threshold": review.most, "passed": review.passed},
    }
    if failed := [name for name, g in gates.items() if not g["passed"]]:
        raise GateError(f"not promoted: {', '.join(failed)} failed")
    return _write_json(Path(path), {"promoted_at": datetime.now(UTC).isoformat(), "run_path": str(run_path)} | gates)


def _cell(x: Any, most: int | None = None) -> str:
    """One table cell: no line end, bars escaped."""
    text = " ".join(str("" if x is None else x).split())
    return (text if most is None else text[:most]).replace("|", "\\|")


def _table(columns: str, rows: Iterable[Iterable[Any]]) -> list[str]:
    """A Markdown table; a column name that ends in ``>`` is set right."""
    names = columns.split(",")
    ruler = ["---:" if n.endswith(">") else "---" for n in names]
    lines = [[n.rstrip(">") for n in names], ruler, *([_cell(x) for x in r] for r in rows)]
    return [f"| {' | '.join(x)} |" for x in lines]


def _facts(data: dict, *names: str) -> list[str]:
    return [f"- **{n}**: {data.get(n, 'n/a')}" for n in names]


def report(made: dict[str, Any], *, promotion: dict | None = None, overlaps: Sequence[dict] | None = None, migration: str | None = None, trimmed: dict | None = None, corpus_size: int | None = None) -> str:
    """A run as Markdown in six sections, a seventh where a trim is given. overlaps:
    rows with overlap_rate in 0..1."""
    s = made.get("summary", {})
    about = _facts(made, "run_id", "version", "source_commit", "snapshot_taken_at", "date", "pipeline_mode", "top_k_requested")
    if corpus_size is not None:
        about.append(f"- **corpus_size**: {corpus_size:,} articles")
    categories = [(name, c["count"], c["pass_count"], f"{c['pass_rate_pct']}%") for name, c in sorted(s.get("by_category", {}).items())]
    totals = _facts(s, "total", "pass_count", "pass_rate_pct", "partial_pass_count", "mean_passing_path_count", "mrr_at_5", "elapsed_total_sec")
    gates = ["_Not promoted: no marker given._"]
    if promotion:
        gates = [line for g in ("objective_gate", "subjective_gate") for line in (f"### {g}", *_facts(promotion.get(g, {}), *promotion.get(g, {})))]
        gates.append(f"_Promoted at {promotion.get('promoted_at', 'n/a')}._")
    verdicts = [
        (q["id"], _cell(q.get("category"), 20), _cell(q.get("query"), 40), "yes" if q.get("pass") else "no", _cell(",".join(q.get("passing_paths") or []), 40), "; ".join(f"#{h['rank']}:{_cell(h.get('title'), 30)}" for h in (q.get("article_results") or [])[:SHOWN_HITS]))
        for q in made.get("questions", [])
    ]
    spread = ["_No overlaps given._"]
    if overlaps:
        bins = [0] * 10
        for o in overlaps:
            bins[min(9, int(o["overlap_rate"] * 10 + 1e-9))] += 1
        spread = _table("from,to,count>,bar", ((k / 10, (k + 1) / 10, n, "#" * (BAR * n // max(bins))) for k, n in enumerate(bins) if n))
    sections = [
        ("Run", about),
        ("Summary", [*totals, "", "### By category", "", *_table("category,count>,pass_count>,pass_rate_pct>", categories)]),
        ("Gates", gates),
        ("Questions", _table(f"id>,category,query,pass,passing paths,top {SHOWN_HITS} hits", verdicts)),
        ("Overlap with the baseline", spread),
        ("Migrated evaluation set", [migration or "_No difference given._"]),
    ]
    if trimmed is not None:
        removed = sorted((trimmed.get("removed_by_source_type") or {}).items())
        sections.append(("Trim", [*_facts(trimmed, "removed_count", "corpus_size_before", "corpus_size_after"), "", *(_table("source_type,removed>", removed) if removed else [])]))
    blocks = ["\n".join([f"## {k}. {title}", "", *lines]).rstrip() for k, (title, lines) in enumerate(sections, 1)]
    return "\n\n".join(["# Baseline report" + (" (trimmed corpus)" if trimmed is not None else ""), *blocks]) + "\n"


def write_report(path: str | Path, text: str) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path
