"""Small input files: evaluation sets, id lists, dictionaries, configuration."""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

MAX_BASELINE_BYTES, MAX_STRING = 10 << 20, 64 << 10


class InputError(ValueError):
    pass


@dataclass(frozen=True)
class GoldPath:
    path_tag: str
    keywords: tuple[str, ...]
    article_hints: tuple[str, ...] = ()
    expected_direction: str | None = None


@dataclass(frozen=True)
class Candidate:
    id: int
    query: str
    category: str
    source: str
    gold_paths: tuple[GoldPath, ...]


def _strings(value: Any, where: str) -> tuple[str, ...]:
    """A list's items as text; a plain string is one item, nothing is none."""
    if value is not None and not isinstance(value, (str, list)):
        raise InputError(f"{where} must be a list or a string")
    return (value,) if isinstance(value, str) else tuple(map(str, value or ()))


def _gold_path(entry: Any, where: str, number: int, hints: str = "article_hints") -> GoldPath:
    if not isinstance(entry, dict):
        raise InputError(f"{where}: gold path must be an object")
    words = _strings(entry.get("keywords"), f"{where}: keywords")
    if not words:
        raise InputError(f"{where}: keywords must not be empty")
    return GoldPath(str(entry.get("path_tag", f"path_{number}")), words, _strings(entry.get(hints), f"{where}: {hints}"), entry.get("expected_direction"))


def _unique(values: list, what: str) -> None:
    if repeated := sorted({str(v) for v in values if values.count(v) > 1}):
        raise InputError(f"repeated {what}: {', '.join(repeated)}")


def load_candidates(path: str | Path) -> list[Candidate]:
    """JSON lines; blank lines and lines with # are skipped, errors name the line."""
    out = []
    for no, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        where = f"line {no}"
        try:
            d = json.loads(line)
        except ValueError as e:
            raise InputError(f"{where}: {e}") from e
        if not isinstance(d, dict):
            raise InputError(f"{where}: must be an object")
        if "expected_keywords" in d:
            raise InputError(f"{where}: expected_keywords is the old format; migrate it to gold_paths")
        if not isinstance(d.get("id"), int) or not isinstance(d.get("query"), str) or not d["query"].strip():
            raise InputError(f"{where}: id must be an integer and query a non-empty string")
        paths = d.get("gold_paths")
        if not isinstance(paths, list) or not paths:
            raise InputError(f"{where}: gold_paths must be a non-empty list")
        made = tuple(_gold_path(p, where, k) for k, p in enumerate(paths))
        _unique([p.path_tag for p in made], f"path_tag in {where}")
        out.append(Candidate(d["id"], d["query"], str(d.get("category") or ""), str(d.get("source") or ""), made))
    _unique([c.id for c in out], "id")
    return out


def load_snapshot(path: str | Path) -> list[Candidate]:
    """Nested benchmark JSON: categories, questions, gold paths; needs provenance."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not data.get("source_commit"):
        raise InputError("source_commit is required")
    out = []
    for category in data.get("categories") or []:
        for q in category.get("questions") or []:
            where = f"question {q.get('id')}"
            made = tuple(_gold_path(p, where, k, "representative_corpus_articles") for k, p in enumerate(q.get("gold_paths") or []))
            if not made:
                raise InputError(f"{where}: no gold path")
            _unique([p.path_tag for p in made], f"path_tag in {where}")
            out.append(Candidate(int(q["id"]), str(q["query"]), str(category.get("name") or ""), str(data["source_commit"]), made))
    _unique([c.id for c in out], "id")
    return out


def gold_frame(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    rows = [(c.id, p.path_tag, list(p.keywords)) for c in candidates for p in c.gold_paths]
    return spark.createDataFrame(rows, "id long, path_tag string, keywords array<string>")


def migrate_legacy(entry: dict[str, Any]) -> dict[str, Any]:
    """An old entry with its keywords and hints as one gold path."""
    out = dict(entry)
    if "gold_paths" not in out:
        if "expected_keywords" not in out:
            raise InputError("expected_keywords is missing")
        words, hints = (list(_strings(out.pop(name, None), name)) for name in ("expected_keywords", "expected_article_hints"))
        out["gold_paths"] = [{"path_tag": "default", "keywords": words, "article_hints": hints}]
    return out


def id_kind(value: str) -> str:
    """'hash' for 16 or 64 hexadecimal digits, else 'article_id'."""
    return "hash" if re.fullmatch(r"[0-9a-fA-F]{16}|[0-9a-fA-F]{64}", value) else "article_id"


def parse_id_list(text: str) -> list[tuple[str, str]]:
    out = []
    for no, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if re.search(r"\s", line):
            raise InputError(f"line {no}: white space in an id")
        out.append((id_kind(line), line))
    return out


def load_baseline(path: str | Path) -> dict[str, Any]:
    """A run's JSON: a regular file of bounded size with bounded strings."""
    p = Path(path)
    if not p.is_file() or p.is_symlink():
        raise InputError("not a regular file")
    if p.stat().st_size > MAX_BASELINE_BYTES:
        raise InputError("file too large")
    data = json.loads(p.read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("questions"), list):
        raise InputError("questions must be a list")
    stack: list[Any] = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, str) and len(x) > MAX_STRING:
            raise InputError("string too long")
        stack += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return data


def merge_dictionaries(sources: list[str | Path | dict], bundled: dict[str, dict] | None = None) -> dict[str, Any]:
    """JSON dictionaries merged, the last one winning; ``example:name`` is bundled."""
    out: dict[str, Any] = {}
    for s in sources:
        if isinstance(s, dict):
            out |= s
        elif str(s).startswith(("http://", "https://")):
            raise InputError("only local files are read")
        elif str(s).startswith("example:"):
            name = str(s).removeprefix("example:")
            if name not in (bundled or {}):
                raise InputError(f"no example {name!r}")
            out |= bundled[name]
        else:
            out |= json.loads(Path(s).read_text(encoding="utf-8"))
    return out


def dictionary_terms(spark: SparkSession, path: str) -> DataFrame:
    """First column of a user dictionary."""
    from pyspark.sql import functions as F

    first = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    return spark.read.text(path).select(first.alias("term")).where("term <> '' and not startswith(term, '#')")


DEFAULTS: dict[str, Any] = {
    "directory_map": {},
    "chunk_strategies": {},
    "search": {"alpha": 0.25, "candidate_pool": 50, "entities": [], "intents": []},
    "web": {"limit": 10},
}


def _deep_merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = _deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(flag: str | None = None, variable: str = "TEXTSCOPE_CONFIG", default: str = "textscope.yaml") -> dict[str, Any]:
    """Defaults under the file named by the flag, the variable, or the default."""
    path = Path(flag or os.environ.get(variable) or default)
    if not path.exists():
        if flag or os.environ.get(variable):
            raise InputError(f"no configuration at {path}")
        return copy.deepcopy(DEFAULTS)
    data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        raise InputError("configuration must be a mapping")
    if unknown := set(data) - set(DEFAULTS):
        raise InputError(f"unknown sections: {', '.join(sorted(unknown))}")
    return _deep_merge(DEFAULTS, data)
