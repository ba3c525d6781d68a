"""Axes configuration: YAML, validated, with its rules and ancestors as tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

RESERVED = "unclassified"
_RULE_KEYS = {"source_type", "primary", "title_regex", "subtype", "tag", "retag_source_type_to"}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    source_type: str
    primary: bool
    title_regex: str | None = None
    subtype: str | None = None
    tag: str | None = None
    retag: str | None = None


@dataclass(frozen=True)
class Axis:
    id: str
    name: str
    order: int
    parent: str | None = None
    rules: tuple[Rule, ...] = ()
    short: str = ""
    description: str = ""
    icon: str = ""


@dataclass(frozen=True)
class AxesConfig:
    axes: tuple[Axis, ...]
    validation: dict[str, Any] = field(default_factory=dict)

    def ancestors(self, axis_id: str) -> list[str]:
        parent = {a.id: a.parent for a in self.axes}
        out, at = [], parent.get(axis_id)
        while at is not None:
            out.append(at)
            at = parent.get(at)
        return out

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a.id, a.order, a.order * 10_000 + k, r.source_type, r.primary, r.title_regex, r.subtype, r.tag, r.retag) for a in self.axes for k, r in enumerate(a.rules)]
        return spark.createDataFrame(rows, "axis_id string, ord int, rule_no int, r_source_type string, is_primary boolean, r_title string, r_subtype string, r_tag string, retag string")

    def ancestors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a.id, x) for a in self.axes for x in self.ancestors(a.id)], "axis_id string, ancestor string")


def _text(entry: dict, key: str, where: str) -> str:
    value = entry.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{where}: {key} must be a non-empty string")
    return value


def _rule(entry: Any, where: str) -> Rule:
    if not isinstance(entry, dict):
        raise ConfigError(f"{where}: a rule must be a mapping")
    if unknown := set(entry) - _RULE_KEYS:
        raise ConfigError(f"{where}: unknown keys {sorted(unknown)}")
    for name in ("subtype", "tag", "retag_source_type_to"):
        if entry.get(name) is not None and not isinstance(entry[name], str):
            raise ConfigError(f"{where}: {name} must be a string")
    if not isinstance(entry.get("primary"), bool):
        raise ConfigError(f"{where}: primary must be true or false")
    pattern = entry.get("title_regex")
    if pattern is not None:
        try:
            re.compile(pattern)
        except (re.error, TypeError) as e:
            raise ConfigError(f"{where}: title_regex: {e}") from e
    return Rule(_text(entry, "source_type", where), entry["primary"], pattern, entry.get("subtype"), entry.get("tag"), entry.get("retag_source_type_to"))


def _bounds(entry: Any) -> dict[str, Any]:
    if not isinstance(entry, dict):
        raise ConfigError("validation must be a mapping")
    for name, value in entry.items():
        if name.endswith(("_min", "_max")) and value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise ConfigError(f"validation: {name} must be a number")
    return entry


def parse_axes(data: Any) -> AxesConfig:
    """Checked: required fields, reserved, repeated and missing ids, orders, cycles."""
    if not isinstance(data, dict) or not isinstance(data.get("axes"), list):
        raise ConfigError("axes must be a list")
    axes = []
    for k, entry in enumerate(data["axes"]):
        where = f"axes[{k}]"
        if not isinstance(entry, dict):
            raise ConfigError(f"{where}: must be a mapping")
        axis = _text(entry, "id", where)
        if axis == RESERVED:
            raise ConfigError(f"{where}: id {RESERVED} is reserved")
        if not isinstance(entry.get("order"), int) or isinstance(entry.get("order"), bool):
            raise ConfigError(f"{where}: order must be an integer")
        rules = tuple(_rule(r, f"{where}.rules[{j}]") for j, r in enumerate(entry.get("rules") or []))
        more = {k: str(entry.get(k) or "") for k in ("short", "description", "icon")}
        axes.append(Axis(axis, _text(entry, "name", where), entry["order"], entry.get("parent"), rules, **more))
    for what in ("id", "order"):
        values = [getattr(a, what) for a in axes]
        if len(set(values)) < len(values):
            raise ConfigError(f"{what}s must be unique")
    parent = {a.id: a.parent for a in axes}
    for axis in parent:
        seen, at = {axis}, parent[axis]
        while at is not None:
            if at not in parent:
                raise ConfigError(f"{axis}: parent {at} is not an axis")
            if at in seen:
                raise ConfigError(f"{axis}: parents form a cycle")
            seen.add(at)
            at = parent[at]
    return AxesConfig(tuple(sorted(axes, key=lambda a: a.order)), _bounds(data.get("validation") or {}))


def load_axes(path: str | Path) -> AxesConfig:
    return parse_axes(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
