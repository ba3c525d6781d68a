"""The filter of searches and summaries, as a column condition."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("tag", "source_type", "subtype", "category", "pub_year")
_KEYS = {*(f"{c}{op}" for c in COLUMNS for op in ("", "__in", "__not_in")), "pub_year__gte", "pub_year__lte"}


def not_excluded(c: str | Column = "category") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != "excluded"


@dataclass(frozen=True)
class Filter:
    """Conditions joined by AND, e.g. Filter.of(tag="a", pub_year__gte=2000)."""

    conditions: tuple[tuple[str, Any], ...] = ()

    @classmethod
    def of(cls, **conditions: Any) -> Filter:
        if unknown := sorted(set(conditions) - _KEYS):
            raise TypeError(f"unknown filter: {', '.join(unknown)}")
        return cls(tuple((k, tuple(v) if isinstance(v, (list, set, tuple)) else v) for k, v in conditions.items() if v is not None))

    def within(self, **fixed: Any) -> Filter:
        """The filter for callers who may only see rows that pass ``fixed``, such as a
        tenant's source_type: both hold, so it can be narrowed but not widened."""
        return Filter((*self.conditions, *Filter.of(**fixed).conditions))

    def canonical(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k, v in sorted(self.conditions, key=repr):
            value = list(v) if isinstance(v, tuple) else v
            out[k] = [out[k], value] if k in out else value
        return out

    def condition(self) -> Column:
        """Nulls follow SQL: a row without the column's value passes no test."""
        return reduce(lambda a, b: a & b, (self._one(k, v) for k, v in self.conditions), F.lit(True))

    @staticmethod
    def _one(key: str, value: Any) -> Column:
        name, _, op = key.partition("__")
        if name == "tag":
            has = lambda t: F.array_contains("tags", F.lit(t))
            if op == "in":
                return reduce(lambda a, b: a | b, map(has, value), F.lit(False))
            return reduce(lambda a, b: a & b, (~has(t) for t in value), F.lit(True)) if op == "not_in" else has(value)
        c = F.col(name)
        return {"": lambda: c == value, "in": lambda: c.isin(list(value)), "not_in": lambda: ~c.isin(list(value)), "gte": lambda: c >= value, "lte": lambda: c <= value}[op]()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition()) if self.conditions else df
