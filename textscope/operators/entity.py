"""Entities of a query, and re-ranking by how well articles cover them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBJECT_TYPES = ("concept", "person", "org")
STRICT_TYPES = ("person", "org")
ALPHA = 0.5
IN_TITLE, IN_CONTENT = 1.0, 0.6
TOGETHER_BONUS, PARAGRAPH_CHARS = 0.15, 10
MISSED_SUBJECT = 0.05


@dataclass(frozen=True)
class Entity:
    name: str
    type: str
    weight: float
    aliases: tuple[str, ...] = ()

    @property
    def forms(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


class EntityScorer:
    def __init__(self, types: dict[str, str], aliases: dict[str, str | list[str]] | None = None, alpha: float = ALPHA):
        self.types, self.alpha = types, alpha
        self.aliases = {k: [v] if isinstance(v, str) else list(v) for k, v in (aliases or {}).items()}

    def aliases_of(self, name: str) -> tuple[str, ...]:
        """Forms listed for the name, then names that list it."""
        own = self.aliases.get(name, [])
        return tuple(dict.fromkeys([*own, *(k for k, v in self.aliases.items() if name in v)]))

    def detect(self, query: str) -> list[Entity]:
        """Dictionary names in the query, the longest first, none inside another;
        listed by place. The first is the subject, unless its type can't be one and
        a later one's can: that one then is. The subject weighs 1, others 0.3."""
        taken = [False] * len(query)
        places: dict[int, str] = {}
        for name in sorted(filter(None, self.types), key=len, reverse=True):
            at = query.find(name)
            while at >= 0:
                span = slice(at, at + len(name))
                if not any(taken[span]):
                    taken[span] = [True] * len(name)
                    places[at] = name
                at = query.find(name, at + 1)
        names = [places[at] for at in sorted(places)]
        subject = next((k for k, n in enumerate(names) if self.types[n] in SUBJECT_TYPES), 0)
        return [Entity(n, self.types[n], 1.0 if k == subject else 0.3, self.aliases_of(n)) for k, n in enumerate(names)]

    def detect_all(self, queries: DataFrame, column: str = "query") -> DataFrame:
        """queries with ``entities`` array<struct<name, type, weight>>, as ``detect`` finds
        them; null: none. The longest name first, none inside another, over all
        places has no built-in form: Arrow batches, with the dictionary as configuration."""

        @F.pandas_udf("array<struct<name:string,type:string,weight:double>>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: [{"name": e.name, "type": e.type, "weight": e.weight} for e in self.detect(t or "")])

        return queries.withColumn("entities", run(column))

    def expand(self, query: str, entities: list[Entity]) -> str:
        more = dict.fromkeys(a for e in entities for a in e.aliases if a not in query)
        return " ".join([query, *more])

    def score(self, articles: DataFrame, entities: list[Entity], *, relevance: str = "ranking_score", title: str = "title", content: str | None = None) -> DataFrame:
        """articles with entity_coverage and entity_score, without those that miss
        a person or organisation that is the first entity. No entity: unchanged."""
        if not entities:
            return articles.withColumn("entity_coverage", F.lit(0.0)).withColumn("entity_score", F.col(relevance))
        t = F.coalesce(F.col(title), F.lit(""))
        c = F.coalesce(F.col(content), F.lit("")) if content else F.lit("")
        holds = lambda text, e: reduce(lambda a, b: a | b, (F.contains(text, F.lit(f)) for f in e.forms))
        signal: list[Column] = [F.when(holds(t, e), IN_TITLE).when(holds(c, e), IN_CONTENT).otherwise(0.0) for e in entities]
        total = sum(e.weight for e in entities)
        coverage = reduce(lambda a, b: a + b, (F.lit(e.weight) * s for e, s in zip(entities, signal))) / total
        if len(entities) > 1 and content:
            together = F.exists(F.split(c, "\n\n"), lambda p: (F.length(p) >= PARAGRAPH_CHARS) & reduce(lambda a, b: a & b, (holds(p, e) for e in entities)))
            coverage = coverage + F.when(together, TOGETHER_BONUS).otherwise(0.0)
        coverage = F.least(F.lit(1.0), coverage)
        missed = signal[0] == 0
        out = articles.where(~missed) if entities[0].type in STRICT_TYPES else articles
        out = out.withColumn("entity_coverage", F.when(missed, MISSED_SUBJECT).otherwise(coverage))
        return out.withColumn("entity_score", self.alpha * F.col(relevance) + (1 - self.alpha) * F.col("entity_coverage"))

    def rerank(self, articles: DataFrame, entities: list[Entity], **names) -> DataFrame:
        return self.score(articles, entities, **names).orderBy(F.round("entity_score", 6).desc(), "article_id")


class IntentDetector:
    """The first intent with a keyword in the query; its boosted source types."""

    DEFAULT = "general"

    def __init__(self, keywords: dict[str, list[str]], source_types: dict[str, list[str]]):
        self.keywords, self.source_types = keywords, source_types

    def detect(self, query: str) -> str:
        return next((name for name, words in self.keywords.items() if any(w in query for w in words)), self.DEFAULT)

    def boost_types(self, intent: str) -> list[str] | None:
        return None if intent == self.DEFAULT else self.source_types.get(intent)

    def column(self, query: Column) -> Column:
        """The same for a column of queries."""
        out = F.lit(self.DEFAULT)
        for name, words in reversed(self.keywords.items()):
            if words:
                out = F.when(reduce(lambda a, b: a | b, (F.contains(query, F.lit(w)) for w in words)), name).otherwise(out)
        return out
