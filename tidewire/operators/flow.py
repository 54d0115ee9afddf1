"""Configurable article flow: an ordered list of frame-to-frame stages with row counts per stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewire.functions import predicates as pr
from tidewire.functions import scores as sc
from tidewire.functions import text as tx
from tidewire.operators import extraction as ex

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FlowConfig:
    """Which stages run, and their thresholds."""

    stages: tuple[str, ...] = ("defaults", "normalise", "language", "validate", "classify", "sentiment", "keywords", "quality")
    min_quality: float = 0.45
    keyword_count: int = 10


@dataclass
class Registry:
    """Named column transformers and validators that callers add to a flow."""

    transformers: dict[str, dict[str, Callable[[], Column]]] = field(default_factory=dict)
    validators: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def transformer(self, name: str, **columns: Callable[[], Column]) -> None:
        self.transformers[name] = columns

    def validator(self, name: str, rule: Callable[[], Column]) -> None:
        self.validators[name] = rule

    def apply(self, df: DataFrame) -> DataFrame:
        """All transformers in order, then ``failed``: the names of the validators a row does not pass."""
        for columns in self.transformers.values():
            df = df.withColumns({name: make() for name, make in columns.items()})
        failed = [F.when(~F.coalesce(rule(), F.lit(False)), F.lit(name)) for name, rule in self.validators.items()]
        return df.withColumn("failed", F.filter(F.array(*failed, F.lit(None).cast("string")), lambda f: f.isNotNull()))


def builtin_stages(config: FlowConfig) -> dict[str, Stage]:
    title, body, summary, url = (F.col(c) for c in ("title", "content", "summary", "url"))

    def valid(df: DataFrame) -> DataFrame:
        return df.filter(pr.valid_crawled(title, url, body, summary))

    def quality(df: DataFrame) -> DataFrame:
        return df.withColumn("quality", F.round(sc.article_quality(title, body, summary), 6)).filter(F.col("quality") >= config.min_quality)

    def classify(df: DataFrame) -> DataFrame:
        c = sc.keyword_category(sc.category_hits(F.concat_ws(" ", title, body)))
        return df.withColumn("__c", c).withColumns({"category": F.col("__c.category"), "category_confidence": F.col("__c.confidence")}).drop("__c")

    return {
        "defaults": ex.with_defaults,
        "normalise": lambda df: df.withColumns({"title": tx.squeeze(title), "summary": tx.squeeze(summary)}),
        "language": lambda df: df.withColumn("detected", tx.language_label(tx.language_scores(body))),
        "validate": valid,
        "classify": classify,
        "sentiment": lambda df: df.withColumn("sentiment", sc.sentiment_multilingual(body)),
        "keywords": lambda df: df.withColumn("keywords", ex.keywords(body, config.keyword_count)),
        "quality": quality,
    }


class Flow:
    """``run`` gives one lazy plan; ``report`` has the rows after each stage once an action ran."""

    def __init__(self, config: FlowConfig = FlowConfig(), extra: dict[str, Stage] | None = None):
        self.config = config
        self.stages = {**builtin_stages(config), **(extra or {})}
        unknown = set(config.stages) - set(self.stages)
        if unknown:
            raise ValueError(f"unknown stages {sorted(unknown)}")
        self.observed: list[tuple[str, Observation]] = []

    def run(self, df: DataFrame) -> DataFrame:
        self.observed = []
        df = self._watch(df, "input")
        for name in self.config.stages:
            df = self._watch(df.transform(self.stages[name]), name)
        return df

    def _watch(self, df: DataFrame, name: str) -> DataFrame:
        seen = Observation(name)
        self.observed.append((name, seen))
        return df.observe(seen, F.count("*").alias("rows"))

    def report(self, spark) -> DataFrame:
        """(stage, position, rows_out, dropped) of the last run; one row per stage."""
        rows, before = [], None
        for i, (name, seen) in enumerate(self.observed):
            n = seen.get["rows"]
            rows.append((name, i, n, 0 if before is None else before - n))
            before = n
        return spark.createDataFrame(rows, "stage string, position int, rows_out bigint, dropped bigint")
