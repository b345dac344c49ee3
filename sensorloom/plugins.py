"""Extension points: support modules, detectors and feeds supplied by a user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorloom.operators.rules import support_stack

KINDS = ("modulator", "detector", "screen", "explainer")
FEED_COLUMNS = ("site", "variable", "us", "value")
SCORE_COLUMNS = ("site", "variable", "rule", "step", "score", "threshold", "base")


class Registry:
    """Support modules by name and kind, and detectors held to the score contract."""

    def __init__(self) -> None:
        self.modules: dict[str, tuple[str, Callable]] = {}
        self.detectors: dict[str, Callable[..., DataFrame]] = {}
        self.nulls: dict[str, Callable[[Column], Column]] = {}
        self.feeds: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def module(self, name: str, kind: str, make: Callable) -> None:
        """A modulator returns a multiplier column, a detector a boolean vote, a screen a boolean to
        admit, an explainer a DataFrame from a DataFrame."""
        if kind not in KINDS:
            raise ValueError(f"{name}: kind must be one of {', '.join(KINDS)}, got {kind!r}")
        if name in self.modules:
            raise ValueError(f"a support module named {name!r} is already registered")
        self.modules[name] = (kind, make)

    def of(self, kind: str) -> dict[str, Callable]:
        return {n: make for n, (k, make) in self.modules.items() if k == kind}

    def detector(self, name: str, scores: Callable[..., DataFrame]) -> None:
        if name in self.detectors:
            raise ValueError(f"a detector named {name!r} is already registered")
        self.detectors[name] = scores

    def scores(self, name: str, *tables: DataFrame) -> DataFrame:
        out = self.detectors[name](*tables)
        absent = [c for c in SCORE_COLUMNS if c not in out.columns]
        if absent:
            raise ValueError(f"{name} returned no column {', '.join(absent)}")
        return out.select(*SCORE_COLUMNS)

    def decide(self, rows: DataFrame, base: Column) -> DataFrame:
        """Screens admit first, then modulators and detectors decide together."""
        for admit in self.of("screen").values():
            rows = rows.where(admit())
        return support_stack(
            rows, base, {n: m() for n, m in self.of("modulator").items()}, {n: d() for n, d in self.of("detector").items()}
        )

    def null(self, name: str, to_pvalue: Callable[[Column], Column]) -> None:
        """The null a detector's raw scores are judged against: from a score column to a p-value column."""
        if name in self.nulls:
            raise ValueError(f"a null named {name!r} is already registered")
        self.nulls[name] = to_pvalue

    def pvalues(self, name: str, rows: DataFrame, score: str) -> DataFrame:
        """Add ``p``; a score that could not be computed has none."""
        value = F.col(score)
        return rows.withColumn("p", F.when(value.isNotNull() & ~F.isnan(value), self.nulls[name](value)))

    def feed(self, name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
        """A source of readings: from a session and a URI to a frame with site, variable, us, value."""
        if name in self.feeds:
            raise ValueError(f"a feed named {name!r} is already registered")
        self.feeds[name] = read

    def readings(self, name: str, spark: SparkSession, uri: str) -> DataFrame:
        out = self.feeds[name](spark, uri)
        absent = [c for c in FEED_COLUMNS if c not in out.columns]
        if absent:
            raise ValueError(f"{name} returned no column {', '.join(absent)}")
        return out.select(*FEED_COLUMNS)
