"""Intermediate tables several queries read, derived once per session and folder.

Bars are one row per symbol and day, far smaller than the trades they come from;
they are kept with MEMORY_AND_DISK, so a lost executor recomputes its partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlens.operators import environment, evaluation, outcomes as oc, rules
from barlens.operators.cleaning import clean_bars
from barlens.plans import replay
from barlens.session import prepare
from barlens.sources import driver_tables as tables

_KEPT: dict[tuple, DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        prepare(spark)
        _KEPT[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _KEPT[key]


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "raw_bars", lambda: tables.daily_bars(spark, sf_dir))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "bars", lambda: clean_bars(raw_bars(spark, sf_dir)))


def proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "proxies", lambda: clean_bars(tables.proxy_bars(spark, sf_dir)))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator, state, feature, label, grid flag and forward path per bar."""
    def build() -> DataFrame:
        df = oc.forward_paths(oc.decision_grid(replay.pattern_frame(bars(spark, sf_dir))))
        return rules.level_free_rating(df)
    return keep(spark, sf_dir, "frame", build)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "snapshots", lambda: environment.with_environment(
        tables.intelligence_rows(spark, sf_dir)))


def plain_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-free signals: points as score, the research level as invalidation price."""
    def build() -> DataFrame:
        df = rules.complete_rows(frame(spark, sf_dir)).filter(F.col("on_grid"))
        score = (F.col("bullish_score") - F.col("bearish_score"))
        action = F.when(F.col("grade") == "A+", "interest").when(F.col("grade").isin("A", "B"), "wait").otherwise("avoid")
        df = df.select(
            "market", "symbol", F.col("session_date").alias("as_of"), "grade", action.alias("action"),
            score.alias("technical_score"), (score * 2 - F.size("base_blocks")).alias("context_adjusted_score"),
            "research_invalidation_price", "paths")
        return evaluation.with_split(df, evaluation.split_dates(df))
    return keep(spark, sf_dir, "plain_signals", build)


def plain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "plain_outcomes", lambda: oc.outcomes(
        plain_signals(spark, sf_dir), "research_invalidation_price"))


def full_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        sig = replay.signals(bars(spark, sf_dir), proxies(spark, sf_dir), snapshots=snapshots(spark, sf_dir))
        return evaluation.with_split(sig, evaluation.split_dates(sig.select("as_of")))
    return keep(spark, sf_dir, "full_signals", build)


def full_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "full_outcomes", lambda: oc.outcomes(
        full_signals(spark, sf_dir), "invalidation_price"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared events; not kept, so that every query derives only the columns it reads."""
    from barlens.operators.events import prepared_events
    return prepared_events(tables.news_items(prepare(spark), sf_dir))
