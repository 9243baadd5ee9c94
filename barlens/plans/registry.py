"""All named queries in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlens.plans import catalog_bars, catalog_data, catalog_events, shared
from barlens.operators import rules
from barlens.session import prepare


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol stands today: latest level-free rating per symbol."""
    prepare(spark)
    df = rules.complete_rows(shared.frame(spark, sf_dir))
    df = df.withColumn("_last", F.max("i").over(Window.partitionBy("market", "symbol")))
    return df.filter(F.col("i") == F.col("_last")).select(
        "market", "symbol", "session_date", "close", "price_position", "tk_state", "kijun_slope", "chikou_state",
        "future_cloud", "kumo_breakout", "grade", "bullish_score", "bearish_score", "base_blocks", "base_risks")


def _ready(run: Callable) -> Callable:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)
    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {**catalog_bars.QUERIES, **catalog_events.QUERIES, **catalog_data.QUERIES}
    return {name: _ready(run) for name, run in named.items()}
