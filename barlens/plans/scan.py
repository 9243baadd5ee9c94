"""The full-market scan: each symbol's latest rating, bucketed and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.indicators import KEYS
from barlens.plans import replay

BUCKET_LIMITS = {"interest": 80, "wait": 60, "avoid": 40}


def watch_price_state(close: Column, watch: Column, invalidation: Column) -> Column:
    return (
        F.when(watch <= invalidation, "INVALID_WATCH_ZONE").when(watch > close, "RECOVERY_TRIGGER")
        .otherwise("WATCH_SUPPORT")
    )


def sample_note(count: Column) -> Column:
    return F.when(count < 10, "too_few").when(count < 20, "reference_only").otherwise("limited_reference")


def scan_order() -> list[Column]:
    """Grade, blocks, expected return (from 15 samples), invalidation, reward/risk, rate, value."""
    c = F.col
    rank = F.when(c("grade") == "A+", 0).when(c("grade") == "A", 1).when(c("grade") == "B", 2).when(
        c("grade") == "C", 3).when(c("grade") == "D", 4).otherwise(9)
    expected = F.when(c("sample_count") >= 15, c("expected_return_pct"))
    return [
        rank, F.size("final_blocks"), -F.coalesce(expected, F.lit(-999.0)),
        F.coalesce("invalidation_rate", F.lit(100.0)), -c("reward_risk_ratio"),
        -F.coalesce("up_rate", F.lit(-1.0)), -F.coalesce("avg_value_20", F.lit(0.0)), c("symbol"),
    ]


def latest_ratings(bars: DataFrame, proxies: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    frame = replay.pattern_frame(bars)
    last = F.col("i") == F.max("i").over(Window.partitionBy(*KEYS))
    return replay.rate(frame.withColumn("_now", last), bars, proxies, F.col("_now"), snapshots)


def scan(bars: DataFrame, proxies: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """One wide row per symbol, in scan order."""
    r = latest_ratings(bars, proxies, snapshots)
    position = F.row_number().over(Window.partitionBy("market", "final_action").orderBy(*scan_order()))
    joined = {c: F.concat_ws(" / ", c) for c in ("final_blocks", "final_risks", "reasons")}
    levels = {c: F.concat_ws(" / ", F.transform(c, lambda v: F.format_number(v, 4))) for c in ("flat_levels", "profile_levels")}
    r = r.withColumn("bucket_position", position)
    ordered = r.orderBy("market", *scan_order())
    return ordered.withColumns({**joined, **levels}).select(
        "market", "symbol", "session_date", "grade", "final_action", "bucket_position", "close",
        "watch_price", watch_price_state(F.col("close"), F.col("watch_price"), F.col("invalidation_price")).alias("watch_state"),
        "invalidation_price", "first_target_price", "reward_risk_ratio", "price_position", "tk_state", "chikou_state",
        "future_cloud", "kumo_breakout", "flat_levels", "profile_levels", "volume_ratio", "atr14", "atr14_pct",
        "candle_range_atr", "adx14", "plus_di14", "minus_di14", "avg_volume_20", "avg_value_20", "liquid",
        "final_blocks", "final_risks", "reasons", F.col("final_confidence").alias("confidence"),
        "sample_count", "up_count", "up_rate", "median_return_pct", "candidate_count", "average_up_return_pct",
        "average_down_return_pct", "invalidation_count", "invalidation_rate", "expected_return_pct", "downside_p25_pct",
        "payoff_ratio", "similarity_status", sample_note(F.col("sample_count")).alias("sample_note"),
        "higher_timeframe", "market_context", "technical_score", "context_adjusted_score",
        "environment_score", "market_score", "news_score", "event_risk",
    )


def bucket_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("market", "final_action").agg(F.count(F.lit(1)).alias("symbols"))


def bucket_lists(scanned: DataFrame) -> DataFrame:
    """The report lists: the first 80 interest, 60 wait and 40 avoid rows.

    A row with any other action fails the job: it belongs to no list."""
    limit = F.lit(None).cast("int")
    for action, rows in BUCKET_LIMITS.items():
        limit = F.when(F.col("final_action") == action, rows).otherwise(limit)
    unknown = F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("final_action", F.lit("null")))).cast("int")
    return scanned.filter(F.col("bucket_position") <= F.coalesce(limit, unknown))
