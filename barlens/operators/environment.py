"""Environment scores: market metrics, headline sentiment, event risk and their blend."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column) -> Column:
    return F.rint(value).cast("int")


def combine(market: Column, news: Column, risk: Column) -> Column:
    """Weighted mean of the known parts (55 market, 25 news, 20 calm); 50 when none is known."""
    parts = [(market, 0.55), (news, 0.25), (100.0 - risk, 0.20)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        total = total + F.when(value.isNotNull(), value * w).otherwise(0.0)
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight == 0, 50).otherwise(half_even(total / F.when(weight != 0, weight)))


def label(score: Column, known: Column) -> Column:
    return (
        F.when(~known, "no_info").when(score >= 72, "very_favourable").when(score >= 60, "favourable")
        .when(score >= 45, "neutral").when(score >= 35, "burden").otherwise("heavy_burden")
    )


def with_environment(df: DataFrame) -> DataFrame:
    """Add environment_score and its label from market_score, news_score, event_risk."""
    m, n, r = F.col("market_score"), F.col("news_score"), F.col("event_risk")
    known = m.isNotNull() | n.isNotNull() | r.isNotNull()
    df = df.withColumn("environment_score", combine(m, n, r))
    return df.withColumn("environment_label", label(F.col("environment_score"), known))


def metric_changes(series: DataFrame, keys: list[str], day: str, close: str) -> DataFrame:
    """1-row and 5-row percent change of the newest value per series (oldest row if shorter).

    Needs two rows; only the newest six survive the rank filter before any shuffle of size.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    recent = series.filter(F.col(close).isNotNull()).withColumn("_r", F.row_number().over(newest)).filter("_r <= 6")
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(close)))
    g = recent.groupBy(*keys).agg(
        at(1).alias("latest"), at(2).alias("_one"),
        F.max_by(close, "_r").alias("_five"), F.count(F.lit(1)).alias("_n"),
    ).filter("_n >= 2")

    def change(base: str) -> Column:
        return F.when(F.col(base) == 0, 0.0).otherwise((F.col("latest") / F.col(base) - 1.0) * 100.0)

    return g.withColumns({"change_1d_pct": change("_one"), "change_5d_pct": change("_five")}).drop("_one", "_five", "_n")


def metric_contributions(changes: DataFrame) -> DataFrame:
    """Needs direction, scale1, scale5, weight: the signed, clipped blend and its signal."""
    part = F.col("direction") * (
        0.65 * clip(F.col("change_1d_pct") / F.col("scale1"), -1.0, 1.0)
        + 0.35 * clip(F.col("change_5d_pct") / F.col("scale5"), -1.0, 1.0)
    )
    df = changes.withColumn("_c", part)
    return df.withColumns({
        "signal": F.when(F.col("_c") >= 0.18, "supportive").when(F.col("_c") <= -0.18, "burden").otherwise("neutral"),
        "contribution": F.col("_c") * F.col("weight"),
    }).drop("_c")


def market_score(metrics: DataFrame, keys: list[str]) -> DataFrame:
    g = metrics.groupBy(*keys).agg(F.sum("contribution").alias("_c"), F.sum("weight").alias("_w"))
    weighted = F.col("_c") / F.greatest(F.lit(1.0), F.col("_w"))
    return g.select(*keys, half_even(clip(50.0 + weighted * 34.0, 0.0, 100.0)).alias("market_score"))


def news_score() -> Column:
    """Aggregate over items with a ``sentiment``; 50 when there is none."""
    return F.coalesce(half_even(clip(50.0 + F.avg("sentiment") * 32.0, 0.0, 100.0)), F.lit(50))


def event_risk() -> Column:
    """Aggregate over items with a ``risk``; 15 when there is none."""
    n = F.count("risk")
    volume = F.least(F.lit(1.0), F.log1p(n) / math.log(13.0))
    value = 10.0 + 45.0 * F.avg("risk") + 30.0 * F.max("risk") + 10.0 * volume
    return F.coalesce(half_even(clip(value, 0.0, 100.0)), F.lit(15))


def blended_news(stock: Column, base: Column) -> Column:
    """Stock news counts 70 %, market news 30 %; whichever is known alone counts in full."""
    return F.coalesce(half_even(stock * 0.7 + base * 0.3), stock, base)


def visible_intelligence(signals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Attach the symbol's snapshot of the day, else the market-wide one.

    The choice comes first: a symbol snapshot generated after the close is
    dropped and does not fall back to the market-wide row.
    """
    fields = ["market_score", "news_score", "event_risk", "environment_score", "generated_at"]
    row = F.struct(*fields)
    own = snapshots.filter(F.col("symbol") != "*").select(
        "market", "symbol", F.col("as_of").alias("session_date"), row.alias("_own"))
    wide = snapshots.filter(F.col("symbol") == "*").select(
        "market", F.col("as_of").alias("session_date"), row.alias("_wide"))
    df = signals.join(own, ["market", "symbol", "session_date"], "left").join(wide, ["market", "session_date"], "left")
    df = df.withColumn("_snap", F.coalesce("_own", "_wide"))
    day = F.col("session_date").cast("timestamp")
    cutoff = F.when(
        F.col("market") == "US", F.to_utc_timestamp(day + F.make_dt_interval(hours=F.lit(16)), "America/New_York")
    ).otherwise(F.to_utc_timestamp(day + F.make_dt_interval(hours=F.lit(15), mins=F.lit(30)), "Asia/Seoul"))
    usable = F.col("_snap.generated_at") <= cutoff
    return df.select(
        *signals.columns, *[F.when(usable, F.col(f"_snap.{f}")).alias(f) for f in fields]
    )
