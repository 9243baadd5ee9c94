"""Higher timeframe, market direction, liquidity and environment around a rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.indicators import KEYS
from barlens.operators.rules import grades

# Default gates: average value and volume of the last 20 sessions, US then KR.
MIN_VALUE = {"US": 20_000_000.0, "KR": 5_000_000_000.0}
MIN_VOLUME = {"US": 200_000.0, "KR": 100_000.0}
FIRST_PROXY = ("SPY", "KOSPI")


# ---- weekly -----------------------------------------------------------------------


def week_end(day: Column) -> Column:
    """The Friday a session belongs to."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Friday-labelled bars; a week counts once its Friday is not after the last session."""
    weekly = bars.groupBy(*KEYS, week_end(F.col("session_date")).alias("week")).agg(
        F.min_by("open", "session_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "session_date").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum("trade_value"), F.lit(0.0)).alias("trade_value"),
        F.max("session_date").alias("last_session"),
    )
    last = F.max("last_session").over(Window.partitionBy(*KEYS))
    return weekly.withColumn("_last", last).filter(F.col("week") <= F.col("_last")).select(
        *KEYS, F.col("week").alias("session_date"), "open", "high", "low", "close", "volume", "trade_value"
    )


def weekly_direction(bars: DataFrame) -> DataFrame:
    """(market, symbol, week, weekly_direction) for weeks with 80 weeks of history."""
    strong = F.col("grade").isin("A+", "A") & (F.col("price_position") == "above")
    weak = (F.col("price_position") == "below") | (F.col("grade") == "D")
    return grades(weekly_bars(bars)).select(
        *KEYS, F.col("session_date").alias("week"),
        F.when(strong, "up").when(weak, "down").otherwise("unclear").alias("weekly_direction"),
    )


def _label(day: Column) -> Column:
    return F.datediff(week_end(day), F.lit("1970-01-01").cast("date"))


def completed_week(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Add ``week``: the newest Friday label known at each daily row.

    On its Friday a week is complete; before that the newest earlier week with
    sessions counts.  Weeks come from ``bars``, whatever rows are asked for.
    """
    by_week = Window.partitionBy(*KEYS).orderBy("_label")
    weeks = bars.select(*KEYS, _label(F.col("session_date")).alias("_label")).distinct().withColumn("_before", F.lag("_label").over(by_week))
    rows = rows.withColumn("_label", _label(F.col("session_date"))).join(weeks, [*KEYS, "_label"], "left")
    own = F.dayofweek("session_date") == 6
    number = F.when(own, F.col("_label")).otherwise(F.col("_before"))
    return rows.withColumn("week", F.date_add(F.lit("1970-01-01").cast("date"), number)).drop("_label", "_before")


def with_weekly(rows: DataFrame, bars: DataFrame) -> DataFrame:
    return completed_week(rows, bars).join(weekly_direction(bars), [*KEYS, "week"], "left").drop("week")


# ---- market direction ------------------------------------------------------------------


def proxy_stance() -> Column:
    strong = F.col("grade").isin("A+", "A") & (F.col("price_position") == "above")
    weak = (F.col("price_position") == "below") | (F.col("grade") == "D")
    return F.when(strong, "strong").when(weak, "weak").otherwise("neutral")


def vote(first: Column, second: Column) -> Column:
    return (
        F.when(first.isNull() | second.isNull(), "unknown")
        .when((first == "strong") & (second == "strong"), "both_up")
        .when((first == "weak") & (second == "weak"), "both_weak")
        .otherwise("mixed")
    )


def market_context(proxy_bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(market, session_date, market_context) on every session of ``sessions``.

    The newest rating of each proxy at or before the date counts.  The window
    holds one row per calendar day of a market.
    """
    side = F.col("symbol").isin(*FIRST_PROXY)
    stance = proxy_stance()
    rated = grades(proxy_bars).groupBy("market", "session_date").agg(
        F.max(F.when(side, stance)).alias("a"), F.max(F.when(~side, stance)).alias("b")
    )
    days = sessions.select("market", "session_date").distinct()
    timeline = rated.join(days.withColumn("wanted", F.lit(True)), ["market", "session_date"], "full_outer")
    so_far = Window.partitionBy("market").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    timeline = timeline.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("a", "b")})
    return timeline.filter(F.col("wanted")).select(
        "market", "session_date", vote(F.col("a"), F.col("b")).alias("market_context")
    )


# ---- gates ----------------------------------------------------------------------------


def _threshold(by_market: dict[str, float]) -> Column:
    return F.when(F.col("market") == "US", by_market["US"]).otherwise(by_market["KR"])


def liquidity_reason(ignore_value: bool = False, ignore_volume: bool = False) -> Column:
    """Null when liquid; value is judged before volume."""
    low_value = F.col("avg_value_20").isNull() | (F.col("avg_value_20") < _threshold(MIN_VALUE))
    low_volume = F.col("avg_volume_20").isNull() | (F.col("avg_volume_20") < _threshold(MIN_VOLUME))
    if ignore_value:
        low_value = F.lit(False)
    if ignore_volume:
        low_volume = F.lit(False)
    return F.when(low_value, "low_trade_value").when(low_volume, "low_volume")


def context_codes(weekly: Column, label: Column) -> tuple[Column, Column]:
    """(blocks, risks) the weekly and market gates add.

    US: anything but two rising proxies blocks.  KR: a mixed market is a risk only.
    """
    us = F.col("market") == "US"
    missing, down = weekly.isNull(), weekly == "down"
    weak, unknown, aligned = label == "both_weak", label == "unknown", label == "both_up"
    blocks = F.array_compact(F.array(
        F.when(missing, "weekly_missing").when(down, "weekly_down"),
        F.when(weak, "market_weak").when(unknown | (us & ~aligned), "market_unconfirmed"),
    ))
    risks = F.array_compact(F.array(
        F.when(missing, "weekly_missing").when(down, "weekly_down").when(weekly == "unclear", "weekly_unclear"),
        F.when(weak, "market_weak").when(unknown, "market_unconfirmed").when(~aligned, "market_mixed"),
    ))
    return blocks, risks


def gated(grade: Column, confidence: Column, action: Column, n_blocks: Column, weekly: Column,
          label: Column, reason: Column) -> dict[str, Column]:
    """Confidence, action and block count after the weekly, market and liquidity gates."""
    blocks, risks = context_codes(weekly, label)
    total = n_blocks + F.size(blocks)
    upper = grade.isin("A+", "A", "B")
    kr_mixed = (F.col("market") == "KR") & (label == "mixed")
    act = F.when(upper & ((total > 0) | kr_mixed), "wait").otherwise(action)
    conf = F.when((confidence == "high") & ((total > 0) | (F.size(risks) > 0)), "medium").otherwise(confidence)
    illiquid = reason.isNotNull()
    return {
        "action": F.when(illiquid, "avoid").otherwise(act),
        "confidence": F.when(illiquid & (conf == "high"), "medium").otherwise(conf),
        "n_blocks": total + illiquid.cast("int"),
    }


def technical_score(grade: Column, confidence: Column, n_blocks: Column) -> Column:
    base = (
        F.when(grade == "A+", 90).when(grade == "A", 80).when(grade == "B", 65)
        .when(grade == "C", 45).when(grade == "D", 25).otherwise(50)
    )
    shift = F.when(confidence == "high", 5).when(confidence == "low", -5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + shift - F.least(F.lit(20), n_blocks * 6)))


def adjusted_score(technical: Column, environment: Column) -> Column:
    blended = F.rint(technical * 0.65 + environment * 0.35).cast("int")
    return F.when(environment.isNull(), technical).otherwise(blended)


def final_action(action: Column, environment: Column, event_risk: Column) -> Column:
    stopped = environment.isNotNull() & ((event_risk >= 75) | (environment < 42))
    return F.when((action == "interest") & stopped, "wait").otherwise(action)


def contextual(rated: DataFrame) -> DataFrame:
    """Final rating of rows carrying weekly_direction, market_context and, when known,
    environment_score and event_risk."""
    weekly, label = F.col("weekly_direction"), F.col("market_context")
    rated = rated.withColumn("liquidity_reason", liquidity_reason())
    reason = F.col("liquidity_reason")
    blocks, risks = context_codes(weekly, label)
    gate = gated(F.col("grade"), F.col("confidence"), F.col("action"), F.size("blocks"), weekly, label, reason)
    extra = F.array_compact(F.array(reason))
    rated = rated.withColumns({
        "final_blocks": F.array_distinct(F.concat("blocks", blocks, extra)),
        "final_risks": F.array_distinct(F.concat("risks", risks, extra)),
        "final_confidence": gate["confidence"],
        "context_action": gate["action"],
        "higher_timeframe": F.coalesce(weekly, F.lit("unknown")),
        "liquid": reason.isNull(),
    })
    score = technical_score(F.col("grade"), F.col("final_confidence"), F.size("final_blocks"))
    rated = rated.withColumns({
        "final_risk_score": F.size("final_risks") + F.size("final_blocks") * 2,
        "technical_score": score,
        "final_action": final_action(F.col("context_action"), F.col("environment_score"), F.col("event_risk")),
    })
    return rated.withColumn("context_adjusted_score", adjusted_score(F.col("technical_score"), F.col("environment_score")))
