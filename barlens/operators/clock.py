"""Completeness and freshness of bars against a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlens.functions.times import CLOSE_MINUTE, ZONES, last_completed_session

MAX_SESSION_LAG_DAYS = 4
MAX_MINUTE_AGE_DAYS = 7


def _cutoff(now: Column) -> Column:
    return F.when(F.col("market") == "US", last_completed_session(now, "US")).otherwise(last_completed_session(now, "KR"))


def completed_daily(bars: DataFrame, now: Column) -> DataFrame:
    return bars.filter(F.col("session_date") <= _cutoff(now))


def daily_freshness(bars: DataFrame, now: Column) -> DataFrame:
    """Latest session per symbol and whether it is current at ``now``."""
    g = bars.groupBy("market", "symbol").agg(F.max("session_date").alias("latest"))
    today = F.when(F.col("market") == "US", F.to_date(F.from_utc_timestamp(now, ZONES["US"]))).otherwise(_cutoff(now))
    return g.withColumn("current", (F.col("latest") <= today) & (F.col("latest") >= F.date_sub(_cutoff(now), MAX_SESSION_LAG_DAYS)))


def minute_freshness(bars: DataFrame, now: Column) -> DataFrame:
    g = bars.groupBy("market", "symbol").agg(F.max("ts").alias("latest"))
    ahead = F.when(F.col("market") == "US", now + F.make_dt_interval(hours=F.lit(1))).otherwise(now)
    return g.withColumn("current", (F.col("latest") >= now - F.make_dt_interval(days=F.lit(MAX_MINUTE_AGE_DAYS))) & (F.col("latest") <= ahead))


def _local() -> Column:
    return F.when(F.col("market") == "US", F.from_utc_timestamp("ts", ZONES["US"])).otherwise(F.from_utc_timestamp("ts", ZONES["KR"]))


def regular_session(bars: DataFrame, interval: int = 60) -> DataFrame:
    """US bars wholly inside 09:30-16:00, KR bars starting in 09:00-15:30."""
    minute = F.hour(_local()) * 60 + F.minute(_local())
    us = (minute >= 570) & (minute + interval <= CLOSE_MINUTE["US"])
    kr = (minute >= 540) & (minute <= CLOSE_MINUTE["KR"])
    return bars.filter(F.when(F.col("market") == "US", us).otherwise(kr))


def completed_minutes(bars: DataFrame, now: Column, interval: int = 60) -> DataFrame:
    """Buckets whose end has passed; a KR bucket ends at 15:30 at the latest."""
    end = F.col("ts") + F.make_dt_interval(mins=F.lit(interval))
    close = F.to_utc_timestamp(F.date_trunc("day", _local()) + F.make_dt_interval(mins=F.lit(CLOSE_MINUTE["KR"])), ZONES["KR"])
    return bars.filter(F.when(F.col("market") == "US", end).otherwise(F.least(end, close)) <= now)
