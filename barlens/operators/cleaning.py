"""Admission of bar series: one corrupt row rejects the whole symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.indicators import KEYS, MIN_BARS

PRICES = ["open", "high", "low", "close"]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _usable_amount(c: Column) -> Column:
    """Unknown is fine, negative or infinite is not."""
    return c.isNull() | F.isnan(c) | ((c >= 0) & (c != F.lit(float("inf"))))


def valid_bar() -> Column:
    ok = finite(F.col("open"))
    for c in PRICES[1:]:
        ok = ok & finite(F.col(c))
    for c in PRICES:
        ok = ok & (F.col(c) > 0)
    return ok & (F.col("high") >= F.greatest(*PRICES)) & (F.col("low") <= F.least(*PRICES))


def judged(bars: DataFrame, order: str | None = None) -> DataFrame:
    """Bars plus ``reason``: null where the whole symbol is usable.

    Unknown trade value becomes close x volume, of a repeated date the last copy
    by ``order`` stays.  Without ``order`` the dates of a symbol must be unique.
    Copies of a date are combined map-side, so the per-symbol window that follows
    sees one row per session, however many copies arrived.
    """
    if "trade_value" not in bars.columns:
        bars = bars.withColumn("trade_value", F.lit(None).cast("double"))
    amounts = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("volume", "trade_value")]
    rows = bars.select(
        *KEYS, "session_date", *PRICES, *amounts, *([order] if order else []),
        (~valid_bar()).cast("int").alias("bad_price"),
        (~_usable_amount(F.col("volume"))).cast("int").alias("bad_volume"),
        (~_usable_amount(F.col("trade_value"))).cast("int").alias("bad_value"),
    )
    bad = ["bad_price", "bad_volume", "bad_value"]
    if order:
        payload = F.struct(*PRICES, "volume", "trade_value")
        rows = (
            rows.groupBy(*KEYS, "session_date")
            .agg(F.max_by(payload, order).alias("p"), *[F.sum(c).alias(c) for c in bad])
            .select(*KEYS, "session_date", "p.*", *bad)
        )
    symbol = Window.partitionBy(*KEYS)
    totals = {f"{c}_rows": F.sum(c).over(symbol) for c in bad}
    rows = rows.withColumns({**totals, "sessions": F.count(F.lit(1)).over(symbol)})
    reason = (
        F.when(F.col("bad_price_rows") > 0, "invalid_prices")
        .when(F.col("bad_volume_rows") > 0, "invalid_volume")
        .when(F.col("bad_value_rows") > 0, "invalid_trade_value")
        .when(F.col("sessions") < MIN_BARS, "too_few_sessions")
    )
    value = F.coalesce("trade_value", F.col("close") * F.col("volume"))
    return rows.withColumns({"reason": reason, "trade_value": value}).drop(*bad)


def clean_bars(bars: DataFrame, order: str | None = None) -> DataFrame:
    """Bars of the admitted symbols only."""
    return judged(bars, order).filter(F.col("reason").isNull()).select(
        *KEYS, "session_date", *PRICES, "volume", "trade_value"
    )


def rejections(bars: DataFrame, order: str | None = None) -> DataFrame:
    """One row per refused symbol: the first failing rule and the bad row counts."""
    return judged(bars, order).filter(F.col("reason").isNotNull()).groupBy(*KEYS, "reason").agg(
        *[F.max(c).alias(c) for c in ("bad_price_rows", "bad_volume_rows", "bad_value_rows", "sessions")]
    )


# ---- provider rows -----------------------------------------------------------


def number(text: Column, absolute: bool = False) -> Column:
    """Text to a finite number; thousands separators allowed, anything else null."""
    value = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    value = F.when(finite(value), value)
    return F.abs(value) if absolute else value


RECORD = "dt string, open_pric string, high_pric string, low_pric string, cur_prc string, acc_trde_qty string, acc_trde_prica string"


def provider_category() -> Column:
    """Why a parsed provider bar is blocked: null, MALFORMED or CORPORATE_ACTION_SUSPECTED."""
    missing = F.col("session_date").isNull()
    for c in PRICES:
        missing = missing | F.col(c).isNull() | (F.col(c) <= 0)
    top, bottom = F.greatest(*PRICES), F.least(*PRICES)
    broken = (F.col("high") < top) | (F.col("low") > bottom)
    return (
        F.when(missing, "MALFORMED")
        .when(broken & (top / bottom >= 1.5), "CORPORATE_ACTION_SUSPECTED")
        .when(broken, "MALFORMED")
    )


def parse_provider_records(records: DataFrame) -> DataFrame:
    """records(market, symbol, record JSON, position) to typed bars with a category."""
    r = records.withColumn("r", F.from_json("record", RECORD))
    return r.select(
        *KEYS, "position",
        F.to_date(F.try_to_timestamp(F.col("r.dt"), F.lit("yyyyMMdd"))).alias("session_date"),
        number(F.col("r.open_pric"), True).alias("open"),
        number(F.col("r.high_pric"), True).alias("high"),
        number(F.col("r.low_pric"), True).alias("low"),
        number(F.col("r.cur_prc"), True).alias("close"),
        number(F.col("r.acc_trde_qty"), True).alias("volume"),
        number(F.col("r.acc_trde_prica"), True).alias("trade_value"),
    ).withColumn("category", provider_category())


def provider_bars(records: DataFrame) -> DataFrame:
    """Daily bars of a provider: the first record of a date wins, blocked records leave.

    US: unknown volume is 0 and unknown value is close x volume.  KR: unknown
    volume stays unknown and value is always close x volume.
    """
    parsed = parse_provider_records(records).filter(F.col("category").isNull())
    first = parsed.groupBy(*KEYS, "session_date").agg(
        F.min_by(F.struct(*PRICES, "volume", "trade_value"), "position").alias("p")
    ).select(*KEYS, "session_date", "p.*")
    us = F.col("market") == "US"
    volume = F.when(us, F.coalesce("volume", F.lit(0.0))).otherwise(F.col("volume"))
    first = first.withColumn("volume", volume)
    derived = F.col("close") * F.col("volume")
    return first.withColumn("trade_value", F.when(us, F.coalesce("trade_value", derived)).otherwise(derived))
