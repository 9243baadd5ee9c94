"""Row-aligned indicators of a bar series (cloud, volatility, trend, momentum).

Every window is partitioned by (market, symbol); a series has one row per
session, so a partition is bounded by the calendar.  After ``number_rows`` all
windows order by (blk, session_date), which is the date order, so that one
exchange and one sort feed them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.smoothing import BLOCK, wilder

KEYS = ["market", "symbol"]
SHIFT = 26
MIN_BARS = 80


def series() -> Window:
    """The date order of a series (blocks are consecutive dates)."""
    return Window.partitionBy(*KEYS).orderBy("blk", "session_date")



FEATURES = [
    "rsi14", "close_sma5_pct", "close_sma20_pct", "close_sma60_pct", "sma5_sma20_pct",
    "sma20_sma60_pct", "return5_pct", "return20_pct", "price_kijun_pct", "tenkan_kijun_pct",
    "price_cloud_top_pct", "cloud_width_pct", "volume_ratio", "candle_range_pct", "atr14_pct",
    "adx14", "di_spread14",
]
STATES = ["price_position", "future_cloud", "tk_structure", "kijun_slope", "chikou_state"]


def pct(left: Column, right: Column) -> Column:
    return (left / F.nullif(right, F.lit(0.0)) - 1.0) * 100.0


def back(n: int) -> Window:
    """The last ``n`` rows including the current one."""
    return series().rowsBetween(-(n - 1), 0)


def number_rows(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    by_date = Window.partitionBy(*KEYS).orderBy("session_date")
    return bars.withColumn("i", (F.row_number().over(by_date) - 1).cast("int")).withColumn(
        "blk", F.floor(F.col("i") / block).cast("int")
    )


def _midpoint(n: int) -> Column:
    full = F.col("i") >= n - 1
    return F.when(full, (F.max("high").over(back(n)) + F.min("low").over(back(n))) / 2.0)


def cloud(numbered: DataFrame) -> DataFrame:
    """Conversion and base line, leading spans and the displaced cloud."""
    df = numbered.withColumns({"tenkan": _midpoint(9), "kijun": _midpoint(26), "span_b": _midpoint(52)})
    df = df.withColumn("span_a", (F.col("tenkan") + F.col("kijun")) / 2.0)
    df = df.withColumns({c: F.lag(s, SHIFT).over(series()) for c, s in (("cloud_a", "span_a"), ("cloud_b", "span_b"))})
    # greatest/least skip nulls: a half-built cloud counts, as in a row-wise max.
    return df.withColumns({
        "cloud_top": F.greatest("cloud_a", "cloud_b"),
        "cloud_bottom": F.least("cloud_a", "cloud_b"),
    })


def liquidity(df: DataFrame) -> DataFrame:
    """Average volume and value of the 20 rows before this one, and the volume ratio."""
    prior = series().rowsBetween(-20, -1)

    def mean(c: str) -> Column:
        return F.when(F.count(c).over(prior) >= 10, F.avg(c).over(prior))

    df = df.withColumns({"avg_volume_20": mean("volume"), "avg_value_20": mean("trade_value")})
    return df.withColumn("volume_ratio", F.col("volume") / F.nullif(F.col("avg_volume_20"), F.lit(0.0)))


def previous(df: DataFrame) -> DataFrame:
    return df.withColumns({f"prev_{c}": F.lag(c, 1).over(series()) for c in ("high", "low", "close")})


def movement(df: DataFrame) -> DataFrame:
    """True range and directional movement of each row (needs ``previous``)."""
    up = F.col("high") - F.col("prev_high")
    down = F.col("prev_low") - F.col("low")
    return df.withColumns({
        "true_range": F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col("prev_close")),
            F.abs(F.col("low") - F.col("prev_close")),
        ),
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })


def trend(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """ATR, RSI inputs, +DI/-DI, ADX (needs ``movement``)."""
    delta = F.col("close") - F.col("prev_close")
    df = wilder(df, KEYS, {
        "atr14": (F.col("true_range"), 0),
        "_pdm": (F.col("plus_dm"), 0),
        "_mdm": (F.col("minus_dm"), 0),
        "_gain": (F.greatest(delta, F.lit(0.0)), 1),
        "_loss": (F.greatest(-delta, F.lit(0.0)), 1),
    }, block)
    atr = F.col("atr14")

    def di(smoothed: str) -> Column:
        return F.when(atr == 0, 0.0).otherwise(100.0 * F.col(smoothed) / atr)

    df = df.withColumns({"plus_di14": di("_pdm"), "minus_di14": di("_mdm")})
    total = F.col("plus_di14") + F.col("minus_di14")
    df = df.withColumn("dx", F.when(total == 0, 0.0).otherwise(
        100.0 * F.abs(F.col("plus_di14") - F.col("minus_di14")) / total))
    df = wilder(df, KEYS, {"adx14": (F.col("dx"), 13)}, block)
    gain, loss = F.col("_gain"), F.col("_loss")
    rsi = (
        F.when((gain == 0) & (loss == 0), 50.0)
        .when((gain == 0) & (loss > 0), 0.0)
        .when((loss == 0) & (gain > 0), 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    )
    return df.withColumn("rsi14", F.when(gain.isNotNull(), rsi)).drop("_pdm", "_mdm", "_gain", "_loss")


def indicator_frame(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """All base indicators of cleaned bars (see ``cleaning.clean_bars``)."""
    return trend(movement(previous(liquidity(cloud(number_rows(bars, block))))), block)


def averages(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"sma{n}": F.when(F.col("i") >= n - 1, F.avg("close").over(back(n))) for n in (5, 20, 60)
    })


def momentum(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"return{n}_pct": (F.col("close") / F.lag("close", n).over(series()) - 1.0) * 100.0 for n in (5, 20)
    })


def slope_class(df: DataFrame) -> DataFrame:
    """Base-line slope over five rows, flat within 0.15 %."""
    change = (F.col("kijun") / F.lag("kijun", 5).over(series()) - 1.0) * 100.0
    return df.withColumn("_slope", change).withColumn(
        "kijun_slope",
        F.when(F.col("_slope") > 0.15, "rising").when(F.col("_slope") < -0.15, "falling").otherwise("flat"),
    ).drop("_slope")


def lagging_state(df: DataFrame) -> DataFrame:
    """Current close against the bar and the cloud 26 rows ago; no cloud then counts as passed."""
    df = df.withColumns({
        f"_then_{c}": F.lag(c, SHIFT).over(series()) for c in ("high", "close", "cloud_top", "cloud_bottom")
    })
    close, top, bottom = F.col("close"), F.col("_then_cloud_top"), F.col("_then_cloud_bottom")
    state = (
        F.when((close > F.col("_then_high")) & (top.isNull() | (close > top)), "strong")
        .when(close > F.col("_then_close"), "partial")
        .when((close < F.col("_then_close")) & (bottom.isNull() | (close < bottom)), "weak")
        .otherwise("mixed")
    )
    return df.withColumn("chikou_state", state).drop(*[c for c in df.columns if c.startswith("_then_")])


def state_columns(df: DataFrame) -> DataFrame:
    close = F.col("close")
    df = df.withColumns({
        "price_position": F.when(close > F.col("cloud_top"), "above")
        .when(close < F.col("cloud_bottom"), "below").otherwise("inside"),
        "future_cloud": F.when(F.col("span_a") > F.col("span_b"), "bullish")
        .when(F.col("span_a") < F.col("span_b"), "bearish").otherwise("neutral"),
        "tk_structure": F.when(F.col("tenkan") > F.col("kijun"), "tenkan_above")
        .when(F.col("tenkan") < F.col("kijun"), "tenkan_below").otherwise("equal"),
    })
    return lagging_state(slope_class(df))


def feature_columns(df: DataFrame) -> DataFrame:
    """The 17 comparison features, blank for the first 79 rows of a series."""
    df = momentum(averages(df))
    c = F.col
    raw = {
        "rsi14": c("rsi14"),
        "close_sma5_pct": pct(c("close"), c("sma5")),
        "close_sma20_pct": pct(c("close"), c("sma20")),
        "close_sma60_pct": pct(c("close"), c("sma60")),
        "sma5_sma20_pct": pct(c("sma5"), c("sma20")),
        "sma20_sma60_pct": pct(c("sma20"), c("sma60")),
        "return5_pct": c("return5_pct"),
        "return20_pct": c("return20_pct"),
        "price_kijun_pct": pct(c("close"), c("kijun")),
        "tenkan_kijun_pct": pct(c("tenkan"), c("kijun")),
        "price_cloud_top_pct": pct(c("close"), c("cloud_top")),
        "cloud_width_pct": (c("cloud_top") - c("cloud_bottom")) / F.nullif(c("close"), F.lit(0.0)) * 100.0,
        "volume_ratio": c("volume_ratio"),
        "candle_range_pct": (c("high") - c("low")) / F.nullif(c("close"), F.lit(0.0)) * 100.0,
        "atr14_pct": c("atr14") / F.nullif(c("close"), F.lit(0.0)) * 100.0,
        "adx14": c("adx14"),
        "di_spread14": c("plus_di14") - c("minus_di14"),
    }
    return df.withColumns({f"f_{name}": F.when(c("i") >= MIN_BARS - 1, e) for name, e in raw.items()})


def research_invalidation(df: DataFrame) -> DataFrame:
    """A simple level for the pattern labels: nearest line below the close, less 1 %."""
    below = [F.when(F.col(c) < F.col("close"), F.col(c)) for c in ("tenkan", "kijun", "cloud_top", "cloud_bottom")]
    support = F.coalesce(F.greatest(*below), F.col("close") * 0.94)
    return df.withColumn("research_invalidation_price", support * 0.99)


def pattern_labels(df: DataFrame, horizon: int = 10) -> DataFrame:
    """Forward labels of a history row: return from the next open, level touched or not."""
    ahead = series().rowsBetween(1, horizon)
    df = df.withColumns({
        "future_low_10": F.when(F.count("low").over(ahead) == horizon, F.min("low").over(ahead)),
        "_entry": F.lead("open", 1).over(series()),
        "_exit": F.lead("close", horizon).over(series()),
    })
    return df.withColumns({
        "pattern_hit": F.col("future_low_10") <= F.col("research_invalidation_price"),
        "pattern_return_pct": (F.col("_exit") / F.col("_entry") - 1.0) * 100.0,
    }).drop("_entry", "_exit")


def feature_frame(indicators: DataFrame) -> DataFrame:
    return pattern_labels(research_invalidation(feature_columns(state_columns(indicators))))
