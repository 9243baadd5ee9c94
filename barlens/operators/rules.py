"""The rating of one bar: states, points, codes, grade, levels, confidence, action.

Texts of a rating are short codes.  A block also counts twice in the risk score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlens.operators import levels
from barlens.operators.indicators import back, indicator_frame, series, state_columns




def crosses(df: DataFrame) -> DataFrame:
    """Latest conversion/base cross within five steps and the cross count of 15 rows."""
    diff = F.col("tenkan") - F.col("kijun")
    df = df.withColumn("_d", diff)
    df = df.withColumn("_p", F.lag("_d", 1).over(series()))
    df = df.withColumns({
        "_cross": F.when((F.col("_p") <= 0) & (F.col("_d") > 0), 1).when((F.col("_p") >= 0) & (F.col("_d") < 0), -1),
        "_sign": F.signum("_d").cast("int"),
    })
    df = df.withColumns({
        "recent_cross": F.coalesce(F.last("_cross", ignorenulls=True).over(back(5)), F.lit(0)),
        "_signs": F.collect_list("_sign").over(back(15)),
    })
    # A zero carries the sign before it; leading zeros of the window stay zero.
    count = F.aggregate(
        "_signs",
        F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.when(s == 0, F.coalesce(acc["last"], F.lit(0))).otherwise(s).alias("last"),
            (acc["n"] + F.when(
                acc["last"].isNotNull()
                & (F.when(s == 0, F.coalesce(acc["last"], F.lit(0))).otherwise(s) != acc["last"]), 1
            ).otherwise(0)).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return df.withColumn("cross_count", count).drop("_d", "_p", "_cross", "_sign", "_signs")


def tk_state(df: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("recent_cross") > 0, "cross_up").when(F.col("recent_cross") < 0, "cross_down")
        .when(F.col("tenkan") > F.col("kijun"), "tenkan_over")
        .when(F.col("tenkan") < F.col("kijun"), "kijun_over").otherwise("equal")
    )
    return df.withColumn("tk_state", state)


def breakout(df: DataFrame) -> DataFrame:
    """Cloud break against the previous row (needs ``prev_close``)."""
    df = df.withColumns({f"_prev_{c}": F.lag(c, 1).over(series()) for c in ("cloud_top", "cloud_bottom")})
    close, prev = F.col("close"), F.col("prev_close")
    top, bottom, ptop, pbottom = (F.col(c) for c in ("cloud_top", "cloud_bottom", "_prev_cloud_top", "_prev_cloud_bottom"))
    state = (
        F.when((prev <= ptop) & (close > top), "up_break")
        .when((prev >= pbottom) & (close < bottom), "down_break")
        .when((close > top) & (prev > F.coalesce(ptop, top)), "settled_above")
        .when((close < bottom) & (prev < F.coalesce(pbottom, bottom)), "staying_below")
        .otherwise("none")
    )
    return df.withColumn("kumo_breakout", state).drop("_prev_cloud_top", "_prev_cloud_bottom")


def measures(df: DataFrame) -> DataFrame:
    c = F.col
    atr = c("atr14")
    spread = c("high") - c("low")
    return df.withColumns({
        "candle_range_pct": F.greatest(F.lit(0.0), spread / c("close") * 100.0),
        "atr14_pct": atr / c("close") * 100.0,
        "candle_range_atr": F.when(atr > 0, spread / atr).otherwise(0.0),
        "cloud_thickness_pct": F.greatest(F.lit(0.0), (c("cloud_top") - c("cloud_bottom")) / c("close") * 100.0),
        "kijun_distance_pct": F.when(c("kijun") > 0, (c("close") / c("kijun") - 1.0) * 100.0).otherwise(0.0),
        "kijun_distance_atr": F.when(atr > 0, F.abs(c("close") - c("kijun")) / atr).otherwise(0.0),
        "high52": F.max("high").over(back(52)),
    })


def rated_inputs(bars: DataFrame) -> DataFrame:
    """Indicators, states and measures of every row of cleaned bars."""
    df = state_columns(indicator_frame(bars))
    return measures(breakout(tk_state(crosses(df))))


# ---- row rules (no windows below this line) -------------------------------------


def facts() -> dict[str, Column]:
    """The yes/no facts all rules share."""
    c = F.col
    ratio_ok = c("volume_ratio").isNotNull() & (c("volume_ratio") >= 1.0)
    up_break = c("kumo_breakout") == "up_break"
    return {
        "above": c("price_position") == "above",
        "inside": c("price_position") == "inside",
        "below": c("price_position") == "below",
        "tenkan_over": c("tenkan") > c("kijun"),
        "tenkan_under": c("tenkan") < c("kijun"),
        "base_holds": c("kijun_slope").isin("rising", "flat"),
        "chikou_strong": c("chikou_state") == "strong",
        "chikou_weak": c("chikou_state") == "weak",
        "chikou_mixed": c("chikou_state") == "mixed",
        "future_bullish": c("future_cloud") == "bullish",
        "future_bearish": c("future_cloud") == "bearish",
        "adx_bull": (c("adx14") >= 25.0) & (c("plus_di14") > c("minus_di14")),
        "adx_bear": (c("adx14") >= 25.0) & (c("minus_di14") > c("plus_di14")),
        "volume_ok": ratio_ok,
        "break_volume": up_break & ratio_ok,
        "break_no_volume": up_break & ~ratio_ok,
        "long_candle": c("candle_range_atr") > 2.5,
        "far_from_base": (c("kijun_distance_atr") > 3.0) & (c("close") > c("kijun")),
    }


def _points(*weighted: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for condition, weight in weighted:
        total = total + F.when(condition, weight).otherwise(0)
    return total


def bullish_points(f: dict[str, Column]) -> Column:
    return _points((f["above"], 2), (f["tenkan_over"], 1), (f["base_holds"], 1), (f["chikou_strong"], 2),
                   (f["future_bullish"], 1), (f["adx_bull"], 1), (f["break_volume"], 2))


def bearish_points(f: dict[str, Column]) -> Column:
    return _points((f["below"], 2), (f["tenkan_under"], 1), (~f["base_holds"], 1), (f["chikou_weak"], 2),
                   (f["future_bearish"], 1), (f["adx_bear"], 1))


def grade(f: dict[str, Column], bullish: Column, near_base: Column) -> Column:
    complete = (f["above"] & f["tenkan_over"] & f["base_holds"] & f["chikou_strong"] & f["future_bullish"] & near_base)
    return (
        F.when(complete, "A+")
        .when(f["above"] & (bullish >= 5) & ~f["chikou_weak"], "A")
        .when(f["above"] | (F.col("recent_cross") > 0), "B")
        .when(f["inside"], "C")
        .otherwise("D")
    )


def confidence_points(f: dict[str, Column], with_volume: bool = True) -> Column:
    facts_used = ["above", "tenkan_over", "base_holds", "chikou_strong", "future_bullish"]
    return _points(*[(f[k], 1) for k in facts_used + (["volume_ok"] if with_volume else [])])


def confidence(points: Column, blocks: Column) -> Column:
    return F.when((points >= 5) & (blocks == 0), "high").when(points >= 3, "medium").otherwise("low")


def action(grade_: Column, blocks: Column) -> Column:
    return (
        F.when((grade_ == "A+") & (blocks == 0), "interest")
        .when(grade_.isin("A+", "A", "B"), "wait").otherwise("avoid")
    )


def codes(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the codes whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, code) for code, cond in pairs]))


def level_free_rating(df: DataFrame) -> DataFrame:
    """Grade, points and the codes that need no price levels."""
    f = facts()
    bullish = bullish_points(f)
    return df.withColumns({
        "bullish_score": bullish,
        "bearish_score": bearish_points(f),
        "grade": grade(f, bullish, F.col("kijun_distance_atr") <= 3.0),
        "base_blocks": codes([
            ("below_cloud", f["below"]), ("inside_cloud", f["inside"]), ("weak_chikou", f["chikou_weak"]),
            ("unconfirmed_break", f["break_no_volume"]), ("long_candle", f["long_candle"]),
            ("far_from_base", f["far_from_base"]),
        ]),
        "base_risks": codes([
            ("sideways", f["inside"]), ("tenkan_under", f["tenkan_under"]), ("falling_base", ~f["base_holds"]),
            ("chikou_not_cleared", f["chikou_mixed"]), ("bearish_future", f["future_bearish"]),
            ("adx_bearish", f["adx_bear"]), ("adx_weak", F.col("adx14") < 18.0),
            ("break_no_volume", f["break_no_volume"]), ("long_candle", f["long_candle"]),
            ("far_from_base", f["far_from_base"]), ("many_crosses", F.col("cross_count") >= 3),
            ("thin_cloud", F.col("cloud_thickness_pct") < 0.7),
        ]),
        "base_reasons": codes([
            ("above_cloud", f["above"]), ("tenkan_over", f["tenkan_over"]), ("chikou_clear", f["chikou_strong"]),
            ("adx_bullish", f["adx_bull"]), ("break_with_volume", f["break_volume"]),
        ]),
    })


def price_plan(df: DataFrame) -> DataFrame:
    """Watch, invalidation and target prices from lines and levels."""
    c = F.col
    close, atr = c("close"), c("atr14")
    both = F.concat("flat_levels", "profile_levels")
    lines = F.array("tenkan", "kijun", "cloud_top", "cloud_bottom")
    support = F.coalesce(
        F.array_max(F.filter(F.concat(lines, both), lambda v: v < close)),
        close - F.greatest(atr * 2.0, close * 0.04),
    )
    target = F.array_min(F.filter(F.concat(both, F.array("high52")), lambda v: v > close * 1.005))
    lowered = support - F.greatest(atr * 0.35, close * 0.003)
    invalid = F.greatest(F.lit(0.01), F.least(lowered, close - F.greatest(atr * 0.8, close * 0.015)))
    df = df.withColumns({
        "watch_price": F.greatest("kijun", "cloud_top"),
        "invalidation_price": invalid,
        "first_target_price": target,
    })
    risk = F.greatest(F.lit(0.01), close - c("invalidation_price"))
    reward = F.greatest(F.lit(0.0), c("first_target_price") - close)
    return df.withColumn("reward_risk_ratio", F.when(c("first_target_price").isNull(), 0.0).otherwise(reward / risk))


def level_rating(df: DataFrame) -> DataFrame:
    """Finish the rating with the level-dependent codes."""
    f = facts()
    no_target = F.col("first_target_price").isNull()
    poor = ~no_target & (F.col("reward_risk_ratio") < 1.5)
    tail = [("low_reward_risk", poor), ("no_resistance", no_target)]
    overlap = F.exists("flat_levels", lambda a: F.exists(
        "profile_levels", lambda b: F.abs(a - b) / F.col("close") <= 0.015))
    df = df.withColumns({
        "blocks": F.concat("base_blocks", codes(tail)),
        "risks": F.concat("base_risks", codes(tail)),
        "reasons": F.concat("base_reasons", codes([("level_overlap", overlap)])),
    })
    n_blocks = F.size("blocks")
    df = df.withColumns({
        "risk_score": F.size("risks") + n_blocks * 2,
        "confidence": confidence(confidence_points(f), n_blocks),
        "action": action(F.col("grade"), n_blocks),
    })
    return df


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows a rating exists for: 80 bars seen and every line and strength value present."""
    ok = F.col("i") >= 79
    for c in ("tenkan", "kijun", "cloud_top", "cloud_bottom", "span_a", "span_b", "atr14", "adx14", "plus_di14", "minus_di14"):
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok)


def grades(bars: DataFrame) -> DataFrame:
    """Level-free ratings of every rateable row: enough for weekly and index context."""
    return level_free_rating(complete_rows(rated_inputs(bars)))


def readings(bars: DataFrame) -> DataFrame:
    """Full ratings of every rateable row of cleaned bars."""
    df = levels.with_windows(rated_inputs(bars))
    df = levels.add_levels(level_free_rating(complete_rows(df)))
    return level_rating(price_plan(df))
