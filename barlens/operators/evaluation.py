"""Result tables of a replay: performance, rank tests, splits, ablation, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.indicators import FEATURES
from barlens.operators.quantiles import exact_quantiles, spearman
from barlens.session import cut

ACTIONS = ("interest", "wait", "avoid")
GRADES = ("A+", "A", "B", "C", "D")
RANKING_HORIZONS = (5, 10, 20)
SIGNALS = (
    "price_above_cloud", "tenkan_above_kijun", "kijun_nonfalling", "chikou_strong", "future_cloud_bullish",
    "adx_di_bullish", "volume_confirmed", "weekly_bullish", "market_bullish", "atr_extension_block",
)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *[F.col(f"r.{c}") for c in take])


def performance(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Return statistics per ``keys`` and horizon; keys are enumerations, null is a group."""
    groups = [*keys, "horizon"]
    ret = F.col("forward_return_pct")
    base = outcomes.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_distinct("as_of").alias("unique_dates"),
        F.avg(ret).alias("mean_return_pct"),
        (F.avg((ret > 0).cast("double")) * 100.0).alias("up_rate_pct"),
        F.avg("mae_pct").alias("mean_mae_pct"),
        F.avg("mfe_pct").alias("mean_mfe_pct"),
        F.avg("max_drawdown_pct").alias("mean_max_drawdown_pct"),
        (F.avg(F.col("invalidation_hit").cast("double")) * 100.0).alias("invalidation_rate_pct"),
        (F.avg(F.col("large_loss").cast("double")) * 100.0).alias("large_loss_rate_pct"),
        F.stddev_pop(ret).alias("return_volatility_pct"),
    )
    median = exact_quantiles(outcomes, groups, "forward_return_pct", {"median_return_pct": 0.5})
    table = _null_safe(base, median, groups, ["median_return_pct"])
    volatility = F.col("return_volatility_pct")
    return table.withColumn(
        "return_to_volatility", F.when(volatility > 0, F.col("mean_return_pct") / volatility)
    ).select(
        *groups, "sample_count", "unique_dates", "mean_return_pct", "median_return_pct", "up_rate_pct",
        "mean_mae_pct", "mean_mfe_pct", "mean_max_drawdown_pct", "invalidation_rate_pct",
        "large_loss_rate_pct", "return_volatility_pct", "return_to_volatility",
    )


# ---- ranking ---------------------------------------------------------------------------


def average_rank(keys: list[str], value: Column) -> Column:
    """Average rank of ties within ``keys`` (one cross-section: at most the listed symbols)."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def cross_sections(outcomes: DataFrame, scores: list[str], min_rows: int) -> DataFrame:
    """Long form over scores, cross-sections large and varied enough, with both ranks."""
    keys = ["as_of", "horizon", "score"]
    rows = outcomes.filter(F.col("horizon").isin(*RANKING_HORIZONS))
    long = rows.select("*", F.inline(F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("score_value")) for s in scores])))
    long = long.filter(F.col("score_value").isNotNull() & F.col("forward_return_pct").isNotNull())
    section = Window.partitionBy(*keys)
    long = long.withColumns({
        "_n": F.count(F.lit(1)).over(section),
        "_low": F.min("score_value").over(section), "_high": F.max("score_value").over(section),
    }).filter((F.col("_n") >= min_rows) & (F.col("_low") < F.col("_high")))
    return long.withColumns({
        "score_rank": average_rank(keys, F.col("score_value")),
        "return_rank": average_rank(keys, F.col("forward_return_pct")),
    }).withColumn("descending_pct", (F.col("_n") + 1 - F.col("score_rank")) / F.col("_n"))


def rank_ic(sections: DataFrame) -> DataFrame:
    """Mean and median over the dates; a group holds one row per date, so the plain median serves."""
    daily = sections.groupBy("as_of", "horizon", "score").agg(
        correlation(F.col("score_rank"), F.col("return_rank")).alias("spearman"))
    return daily.groupBy("horizon", "score").agg(
        F.count_distinct("as_of").alias("date_count"), F.avg("spearman").alias("mean_spearman"), F.median("spearman").alias("median_spearman"))


def rank_groups(sections: DataFrame) -> DataFrame:
    p = F.col("descending_pct")
    labels = F.array_compact(F.array(
        F.when(p <= 0.05, "Top 5%"), F.when(p <= 0.10, "Top 10%"),
        F.when(p <= 0.20, "Top 20%"), F.when(p > 0.80, "Bottom 20%")))
    rows = sections.withColumn("rank_group", F.explode(labels)).withColumnRenamed("score", "ranking_score")
    return performance(rows, ["ranking_score", "rank_group"])


def action_ordering(action_results: DataFrame) -> DataFrame:
    """Does interest beat wait beat avoid on mean, median and up-rate, per horizon?"""
    g = action_results.groupBy("horizon").agg(*[
        F.max(F.when(F.col("action") == a, F.col(c))).alias(f"{a}_{c}")
        for a in ACTIONS for c in ("mean_return_pct", "median_return_pct", "up_rate_pct")
    ], *[F.count_if(F.col("action") == a).alias(f"_has_{a}") for a in ACTIONS])
    missing = F.concat_ws(",", *[F.when(F.col(f"_has_{a}") == 0, a) for a in ACTIONS])

    def ordered(c: str) -> Column:
        a, b, d = (F.col(f"{x}_{c}") for x in ACTIONS)
        return F.coalesce((a > b) & (b > d), F.lit(False)) & (missing == "")

    complete = missing == ""
    return g.select(
        "horizon", F.when(complete, "evaluated").otherwise("not_evaluable").alias("status"),
        missing.alias("missing_actions"),
        ordered("mean_return_pct").alias("mean_return_order_pass"),
        ordered("median_return_pct").alias("median_return_order_pass"),
        ordered("up_rate_pct").alias("up_rate_order_pass"),
        *[F.when(complete, F.col(f"{a}_mean_return_pct")).alias(f"{a}_mean_return_pct") for a in ACTIONS],
    )


# ---- splits -----------------------------------------------------------------------------


def split_dates(dates: DataFrame, purge: int = 20, minimum: int = 60) -> DataFrame:
    """(as_of, split) over distinct dates: 60/20/20 in date order with purged gaps.

    The input is the distinct decision dates, bounded by the calendar.
    """
    everything = Window.partitionBy(F.lit(1))
    d = dates.select("as_of").distinct().withColumns({
        "k": F.row_number().over(everything.orderBy("as_of")) - 1,
        "n": F.count(F.lit(1)).over(everything),
    })
    usable = F.col("n") - 2 * purge
    train = F.greatest(F.lit(minimum), F.floor(usable * 0.60))
    valid = F.greatest(F.lit(minimum), F.floor(usable * 0.20))
    tight = (valid < minimum) | (usable - train - valid < minimum)
    d = d.withColumns({
        "_train": F.when(tight, usable - 2 * minimum).otherwise(train),
        "_valid": F.when(tight, F.lit(minimum)).otherwise(valid),
    })
    k, v0 = F.col("k"), F.col("_train") + purge
    t0 = v0 + F.col("_valid") + purge
    split = (
        F.when(usable < minimum * 3, "insufficient")
        .when(k < F.col("_train"), "train")
        .when((k >= v0) & (k < v0 + F.col("_valid")), "validation")
        .when((k >= t0) & (k < t0 + usable - F.col("_train") - F.col("_valid")), "test")
        .otherwise("purged")
    )
    return d.select("as_of", split.alias("split"))


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    return rows.join(splits, "as_of", "left").withColumn("split", F.coalesce("split", F.lit("purged")))


# ---- correlations -----------------------------------------------------------------------


def signal_correlations(signals: DataFrame, booleans: tuple[str, ...] = SIGNALS) -> DataFrame:
    """All pairs of decision flags and of features in one pass.

    Each row becomes one short row per pair and is combined map-side, so only
    partial moments of the few pairs are shuffled.
    """
    plan = [("decision_signal", a, b, a, b, 3) for a, b in combinations(booleans, 2)]
    plan += [("similarity_feature", a, b, f"f_{a}", f"f_{b}", 20) for a, b in combinations(FEATURES, 2)]
    pairs = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for k, (_, _, _, a, b, _) in enumerate(plan)])
    long = signals.select(F.inline(pairs)).withColumn("both", F.col("x").isNotNull() & F.col("y").isNotNull())
    x, y = F.when(F.col("both"), F.col("x")), F.when(F.col("both"), F.col("y"))
    moments = long.groupBy("k").agg(F.count(x).alias("sample_count"), correlation(x, y).alias("r"))
    names = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), F.lit(n).alias("least"))
        for c, a, b, _, _, n in plan])
    named = moments.withColumn("p", F.get(names, F.col("k")))
    r = F.when(F.col("sample_count") >= F.col("p.least"), F.col("r"))
    return named.select(
        "p.category", "p.signal_a", "p.signal_b", "sample_count", r.alias("phi_correlation"), F.abs(r).alias("absolute_correlation"),
    ).orderBy(F.col("absolute_correlation").desc_nulls_last())


# ---- similarity validation ------------------------------------------------------------


def quartile_labels(df: DataFrame, column: str, key: str = "horizon") -> DataFrame:
    """Rows with Q1..Q4 per ``key``; none with under 8 rows, 4 distinct values or equal edges."""
    usable = df.filter(F.col(column).isNotNull())
    edges = exact_quantiles(usable, [key], column, {f"_e{k}": k / 4 for k in range(5)})
    # Four distinct values exist exactly when the count of distinct ones says so;
    # the distinct list is combined map-side.
    size = usable.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(column).alias("_d"))
    ok = edges.join(size, key).filter(
        (F.col("_n") >= 8) & (F.col("_d") >= 4)
        & (F.col("_e0") < F.col("_e1")) & (F.col("_e1") < F.col("_e2"))
        & (F.col("_e2") < F.col("_e3")) & (F.col("_e3") < F.col("_e4")))
    c = F.col(column)
    label = F.when(c <= F.col("_e1"), "Q1").when(c <= F.col("_e2"), "Q2").when(c <= F.col("_e3"), "Q3").otherwise("Q4")
    return usable.join(ok, key).withColumn("quartile", label).drop(*[f"_e{k}" for k in range(5)], "_n", "_d")


def _similarity_table(rows: DataFrame, test: str, group: Column) -> DataFrame:
    rows = rows.withColumn("group", group)
    ret, rate = F.col("forward_return_pct"), F.col("up_rate")
    known = rate.isNotNull()
    actual = F.when(known, (ret > 0).cast("double"))
    chance = rate / 100.0
    base = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(ret).alias("mean_return_pct"),
        (F.avg((ret > 0).cast("double")) * 100.0).alias("up_rate_pct"),
        F.avg("nearest_distance").alias("mean_distance"),
        F.avg(rate).alias("mean_predicted_up_rate"),
        (F.abs(F.avg(chance) - F.avg(actual)) * 100.0).alias("calibration_abs_error_pct"),
        F.avg((chance - actual) * (chance - actual)).alias("brier_score"),
    )
    median = exact_quantiles(rows, ["group"], "forward_return_pct", {"median_return_pct": 0.5})
    return _null_safe(base, median, ["group"], ["median_return_pct"]).withColumn("test", F.lit(test))


def similarity_sample(outcomes: DataFrame) -> DataFrame:
    """Ten-session outcomes with a pattern sample: the few columns the tests read, stored once."""
    return cut(outcomes.filter((F.col("horizon") == 10) & (F.col("similar_sample_count") > 0)).select(
        "horizon", "forward_return_pct", "similar_sample_count", "up_rate", "nearest_distance", "market_context"))


def similarity_groups(sample: DataFrame) -> DataFrame:
    """Calibration by sample size, distance quartile, predicted-rate quartile and market context."""
    n = F.col("similar_sample_count")
    size = F.when(n <= 14, "<15").when(n <= 24, "15-24").otherwise("25+")
    parts = [
        _similarity_table(sample, "sample_count", size),
        _similarity_table(quartile_labels(sample, "nearest_distance"), "distance", F.col("quartile")),
        _similarity_table(quartile_labels(sample, "up_rate"), "predicted_up_rate", F.col("quartile")),
        _similarity_table(sample, "market_context", F.col("market_context")),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def similarity_overall(sample: DataFrame) -> DataFrame:
    """One row: Brier score and three rank correlations over the whole sample."""
    known = sample.filter(F.col("up_rate").isNotNull())
    chance = F.col("up_rate") / 100.0
    actual = (F.col("forward_return_pct") > 0).cast("double")
    known = known.withColumn("_error", F.abs(chance - actual))
    base = known.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("forward_return_pct").alias("mean_return_pct"),
        (F.avg(actual) * 100.0).alias("up_rate_pct"),
        F.avg((chance - actual) * (chance - actual)).alias("brier_score"),
    ).select(F.lit("overall").alias("test"), F.lit("all").alias("group"), "*")
    for name, a, b in (
        ("spearman_with_return", "up_rate", "forward_return_pct"),
        ("sample_count_vs_abs_error_spearman", "similar_sample_count", "_error"),
        ("distance_vs_return_spearman", "nearest_distance", "forward_return_pct"),
    ):
        one = spearman(known, a, b).select(F.lit("all").alias("group"), F.col("spearman").alias(name))
        base = base.join(one, "group", "left")
    return base


# ---- ablation table -----------------------------------------------------------------------


def ablation_table(outcomes: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Interest results with and without each family, per split (and all) and horizon."""
    long = outcomes.select(
        "split", "horizon", "action", "forward_return_pct",
        F.inline(F.array(*[F.struct(
            F.lit(f).alias("family"), F.col(f"ablation_{f}_action").alias("variant"),
            F.col(f"ablation_{f}_status").alias("status")) for f in families])),
    )
    union = long.groupBy("family").agg(F.concat_ws(",", F.sort_array(F.collect_set("status"))).alias("family_status"))
    splits = F.when(F.col("split").isin("train", "validation", "test"), F.array(F.lit("all"), F.col("split"))).otherwise(
        F.array(F.lit("all")))
    ret = F.col("forward_return_pct")
    base, var = F.when(F.col("action") == "interest", ret), F.when(F.col("variant") == "interest", ret)
    g = long.withColumn("split", F.explode(splits)).groupBy("family", "split", "horizon").agg(
        F.count(base).alias("baseline_interest_count"), F.count(var).alias("ablated_interest_count"),
        F.avg(base).alias("baseline_mean_return_pct"), F.avg(var).alias("_mean"),
        F.stddev_pop(base).alias("_bv"), F.stddev_pop(var).alias("_vv"),
    ).join(union, "family")
    fixed = F.col("family_status").isin("non_identifiable_without_rule_rewrite", "missing_pit_snapshots")
    base_rtv = F.when(F.col("_bv") > 0, F.col("baseline_mean_return_pct") / F.col("_bv"))
    var_rtv = F.when(F.col("_vv") > 0, F.col("_mean") / F.col("_vv"))
    return g.select(
        "family", F.col("family_status").alias("status"), "split", "horizon",
        "baseline_interest_count", "ablated_interest_count", "baseline_mean_return_pct",
        F.when(~fixed, F.col("_mean")).alias("ablated_mean_return_pct"),
        F.when(~fixed, F.col("_mean") - F.col("baseline_mean_return_pct")).alias("mean_return_delta_pct"),
        base_rtv.alias("baseline_return_to_volatility"),
        F.when(~fixed, var_rtv).alias("ablated_return_to_volatility"),
        F.when(~fixed, var_rtv - base_rtv).alias("return_to_volatility_delta"),
        F.lit("undecided").alias("recommendation"),
    )


# ---- trust -----------------------------------------------------------------------------------

CORE_REQUIREMENTS = (
    "price_history", "market_proxies", "universe_snapshots", "historical_universe_verified",
    "delisted_securities_included", "corporate_action_verified", "intelligence_complete",
)
REQUIREMENTS = (
    "price_history", "market_proxies", "universe_snapshots", "historical_universe_verified",
    "delisted_securities_included", "corporate_action_verified", "exchange_calendar_verified",
    "intelligence_complete", "independent_dates_sufficient",
)


def with_trust(flags: DataFrame) -> DataFrame:
    """Trust level and blockers from the nine requirement flags (and ``evaluated``)."""
    core = F.lit(True)
    for name in CORE_REQUIREMENTS:
        core = core & F.coalesce(F.col(name), F.lit(False))
    rest = F.coalesce(F.col("exchange_calendar_verified"), F.lit(False)) & F.coalesce(
        F.col("independent_dates_sufficient"), F.lit(False))
    level = (
        F.when(~F.col("evaluated"), "NOT_EVALUABLE").when(~core, "EXPLORATORY")
        .when(~rest, "PARTIALLY_TRUSTED").otherwise("TRUSTED")
    )
    blockers = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.col(name), F.lit(False)), name) for name in REQUIREMENTS]))
    return flags.withColumns({"trust_level": level, "trust_blockers": blockers})


def run_metadata(bars: DataFrame, signals: DataFrame, outcomes: DataFrame, proxies: DataFrame,
                 verified: dict[str, bool], required_proxies: tuple[str, ...], splits: DataFrame,
                 universe_given: bool = False, full_context: bool = False) -> DataFrame:
    """One row per market: counts, ranges, requirement flags, trust level and blockers."""
    keys = ["market"]
    b = bars.groupBy(*keys).agg(
        F.count_distinct("symbol").alias("stock_count"), F.min("session_date").alias("first_session"),
        F.max("session_date").alias("last_session"), F.count(F.lit(1)).alias("bar_count"))
    s = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.count_if(F.col("environment_score").isNull()).alias("_no_environment"))
    o = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("outcome_count"))
    p = proxies.filter(F.col("symbol").isin(*required_proxies)).groupBy(*keys).agg(
        F.count_distinct("symbol").alias("_proxies"))
    # One flag for the run: the split is either applied to all dates or to none.
    applied = splits.agg((F.count_if(F.col("split") == "test") > 0).alias("independent_dates_sufficient"))
    t = b.join(s, keys, "left").join(o, keys, "left").join(p, keys, "left")
    t = t.withColumn("_one", F.lit(1)).join(applied.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("signal_count", "outcome_count", "_proxies")}
    complete = (F.col("signal_count") > 0) & (F.col("_no_environment") == 0)
    t = t.withColumns(zero).withColumns({
        "evaluated": F.col("signal_count") > 0,
        "price_history": F.col("signal_count") > 0,
        "market_proxies": F.col("_proxies") >= 2,
        "universe_snapshots": F.lit(universe_given),
        "historical_universe_verified": F.lit(verified.get("point_in_time_verified", False)),
        "delisted_securities_included": F.lit(verified.get("delisted_securities_included", False)),
        "corporate_action_verified": F.lit(verified.get("price_policy_verified", False)),
        "exchange_calendar_verified": F.lit(verified.get("exchange_calendar_verified", False)),
        "intelligence_complete": F.coalesce(complete, F.lit(False)) | F.lit(not full_context),
    })
    return with_trust(t).drop("_no_environment", "_proxies")


def limitation_codes() -> Column:
    """Codes of the known limits, from the requirement flags of ``run_metadata``."""
    pairs = [
        ("no_price_history", ~F.col("price_history")), ("no_market_proxies", ~F.col("market_proxies")),
        ("no_intelligence", ~F.col("intelligence_complete")), ("no_universe_snapshots", ~F.col("universe_snapshots")),
        ("universe_unverified", F.col("universe_snapshots") & ~F.col("historical_universe_verified")),
        ("price_policy_unverified", ~F.col("corporate_action_verified")),
        ("delisted_missing", ~F.col("delisted_securities_included")),
        ("calendar_unverified", ~F.col("exchange_calendar_verified")),
        ("provider_must_verify_prices", F.lit(True)),
    ]
    return F.array_compact(F.array(*[F.when(cond, code) for code, cond in pairs]))


def empty_tables(spark, horizons: tuple[int, ...], families: tuple[str, ...]) -> dict[str, DataFrame]:
    """Zero-count result tables for a run in which nothing could be evaluated."""
    def product(**axes) -> DataFrame:
        df = spark.range(1).select()
        for name, values in axes.items():
            df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
        return df

    status = F.lit("not_evaluable").alias("status")
    none = F.lit(0).alias("sample_count")
    scores, groups = ("technical_score", "context_adjusted_score"), ("Top 5%", "Top 10%", "Top 20%", "Bottom 20%")
    fails = [F.lit(False).alias(f"{c}_order_pass") for c in ("mean_return", "median_return", "up_rate")]
    return {
        "baseline": product(horizon=horizons).select("*", none, status),
        "grade_results": product(grade=GRADES, horizon=horizons).select("*", none, status),
        "action_results": product(action=ACTIONS, horizon=horizons).select("*", none, status),
        "action_ordering": product(horizon=horizons).select("*", status, *fails),
        "rank_ic": product(score=scores, horizon=RANKING_HORIZONS).select("*", F.lit(0).alias("date_count"), status),
        "ranking_groups": product(ranking_score=scores, rank_group=groups, horizon=RANKING_HORIZONS).select("*", none, status),
        "walk_forward": product(split=("train", "validation", "test"), horizon=horizons).select("*", none, status),
        "ablation": product(family=families, split=("all", "validation", "test"), horizon=horizons).select(
            "*", F.lit("no_eligible_stock_history").alias("status"), F.lit(0).alias("baseline_interest_count"),
            F.lit(0).alias("ablated_interest_count"), F.lit("undecided").alias("recommendation")),
        "similarity_validation": product(test=("sample_count", "distance", "predicted_up_rate", "market_context")).select(
            "*", F.lit("all").alias("group"), none, status),
    }
