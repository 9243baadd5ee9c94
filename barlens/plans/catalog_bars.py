"""Named queries over bars: indicators, ratings, replays, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlens.operators import ablation, cleaning, context, environment, evaluation, levels, outcomes as oc, rules, similarity
from barlens.operators.indicators import FEATURES, STATES
from barlens.plans import replay, shared
from barlens.sources import driver_tables as tables

ID = ["symbol", "session_date"]


def rounded(df: DataFrame, exact: list[str], numbers: list[str], digits: int = 4) -> DataFrame:
    return df.select(*exact, *[F.round(c, digits).alias(c) for c in numbers])


def frame_query(exact: list[str], numbers: list[str], rated_only: bool = False, digits: int = 4):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = shared.frame(spark, sf_dir)
        if rated_only:
            df = rules.complete_rows(df)
        return rounded(df, [*ID, *exact], numbers, digits)
    return run


def millions(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name) / 1e6)


def cloud_position(spark, sf):
    """Where each symbol stands against its cloud, counted over its history."""
    df = shared.frame(spark, sf).filter(F.col("i") >= 79)
    return df.groupBy("symbol", "price_position").count().withColumnRenamed("count", "sessions")


def liquidity_averages(spark, sf):
    df = millions(shared.frame(spark, sf), "avg_value_20")
    return rounded(df, ID, ["avg_volume_20", "avg_value_20", "volume_ratio"], 7)


def bar_validity(spark, sf):
    """FLT1 verdict per symbol over its observations."""
    df = cleaning.judged(shared.raw_bars(spark, sf))
    return df.groupBy("market", "symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.max("bad_price_rows").alias("bad_price_rows"),
        F.coalesce(F.max("reason"), F.lit("usable")).alias("verdict"),
        F.round(F.sum(F.col("trade_value") / 1e6), 2).alias("value_millions"))


def minute_validity(spark, sf):
    """The same gate on intraday observations: corrupt values reject the series."""
    m = tables.minute_bars(spark, sf).select(
        "market", "symbol", F.to_date("ts").alias("session_date"), "open", "high", "low", "close", "volume", "event_id")
    df = cleaning.judged(m, "event_id")
    return df.groupBy("market", "symbol").agg(
        F.max("bad_price_rows").alias("bad_price_rows"), F.max("sessions").alias("sessions"),
        F.coalesce(F.max("reason"), F.lit("usable")).alias("verdict"))


def metric_changes(spark, sf):
    c = environment.metric_changes(shared.bars(spark, sf), ["symbol"], "session_date", "close")
    return rounded(c, ["symbol"], ["latest", "change_1d_pct", "change_5d_pct"])


def metric_score(spark, sf):
    c = environment.metric_changes(shared.bars(spark, sf), ["market", "symbol"], "session_date", "close")
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    c = c.withColumns({
        "direction": F.when(number % 3 == 0, -1.0).otherwise(1.0), "weight": 0.35 + (number % 5) * 0.25,
        "scale1": F.lit(80.0), "scale5": F.lit(200.0)})
    return environment.market_score(environment.metric_contributions(c), ["market"])


def forward_labels(spark, sf):
    df = shared.frame(spark, sf)
    return rounded(df, [*ID, "pattern_hit"], ["future_low_10", "pattern_return_pct"])


def paths(spark, sf):
    df = shared.plain_outcomes(spark, sf)
    return rounded(df, ["symbol", "as_of", "horizon", "invalidation_hit", "large_loss"],
                   ["entry_price", "exit_price", "forward_return_pct", "mae_pct", "mfe_pct", "max_drawdown_pct"])


def path_totals(spark, sf):
    df = shared.plain_outcomes(spark, sf)
    return df.groupBy("symbol", "horizon").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if("invalidation_hit").alias("hits"),
        F.count_if("large_loss").alias("large_losses"), F.round(F.avg("max_drawdown_pct"), 4).alias("mean_drawdown"),
        F.round(F.avg("mae_pct"), 4).alias("mean_mae"), F.round(F.avg("mfe_pct"), 4).alias("mean_mfe"),
        F.round(F.avg("forward_return_pct"), 4).alias("mean_return"))


def decision_grid(spark, sf):
    """FLT22 with a step of 5: decisions per symbol."""
    df = oc.decision_grid(shared.frame(spark, sf).drop("on_grid"), 5)
    return df.groupBy("symbol").agg(
        F.count_if("on_grid").alias("decisions"), F.min(F.when(F.col("on_grid"), F.col("session_date"))).alias("first"),
        F.max(F.when(F.col("on_grid"), F.col("session_date"))).alias("last"))


PERF = ["mean_return_pct", "median_return_pct", "up_rate_pct", "mean_mae_pct", "mean_mfe_pct", "mean_max_drawdown_pct",
        "invalidation_rate_pct", "large_loss_rate_pct", "return_volatility_pct", "return_to_volatility"]


def performance(keys, source=shared.plain_outcomes, only_splits=False):
    def run(spark, sf):
        out = source(spark, sf)
        if only_splits:
            out = out.filter(F.col("split").isin("train", "validation", "test"))
        return rounded(evaluation.performance(out, keys), [*keys, "horizon", "sample_count", "unique_dates"], PERF)
    return run


def sections(spark, sf):
    return evaluation.cross_sections(shared.plain_outcomes(spark, sf), ["technical_score", "context_adjusted_score"], 10)


def rank_ic(spark, sf):
    return rounded(evaluation.rank_ic(sections(spark, sf)), ["horizon", "score", "date_count"],
                   ["mean_spearman", "median_spearman"])


def rank_groups(spark, sf):
    keys = ["ranking_score", "rank_group"]
    return rounded(evaluation.rank_groups(sections(spark, sf)), [*keys, "horizon", "sample_count", "unique_dates"], PERF)


def average_ranks(spark, sf):
    """Average ranks and their percentile per date, summed per symbol."""
    s = sections(spark, sf)
    return s.groupBy("symbol", "horizon", "score").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score_rank"), 4).alias("score_rank"),
        F.round(F.sum("return_rank"), 4).alias("return_rank"), F.round(F.sum("descending_pct"), 4).alias("descending_pct"))


def action_ordering(spark, sf):
    t = evaluation.action_ordering(evaluation.performance(shared.plain_outcomes(spark, sf), ["action"]))
    return rounded(t, ["horizon", "status", "missing_actions", "mean_return_order_pass", "median_return_order_pass",
                       "up_rate_order_pass"], [f"{a}_mean_return_pct" for a in evaluation.ACTIONS])


def split_dates(spark, sf):
    return evaluation.split_dates(shared.plain_signals(spark, sf))


def splits_join(spark, sf):
    return shared.plain_outcomes(spark, sf).groupBy("split", "horizon").agg(F.count(F.lit(1)).alias("rows"))


LEVEL_FREE_SIGNALS = tuple(s for s in evaluation.SIGNALS if s not in ("weekly_bullish", "market_bullish"))


def correlations(spark, sf):
    df = rules.complete_rows(shared.frame(spark, sf))
    df = df.withColumns({"weekly_direction": F.lit(None).cast("string"), "market_context": F.lit(None).cast("string")})
    df = df.withColumns({k: v for k, v in replay.decision_flags().items() if k in LEVEL_FREE_SIGNALS})
    t = evaluation.signal_correlations(df, LEVEL_FREE_SIGNALS)
    return rounded(t, ["category", "signal_a", "signal_b", "sample_count"], ["phi_correlation", "absolute_correlation"])


def quartiles(spark, sf):
    """Quartile labelling of the 10-row return per horizon."""
    q = evaluation.quartile_labels(shared.plain_outcomes(spark, sf), "mae_pct")
    return q.groupBy("horizon", "quartile").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.min("mae_pct"), 4).alias("low"), F.round(F.max("mae_pct"), 4).alias("high"))


def pattern_counts(spark, sf):
    """Usable history and same-state candidates known at each decision row."""
    df = shared.frame(spark, sf).filter(F.col("i") >= 79)
    return df.select(*ID, "history_count", "candidate_count")


def latest_scale(spark, sf):
    """Robust scale of the candidates of each symbol's latest row, per feature."""
    df = shared.frame(spark, sf)
    newest = Window.partitionBy("market", "symbol")
    df = df.withColumn("_last", F.max("i").over(newest))
    cur = df.filter(F.col("i") == F.col("_last")).select("symbol", *STATES, F.col("i").alias("at"))
    cand = df.filter("_usable").join(cur, ["symbol", *STATES]).filter(F.col("i") <= F.col("at") - 10)
    long = cand.select("symbol", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"f_{f}").alias("x")) for f in FEATURES])))
    keys = ["symbol", "feature"]
    # One symbol's candidates: at most its sessions.
    med = long.groupBy(*keys).agg(F.median("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("x").alias("candidates"))
    mad = long.join(med, keys).groupBy(*keys, "sd", "candidates").agg((F.median(F.abs(F.col("x") - F.col("m"))) * 1.4826).alias("mad"))
    scale = F.when(F.col("mad") > 1e-8, F.col("mad")).otherwise(F.col("sd"))
    return mad.select(*keys, "candidates", F.round(F.when(scale > 1e-8, scale).otherwise(1.0), 4).alias("scale"))


def decision_scales(spark, sf):
    """Robust scale of the candidates of every decision row, per feature."""
    return similarity.decision_scales(shared.frame(spark, sf), F.col("on_grid")).select(
        "symbol", "session_date", "feature", "candidates", F.round("scale", 4).alias("scale"))


def decision_patterns(spark, sf):
    """The 18-field pattern summary of every decision row."""
    return rounded(similarity.with_similarity(shared.frame(spark, sf), F.col("on_grid")), [
        *ID, "sample_count", "up_count", "recent_sample_count", "recent_up_count", "similarity_status", "candidate_count", "invalidation_count"], [
        "up_rate", "median_return_pct", "recent_up_rate", "nearest_distance", "average_up_return_pct", "average_down_return_pct",
        "invalidation_rate", "expected_return_pct", "downside_p25_pct", "payoff_ratio"])


def nearest_neighbors(spark, sf):
    return rounded(similarity.neighbors(shared.frame(spark, sf), F.col("on_grid")), ["market", "symbol", "i", "neighbor_i", "pattern_hit"], ["distance", "pattern_return_pct"])


def weekly(spark, sf):
    return millions(context.weekly_bars(shared.bars(spark, sf)), "trade_value").select(
        *ID, "open", "high", "low", "close", "volume", F.round("trade_value", 6).alias("trade_value"))


def weekly_as_of(spark, sf):
    df = shared.frame(spark, sf).filter(F.col("i") >= 79).select("market", "symbol", "session_date")
    return context.with_weekly(df, shared.bars(spark, sf)).select(*ID, "weekly_direction")


def market_context(spark, sf):
    return context.market_context(shared.proxies(spark, sf), shared.bars(spark, sf))


def liquidity_gate(spark, sf):
    df = rules.complete_rows(shared.frame(spark, sf))
    reason = F.coalesce(context.liquidity_reason(), F.lit("liquid"))
    return df.groupBy("market", "symbol", reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def profile_histogram(spark, sf):
    """Volume per price bin of every rateable row's 140-row window, summed per symbol."""
    df = levels.add_levels(levels.with_windows(shared.frame(spark, sf)).filter(F.col("i") >= 79))
    bins = df.select("symbol", F.posexplode("profile_weights").alias("bin", "weight"))
    return bins.groupBy("symbol", "bin").agg(F.sum("weight").alias("volume"))


def price_levels(spark, sf):
    df = levels.add_levels(levels.with_windows(shared.frame(spark, sf)).filter(F.col("i") >= 79))
    return df.select(*ID, "flat_levels", "profile_levels")


def full_readings(spark, sf):
    s = shared.full_signals(spark, sf)
    return s.select("market", "as_of", "symbol", "grade", "action", "technical_score", "context_adjusted_score",
                    "confidence", "risk_score", "hard_block_count", "liquid", "market_context", "invalidation_price",
                    "similar_sample_count", "similarity_status", "environment_score", "event_risk")


def signal_projection(spark, sf):
    """The level-free part of a signal row: booleans and features of the decision row."""
    df = rules.complete_rows(shared.frame(spark, sf))
    df = df.withColumns({"weekly_direction": F.lit(None).cast("string"), "market_context": F.lit(None).cast("string")})
    flags = {k: v for k, v in replay.decision_flags().items() if k in LEVEL_FREE_SIGNALS}
    return rounded(df.withColumns(flags), [*ID, *LEVEL_FREE_SIGNALS], [f"f_{c}" for c in FEATURES])


def ablation_rows(spark, sf):
    s = shared.full_signals(spark, sf)
    long = s.select("symbol", "as_of", F.inline(F.array(*[F.struct(
        F.lit(f).alias("family"), F.col(f"ablation_{f}_action").alias("variant_action"),
        F.col(f"ablation_{f}_score").alias("variant_score"), F.col(f"ablation_{f}_status").alias("status"))
        for f in ablation.FAMILIES])))
    return long.groupBy("family", "variant_action", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("variant_score").alias("score_sum"))


def ablation_table(spark, sf):
    return evaluation.ablation_table(shared.full_outcomes(spark, sf), ablation.FAMILIES)


def plain_ablation(spark, sf):
    """The ablation comparison on level-free signals (two families)."""
    out = shared.plain_outcomes(spark, sf)
    out = out.withColumns({
        "ablation_grade_only_action": F.when(F.col("grade").isin("A+", "A"), "interest").otherwise("avoid"),
        "ablation_grade_only_status": F.lit("projected"),
        "ablation_fixed_action": F.col("action"), "ablation_fixed_status": F.lit("missing_pit_snapshots")})
    t = evaluation.ablation_table(out, ("grade_only", "fixed"))
    return rounded(t, ["family", "status", "split", "horizon", "baseline_interest_count", "ablated_interest_count"],
                   ["baseline_mean_return_pct", "ablated_mean_return_pct", "mean_return_delta_pct",
                    "baseline_return_to_volatility", "ablated_return_to_volatility", "return_to_volatility_delta"])


def similarity_validation(spark, sf):
    return evaluation.similarity_groups(evaluation.similarity_sample(shared.full_outcomes(spark, sf)))


def similarity_overall(spark, sf):
    return evaluation.similarity_overall(evaluation.similarity_sample(shared.full_outcomes(spark, sf)))


def run_metadata(spark, sf):
    sig = shared.full_signals(spark, sf)
    return evaluation.run_metadata(
        shared.bars(spark, sf), sig, shared.full_outcomes(spark, sf), shared.proxies(spark, sf), {},
        ("SPY", "QQQ", "KOSPI", "KOSDAQ"), sig)


def trust_levels(spark, sf):
    """Trust level and blockers of each symbol-date, with flags read off the data."""
    f = shared.frame(spark, sf).filter(F.col("i") >= 79)
    f = f.withColumns({
        "evaluated": F.col("i") >= 100, "price_history": F.lit(True), "market_proxies": F.col("volume_ratio") > 0.2,
        "universe_snapshots": F.col("close") > 20000, "historical_universe_verified": F.col("close") > 10000,
        "delisted_securities_included": F.col("grade") != "D", "corporate_action_verified": F.lit(True),
        "exchange_calendar_verified": F.col("kijun_slope") != "flat", "intelligence_complete": F.col("price_position") != "inside",
        "independent_dates_sufficient": F.col("tk_state") != "kijun_over"})
    t = evaluation.with_trust(f)
    return t.groupBy("trust_level", F.concat_ws(",", "trust_blockers").alias("blockers")).agg(F.count(F.lit(1)).alias("rows"))


def latest_scan(spark, sf):
    """Entry B: the latest full rating of every symbol, in scan order."""
    from barlens.plans.scan import scan
    return scan(shared.bars(spark, sf), shared.proxies(spark, sf), shared.snapshots(spark, sf))


def bucket_counts(spark, sf):
    """Scan summary over the replay: ratings per market and final action."""
    s = shared.full_signals(spark, sf)
    return s.groupBy("market", F.col("action").alias("final_action")).agg(F.count(F.lit(1)).alias("ratings"))


def bucket_lists(spark, sf):
    from barlens.plans.scan import bucket_lists as lists
    return lists(latest_scan(spark, sf)).select("market", "symbol", "final_action", "bucket_position", "grade")


def watch_state(spark, sf):
    from barlens.plans.scan import watch_price_state, sample_note
    df = rules.complete_rows(shared.frame(spark, sf))
    watch = F.greatest("kijun", "cloud_top")
    state = watch_price_state(F.col("close"), watch, F.col("research_invalidation_price"))
    return df.groupBy("symbol", state.alias("state"), sample_note(F.col("candidate_count")).alias("note")).agg(
        F.count(F.lit(1)).alias("rows"))


def news_blend(spark, sf):
    """Environment label ladder and stock/market news blend over the snapshots."""
    s = shared.snapshots(spark, sf)
    wide = s.filter("symbol = '*'").select("market", "as_of", F.col("news_score").alias("base_news"))
    own = s.filter("symbol <> '*'").join(wide, ["market", "as_of"], "left")
    return own.select("market", "as_of", "symbol", environment.blended_news(F.col("news_score"), F.col("base_news")).alias("news"),
                      "environment_score", "environment_label")


def environment_scores(spark, sf):
    return shared.snapshots(spark, sf).select("market", "as_of", "symbol", "environment_score", "environment_label")


def neutralised(spark, sf):
    s = shared.snapshots(spark, sf)
    m, n, r = F.col("market_score"), F.col("news_score"), F.col("event_risk")
    return s.select("market", "as_of", "symbol", environment.combine(m, F.lit(50), r).alias("without_news"),
                    environment.combine(m, n, F.lit(15)).alias("without_events"))


def intelligence_cutoff(spark, sf):
    df = shared.bars(spark, sf).select("market", "symbol", "session_date")
    v = environment.visible_intelligence(df, shared.snapshots(spark, sf))
    return v.select("symbol", "session_date", "environment_score", "event_risk")


def adjusted_scores(spark, sf):
    """Technical and context-adjusted score from the level-free grade and the day's snapshot."""
    df = rules.complete_rows(shared.frame(spark, sf)).select("market", "symbol", "session_date", "grade", "base_blocks")
    df = environment.visible_intelligence(df, shared.snapshots(spark, sf))
    n = F.size("base_blocks")
    conf = F.when(n == 0, "high").when(n == 1, "medium").otherwise("low")
    tech = context.technical_score(F.col("grade"), conf, n)
    return df.select(*ID, tech.alias("technical_score"), context.adjusted_score(tech, F.col("environment_score")).alias("context_adjusted_score"),
                     context.final_action(rules.action(F.col("grade"), n), F.col("environment_score"), F.col("event_risk")).alias("final_action"))


QUERIES = {
    "cloud_position": cloud_position,
    "flt1_bar_validity": bar_validity,
    "flt1_minute_validity": minute_validity,
    "win_i1_lines": frame_query([], ["tenkan", "kijun"]),
    "win_i2_spans": frame_query([], ["span_a", "span_b"]),
    "win_i3_cloud": frame_query([], ["cloud_a", "cloud_b", "cloud_top", "cloud_bottom"]),
    "win_i4_liquidity": liquidity_averages,
    "win_i5_volume_ratio": frame_query([], ["volume_ratio"]),
    "win_i6_true_range": frame_query([], ["true_range"]),
    "win_i7_atr": frame_query([], ["atr14"]),
    "win_i8_di": frame_query([], ["plus_dm", "minus_dm", "plus_di14", "minus_di14"]),
    "win_i9_adx": frame_query([], ["dx", "adx14"]),
    "win_i10_rsi": frame_query([], ["rsi14"]),
    "win_i11_sma": frame_query([], ["sma5", "sma20", "sma60"]),
    "win_i12_distances": frame_query([], ["f_close_sma5_pct", "f_close_sma20_pct", "f_close_sma60_pct", "f_sma5_sma20_pct",
                                          "f_price_kijun_pct", "f_tenkan_kijun_pct", "f_price_cloud_top_pct"]),
    "win_i13_momentum": frame_query([], ["return5_pct", "return20_pct"]),
    "win_i14_slope": frame_query(["kijun_slope"], []),
    "win_i15_lagging": frame_query(["chikou_state"], []),
    "win_i16_features": frame_query([], [f"f_{c}" for c in FEATURES]),
    "win_i17_invalidation": frame_query([], ["research_invalidation_price"], digits=8),
    "win_i18_metric_changes": metric_changes,
    "win_x1_recent_cross": frame_query(["recent_cross", "tk_state"], [], True),
    "win_x2_cross_count": frame_query(["cross_count"], [], True),
    "win_x3_breakout": frame_query(["kumo_breakout"], [], True),
    "win_x4_x5_top5_levels": price_levels,
    "win_x6_high52": frame_query([], ["high52"]),
    "win_f1_f2_f3_labels": forward_labels,
    "win_f4_f5_f6_paths": paths,
    "join17_signal_paths": path_totals,
    "flt22_decision_grid": decision_grid,
    "rul1_points": frame_query(["bullish_score", "bearish_score"], [], True),
    "rul2_codes": frame_query(["base_blocks", "base_risks", "base_reasons"], [], True),
    "rul3_grade": frame_query(["grade"], [], True),
    "rul4_rul12_readings": full_readings,
    "rul10_rul12_scores": adjusted_scores,
    "rul13_watch_state": watch_state,
    "rul14_environment": environment_scores,
    "rul15_news_blend": news_blend,
    "rul16_ablation_rows": ablation_rows,
    "rul17_neutralised": neutralised,
    "rul19_signal_projection": signal_projection,
    "agg1_performance": performance(["grade", "split"]),
    "agg2_baseline": performance([]),
    "agg2_by_action": performance(["action"]),
    "agg3_walk_forward": performance(["split", "action"], only_splits=True),
    "agg4_rank_ic": rank_ic,
    "agg5_rank_groups": rank_groups,
    "agg6_action_ordering": action_ordering,
    "agg7_ablation": plain_ablation,
    "agg7_ablation_full": ablation_table,
    "agg8_correlations": correlations,
    "agg9_similarity_groups": similarity_validation,
    "agg10_quartiles": quartiles,
    "agg11_similarity_overall": similarity_overall,
    "agg12_robust_scale": latest_scale,
    "agg12_decision_scales": decision_scales,
    "agg13_pattern_summary": decision_patterns,
    "agg14_weekly": weekly,
    "agg15_profile": profile_histogram,
    "agg16_market_score": metric_score,
    "agg26_run_metadata": run_metadata,
    "agg27_trust": trust_levels,
    "agg30_join6_market_context": market_context,
    "win_r3_average_rank": average_ranks,
    "win_s1_splits": split_dates,
    "join7_weekly_as_of": weekly_as_of,
    "join13_candidates": pattern_counts,
    "join18_split_join": splits_join,
    "join10_flt17_intelligence": intelligence_cutoff,
    "top4_neighbors": nearest_neighbors,
    "flt16_liquidity_gate": liquidity_gate,
    "scan_latest": latest_scan,
    "agg29_bucket_counts": bucket_counts,
    "top3_bucket_lists": bucket_lists,
}
