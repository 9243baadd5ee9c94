"""The point-in-time replay: bars in, signals, outcomes and result tables out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from barlens.operators import ablation, context, environment, evaluation, levels, outcomes as oc, rules, similarity
from barlens.operators.indicators import FEATURES, feature_columns, pattern_labels, research_invalidation


@dataclass(frozen=True)
class Replay:
    decision_step: int = 1
    horizons: tuple[int, ...] = oc.HORIZONS
    min_cross_section: int = 20
    large_loss_pct: float = -10.0
    purge_sessions: int = 20
    min_split_dates: int = 60
    verified: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.decision_step < 1 or not self.horizons or min(self.horizons) < 1:
            raise ValueError("decision_step and horizons must be positive")


def pattern_frame(bars: DataFrame) -> DataFrame:
    """Indicators, states, features and pattern labels of every row, computed once."""
    df = research_invalidation(feature_columns(rules.rated_inputs(bars)))
    return similarity.with_candidates(pattern_labels(df))


def decision_flags() -> dict[str, Column]:
    f = rules.facts()
    up_week = F.coalesce(F.col("weekly_direction") == "up", F.lit(False))
    far = (F.col("atr14") > 0) & (F.col("kijun_distance_atr") > 3.0)
    return {
        "price_above_cloud": f["above"],
        "tenkan_above_kijun": F.col("tk_state").isin("tenkan_over", "cross_up"),
        "kijun_nonfalling": f["base_holds"],
        "chikou_strong": f["chikou_strong"],
        "future_cloud_bullish": f["future_bullish"],
        "adx_di_bullish": f["adx_bull"],
        "volume_confirmed": f["volume_ok"],
        "weekly_bullish": up_week,
        "market_bullish": F.col("market_context") == "both_up",
        "atr_extension_block": f["long_candle"] | far,
    }


def rate(frame: DataFrame, bars: DataFrame, proxies: DataFrame, decide: Column,
         snapshots: DataFrame | None = None) -> DataFrame:
    """Full contextual ratings of the rows of ``frame`` where ``decide`` holds."""
    windows = levels.with_windows(frame)
    matched = similarity.with_similarity(windows, decide)
    rated = rules.level_free_rating(rules.complete_rows(matched))
    rated = rules.level_rating(rules.price_plan(levels.add_levels(rated)))
    rated = context.with_weekly(rated, bars)
    rated = rated.join(context.market_context(proxies, bars), ["market", "session_date"], "left")
    if snapshots is None:
        for c in ("market_score", "news_score", "event_risk", "environment_score"):
            rated = rated.withColumn(c, F.lit(None).cast("int"))
        rated = rated.withColumn("generated_at", F.lit(None).cast("timestamp"))
    else:
        rated = environment.visible_intelligence(rated, snapshots)
    return context.contextual(rated)


def signals(bars: DataFrame, proxies: DataFrame, config: Replay = Replay(),
            snapshots: DataFrame | None = None, universe: DataFrame | None = None,
            outcome_bars: DataFrame | None = None) -> DataFrame:
    """One row per decision, with its future ``paths`` attached for ``outcomes``."""
    frame = oc.decision_grid(pattern_frame(bars), config.decision_step, config.horizons)
    if outcome_bars is None:
        frame = oc.forward_paths(frame, config.horizons)
    rated = rate(frame, bars, proxies, F.col("on_grid"), snapshots)
    if universe is not None:
        rated = rated.join(universe, ["market", "symbol", "session_date"], "left_semi")
    if outcome_bars is not None:
        rated = _foreign_paths(rated, bars, outcome_bars, config)
    rated = ablation.add_ablation(rated.withColumns(decision_flags()))
    extra = [c for c in ("paths", "signal_lows") if c in rated.columns]
    return rated.select(
        "market", F.col("session_date").alias("as_of"), "symbol", "grade", F.col("final_action").alias("action"),
        "technical_score", "context_adjusted_score", F.col("final_confidence").alias("confidence"),
        "bullish_score", "bearish_score", F.col("final_risk_score").alias("risk_score"),
        F.size("final_blocks").alias("hard_block_count"), "liquid", "liquidity_reason", "market_context",
        (F.col("market_context") == "both_weak").alias("market_weak"), *evaluation.SIGNALS,
        F.col("sample_count").alias("similar_sample_count"), "up_rate", "nearest_distance",
        "similarity_status", "environment_score", "market_score", "news_score", "event_risk",
        F.col("generated_at").alias("intelligence_generated_at"), "invalidation_price",
        *[f"f_{c}" for c in FEATURES],
        *[f"ablation_{f}_{k}" for f in ablation.FAMILIES for k in ("action", "score", "status")], *extra,
    )


def _foreign_paths(rated: DataFrame, bars: DataFrame, outcome_bars: DataFrame, config: Replay) -> DataFrame:
    """Paths from adjusted prices, lows for the level test from signal prices."""
    from barlens.operators.indicators import series, number_rows

    keys = ["market", "symbol", "session_date"]
    paths = oc.forward_paths(number_rows(outcome_bars), config.horizons).select(*keys, "paths")
    lows = number_rows(bars).select(*keys, F.array(*[
        F.min("low").over(series().rowsBetween(1, h)) for h in config.horizons]).alias("signal_lows"))
    return rated.join(paths, keys).join(lows, keys)


@dataclass
class Bundle:
    """Result tables of a run; ``write`` stores one folder per table."""

    tables: dict[str, DataFrame]

    def write(self, folder: str, fmt: str = "parquet") -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def evaluate(bars: DataFrame, proxies: DataFrame, config: Replay = Replay(),
             snapshots: DataFrame | None = None, universe: DataFrame | None = None,
             outcome_bars: DataFrame | None = None, required_proxies: tuple[str, ...] = ("SPY", "QQQ", "KOSPI", "KOSDAQ"),
             ) -> Bundle:
    """All twelve tables.  Signals and outcomes are persisted: ten aggregates read them."""
    sig = signals(bars, proxies, config, snapshots, universe, outcome_bars)
    splits = evaluation.split_dates(sig, config.purge_sessions, config.min_split_dates)
    sig = evaluation.with_split(sig, splits).persist()
    lows = "signal_lows" if "signal_lows" in sig.columns else None
    out = oc.outcomes(sig, "invalidation_price", config.large_loss_pct, lows).persist()
    sig = sig.drop("paths", "signal_lows")
    actions = evaluation.performance(out, ["action"])
    sections = evaluation.cross_sections(out, ["technical_score", "context_adjusted_score"], config.min_cross_section)
    sample = evaluation.similarity_sample(out)
    return Bundle({
        "signals": sig,
        "outcomes": out,
        "baseline": evaluation.performance(out, []),
        "grade_results": evaluation.performance(out, ["grade"]),
        "action_results": actions,
        "action_ordering": evaluation.action_ordering(actions),
        "rank_ic": evaluation.rank_ic(sections),
        "ranking_groups": evaluation.rank_groups(sections),
        "walk_forward": evaluation.performance(
            out.filter(F.col("split").isin("train", "validation", "test")), ["split", "action"]),
        "ablation": evaluation.ablation_table(out, ablation.FAMILIES),
        "signal_correlations": evaluation.signal_correlations(sig),
        "similarity_validation": evaluation.similarity_groups(sample).unionByName(
            evaluation.similarity_overall(sample), allowMissingColumns=True),
        "metadata": evaluation.run_metadata(
            bars, sig, out, proxies, config.verified, required_proxies, splits, universe is not None),
    })
