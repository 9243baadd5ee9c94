"""Leave-one-family-out decisions, recorded next to the real one and never fed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlens.operators import rules
from barlens.operators.context import adjusted_score, final_action, gated, liquidity_reason, technical_score
from barlens.operators.environment import combine

FAMILIES = (
    "ichimoku", "adx_di", "atr", "volume", "trade_value", "weekly", "intraday_60m", "similarity",
    "market_direction", "environment", "news", "global_event",
)


def _block_count(without: tuple[str, ...]) -> Column:
    if not without:
        return F.size("blocks")
    return F.size(F.filter("blocks", lambda b: ~b.isin(*without)))


def _variant_bases() -> dict[str, dict[str, Column]]:
    """Raw grade, confidence, action and block count with one rule family neutralised."""
    f = rules.facts()
    bullish = F.col("bullish_score")
    near = F.col("kijun_distance_atr") <= 3.0
    spec = {
        "adx_di": (bullish - f["adx_bull"].cast("int"), near, (), True),
        "volume": (bullish - F.when(f["break_volume"], 2).otherwise(0), near, ("unconfirmed_break",), False),
        "atr": (bullish, F.lit(True), ("long_candle", "far_from_base", "low_reward_risk"), True),
    }
    out = {}
    for name, (points, near_base, dropped, with_volume) in spec.items():
        grade, n = rules.grade(f, points, near_base), _block_count(dropped)
        out[name] = {
            "grade": grade, "n": n,
            "confidence": rules.confidence(rules.confidence_points(f, with_volume), n),
            "action": rules.action(grade, n),
        }
    return out


def add_ablation(rated: DataFrame) -> DataFrame:
    """Add action, score and status of the twelve families to contextual ratings."""
    variants = _variant_bases()
    flat = {f"_{v}_{k}": c for v, parts in variants.items() for k, c in parts.items()}
    df = rated.withColumns(flat)
    weekly, label = F.col("weekly_direction"), F.col("market_context")
    score, risk = F.col("environment_score"), F.col("event_risk")
    raw = {"grade": F.col("grade"), "confidence": F.col("confidence"), "action": F.col("action"), "n": F.size("blocks")}

    def outcome(base: dict[str, Column], weekly=weekly, label=label, reason=None, score=score, risk=risk):
        reason = liquidity_reason() if reason is None else reason
        g = gated(base["grade"], base["confidence"], base["action"], base["n"], weekly, label, reason)
        tech = technical_score(base["grade"], g["confidence"], g["n_blocks"])
        return final_action(g["action"], score, risk), adjusted_score(tech, score)

    def of(name: str) -> dict[str, Column]:
        return {k: F.col(f"_{name}_{k}") for k in ("grade", "confidence", "action", "n")}

    news, market = F.col("news_score"), F.col("market_score")
    known = score.isNotNull()
    neutral_news = F.when(known, combine(market, F.lit(50), risk))
    neutral_risk = F.when(known, combine(market, news, F.lit(15)))
    nothing = F.lit(None).cast("int")
    base = (F.col("final_action"), F.col("context_adjusted_score"))
    no_events = outcome(raw, score=neutral_risk, risk=F.when(known, F.lit(15)))
    results = {
        "ichimoku": base, "intraday_60m": base, "similarity": base,
        "adx_di": outcome(of("adx_di")), "atr": outcome(of("atr")),
        "volume": outcome(of("volume"), reason=liquidity_reason(ignore_volume=True)),
        "trade_value": outcome(raw, reason=liquidity_reason(ignore_value=True)),
        "weekly": outcome(raw, weekly=F.lit("up")),
        "market_direction": outcome(raw, label=F.lit("both_up")),
        "environment": outcome(raw, score=nothing, risk=nothing),
        "news": outcome(raw, score=neutral_news), "global_event": no_events,
    }
    rewritten = F.lit("evaluation_only_rule_neutralization")
    snapshot = F.when(known, "projected").otherwise("missing_pit_snapshots")
    statuses = {
        "ichimoku": F.lit("non_identifiable_without_rule_rewrite"),
        "intraday_60m": F.lit("no_operational_effect"), "similarity": F.lit("no_operational_effect"),
        "adx_di": rewritten, "atr": rewritten, "volume": rewritten,
        "trade_value": F.lit("exact_liquidity_neutralization"),
        "weekly": F.lit("exact_context_neutralization"), "market_direction": F.lit("exact_context_neutralization"),
        "environment": snapshot, "news": snapshot, "global_event": snapshot,
    }
    cols = {}
    for family in FAMILIES:
        cols[f"ablation_{family}_action"] = results[family][0]
        cols[f"ablation_{family}_score"] = results[family][1]
        cols[f"ablation_{family}_status"] = statuses[family]
    return df.withColumns(cols).drop(*flat)
