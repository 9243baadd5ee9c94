"""DuckDB statements for bars, indicators, ratings and evaluation tables."""

PER_BAR = """(CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 2 = 0 THEN 'KR' ELSE 'US' END)"""
ORDER = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
OHLC = f"""arg_min(l_extendedprice, {ORDER}) AS open, max(l_extendedprice) AS high,
 min(l_extendedprice) AS low, arg_max(l_extendedprice, {ORDER}) AS close, sum(l_quantity) * 5000.0 AS volume"""
BARS = f"""bars AS (SELECT {PER_BAR} AS market, p_brand AS symbol, CAST(l_shipdate AS DATE) AS session_date, {OHLC}
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
PROXY = f"""pb AS (SELECT l_linestatus AS ls, CAST(l_shipdate AS DATE) AS session_date, {OHLC} FROM lineitem GROUP BY ALL),
proxybars AS (SELECT 'US' AS market, CASE ls WHEN 'O' THEN 'SPY' ELSE 'QQQ' END AS symbol, * EXCLUDE ls FROM pb
 UNION ALL SELECT 'KR', CASE ls WHEN 'O' THEN 'KOSPI' ELSE 'KOSDAQ' END, * EXCLUDE ls FROM pb)"""
WEEKLY = """wk0 AS (SELECT market, symbol, CAST(date_trunc('week', session_date + INTERVAL 2 DAY) + INTERVAL 4 DAY AS DATE) AS week,
 arg_min(open, session_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, session_date) AS close,
 sum(volume) AS volume, sum(close * volume) AS trade_value, max(session_date) AS last_session FROM bars GROUP BY ALL),
wk AS (SELECT market, symbol, week AS session_date, open, high, low, close, volume, trade_value FROM
 (SELECT *, max(last_session) OVER (PARTITION BY symbol) AS lst FROM wk0) WHERE week <= lst)"""


def wilder(x: str, seed: int) -> str:
    """Weighted running sum form of the smoothing; series here stay under one block."""
    q = "(14.0/13.0)"
    return (f"CASE WHEN i >= {seed + 13} THEN pow(13.0/14.0, i) * sum(CASE WHEN i = {seed} THEN 1.0 WHEN i > {seed} "
            f"THEN 1.0/14.0 ELSE 0.0 END * (CASE WHEN i >= {seed} THEN {x} ELSE 0 END) * pow({q}, i)) OVER w END")


def chain(src: str = "bars", p: str = "") -> str:
    """CTEs from bars to states, features and labels; the last one is {p}feat."""
    value = "trade_value" if src == "wk" else "close * volume"
    keep = "* EXCLUDE (trade_value)" if src == "wk" else "*"
    return f"""
{p}n0 AS (SELECT {keep}, {value} AS trade_value, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS i,
 count(*) OVER (PARTITION BY symbol) AS n FROM {src}),
{p}n1 AS (SELECT *,
 CASE WHEN i >= 8 THEN (max(high) OVER (w ROWS 8 PRECEDING) + min(low) OVER (w ROWS 8 PRECEDING)) / 2.0 END AS tenkan,
 CASE WHEN i >= 25 THEN (max(high) OVER (w ROWS 25 PRECEDING) + min(low) OVER (w ROWS 25 PRECEDING)) / 2.0 END AS kijun,
 CASE WHEN i >= 51 THEN (max(high) OVER (w ROWS 51 PRECEDING) + min(low) OVER (w ROWS 51 PRECEDING)) / 2.0 END AS span_b,
 CASE WHEN count(volume) OVER p20 >= 10 THEN avg(volume) OVER p20 END AS avg_volume_20,
 CASE WHEN count(trade_value) OVER p20 >= 10 THEN avg(trade_value) OVER p20 END AS avg_value_20,
 lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc,
 CASE WHEN i >= 4 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS sma5,
 CASE WHEN i >= 19 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma20,
 CASE WHEN i >= 59 THEN avg(close) OVER (w ROWS 59 PRECEDING) END AS sma60,
 (close / lag(close, 5) OVER w - 1.0) * 100.0 AS return5_pct, (close / lag(close, 20) OVER w - 1.0) * 100.0 AS return20_pct,
 max(high) OVER (w ROWS 51 PRECEDING) AS high52,
 lag(high, 26) OVER w AS high26, lag(close, 26) OVER w AS close26,
 lead(open) OVER w AS entry, lead(close, 10) OVER w AS exit10,
 CASE WHEN count(low) OVER f10 = 10 THEN min(low) OVER f10 END AS future_low_10
 FROM {p}n0 WINDOW w AS (PARTITION BY symbol ORDER BY i), p20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
 f10 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
{p}n2 AS (SELECT *, (tenkan + kijun) / 2.0 AS span_a, volume / nullif(avg_volume_20, 0) AS volume_ratio,
 greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range,
 CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS plus_dm,
 CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS minus_dm,
 tenkan - kijun AS d FROM {p}n1),
{p}n3 AS (SELECT *, lag(span_a, 26) OVER w AS cloud_a, lag(span_b, 26) OVER w AS cloud_b,
 {wilder('true_range', 0)} AS atr14, {wilder('plus_dm', 0)} AS sp, {wilder('minus_dm', 0)} AS sm,
 {wilder('greatest(close - pc, 0)', 1)} AS gain, {wilder('greatest(pc - close, 0)', 1)} AS loss,
 (kijun / lag(kijun, 5) OVER w - 1.0) * 100.0 AS kchange, lag(d) OVER w AS pd
 FROM {p}n2 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
{p}n4 AS (SELECT *, greatest(cloud_a, cloud_b) AS cloud_top, least(cloud_a, cloud_b) AS cloud_bottom,
 CASE WHEN atr14 = 0 THEN 0 ELSE 100.0 * sp / atr14 END AS plus_di14, CASE WHEN atr14 = 0 THEN 0 ELSE 100.0 * sm / atr14 END AS minus_di14,
 CASE WHEN pd <= 0 AND d > 0 THEN 1 WHEN pd >= 0 AND d < 0 THEN -1 END AS crossed FROM {p}n3),
{p}n5 AS (SELECT *, CASE WHEN plus_di14 + minus_di14 = 0 THEN 0 ELSE 100.0 * abs(plus_di14 - minus_di14) / (plus_di14 + minus_di14) END AS dx,
 lag(cloud_top, 26) OVER w AS top26, lag(cloud_bottom, 26) OVER w AS bottom26, lag(cloud_top) OVER w AS ptop, lag(cloud_bottom) OVER w AS pbottom,
 coalesce(last_value(crossed IGNORE NULLS) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS recent_cross
 FROM {p}n4 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
{p}n6 AS (SELECT *, {wilder('dx', 13)} AS adx14,
 CASE WHEN gain IS NULL THEN NULL WHEN gain = 0 AND loss = 0 THEN 50.0 WHEN gain = 0 THEN 0.0 WHEN loss = 0 THEN 100.0
  ELSE 100.0 - 100.0 / (1.0 + gain / loss) END AS rsi14,
 CASE WHEN close > cloud_top THEN 'above' WHEN close < cloud_bottom THEN 'below' ELSE 'inside' END AS price_position,
 CASE WHEN span_a > span_b THEN 'bullish' WHEN span_a < span_b THEN 'bearish' ELSE 'neutral' END AS future_cloud,
 CASE WHEN tenkan > kijun THEN 'tenkan_above' WHEN tenkan < kijun THEN 'tenkan_below' ELSE 'equal' END AS tk_structure,
 CASE WHEN kchange > 0.15 THEN 'rising' WHEN kchange < -0.15 THEN 'falling' ELSE 'flat' END AS kijun_slope,
 CASE WHEN close > high26 AND (top26 IS NULL OR close > top26) THEN 'strong' WHEN close > close26 THEN 'partial'
  WHEN close < close26 AND (bottom26 IS NULL OR close < bottom26) THEN 'weak' ELSE 'mixed' END AS chikou_state,
 CASE WHEN recent_cross > 0 THEN 'cross_up' WHEN recent_cross < 0 THEN 'cross_down' WHEN tenkan > kijun THEN 'tenkan_over'
  WHEN tenkan < kijun THEN 'kijun_over' ELSE 'equal' END AS tk_state,
 CASE WHEN pc <= ptop AND close > cloud_top THEN 'up_break' WHEN pc >= pbottom AND close < cloud_bottom THEN 'down_break'
  WHEN close > cloud_top AND pc > coalesce(ptop, cloud_top) THEN 'settled_above'
  WHEN close < cloud_bottom AND pc < coalesce(pbottom, cloud_bottom) THEN 'staying_below' ELSE 'none' END AS kumo_breakout,
 CASE WHEN atr14 > 0 THEN (high - low) / atr14 ELSE 0 END AS candle_range_atr,
 greatest(0, (cloud_top - cloud_bottom) / close * 100.0) AS cloud_thickness_pct,
 CASE WHEN atr14 > 0 THEN abs(close - kijun) / atr14 ELSE 0 END AS kijun_distance_atr,
 coalesce(greatest(CASE WHEN tenkan < close THEN tenkan END, CASE WHEN kijun < close THEN kijun END, CASE WHEN cloud_top < close THEN cloud_top END,
  CASE WHEN cloud_bottom < close THEN cloud_bottom END), close * 0.94) * 0.99 AS research_invalidation_price,
 (exit10 / entry - 1.0) * 100.0 AS pattern_return_pct
 FROM {p}n5 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
{p}feat AS (SELECT *, {", ".join(f"CASE WHEN i >= 79 THEN {e} END AS f_{k}" for k, e in FEATURES.items())},
 future_low_10 <= research_invalidation_price AS pattern_hit FROM {p}n6)"""


def _pct(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0) - 1.0) * 100.0"


FEATURES = {
    "rsi14": "rsi14", "close_sma5_pct": _pct("close", "sma5"), "close_sma20_pct": _pct("close", "sma20"),
    "close_sma60_pct": _pct("close", "sma60"), "sma5_sma20_pct": _pct("sma5", "sma20"),
    "sma20_sma60_pct": _pct("sma20", "sma60"), "return5_pct": "return5_pct", "return20_pct": "return20_pct",
    "price_kijun_pct": _pct("close", "kijun"), "tenkan_kijun_pct": _pct("tenkan", "kijun"),
    "price_cloud_top_pct": _pct("close", "cloud_top"), "cloud_width_pct": "(cloud_top - cloud_bottom) / nullif(close, 0) * 100.0",
    "volume_ratio": "volume_ratio", "candle_range_pct": "(high - low) / nullif(close, 0) * 100.0",
    "atr14_pct": "atr14 / nullif(close, 0) * 100.0", "adx14": "adx14", "di_spread14": "plus_di14 - minus_di14",
}
STATES = ["price_position", "future_cloud", "tk_structure", "kijun_slope", "chikou_state"]


def rated(p: str = "") -> str:
    """Level-free rating on {p}feat as {p}rated (rows with 80 bars of history)."""
    arr = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in pairs) + "], lambda x: x IS NOT NULL)"
    ok = "coalesce(volume_ratio >= 1.0, false)"
    blocks = arr([("below_cloud", "price_position = 'below'"), ("inside_cloud", "price_position = 'inside'"),
                  ("weak_chikou", "chikou_state = 'weak'"), ("unconfirmed_break", f"kumo_breakout = 'up_break' AND NOT {ok}"),
                  ("long_candle", "candle_range_atr > 2.5"), ("far_from_base", "kijun_distance_atr > 3.0 AND close > kijun")])
    bull_adx, bear_adx = "adx14 >= 25 AND plus_di14 > minus_di14", "adx14 >= 25 AND minus_di14 > plus_di14"
    risks = arr([("sideways", "price_position = 'inside'"), ("tenkan_under", "tenkan < kijun"), ("falling_base", "kijun_slope = 'falling'"),
                 ("chikou_not_cleared", "chikou_state = 'mixed'"), ("bearish_future", "future_cloud = 'bearish'"),
                 ("adx_bearish", bear_adx), ("adx_weak", "adx14 < 18"), ("break_no_volume", f"kumo_breakout = 'up_break' AND NOT {ok}"),
                 ("long_candle", "candle_range_atr > 2.5"), ("far_from_base", "kijun_distance_atr > 3.0 AND close > kijun"),
                 ("many_crosses", "cross_count >= 3"), ("thin_cloud", "cloud_thickness_pct < 0.7")])
    reasons = arr([("above_cloud", "price_position = 'above'"), ("tenkan_over", "tenkan > kijun"), ("chikou_clear", "chikou_state = 'strong'"),
                   ("adx_bullish", bull_adx), ("break_with_volume", f"kumo_breakout = 'up_break' AND {ok}")])
    return f"""
{p}xs AS (SELECT a.symbol, a.i, b.i AS k, nullif(sign(b.d), 0) AS s FROM {p}feat a JOIN {p}feat b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 14 AND a.i
 WHERE a.i >= 79 AND b.d IS NOT NULL),
{p}xf AS (SELECT symbol, i, k, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol, i ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS s FROM {p}xs),
{p}xg AS (SELECT symbol, i, s, lag(s) OVER (PARTITION BY symbol, i ORDER BY k) AS ps FROM {p}xf),
{p}xc AS (SELECT symbol, i, count(*) FILTER (s <> ps) AS cross_count FROM {p}xg GROUP BY ALL),
{p}pts AS (SELECT f.*, x.cross_count,
 (price_position = 'above')::INT * 2 + (tenkan > kijun)::INT + (kijun_slope <> 'falling')::INT + (chikou_state = 'strong')::INT * 2
  + (future_cloud = 'bullish')::INT + ({bull_adx})::INT + (kumo_breakout = 'up_break' AND {ok})::INT * 2 AS bullish_score,
 (price_position = 'below')::INT * 2 + (tenkan < kijun)::INT + (kijun_slope = 'falling')::INT + (chikou_state = 'weak')::INT * 2
  + (future_cloud = 'bearish')::INT + ({bear_adx})::INT AS bearish_score
 FROM {p}feat f JOIN {p}xc x USING (symbol, i) WHERE i >= 79),
{p}rated AS (SELECT *, CASE WHEN price_position = 'above' AND tenkan > kijun AND kijun_slope <> 'falling' AND chikou_state = 'strong'
  AND future_cloud = 'bullish' AND kijun_distance_atr <= 3.0 THEN 'A+'
  WHEN price_position = 'above' AND bullish_score >= 5 AND chikou_state <> 'weak' THEN 'A'
  WHEN price_position = 'above' OR recent_cross > 0 THEN 'B' WHEN price_position = 'inside' THEN 'C' ELSE 'D' END AS grade,
 {blocks} AS base_blocks, {risks} AS base_risks, {reasons} AS base_reasons FROM {p}pts)"""


FEAT = f"WITH {BARS}, {chain()}"
RATED = f"{FEAT}, {rated()}"


def r4(*cols: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in cols)


def signals_cte(horizons=(1, 5, 10, 20)) -> str:
    """Level-free signals and their outcomes (splits included) on top of RATED."""
    parts = " UNION ALL ".join(f"""
 SELECT s.*, {h} AS horizon, p.entry AS entry_price, p.x{h} AS exit_price, (p.x{h} / p.entry - 1.0) * 100.0 AS forward_return_pct,
 (p.l{h} / p.entry - 1.0) * 100.0 AS mae_pct, (p.h{h} / p.entry - 1.0) * 100.0 AS mfe_pct, p.dd{h} AS max_drawdown_pct,
 p.l{h} <= s.research_invalidation_price AS invalidation_hit, (p.x{h} / p.entry - 1.0) * 100.0 <= -10.0 AS large_loss
 FROM sig s JOIN paths p USING (symbol, i)""" for h in horizons)
    cols = ", ".join(f"lead(close, {h}) OVER w AS x{h}, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS l{h}, "
                     f"max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS h{h}" for h in horizons)
    dd = ", ".join(f"min(CASE WHEN st.step <= {h} THEN (st.close / st.peak - 1.0) * 100.0 END) AS dd{h}" for h in horizons)
    return f"""
p0 AS (SELECT symbol, i, n, lead(open) OVER w AS entry, {cols} FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY i)),
st0 AS (SELECT a.symbol, a.i, a.entry, b.i - a.i AS step, b.close FROM p0 a JOIN feat b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + {max(horizons)} WHERE a.i >= 79),
st AS (SELECT *, greatest(entry, max(close) OVER (PARTITION BY symbol, i ORDER BY step ROWS UNBOUNDED PRECEDING)) AS peak FROM st0),
ddt AS (SELECT symbol, i, {dd.replace("min(CASE", "least(0.0, min(CASE").replace("END)", "END))")} FROM st GROUP BY ALL),
paths AS (SELECT p0.*, ddt.* EXCLUDE (symbol, i) FROM p0 JOIN ddt USING (symbol, i) WHERE i >= 79 AND i <= n - 1 - {max(horizons)}),
sig0 AS (SELECT market, symbol, i, session_date AS as_of, grade, CASE grade WHEN 'A+' THEN 'interest' WHEN 'A' THEN 'wait' WHEN 'B' THEN 'wait' ELSE 'avoid' END AS action,
 bullish_score - bearish_score AS technical_score, (bullish_score - bearish_score) * 2 - len(base_blocks) AS context_adjusted_score,
 research_invalidation_price FROM rated WHERE i <= n - 1 - {max(horizons)}),
dts AS (SELECT as_of, row_number() OVER (ORDER BY as_of) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT as_of FROM sig0)),
dsp AS (SELECT as_of, k, n, n - 40 AS u, greatest(60, CAST(floor((n - 40) * 0.6) AS BIGINT)) AS tr, greatest(60, CAST(floor((n - 40) * 0.2) AS BIGINT)) AS va FROM dts),
dsq AS (SELECT as_of, k, u, CASE WHEN va < 60 OR u - tr - va < 60 THEN u - 120 ELSE tr END AS tr, CASE WHEN va < 60 OR u - tr - va < 60 THEN 60 ELSE va END AS va FROM dsp),
spl AS (SELECT as_of, CASE WHEN u < 180 THEN 'insufficient' WHEN k < tr THEN 'train' WHEN k >= tr + 20 AND k < tr + 20 + va THEN 'validation'
 WHEN k >= tr + va + 40 AND k < u + 40 THEN 'test' ELSE 'purged' END AS split FROM dsq),
sig AS (SELECT sig0.*, split FROM sig0 JOIN spl USING (as_of)),
outc AS ({parts})"""


OUT = f"{RATED}, {signals_cte()}"


def performance(src: str, keys: list[str]) -> str:
    k = ", ".join([*keys, "horizon"])
    return f"""SELECT {k}, count(*) AS sample_count, count(DISTINCT as_of) AS unique_dates, round(avg(forward_return_pct), 4) AS mean_return_pct,
 round(median(forward_return_pct), 4) AS median_return_pct, round(avg((forward_return_pct > 0)::INT) * 100.0, 4) AS up_rate_pct,
 round(avg(mae_pct), 4) AS mean_mae_pct, round(avg(mfe_pct), 4) AS mean_mfe_pct, round(avg(max_drawdown_pct), 4) AS mean_max_drawdown_pct,
 round(avg(invalidation_hit::INT) * 100.0, 4) AS invalidation_rate_pct, round(avg(large_loss::INT) * 100.0, 4) AS large_loss_rate_pct,
 round(stddev_pop(forward_return_pct), 4) AS return_volatility_pct,
 round(CASE WHEN stddev_pop(forward_return_pct) > 0 THEN avg(forward_return_pct) / stddev_pop(forward_return_pct) END, 4) AS return_to_volatility
 FROM {src} GROUP BY {k}"""


SECTIONS = f"""{OUT}, lng AS (SELECT *, 'technical_score' AS score, technical_score::DOUBLE AS sv FROM outc WHERE horizon IN (5, 10, 20)
 UNION ALL SELECT *, 'context_adjusted_score', context_adjusted_score::DOUBLE FROM outc WHERE horizon IN (5, 10, 20)),
sec0 AS (SELECT *, count(*) OVER g AS cn, min(sv) OVER g AS lo, max(sv) OVER g AS hi FROM lng WINDOW g AS (PARTITION BY as_of, horizon, score)),
sec AS (SELECT *, rank() OVER (PARTITION BY as_of, horizon, score ORDER BY sv) + (count(*) OVER (PARTITION BY as_of, horizon, score, sv) - 1) / 2.0 AS sr,
 rank() OVER (PARTITION BY as_of, horizon, score ORDER BY forward_return_pct) + (count(*) OVER (PARTITION BY as_of, horizon, score, forward_return_pct) - 1) / 2.0 AS rr,
 (rank() OVER (PARTITION BY as_of, horizon, score ORDER BY sv DESC) + (count(*) OVER (PARTITION BY as_of, horizon, score, sv) - 1) / 2.0) / cn AS dp
 FROM sec0 WHERE cn >= 10 AND lo < hi)"""


def _frame(cols: str, src: str = FEAT, table: str = "feat") -> str:
    return f"{src} SELECT symbol, session_date, {cols} FROM {table}"


FLAGS = """price_position = 'above' AS price_above_cloud, tk_state IN ('tenkan_over', 'cross_up') AS tenkan_above_kijun,
 kijun_slope <> 'falling' AS kijun_nonfalling, chikou_state = 'strong' AS chikou_strong, future_cloud = 'bullish' AS future_cloud_bullish,
 adx14 >= 25 AND plus_di14 > minus_di14 AS adx_di_bullish, coalesce(volume_ratio >= 1, false) AS volume_confirmed,
 candle_range_atr > 2.5 OR (atr14 > 0 AND kijun_distance_atr > 3.0) AS atr_extension_block"""
FLAG_NAMES = ["price_above_cloud", "tenkan_above_kijun", "kijun_nonfalling", "chikou_strong", "future_cloud_bullish",
              "adx_di_bullish", "volume_confirmed", "atr_extension_block"]


def _correlations() -> str:
    from itertools import combinations
    parts = []
    for kind, names, pre, least in (("decision_signal", FLAG_NAMES, "", 3), ("similarity_feature", list(FEATURES), "f_", 20)):
        for a, b in combinations(names, 2):
            x, y = f"({pre}{a})::DOUBLE", f"({pre}{b})::DOUBLE"
            parts.append(f"""SELECT '{kind}' AS category, '{a}' AS signal_a, '{b}' AS signal_b, count(*) AS sample_count,
 CASE WHEN count(*) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END AS c
 FROM fl WHERE {pre}{a} IS NOT NULL AND {pre}{b} IS NOT NULL""")
    body = " UNION ALL ".join(parts)
    return f"""{RATED}, fl AS MATERIALIZED (SELECT *, {FLAGS} FROM rated), cc AS ({body})
 SELECT category, signal_a, signal_b, sample_count, round(c, 4) AS phi_correlation, round(abs(c), 4) AS absolute_correlation FROM cc"""


USABLE = "(" + " AND ".join(f"f_{c} IS NOT NULL" for c in FEATURES) + " AND pattern_return_pct IS NOT NULL)"
SAME = " AND ".join(f"c.{s} = h.{s}" for s in STATES)

SNAP = """ord AS (SELECT CAST(o_orderdate AS DATE) AS as_of, o_orderkey, o_custkey AS c,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'Brand#' || (o_custkey % 25 + 1) ELSE '*' END AS symbol,
 CASE WHEN o_orderpriority = '1-URGENT' THEN (CASE WHEN (o_custkey % 25 + 1) % 2 = 0 THEN 'KR' ELSE 'US' END)
  WHEN o_custkey % 2 = 0 THEN 'KR' ELSE 'US' END AS market FROM orders),
sn0 AS (SELECT market, as_of, symbol, (max(o_orderkey) % 101)::DOUBLE AS market_score, CASE WHEN min(c) % 9 <> 0 THEN (max(c) % 101)::DOUBLE END AS news_score,
 CASE WHEN min(c) % 8 <> 0 THEN ((count(*) * 17 + min(c)) % 101)::DOUBLE END AS event_risk, min(o_orderkey) % 24 AS h FROM ord GROUP BY ALL),
snap AS (SELECT *, as_of + to_hours(h::INT) AS generated_at, CAST(round_even((market_score * 0.55 + coalesce(news_score * 0.25, 0) + coalesce((100 - event_risk) * 0.2, 0))
 / (0.55 + CASE WHEN news_score IS NULL THEN 0 ELSE 0.25 END + CASE WHEN event_risk IS NULL THEN 0 ELSE 0.2 END), 0) AS INT) AS environment_score FROM sn0)"""
LADDER = """CASE WHEN environment_score >= 72 THEN 'very_favourable' WHEN environment_score >= 60 THEN 'favourable'
 WHEN environment_score >= 45 THEN 'neutral' WHEN environment_score >= 35 THEN 'burden' ELSE 'heavy_burden' END"""
VISIBLE = """vis0 AS (SELECT b.market, b.symbol, b.session_date, CASE WHEN o.symbol IS NOT NULL THEN o.environment_score ELSE w.environment_score END AS es,
 CASE WHEN o.symbol IS NOT NULL THEN o.event_risk ELSE w.event_risk END AS er,
 CASE WHEN o.symbol IS NOT NULL THEN o.generated_at ELSE w.generated_at END AS g FROM bars b
 LEFT JOIN snap o ON o.market = b.market AND o.symbol = b.symbol AND o.as_of = b.session_date
 LEFT JOIN snap w ON w.market = b.market AND w.symbol = '*' AND w.as_of = b.session_date),
vis AS (SELECT market, symbol, session_date, CASE WHEN ok THEN es END AS environment_score, CASE WHEN ok THEN er::INT END AS event_risk FROM
 (SELECT *, (g AT TIME ZONE 'UTC') <= (CASE market WHEN 'US' THEN (session_date + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York'
  ELSE (session_date + INTERVAL 930 MINUTE) AT TIME ZONE 'Asia/Seoul' END) AS ok FROM vis0))"""

TRUST_CORE = "coalesce(volume_ratio > 0.2, false) AND close > 20000 AND close > 10000 AND grade <> 'D' AND price_position <> 'inside'"
BLOCKERS = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in [
    ("market_proxies", "volume_ratio > 0.2"), ("universe_snapshots", "close > 20000"), ("historical_universe_verified", "close > 10000"),
    ("delisted_securities_included", "grade <> 'D'"), ("exchange_calendar_verified", "kijun_slope <> 'flat'"),
    ("intelligence_complete", "price_position <> 'inside'"), ("independent_dates_sufficient", "tk_state <> 'kijun_over'")]) + ")"
STANCE = "CASE WHEN grade IN ('A+', 'A') AND price_position = 'above' THEN 'strong' WHEN price_position = 'below' OR grade = 'D' THEN 'weak' ELSE 'neutral' END"
METRICS = """mc0 AS (SELECT market, symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r FROM bars),
mc AS (SELECT market, symbol, max(close) FILTER (r = 1) AS latest, max(close) FILTER (r = 2) AS one, arg_max(close, r) AS five FROM mc0 WHERE r <= 6 GROUP BY ALL),
chg AS (SELECT market, symbol, latest, (latest / one - 1.0) * 100.0 AS change_1d_pct, (latest / five - 1.0) * 100.0 AS change_5d_pct,
 CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INT) AS num FROM mc)"""


def oracles() -> dict[str, str]:
    perf = performance
    return {
        "cloud_position": f"{FEAT} SELECT symbol, price_position, count(*) AS sessions FROM feat WHERE i >= 79 GROUP BY ALL",
        "flt1_bar_validity": f"""WITH {BARS} SELECT market, symbol, count(*) AS sessions, 0 AS bad_price_rows,
 CASE WHEN count(*) < 80 THEN 'too_few_sessions' ELSE 'usable' END AS verdict, round(sum(close * volume / 1e6), 2) AS value_millions FROM bars GROUP BY market, symbol""",
        "flt1_minute_validity": """SELECT CASE WHEN event_type IN ('click', 'view', 'error') THEN 'US' ELSE 'KR' END AS market, event_type AS symbol,
 count(*) FILTER (value <= 0) AS bad_price_rows, count(DISTINCT CAST(ts AS DATE)) AS sessions,
 CASE WHEN count(*) FILTER (value <= 0) > 0 THEN 'invalid_prices' WHEN count(DISTINCT CAST(ts AS DATE)) < 80 THEN 'too_few_sessions' ELSE 'usable' END AS verdict
 FROM events GROUP BY event_type""",
        "win_i1_lines": _frame(r4("tenkan", "kijun")),
        "win_i2_spans": _frame(r4("span_a", "span_b")),
        "win_i3_cloud": _frame(r4("cloud_a", "cloud_b", "cloud_top", "cloud_bottom")),
        "win_i4_liquidity": _frame("round(avg_volume_20, 7) AS avg_volume_20, round(avg_value_20 / 1e6, 7) AS avg_value_20, round(volume_ratio, 7) AS volume_ratio"),
        "win_i5_volume_ratio": _frame(r4("volume_ratio")),
        "win_i6_true_range": _frame(r4("true_range")),
        "win_i7_atr": _frame(r4("atr14")),
        "win_i8_di": _frame(r4("plus_dm", "minus_dm", "plus_di14", "minus_di14")),
        "win_i9_adx": _frame(r4("dx", "adx14")),
        "win_i10_rsi": _frame(r4("rsi14")),
        "win_i11_sma": _frame(r4("sma5", "sma20", "sma60")),
        "win_i12_distances": _frame(r4("f_close_sma5_pct", "f_close_sma20_pct", "f_close_sma60_pct", "f_sma5_sma20_pct",
                                       "f_price_kijun_pct", "f_tenkan_kijun_pct", "f_price_cloud_top_pct")),
        "win_i13_momentum": _frame(r4("return5_pct", "return20_pct")),
        "win_i14_slope": _frame("kijun_slope"),
        "win_i15_lagging": _frame("chikou_state"),
        "win_i16_features": _frame(r4(*[f"f_{c}" for c in FEATURES])),
        "win_i17_invalidation": _frame("round(research_invalidation_price, 8) AS research_invalidation_price"),
        "win_i18_metric_changes": f"WITH {BARS}, {METRICS} SELECT symbol, {r4('latest', 'change_1d_pct', 'change_5d_pct')} FROM chg",
        "win_x1_recent_cross": _frame("recent_cross, tk_state", RATED, "rated"),
        "win_x2_cross_count": _frame("cross_count", RATED, "rated"),
        "win_x3_breakout": _frame("kumo_breakout", RATED, "rated"),
        "win_x6_high52": _frame(r4("high52")),
        "win_f1_f2_f3_labels": _frame("pattern_hit, " + r4("future_low_10", "pattern_return_pct")),
        "win_f4_f5_f6_paths": f"""{OUT} SELECT symbol, as_of, horizon, invalidation_hit, large_loss,
 {r4('entry_price', 'exit_price', 'forward_return_pct', 'mae_pct', 'mfe_pct', 'max_drawdown_pct')} FROM outc""",
        "join17_signal_paths": f"""{OUT} SELECT symbol, horizon, count(*) AS signals, count(*) FILTER (invalidation_hit) AS hits,
 count(*) FILTER (large_loss) AS large_losses, round(avg(max_drawdown_pct), 4) AS mean_drawdown, round(avg(mae_pct), 4) AS mean_mae,
 round(avg(mfe_pct), 4) AS mean_mfe, round(avg(forward_return_pct), 4) AS mean_return FROM outc GROUP BY symbol, horizon""",
        "flt22_decision_grid": f"""WITH {BARS}, n AS (SELECT symbol, session_date, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS i,
 count(*) OVER (PARTITION BY symbol) AS n FROM bars), g AS (SELECT *, i >= 79 AND (i - 79) % 5 = 0 AND i <= n - 21 AS ok FROM n)
 SELECT symbol, count(*) FILTER (ok) AS decisions, min(session_date) FILTER (ok) AS first, max(session_date) FILTER (ok) AS last FROM g GROUP BY symbol""",
        "rul1_points": _frame("bullish_score, bearish_score", RATED, "rated"),
        "rul2_codes": _frame("base_blocks, base_risks, base_reasons", RATED, "rated"),
        "rul3_grade": _frame("grade", RATED, "rated"),
        "rul10_rul12_scores": f"""{RATED}, {SNAP}, {VISIBLE}, t AS (SELECT r.symbol, r.session_date, grade, len(base_blocks) AS nb, environment_score AS es, event_risk AS er,
 greatest(0, least(100, CASE grade WHEN 'A+' THEN 90 WHEN 'A' THEN 80 WHEN 'B' THEN 65 WHEN 'C' THEN 45 ELSE 25 END
  + CASE len(base_blocks) WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE -5 END - least(20, len(base_blocks) * 6))) AS ts FROM rated r JOIN vis USING (market, symbol, session_date))
 SELECT symbol, session_date, ts AS technical_score, CASE WHEN es IS NULL THEN ts ELSE CAST(round_even(ts::DOUBLE * 0.65::DOUBLE + es::DOUBLE * 0.35::DOUBLE, 0) AS INT) END AS context_adjusted_score,
 CASE WHEN grade = 'A+' AND nb = 0 THEN CASE WHEN es IS NOT NULL AND (coalesce(er >= 75, false) OR es < 42) THEN 'wait' ELSE 'interest' END
  WHEN grade IN ('A+', 'A', 'B') THEN 'wait' ELSE 'avoid' END AS final_action FROM t""",
        "rul13_watch_state": f"""{RATED}, {COUNTS_CTE} SELECT r.symbol,
 CASE WHEN greatest(kijun, cloud_top) <= research_invalidation_price THEN 'INVALID_WATCH_ZONE' WHEN greatest(kijun, cloud_top) > close THEN 'RECOVERY_TRIGGER' ELSE 'WATCH_SUPPORT' END AS state,
 CASE WHEN candidate_count < 10 THEN 'too_few' WHEN candidate_count < 20 THEN 'reference_only' ELSE 'limited_reference' END AS note, count(*) AS rows
 FROM rated r JOIN cnt USING (symbol, session_date) GROUP BY ALL""",
        "rul14_environment": f"WITH {SNAP} SELECT market, as_of, symbol, environment_score, {LADDER} AS environment_label FROM snap",
        "rul15_news_blend": f"""WITH {SNAP} SELECT o.market, o.as_of, o.symbol, CAST(CASE WHEN o.news_score IS NOT NULL AND w.news_score IS NOT NULL
 THEN round_even(o.news_score * 0.7::DOUBLE + w.news_score * 0.3::DOUBLE, 0) ELSE coalesce(o.news_score, w.news_score) END AS INT) AS news,
 o.environment_score, {LADDER.replace('environment_score', 'o.environment_score')} AS environment_label
 FROM snap o LEFT JOIN snap w ON w.market = o.market AND w.as_of = o.as_of AND w.symbol = '*' WHERE o.symbol <> '*'""",
        "rul17_neutralised": f"""WITH {SNAP} SELECT market, as_of, symbol,
 CAST(round_even((market_score * 0.55::DOUBLE + 12.5 + coalesce((100 - event_risk) * 0.2::DOUBLE, 0)) / (0.8::DOUBLE + CASE WHEN event_risk IS NULL THEN 0 ELSE 0.2::DOUBLE END), 0) AS INT) AS without_news,
 CAST(round_even((market_score * 0.55::DOUBLE + coalesce(news_score * 0.25::DOUBLE, 0) + 17.0) / (0.75::DOUBLE + CASE WHEN news_score IS NULL THEN 0 ELSE 0.25::DOUBLE END), 0) AS INT) AS without_events FROM snap""",
        "rul19_signal_projection": f"{RATED} SELECT symbol, session_date, {FLAGS}, {r4(*[f'f_{c}' for c in FEATURES])} FROM rated",
        "agg1_performance": f"{OUT} {perf('outc', ['grade', 'split'])}",
        "agg2_baseline": f"{OUT} {perf('outc', [])}",
        "agg2_by_action": f"{OUT} {perf('outc', ['action'])}",
        "agg3_walk_forward": f"{OUT}, wf AS (SELECT * FROM outc WHERE split IN ('train', 'validation', 'test')) {perf('wf', ['split', 'action'])}",
        "agg4_rank_ic": f"""{SECTIONS}, ic AS (SELECT as_of, horizon, score, corr(sr, rr) AS c FROM sec GROUP BY ALL)
 SELECT horizon, score, count(DISTINCT as_of) AS date_count, round(avg(c), 4) AS mean_spearman, round(median(c), 4) AS median_spearman FROM ic GROUP BY horizon, score""",
        "agg5_rank_groups": f"""{SECTIONS}, grp AS (SELECT *, score AS ranking_score, unnest(list_filter([CASE WHEN dp <= 0.05 THEN 'Top 5%' END, CASE WHEN dp <= 0.10 THEN 'Top 10%' END,
 CASE WHEN dp <= 0.20 THEN 'Top 20%' END, CASE WHEN dp > 0.80 THEN 'Bottom 20%' END], lambda x: x IS NOT NULL)) AS rank_group FROM sec) {perf('grp', ['ranking_score', 'rank_group'])}""",
        "agg6_action_ordering": f"""{OUT}, a AS (SELECT action, horizon, avg(forward_return_pct) AS m, median(forward_return_pct) AS d, avg((forward_return_pct > 0)::INT) AS u FROM outc GROUP BY ALL),
 p AS (SELECT horizon, max(m) FILTER (action = 'interest') AS m1, max(m) FILTER (action = 'wait') AS m2, max(m) FILTER (action = 'avoid') AS m3,
 max(d) FILTER (action = 'interest') AS d1, max(d) FILTER (action = 'wait') AS d2, max(d) FILTER (action = 'avoid') AS d3,
 max(u) FILTER (action = 'interest') AS u1, max(u) FILTER (action = 'wait') AS u2, max(u) FILTER (action = 'avoid') AS u3 FROM a GROUP BY horizon)
 SELECT horizon, 'evaluated' AS status, '' AS missing_actions, m1 > m2 AND m2 > m3 AS mean_return_order_pass, d1 > d2 AND d2 > d3 AS median_return_order_pass,
 u1 > u2 AND u2 > u3 AS up_rate_order_pass, round(m1, 4) AS interest_mean_return_pct, round(m2, 4) AS wait_mean_return_pct, round(m3, 4) AS avoid_mean_return_pct FROM p""",
        "agg7_ablation": f"""{OUT}, v AS (SELECT *, 'grade_only' AS family, 'projected' AS st, CASE WHEN grade IN ('A+', 'A') THEN 'interest' ELSE 'avoid' END AS va FROM outc
 UNION ALL SELECT *, 'fixed', 'missing_pit_snapshots', action FROM outc),
 w AS (SELECT family, st, 'all' AS sp, horizon, action, va, forward_return_pct AS r FROM v UNION ALL SELECT family, st, split, horizon, action, va, forward_return_pct FROM v WHERE split IN ('train', 'validation', 'test')),
 g AS (SELECT family, st AS status, sp AS split, horizon, count(*) FILTER (action = 'interest') AS bc, count(*) FILTER (va = 'interest') AS vc,
 avg(r) FILTER (action = 'interest') AS bm, avg(r) FILTER (va = 'interest') AS vm, stddev_pop(r) FILTER (action = 'interest') AS bs, stddev_pop(r) FILTER (va = 'interest') AS vs FROM w GROUP BY ALL)
 SELECT family, status, split, horizon, bc AS baseline_interest_count, vc AS ablated_interest_count, round(bm, 4) AS baseline_mean_return_pct,
 CASE WHEN family <> 'fixed' THEN round(vm, 4) END AS ablated_mean_return_pct, CASE WHEN family <> 'fixed' THEN round(vm - bm, 4) END AS mean_return_delta_pct,
 round(CASE WHEN bs > 0 THEN bm / bs END, 4) AS baseline_return_to_volatility, CASE WHEN family <> 'fixed' AND vs > 0 THEN round(vm / vs, 4) END AS ablated_return_to_volatility,
 CASE WHEN family <> 'fixed' AND vs > 0 AND bs > 0 THEN round(vm / vs - bm / bs, 4) END AS return_to_volatility_delta FROM g""",
        "agg8_correlations": _correlations(),
        "agg10_quartiles": f"""{OUT}, e AS (SELECT horizon, quantile_cont(mae_pct, [0.25, 0.5, 0.75]) AS q FROM outc GROUP BY horizon HAVING min(mae_pct) < q[1] AND q[1] < q[2] AND q[2] < q[3] AND q[3] < max(mae_pct)),
 l AS (SELECT horizon, mae_pct, CASE WHEN mae_pct <= q[1] THEN 'Q1' WHEN mae_pct <= q[2] THEN 'Q2' WHEN mae_pct <= q[3] THEN 'Q3' ELSE 'Q4' END AS quartile FROM outc JOIN e USING (horizon))
 SELECT horizon, quartile, count(*) AS rows, round(min(mae_pct), 4) AS low, round(max(mae_pct), 4) AS high FROM l GROUP BY ALL""",
        "agg12_robust_scale": f"""{FEAT}, cur AS (SELECT * FROM feat WHERE i = n - 1),
 cand AS (SELECT h.* FROM cur c JOIN feat h ON c.symbol = h.symbol AND {SAME} AND h.i <= c.i - 10 WHERE {USABLE.replace('f_', 'h.f_').replace('pattern_return_pct', 'h.pattern_return_pct')}),
 lng AS (""" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, f_{c} AS x FROM cand" for c in FEATURES) + """),
 md AS (SELECT symbol, feature, median(x) AS m, stddev_pop(x) AS sd, count(x) AS candidates FROM lng GROUP BY ALL),
 ma AS (SELECT l.symbol, l.feature, sd, candidates, median(abs(x - m)) * 1.4826 AS mad FROM lng l JOIN md USING (symbol, feature) GROUP BY ALL)
 SELECT symbol, feature, candidates, round(CASE WHEN (CASE WHEN mad > 1e-8 THEN mad ELSE sd END) > 1e-8 THEN (CASE WHEN mad > 1e-8 THEN mad ELSE sd END) ELSE 1.0 END, 4) AS scale FROM ma""",
        "agg12_decision_scales": f"{FEAT}, {SCALES} SELECT symbol, session_date, {_NAMES}[f] AS feature, candidates, round(scale, 4) AS scale FROM sc",
        "top4_neighbors": f"""{FEAT}, {NEAREST} SELECT market, symbol, i::INT AS i, k::INT AS neighbor_i, round(largest, 4) AS distance, round(ret, 4) AS pattern_return_pct, hit AS pattern_hit FROM near""",
        "agg13_pattern_summary": f"""{FEAT}, {NEAREST},
 turn AS (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY k DESC) AS age, count(*) OVER (PARTITION BY symbol, i) AS n FROM near),
 g AS (SELECT symbol, i, count(*) AS n, count(*) FILTER (ret > 0) AS up, median(ret) AS med, min(largest) AS nearest, avg(ret) FILTER (ret > 0) AS au, avg(ret) FILTER (ret <= 0) AS ad,
  count(*) FILTER (hit) AS inv, avg(ret) AS mean, quantile_cont(ret, 0.25) AS p25, count(*) FILTER (age <= greatest(1, ceil(n * 0.25))) AS rn, count(*) FILTER (age <= greatest(1, ceil(n * 0.25)) AND ret > 0) AS ru FROM turn GROUP BY symbol, i)
 SELECT c.symbol, c.session_date, coalesce(g.n, 0)::INT AS sample_count, coalesce(up, 0)::INT AS up_count, round(up / g.n * 100.0, 4) AS up_rate, round(med, 4) AS median_return_pct, coalesce(rn, 0)::INT AS recent_sample_count,
  coalesce(ru, 0)::INT AS recent_up_count, round(ru / rn * 100.0, 4) AS recent_up_rate, round(nearest, 4) AS nearest_distance,
  CASE WHEN NOT ({' AND '.join(f'c.f_{c} IS NOT NULL' for c in FEATURES)} AND history_count >= 25) THEN 'too_little_history' WHEN g.n IS NULL THEN 'no_match' WHEN g.n < 15 THEN 'small_sample' WHEN g.n < 25 THEN 'caution'
   WHEN up / g.n * 100.0 >= 65 AND ru / rn * 100.0 >= 50 THEN 'favourable' WHEN up / g.n * 100.0 < 45 THEN 'unfavourable' ELSE 'no_edge' END AS similarity_status,
  candidate_count, round(au, 4) AS average_up_return_pct, round(ad, 4) AS average_down_return_pct, coalesce(inv, 0)::INT AS invalidation_count, round(inv / g.n * 100.0, 4) AS invalidation_rate,
  round(mean, 4) AS expected_return_pct, round(p25, 4) AS downside_p25_pct, round(au / abs(nullif(ad, 0)), 4) AS payoff_ratio
 FROM us c JOIN cnt USING (symbol, i) LEFT JOIN g USING (symbol, i) WHERE c.i >= 79 AND c.i <= c.n - 1 - 20""",
        "agg14_weekly": f"WITH {BARS}, {WEEKLY} SELECT symbol, session_date, open, high, low, close, volume, round(trade_value / 1e6, 6) AS trade_value FROM wk",
        "agg15_profile": f"""WITH {BARS}, n AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS i, (high + low + close) / 3.0 AS p, volume FROM bars),
 e AS (SELECT a.symbol, a.i, b.p, b.volume FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 139 AND a.i WHERE a.i >= 79),
 r AS (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi FROM e WINDOW w AS (PARTITION BY symbol, i)),
 q AS (SELECT *, CAST(least(floor((p - lo) / (hi - lo) * 18), 17) AS INT) AS k, (hi - lo) / 18 AS st FROM r),
 z AS (SELECT symbol, i, volume, CASE WHEN p < lo + k * st THEN k - 1 WHEN p >= lo + (k + 1) * st AND k <> 17 THEN k + 1 ELSE k END AS bin FROM q),
 t AS (SELECT symbol, bin, sum(volume) AS volume FROM z GROUP BY ALL)
 SELECT s.symbol, b.bin, coalesce(t.volume, 0) AS volume FROM (SELECT DISTINCT symbol FROM z) s CROSS JOIN (SELECT unnest(range(18))::INT AS bin) b LEFT JOIN t ON t.symbol = s.symbol AND t.bin = b.bin""",
        "agg16_market_score": f"""WITH {BARS}, {METRICS}, c AS (SELECT market, (CASE WHEN num % 3 = 0 THEN -1.0 ELSE 1.0 END) * (0.65 * greatest(-1, least(1, change_1d_pct / 80.0)) + 0.35 * greatest(-1, least(1, change_5d_pct / 200.0)))
 * (0.35 + (num % 5) * 0.25) AS v, 0.35 + (num % 5) * 0.25 AS w FROM chg)
 SELECT market, CAST(round_even(greatest(0, least(100, 50 + sum(v) / greatest(1, sum(w)) * 34)), 0) AS INT) AS market_score FROM c GROUP BY market""",
        "agg27_trust": f"""{RATED} SELECT CASE WHEN i < 100 THEN 'NOT_EVALUABLE' WHEN NOT ({TRUST_CORE}) THEN 'EXPLORATORY'
 WHEN NOT (kijun_slope <> 'flat' AND tk_state <> 'kijun_over') THEN 'PARTIALLY_TRUSTED' ELSE 'TRUSTED' END AS trust_level, {BLOCKERS} AS blockers, count(*) AS rows FROM rated GROUP BY ALL""",
        "agg30_join6_market_context": f"""WITH {BARS}, {PROXY}, {chain('proxybars', 'x')}, {rated('x')},
 s AS (SELECT market, session_date, symbol IN ('SPY', 'KOSPI') AS first, {STANCE} AS st FROM xrated),
 days AS (SELECT DISTINCT market, session_date FROM bars)
 SELECT d.market, d.session_date, CASE WHEN a.st IS NULL OR b.st IS NULL THEN 'unknown' WHEN a.st = 'strong' AND b.st = 'strong' THEN 'both_up'
 WHEN a.st = 'weak' AND b.st = 'weak' THEN 'both_weak' ELSE 'mixed' END AS market_context FROM days d
 ASOF LEFT JOIN (SELECT * FROM s WHERE first) a ON d.market = a.market AND d.session_date >= a.session_date
 ASOF LEFT JOIN (SELECT * FROM s WHERE NOT first) b ON d.market = b.market AND d.session_date >= b.session_date""",
        "win_r3_average_rank": f"""{SECTIONS} SELECT symbol, horizon, score, count(*) AS n, round(sum(sr), 4) AS score_rank, round(sum(rr), 4) AS return_rank,
 round(sum(dp), 4) AS descending_pct FROM sec GROUP BY symbol, horizon, score""",
        "win_s1_splits": f"{OUT} SELECT as_of, split FROM spl",
        "join18_split_join": f"{OUT} SELECT split, horizon, count(*) AS rows FROM outc GROUP BY ALL",
        "join7_weekly_as_of": f"""WITH {BARS}, {WEEKLY}, {chain('wk', 'w')}, {rated('w')},
 wd AS (SELECT symbol, session_date AS week, CASE WHEN grade IN ('A+', 'A') AND price_position = 'above' THEN 'up' WHEN price_position = 'below' OR grade = 'D' THEN 'down' ELSE 'unclear' END AS weekly_direction FROM wrated),
 n AS (SELECT symbol, session_date, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS i FROM bars)
 SELECT n.symbol, n.session_date, weekly_direction FROM n ASOF LEFT JOIN wd ON n.symbol = wd.symbol AND n.session_date >= wd.week WHERE i >= 79""",
        "join13_candidates": f"{FEAT}, {COUNTS_CTE} SELECT symbol, session_date, history_count, candidate_count FROM cnt",
        "join10_flt17_intelligence": f"WITH {BARS}, {SNAP}, {VISIBLE} SELECT symbol, session_date, environment_score, event_risk FROM vis",
        "flt16_liquidity_gate": f"""{FEAT} SELECT market, symbol, CASE WHEN avg_value_20 IS NULL OR avg_value_20 < CASE market WHEN 'US' THEN 2e7 ELSE 5e9 END THEN 'low_trade_value'
 WHEN avg_volume_20 IS NULL OR avg_volume_20 < CASE market WHEN 'US' THEN 2e5 ELSE 1e5 END THEN 'low_volume' ELSE 'liquid' END AS reason, count(*) AS rows FROM feat WHERE i >= 79 GROUP BY ALL""",
    }


_NAMES = "[" + ", ".join(f"'{c}'" for c in FEATURES) + "]"
_VALUES = lambda t: "[" + ", ".join(f"{t}.f_{c}" for c in FEATURES) + "]"
#: Every decision row with its same-state candidates, feature by feature, and the robust scale of each feature.
SCALES = f"""us AS (SELECT *, {USABLE} AS usable FROM feat),
cnt AS (SELECT c.symbol, c.i, count(h.i) AS history_count, count(h.i) FILTER ({SAME}) AS candidate_count
 FROM us c LEFT JOIN (SELECT * FROM us WHERE usable) h ON c.symbol = h.symbol AND h.i <= c.i - 10 WHERE c.i >= 79 GROUP BY ALL),
cand AS (SELECT c.market, c.symbol, c.session_date, c.i, h.i AS k, {_VALUES('c')} AS cx, {_VALUES('h')} AS hx, h.pattern_return_pct AS ret, h.pattern_hit AS hit
 FROM us c JOIN us h ON c.symbol = h.symbol AND {SAME} AND h.i <= c.i - 10 AND h.usable WHERE c.i >= 79 AND c.i <= c.n - 1 - 20),
lng AS (SELECT symbol, session_date, i, k, f, hx[f] AS x, cx[f] AS y FROM cand, range(1, {len(FEATURES)} + 1) AS r(f)),
md AS (SELECT symbol, i, f, median(x) AS m, stddev_pop(x) AS sd, count(x) AS candidates FROM lng GROUP BY ALL),
ma AS (SELECT l.symbol, l.session_date, l.i, l.f, sd, candidates, median(abs(x - m)) * 1.4826 AS mad FROM lng l JOIN md USING (symbol, i, f) GROUP BY ALL),
sc AS (SELECT *, CASE WHEN (CASE WHEN mad > 1e-8 THEN mad ELSE sd END) > 1e-8 THEN (CASE WHEN mad > 1e-8 THEN mad ELSE sd END) ELSE 1.0 END AS scale FROM ma)"""
#: Nearest candidates by the largest, then the mean scaled difference, each more than ten rows from those taken before.
NEAREST = f"""{SCALES},
ready AS (SELECT c.symbol, c.i FROM us c JOIN cnt USING (symbol, i) WHERE history_count >= 25 AND candidate_count > 0 AND {' AND '.join(f'c.f_{c} IS NOT NULL' for c in FEATURES)}),
dist AS (SELECT l.symbol, l.i, l.k, max(abs((x - y) / scale)) AS largest, avg(abs((x - y) / scale)) AS mean FROM lng l JOIN sc USING (symbol, i, f) JOIN ready USING (symbol, i) GROUP BY ALL),
kept AS (SELECT symbol, i, unnest(list_reduce(list_transform(list(k ORDER BY largest, mean, k), lambda x: [x]),
  lambda acc, x: CASE WHEN len(acc) < 30 AND len(list_filter(acc, lambda y: abs(y - x[1]) <= 10)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM dist GROUP BY symbol, i),
near AS (SELECT c.market, c.symbol, c.session_date, c.i, c.k, d.largest, c.ret, c.hit FROM kept JOIN cand c USING (symbol, i, k) JOIN dist d USING (symbol, i, k))"""

COUNTS_CTE = f"""us AS (SELECT *, {USABLE} AS usable FROM feat),
cnt AS (SELECT c.symbol, c.session_date, count(h.i) AS history_count, count(h.i) FILTER ({SAME}) AS candidate_count
 FROM us c LEFT JOIN (SELECT * FROM us WHERE usable) h ON c.symbol = h.symbol AND h.i <= c.i - 10 WHERE c.i >= 79 GROUP BY ALL)"""
