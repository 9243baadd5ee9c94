"""DuckDB statements for datasets, universes, clocks."""

from barlens.functions import fixed_values as fixed
from oracles.bars_sql import BARS, ORDER, PER_BAR, PROXY
from oracles.bars_sql import SNAP

NUM = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INT)"
CAL = "cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date FROM orders)"
ARRIVE = f"""dv AS (SELECT {PER_BAR} AS market, p_brand AS symbol, CAST(l_shipdate AS DATE) AS session_date, l_extendedprice AS open,
 CASE WHEN l_tax = 0.08 THEN l_extendedprice * 0.9 ELSE l_extendedprice END AS high, l_extendedprice AS low, CASE WHEN l_discount = 0.1 THEN 0.0 ELSE l_extendedprice END AS close,
 CASE WHEN l_quantity = 50 THEN -1.0 ELSE l_quantity END AS volume, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS num FROM lineitem JOIN part ON l_partkey = p_partkey)"""
GAPS = f"""rng AS (SELECT symbol, min(session_date) AS lo, max(session_date) AS hi FROM src GROUP BY symbol),
grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS session_date FROM rng),
act AS (SELECT DISTINCT symbol, session_date FROM src),
mis AS (SELECT g.symbol, g.session_date, 'missing_exchange_session' AS code FROM grid g JOIN cal USING (session_date) ANTI JOIN act a ON a.symbol = g.symbol AND a.session_date = g.session_date),
ext AS (SELECT a.symbol, a.session_date, 'non_session_date' AS code FROM act a ANTI JOIN cal ON cal.session_date = a.session_date),
gp AS (SELECT * FROM mis UNION ALL SELECT * FROM ext)"""
GAP_ROWS = f"""lg AS (SELECT symbol, close, session_date, lag(close) OVER (PARTITION BY symbol ORDER BY session_date) AS pc FROM bars)"""
MASTER = """ms AS (SELECT 'P' || lpad(p_partkey::VARCHAR, greatest(length(p_partkey::VARCHAR), 5)::INT, '0') AS symbol, p_partkey, CASE p_size % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' ELSE 'AMEX' END AS exchange,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') || CASE WHEN p_size % 11 = 0 THEN ' Warrants' WHEN p_size % 7 = 0 THEN ' Corp Preferred' ELSE ' Corp' END AS english_name,
 p_brand || CASE WHEN p_size % 13 = 0 THEN '우' ELSE '' END AS korean_name, CASE WHEN p_size % 17 = 0 THEN '' ELSE p_type END AS sector, p_size % 19 = 0 AS is_etf, p_retailprice, p_size FROM part)"""
COMMON = "NOT is_etf AND NOT (p_size % 11 = 0 OR p_size % 7 = 0)"
RANKS = f"""{MASTER}, tv AS (SELECT l_partkey, sum(l_quantity * 100) AS u, max(l_extendedprice) AS mc, count(*) AS c FROM lineitem GROUP BY l_partkey),
rk0 AS (SELECT 'cap' AS kind, exchange, symbol, abs(mc / 1000 - 80) AS price, mc AS amount FROM tv JOIN ms ON l_partkey = p_partkey WHERE c >= 20
 UNION ALL SELECT 'value', exchange, symbol, abs(mc / 1000 - 80), u FROM tv JOIN ms ON l_partkey = p_partkey WHERE u >= 60000),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY amount DESC, symbol) AS position FROM rk0)),
bl AS (SELECT coalesce(a.exchange, b.exchange) AS exchange, coalesce(a.symbol, b.symbol) AS symbol, a.position AS cap_rank, b.position AS value_rank, a.amount * 1000.0 AS market_cap_usd,
 b.amount * 1000.0 AS trade_value_usd, coalesce(a.price, b.price) AS price FROM (SELECT * FROM rk WHERE kind = 'cap') a FULL JOIN (SELECT * FROM rk WHERE kind = 'value') b ON a.exchange = b.exchange AND a.symbol = b.symbol),
cd AS (SELECT bl.*, m.sector, CASE WHEN m.symbol IS NULL THEN 'unverified' WHEN price < 5 OR NOT ({COMMON}) THEN 'excluded' ELSE 'candidate' END AS verdict,
 coalesce(greatest(0, 400.0 - cap_rank), 0) + coalesce(greatest(0, 450.0 - value_rank), 0) + CASE WHEN cap_rank IS NOT NULL AND value_rank IS NOT NULL THEN 120.0 ELSE 0 END
 + CASE WHEN market_cap_usd > 0 THEN least(120.0, log10(market_cap_usd) * 10.0) ELSE 0 END + CASE WHEN trade_value_usd > 0 THEN least(100.0, log10(trade_value_usd) * 9.0) ELSE 0 END AS rank_score
 FROM bl LEFT JOIN (SELECT * FROM ms WHERE p_partkey % 23 <> 0) m ON m.exchange = bl.exchange AND m.symbol = bl.symbol),
ok AS (SELECT symbol, sector, round(rank_score, 4) AS rank_score, CASE WHEN coalesce(sector, '') = '' THEN 12 ELSE 24 END AS cap,
 row_number() OVER (PARTITION BY coalesce(sector, '') ORDER BY round(rank_score, 4) DESC, symbol) AS r FROM cd WHERE verdict = 'candidate'),
pk AS (SELECT symbol, sector, rank_score, r > cap AS deferred FROM ok ORDER BY r > cap, rank_score DESC, symbol LIMIT 120)"""
BOARD = "CASE WHEN num % 2 = 0 THEN 'KOSDAQ' ELSE 'KOSPI' END"
SECTION = f"""{BARS}, br AS (SELECT DISTINCT p_brand AS symbol, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS num FROM part),
bx AS (SELECT symbol, num, {BOARD} AS board, lpad(num::VARCHAR, greatest(length(num::VARCHAR), 6)::INT, '0') AS code, DATE '1995-01-01' + (num * 30) AS listing_date,
 CASE WHEN num % 6 = 0 THEN 'preferred_stock' WHEN num % 7 = 0 THEN 'unknown_stock_type' ELSE 'common_stock' END AS security_type FROM br),
dd AS (SELECT DISTINCT session_date, board FROM bars JOIN bx USING (symbol)),
cs AS (SELECT dd.session_date, dd.board, code AS symbol, 'KR7' || code || '003' AS permanent_id, security_type, security_type = 'common_stock' AND dd.session_date >= listing_date AS eligible,
 CASE WHEN dd.session_date < listing_date THEN 'before_listing_date' WHEN security_type <> 'common_stock' THEN 'security_type=' || security_type ELSE '' END AS exclusion_reason,
 coalesce(round(close) * volume, 0) AS trade_value, close FROM dd JOIN bx ON bx.board = dd.board LEFT JOIN bars b ON b.symbol = bx.symbol AND b.session_date = dd.session_date),
cr AS (SELECT *, CASE WHEN eligible AND trade_value > 0 THEN row_number() OVER (PARTITION BY session_date, board, eligible AND trade_value > 0 ORDER BY trade_value DESC, symbol) END AS trade_value_rank FROM cs)"""
LOCAL = "(ts AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN event_type IN ('click', 'view', 'error') THEN 'America/New_York' ELSE 'Asia/Seoul' END"
IS_US = "event_type IN ('click', 'view', 'error')"


def provider(market: str) -> str:
    price, r = "l_extendedprice", "symbol"
    value = "coalesce(CASE WHEN l_linenumber > 3 THEN round(l_extendedprice * 100, 2) END, close * volume)" if market == "US" else "close * volume"
    vol = "CASE WHEN l_linenumber <> 7 THEN l_quantity * 5000.0 ELSE 0 END" if market == "US" else "CASE WHEN l_linenumber <> 7 THEN l_quantity * 5000.0 END"
    return f"""WITH r AS (SELECT {PER_BAR} AS market, p_brand AS symbol, CAST(l_shipdate AS DATE) AS session_date, l.*, row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY {ORDER}) AS k
 FROM lineitem l JOIN part ON l_partkey = p_partkey), f AS (SELECT symbol, session_date, l_linenumber, l_extendedprice, round({price} * (1 - l_discount), 4) AS open, {price} AS high, round({price} * 0.85, 4) AS low,
 round({price} * (1 - l_tax), 4) AS close, {vol} AS volume FROM r WHERE k = 1 AND market = '{market}')
 SELECT symbol, session_date, open, high, low, close, volume, round({value} / 1e6, 8) AS trade_value FROM f"""


def oracles() -> dict[str, str]:
    issue = lambda code, sev, expr: f"SELECT symbol, '{sev}' AS severity, '{code}' AS code, CAST(sum({expr}) AS BIGINT) AS count FROM dv GROUP BY symbol HAVING sum({expr}) > 0"
    bad = "(open <= 0)::INT + (high <= 0)::INT + (low <= 0)::INT + (close <= 0)::INT"
    now_us, now_kr = "DATE '2001-06-14'", "DATE '2001-06-15'"
    return {
        "src6_us_provider_bars": provider("US"), "src7_kr_provider_bars": provider("KR"),
        "flt2_categories": f"""WITH r AS (SELECT p_brand AS symbol, round(l_extendedprice * (1 - l_discount), 2) AS o, l_extendedprice AS h0, round(l_extendedprice * 0.85, 2) AS l, round(l_extendedprice * (1 - l_tax), 2) AS c, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
 s AS (SELECT symbol, o, l, c, CASE WHEN l_linenumber = 7 THEN c * 0.5 ELSE h0 END AS h FROM r)
 SELECT symbol, CASE WHEN h < greatest(o, h, l, c) OR l > least(o, h, l, c) THEN CASE WHEN greatest(o, h, l, c) / least(o, h, l, c) >= 1.5 THEN 'CORPORATE_ACTION_SUSPECTED' ELSE 'MALFORMED' END ELSE 'ok' END AS category, count(*) AS records FROM s GROUP BY ALL""",
        "agg19_issue_counts": f"""WITH {ARRIVE}, {CAL}, src AS (SELECT symbol, session_date FROM dv), {GAPS},
 du AS (SELECT symbol, session_date, count(*) AS n FROM dv GROUP BY ALL)
 {issue('weekend_rows', 'warning', "(isodow(session_date) > 5)::INT")} UNION ALL {issue('non_positive_price', 'error', bad)} UNION ALL {issue('negative_volume', 'error', '(volume < 0)::INT')}
 UNION ALL {issue('invalid_ohlc_relation', 'error', '(high < greatest(open, high, low, close) OR low > least(open, high, low, close))::INT')}
 UNION ALL {issue('before_listing', 'error', "(session_date < DATE '1995-01-01' + (num * 10))::INT")} UNION ALL {issue('after_delisting', 'error', "(session_date > DATE '2001-12-31' - (num * 10))::INT")}
 UNION ALL SELECT symbol, 'error', 'duplicate_session', CAST(sum(n) AS BIGINT) FROM du WHERE n > 1 GROUP BY symbol
 UNION ALL SELECT symbol, 'warning', code, count(*) FROM gp GROUP BY ALL
 UNION ALL SELECT symbol, 'error', 'stale_data', 1 FROM dv GROUP BY symbol HAVING max(session_date) < DATE '2001-12-01'""",
        "agg19_win_q1_gaps": f"""WITH {BARS}, {CAL}, src AS (SELECT symbol, session_date FROM bars), {GAPS}, {GAP_ROWS}
 SELECT symbol, 'warning' AS severity, 'large_gap' AS code, count(*) AS count FROM lg WHERE abs(close / pc - 1.0) >= 0.45 GROUP BY symbol
 UNION ALL SELECT symbol, 'warning', 'suspected_split', count(*) FROM lg WHERE close / pc BETWEEN 0.18 AND 0.55 OR close / pc BETWEEN 1.8 AND 5.5 GROUP BY symbol
 UNION ALL SELECT symbol, 'warning', 'weekend_rows', count(*) FROM bars WHERE isodow(session_date) > 5 GROUP BY symbol
 UNION ALL SELECT symbol, 'warning', code, count(*) FROM gp GROUP BY ALL""",
        "top7_examples": f"""WITH {ARRIVE}, {CAL}, src AS (SELECT symbol, session_date FROM dv), {GAPS}
 SELECT symbol, code, list_sort(list(session_date::VARCHAR))[1:5] AS examples FROM gp GROUP BY symbol, code""",
        "agg20_status": "SELECT DISTINCT p_brand AS symbol, 'failed' AS status FROM part JOIN lineitem ON l_partkey = p_partkey",
        "agg21_assets": f"""WITH {BARS}, {CAL}, src AS (SELECT symbol, session_date FROM bars), {GAPS}, mc AS (SELECT symbol, count(*) AS m FROM mis GROUP BY symbol)
 SELECT symbol, min(session_date) AS start_date, max(session_date) AS end_date, count(*) AS rows, coalesce(max(m), 0) AS missing_days, 0 AS duplicate_rows, 'warning' AS quality_status
 FROM bars LEFT JOIN mc USING (symbol) GROUP BY symbol""",
        "snk2_published": f"WITH {BARS}, b AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) FILTER (close < 1000) = 0) SELECT symbol, count(*) AS rows, min(session_date) AS first FROM bars WHERE symbol IN (SELECT symbol FROM b) GROUP BY symbol",
        "snk4_upsert": f"""WITH {SNAP}, o AS (SELECT market, symbol, min(as_of) AS as_of, count(*) AS n FROM snap GROUP BY ALL), w AS (SELECT market, symbol, max(as_of) AS as_of, count(*) AS n FROM snap WHERE environment_score >= 60 GROUP BY ALL)
 SELECT * FROM w UNION ALL SELECT * FROM o WHERE (market, symbol) NOT IN (SELECT (market, symbol) FROM w)""",
        "snk9_open_requests": """SELECT c_custkey AS key, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""",
        "snk1_artifacts": "SELECT source, sha256(text) AS data_hash, count(*) AS arrivals FROM documents GROUP BY ALL",
        "join11_sessions": f"WITH {BARS}, {CAL}, src AS (SELECT symbol, session_date FROM bars), {GAPS} SELECT symbol, code, count(*) AS days, min(session_date) AS first FROM gp GROUP BY symbol, code",
        "join12_weekdays": f"""WITH {BARS}, {CAL}, src AS (SELECT symbol, session_date FROM bars), {GAPS} SELECT g.symbol, 'possible_missing_or_holiday' AS code, count(*) AS days, min(g.session_date) AS first
 FROM grid g ANTI JOIN act a ON a.symbol = g.symbol AND a.session_date = g.session_date WHERE isodow(g.session_date) < 6 GROUP BY g.symbol""",
        "win_r4_duplicates": f"WITH {ARRIVE}, d AS (SELECT symbol, session_date, count(*) AS c FROM dv GROUP BY ALL) SELECT symbol, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS flagged, CAST(sum(c - 1) AS BIGINT) AS dropped, count(*) AS kept FROM d GROUP BY symbol",
        "flt21_trust_flags": "SELECT true AS point_in_time_verified, true AS price_policy_verified FROM (SELECT count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey) WHERE n > 0",
        "scl_d3_session_status": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, * FROM orders), s AS (SELECT d, CASE WHEN count(*) >= 10 THEN 210 ELSE 390 END AS m FROM o GROUP BY d), u AS (SELECT mode(m) AS um FROM s),
 c AS (SELECT DISTINCT d FROM o WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND o_custkey % 97 = 0), e AS (SELECT DISTINCT d FROM o WHERE o_custkey % 89 = 0),
 x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
 SELECT x.d AS session_date, CASE WHEN s.d IS NULL OR x.d IN (SELECT d FROM c) THEN 'CLOSED' WHEN m < um OR x.d IN (SELECT d FROM e) THEN 'EARLY_CLOSE' ELSE 'REGULAR' END AS status FROM x LEFT JOIN s ON s.d = x.d CROSS JOIN u""",
        "flt6_completed_daily": f"WITH {BARS} SELECT market, symbol, count(*) AS rows, max(session_date) AS latest FROM bars WHERE session_date <= CASE market WHEN 'US' THEN {now_us} ELSE {now_kr} END GROUP BY market, symbol",
        "flt7_daily_freshness": f"""WITH {BARS} SELECT market, symbol, max(session_date) AS latest, CASE market WHEN 'US' THEN max(session_date) <= DATE '2001-11-06' AND max(session_date) >= DATE '2001-11-06' - 4
 ELSE max(session_date) <= DATE '2001-11-06' AND max(session_date) >= DATE '2001-11-06' - 4 END AS current FROM bars GROUP BY market, symbol""",
        "flt8_minute_freshness": f"""SELECT event_type AS symbol, max(ts) >= TIMESTAMP '2024-01-30' AND max(ts) <= TIMESTAMP '2024-02-06' + CASE WHEN {IS_US} THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS current FROM events GROUP BY event_type""",
        "flt9_regular_session": f"""WITH m AS (SELECT *, {LOCAL} AS lt FROM events), n AS (SELECT *, hour(lt) * 60 + minute(lt) AS mi FROM m)
 SELECT event_type AS symbol, count(*) AS rows, min(event_id) AS first FROM n WHERE CASE WHEN {IS_US} THEN mi >= 570 AND mi + 60 <= 960 ELSE mi >= 540 AND mi <= 930 END GROUP BY event_type""",
        "flt10_completed_minutes": f"""WITH m AS (SELECT *, {LOCAL} AS lt FROM events) SELECT event_type AS symbol, count(*) AS rows, max(event_id) AS last FROM m
 WHERE CASE WHEN {IS_US} THEN ts + INTERVAL 60 MINUTE ELSE least(ts + INTERVAL 60 MINUTE, date_trunc('day', lt) + INTERVAL 390 MINUTE) END <= TIMESTAMP '2024-01-15 06:45:00' GROUP BY event_type""",
        "flt3_us_common": f"WITH {MASTER} SELECT symbol, {COMMON} AND p_size % 13 <> -1 AS common FROM ms",
        "flt4_kr_common": f"""WITH {MASTER} SELECT symbol, exchange <> 'AMEX' AND NOT is_etf AND (NOT (p_retailprice % 3 < 1) OR exchange = 'NYSE') AND p_size % 13 <> 0 AND sector NOT IN ('SMALL', 'PROMO') AS common FROM ms""",
        "flt5_security_type": "SELECT p_brand AS \"ISU_ABBRV\", CASE WHEN num % 6 = 0 THEN 'preferred_stock' WHEN num % 7 = 0 THEN 'unknown_stock_type' ELSE 'common_stock' END AS security_type FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS num FROM part)",
        "join1_rankings": f"WITH {RANKS} SELECT exchange, symbol, cap_rank, value_rank, round(market_cap_usd, 4) AS market_cap_usd, round(trade_value_usd, 4) AS trade_value_usd, price FROM bl",
        "join2_rul18_candidates": f"WITH {RANKS} SELECT exchange, symbol, verdict, round(rank_score, 4) AS rank_score FROM cd",
        "top1_win_r2_selection": f"WITH {RANKS} SELECT * FROM pk",
        "agg25_stats": f"""WITH {RANKS} SELECT (SELECT count(*) FROM cd) AS ranked_unique, (SELECT count(*) FROM cd WHERE verdict = 'excluded') AS excluded, (SELECT count(*) FROM cd WHERE verdict = 'unverified') AS unverified,
 count(*) AS selected, count(DISTINCT sector) AS sector_count FROM pk""",
        "src9_join4_cross_section": f"WITH {SECTION} SELECT session_date, board, symbol, permanent_id, security_type, eligible, exclusion_reason, trade_value, trade_value_rank FROM cr",
        "win_r1_turnover_rank": f"WITH {SECTION} SELECT board, symbol, count(*) FILTER (eligible) AS eligible_days, CAST(sum(trade_value_rank) AS BIGINT) AS rank_sum FROM cr GROUP BY board, symbol",
        "src9_prices": f"WITH {SECTION} SELECT symbol, count(*) AS rows, round(sum(close), 2) AS close_sum FROM cr WHERE eligible AND close IS NOT NULL GROUP BY symbol",
        "src10_index_rows": f"WITH {PROXY} SELECT session_date, symbol AS board, open, close, true AS valid FROM proxybars WHERE market = 'KR' AND NOT (symbol = 'KOSPI' AND (dayofweek(session_date) + 1) % 3 = 2)",
        "agg23_membership": f"""WITH {BARS}, q AS (SELECT market, symbol, date_trunc('month', session_date)::DATE AS d, sum(volume) > 2000000 AS e, {NUM} AS num FROM bars GROUP BY ALL), u AS (SELECT * FROM q WHERE e),
 l AS (SELECT market, max(d) AS last FROM u GROUP BY market), s AS (SELECT symbol, max(d = last) AS now, max(d < last) AS past, max(d < DATE '1995-01-01' + (num * 20)) AS early, max(d > DATE '2001-12-31' - (num * 20)) AS late FROM u JOIN l USING (market) GROUP BY symbol)
 SELECT symbol, 'historical_only' AS finding FROM s WHERE past AND NOT now UNION ALL SELECT symbol, 'new_on_latest' FROM s WHERE now AND NOT past UNION ALL SELECT symbol, 'before_listing' FROM s WHERE early UNION ALL SELECT symbol, 'after_delisting' FROM s WHERE late""",
        "join5_members": f"WITH {BARS}, {CAL} SELECT symbol, count(*) AS rows FROM bars SEMI JOIN cal USING (session_date) WHERE volume >= 200000 GROUP BY symbol",
        "flt12_flt13_eligible": f"""WITH {BARS}, x AS (SELECT symbol, session_date, {NUM} AS num FROM bars) SELECT symbol, count(*) AS days, max(session_date) AS last FROM x
 WHERE session_date >= DATE '1995-06-01' + (num * 9) AND (num % 2 = 1 OR session_date <= DATE '2001-06-01' - (num * 9)) AND session_date <= DATE '2001-09-30' AND num % 5 <> 0 GROUP BY symbol""",
        "agg19_text_stamps": f"""WITH {BARS}, x AS (SELECT market, symbol, session_date, {NUM} % 6 AS n, {NUM} % 6 = 0 AND day(session_date) = 13 AS bad FROM bars)
 SELECT symbol, count(*) FILTER (bad) AS unreadable, count(*) FILTER (n = 1 OR (n = 2 AND market <> 'KR')) AS off_zone, count(*) FILTER (NOT bad) AS days, max(session_date) FILTER (NOT bad) AS last FROM x GROUP BY symbol""",
        "flt13_sliced_bars": f"""WITH {BARS}, x AS (SELECT symbol, session_date, close, {NUM} AS num FROM bars), q AS (SELECT DISTINCT symbol, num, unnest([DATE '1995-02-01', DATE '1995-08-01', DATE '1997-12-31']) AS as_of FROM x),
 e AS (SELECT * FROM q WHERE num % 3 = 0 OR (num % 5 <> 0 AND as_of >= DATE '1993-01-01' + (num * 9) AND (num % 2 = 1 OR as_of <= DATE '1997-06-30') AND (as_of <= DATE '1995-03-31' OR as_of >= DATE '1996-01-01')))
 SELECT symbol || '|' || as_of AS request_id, session_date, close FROM e JOIN x USING (symbol) WHERE session_date <= as_of""",
        "flt13_sliced_ticks": """SELECT event_type AS request_id, event_id FROM events WHERE ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Seoul')::DATE <= DATE '2024-01-09'""",
        "join20_metadata": """WITH r AS (SELECT (c_custkey % 90)::VARCHAR AS symbol, arg_max(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS sector FROM customer GROUP BY ALL)
 SELECT 'US' AS market, symbol, CASE WHEN s_suppkey % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange, name, name AS korean_name, name AS english_name, sector, 'common_stock' AS security_type, false AS is_etf,
 CASE WHEN s_suppkey % 3 = 0 THEN '1995-01-01' ELSE '' END AS listing_date, '' AS delisting_date, '' AS permanent_id FROM supplier JOIN r ON symbol = s_suppkey::VARCHAR WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0""",
        "join3_board_candidates": f"""WITH {SECTION}, sc AS (SELECT p_brand AS symbol, arg_min(p_type, p_partkey) AS sector FROM part GROUP BY p_brand),
 r AS (SELECT b.session_date AS as_of, code AS symbol, board, sector, close, row_number() OVER (PARTITION BY b.session_date, board ORDER BY round(close) * volume DESC, code) AS k FROM bars b JOIN bx USING (symbol) JOIN sc USING (symbol))
 SELECT as_of, symbol, board, sector, greatest(0.0, 500.0 - k)::DOUBLE AS rank_score FROM r WHERE close >= 5000""",
        "flt18_resolution": f"""WITH {MASTER}, qs AS (SELECT DISTINCT unnest([p_name, p_name || ' corp', 'p' || lpad(p_partkey::VARCHAR, greatest(length(p_partkey::VARCHAR), 5)::INT, '0'), p_type, string_split(p_name, ' ')[1]]) AS query FROM part),
 h AS (SELECT query, symbol, 0 AS level FROM qs JOIN ms ON lower(query) = lower(symbol) UNION ALL SELECT query, symbol, 1 FROM qs JOIN ms ON lower(query) = lower(english_name)
 UNION ALL SELECT query, symbol, 2 FROM qs JOIN ms ON contains(lower(english_name), lower(query))), b AS (SELECT query, min(level) AS level FROM h GROUP BY query),
 g AS (SELECT query, count(DISTINCT symbol) AS matches, min(symbol) AS symbol FROM h JOIN b USING (query, level) GROUP BY query)
 SELECT query, CASE WHEN matches = 1 THEN symbol END AS symbol, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'not_found' WHEN matches > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM qs LEFT JOIN g USING (query)""",
        "top8_tails": f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS k FROM bars) SELECT symbol, count(*) AS rows, min(session_date) AS first FROM r WHERE k <= 650 GROUP BY symbol",
        "src13_batch_gaps": """WITH h AS (SELECT DISTINCT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events), g AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 15 MINUTE)) AS b FROM h GROUP BY event_type)
 SELECT g.event_type, strftime(g.b, '%Y%m%d%H%M%S') AS batch FROM g ANTI JOIN h ON h.event_type = g.event_type AND h.b = g.b""",
        "scl_s12_symbols": f"WITH {MASTER} SELECT symbol, symbol AS base, lpad(p_partkey::VARCHAR, greatest(length(p_partkey::VARCHAR), 6)::INT, '0') AS code, CASE WHEN p_partkey % 5 = 0 THEN 'BRKB' ELSE symbol END AS us FROM ms",
        "scl_s11_numbers": "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END END AS value, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS magnitude FROM orders",
        "str1_closed_buckets": """SELECT event_type AS symbol, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS bucket, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
 count(*)::DOUBLE AS volume, count(*) AS trades FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)""",
    }
