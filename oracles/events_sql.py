"""DuckDB statements for text functions and news evidence."""

from barlens.functions import fixed_values as fixed
from oracles.bars_sql import OUT

HIT = lambda col, terms: "(" + " OR ".join(f"contains({col}, '{x}')" for x in terms) + ")"
HITS = lambda col, terms: "(" + " + ".join(f"contains({col}, '{x}')::INT" for x in terms) + ")"


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def norm(c: str) -> str:
    tail = r"\s+[-|–—]\s+[^-|–—]{2,40}$"
    return f"trim(regexp_replace(regexp_replace({fold(c)}, '{tail}', ''), '[^0-9a-z가-힣]+', ' ', 'g'))"


STOP = ", ".join(f"'{w}'" for w in fixed.TITLE_STOPWORDS)
TOK = f"list_distinct(list_filter(string_split({{}}, ' '), lambda w: length(w) >= 2 AND NOT list_contains([{STOP}], w)))"
NUM_PATTERN = r"(?:[$₩€£]\s*)?[0-9]+(?:\.[0-9]+)?\s*(?:" + "|".join(fixed.NUMBER_UNITS) + ")?"


def facts(c: str) -> str:
    # list_distinct has no order, so first occurrences are kept by position.
    raw = f"list_transform(regexp_extract_all(replace({fold(c)}, ',', ''), '{NUM_PATTERN}'), lambda x: regexp_replace(x, '\\s+', '', 'g'))"
    return f"list_filter({raw}, lambda x, i: list_position({raw}, x) = i)"


def event_type(c: str, head: str = "") -> str:
    body = " ".join(f"WHEN {HIT(c, terms)} THEN '{kind}'" for kind, terms in fixed.EVENT_TERMS)
    return f"(CASE {head} {body} ELSE 'OTHER' END)"


def scope(c: str, default: str) -> str:
    return (f"(CASE WHEN {HIT(c, fixed.GLOBAL_TERMS)} THEN 'GLOBAL_EVENT' WHEN {HIT(c, fixed.MACRO_TERMS)} THEN 'MACRO' "
            f"WHEN {HIT(c, fixed.MARKET_TERMS)} THEN 'MARKET' ELSE {default} END)")


SOURCES = "['OPENDART', 'SEC_EDGAR', 'NAVER_NEWS', 'GOOGLE_NEWS_RSS', 'GDELT_GKG', 'GDELT_DOC']"
SYMBOL = "CASE WHEN lang = 'de' THEN '*' ELSE 'Brand#' || (doc_id % 25 + 1) END"
NEWS = f"""nw0 AS (SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS sn, {fold('text')} AS ft, {norm('text')} AS title_key,
 {SYMBOL} AS symbol FROM documents),
nw AS (SELECT 'evt_' || lpad(doc_id::VARCHAR, greatest(length(doc_id::VARCHAR), 9)::INT, '0') AS event_id, CASE WHEN lang = 'de' OR (doc_id % 25 + 1) % 2 = 0 THEN 'KR' ELSE 'US' END AS market, symbol,
 TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS event_time,
 CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_hours((doc_id % 7 - 1)::INT) END AS first_seen_at,
 {SOURCES}[sn % 6 + 1] AS source_type,
 'https://news.example.com/a/' || substr(md5(text), 1, 2) || '?a=1&b=2' AS url_key,
 CASE WHEN doc_id % 5 <> 0 THEN 'article_' || substr(md5(source || '|' || lang || '|' || (n_chars % 50)), 1, 24) ELSE '' END AS article_id,
 title_key, text, ft, {event_type('ft')} AS event_type, {scope('ft', "CASE WHEN symbol = '*' THEN 'MARKET' ELSE 'COMPANY' END")} AS scope,
 [lang, source] AS names, CASE WHEN doc_id % 13 = 0 THEN 'K' || (n_chars % 20) ELSE '' END AS explicit_key, sha256(text) AS raw_hash FROM nw0),
ev AS (SELECT *, CASE WHEN source_type IN ('OPENDART', 'SEC_EDGAR') THEN 1 WHEN source_type IN ('NAVER_NEWS', 'GOOGLE_NEWS_RSS') THEN 2 ELSE 3 END AS source_level FROM nw)"""


def dedup(src: str, p: str = "") -> str:
    """Sequential rule as a recursion over each symbol's rows; kept ids in {p}kept."""
    return f"""{p}seq AS MATERIALIZED (SELECT event_id, market, symbol, article_id, url_key, md5(title_key) AS tk, title_key = '' AS nt, row_number() OVER (PARTITION BY market, symbol ORDER BY event_time, source_type, event_id) AS rn FROM {src}),
{p}walk(market, symbol, rn, ids, urls, tks, keep) AS (
 SELECT DISTINCT market, symbol, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR FROM {p}seq
 UNION ALL
 SELECT market, symbol, rn, CASE WHEN dropped OR article_id = '' THEN ids ELSE list_append(ids, article_id) END,
  CASE WHEN dropped THEN urls ELSE list_append(urls, url_key) END, CASE WHEN dropped OR nt THEN tks ELSE list_append(tks, tk) END,
  CASE WHEN NOT dropped THEN event_id END FROM (
  SELECT s.*, w.ids, w.urls, w.tks, (article_id <> '' AND list_contains(w.ids, article_id)) OR list_contains(w.urls, url_key) OR (NOT nt AND list_contains(w.tks, tk)) AS dropped
  FROM {p}walk w JOIN {p}seq s ON s.market = w.market AND s.symbol = w.symbol AND s.rn = w.rn + 1)),
{p}kept AS MATERIALIZED (SELECT keep AS event_id FROM {p}walk WHERE keep IS NOT NULL)"""


def entity(c: str) -> str:
    return f"trim(regexp_replace({fold(c)}, '[^0-9a-z가-힣]+', ' ', 'g'))"


def root(c: str) -> str:
    return f"trim(regexp_replace({entity(c)}, '(?:(?:^| )(?:{'|'.join(fixed.LEGAL_SUFFIXES)}))+$', ''))"


def words(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


GATE = f"""og AS (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS k, 'Brand ' || regexp_extract(symbol, '([0-9]+)$', 1) || ' Works' AS company FROM ev WHERE source_type = 'GDELT_GKG'),
nm AS (SELECT *, list_concat([company, 'Apple', symbol], CASE WHEN k % 2 = 0 THEN ['Apple Inc'] ELSE [] END) AS called, list_filter(list_transform([split_part(text, ' ', 1),
  [upper(company), company || ' Co., Ltd.', 'Brand', 'Apple', 'Apple Inc.', symbol, 'New ' || company][k % 7 + 1]], lambda o: {entity('o')}), lambda o: o <> '') AS eo FROM og),
rt AS (SELECT *, list_filter(list_transform(list_filter(eo, lambda o: list_has_any(string_split(o, ' '), {words(fixed.LEGAL_SUFFIXES)})), lambda o: {root('o')}), lambda o: o <> '') AS roots FROM nm),
nd AS (SELECT *, list_filter(called, lambda a: {entity('a')} <> '' AND {entity('a')} <> {entity('symbol')} AND (list_contains(eo, {entity('a')}) OR list_contains(roots, {root('a')}))) AS named FROM rt),
ql AS (SELECT *, list_filter(named, lambda a: list_has_any(string_split({entity('a')}, ' '), {words(fixed.CORPORATE_SUFFIXES)})
  OR (NOT list_contains({words(fixed.GENERIC_NAMES)}, {entity('a')}) AND (len(string_split({entity('a')}, ' ')) > 1 OR {entity('a')} = {entity('company')}))) AS qualified FROM nd),
gate AS (SELECT market, symbol, event_id, len(qualified) > 0 AS accepted, CASE WHEN len(qualified) > 0 THEN 'DIRECT_COMPANY' ELSE 'REJECTED_GENERIC' END AS status, CASE WHEN len(qualified) > 0 THEN 'COMPANY' ELSE 'SECTOR' END AS scope,
 CASE WHEN len(qualified) > 0 THEN 'exact_organization_alias' WHEN len(named) > 0 THEN 'generic_name_without_legal_qualifier' ELSE 'no_exact_organization_alias' END AS reason,
 array_to_string(CASE WHEN len(qualified) > 0 THEN qualified ELSE named END, '|') AS matches FROM ql)"""


SEEN = ("CASE WHEN event_time > TIMESTAMP '2024-01-01 12:00:00' THEN 'event_after_as_of' WHEN first_seen_at IS NULL THEN 'first_seen_unknown' "
        "WHEN first_seen_at > TIMESTAMP '2024-01-01 12:00:00' THEN 'first_seen_after_as_of' ELSE 'visible' END")
ANALYSIS = "'analysis_' || substr(sha256('2024-01-01 12:00:00' || chr(31) || market || chr(31) || symbol), 1, 24)"
LINE = f"""line AS (SELECT {ANALYSIS} AS analysis_id, event_id, CASE source_type WHEN 'OPENDART' THEN 'dart_event_ids' WHEN 'SEC_EDGAR' THEN 'edgar_event_ids'
 WHEN 'NAVER_NEWS' THEN 'naver_news_ids' WHEN 'GOOGLE_NEWS_RSS' THEN 'google_news_ids' ELSE 'gdelt_candidate_ids' END AS source_group, event_type, source_level, scope, raw_hash, source_type
 FROM ev WHERE {SEEN} = 'visible')"""
HKEY = f"regexp_replace({fold('text')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')"
FIRST = f"""fh AS (SELECT market, symbol, event_id, event_time, source_type, row_number() OVER (PARTITION BY market, symbol, {HKEY} ORDER BY event_time, source_type, event_id) AS r, {HKEY} AS hk FROM ev)"""
SENT = f"(({HITS('ft', fixed.POSITIVE_TERMS)} - {HITS('ft', fixed.NEGATIVE_TERMS)}) / greatest(1.0, {HITS('ft', fixed.POSITIVE_TERMS)} + {HITS('ft', fixed.NEGATIVE_TERMS)}))::DOUBLE"
RISK = f"least(1.0::DOUBLE, 0.28::DOUBLE * {HITS('ft', fixed.RISK_TERMS)} + 0.35::DOUBLE * {HITS('ft', fixed.STRONG_RISK_TERMS)})"


def clusters() -> str:
    tok = TOK.format("title_key")
    gate = ("abs(date_diff('second', a.event_time, b.event_time)) <= 129600 AND NOT (len(a.nums) > 0 AND len(b.nums) > 0 AND NOT list_has_any(a.nums, b.nums)) "
            "AND list_has_any(a.names, b.names)")
    return f"""WITH RECURSIVE {NEWS}, {dedup('ev')},
 kv AS MATERIALIZED (SELECT *, {tok} AS tok, list_sort({facts('text')}) AS nums, row_number() OVER (PARTITION BY market, symbol, event_type ORDER BY event_time, source_type, event_id) AS rn
  FROM ev WHERE event_id IN (SELECT event_id FROM kept)),
 pr AS (SELECT b.event_id, a.rn AS arn, b.explicit_key <> '' AND a.explicit_key = b.explicit_key AS byid, a.nums = b.nums AND len(b.nums) > 0 AS eqn,
  CASE WHEN len(a.tok) = 0 OR len(b.tok) = 0 THEN 0 ELSE len(list_intersect(a.tok, b.tok)) / len(list_distinct(list_concat(a.tok, b.tok))) END AS j
  FROM kv a JOIN kv b ON a.market = b.market AND a.symbol = b.symbol AND a.event_type = b.event_type AND a.rn < b.rn WHERE {gate}),
 mt AS (SELECT event_id, arn, CASE WHEN byid THEN 'source_event_id' WHEN j >= 0.58 THEN 'title_entity_time_candidate' WHEN eqn AND j >= 0.35 THEN 'title_number_entity_time_candidate' END AS method FROM pr),
 ml AS MATERIALIZED (SELECT kv.market, kv.symbol, kv.event_type, kv.event_id, kv.rn, coalesce((SELECT list(arn) FROM mt WHERE mt.event_id = kv.event_id AND method IS NOT NULL), []::BIGINT[]) AS ms FROM kv),
 go(market, symbol, event_type, rn, reps, event_id, lead) AS (SELECT DISTINCT market, symbol, event_type, 0::BIGINT, []::BIGINT[], NULL::VARCHAR, NULL::BIGINT FROM ml
  UNION ALL SELECT m.market, m.symbol, m.event_type, m.rn, CASE WHEN len(list_intersect(g.reps, m.ms)) = 0 THEN list_append(g.reps, m.rn) ELSE g.reps END,
  m.event_id, coalesce(list_min(list_intersect(g.reps, m.ms)), m.rn) FROM go g JOIN ml m ON m.market = g.market AND m.symbol = g.symbol AND m.event_type = g.event_type AND m.rn = g.rn + 1)
 SELECT g.event_id, l.event_id AS leader_id, 'cluster_' || substr(sha256(l.market || chr(31) || l.symbol || chr(31) || l.event_type || chr(31) || strftime(l.event_time, '%Y-%m-%d') || chr(31) ||
  coalesce(nullif(l.explicit_key, ''), nullif(l.title_key, ''), nullif(l.article_id, ''), l.event_id)), 1, 24) AS cluster_id,
  coalesce(mt.method, 'singleton') AS cluster_method FROM go g JOIN kv l ON l.market = g.market AND l.symbol = g.symbol AND l.event_type = g.event_type AND l.rn = g.lead
  LEFT JOIN mt ON mt.event_id = g.event_id AND mt.arn = g.lead WHERE g.event_id IS NOT NULL"""


STORE = "source_type IN ('OPENDART', 'NAVER_NEWS', 'GDELT_GKG')"


def matched(src: str) -> str:
    best = lambda k: f"(SELECT arg_max(s.event_id, row(s.event_time, s.event_id)) FROM ev s WHERE s.{STORE} AND s.market = e.market AND s.symbol = e.symbol AND s.{k} <> '' AND s.{k} = e.{k})"
    return f"""mm AS (SELECT event_id, market, symbol, {best('article_id')} AS ba, {best('url_key')} AS bu, {best('title_key')} AS bt FROM {src} e WHERE NOT ({STORE}))"""


def oracles() -> dict[str, str]:
    tok = TOK.format(norm("text"))
    ent = lambda c: f"trim(regexp_replace(lower({c}), '[^0-9a-z가-힣]+', ' ', 'g'))"
    en = """array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') || CASE WHEN p_size % 11 = 0 THEN ' Warrants' WHEN p_size % 7 = 0 THEN ' Corp Preferred' ELSE ' Corp' END"""
    sq = lambda c: f"trim(regexp_replace({fold(c)}, '\\s+', ' ', 'g'))"
    url = r"regexp_replace(regexp_extract(url, '^([a-z]+://)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', ''), ''), '/'), '$', '')"
    q = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
    qs = lambda extra: f"array_to_string(list_sort(list_filter(list_concat(string_split({q}, '&'), {extra}), lambda p: p <> '' AND NOT regexp_matches(p, '^({"|".join(fixed.TRACKING_KEYS)})='))), '&')"
    joined = lambda extra: f"{url} || CASE WHEN {qs(extra)} = '' THEN '' ELSE '?' || {qs(extra)} END"
    plain_url, extra_url = joined("[]::VARCHAR[]"), joined("['b=1']")
    strip = "regexp_replace(html, '<[^>]+>', '', 'g')"
    body = f"replace(replace(replace(replace({strip}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    items = "list_filter(list_transform(string_split(replace(text, '. ', ',12;'), ';'), lambda x: trim(regexp_replace(trim(x), ',[^,]*$', ''))), lambda x: x <> '')"
    form = "WHEN doc_id % 10 <> 0 AND doc_id % 17 = 0 THEN 'EARNINGS' WHEN doc_id % 20 = 0 THEN 'MANAGEMENT_CHANGE'"
    withform = "ft || ' ' || CASE WHEN doc_id % 10 = 0 THEN '8-k' WHEN doc_id % 17 = 0 THEN '10-q' ELSE '' END || ' ' || CASE WHEN doc_id % 20 = 0 THEN '5.02, 9.01' WHEN doc_id % 10 = 0 THEN '7.01' ELSE '' END"
    day = lambda z, m: f"""(SELECT CASE WHEN isodow(d) > 5 THEN d - (isodow(d) - 5)::INT ELSE d END FROM (SELECT CASE WHEN isodow(x::DATE) < 6 AND hour(x) * 60 + minute(x) < {m} THEN x::DATE - 1 ELSE x::DATE END AS d
 FROM (SELECT (ts AT TIME ZONE 'UTC') AT TIME ZONE '{z}' AS x)))"""  # noqa: E731
    docs = f"d AS (SELECT *, {fold('text')} AS ft FROM documents)"
    sec = "epoch(date_trunc('second', ts))::BIGINT"
    return {
        "scl_s1_titles": f"SELECT doc_id, {norm('text')} AS title FROM documents",
        "scl_s2_tokens": f"SELECT doc_id, len({tok}) AS tokens, array_to_string(list_sort({tok}), ' ') AS sorted FROM documents",
        "scl_s3_similarity": f"""WITH d AS (SELECT doc_id, source, {tok} AS tok FROM documents), f AS (SELECT source, arg_min(tok, doc_id) AS first FROM d GROUP BY source)
 SELECT doc_id, round(CASE WHEN len(tok) = 0 OR len(first) = 0 THEN 0 ELSE len(list_intersect(tok, first)) / len(list_distinct(list_concat(tok, first))) END, 4) AS similarity FROM d JOIN f USING (source)""",
        "scl_s4_numeric_facts": f"SELECT doc_id, {facts('text')} AS facts FROM documents",
        "scl_s5_entities": f"""WITH m AS (SELECT 'P' || lpad(p_partkey::VARCHAR, greatest(length(p_partkey::VARCHAR), 5)::INT, '0') AS symbol, {en} AS n FROM part)
 SELECT symbol, {ent("n || ' Co., Ltd.'")} AS entity, trim(regexp_replace({ent("n || ' Co., Ltd.'")}, '(?:(?:^| )(?:{"|".join(fixed.LEGAL_SUFFIXES)}))+$', '')) AS root, true AS named FROM m""",
        "scl_s6_alias": f"SELECT doc_id, {sq('source')} = 'src7' AS by_source, contains({sq('text')}, 'ation') AS by_word, {sq('text')} = 'src' AS short_alias FROM documents",
        "scl_s7_urls": f"SELECT page_id, {plain_url} AS canonical, CASE WHEN contains(url, '#') THEN {plain_url} ELSE {extra_url} END AS tracked FROM pages",
        "scl_s8_ids": "SELECT doc_id, 'article_' || substr(sha256(trim(source) || chr(31) || trim(text) || chr(31)), 1, 24) AS id FROM documents",
        "scl_s9_html": f"SELECT page_id, trim(regexp_replace({body}, '\\s+', ' ', 'g')) AS body FROM pages",
        "scl_s10_lists": f"SELECT doc_id, list_filter({items}, lambda x, i: list_position({items}, x) = i) AS items FROM documents",
        "scl_c1_event_types": f"WITH {docs}, e AS (SELECT doc_id, ft, {withform} AS wf FROM d) SELECT doc_id, {event_type('ft')} AS plain, {event_type('wf', form)} AS with_form FROM e",
        "scl_c2_scopes": f"""WITH {docs} SELECT doc_id, {scope('ft', "'SECTOR'")} AS scope FROM d""",
        "scl_c3_source_level": f"WITH {NEWS} SELECT source_type, source_level, count(*) AS events FROM ev GROUP BY ALL",
        "scl_c4_headline_scores": f"WITH {docs} SELECT doc_id, round({SENT}, 4) AS sentiment, round({RISK}, 4) AS risk FROM d",
        "scl_c8_actions": "SELECT o_orderstatus, count(*) AS orders, CASE o_orderstatus WHEN 'F' THEN 'interest' WHEN 'O' THEN 'wait' ELSE 'other' END AS action FROM orders GROUP BY o_orderstatus",
        "scl_d1_datetimes": f"""SELECT event_id, {sec} AS digits, {sec} AS iso, {sec} AS mail, epoch(date_trunc('second', ts) AT TIME ZONE 'America/New_York')::BIGINT AS new_york,
 epoch((ts::DATE + INTERVAL 86399 SECOND) AT TIME ZONE 'Asia/Seoul')::BIGINT AS seoul_day_end, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS text FROM events""",
        "scl_d2_last_session": f"SELECT event_id, {day('America/New_York', 960)} AS us, {day('Asia/Seoul', 930)} AS kr FROM events",
        "scl_d6_display_time": f"WITH {NEWS} SELECT event_id, CASE WHEN source_type IN ('OPENDART', 'GDELT_DOC') THEN strftime(event_time, '%Y-%m-%d') ELSE strftime(event_time, '%Y-%m-%d %H:%M') END AS shown FROM ev",
        "flt14_visibility": f"WITH {NEWS} SELECT event_id, {SEEN} AS reason FROM ev",
        "flt15_as_of": f"WITH {NEWS} SELECT event_id, symbol, epoch(event_time)::BIGINT AS at FROM ev WHERE market = 'KR' AND {SEEN} IN ('visible', 'first_seen_unknown')",
        "flt19_find_events": f"WITH {NEWS} SELECT event_id, epoch(event_time)::BIGINT AS at FROM ev WHERE market = 'KR' AND symbol = '*' AND source_type = 'SEC_EDGAR'",
        "flt20_official_items": f"""WITH {NEWS}, o AS (SELECT market, symbol, event_id, row_number() OVER (PARTITION BY market, symbol ORDER BY event_time DESC, event_id DESC) AS position FROM ev
 WHERE source_level = 1 AND first_seen_at <= TIMESTAMP '2024-01-01 16:00:00') SELECT * FROM o WHERE position <= 8""",
        "set1_deduplicated": f"WITH RECURSIVE {NEWS}, {dedup('ev')} SELECT event_id, market, symbol FROM ev WHERE event_id IN (SELECT event_id FROM kept)",
        "set2_clusters": clusters(),
        "join15_store_matches": f"""WITH {NEWS}, {matched('ev')} SELECT event_id, CASE WHEN ba IS NOT NULL THEN 'article' WHEN bu IS NOT NULL THEN 'url' WHEN bt IS NOT NULL THEN 'title' ELSE 'new' END AS match_kind,
 coalesce(ba, bu, bt) AS matched_id FROM mm""",
        "set6_ingest": f"""WITH RECURSIVE {NEWS}, inc AS (SELECT * FROM ev WHERE NOT ({STORE})), {dedup('inc')}, {matched('ev')},
 al AS (SELECT market, symbol, event_id FROM ev WHERE {STORE} UNION ALL SELECT market, symbol, event_id FROM mm WHERE coalesce(ba, bu, bt) IS NULL AND event_id IN (SELECT event_id FROM kept))
 SELECT market, symbol, count(*) AS events, min(event_id) AS first, max(event_id) AS last FROM al GROUP BY market, symbol""",
        "set6_store_clusters": f"SELECT event_id, cluster_id, cluster_method FROM ({clusters()})",
        "str2_first_observations": """SELECT 'evt_' || event_id AS event_id, CASE WHEN event_id % 23 = 0 AND ts >= '2024-01-30' THEN 3 WHEN ts < '2024-01-11' THEN 0 WHEN ts < '2024-01-21' THEN 1 ELSE 2 END AS part
 FROM events WHERE NOT (event_id % 23 = 0 AND ts < '2024-01-15')""",
        "str3_streamed_view": f"WITH {NEWS} SELECT event_id, market, symbol FROM ev WHERE {SEEN} = 'visible'",
        "set3_headlines": f"WITH {NEWS}, {FIRST} SELECT market, symbol, event_id FROM fh WHERE r = 1 AND hk <> ''",
        "top6_headlines": f"""WITH {NEWS}, {FIRST}, p AS (SELECT market, symbol, event_id, row_number() OVER (PARTITION BY market, symbol ORDER BY event_time, source_type, event_id) AS position FROM fh WHERE r = 1 AND hk <> '')
 SELECT * FROM p WHERE position <= 8""",
        "agg17_agg18_scores": f"""WITH {NEWS}, s AS (SELECT market, symbol, {SENT} AS sentiment, {RISK} AS risk FROM ev)
 SELECT market, symbol, CAST(round_even(greatest(0, least(100, 50 + avg(sentiment) * 32)), 0) AS INT) AS news_score,
 CAST(round_even(greatest(0, least(100, 10 + 45 * avg(risk) + 30 * max(risk) + 10 * least(1, ln(1 + count(*)) / ln(13)))), 0) AS INT) AS event_risk FROM s GROUP BY market, symbol""",
        "agg22_counts": f"""WITH {NEWS}, u AS (SELECT 'by_source' AS dimension, source_type AS value FROM ev UNION ALL SELECT 'by_market', market FROM ev UNION ALL SELECT 'by_symbol', market || ':' || symbol FROM ev
 UNION ALL SELECT 'source_levels', 'LEVEL_' || source_level FROM ev UNION ALL SELECT 'scopes', scope FROM ev UNION ALL SELECT 'normalized_event_types', event_type FROM ev)
 SELECT dimension, value, count(*) AS events FROM u GROUP BY ALL""",
        "agg22_quality": f"""WITH {NEWS} SELECT count(*) AS event_count, count(*) FILTER (first_seen_at IS NULL) AS unknown_first_seen_count, count(*) FILTER (first_seen_at < event_time) AS first_seen_before_event_count,
 count(*) FILTER (article_id <> '') - count(DISTINCT CASE WHEN article_id <> '' THEN (market, symbol, article_id) END) AS duplicate_article_id_count,
 count(*) - count(DISTINCT (market, symbol, url_key)) AS duplicate_canonical_url_count,
 count(*) FILTER (title_key <> '') - count(DISTINCT CASE WHEN title_key <> '' THEN (market, symbol, title_key) END) AS duplicate_normalized_title_count FROM ev""",
        "agg22_coverage": f"WITH {NEWS} SELECT source_type, epoch(min(event_time))::BIGINT AS start, epoch(max(event_time))::BIGINT AS \"end\" FROM ev GROUP BY source_type",
        "scl_c7_organisations": f"WITH {NEWS}, {GATE} SELECT event_id, accepted, status, scope, reason, matches FROM gate",
        "agg22_relevance_replay": f"""WITH {NEWS}, {GATE} SELECT symbol, count(*) AS before_candidate_count, count(*) FILTER (accepted) AS accepted_candidate_count,
 count(*) FILTER (NOT accepted) AS rejected_candidate_count FROM gate GROUP BY ROLLUP (symbol)""",
        "agg22_quarantine": f"WITH {NEWS}, {GATE} SELECT market, symbol, event_id, status, reason, matches FROM gate WHERE NOT accepted",
        "agg22_multi_article_clusters": f"""SELECT count(*) FILTER (n > 1) AS multi_article_cluster_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS clustered_events
 FROM (SELECT cluster_id, count(*) AS n FROM ({clusters()}) WHERE cluster_id <> '' GROUP BY cluster_id)""",
        "agg24_lineage": f"WITH {NEWS}, {LINE} SELECT * EXCLUDE (source_type) FROM line",
        "agg24_counts": f"""WITH {NEWS}, {LINE} SELECT analysis_id, {", ".join(f"count(*) FILTER (source_group = '{g}') AS {g}" for g in ('dart_event_ids', 'edgar_event_ids', 'naver_news_ids', 'google_news_ids', 'gdelt_candidate_ids'))},
 count(*) AS visible_events, count(DISTINCT raw_hash) AS raw_hashes FROM line GROUP BY analysis_id""",
        "agg24_running_counts": f"""WITH {NEWS}, a AS (SELECT market, symbol, h, TIMESTAMP '2024-01-01' + to_hours(h::INT) AS t FROM (SELECT DISTINCT market, symbol FROM ev), range(0, 49, 2) AS r(h))
 SELECT a.market || '|' || a.symbol || '|' || a.h AS analysis_id, {", ".join(f"count(*) FILTER (source_type IN ({s})) AS {g}" for g, s in (('dart_event_ids', "'OPENDART'"), ('edgar_event_ids', "'SEC_EDGAR'"), ('naver_news_ids', "'NAVER_NEWS'"), ('google_news_ids', "'GOOGLE_NEWS_RSS'"), ('gdelt_candidate_ids', "'GDELT_GKG', 'GDELT_DOC'")))},
 count(event_id) AS visible_events FROM a LEFT JOIN ev ON ev.market = a.market AND ev.symbol = a.symbol AND ev.event_time <= t AND ev.first_seen_at <= t GROUP BY a.market, a.symbol, a.h""",
        "rul20_overview": f"""WITH {NEWS}, ms AS (SELECT DISTINCT symbol AS market, coalesce(try_cast(split_part(symbol, '#', 2) AS INT), 0) AS n FROM ev),
 it AS (SELECT e.*, ms.n, ['news', 'events', 'fallback'][CAST(substr(event_id, 5) AS INT) % 3 + 1] AS feed, {HKEY} AS hk, {SENT} AS sen, {RISK} AS rsk FROM ev e JOIN ms ON ms.market = e.symbol),
 kp AS (SELECT * FROM it WHERE CASE feed WHEN 'news' THEN n % 8 <> 0 WHEN 'events' THEN n % 3 <> 0 ELSE n % 2 = 1 END),
 us AS (SELECT *, feed = 'news' AS is_news FROM kp WHERE feed = 'news' OR feed = CASE WHEN n % 3 = 0 AND n % 2 = 1 AND symbol IN (SELECT symbol FROM kp WHERE feed = 'fallback') THEN 'fallback' ELSE 'events' END),
 hd AS (SELECT *, row_number() OVER (PARTITION BY symbol, is_news ORDER BY event_time, source_type, event_id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY symbol, is_news, hk ORDER BY event_time, source_type, event_id) AS r FROM us WHERE hk <> '') WHERE r = 1),
 g AS (SELECT ms.market, n, CASE WHEN n % 5 <> 0 THEN n * 7 % 101 END AS market_score,
  (SELECT CAST(round_even(greatest(0, least(100, 50 + avg(sen) * 32)), 0) AS INT) FROM us WHERE us.symbol = ms.market AND is_news) AS ns,
  (SELECT CAST(round_even(greatest(0, least(100, 10 + 45 * avg(rsk) + 30 * max(rsk) + 10 * least(1, ln(1 + count(*)) / ln(13)))), 0) AS INT) FROM us WHERE us.symbol = ms.market AND NOT is_news) AS er,
  (SELECT count(*) FROM kp WHERE kp.symbol = ms.market AND feed = 'news') AS cn, (SELECT count(*) FROM kp WHERE kp.symbol = ms.market AND feed = 'events') AS ce, (SELECT count(*) FROM kp WHERE kp.symbol = ms.market AND feed = 'fallback') AS cf FROM ms),
 s AS (SELECT *, CASE WHEN n % 4 = 0 AND cn = 0 THEN NULL ELSE coalesce(ns, 50) END AS news_score, CASE WHEN n % 3 = 0 AND ce = 0 AND cf = 0 THEN NULL ELSE coalesce(er, 15) END AS event_risk FROM g),
 c AS (SELECT *, CASE WHEN market_score IS NULL AND news_score IS NULL AND event_risk IS NULL THEN 50 ELSE CAST(round_even((coalesce(market_score * 0.55, 0) + coalesce(news_score * 0.25, 0) + coalesce((100.0 - event_risk) * 0.2, 0))
  / (CASE WHEN market_score IS NULL THEN 0 ELSE 0.55 END + CASE WHEN news_score IS NULL THEN 0 ELSE 0.25 END + CASE WHEN event_risk IS NULL THEN 0 ELSE 0.2 END), 0) AS INT) END AS environment_score FROM s)
 SELECT market, market_score::INT AS market_score, news_score, event_risk, environment_score, CASE WHEN market_score IS NULL AND news_score IS NULL AND event_risk IS NULL THEN 'no_info' WHEN environment_score >= 72 THEN 'very_favourable' WHEN environment_score >= 60 THEN 'favourable'
  WHEN environment_score >= 45 THEN 'neutral' WHEN environment_score >= 35 THEN 'burden' ELSE 'heavy_burden' END AS environment_label,
  array_to_string(list_filter([CASE WHEN cn > 0 THEN 'news' END, CASE WHEN ce > 0 THEN 'events' END, CASE WHEN n % 3 = 0 AND cf > 0 THEN 'fallback' END], lambda x: x IS NOT NULL), ',') AS feeds,
  coalesce((SELECT string_agg(event_id, ',' ORDER BY pos) FROM hd WHERE hd.symbol = c.market AND is_news AND pos <= 8), '') AS headlines,
  coalesce((SELECT string_agg(event_id, ',' ORDER BY pos) FROM hd WHERE hd.symbol = c.market AND NOT is_news AND pos <= 6), '') AS event_headlines,
  coalesce((SELECT string_agg(scope, ',' ORDER BY pos) FROM hd WHERE hd.symbol = c.market AND NOT is_news AND pos <= 6), '') AS scopes FROM c""",
        "snk11_scl_j1_snapshots": f"WITH {NEWS}, {LINE} SELECT * EXCLUDE (source_type) FROM line",
        "snk10_capture": f"WITH {NEWS}, {LINE} SELECT analysis_id, 'event' AS kind, event_id AS reference FROM line UNION SELECT analysis_id, 'raw', raw_hash FROM line",
        "join16_missing_lineage": f"""WITH {NEWS}, {LINE} SELECT analysis_id, event_id AS reference, 'event' AS missing FROM line WHERE source_type = 'GDELT_DOC'
 UNION ALL SELECT analysis_id, raw_hash, 'raw' FROM line WHERE raw_hash NOT IN (SELECT raw_hash FROM ev WHERE source_type <> 'NAVER_NEWS')""",
        "snk12_outcomes": f"""{OUT} SELECT symbol || '|' || as_of AS analysis_id, {", ".join(f"round(max(forward_return_pct) FILTER (horizon = {h}), 4) AS h{h}" for h in (1, 5, 10, 20))} FROM outc GROUP BY symbol, as_of""",
    }
