"""Named queries over datasets, universes, clocks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlens.functions import text as t
from barlens.operators import cleaning, clock, quality, universe
from barlens.plans import shared
from barlens.session import stored
from barlens.sources import driver_tables as tables

NOW = "2001-06-15 18:00:00"


def at(text: str = NOW):
    return F.lit(text).cast("timestamp")


def provider(market):
    def run(spark, sf):
        b = cleaning.provider_bars(tables.provider_records(spark, sf)).filter(F.col("market") == market)
        return b.select("symbol", "session_date", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")],
                        "volume", F.round(F.col("trade_value") / 1e6, 8).alias("trade_value"))
    return run


def provider_categories(spark, sf):
    p = cleaning.parse_provider_records(tables.provider_records(spark, sf))
    broken = p.withColumn("high", F.when(F.col("volume").isNull(), F.col("close") * 0.5).otherwise(F.col("high")))
    return broken.groupBy("symbol", F.coalesce(cleaning.provider_category(), F.lit("ok")).alias("category")).agg(F.count(F.lit(1)).alias("records"))


def delivered(spark, sf) -> DataFrame:
    """Bars as a careless provider delivers them: one row per trade, in order of arrival."""
    brands = tables.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    li = tables.table(spark, sf, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice")
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    return li.select(
        tables.market_of(F.col("symbol")).alias("market"), "symbol", F.to_date("l_shipdate").alias("session_date"),
        price.alias("open"), F.when(F.col("l_tax") == 0.08, price * 0.9).otherwise(price).alias("high"), price.alias("low"),
        F.when(F.col("l_discount") == 0.1, F.lit(0.0)).otherwise(price).alias("close"),
        F.when(F.col("l_quantity") == 50, -1.0).otherwise(F.col("l_quantity")).alias("volume"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ingest_order"), "l_partkey", "l_suppkey",
        F.date_add(F.lit("1995-01-01").cast("date"), (number * 10).cast("int")).alias("listing_date"),
        F.date_add(F.lit("2001-12-31").cast("date"), (-number * 10).cast("int")).alias("delisting_date"))


#: Order positions numbered together.
POSITIONS = 1_000_000


def unique_delivered(spark, sf) -> DataFrame:
    """The same with a total arrival order: the rows of a symbol are numbered from 1 by order
    position, part and supplier (then by their values, equal rows being alike)."""
    return arrival_numbers(delivered(spark, sf)).drop("l_partkey", "l_suppkey")


def arrival_numbers(d: DataFrame) -> DataFrame:
    """``ingest_order`` replaced by the row's number within its symbol; stretches of order
    positions are counted first, so that no window sees more than one of them."""
    keys = ["market", "symbol"]
    d = d.withColumn("_stretch", F.floor(F.col("ingest_order") / POSITIONS))
    ahead = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    within = Window.partitionBy(*keys, "_stretch").orderBy("ingest_order", "l_partkey", "l_suppkey", "session_date", "open", "high", "close", "volume")
    d = d.withColumn("_at", F.row_number().over(within)).join(counts.drop("_n"), [*keys, "_stretch"])
    return d.withColumn("ingest_order", F.col("_ahead") + F.col("_at")).drop("_stretch", "_at", "_ahead")


def issues(spark, sf):
    def build():
        # Numbered once: the audit reads the rows several times.
        return quality.inspect(stored(unique_delivered(spark, sf), "delivered"), tables.order_calendar(spark, sf), "2001-12-01")
    return shared.keep(spark, sf, "issues", build)


def issue_counts(spark, sf):
    return issues(spark, sf).filter(~F.col("code").isin("large_gap", "suspected_split", "not_sorted")).select("symbol", "severity", "code", "count")


def issue_examples(spark, sf):
    return issues(spark, sf).filter(F.col("code").isin("missing_exchange_session", "non_session_date")).select("symbol", "code", "examples")


def all_issues(spark, sf):
    return issues(spark, sf)


def clean_issues(spark, sf) -> DataFrame:
    """Issues of the daily bars (one row per session, so few errors)."""
    def build():
        b = shared.raw_bars(spark, sf).withColumn("ingest_order", F.datediff("session_date", F.lit("1970-01-01").cast("date")).cast("long"))
        return quality.inspect(b, tables.order_calendar(spark, sf))
    return shared.keep(spark, sf, "clean_issues", build)


def gap_issues(spark, sf):
    return clean_issues(spark, sf).select("symbol", "severity", "code", "count")


def report_status(spark, sf):
    r = quality.reports(issues(spark, sf).filter("code <> 'not_sorted'"), shared.raw_bars(spark, sf))
    return r.select("symbol", "status")


def assets(spark, sf):
    i = clean_issues(spark, sf)
    b = shared.raw_bars(spark, sf)
    return quality.asset_manifest(b, i, quality.reports(i, b)).select(
        "symbol", "start_date", "end_date", "rows", "missing_days", "duplicate_rows", "quality_status")


def dataset(spark, sf):
    i = clean_issues(spark, sf)
    b = shared.raw_bars(spark, sf)
    return quality.dataset_manifest(quality.asset_manifest(b, i, quality.reports(i, b)), F.lit(True), False)


def publish(spark, sf):
    """Published bars: symbols with an odd number fail their audit here."""
    b = shared.raw_bars(spark, sf)
    r = b.groupBy("market", "symbol").agg(F.count_if(F.col("close") < 1000).alias("error_count"))
    return quality.publishable(b, r).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("session_date").alias("first"))


def upserted(spark, sf):
    s = shared.snapshots(spark, sf)
    old = s.groupBy("market", "symbol").agg(F.min("as_of").alias("as_of"), F.count(F.lit(1)).alias("n"))
    new = s.filter("environment_score >= 60").groupBy("market", "symbol").agg(F.max("as_of").alias("as_of"), F.count(F.lit(1)).alias("n"))
    return quality.upsert(old, new, ["market", "symbol"])


def open_requests(spark, sf):
    c = tables.table(spark, sf, "customer")
    o = tables.table(spark, sf, "orders")
    requests = c.select(F.col("c_custkey").alias("key"), "c_mktsegment")
    done = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("data_hash"))
    stored = tables.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("data_hash"))
    return quality.to_collect(requests, done, stored)


def missing_sessions(spark, sf):
    g = quality.session_gaps(shared.raw_bars(spark, sf), tables.order_calendar(spark, sf))
    return g.groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("days"), F.min("session_date").alias("first"))


def missing_weekdays(spark, sf):
    g = quality.session_gaps(shared.raw_bars(spark, sf), None)
    return g.groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("days"), F.min("session_date").alias("first"))


def duplicates(spark, sf):
    d = delivered(spark, sf).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("copies"))
    return d.groupBy("symbol").agg(F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("flagged"),
                                   F.sum(F.col("copies") - 1).alias("dropped"), F.count(F.lit(1)).alias("kept"))


def trust_flags(spark, sf):
    a = assets(spark, sf).withColumns({
        "kind": F.lit("stock"), "survivorship_safe": F.col("missing_days") >= 0,
        "corporate_action_policy": F.lit("provider adjusted"), "price_adjustment": F.lit("split adjusted")})
    return quality.manifest_flags(a, True, True, True)


def session_status(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    days = li.select(F.lit("X").alias("calendar"), F.to_date("l_shipdate").alias("session_date")).distinct()
    o = tables.table(spark, sf, "orders")
    sessions = o.groupBy(F.to_date("o_orderdate").alias("session_date")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("X").alias("calendar"), "session_date", F.when(F.col("n") >= 10, 210).otherwise(390).alias("minutes"))
    closed = o.filter("o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND o_custkey % 97 = 0").select(
        F.lit("X").alias("calendar"), F.to_date("o_orderdate").alias("session_date")).distinct()
    early = o.filter("o_custkey % 89 = 0").select(F.lit("X").alias("calendar"), F.to_date("o_orderdate").alias("session_date")).distinct()
    return quality.session_status(days, sessions, closed, early).select("session_date", "status")


def completed_daily(spark, sf):
    return clock.completed_daily(shared.bars(spark, sf), at()).groupBy("market", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("session_date").alias("latest"))


def daily_fresh(spark, sf):
    return clock.daily_freshness(shared.bars(spark, sf), at("2001-11-06 22:00:00"))


def minute_fresh(spark, sf):
    return clock.minute_freshness(tables.minute_bars(spark, sf), at("2024-02-06 00:00:00")).select("symbol", "current")


def regular_minutes(spark, sf):
    return clock.regular_session(tables.minute_bars(spark, sf)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first"))


def completed_minutes(spark, sf):
    return clock.completed_minutes(tables.minute_bars(spark, sf), at("2024-01-15 06:45:00")).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("last"))


def us_filter(spark, sf):
    return tables.master(spark, sf).select("symbol", universe.us_common_stock().alias("common"))


def kr_filter(spark, sf):
    m = tables.master(spark, sf)
    m = m.select(F.col("symbol"), F.when(F.col("exchange") == "NYSE", "KOSPI").when(F.col("exchange") == "NASDAQ", "KOSDAQ").otherwise("KONEX").alias("exchange"),
                 "is_etf", F.col("korean_name").alias("name"), F.when(F.col("list_price") % 3 < 1, "거래소").otherwise("").alias("market_name"),
                 F.when(F.col("sector") == "PROMO", "관리종목").otherwise("정상").alias("audit_info"), F.lit("").alias("state"),
                 F.when(F.col("sector") == "SMALL", "2").otherwise("0").alias("order_warning"))
    return m.select("symbol", universe.kr_common_stock().alias("common"))


def types(spark, sf):
    _, basic = tables.cross_section_rows(spark, sf)
    return basic.select("ISU_ABBRV", universe.security_type(F.col("KIND_STKCERT_TP_NM"), F.col("ISU_ABBRV")).alias("security_type"))


def blended(spark, sf):
    b = universe.blend_rankings(universe.ranked(tables.ranking_rows(spark, sf)))
    return b.select("exchange", "symbol", "cap_rank", "value_rank", *[F.round(c, 4).alias(c) for c in ("market_cap_usd", "trade_value_usd")], "price")


def _candidates(spark, sf):
    b = universe.blend_rankings(universe.ranked(tables.ranking_rows(spark, sf)))
    return universe.us_candidates(b, tables.master(spark, sf).filter("part_key % 23 <> 0"))


def candidates(spark, sf):
    return _candidates(spark, sf).select("exchange", "symbol", "verdict", F.round("rank_score", 4).alias("rank_score"))


def selected(spark, sf):
    c = _candidates(spark, sf).filter("verdict = 'candidate'").withColumn("rank_score", F.round("rank_score", 4))
    return universe.sector_capped(c, 120, 24).select("symbol", "sector", "rank_score", "deferred")


def stats(spark, sf):
    c = _candidates(spark, sf)
    s = universe.sector_capped(c.filter("verdict = 'candidate'").withColumn("rank_score", F.round("rank_score", 4)), 120, 24)
    return universe.universe_stats(c, s)


def _section(spark, sf):
    return universe.cross_section(*tables.cross_section_rows(spark, sf))


def cross_section(spark, sf):
    return _section(spark, sf).select("session_date", "board", "symbol", "permanent_id", "security_type", "eligible", "exclusion_reason", "trade_value", "trade_value_rank")


def cross_section_totals(spark, sf):
    return _section(spark, sf).groupBy("board", "symbol").agg(F.count_if("eligible").alias("eligible_days"), F.sum("trade_value_rank").alias("rank_sum"))


def cross_prices(spark, sf):
    return universe.cross_section_prices(_section(spark, sf)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("close"), 2).alias("close_sum"))


def index_rows(spark, sf):
    p = shared.keep(spark, sf, "raw_proxies", lambda: tables.proxy_bars(spark, sf)).filter("market = 'KR'")
    alias = F.when(F.col("symbol") == "KOSPI", F.element_at(F.array(F.lit("코스피"), F.lit("KOSPI"), F.lit("기타")), F.dayofweek("session_date") % 3 + 1)).otherwise("코스닥")
    rows = p.select("session_date", F.col("symbol").alias("board"), alias.alias("IDX_NM"), *[F.format_number(c, 2).alias(n) for c, n in (
        ("open", "OPNPRC_IDX"), ("high", "HGPRC_IDX"), ("low", "LWPRC_IDX"), ("close", "CLSPRC_IDX"))],
        F.format_number("volume", 0).alias("ACC_TRDVOL"), F.lit("0").alias("ACC_TRDVAL"), F.lit(1).alias("position"))
    return universe.index_bars(rows).select("session_date", "board", "open", "close", "valid")


def membership(spark, sf):
    """Members: brands whose trades on a quarter's days reach a volume, with listing dates."""
    b = shared.raw_bars(spark, sf)
    q = b.groupBy("market", "symbol", F.to_date(F.date_trunc("month", "session_date")).alias("session_date")).agg(F.sum("volume").alias("v"))
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    u = q.select("market", "symbol", "session_date", (F.col("v") > 2_000_000).alias("eligible"),
                 F.date_add(F.lit("1995-01-01").cast("date"), (number * 20).cast("int")).alias("listing_date"),
                 F.date_add(F.lit("2001-12-31").cast("date"), (-number * 20).cast("int")).alias("delisting_date"))
    return universe.membership_audit(u).select("symbol", "finding")


def member_bars(spark, sf):
    """Universe membership as a semi-join on (symbol, date)."""
    b = shared.raw_bars(spark, sf)
    days = tables.order_calendar(spark, sf)
    members = b.filter("volume >= 200000").join(days, "session_date", "left_semi").select("market", "symbol", "session_date")
    return b.join(members, ["market", "symbol", "session_date"], "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


def eligible_days(spark, sf):
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    b = shared.raw_bars(spark, sf).withColumns({
        "listing_date": F.date_add(F.lit("1995-06-01").cast("date"), (number * 9).cast("int")),
        "delisting_date": F.when(number % 2 == 0, F.date_add(F.lit("2001-06-01").cast("date"), (-number * 9).cast("int"))),
        "ticker_start_date": F.lit(None).cast("date"), "ticker_end_date": F.lit("2001-09-30").cast("date"),
        "security_type": F.when(number % 5 == 0, "etf").otherwise("Common")})
    return b.filter(universe.eligible_on(F.col("session_date"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.max("session_date").alias("last"))


def _ranges(b):
    """Two ticker ranges a symbol, of which the first ends before the second begins."""
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    rows = b.select("market", "symbol").distinct().withColumn("n", number).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return rows.select(
        "market", "symbol", F.when(F.col("n") % 5 == 0, "etf").otherwise("CS").alias("security_type"), F.date_add(F.lit("1993-01-01").cast("date"), F.col("n") * 9).alias("listing_date"),
        F.when(F.col("n") % 2 == 0, F.lit("1997-06-30").cast("date")).alias("delisting_date"), F.when(F.col("k") == 2, F.lit("1996-01-01").cast("date")).alias("ticker_start_date"),
        F.when(F.col("k") == 1, F.lit("1995-03-31").cast("date")).alias("ticker_end_date"))


def sliced_bars(spark, sf):
    """What requests of three days may know of every symbol's bars; a third of the symbols has no history rows."""
    b = shared.bars(spark, sf)
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("1995-02-01", "1995-08-01", "1997-12-31")])).alias("as_of")
    asked = b.select("market", "symbol").distinct().select("market", "symbol", days).withColumn("request_id", F.concat_ws("|", "symbol", "as_of"))
    history = _ranges(b).filter(F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int") % 3 != 0)
    return universe.point_in_time_slice(b, asked, history, "America/New_York").select("request_id", "session_date", "close")


def sliced_ticks(spark, sf):
    """Ticks as instants: the day in Seoul decides."""
    ticks = tables.minute_bars(spark, sf).select("market", "symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    asked = ticks.select("market", "symbol").distinct().select("market", "symbol", F.lit("2024-01-09").cast("date").alias("as_of"), F.col("symbol").alias("request_id"))
    return universe.point_in_time_slice(ticks, asked, _ranges(ticks).limit(0), "Asia/Seoul", "ts").select("request_id", "event_id")


def metadata(spark, sf):
    """Customers asked for, some twice, against assets of suppliers of the same number."""
    c = tables.table(spark, sf, "customer")
    asked = c.select(F.lit("US").alias("market"), (F.col("c_custkey") % 90).cast("string").alias("symbol"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("c_custkey").alias("position"))
    s = tables.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    assets = s.select(F.lit("US").alias("market"), k.cast("string").alias("symbol"), F.when(k % 4 == 0, "proxy").otherwise("stock").alias("kind"), F.when(k % 5 != 0, F.concat(F.lit("p/"), k.cast("string"))).alias("processed_path"),
                      F.when(k % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"), F.lit("common_stock").alias("security_type"), F.when(k % 3 == 0, F.lit("1995-01-01")).alias("listing_date"), F.lit(None).cast("string").alias("delisting_date"))
    return universe.security_metadata(asked, assets)


def text_stamps(spark, sf):
    """Bars with their days as text: some unreadable, some with an offset that is or is not the market's."""
    b = shared.raw_bars(spark, sf).select("market", "symbol", "session_date").withColumn("n", F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int") % 6)
    day = F.col("session_date").cast("string")
    stamp = (F.when((F.col("n") == 0) & (F.dayofmonth("session_date") == 13), "n/a").when(F.col("n") == 1, F.concat(day, F.lit("T00:00:00Z")))
             .when(F.col("n") == 2, F.concat(day, F.lit(" 00:00:00+09:00"))).otherwise(day))
    zone = F.when(F.col("market") == "KR", "Asia/Seoul").otherwise("America/New_York")
    rows = quality.read_stamps(b.withColumn("stamp", stamp).drop("session_date"), zone)
    return rows.groupBy("symbol").agg(F.count_if(~F.col("readable")).alias("unreadable"), F.count_if("off_zone").alias("off_zone"),
                                      F.count("session_date").alias("days"), F.max("session_date").alias("last"))


def board_rows(spark, sf):
    """Daily turnover ranks per board joined to a master; the best score per symbol and date."""
    daily, _ = tables.cross_section_rows(spark, sf)
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("session_date", "board").orderBy(F.regexp_replace("ACC_TRDVAL", ",", "").cast("double").desc(), "ISU_SRT_CD"))
    ranks = daily.select(F.col("session_date").alias("as_of"), "board", F.concat("ISU_SRT_CD", F.lit("_AL")).alias("stk_cd"),
                         F.regexp_replace("TDD_CLSPRC", ",", "").cast("double").alias("cur_prc"), rank.alias("position"))
    _, basic = tables.cross_section_rows(spark, sf)
    m = basic.select(F.col("ISU_SRT_CD").alias("symbol"), F.col("board").alias("exchange"), F.col("SECT_TP_NM").alias("sector"))
    return universe.board_candidates(ranks, m, 5000.0)


def board_candidates(spark, sf):
    return board_rows(spark, sf).select("as_of", "symbol", "board", "sector", "rank_score")


def board_selection(spark, sf):
    return universe.two_capped(board_rows(spark, sf), 8, 24)


def resolved(spark, sf):
    m = tables.master(spark, sf).select("symbol", F.col("english_name").alias("name"))
    p = tables.table(spark, sf, "part")
    words = p.select(F.explode(F.array(F.col("p_name"), F.concat("p_name", F.lit(" corp")), F.concat(F.lit("p"), tables.padded(F.col("p_partkey"), 5)),
                                       F.col("p_type"), F.split("p_name", " ")[0])).alias("query")).distinct()
    return universe.resolve(words, m)


def tails(spark, sf):
    return universe.tail_rows(shared.raw_bars(spark, sf), ["market", "symbol"], "session_date", 650).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("session_date").alias("first"))


def batch_gaps(spark, sf):
    """15-minute batches without an event, per event type."""
    e = tables.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    stamp = F.to_timestamp(F.floor(F.unix_seconds("ts") / 900) * 900)
    have = e.select("event_type", stamp.alias("batch")).distinct()
    span = have.groupBy("event_type").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi"))
    grid = span.select("event_type", F.explode(F.sequence("lo", "hi", F.expr("interval 15 minutes"))).alias("batch"))
    return grid.join(have, ["event_type", "batch"], "left_anti").select("event_type", F.date_format("batch", "yyyyMMddHHmmss").alias("batch"))


def raw_artifacts(spark, sf):
    """Content-addressed artifacts: hash is the name, repeats are stored once."""
    d = tables.table(spark, sf, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("data_hash"))
    return d.groupBy("source", "data_hash").agg(F.count(F.lit(1)).alias("arrivals"))


def symbols(spark, sf):
    m = tables.master(spark, sf)
    raw = F.concat(F.lower("symbol"), F.when(F.col("part_key") % 2 == 0, "_al").otherwise(" "))
    isin = F.concat(F.lit("KR7"), tables.padded(F.col("part_key"), 6), F.lit("003"))
    share = F.when(F.col("part_key") % 5 == 0, "brk.b").otherwise(F.col("symbol"))
    return m.select("symbol", universe.base_symbol(raw).alias("base"), universe.exchange_code(F.lit(""), isin).alias("code"), universe.normalize_us_symbol(share).alias("us"))


def numbers(spark, sf):
    o = tables.table(spark, sf, "orders")
    text = F.concat(F.when(F.col("o_custkey") % 2 == 0, "-").otherwise("+"), F.format_number("o_totalprice", 2))
    bad = F.when(F.col("o_custkey") % 7 == 0, "n/a").otherwise(text)
    return o.select("o_orderkey", cleaning.number(bad).alias("value"), cleaning.number(bad, True).alias("magnitude"))


def hourly_buckets(spark, sf):
    """STR1 as a batch: hourly bars of buckets that are closed at the stream's watermark."""
    from barlens.streaming.jobs import closed_buckets
    m = tables.minute_bars(spark, sf)
    b = closed_buckets(m, at("2024-01-20 12:30:00"))
    return b.select("symbol", F.unix_seconds("bucket").alias("bucket"), "open", "high", "low", "close", "volume", "trades")


QUERIES = {
    "src6_us_provider_bars": provider("US"), "src7_kr_provider_bars": provider("KR"), "flt2_categories": provider_categories,
    "agg19_issue_counts": issue_counts, "agg19_win_q1_gaps": gap_issues, "agg19_all_issues": all_issues, "top7_examples": issue_examples,
    "agg20_status": report_status, "agg21_assets": assets, "agg21_dataset": dataset, "snk2_published": publish, "snk4_upsert": upserted,
    "snk9_open_requests": open_requests, "snk1_artifacts": raw_artifacts, "join11_sessions": missing_sessions, "join12_weekdays": missing_weekdays,
    "win_r4_duplicates": duplicates, "flt21_trust_flags": trust_flags, "scl_d3_session_status": session_status,
    "flt6_completed_daily": completed_daily, "flt7_daily_freshness": daily_fresh, "flt8_minute_freshness": minute_fresh,
    "flt9_regular_session": regular_minutes, "flt10_completed_minutes": completed_minutes, "flt3_us_common": us_filter, "flt4_kr_common": kr_filter,
    "flt5_security_type": types, "join1_rankings": blended, "join2_rul18_candidates": candidates, "top1_win_r2_selection": selected,
    "agg25_stats": stats, "src9_join4_cross_section": cross_section, "win_r1_turnover_rank": cross_section_totals, "src9_prices": cross_prices,
    "src10_index_rows": index_rows, "agg23_membership": membership, "join5_members": member_bars, "flt12_flt13_eligible": eligible_days, "agg19_text_stamps": text_stamps, "flt13_sliced_bars": sliced_bars, "flt13_sliced_ticks": sliced_ticks, "join20_metadata": metadata,
   
    "join3_board_candidates": board_candidates, "top2_board_selection": board_selection, "flt18_resolution": resolved, "top8_tails": tails,
    "src13_batch_gaps": batch_gaps, "scl_s12_symbols": symbols, "scl_s11_numbers": numbers, "str1_closed_buckets": hourly_buckets,
}
