"""Readers of price datasets, snapshots and feeds, as typed DataFrames."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.functions import classify, text as t, times
from barlens.operators.cleaning import number

TRUTHY = ("1", "true", "yes", "y", "예")
PROXIES = ("SPY", "QQQ", "KOSPI", "KOSDAQ")
AMOUNTS = ("open", "high", "low", "close", "volume", "trade_value")


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price files, each read by its own header; the date is the first of timestamp, date, datetime.

    Files may differ in the order and number of their columns; a file without a date
    column gives no rows.  A date that cannot be read fails the job: a silent gap would
    shift every window.  Quoted fields hold no line breaks.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"), _stem().alias("stem"), place.alias("place"),
    ).filter(F.trim("value") != "")
    heads = lines.groupBy("file").agg(F.min("place").alias("top"), F.min_by("value", "place").alias("head")).select(
        "file", "top", F.transform(F.split("head", ","), lambda c: F.regexp_replace(c, '^"(.*)"$', "$1")).alias("names"))
    # Column names only: as many as the formats have, however many the files.
    seen = heads.select(F.size("names").alias("width"), F.explode("names").alias("name")).agg(F.max("width").alias("width"), F.collect_set("name").alias("names")).first()
    wanted = [c for c in AMOUNTS if c in seen["names"]] + sorted(c for c in seen["names"] if c.startswith(("raw_", "adjusted_", "adjustment_")))
    fields = F.from_csv(F.col("value"), ", ".join(f"c{k} string" for k in range(seen["width"] or 1)))
    rows = lines.join(heads, "file").filter(F.col("place") > F.col("top")).withColumn("row", fields)
    rows = rows.withColumn("cells", F.array(*[F.col(f"row.c{k}") for k in range(seen["width"] or 1)]))

    def at(name: str) -> Column:
        return F.nullif(F.array_position("names", F.lit(name)), F.lit(0)).cast("int") - 1

    rows = rows.withColumn("_date", F.coalesce(*[at(c) for c in ("timestamp", "date", "datetime")])).filter("_date is not null")
    day = F.get("cells", F.col("_date"))
    parsed = day.try_cast("date")
    parsed = F.when(day.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("bad date: "), day)).cast("date")).otherwise(parsed)
    return rows.select(F.upper("stem").alias("stem"), parsed.alias("session_date"), *[F.get("cells", at(c)).try_cast("double").alias(c) for c in wanted])


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin(*TRUTHY)


def dataset(spark: SparkSession, root: str, market: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stock bars, proxy bars, metadata) of a dataset folder; ETFs leave."""
    base = f"{root}/{market}"
    meta = spark.read.option("header", True).csv(f"{base}/stocks.csv")
    meta = meta.select(F.upper("symbol").alias("symbol"), *[
        F.coalesce(F.col(c) if c in meta.columns else F.lit(None).cast("string"), d).alias(c) for c, d in (
            ("exchange", F.lit("HIST")), ("name", F.upper("symbol")), ("sector", F.lit("")), ("is_etf", F.lit("false")))])
    meta = meta.withColumn("is_etf", truthy(F.col("is_etf")))
    bars = price_csv(spark, f"{base}/stocks/*.csv").withColumnRenamed("stem", "symbol")
    kept = bars.join(meta.filter("is_etf").select("symbol"), "symbol", "left_anti")
    proxies = price_csv(spark, f"{base}/proxies/*.csv").withColumnRenamed("stem", "symbol")
    tag = F.lit(market.upper()).alias("market")
    return kept.select(tag, "*"), proxies.select(tag, "*"), meta


def cache(spark: SparkSession, root: str, market: str) -> tuple[DataFrame, DataFrame]:
    """(stock bars, proxy bars) of cache files named EXCHANGE_SYMBOL."""
    bars = price_csv(spark, f"{root}/daily/*.csv")
    has = F.contains("stem", F.lit("_"))
    bars = bars.withColumns({
        "exchange": F.when(has, F.substring_index("stem", "_", 1)).otherwise(""),
        "symbol": F.when(has, F.regexp_replace("stem", "^[^_]*_", "")).otherwise(F.col("stem"))}).drop("stem")
    bars = bars.withColumn("market", F.lit(market.upper()))
    proxy = F.col("symbol").isin(*PROXIES)
    return bars.filter(~proxy), bars.filter(proxy)


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    u = spark.read.option("header", True).csv(path)
    if not {"date", "market", "symbol"} <= set(u.columns):
        raise ValueError("universe files need date, market and symbol")
    if "eligible" in u.columns:
        u = u.filter(truthy(F.col("eligible")))
    u = u.select(F.upper("market").alias("market"), F.to_date("date").alias("session_date"), F.upper("symbol").alias("symbol"))
    return u.filter(F.col("market").isin("US", "KR")).distinct()


ITEM = ("title string, url string, source string, published_at string, sentiment double, risk double, collected_at string, raw_hash string, "
        "source_type string, original_link string, provider_link string, scope string, event_id string, entities array<string>, event_time_precision string, synthetic_time boolean")
METRIC = "name string, symbol string, latest double, change_1d_pct double, change_5d_pct double, signal string, contribution double, weight double"
INTELLIGENCE = (
    "market string, as_of string, symbol string, scope string, score int, label string, market_score int, news_score int, event_risk int, "
    f"metrics array<struct<{METRIC.replace(' ', ':').replace(',:', ',')}>>, headlines array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, "
    f"event_headlines array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, official_headlines array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, "
    "notes array<string>, sources array<string>, generated_at string, market_context_score int, stock_context_score int, sector_context_score int")


def intelligence_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Context snapshots; absent keys take defaults, an unknown market fails the job.

    A snapshot time without an offset is unusable and becomes null.
    """
    j = spark.read.schema(INTELLIGENCE).json(path)
    market = F.upper(F.coalesce("market", F.lit("")))
    checked = F.when(market.isin("US", "KR"), market).otherwise(F.raise_error(F.lit("market must be US or KR")).cast("string"))
    zoned = F.regexp(F.coalesce("generated_at", F.lit("")), F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    empty = {c: F.coalesce(c, F.array().cast(j.schema[c].dataType)) for c in ("metrics", "headlines", "event_headlines", "official_headlines", "notes", "sources")}
    return j.withColumns({
        "market": checked, "as_of": F.to_date("as_of"), "symbol": F.upper(F.coalesce("symbol", F.lit("*"))),
        "environment_score": F.coalesce("score", F.lit(50)), "label": F.coalesce("label", F.lit("no_info")),
        "generated_at": F.when(zoned, F.col("generated_at").try_cast("timestamp")), **empty}).drop("score")


def minute_records(records: DataFrame) -> DataFrame:
    """records(market, symbol, record JSON, position) to intraday bars; first record of a time wins."""
    schema = "cntr_tm string, open_pric string, high_pric string, low_pric string, cur_prc string, trde_qty string"
    r = records.withColumn("r", F.from_json("record", schema))
    ts = F.when(F.col("market") == "US", times.session_clock(F.col("r.cntr_tm"), "US")).otherwise(times.session_clock(F.col("r.cntr_tm"), "KR"))
    prices = {c: number(F.col(f"r.{s}"), True) for c, s in (("open", "open_pric"), ("high", "high_pric"), ("low", "low_pric"), ("close", "cur_prc"))}
    df = r.select("market", "symbol", "position", ts.alias("ts"), *[e.alias(c) for c, e in prices.items()], number(F.col("r.trde_qty"), True).alias("volume"))
    names = list(prices)
    valid = F.col("ts").isNotNull() & (F.least(*names) > 0) & (F.col("high") >= F.greatest(*names)) & (F.col("low") <= F.least(*names))
    for c in names:
        valid = valid & F.col(c).isNotNull()
    first = df.filter(valid).groupBy("market", "symbol", "ts").agg(F.min_by(F.struct(*names, "volume"), "position").alias("p")).select("market", "symbol", "ts", "p.*")
    us = F.col("market") == "US"
    return first.withColumn("volume", F.when(us, F.coalesce("volume", F.lit(0.0))).otherwise(F.col("volume")))


# ---- tab-separated feeds ---------------------------------------------------------------------


#: Lines of an archive member handed on at a time.
MEMBER_LINES = 10_000


def member_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of the first member of every zip archive under ``path``, one archive a row of the task's input.

    A member is unpacked as a stream, MEMBER_LINES lines at a time; only the archive itself, compressed, is held whole.
    Undecodable bytes are replaced; an archive without members has no lines, one that is no archive fails the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    members = [m for m in archive.infolist() if not m.is_dir()]
                    if not members:
                        continue
                    with archive.open(members[0]) as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="replace") as text:
                        while lines := list(itertools.islice(text, MEMBER_LINES)):
                            yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\n") for x in lines], pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def tab_rows(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines split at tabs; lines with fewer than ``least`` fields are skipped.  A path ending in .zip names archives."""
    lines = member_lines(spark, path) if path.lower().endswith(".zip") else spark.read.text(path)
    lines = lines.select(F.split("value", "\t").alias("f"))
    return lines.filter(F.size("f") >= least)


def _pick(names: dict[str, int]) -> list[Column]:
    return [F.get("f", k).alias(n) for n, k in names.items()]


def event_export(spark: SparkSession, path: str) -> DataFrame:
    return tab_rows(spark, path, 61).select(*_pick({
        "gdelt_event_id": 0, "sql_date": 1, "actor1_name": 6, "actor2_name": 16, "event_code": 27, "event_base_code": 28,
        "event_root_code": 29, "quad_class": 30, "goldstein_scale": 31, "num_mentions": 32, "num_sources": 33, "num_articles": 34,
        "average_tone": 35, "date_added": 59, "source_url": 60}))


def mentions(spark: SparkSession, path: str) -> DataFrame:
    return tab_rows(spark, path, 14).select(*_pick({
        "gdelt_event_id": 0, "event_time": 1, "mention_time": 2, "mention_type": 3, "mention_source_name": 4, "mention_identifier": 5,
        "sentence_id": 6, "confidence": 11, "document_length": 12, "document_tone": 13}))


def knowledge_graph(spark: SparkSession, path: str) -> DataFrame:
    g = tab_rows(spark, path, 18).select(*_pick({
        "record_id": 0, "published": 1, "source_collection": 2, "source_name": 3, "source_url": 4, "themes": 7,
        "organizations": 13, "enhanced_organizations": 14, "tone": 15, "gcam": 17}))
    orgs = F.array_distinct(F.concat(t.semicolon_values(F.col("organizations")), t.semicolon_values(F.col("enhanced_organizations"), True)))
    return g.withColumns({"organizations": orgs, "themes": t.semicolon_values(F.col("themes"))}).drop("enhanced_organizations").filter(F.size("organizations") > 0)


def graph_events(graph: DataFrame, targets: DataFrame, export: DataFrame, mentioned: DataFrame, collected_at: Column) -> DataFrame:
    """Graph records naming a target company, with the event ids seen for their URL.

    Organisations and aliases meet in equi-joins: on the folded name, and on the
    legal root where the organisation carries a legal suffix.
    """
    from barlens.functions import fixed_values as fixed

    aliases = targets.select("market", "symbol", "company_name", F.explode(F.array_distinct(F.concat(F.array("company_name"), "aliases"))).alias("alias"))
    aliases = aliases.withColumns({"name": t.entity_name(F.col("alias")), "root": t.corporate_root(F.col("alias"))})
    aliases = aliases.filter((F.col("name") != "") & (F.col("name") != t.entity_name(F.col("symbol"))))
    words = F.split("name", " ")
    generic = F.col("name").isin(*fixed.GENERIC_NAMES)
    qualified = (~generic & ((F.size(words) > 1) | (F.col("name") == t.entity_name(F.col("company_name"))))) | F.arrays_overlap(
        words, F.array(*[F.lit(x) for x in fixed.CORPORATE_SUFFIXES]))
    aliases = aliases.filter(qualified)
    orgs = graph.select("record_id", F.explode("organizations").alias("org")).select("record_id", t.entity_name(F.col("org")).alias("name"), t.corporate_root(F.col("org")).alias("root"))
    legal = F.arrays_overlap(F.split("name", " "), F.array(*[F.lit(x) for x in fixed.LEGAL_SUFFIXES]))
    target = ["market", "symbol", "company_name", "alias"]
    by_name = orgs.select("record_id", "name").join(aliases.select(*target, "name"), "name")
    by_root = orgs.filter(legal & (F.col("root") != "")).select("record_id", "root").join(aliases.select(*target, "root"), "root")
    hits = by_name.select("record_id", *target).unionByName(by_root.select("record_id", *target)).groupBy("record_id", "market", "symbol", "company_name").agg(
        F.sort_array(F.collect_set("alias")).alias("matched_aliases"))
    ids = export.filter("source_url <> ''").select(t.canonical_url(F.col("source_url")).alias("url_key"), "gdelt_event_id", F.lit(0).alias("o")).unionByName(
        mentioned.filter("mention_identifier <> ''").select(t.canonical_url(F.col("mention_identifier")).alias("url_key"), "gdelt_event_id", F.lit(1).alias("o")))
    # Distinct ids per URL; a URL mentioned a million times still sends each id once.
    ids = ids.filter("gdelt_event_id <> ''").groupBy("url_key", "gdelt_event_id").agg(F.min("o").alias("o"), F.count_if(F.col("o") == 1).alias("m"))
    ids = ids.groupBy("url_key").agg(F.count(F.lit(1)).alias("related_events"), F.sum("m").alias("mention_count"), F.min_by("gdelt_event_id", F.struct("o", "gdelt_event_id")).alias("_first"))
    g = graph.withColumn("url_key", t.canonical_url(F.col("source_url"))).join(hits, "record_id").join(ids, "url_key", "left")
    kind = classify.event_type(F.concat_ws(" ", F.array_join("themes", " "), "source_url"))
    return g.select(
        t.stable_id("evt", F.lit("GDELT_GKG"), F.col("record_id"), F.col("symbol")).alias("event_id"), "market", "symbol", "company_name",
        kind.alias("event_type"), times.parse_datetime(F.col("published")).alias("event_time"),
        times.parse_datetime(F.substring("record_id", 1, 14)).alias("first_seen_at"), F.lit("GDELT_GKG").alias("source_type"),
        "source_name", "source_url", F.lit("").alias("title"), collected_at.alias("collected_at"),
        t.stable_id("article", F.lit("GDELT_GKG"), F.col("record_id"), F.col("source_url")).alias("article_id"),
        F.col("organizations").alias("entities"), "matched_aliases", F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.when(F.col("related_events") == 1, F.col("_first")).otherwise("").alias("gdelt_event_id"),
        F.lit(3).alias("source_level"), F.lit("COMPANY").alias("scope"), F.lit("DIRECT_COMPANY").alias("relevance_status"),
    ).filter("event_time is not null and first_seen_at is not null")


# ---- filings and news -----------------------------------------------------------------------------


def kr_filings(rows: DataFrame, collected_at: Column) -> DataFrame:
    """Filing list rows (corp_name, stock_code, report_nm, rcept_no, rcept_dt): usable from the end of their day."""
    full = (F.trim("rcept_no") != "") & (F.trim("rcept_dt") != "") & (F.trim("report_nm") != "")
    at = times.parse_datetime(F.col("rcept_dt"), "Asia/Seoul", True)
    symbol = F.lpad(F.upper("stock_code"), 6, "0")
    number_ = F.trim("rcept_no")
    return rows.filter(full).select(
        t.stable_id("evt", F.lit("OPENDART"), number_, F.col("stock_code")).alias("event_id"), F.lit("KR").alias("market"), symbol.alias("symbol"),
        F.col("corp_name").alias("company_name"), classify.event_type(F.col("report_nm")).alias("event_type"), at.alias("event_time"), at.alias("first_seen_at"),
        F.lit("OPENDART").alias("source_type"), F.concat(F.lit("https://dart.fss.or.kr/dsaf001/main.do?rcpNo="), number_).alias("source_url"),
        F.trim("report_nm").alias("title"), collected_at.alias("collected_at"), t.stable_id("filing", F.lit("OPENDART"), number_).alias("article_id"),
        F.lit("date").alias("event_time_precision"), F.lit(True).alias("synthetic_time"), F.lit("PARTIALLY_TRUSTED").alias("pit_trust"),
        F.contains("report_nm", F.lit("정정")).alias("is_correction"), F.array("corp_name").alias("entities"),
        F.lit(1).alias("source_level"), F.lit("COMPANY").alias("scope"), F.lit("DIRECT_COMPANY").alias("relevance_status"))


def company_codes(spark: SparkSession, path: str) -> DataFrame:
    """Company-code XML to (corp_code, corp_name, ticker); only listed companies have a ticker."""
    x = spark.read.format("xml").option("rowTag", "list").schema("corp_code string, corp_name string, stock_code string").load(path)
    return x.filter((F.trim("corp_code") != "") & (F.trim("stock_code") != "")).select(
        F.trim("corp_code").alias("corp_code"), F.trim("corp_name").alias("corp_name"), F.lpad(F.trim("stock_code"), 6, "0").alias("ticker"))


SUBMISSION_FIELDS = ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "primaryDocument", "items")


def submission_rows(payloads: DataFrame) -> DataFrame:
    """Column-oriented submissions (cik, ticker, company_name, recent struct of arrays) to rows; short arrays pad."""
    zipped = F.arrays_zip(*[F.col(f"recent.{c}").alias(c) for c in SUBMISSION_FIELDS])
    rows = payloads.select("cik", "ticker", "company_name", F.inline(zipped).alias(*SUBMISSION_FIELDS))
    return rows.select("cik", "ticker", "company_name", *[F.coalesce(c, F.lit("")).alias(c) for c in SUBMISSION_FIELDS])


def us_filings(rows: DataFrame, collected_at: Column, forms: tuple[str, ...], start: str) -> DataFrame:
    form = F.upper(F.trim("form"))
    rows = rows.filter(form.isin(*forms) & ((F.col("filingDate") == "") | (F.col("filingDate") >= start)))
    rows = rows.filter((F.trim("accessionNumber") != "") & (F.trim("filingDate") != ""))
    precise = F.trim("acceptanceDateTime") != ""
    at = F.when(precise, times.parse_datetime(F.col("acceptanceDateTime"), "America/New_York")).otherwise(
        times.parse_datetime(F.col("filingDate"), "America/New_York", True))
    number_ = F.trim("accessionNumber")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"),
                   F.replace(number_, F.lit("-"), F.lit("")), F.lit("/"), F.trim("primaryDocument"))
    title = F.concat(F.lit("SEC "), form, F.when(F.col("items") != "", F.concat(F.lit(" items "), F.col("items"))).otherwise(""))
    return rows.select(
        t.stable_id("evt", F.lit("SEC_EDGAR"), number_, F.col("ticker")).alias("event_id"), F.lit("US").alias("market"), F.upper("ticker").alias("symbol"), "company_name",
        classify.event_type(form, form, F.col("items")).alias("event_type"), at.alias("event_time"), at.alias("first_seen_at"), F.lit("SEC_EDGAR").alias("source_type"),
        url.alias("source_url"), title.alias("title"), collected_at.alias("collected_at"), t.stable_id("filing", F.lit("SEC_EDGAR"), number_).alias("article_id"),
        F.when(precise, "second").otherwise("date").alias("event_time_precision"), F.when(precise, "TRUSTED").otherwise("PARTIALLY_TRUSTED").alias("pit_trust"),
        F.endswith(form, F.lit("/A")).alias("is_correction"), F.array("company_name", F.upper("ticker"), "cik").alias("entities"),
        F.lit(1).alias("source_level"), F.lit("COMPANY").alias("scope"), F.lit("DIRECT_COMPANY").alias("relevance_status"))


def _news(rows: DataFrame, source_type: str, collected_at: Column, market: Column) -> DataFrame:
    """rows(title, url, published, symbol, company_name, aliases) to events; no title or time, no event."""
    rows = rows.withColumn("title", t.clean_html(F.col("title"))).withColumn("event_time", times.parse_datetime(F.col("published")))
    rows = rows.filter("title <> '' and event_time is not null")
    rel = classify.company_relevance(F.col("title"), F.col("company_name"), F.col("symbol"), F.col("aliases"), F.array().cast("array<string>"))
    article = t.stable_id("article", t.canonical_url(F.col("url")), F.col("title"))
    rows = rows.withColumns({"rel": rel, "article_id": article})
    return rows.select(
        t.stable_id("evt", F.lit(source_type), F.col("article_id"), F.col("symbol")).alias("event_id"), market.alias("market"), F.upper("symbol").alias("symbol"), "company_name",
        classify.event_type(F.col("title")).alias("event_type"), "event_time", collected_at.alias("first_seen_at"), F.lit(source_type).alias("source_type"),
        F.col("url").alias("source_url"), "title", collected_at.alias("collected_at"), "article_id", F.col("rel.scope").alias("scope"),
        F.col("rel.status").alias("relevance_status"), F.col("rel.matches").alias("entities"), classify.source_level(F.lit(source_type)).alias("source_level"),
        classify.sentiment(F.col("title")).alias("sentiment"), classify.headline_risk(F.col("title")).alias("risk"))


def search_news(payloads: DataFrame, collected_at: Column) -> DataFrame:
    """News-search payloads (symbol, company_name, aliases, body JSON) to events."""
    body = F.from_json("body", "items array<struct<title:string,originallink:string,link:string,pubDate:string,description:string>>")
    rows = payloads.select("symbol", "company_name", "aliases", F.explode(body["items"]).alias("i"))
    url = F.coalesce(F.nullif("i.originallink", F.lit("")), F.col("i.link"), F.lit(""))
    return _news(rows.select("symbol", "company_name", "aliases", F.col("i.title").alias("title"), url.alias("url"), F.col("i.pubDate").alias("published")),
                 "NAVER_NEWS", collected_at, F.lit("KR"))


def rss_news(spark: SparkSession, path: str, target: dict, collected_at: Column) -> DataFrame:
    """RSS items of one search for one company."""
    x = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, source string").load(path)
    rows = x.select(F.lit(target["symbol"]).alias("symbol"), F.lit(target["company_name"]).alias("company_name"),
                    F.array(*[F.lit(a) for a in target.get("aliases", ())]).cast("array<string>").alias("aliases"),
                    "title", F.trim("link").alias("url"), F.col("pubDate").alias("published"))
    return _news(rows, "GOOGLE_NEWS_RSS", collected_at, F.lit(target["market"]))


def article_list(payloads: DataFrame) -> DataFrame:
    """Article-list JSON to global-event items."""
    body = F.from_json("body", "articles array<struct<title:string,url:string,domain:string,seendate:string>>")
    rows = payloads.select(F.explode(body["articles"]).alias("a")).withColumn("title", t.clean_html(F.col("a.title"))).filter("title <> ''")
    return rows.select("title", F.col("a.url").alias("url"), F.coalesce(F.nullif("a.domain", F.lit("")), F.lit("GDELT")).alias("source"),
                       F.col("a.seendate").alias("published_at"), classify.sentiment(F.col("title")).alias("sentiment"), classify.headline_risk(F.col("title")).alias("risk"),
                       F.lit("GDELT_DOC").alias("source_type"), F.lit(3).alias("source_level"), F.lit("GLOBAL_EVENT").alias("scope"), F.lit("GLOBAL_CANDIDATE").alias("relevance_status"))


def split_company_news(items: DataFrame, company: dict) -> tuple[DataFrame, DataFrame]:
    """(direct company items, context items) of one company's search result."""
    none = F.array().cast("array<string>")
    rel = classify.company_relevance(F.col("title"), F.lit(company["company_name"]), F.lit(company["symbol"]), none, none)
    tagged = items.withColumn("_rel", rel).withColumns({"scope": F.col("_rel.scope"), "relevance_status": F.col("_rel.status")}).drop("_rel")
    direct = (F.col("scope") == "COMPANY") & (F.col("relevance_status") == "DIRECT_COMPANY")
    return tagged.filter(direct), tagged.filter(~direct)


def visible_items(items: DataFrame, market: str, symbol: str, analysis_time: Column) -> DataFrame:
    """Headlines shown with an analysis as events; items without title or time are skipped."""
    url = F.coalesce("url", F.lit(""))
    article = t.stable_id("article", t.canonical_url(url), F.col("title"))
    source = F.replace(F.upper(F.coalesce("source_type", F.lit("ANALYSIS"))), F.lit(" "), F.lit("_"))
    rows = items.withColumns({"article_id": article, "_source": source, "event_time": times.parse_datetime(F.col("published_at"))})
    rows = rows.filter((F.coalesce("title", F.lit("")) != "") & F.col("event_time").isNotNull())
    return rows.select(
        t.stable_id("evt", F.col("_source"), F.col("article_id"), F.lit(market), F.lit(symbol)).alias("event_id"), F.lit(market.upper()).alias("market"),
        F.lit(symbol.upper()).alias("symbol"), classify.event_type(F.col("title")).alias("event_type"), "event_time",
        F.coalesce(times.parse_datetime(F.col("collected_at")), analysis_time).alias("first_seen_at"), F.col("_source").alias("source_type"), url.alias("source_url"), "title",
        "article_id", classify.source_level(F.col("_source")).alias("source_level"), classify.scope(F.col("title"), "MARKET" if symbol == "*" else "COMPANY").alias("scope"),
        F.when(F.col("_source") == "NAVER_NEWS", "TRUSTED").otherwise("PARTIALLY_TRUSTED").alias("pit_trust"))


def mapped_targets(targets: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets with their filing-company code, targets without one)."""
    keyed = targets.withColumn("ticker", F.lpad("symbol", 6, "0"))
    return keyed.join(codes, "ticker"), keyed.join(codes, "ticker", "left_anti")


def collection_status(results: DataFrame) -> DataFrame:
    """Per source: unavailable with errors and no events, partial with both, else success."""
    g = results.groupBy("source").agg(F.sum("events").alias("events"), F.sum("errors").alias("errors"))
    status = F.when((F.col("errors") > 0) & (F.col("events") == 0), "unavailable").when(F.col("errors") > 0, "partial").otherwise("success")
    return g.withColumn("status", status)
