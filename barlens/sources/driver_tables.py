"""Adapters that turn the generic test tables into the engine's inputs.

Each adapter reads whole tables. Symbols are part brands, sessions are ship
dates, news items are documents; the derivations only reshape columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOT = 5000.0  # one unit of l_quantity counts as this many shares


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_of(symbol: Column) -> Column:
    number = F.regexp_extract(symbol, "([0-9]+)$", 1).cast("int")
    return F.when(number % 2 == 0, "KR").otherwise("US")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.to_date("l_shipdate").alias("session_date"),
    )


def _bars(trades: DataFrame, *keys: str) -> DataFrame:
    # (order, line) repeats in the data, so ties need the full row as the order.
    first_to_last = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    price = F.col("l_extendedprice")
    group = [*keys, "session_date"]
    # Plain numbers are reduced by hashing; only trades of a bar's first and last order are compared whole.
    whole = trades.groupBy(*group).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_quantity") * LOT).alias("volume"),
        F.when(F.count("l_orderkey") == F.count(F.lit(1)), F.min("l_orderkey")).alias("_from"), F.max("l_orderkey").alias("_to"))
    edges = whole.select(*[F.col(c).alias(f"_{c}") for c in group], "_from", "_to")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    at_edge = F.col("l_orderkey").eqNullSafe(F.col("_from")) | F.col("l_orderkey").eqNullSafe(F.col("_to"))
    ends = trades.join(edges, [*same, at_edge]).groupBy(*group).agg(
        F.min_by(price, first_to_last).alias("open"), F.max_by(price, first_to_last).alias("close"))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in group], "open", "close")
    return whole.join(ends, same).select(*group, "open", "high", "low", "close", "volume")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars(market, symbol, session_date, open, high, low, close, volume).

    One row per symbol and session: everything downstream that windows over a
    symbol therefore holds at most the number of calendar days.
    """
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    trades = _trades(spark, sf_dir).join(brands, F.col("l_partkey") == F.col("p_partkey"))
    bars = _bars(trades, "symbol")
    return bars.select(
        market_of(F.col("symbol")).alias("market"), "symbol", "session_date",
        "open", "high", "low", "close", "volume",
    )


def proxy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two index series per market, from the two line statuses."""
    names = F.when(F.col("l_linestatus") == "O", F.array(
        F.struct(F.lit("US").alias("market"), F.lit("SPY").alias("symbol")),
        F.struct(F.lit("KR").alias("market"), F.lit("KOSPI").alias("symbol")),
    )).otherwise(F.array(
        F.struct(F.lit("US").alias("market"), F.lit("QQQ").alias("symbol")),
        F.struct(F.lit("KR").alias("market"), F.lit("KOSDAQ").alias("symbol")),
    ))
    bars = _bars(_trades(spark, sf_dir), "l_linestatus")
    return bars.select(
        F.inline(names), "session_date", "open", "high", "low", "close", "volume"
    )


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second exchange calendar: the distinct order dates."""
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("session_date")
    ).distinct()


def provider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily chart payloads as a provider sends them: text fields, thousands
    separators, a sign for down days, several records for one date."""
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    t = _trades(spark, sf_dir).join(brands, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice")
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("")

    def text(value: Column) -> Column:
        return F.concat(sign, F.format_number(value, 4))

    record = F.to_json(F.struct(
        F.date_format("session_date", "yyyyMMdd").alias("dt"),
        text(price * (1 - F.col("l_discount"))).alias("open_pric"),
        text(price).alias("high_pric"),
        text(price * 0.85).alias("low_pric"),
        text(price * (1 - F.col("l_tax"))).alias("cur_prc"),
        F.when(F.col("l_linenumber") != 7, F.format_number(F.col("l_quantity") * LOT, 0)).alias("acc_trde_qty"),
        F.when(F.col("l_linenumber") > 3, text(price * 100)).alias("acc_trde_prica"),
    ))
    return t.select(
        market_of(F.col("symbol")).alias("market"), "symbol", record.alias("record"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                 "l_quantity").alias("position"),
    )


def padded(number: Column, width: int) -> Column:
    """The number's text with leading zeros; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday observations: one per event, symbol = event type, price = value."""
    e = table(spark, sf_dir, "events")
    value = F.col("value")
    return e.select(
        F.when(F.col("event_type").isin("click", "view", "error"), "US").otherwise("KR").alias("market"),
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        value.alias("open"), value.alias("high"), value.alias("low"), value.alias("close"),
        F.lit(1.0).alias("volume"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security master: one row per part, names and sectors from the part columns."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P"), padded(F.col("p_partkey"), 5)).alias("symbol"),
        F.when(F.col("p_size") % 3 == 0, "NASDAQ").when(F.col("p_size") % 3 == 1, "NYSE")
        .otherwise("AMEX").alias("exchange"),
        F.concat(F.initcap("p_name"), F.when(F.col("p_size") % 11 == 0, " Warrants")
                 .when(F.col("p_size") % 7 == 0, " Corp Preferred").otherwise(" Corp")).alias("english_name"),
        F.concat(F.col("p_brand"), F.when(F.col("p_size") % 13 == 0, "우").otherwise("")).alias("korean_name"),
        F.when(F.col("p_size") % 17 == 0, "").otherwise(F.col("p_type")).alias("sector"),
        (F.col("p_size") % 19 == 0).alias("is_etf"),
        F.col("p_retailprice").alias("list_price"),
        F.col("p_partkey").alias("part_key"),
    )


def part_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover, value and last price per part: the ranking service's raw numbers."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity") * 100).alias("traded_units"),
        F.max("l_extendedprice").alias("market_cap"),
        F.count(F.lit(1)).alias("trades"),
    )


def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rankings(kind, stex_tp, stk_cd, cur_prc, amount): two rank lists."""
    m = master(spark, sf_dir)
    r = part_turnover(spark, sf_dir).join(m, F.col("l_partkey") == F.col("part_key"))
    base = [F.col("exchange").alias("stex_tp"), F.col("symbol").alias("stk_cd"),
            (F.col("market_cap") / 1000 - 80).alias("cur_prc")]
    # Each list is a view of the same rows; a security may be on one list only.
    cap = r.filter(F.col("trades") >= 20).select(F.lit("cap").alias("kind"), *base, F.col("market_cap").alias("amount"))
    value = r.filter(F.col("traded_units") >= 60000).select(
        F.lit("value").alias("kind"), *base, F.col("traded_units").cast("double").alias("amount"))
    return cap.unionByName(value)


def cross_section_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exchange daily rows and basic-info rows (all text), one board per brand parity."""
    bars = daily_bars(spark, sf_dir)
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    code = padded(number, 6)
    board = F.when(number % 2 == 0, "KOSDAQ").otherwise("KOSPI")
    daily = bars.select(
        "session_date", board.alias("board"), code.alias("ISU_SRT_CD"), F.col("symbol").alias("ISU_NM"),
        F.format_number("open", 2).alias("TDD_OPNPRC"), F.format_number("high", 2).alias("TDD_HGPRC"),
        F.format_number("low", 2).alias("TDD_LWPRC"), F.format_number("close", 2).alias("TDD_CLSPRC"),
        F.format_number("volume", 0).alias("ACC_TRDVOL"),
        # Thousands keep the text exact on both sides.
        F.format_number(F.round(F.col("close")) * F.col("volume"), 0).alias("ACC_TRDVAL"),
    )
    basic = (
        table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"))
        .agg(F.min_by("p_type", "p_partkey").alias("sector"), F.count(F.lit(1)).alias("parts"))
        .select(
            board.alias("board"), code.alias("ISU_SRT_CD"),
            F.concat(F.lit("KR7"), code, F.lit("003")).alias("ISU_CD"), F.col("symbol").alias("ISU_ABBRV"),
            F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (number * 30).cast("int")), "yyyyMMdd").alias("LIST_DD"),
            F.when(number % 6 == 0, "구형우선주").when(number % 7 == 0, "").otherwise("보통주").alias("KIND_STKCERT_TP_NM"),
            F.col("sector").alias("SECT_TP_NM"),
        )
    )
    return daily, basic


SOURCE_TYPES = ("OPENDART", "SEC_EDGAR", "NAVER_NEWS", "GOOGLE_NEWS_RSS", "GDELT_GKG", "GDELT_DOC")


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised news evidence: one event per document, the whole text as title.

    A file may hold all its rows in one group, which one task reads; the rows are dealt out before any work on texts.
    """
    d = table(spark, sf_dir, "documents").repartition("doc_id", "n_chars")
    doc = F.col("doc_id")
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    digest = F.md5(F.col("text").cast("binary"))
    symbol = F.when(F.col("lang") == "de", "*").otherwise(F.concat(F.lit("Brand#"), (doc % 25 + 1).cast("string")))
    event_time = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=doc.cast("int")))
    shift = F.make_dt_interval(hours=((doc % 7) - 1).cast("int"))
    source_type = F.element_at(F.array(*[F.lit(x) for x in SOURCE_TYPES]), n % 6 + 1)
    return d.select(
        F.concat(F.lit("evt_"), padded(doc, 9)).alias("event_id"),
        F.when(F.col("lang") == "de", "KR").otherwise(market_of(symbol)).alias("market"),
        symbol.alias("symbol"),
        event_time.alias("event_time"),
        F.when(doc % 11 != 0, event_time + shift).alias("first_seen_at"),
        source_type.alias("source_type"),
        F.concat(F.lit("HTTPS://www.News.example.com//a/"), F.substring(digest, 1, 2),
                 F.when(n % 2 == 0, "/?utm_source=feed&b=2&a=1").otherwise("?a=1&b=2#top")).alias("source_url"),
        F.col("text").alias("title"),
        F.when(doc % 5 != 0, F.concat(F.lit("article_"), F.substring(F.md5(F.concat_ws(
            "|", "source", "lang", (F.col("n_chars") % 50).cast("string")).cast("binary")), 1, 24))).otherwise("").alias("article_id"),
        F.array(F.upper("lang"), F.col("source")).alias("entities"),
        F.map_from_arrays(
            F.array(F.lit("raw_hash"), F.lit("accession_number")),
            F.array(F.sha2(F.col("text").cast("binary"), 256),
                    F.when(doc % 13 == 0, F.concat(F.lit("K"), (F.col("n_chars") % 20).cast("string"))).otherwise("")),
        ).alias("raw_reference"),
        F.col("lang"), F.col("source"), doc.alias("doc_id"),
    )


def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation-graph events: those of the news items, with the organisations their record names (the text's
    first word and one made from the row's number) and the names their company is searched by."""
    doc, number = F.col("doc_id"), F.regexp_extract("symbol", "([0-9]+)$", 1)
    company = F.concat(F.lit("Brand "), number, F.lit(" Works"))
    made = F.element_at(F.array(F.upper(company), F.concat(company, F.lit(" Co., Ltd.")), F.lit("Brand"), F.lit("Apple"), F.lit("Apple Inc."),
                                F.col("symbol"), F.concat(F.lit("New "), company)), (doc % 7 + 1).cast("int"))
    aliases = F.concat(F.array(F.lit("Apple"), F.col("symbol")), F.when(doc % 2 == 0, F.array(F.lit("Apple Inc"))).otherwise(F.array().cast("array<string>")))
    return news_items(spark, sf_dir).filter("source_type = 'GDELT_GKG'").select(
        "event_id", "market", "symbol", "source_type", company.alias("company_name"), aliases.alias("matched_aliases"),
        F.array(F.substring_index("title", " ", 1), made).alias("organizations"))


def intelligence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context scores per (market, as_of, symbol or *), generated some time that day."""
    o = table(spark, sf_dir, "orders")
    cust = F.col("o_custkey")
    symbol = F.when(F.col("o_orderpriority") == "1-URGENT",
                    F.concat(F.lit("Brand#"), (cust % 25 + 1).cast("string"))).otherwise("*")
    market = F.when(symbol != "*", market_of(symbol)).when(cust % 2 == 0, "KR").otherwise("US")
    g = o.select(F.to_date("o_orderdate").alias("as_of"), market.alias("market"), symbol.alias("symbol"),
                 "o_orderkey", cust.alias("c")).groupBy("market", "as_of", "symbol").agg(
        (F.max("o_orderkey") % 101).cast("int").alias("market_score"),
        F.when(F.min("c") % 9 != 0, (F.max("c") % 101).cast("int")).alias("news_score"),
        F.when(F.min("c") % 8 != 0, ((F.count(F.lit(1)) * 17 + F.min("c")) % 101).cast("int")).alias("event_risk"),
        (F.min("o_orderkey") % 24).cast("int").alias("hour"),
    )
    return g.withColumn(
        "generated_at", F.col("as_of").cast("timestamp") + F.make_dt_interval(hours=F.col("hour"))
    ).drop("hour")
