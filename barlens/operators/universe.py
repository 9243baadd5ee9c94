"""Security filters, rankings, cross-sections and universe selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions import fixed_values as fixed
from barlens.operators.cleaning import number

UNSORTED = "unclassified"


def normalize_us_symbol(symbol: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in fixed.CLASS_SHARES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, s), s)


def base_symbol(symbol: Column) -> Column:
    return F.substring_index(F.upper(F.trim(F.coalesce(symbol, F.lit("")))), "_", 1)


def exchange_code(*fields: Column) -> Column:
    """Six-digit code of the first field that is one, or an ISIN holding one."""
    result = []
    for f in fields:
        v = F.upper(F.regexp_replace(F.coalesce(f, F.lit("")), r"(?U)\s+", ""))
        result.append(F.when(F.regexp(v, F.lit(r"^\d{6}$")), v).when(F.regexp(v, F.lit(r"^KR[A-Z0-9]\d{6}[A-Z0-9]{3}$")), F.substring(v, 4, 6)))
    return F.coalesce(*result, F.lit(""))


def us_common_stock() -> Column:
    name = F.trim(F.concat_ws(" ", "korean_name", "english_name"))
    return (
        F.col("exchange").isin(*fixed.US_EXCHANGES) & (F.col("symbol") != "") & ~F.col("is_etf")
        & ~F.upper("symbol").isin(*fixed.US_PROXIES) & ~F.regexp(name, F.lit(fixed.EXCLUDED_NAME))
        & ~F.regexp(F.col("symbol"), F.lit(fixed.EXCLUDED_SYMBOL)))


def kr_common_stock() -> Column:
    """Needs symbol, exchange, is_etf, name, market_name, audit_info, state, order_warning."""
    name = F.trim(F.col("name"))
    board = F.when(F.col("exchange") == "KOSPI", fixed.BOARD_NAMES["KOSPI"]).otherwise(fixed.BOARD_NAMES["KOSDAQ"])
    market = F.trim(F.coalesce("market_name", F.lit("")))
    warning = F.trim(F.coalesce("order_warning", F.lit("")))
    status = F.concat_ws(" ", "audit_info", "state")
    return (
        F.col("exchange").isin("KOSPI", "KOSDAQ") & ~F.col("is_etf") & F.regexp(F.upper("symbol"), F.lit("^[0-9A-Z]{6}$"))
        & ((market == "") | (market == board)) & (name != "")
        & ~F.regexp(name, F.lit("(?i)(?:스팩|SPAC|기업인수목적)")) & ~F.regexp(name, F.lit("(?i)(?:우|우B|우C|[1-9]우B|[1-9]우C|우선주)$"))
        & ~F.regexp(name, F.lit("(?i)(?:ETF|ETN)$")) & warning.isin("", "0") & ~F.regexp(status, F.lit("|".join(fixed.STATUS_RISKS))))


def security_type(kind: Column, name: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    preferred = F.contains(k, F.lit("우선")) | F.contains(k, F.lit("preferred")) | F.regexp(name, F.lit("(?i)우(?:b|c)?$"))
    return F.when(preferred, "preferred_stock").when(F.contains(k, F.lit("보통")) | F.contains(k, F.lit("common")), "common_stock").otherwise("unknown_stock_type")


def _pieces(text: Column, width: int) -> Column:
    """Distinct substrings of ``width`` characters."""
    starts = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(width))))


def _containing(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(_q, _n): the names that contain a query text, both distinct.

    A query meets the names that hold its rarest piece of three characters (all of it, if it is shorter).
    """
    width = F.least(F.lit(3), F.length("_q"))
    asked = queries.filter(F.length("_q") > 0).select("_q", F.explode(F.when(width == 3, _pieces(F.col("_q"), 3)).otherwise(F.array("_q"))).alias("g"))
    grams = names.select("_n", F.explode(F.concat(*[_pieces(F.col("_n"), n) for n in (1, 2, 3)])).alias("g")).join(
        asked.select("g").distinct().hint("merge"), "g", "left_semi")
    # A piece that no name holds counts as rarest, and then nothing is met.
    known = asked.join(grams.groupBy("g").agg(F.count(F.lit(1)).alias("names")).hint("merge"), "g", "left")
    rarest = known.groupBy("_q").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "g")).alias("r")).select("_q", F.col("r.g").alias("g"))
    return rarest.join(grams.hint("merge"), "g").filter(F.contains(F.col("_n"), F.col("_q"))).select("_q", "_n")


def resolve(queries: DataFrame, master: DataFrame) -> DataFrame:
    """query text to security: exact code, else exact name, else a name containing it.

    Only the best level counts; several hits there make the query ambiguous.
    Codes and names are equi-joins; the containment level runs for the queries the first two left open.
    Names are matched once however many securities bear them: securities with one name are counted per name,
    those with several names stay rows.  Joins are sorted ones: either side may be the whole master.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("_q")).distinct()
    m = master.select("symbol", F.lower("name").alias("_n"), F.lower("symbol").alias("_s"))
    texts = q.select("_q").filter("_q is not null").distinct()
    codes = m.filter("_s is not null").groupBy("_s").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("first"))
    code = texts.join(codes.hint("merge"), F.col("_q") == F.col("_s")).select("_q", "n", "first")
    named = m.filter("_n is not null").select("symbol", "_n").distinct()
    several = named.filter("symbol is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("symbol")
    loose = named.join(several.hint("merge"), "symbol", "left_semi")
    plain = named.join(several.hint("merge"), "symbol", "left_anti").groupBy("_n").agg(F.count("symbol").alias("n"), F.min("symbol").alias("first"))
    names = named.select("_n").distinct()

    def counted(pairs: DataFrame) -> DataFrame:
        """Matches and first symbol of every query text, from the names (_n) that it met."""
        single = pairs.join(plain.hint("merge"), "_n").groupBy("_q").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        many = pairs.join(loose.hint("merge"), "_n").groupBy("_q").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("first"))
        return single.unionByName(many).groupBy("_q").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    left = texts.join(code.select("_q").hint("merge"), "_q", "left_anti")
    equal = left.join(names.hint("merge"), F.col("_q") == F.col("_n")).select("_q", "_n")
    name = counted(equal)
    part = counted(_containing(left.join(name.select("_q").hint("merge"), "_q", "left_anti"), names))
    best = code.unionByName(name).unionByName(part)
    out = q.join(best.hint("merge"), "_q", "left").select("query", F.col("n").alias("matches"), F.col("first").alias("symbol"))
    status = F.when(F.col("matches").isNull(), "not_found").when(F.col("matches") > 1, "ambiguous").otherwise("resolved")
    return out.select("query", F.when(F.col("matches") == 1, F.col("symbol")).alias("symbol"), F.coalesce("matches", F.lit(0)).alias("matches"), status.alias("status"))


# ---- US ranking blend -----------------------------------------------------------------------------


def ranked(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """Each rank list with positions; only its first ``depth`` rows where a page size is given."""
    w = Window.partitionBy("kind").orderBy(F.col("amount").desc(), "stk_cd")
    placed = rows.withColumn("position", F.row_number().over(w))
    return placed if depth is None else placed.filter(F.col("position") <= depth)


def blend_rankings(ranks: DataFrame) -> DataFrame:
    """Full outer join of the market-cap and turnover lists on (exchange, symbol)."""
    r = ranks.select("kind", "position", "amount", F.upper(F.trim("stex_tp")).alias("exchange"),
                     normalize_us_symbol(F.col("stk_cd")).alias("symbol"), F.abs("cur_prc").alias("price"))
    r = r.filter((F.col("symbol") != "") & F.col("exchange").isin(*fixed.US_EXCHANGES))
    side = lambda k: r.filter(F.col("kind") == k).groupBy("exchange", "symbol").agg(
        F.max("position").alias(f"{k}_rank"), F.max_by(F.abs("amount") * 1000.0, "position").alias(f"{k}_amount"), F.min_by("price", "position").alias(f"{k}_price"))
    j = side("cap").join(side("value"), ["exchange", "symbol"], "full_outer")
    return j.select("exchange", "symbol", "cap_rank", "value_rank", F.col("cap_amount").alias("market_cap_usd"),
                    F.col("value_amount").alias("trade_value_usd"), F.coalesce("cap_price", "value_price", F.lit(0.0)).alias("price"))


def us_candidates(blended: DataFrame, master: DataFrame) -> DataFrame:
    """Verdict and rank score of every ranked instrument; unknown ones are never admitted."""
    m = master.select("exchange", normalize_us_symbol(F.col("symbol")).alias("symbol"), "korean_name", "english_name", "sector", "is_etf")
    j = blended.join(m, ["exchange", "symbol"], "left")
    verdict = (
        F.when(F.col("is_etf").isNull(), "unverified").when((F.col("price") < 5.0) | ~us_common_stock(), "excluded").otherwise("candidate"))
    points = lambda rank, top: F.coalesce(F.greatest(F.lit(0.0), top - F.col(rank)), F.lit(0.0))
    bonus = lambda c, cap, mult: F.when(F.col(c) > 0, F.least(F.lit(cap), F.log10(c) * mult)).otherwise(0.0)
    both = F.when(F.col("cap_rank").isNotNull() & F.col("value_rank").isNotNull(), 120.0).otherwise(0.0)
    score = points("cap_rank", 400.0) + points("value_rank", 450.0) + both + bonus("market_cap_usd", 120.0, 10.0) + bonus("trade_value_usd", 100.0, 9.0)
    return j.withColumns({"verdict": verdict, "rank_score": score})


def sector_capped(candidates: DataFrame, target: int = 240, per_sector: int = 24) -> DataFrame:
    """Top ``target`` with a sector cap, back-filled from the rows above the cap.

    Equal to the sequential pick: within-cap rows first, then the rest, both by
    score.  A row deeper than cap + target in its sector can never be reached, so
    only that many per sector leave each task.
    """
    sector = F.when(F.coalesce("sector", F.lit("")) == "", UNSORTED).otherwise(F.col("sector"))
    df = candidates.withColumn("_sector", sector)
    by_score = [F.col("rank_score").desc(), F.col("symbol")]
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy("_sector").orderBy(*by_score))).filter(F.col("_r") <= per_sector + target)
    cap = F.when(F.col("_sector") == UNSORTED, max(8, per_sector // 2)).otherwise(per_sector)
    df = df.withColumn("deferred", F.col("_r") > cap)
    return df.orderBy("deferred", *by_score).limit(target).drop("_sector", "_r")


def universe_stats(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    c = candidates.agg(F.count(F.lit(1)).alias("ranked_unique"), F.count_if(F.col("verdict") == "excluded").alias("excluded"),
                       F.count_if(F.col("verdict") == "unverified").alias("unverified")).withColumn("_one", F.lit(1))
    s = selected.agg(F.count(F.lit(1)).alias("selected"), F.count_distinct("sector").alias("sector_count")).withColumn("_one", F.lit(1))
    return c.join(s, "_one").drop("_one")


# ---- KR selection -----------------------------------------------------------------------------------


def board_candidates(ranks: DataFrame, master: DataFrame, min_price: float = 1000.0) -> DataFrame:
    """Per-board turnover ranks joined to the master on code and board; best score per symbol.

    Of equal scores the better position counts, then the board later by name.
    ``ranks``: as_of, board, stk_cd, cur_prc, position.
    """
    r = ranks.select("as_of", "board", base_symbol(F.col("stk_cd")).alias("symbol"), F.abs("cur_prc").alias("price"), "position")
    j = r.join(master, "symbol").filter((F.col("exchange") == F.col("board")) & (F.col("price") >= min_price))
    j = j.withColumn("rank_score", F.greatest(F.lit(0.0), 500.0 - F.col("position")))
    best = j.groupBy("as_of", "symbol").agg(F.max_by(F.struct("board", "price", "position", "sector", "rank_score"),
                                                      F.struct(F.col("rank_score"), -F.col("position"), F.col("board"))).alias("b"))
    return best.select("as_of", "symbol", "b.*")


def two_capped(candidates: DataFrame, target: int = 160, per_sector: int = 24) -> DataFrame:
    """Per date: top ``target`` under a sector cap and a 65 % board cap, then back-fill.

    A row rejected by the board cap does not use up its sector, so the pick is
    sequential.  Per (date, sector, board) only the first ``target`` rows can be
    picked; that bound is applied before a date's rows meet in one task.
    """
    sector = F.when(F.coalesce("sector", F.lit("")) == "", UNSORTED).otherwise(F.col("sector"))
    cell = Window.partitionBy("as_of", "sector", "board").orderBy(F.col("rank_score").desc(), "symbol")
    df = candidates.select("as_of", "symbol", "board", sector.alias("sector"), "rank_score")
    df = df.withColumn("_r", F.row_number().over(cell)).filter(F.col("_r") <= target).drop("_r")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank_score", "symbol"], ascending=[False, True], ignore_index=True)
        sectors: dict[str, int] = {}
        boards: dict[str, int] = {}
        board_cap = max(1, int(target * 0.65))
        chosen, later = [], []
        for k, (s, b) in enumerate(zip(pdf["sector"], pdf["board"])):
            cap = max(10, per_sector // 2) if s == UNSORTED else per_sector
            if len(chosen) >= target:
                break
            if sectors.get(s, 0) >= cap or boards.get(b, 0) >= board_cap:
                later.append(k)
                continue
            chosen.append(k)
            sectors[s], boards[b] = sectors.get(s, 0) + 1, boards.get(b, 0) + 1
        chosen += later[:max(0, target - len(chosen))]
        out = pdf.loc[chosen]
        return out.assign(position=range(1, len(out) + 1))

    return df.groupBy("as_of").applyInPandas(
        pick, "as_of date, symbol string, board string, sector string, rank_score double, position int")


# ---- exchange cross-section ---------------------------------------------------------------------------


def cross_section(daily: DataFrame, basic: DataFrame) -> DataFrame:
    """Universe rows of each date: daily rows full-outer basic info, typed and ranked.

    ``basic`` without a date column applies to every date of its board.
    """
    days = daily.select("session_date", "board").distinct()
    b = basic.join(days, "board").withColumn("symbol", exchange_code(F.col("ISU_SRT_CD"), F.col("ISU_CD")))
    d = daily.withColumn("symbol", exchange_code(F.col("ISU_SRT_CD"))).drop("ISU_SRT_CD")
    j = b.drop("ISU_SRT_CD").join(d, ["session_date", "board", "symbol"], "full_outer").filter(F.col("symbol") != "")
    name = F.coalesce(F.nullif("ISU_ABBRV", F.lit("")), F.nullif("ISU_NM", F.lit("")), F.col("symbol"))
    kind = security_type(F.col("KIND_STKCERT_TP_NM"), name)
    listing = F.to_date(F.try_to_timestamp(F.regexp_replace("LIST_DD", r"\D", ""), F.lit("yyyyMMdd")))
    isin = F.upper(F.trim(F.coalesce("ISU_CD", F.lit(""))))
    known = F.regexp(isin, F.lit("^KR[A-Z0-9]{10}$"))
    early = F.coalesce(F.col("session_date") < listing, F.lit(False))
    amount = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
    u = j.select(
        "session_date", "board", "symbol", F.when(known, isin).otherwise(F.concat_ws(":", F.lit("KRX"), "board", "symbol")).alias("permanent_id"),
        known.alias("permanent_id_verified"), F.trim(name).alias("company_name"), kind.alias("security_type"), listing.alias("listing_date"),
        ((kind == "common_stock") & ~early).alias("eligible"),
        F.when(early, "before_listing_date").when(kind != "common_stock", F.concat(F.lit("security_type="), kind)).otherwise("").alias("exclusion_reason"),
        amount("ACC_TRDVAL").alias("trade_value"), *[amount(f"TDD_{s}PRC").alias(n) for n, s in (("open", "OPN"), ("high", "HG"), ("low", "LW"), ("close", "CLS"))],
        F.coalesce("SECT_TP_NM", F.lit("")).alias("sector"), F.col("TDD_CLSPRC").isNotNull().alias("traded"))
    # One date and board: at most the listed securities.
    order = Window.partitionBy("session_date", "board", F.col("eligible") & (F.col("trade_value") > 0)).orderBy(F.col("trade_value").desc(), "symbol")
    return u.withColumn("trade_value_rank", F.when(F.col("eligible") & (F.col("trade_value") > 0), F.row_number().over(order)))


def cross_section_prices(universe: DataFrame) -> DataFrame:
    return universe.filter("eligible AND traded").filter(F.least("open", "high", "low", "close") > 0).select(
        "session_date", "board", "symbol", "open", "high", "low", "close")


def index_bars(rows: DataFrame) -> DataFrame:
    """The broad index row per board and date by alias; a non-positive price is flagged.

    ``rows``: session_date, board, IDX_NM, OPNPRC_IDX.. as text, position.
    """
    match = F.lit(False)
    for board, names in fixed.INDEX_ALIASES.items():
        match = match | ((F.col("board") == board) & F.trim("IDX_NM").isin(*names))
    cols = {"open": "OPNPRC_IDX", "high": "HGPRC_IDX", "low": "LWPRC_IDX", "close": "CLSPRC_IDX", "volume": "ACC_TRDVOL", "trade_value": "ACC_TRDVAL"}
    typed = [F.coalesce(number(F.col(c)), F.lit(0.0)).alias(n) for n, c in cols.items()]
    first = rows.filter(match).groupBy("session_date", "board").agg(F.min_by(F.struct(*typed), "position").alias("p")).select("session_date", "board", "p.*")
    return first.withColumn("valid", F.least("open", "high", "low", "close") > 0)


def membership_audit(universe: DataFrame) -> DataFrame:
    """(finding, symbol): past-only members, new on the latest date, listing/delisting violations."""
    e = universe.filter("eligible")
    last = e.groupBy("market").agg(F.max("session_date").alias("_last"))
    s = e.join(last, "market").groupBy("market", "symbol").agg(
        F.max((F.col("session_date") == F.col("_last")).cast("int")).alias("now"), F.max((F.col("session_date") < F.col("_last")).cast("int")).alias("past"),
        F.max((F.col("session_date") < F.col("listing_date")).cast("int")).alias("early"),
        F.max((F.col("session_date") > F.col("delisting_date")).cast("int")).alias("late"))
    found = F.array_compact(F.array(
        F.when((F.col("past") == 1) & (F.col("now") == 0), "historical_only"), F.when((F.col("past") == 0) & (F.col("now") == 1), "new_on_latest"),
        F.when(F.col("early") == 1, "before_listing"), F.when(F.col("late") == 1, "after_delisting")))
    return s.select("market", "symbol", F.explode(found).alias("finding"))


def eligible_on(day: Column) -> Column:
    """Listing, delisting and ticker ranges are inclusive; common types only."""
    inside = F.lit(True)
    for c, after in (("listing_date", True), ("ticker_start_date", True), ("delisting_date", False), ("ticker_end_date", False)):
        inside = inside & F.coalesce(day >= F.col(c) if after else day <= F.col(c), F.lit(True))
    return inside & F.lower("security_type").isin("common_stock", "common", "cs", "stock")


def point_in_time_slice(bars: DataFrame, requests: DataFrame, history: DataFrame, zone: str, time: str = "session_date") -> DataFrame:
    """Bars that each request may know: (request_id and the bar's columns).

    ``requests``: request_id, market, symbol, as_of (a date).  ``history``: market, symbol, security_type and the dates
    of listing, delisting and ticker use, one row per ticker range.  Bars carry a session date, or an instant in
    ``time``, which counts by its day in the market's ``zone``.  A symbol with history rows has bars only if one of its
    ranges is eligible on the day asked for; a symbol without any is not checked.  No session is filled in.
    """
    keys = ["market", "symbol"]
    h = history.select(*keys, "security_type", "listing_date", "delisting_date", "ticker_start_date", "ticker_end_date")
    ranges = requests.select(*keys, "request_id", "as_of").join(h, keys).groupBy("request_id").agg(F.max(eligible_on(F.col("as_of")).cast("int")).alias("_eligible"))
    asked = requests.select("request_id", *keys, "as_of").join(ranges, "request_id", "left").filter(F.coalesce(F.col("_eligible"), F.lit(1)) == 1)
    day = F.col(time) if dict(bars.dtypes)[time] == "date" else F.to_date(F.from_utc_timestamp(time, zone))
    return bars.withColumn("_day", day).join(asked.select("request_id", *keys, "as_of"), keys).filter(F.col("_day") <= F.col("as_of")).select("request_id", *bars.columns)


def security_metadata(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Metadata of the published stocks: assets of kind ``stock`` with a processed file, with the request's names.

    ``requests``: market, symbol, name, sector, position (of repeated requests the last counts).  ``assets``: market,
    symbol, kind, processed_path, exchange, security_type, listing_date, delisting_date.
    """
    keys = ["market", "symbol"]
    last = requests.groupBy(*keys).agg(F.max_by(F.struct("name", "sector"), "position").alias("r"))
    stocks = assets.filter((F.col("kind") == "stock") & (F.coalesce("processed_path", F.lit("")) != ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return stocks.join(last, keys).select(
        *keys, "exchange", "r.name", F.col("r.name").alias("korean_name"), F.col("r.name").alias("english_name"), "r.sector", "security_type",
        F.lit(False).alias("is_etf"), text("listing_date"), text("delisting_date"), F.lit("").alias("permanent_id"))


def tail_rows(bars: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key; the rank filter limits each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
