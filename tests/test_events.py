"""Evidence rules, text functions, feeds, sinks and streams on small fixtures."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.functions import classify, text as t, times
from barlens.operators import clock, events as ev, quality, universe
from barlens.sources import files, sinks
from barlens.streaming import jobs

T0 = dt.datetime(2024, 6, 3, 0, 0)
SCHEMA = ("event_id string, market string, symbol string, event_time timestamp, first_seen_at timestamp, source_type string, source_url string, "
          "title string, article_id string, entities array<string>, raw_reference map<string,string>")


def event(k, title="", url="", article="", minutes=0, symbol="AAA", key="", entities=()):
    at = T0 + dt.timedelta(minutes=minutes)
    return (f"e{k:03d}", "US", symbol, at, at, "NAVER_NEWS", url, title, article, list(entities), {"accession_number": key})


def made(spark, rows):
    return ev.prepared_events(spark.createDataFrame(rows, SCHEMA))


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_dedup_is_sequential_not_transitive(spark):
    rows = [event(1, "alpha one", "http://a/1", "x", 1), event(2, "beta two", "http://a/1/?utm_source=z", "y", 2),
            event(3, "gamma three", "http://a/3", "y", 3), event(4, "alpha one!", "http://a/4", "", 4, "BBB"), event(5, "ALPHA, one", "", "", 5)]
    kept = {r["event_id"] for r in ev.deduplicate(made(spark, rows)).collect()}
    # e2 falls to e1's URL; e3 shares its article only with the dropped e2.
    assert kept == {"e001", "e003", "e004"}


def test_dedup_against_brute_force(spark):
    g = random.Random(5)
    rows = [event(k, f"t{g.randint(0, 14)}", f"http://h/{g.randint(0, 14)}" if g.random() < 0.7 else "", f"a{g.randint(0, 14)}" if g.random() < 0.7 else "",
                  g.randint(0, 50)) for k in range(120)]
    seen, want = set(), set()
    for r in sorted(rows, key=lambda r: (r[3], r[5], r[0])):
        keys = {("t", r[7])} | ({("u", r[6])} if r[6] else set()) | ({("a", r[8])} if r[8] else set())
        if not keys & seen:
            want.add(r[0])
            seen |= keys
    assert {r["event_id"] for r in ev.deduplicate(made(spark, rows)).collect()} == want


def test_clusters_by_title_and_amount(spark):
    rows = [event(1, "Acme wins supply contract worth 500 million", minutes=1), event(2, "Acme wins supply contract worth 500 million today", minutes=2),
            event(3, "Acme wins supply contract worth 900 million", minutes=3), event(4, "Acme wins supply contract worth 500 million", minutes=60 * 40, url="http://x/9")]
    got = {r["event_id"]: (r["leader_id"], r["cluster_method"]) for r in ev.cluster(made(spark, rows)).collect()}
    assert got["e002"] == ("e001", "title_entity_time_candidate")
    assert got["e003"] == ("e003", "singleton") and got["e004"][0] == "e004"


def test_cluster_rounds_do_not_change_the_result(spark):
    g = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [event(k, " ".join(g.sample(words, 4)) + f" {k % 3}00", f"http://h/{k}", f"a{k}", k * 40) for k in range(60)]
    ready = made(spark, rows).persist()
    small = {(r["event_id"], r["leader_id"], r["cluster_method"]) for r in ev.cluster(ready, batch=4).collect()}
    large = {(r["event_id"], r["leader_id"], r["cluster_method"]) for r in ev.cluster(ready).collect()}
    assert small == large and len(small) == 60


CHAIN = "Acme wins supply contract in Spain"


def test_touched_clusters_keep_their_leaders(spark):
    # e1 leads e2; e3 is too far from e1, and e2 is no leader: e3 leads.
    rows = [event(1, CHAIN, minutes=0), event(2, CHAIN + " today", minutes=30 * 60), event(3, CHAIN + " now", minutes=60 * 60),
            event(4, CHAIN + " again", minutes=400 * 60), event(5, CHAIN, minutes=0, symbol="BBB")]
    ready = made(spark, rows)
    whole = {r["event_id"]: (r["leader_id"], r["cluster_id"], r["cluster_method"]) for r in ev.cluster(ready).collect()}
    assert whole["e002"][0] == "e001" and whole["e003"][0] == "e003"
    late = ready.filter("event_id = 'e003'")
    got = {r["event_id"]: (r["leader_id"], r["cluster_id"], r["cluster_method"]) for r in jobs.clusters_touched(ready.filter("event_id <> 'e003'"), late).collect()}
    assert got == {k: whole[k] for k in ("e001", "e002", "e003")}


def test_ingest_in_batches_gives_the_clusters_of_one_run(spark, tmp_path):
    g = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [event(k, " ".join(g.sample(words, 4)) + " " + chr(97 + k) * 5, minutes=k * 200 + g.randint(0, 900), symbol=g.choice(["AAA", "BBB"])) for k in range(24)]
    want = {(r["event_id"], r["cluster_id"], r["cluster_method"]) for r in ev.cluster(ev.deduplicate(made(spark, rows))).collect()}
    by_time = sorted(rows, key=lambda r: (r[3], r[0]))
    folder = str(tmp_path / "store")
    for part in (by_time[:9], by_time[9:17], by_time[9:17], by_time[17:]):  # a repeated batch adds nothing
        jobs.ingest_batch(spark.createDataFrame(part, SCHEMA), folder)
    got = [(r["event_id"], r["cluster_id"], r["cluster_method"]) for r in spark.read.parquet(folder).collect()]
    assert len(got) == len(want) == 24 and set(got) == want and len({c for _, c, _ in got}) < 24


def test_visibility_reasons(spark):
    rows = spark.createDataFrame([(T0, T0), (T0 + dt.timedelta(hours=2), T0), (T0, T0 + dt.timedelta(hours=2)), (T0, None)], "event_time timestamp, first_seen_at timestamp")
    got = [r[0] for r in rows.select(ev.visibility(F.lit("2024-06-03 01:00:00").cast("timestamp"))).collect()]
    assert got == ["visible", "event_after_as_of", "first_seen_after_as_of", "first_seen_unknown"]


@pytest.mark.parametrize("title,name,symbol,aliases,accepted,reason", [
    ("Apple pie recipe wins prize", "Apple Inc", "AAPL", [], False, "no_direct_company_mention"),
    ("Apple Inc reports record revenue", "Apple Inc", "AAPL", [], True, "exact_company_name_or_verified_alias"),
    ("Apple unveils iPhone as revenue grows", "Apple Inc", "AAPL", [], True, "exact_company_name_or_verified_alias"),
    ("Shares of ($AAPL) in focus", "Apple Inc", "AAPL", [], False, "ticker_only_low_trust"),
    ("Microsoft Office tips for teams", "Microsoft", "MSFT", [], False, "product_only_context"),
    ("삼성생명 실적 발표", "삼성전자", "005930", [], False, "different_samsung_affiliate"),
])
def test_company_relevance(spark, title, name, symbol, aliases, accepted, reason):
    none = F.array().cast("array<string>")
    r = one(spark, classify.company_relevance(F.lit(title), F.lit(name), F.lit(symbol), none, none))
    assert (r["accepted"], r["reason"]) == (accepted, reason)


def test_context_relevance(spark):
    r = one(spark, classify.context_relevance(F.lit("Chip makers on Nasdaq rise"), F.lit("US"), F.lit("semiconductor"), F.lit("Acme Corp")))
    assert (r["market"], r["sector"], r["company"]) == ("HIGH", "HIGH", "LOW")


@pytest.mark.parametrize("raw,tz,end,want", [
    ("20240603", "Asia/Seoul", True, "2024-06-03T14:59:59+00:00"), ("2024-06-03", "UTC", False, "2024-06-03T00:00:00+00:00"),
    ("20240603101530", "UTC", False, "2024-06-03T10:15:30+00:00"), ("2024-06-03T10:00:00-04:00", "UTC", False, "2024-06-03T14:00:00+00:00"),
    ("2024-06-03T10:00:00", "America/New_York", False, "2024-06-03T14:00:00+00:00"), ("Mon, 03 Jun 2024 10:00:00 +0900", "UTC", False, "2024-06-03T01:00:00+00:00"),
    ("nonsense", "UTC", False, None)])
def test_datetimes(spark, raw, tz, end, want):
    assert one(spark, times.iso_utc(times.parse_datetime(F.lit(raw), tz, end))) == want


@pytest.mark.parametrize("raw,want", [
    ("20240603250000", "2024-06-04T05:00:00+00:00"), ("20240310023000", "2024-03-10T07:00:00+00:00"), ("20241103013000", None),
    ("20241103003000", "2024-11-03T04:30:00+00:00"), ("20240603480000", None)])
def test_session_clock(spark, raw, want):
    assert one(spark, times.iso_utc(times.session_clock(F.lit(raw), "US"))) == want


def test_text_helpers(spark):
    assert one(spark, t.canonical_url(F.lit("HTTPS://www.Site.com//a//b/?utm_source=x&b=2&a=1#top"))) == "https://site.com/a/b?a=1&b=2"
    assert one(spark, t.clean_html(F.lit("<b>A &amp; B</b> &#8211;  &eacute;"))) == "A & B – é"
    assert one(spark, t.numeric_facts(F.lit("worth 1,200 million and 5.5% of $ 30"))) == ["1200million", "5.5%", "$30"]
    assert one(spark, t.corporate_root(F.lit("Zinc Co. Ltd."))) == "zinc"
    assert one(spark, classify.event_type(F.lit("SEC 8-K"), F.lit("8-K"), F.lit("5.02, 9.01"))) == "MANAGEMENT_CHANGE"


def test_feeds(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<rss><item><title>Acme Corp &amp; partner</title><link>http://a/1</link><pubDate>Mon, 03 Jun 2024 10:00:00 GMT</pubDate></item>"
                                    "<item><title></title><link>b</link><pubDate>x</pubDate></item></rss>")
    now = F.lit("2024-06-03 12:00:00").cast("timestamp")
    rows = files.rss_news(spark, str(tmp_path / "x.xml"), {"symbol": "ACM", "company_name": "Acme Corp", "market": "US"}, now).collect()
    assert [(r["title"], r["relevance_status"]) for r in rows] == [("Acme Corp & partner", "DIRECT_COMPANY")]
    (tmp_path / "c.xml").write_text("<r><list><corp_code>001</corp_code><corp_name>A</corp_name><stock_code>5930</stock_code></list><list><corp_code>2</corp_code><corp_name>B</corp_name><stock_code> </stock_code></list></r>")
    assert [r["ticker"] for r in files.company_codes(spark, str(tmp_path / "c.xml")).collect()] == ["005930"]
    line = "\t".join(str(k) for k in range(61))
    (tmp_path / "e.tsv").write_text(line + "\n1\t2\n")
    assert [r["source_url"] for r in files.event_export(spark, str(tmp_path / "e.tsv")).collect()] == ["60"]
    f = spark.createDataFrame([("A", "005930", "주요사항 정정 유상증자", "1", "20240603")], "corp_name string, stock_code string, report_nm string, rcept_no string, rcept_dt string")
    r = files.kr_filings(f, now).first()
    assert (r["event_type"], r["is_correction"], r["event_time"]) == ("CAPITAL_RAISE", True, dt.datetime(2024, 6, 3, 14, 59, 59))
    sub = spark.createDataFrame([("0000320193", "aapl", "Apple", (["1-2-3"], ["10-K/A"], ["2024-06-03"], [], ["d.htm"], None))],
                                "cik string, ticker string, company_name string, recent struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>,items:array<string>>")
    sub = sub.withColumn("recent", F.col("recent").withField("items", F.array().cast("array<string>")))
    r = files.us_filings(files.submission_rows(sub), now, ("10-K/A",), "2024-01-01").first()
    assert r["is_correction"] and r["event_time_precision"] == "date" and r["source_url"].endswith("/320193/123/d.htm")


def test_graph_matching(spark):
    g = spark.createDataFrame([("20240603101500-1", "20240603100000", "src", "http://a/1", ["x"], ["Acme Corp", "Other"]),
                               ("20240603101500-2", "20240603100000", "src", "http://a/2", [], ["apple"])],
                              "record_id string, published string, source_name string, source_url string, themes array<string>, organizations array<string>")
    targets = spark.createDataFrame([("US", "ACM", "Acme Inc", ["Acme"]), ("US", "AAPL", "Apple", [])], "market string, symbol string, company_name string, aliases array<string>")
    x = spark.createDataFrame([("77", "http://www.a/1")], "gdelt_event_id string, source_url string")
    m = spark.createDataFrame([("77", "http://a/1")], "gdelt_event_id string, mention_identifier string")
    rows = files.graph_events(g, targets, x, m, F.current_timestamp()).collect()
    assert [(r["symbol"], r["gdelt_event_id"], r["mention_count"]) for r in rows] == [("ACM", "77", 1)]


def test_price_files_and_dataset(spark, tmp_path):
    base = tmp_path / "KR"
    for d in ("stocks", "proxies"):
        (base / d).mkdir(parents=True)
    (base / "stocks.csv").write_text("symbol,name,is_etf\nAAA,Alpha,false\nEEE,Fund,true\n")
    for s in ("aaa", "eee"):
        (base / "stocks" / f"{s}.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,2,10\n")
    (base / "proxies" / "KOSPI.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-02,1,2,1,2,10\n")
    stocks, proxies, _ = files.dataset(spark, str(tmp_path), "KR")
    assert [r["symbol"] for r in stocks.collect()] == ["AAA"] and proxies.first()["symbol"] == "KOSPI"
    (tmp_path / "bad.csv").write_text("date,open,high,low,close,volume\nnot-a-day,1,2,1,2,10\n")
    with pytest.raises(Exception, match="bad date"):
        files.price_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "u.csv").write_text("date,market,symbol,eligible\n2024-01-02,us,abc,예\n2024-01-02,us,def,no\n")
    assert [r["symbol"] for r in files.universe_csv(spark, str(tmp_path / "u.csv")).collect()] == ["ABC"]
    (tmp_path / "i.jsonl").write_text('{"market":"us","as_of":"2024-01-02","score":70,"generated_at":"2024-01-02T20:59:00+00:00"}\n{"market":"KR","as_of":"2024-01-02","generated_at":"2024-01-02T01:00:00"}\n')
    rows = {r["market"]: r for r in files.intelligence_jsonl(spark, str(tmp_path / "i.jsonl")).collect()}
    assert rows["US"]["symbol"] == "*" and rows["KR"]["environment_score"] == 50 and rows["KR"]["generated_at"] is None


def test_price_files_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,4,0.5,3,10\n")
    (tmp_path / "b.csv").write_text('close,"timestamp",open,low,high,raw_close\n30,2024-01-03,10,5,40,31\n\n30,"2024-01-04",11,5,40,\n')
    (tmp_path / "c.csv").write_text("\ufeffdatetime,date,close\n2024-01-05,2024-01-06,7\n")
    (tmp_path / "d.csv").write_text("open,close\n1,2\n")
    (tmp_path / "e.csv").write_text("")
    rows = files.price_csv(spark, str(tmp_path / "*.csv")).collect()
    got = sorted((r["stem"], str(r["session_date"]), r["open"], r["high"], r["low"], r["close"], r["volume"], r["raw_close"]) for r in rows)
    assert got == [("A", "2024-01-02", 1, 4, 0.5, 3, 10, None), ("B", "2024-01-03", 10, 40, 5, 30, None, 31), ("B", "2024-01-04", 11, 40, 5, 30, None, None),
                   ("C", "2024-01-06", None, None, None, 7, None, None)]


def test_quality_codes(spark):
    n = 90
    days = pd.bdate_range("2024-01-02", periods=n).date
    close = [100 + 20 * k / (n - 1) for k in range(n)]
    pdf = pd.DataFrame({"market": "US", "symbol": "Q", "session_date": days, "open": close, "high": close, "low": close, "close": close, "volume": 10.0, "ingest_order": range(n)})
    for c in ("open", "high", "low", "close"):
        pdf[f"raw_{c}"], pdf[f"adjusted_{c}"] = pdf[c], pdf[c] * 0.5
    pdf["adjustment_factor"] = 0.5
    pdf.loc[3, "adjustment_factor"] = 0.4
    pdf.loc[5, "high"] = 1.0
    pdf = pd.concat([pdf, pdf.iloc[[7]].assign(ingest_order=n)])
    got = {r["code"]: r["count"] for r in quality.inspect(spark.createDataFrame(pdf), None, "2030-01-01").collect()}
    assert got == {"adjustment_factor_mismatch": 1, "invalid_ohlc_relation": 1, "duplicate_session": 2, "not_sorted": 1, "stale_data": 1}


def test_lag_across_chunks(spark):
    df = spark.createDataFrame([("US", "A", dt.date(2024, 1, 1 + k % 28), float(k), k) for k in range(50)], "market string, symbol string, session_date date, close double, ingest_order long")
    got = quality.previous_row(df, chunk=7).orderBy("ingest_order").select("prev_close").collect()
    assert [r[0] for r in got] == [None] + [float(k) for k in range(49)]


def test_two_caps_against_sequential_pick(spark):
    g = random.Random(11)
    day = dt.date(2024, 1, 2)
    rows = [(day, f"s{k:03d}", g.choice(["KOSPI", "KOSPI", "KOSDAQ"]), g.choice(["a", "b", "c"]), float(g.randint(0, 50))) for k in range(120)]
    got = [r["symbol"] for r in universe.two_capped(spark.createDataFrame(rows, "as_of date, symbol string, board string, sector string, rank_score double"), 30, 8).orderBy("position").collect()]
    chosen, later, sec, brd = [], [], {}, {}
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if len(chosen) >= 30:
            break
        if sec.get(r[3], 0) >= 8 or brd.get(r[2], 0) >= 19:
            later.append(r[1])
            continue
        chosen.append(r[1])
        sec[r[3]], brd[r[2]] = sec.get(r[3], 0) + 1, brd.get(r[2], 0) + 1
    assert got == chosen + later[:30 - len(chosen)]


def test_sinks(spark, tmp_path):
    files_ = spark.createDataFrame([("s", "2024-01-02", bytearray(b"a")), ("s", "2024-01-02", bytearray(b"a")), ("s", "2024-01-03", bytearray(b"b"))], "source string, day string, content binary")
    folder = str(tmp_path / "raw")
    for _ in range(2):
        sinks.store_artifacts(spark, files_, folder)
    stored = spark.read.parquet(folder)
    assert stored.count() == 2 and sinks.damaged_artifacts(stored).count() == 0
    assert sinks.required_first(spark.createDataFrame([("x", "US")], "extra string, market string")).columns[:3] == ["date", "market", "symbol"]


def test_streams(spark, tmp_path):
    ticks = str(tmp_path / "ticks")
    rows = [("US", "A", T0 + dt.timedelta(minutes=7 * k), k, float(k + 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "market string, symbol string, ts timestamp, event_id long, close double")
    df = df.select("market", "symbol", "ts", "event_id", *[F.col("close").alias(c) for c in ("open", "high", "low")], "close", F.lit(1.0).alias("volume"))
    df.write.parquet(ticks)
    q = (jobs.bucket_stream(spark.readStream.schema(df.schema).parquet(ticks), "10 minutes").writeStream.format("memory").queryName("buckets")
         .outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start())
    q.awaitTermination(60)
    last = max(r[2] for r in rows) - dt.timedelta(minutes=10)
    got = {(r["bucket"], r["open"], r["close"]) for r in spark.table("buckets").collect()}
    want = {(r["bucket"], r["open"], r["close"]) for r in jobs.closed_buckets(df, F.lit(last)).collect()}
    assert got == want and len(got) >= 5

    feed, store = str(tmp_path / "feed"), str(tmp_path / "store")
    first = spark.createDataFrame([event(1, "alpha one", "http://a/1", "x"), event(2, "beta two", "http://a/2", "y")], SCHEMA)
    first.write.parquet(feed)
    for name in ("c2", "c3"):  # the second run replays the feed: nothing is new
        jobs.ingest_stream(spark.readStream.schema(first.schema).parquet(feed), store, str(tmp_path / name)).awaitTermination(90)
    assert sorted(r["event_id"] for r in spark.read.parquet(store).collect()) == ["e001", "e002"]


def test_minute_rules(spark):
    rows = spark.createDataFrame([("US", dt.datetime(2024, 6, 3, 13, 0)), ("US", dt.datetime(2024, 6, 3, 13, 30)), ("US", dt.datetime(2024, 6, 3, 19, 30)), ("KR", dt.datetime(2024, 6, 3, 6, 0))],
                                 "market string, ts timestamp")
    assert clock.regular_session(rows).count() == 2
    assert clock.completed_minutes(rows, F.lit("2024-06-03 06:30:00").cast("timestamp")).count() == 1


def test_organisation_gate(spark):
    """Whole names and legal roots pass; tickers, parts of names and generic words do not; missing arrays are empty."""
    cases = [
        (["ACME Robotics"], "Acme Robotics", "ACM", [], True, "exact_organization_alias"),
        (["Acme Robotics Co., Ltd."], "Acme Robotics", "ACM", [], True, "exact_organization_alias"),
        (["Acme Robotics Lab"], "Acme Robotics", "ACM", [], False, "no_exact_organization_alias"),
        (["ACM"], "Acme Robotics", "ACM", ["acm"], False, "no_exact_organization_alias"),
        (["Apple Inc"], "Apple Inc", "AAPL", ["Apple"], True, "exact_organization_alias"),
        (["Apple"], "Orchard", "AAPL", ["Apple"], False, "generic_name_without_legal_qualifier"),
        (["Robo"], "Acme Robotics", "ACM", ["Robo"], False, "generic_name_without_legal_qualifier"),
        (["Acme"], "Acme", "ACM", None, True, "exact_organization_alias"),
        (None, "Acme", "ACM", [], False, "no_exact_organization_alias"),
        (["Acme"], None, None, ["", "Acme Motors"], False, "no_exact_organization_alias"),
        ([], "", "", [], False, "no_exact_organization_alias"),
    ]
    rows = spark.createDataFrame([("US", f"S{k % 2}", f"e{k}", "GDELT_GKG", o, c, a, s) for k, (o, c, s, a, *_) in enumerate(cases)]
                                 + [("US", "S0", "other", "OPENDART", ["Acme"], "Acme", [], "ACM")],
                                 "market string, listed string, event_id string, source_type string, organizations array<string>, company_name string, matched_aliases array<string>, symbol string")
    replayed = ev.relevance_replay(rows).cache()
    got = {r["event_id"]: (r["verdict"]["accepted"], r["verdict"]["reason"]) for r in replayed.collect()}
    assert got == {f"e{k}": c[4:] for k, c in enumerate(cases)}
    assert {r["event_id"] for r in ev.relevance_quarantine(replayed).collect()} == {f"e{k}" for k, c in enumerate(cases) if not c[4]}
    whole = max(ev.replay_counts(replayed).collect(), key=lambda r: r["before_candidate_count"])
    assert tuple(whole)[1:] == (len(cases), sum(c[4] for c in cases), sum(not c[4] for c in cases))
    clustered = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c2"), ("d", None), ("e", "")], "event_id string, cluster_id string")
    assert tuple(ev.multi_article_clusters(clustered).first()) == (1, 2)
    assert tuple(ev.multi_article_clusters(clustered.limit(0)).first()) == (0, 0)


def test_zipped_feeds(spark, tmp_path):
    """Archives read like their unpacked first members, however many lines they have."""
    import zipfile

    folder = {k: tmp_path / k for k in ("plain", "zipped", "broken")}
    for f in folder.values():
        f.mkdir()
    long = files.MEMBER_LINES + 5
    for k, count in enumerate((3, long, 0)):
        lines = ["\t".join([f"{k}-{i}", *["x"] * 59, f"http://a/{k}/{i}"]) for i in range(count)] + ["too\tshort"]
        data = ("\n".join(lines) + ("\n" if k else "\r\n")).encode() + b"\xff" * 3
        (folder["plain"] / f"{k}.csv").write_bytes(data)
        with zipfile.ZipFile(folder["zipped"] / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            archive.mkdir("folder")
            archive.writestr(f"folder/{k}.csv", data)
            archive.writestr("second.csv", "\t".join(["no"] * 61))
    zipfile.ZipFile(folder["zipped"] / "none.zip", "w").close()
    want = files.event_export(spark, str(folder["plain"])).collect()
    got = files.event_export(spark, str(folder["zipped"] / "*.zip")).collect()
    assert sorted(got) == sorted(want) and len(want) == long + 3
    (folder["broken"] / "x.zip").write_bytes(b"not an archive")
    with pytest.raises(Exception, match="zip"):
        files.event_export(spark, str(folder["broken"] / "*.zip")).collect()
