"""Steps whose work must grow no faster than their input: their results, and what their plans must not hold."""

import datetime as dt

from pyspark.sql import functions as F

from barlens.operators import events as ev, quality, universe
from barlens.plans import shared
from barlens.sources import driver_tables as tables


def shown(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_resolution_counts_securities_and_broadcasts_nothing(spark, capsys):
    master = [("P1", "Large Ring Corp"), ("P2", "Large Ring Corp"), ("P2", "Large Ring Corp"), ("P3", "Old Bolt"), ("P3", "Bolt Works"), ("P4", "Tin Plate Corp"), (None, "Zinc Bar"), ("P5", None)]
    asked = ["p1", "Large Ring Corp", "large", " BOLT", "bolt works", "tin", "zinc", "ti", "x", "nothing", "", None]
    values = lambda rows: ", ".join("(" + ", ".join("cast(null as string)" if v is None else f"'{v}'" for v in r) + ")" for r in rows)
    m = spark.sql(f"select * from values {values(master)} as t(symbol, name)")
    q = spark.sql(f"select * from values {values([(a,) for a in asked])} as t(query)")
    out = universe.resolve(q, m)
    assert "BroadcastHashJoin" not in shown(out, capsys)
    got = {r["query"]: (r["symbol"], r["matches"], r["status"]) for r in out.collect()}
    want = {}
    for a in asked:
        key = None if a is None else a.strip(" ").lower()
        levels = [[s for s, _ in master if s and key is not None and s.lower() == key], [s for s, n in master if n and key is not None and n.lower() == key],
                  [s for s, n in master if n and key and key in n.lower()]]
        hits = next((level for level in levels if level), None)
        known = sorted({s for s in hits if s}) if hits else []
        status = "not_found" if hits is None else "ambiguous" if len(known) > 1 else "resolved"
        want[a] = (known[0] if len(known) == 1 else None, len(known), status)
    assert got == want


def documents(spark, folder):
    rows = [(k, None if k == 7 else f"Bank {k % 3} wins order number {k % 4}", "de" if k % 9 == 0 else "en", f"src{k % 8}", 30 + k) for k in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_news_is_dealt_out_and_read_by_need(spark, tmp_path, capsys):
    n = shared.news(spark, documents(spark, tmp_path))
    whole = shown(n, capsys)
    assert "InMemoryTableScan" not in whole and "hashpartitioning(doc_id" in whole
    # A view by time reads no text.
    assert "text:string" not in shown(ev.events_as_of(n, F.lit("2024-01-01 12:00:00").cast("timestamp")).select("event_id", "event_time"), capsys)
    # Blank headlines go after the grouping; a filter on the text would run where it is scanned.
    assert "_length" in shown(ev.first_headlines(n), capsys)
    assert ev.first_headlines(n).filter("event_id = 'evt_000000007'").count() == 0
    assert n.count() == 40


def test_store_matches_by_digest_and_blank_keys_match_nothing(spark):
    at = dt.datetime(2024, 1, 1)
    schema = "event_id string, market string, symbol string, event_time timestamp, article_id string, url_key string, title_key string"
    store = spark.createDataFrame([("s1", "US", "A", at, "", "", "t"), ("s2", "US", "A", at, "", "u", ""), ("s3", "US", "A", at, None, "", None)], schema)
    new = spark.createDataFrame([("n1", "US", "A", at, "", "", "t"), ("n2", "US", "A", at, None, "u", "t"), ("n3", "US", "A", at, "", "", ""), ("n4", "US", "B", at, "", "", "t")], schema)
    got = {r["event_id"]: (r["matched_id"], r["match_kind"]) for r in ev.match_store(new, store).collect()}
    assert got == {"n1": ("s1", "title"), "n2": ("s2", "url"), "n3": (None, "new"), "n4": (None, "new")}


def test_issues_are_summed_once_with_their_first_examples(spark, capsys):
    day = dt.date(2024, 1, 1)
    rows = [("US", "A", day + dt.timedelta(days=k // 3), 10.0, 9.0 if k > 5000 and k % 2 else 12.0, 9.0, 11.0, 1.0, k * 5) for k in range(9000)]
    b = spark.createDataFrame(rows, "market string, symbol string, session_date date, open double, high double, low double, close double, volume double, ingest_order bigint")
    out = quality.inspect(b)
    assert "bar-issues" in shown(out, capsys)
    got = {r["code"]: (r["count"], r["examples"]) for r in out.collect()}
    broken = [str(r[2]) for r in rows if r[4] < 11]
    weekend = [str(r[2]) for r in rows if r[2].weekday() >= 5]
    assert got == {"duplicate_session": (9000, [str(r[2]) for r in rows[:5]]), "invalid_ohlc_relation": (len(broken), broken[:5]), "weekend_rows": (len(weekend), weekend[:5])}


def test_bars_reduce_numbers_by_hashing(spark, capsys):
    day = dt.date(2024, 1, 2)
    rows = [("A", day, None, 1, 1, 1, 5.0, 2.0), ("A", day, 3, 1, 1, 1, 7.0, 1.0), ("A", day, 3, 2, 1, 1, 6.0, 1.0), ("A", None, 4, 1, 1, 1, 9.0, 1.0), (None, day, 5, 1, 1, 1, 8.0, None)]
    t = spark.createDataFrame(rows, "symbol string, session_date date, l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double")
    out = tables._bars(t, "symbol")
    assert "HashAggregate" in shown(out, capsys).replace("ObjectHashAggregate", "").replace("SortAggregate", "")
    got = {(r["symbol"], r["session_date"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out.collect()}
    assert got == {("A", day): (5.0, 7.0, 5.0, 6.0, 4 * 5000.0), ("A", None): (9.0, 9.0, 9.0, 9.0, 5000.0), (None, day): (8.0, 8.0, 8.0, 8.0, None)}
