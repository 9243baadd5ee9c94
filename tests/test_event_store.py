"""The event store and leader rounds against the sequential rule."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barlens.operators import events as ev, leaders as ld
from barlens.operators.event_store import EventStore
from barlens.sources import sinks
from barlens.streaming import jobs
from tests.test_events import SCHEMA, T0, event, made


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def lead(rows):
    """event_id -> leader, one by one; titles hold no numbers here."""
    leaders, out = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[5], r[0])):
        for other in leaders:
            if other[2] == r[2] and r[3] - other[3] <= dt.timedelta(hours=36) and (
                    (r[10]["accession_number"] and r[10]["accession_number"] == other[10]["accession_number"]) or jaccard(r[7], other[7]) >= 0.58):
                out[r[0]] = other[0]
                break
        else:
            leaders.append(r)
            out[r[0]] = r[0]
    return out


def titles(g, n, symbols=("AAA",), minutes=4000):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    return [event(k, " ".join(g.sample(words, g.choice([3, 4, 5]))) + " " + chr(97 + k % 26) * (4 + k // 26), f"http://h/{k}", f"a{k}", g.randint(0, minutes), g.choice(symbols),
                  key=g.choice(["", "", "", "K1"])) for k in range(n)]


def test_leader_rounds_against_the_sequential_rule(spark):
    rows = titles(random.Random(4), 90, ("AAA", "BBB"))
    # A family of near copies, and events with no word at all.
    rows += [event(100 + k, f"family of very near copies with many shared words {'abcdefghijklmnopqrstuvwxyz'[k % 26] * (3 + k // 26)}", f"http://f/{k}", f"f{k}", 10 + k) for k in range(60)]
    rows += [event(200 + k, "", f"http://e/{k}", f"e{k}", k) for k in range(3)]
    ready = made(spark, rows).persist()
    got = {r["event_id"]: r["leader_id"] for r in ev.cluster(ready).collect()}
    assert got == lead(rows) and sum(k != v for k, v in got.items()) > 80
    assert {r["event_id"]: r["leader_id"] for r in ev.cluster(ready, batch=1).collect()} == got
    assert ev.cluster(ready.limit(0)).count() == 0


def test_late_events_open_their_slots_anew(spark, tmp_path):
    """Batches in no order of time: every new event gets the cluster that one run over all events so far gives it."""
    g = random.Random(8)
    rows = titles(g, 45, minutes=9000)
    names = {r["event_id"]: r["n"] for r in made(spark, rows).select("event_id", ld.cluster_name().alias("n")).collect()}
    g.shuffle(rows)
    store, want, known = EventStore(spark, str(tmp_path / "store")), {}, []
    for number, part in enumerate((rows[:15], rows[15:30], rows[30:])):
        known += part
        found = lead(known)
        want |= {r[0]: names[found[r[0]]] for r in part}
        batch = made(spark, part)
        store.ingest(batch, f"b{number}")
        if number == 1:  # run again after a failure: it replaces what it wrote
            store.ingest(batch, f"b{number}")
    stored = store.events(batch.withColumn("cluster_id", F.lit("")).schema).select("event_id", "cluster_id").collect()
    assert len(stored) == 45 and {r["event_id"]: r["cluster_id"] for r in stored} == want
    roles = spark.read.parquet(f"{store.path}/_leads").groupBy("event_id").agg(F.max_by("leads", "written").alias("leads")).collect()
    assert {r["event_id"] for r in roles if r["leads"]} == {k for k, v in lead(rows).items() if k == v}


def test_store_matches_by_every_key(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.ingest(made(spark, [event(1, "alpha one", "http://a/1", "x", 1), event(2, "beta two", "http://a/2", "", 2), event(3, "", "http://a/3", "z", 3)]))
    incoming = made(spark, [event(1, "other", "", "", 5), event(11, "new title", "http://a/9", "x", 6), event(12, "new words", "http://a/2/?utm_source=q", "", 7),
                            event(13, "Beta, two!", "", "", 8), event(14, "alpha one", "http://a/1", "x", 9, "BBB"), event(15, "", "", "", 10)])
    got = {r["event_id"]: (r["matched_id"], r["match_kind"]) for r in store.match(incoming).collect()}
    assert got == {"e001": ("e001", "id"), "e011": ("e001", "article"), "e012": ("e002", "url"), "e013": ("e002", "title")}
    added = store.ingest(incoming).collect()
    assert {r["event_id"] for r in added} == {"e014", "e015"} and all(r["cluster_id"] for r in added)
    assert store.ingest(incoming.limit(0)).count() == 0


def test_first_observations_in_a_running_stream(spark, tmp_path):
    """Replays are not new, and what comes later than the watermark allows is left out."""
    feed = str(tmp_path / "feed")
    hours = lambda h: T0 + dt.timedelta(hours=h)
    parts = [[("a", hours(0), 1), ("b", hours(10), 1), ("a", hours(0), 2)], [("c", hours(100), 3), ("b", hours(10), 4)], [("d", hours(101), 5), ("c", hours(100), 6)],
             [("late", hours(20), 7), ("a", hours(0), 8), ("e", hours(99), 9), ("d", hours(101), 10)]]
    schema = "event_id string, event_time timestamp, seen int"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
    out = str(tmp_path / "out")
    jobs.observe(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), out, str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r["event_id"], r["seen"]) for r in spark.read.parquet(out).select("event_id", "seen").distinct().collect() if r["event_id"] != "a") == [("b", 1), ("c", 3), ("d", 5), ("e", 9)]
    assert spark.read.parquet(out).filter("event_id = 'a'").count() == 1
    jobs.observe(spark.readStream.schema(schema).parquet(feed), out, str(tmp_path / "c")).awaitTermination(120)  # nothing more
    assert spark.read.parquet(out).count() == 5


def test_snapshot_records(spark, tmp_path, monkeypatch):
    """Nested records: several for much evidence, none lost, defaults for what a record does not have."""
    monkeypatch.setattr(sinks, "RECORD_EVENTS", 4)
    events = made(spark, [event(k, f"title {k}", f"http://a/{k}", f"x{k}", k) for k in range(30)])
    analyses = spark.createDataFrame([("a1", "US", "AAA", T0 + dt.timedelta(minutes=20)), ("a2", "US", "BBB", T0)], "analysis_id string, market string, symbol string, analysis_timestamp timestamp")
    folder = str(tmp_path / "snapshots")
    sinks.write_snapshots(analyses, ev.snapshot_lineage(analyses, events), folder)
    records = sinks.read_snapshots(spark, folder)
    got = records.filter("analysis_id = 'a1'").collect()
    assert len(got) > 1 and sorted(e for r in got for e in r["naver_news_ids"]) == sorted(e["event_id"] for r in got for e in r["lineage"]) == [f"e{k:03d}" for k in range(21)]
    (empty,) = records.filter("analysis_id = 'a2'").collect()
    assert (empty["part"], empty["parts"], empty["lineage"], empty["dart_event_ids"]) == (0, 1, [], [])
    assert sinks.snapshot_events(records).groupBy("source_group").count().collect() == [("naver_news_ids", 21)]
