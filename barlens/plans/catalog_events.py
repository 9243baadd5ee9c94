"""Named queries over news evidence and text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from barlens.functions import classify, text as t, times
from barlens.operators import environment, events as ev
from barlens.operators.event_store import EventStore
from barlens.plans import shared
from barlens.session import shared_folder
from barlens.sources import driver_tables as tables, sinks
from barlens.streaming.jobs import observe, usable_view

AS_OF = "2024-01-01 12:00:00"


def at(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def documents(spark, sf) -> DataFrame:
    return tables.table(spark, sf, "documents")


def doc_query(**cols):
    def run(spark, sf):
        return documents(spark, sf).select("doc_id", *[f().alias(name) for name, f in cols.items()])
    return run


def titles(spark, sf):
    return documents(spark, sf).select("doc_id", t.normalize_title(F.col("text")).alias("title"))


def tokens(spark, sf):
    tok = t.title_tokens(t.normalize_title(F.col("text")))
    return documents(spark, sf).select("doc_id", F.size(tok).alias("tokens"), F.array_join(F.array_sort(tok), " ").alias("sorted"))


def similarity_to_first(spark, sf):
    """Jaccard similarity of each document to the first document of its source."""
    d = documents(spark, sf).select("doc_id", "source", t.title_tokens(t.normalize_title(F.col("text"))).alias("tok"))
    first = d.groupBy("source").agg(F.min_by("tok", "doc_id").alias("first"))
    return d.join(first, "source").select("doc_id", F.round(t.jaccard(F.col("tok"), F.col("first")), 4).alias("similarity"))


def entity_names(spark, sf):
    p = tables.master(spark, sf)
    name = F.concat("english_name", F.lit(" Co., Ltd."))
    return p.select("symbol", t.entity_name(name).alias("entity"), t.corporate_root(name).alias("root"),
                    t.contains_name(F.concat(F.lit("News on "), F.col("english_name"), F.lit(" today")), F.col("english_name")).alias("named"))


def alias_match(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", *[t.alias_matches(F.array("text", "source"), F.lit(a)).alias(n) for n, a in (
        ("by_source", "SRC7"), ("by_word", "ation"), ("short_alias", "src"))])


def urls(spark, sf):
    p = tables.table(spark, sf, "pages")
    tracked = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=a&b=1"))
    return p.select("page_id", t.canonical_url(F.col("url")).alias("canonical"), t.canonical_url(F.when(F.contains("url", F.lit("#")), F.col("url")).otherwise(tracked)).alias("tracked"))


def ids(spark, sf):
    return documents(spark, sf).select("doc_id", t.stable_id("article", F.col("source"), F.col("text"), F.lit(None)).alias("id"))


def stripped_html(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", t.clean_html(F.col("html")).alias("body"))


def semicolons(spark, sf):
    listed = F.replace("text", F.lit(". "), F.lit(",12;"))
    return documents(spark, sf).select("doc_id", t.semicolon_values(listed, True).alias("items"))


def headline_scores(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.round(classify.sentiment(F.col("text")), 4).alias("sentiment"), F.round(classify.headline_risk(F.col("text")), 4).alias("risk"))


def event_types(spark, sf):
    d = documents(spark, sf)
    form = F.when(F.col("doc_id") % 10 == 0, "8-K").when(F.col("doc_id") % 17 == 0, "10-Q").otherwise("")
    items = F.when(F.col("doc_id") % 20 == 0, "5.02, 9.01").when(F.col("doc_id") % 10 == 0, "7.01")
    return d.select("doc_id", classify.event_type(F.col("text")).alias("plain"), classify.event_type(F.col("text"), form, items).alias("with_form"))


def scopes(spark, sf):
    return documents(spark, sf).select("doc_id", classify.scope(F.col("text"), "SECTOR").alias("scope"))


def source_levels(spark, sf):
    return shared.news(spark, sf).groupBy("source_type", "source_level").agg(F.count(F.lit(1)).alias("events"))


def actions(spark, sf):
    o = tables.table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "F", "interest - confirm support").when(F.col("o_orderstatus") == "O", "wait - recheck").otherwise("hold")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.min(classify.canonical_action(text)).alias("action"))


def datetimes(spark, sf):
    """Every text form of the event times parses back to the same instant."""
    e = tables.table(spark, sf, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    forms = {
        "digits": F.date_format("ts", "yyyyMMddHHmmss"), "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "mail": F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), "day": F.date_format("ts", "yyyyMMdd"),
    }
    seoul_end = times.parse_datetime(forms["day"], "Asia/Seoul", True)
    return e.select("event_id", *[F.unix_seconds(times.parse_datetime(forms[k])).alias(k) for k in ("digits", "iso", "mail")],
                    F.unix_seconds(times.parse_datetime(forms["digits"], "America/New_York")).alias("new_york"),
                    F.unix_seconds(seoul_end).alias("seoul_day_end"), times.iso_utc(F.col("ts")).alias("text"))


def completed_sessions(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", times.last_completed_session(F.col("ts"), "US").alias("us"), times.last_completed_session(F.col("ts"), "KR").alias("kr"))


def display_times(spark, sf):
    n = shared.news(spark, sf)
    precision = F.when(F.col("source_type") == "OPENDART", "date").otherwise("second")
    return n.select("event_id", times.display_time(times.iso_utc(F.col("event_time")), precision, F.col("source_type") == "GDELT_DOC").alias("shown"))


def visibility(spark, sf):
    return shared.news(spark, sf).select("event_id", ev.visibility(at()).alias("reason"))


def lenient_view(spark, sf):
    return ev.events_as_of(shared.news(spark, sf), at(), market="kr", require_first_seen=False).select(
        "event_id", "symbol", F.unix_seconds("event_time").alias("at"))


def found(spark, sf):
    return ev.find_events(shared.news(spark, sf), market="kr", symbol="*", source_type="SEC_EDGAR").select(
        "event_id", F.unix_seconds("event_time").alias("at"))


def deduplicated(spark, sf):
    return ev.deduplicate(shared.news(spark, sf)).select("event_id", "market", "symbol")


def clusters(spark, sf):
    kept = shared.keep(spark, sf, "kept_news", lambda: ev.deduplicate(shared.news(spark, sf)))
    return ev.cluster(kept)


def _split_store(spark, sf):
    n = shared.news(spark, sf)
    stored = F.col("source_type").isin("OPENDART", "NAVER_NEWS", "GDELT_GKG")
    return n.filter(~stored), n.filter(stored)


def store_matches(spark, sf):
    incoming, store = _split_store(spark, sf)
    return ev.match_store(incoming, store).select("event_id", "match_kind", "matched_id")


def store_after_ingest(spark, sf):
    incoming, store = _split_store(spark, sf)
    merged = store.unionByName(ev.ingest(incoming, store), allowMissingColumns=True)
    return merged.groupBy("market", "symbol").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/barlens-{name}-{uuid.uuid4().hex}"


def store_clusters(spark, sf):
    """Deduplicated news taken into an event store in three batches of their time."""
    kept = shared.keep(spark, sf, "kept_news", lambda: ev.deduplicate(shared.news(spark, sf)))
    span = kept.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b")).first()
    store = EventStore(spark, _folder(spark, "store"))
    seconds = lambda c: F.unix_seconds(c)
    a, b = seconds(F.lit(span["a"])), seconds(F.lit(span["b"]))
    third = F.floor((seconds(F.col("event_time")) - a) * 3 / (b - a + 1))
    for k in range(3):
        store.ingest(kept.filter(third == k), f"third-{k}")
    return store.events(kept.withColumns({"cluster_id": F.lit(""), "cluster_method": F.lit("")}).schema).select("event_id", "cluster_id", "cluster_method")


def _observed(spark, rows, parts, name):
    """``rows`` arrive in ``parts`` runs of one stream over a growing folder."""
    feed, out, log = (_folder(spark, f"{name}-{x}") for x in ("feed", "out", "log"))
    for k in range(parts):
        rows.filter(F.col("part") == k).write.mode("append").parquet(feed)
        observe(spark.readStream.schema(rows.schema).parquet(feed), out, log).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def first_observations(spark, sf):
    """Events in four arrivals: thirds of January, then replays of every tenth with what had been held back."""
    e = tables.table(spark, sf, "events").select(F.concat(F.lit("evt_"), "event_id").alias("event_id"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("n"))
    part = F.when(F.col("event_time") < "2024-01-11", 0).when(F.col("event_time") < "2024-01-21", 1).otherwise(2)
    held = (F.col("n") % 23 == 0) & ((F.col("event_time") < "2024-01-15") | (F.col("event_time") >= "2024-01-30"))
    arrivals = e.withColumn("part", F.when(held, 3).otherwise(part)).unionByName(e.filter((F.col("n") % 10 == 0) & ~held).withColumn("part", F.lit(3)))
    return _observed(spark, arrivals, 4, "first").select("event_id", "part")


def streamed_view(spark, sf):
    """News in the order of their first sighting through the stream, then the view at a time."""
    n = shared.news(spark, sf)
    part = F.when(F.col("first_seen_at") <= at("2024-01-01 06:00:00"), 0).when(F.col("first_seen_at") <= at(), 1).otherwise(2)
    rows = n.select("event_id", "market", "symbol", "event_time", "first_seen_at", part.alias("part"))
    return usable_view(_observed(spark, rows, 3, "seen"), at()).select("event_id", "market", "symbol")


def headlines(spark, sf):
    return ev.first_headlines(shared.news(spark, sf)).select("market", "symbol", "event_id")


def top_headlines(spark, sf):
    return ev.first_headlines(shared.news(spark, sf), 8).select("market", "symbol", "event_id", "position")


def official(spark, sf):
    return ev.official_items(shared.news(spark, sf), at("2024-01-01 16:00:00")).select("market", "symbol", "event_id", "position")


def audit_counts(spark, sf):
    return ev.audit_counts(shared.news(spark, sf))


def audit_quality(spark, sf):
    return ev.audit_quality(shared.news(spark, sf))


def organisations(spark, sf):
    """Every organisation-graph event put through the gate."""
    rows = ev.relevance_replay(tables.graph_records(spark, sf))
    return rows.select("event_id", "verdict.accepted", "verdict.status", "verdict.scope", "verdict.reason", F.array_join("verdict.matches", "|").alias("matches"))


def relevance_replay(spark, sf):
    return ev.replay_counts(ev.relevance_replay(tables.graph_records(spark, sf)))


def relevance_quarantine(spark, sf):
    return ev.relevance_quarantine(ev.relevance_replay(tables.graph_records(spark, sf))).withColumn("matches", F.array_join("matches", "|"))


def multi_article_clusters(spark, sf):
    return ev.multi_article_clusters(clusters(spark, sf))


def coverage(spark, sf):
    return ev.coverage(shared.news(spark, sf)).select(
        "source_type", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"))


def analyses(spark, sf):
    """One analysis per symbol at a fixed time."""
    n = shared.news(spark, sf)
    stamp = at()
    return n.select("market", "symbol").distinct().select(
        t.stable_id("analysis", F.lit(AS_OF), F.col("market"), F.col("symbol")).alias("analysis_id"), "market", "symbol", stamp.alias("analysis_timestamp"))


def lineage(spark, sf):
    return ev.snapshot_lineage(analyses(spark, sf), shared.news(spark, sf)).select(
        "analysis_id", "event_id", "source_group", "event_type", "source_level", "scope", "raw_hash")


def snapshot_counts(spark, sf):
    return ev.snapshot_counts(ev.snapshot_lineage(analyses(spark, sf), shared.news(spark, sf)))


def running_counts(spark, sf):
    """An analysis of every symbol each second hour of the first two days."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(2))).alias("hour")
    a = shared.news(spark, sf).select("market", "symbol").distinct().select("market", "symbol", hours)
    a = a.select(F.concat_ws("|", "market", "symbol", "hour").alias("analysis_id"), "market", "symbol", (at("2024-01-01 00:00:00") + F.make_dt_interval(hours="hour")).alias("analysis_timestamp"))
    return ev.running_counts(a, shared.news(spark, sf))


def capture_records(spark, sf):
    """Distinct evidence ids and raw hashes of each analysis, in long form."""
    line = ev.snapshot_lineage(analyses(spark, sf), shared.news(spark, sf))
    return line.select("analysis_id", F.inline(F.array(
        F.struct(F.lit("event").alias("kind"), F.col("event_id").alias("reference")),
        F.struct(F.lit("raw").alias("kind"), F.col("raw_hash").alias("reference"))))).distinct()


def missing_lineage(spark, sf):
    """Lineage against a store that lost one source and the raw texts of another."""
    n = shared.news(spark, sf)
    line = ev.snapshot_lineage(analyses(spark, sf), n)
    store = n.filter(F.col("source_type") != "GDELT_DOC")
    raw = n.filter(~F.col("source_type").eqNullSafe("NAVER_NEWS")).select(F.element_at("raw_reference", "raw_hash").alias("raw_hash"))
    return ev.missing_lineage(line, store, raw)


def snapshot_outcomes(spark, sf):
    """Forward outcomes per decision as a map of horizon to return, read back as columns."""
    out = shared.plain_outcomes(spark, sf).withColumn("analysis_id", F.concat_ws("|", "symbol", "as_of"))
    ids = out.select("analysis_id").distinct()
    m = ev.attach_outcomes(ids, out)
    return m.select("analysis_id", *[F.round(F.element_at("outcomes", h), 4).alias(f"h{h}") for h in (1, 5, 10, 20)])


def news_scores(spark, sf):
    """News score and event risk per market and symbol from the headlines."""
    n = shared.news(spark, sf).select("market", "symbol", classify.sentiment(F.col("title")).alias("sentiment"), classify.headline_risk(F.col("title")).alias("risk"))
    return n.groupBy("market", "symbol").agg(environment.news_score().alias("news_score"), environment.event_risk().alias("event_risk"))


def overview(spark, sf):
    """Every symbol's news as a market of its own; some lack a feed, and some feeds failed."""
    n = shared.news(spark, sf)
    number = F.coalesce(F.try_element_at(F.split("symbol", "#"), F.lit(2)).cast("int"), F.lit(0))
    rows = n.withColumns({"n": number, "feed": F.element_at(F.array(F.lit("news"), F.lit("events"), F.lit("fallback")), (F.col("doc_id") % 3 + 1).cast("int"))})
    kept = F.when(F.col("feed") == "news", F.col("n") % 8 != 0).when(F.col("feed") == "events", F.col("n") % 3 != 0).otherwise(F.col("n") % 2 == 1)
    items = rows.filter(kept).select(F.col("symbol").alias("market"), "feed", "title", "scope", "event_time", "source_type", "event_id")
    markets = n.select("symbol").distinct().withColumn("n", number)
    failures = markets.select(F.col("symbol").alias("market"), F.explode(F.array_compact(F.array(F.when(F.col("n") % 4 == 0, "news"), F.when(F.col("n") % 3 == 0, "events")))).alias("feed"))
    scores = markets.select(F.col("symbol").alias("market"), F.when(F.col("n") % 5 != 0, F.col("n") * 7 % 101).alias("market_score"))
    ids = lambda c: F.coalesce(F.array_join(F.transform(c, lambda h: h["event_id"]), ","), F.lit("")).alias(c)
    scopes = F.coalesce(F.array_join(F.transform("event_headlines", lambda h: h["scope"]), ","), F.lit("")).alias("scopes")
    return ev.market_overview(scores, items, failures).select(
        "market", "market_score", "news_score", "event_risk", "environment_score", "environment_label", F.array_join("feeds", ",").alias("feeds"), ids("headlines"), ids("event_headlines"), scopes)


def snapshot_round_trip(spark, sf):
    """Snapshots written as nested records and read back."""
    a = analyses(spark, sf)
    folder = _folder(spark, "snapshots")
    sinks.write_snapshots(a, ev.snapshot_lineage(a, shared.news(spark, sf)), folder)
    return sinks.snapshot_events(sinks.read_snapshots(spark, folder)).select("analysis_id", "event_id", "source_group", "event_type", "source_level", "scope", "raw_hash")


QUERIES = {
    "snk11_scl_j1_snapshots": snapshot_round_trip,
    "rul20_overview": overview,
    "scl_s1_titles": titles, "scl_s2_tokens": tokens, "scl_s3_similarity": similarity_to_first,
    "scl_s4_numeric_facts": doc_query(facts=lambda: t.numeric_facts(F.col("text"))),
    "scl_s5_entities": entity_names, "scl_s6_alias": alias_match, "scl_s7_urls": urls, "scl_s8_ids": ids,
    "scl_s9_html": stripped_html, "scl_s10_lists": semicolons, "scl_c1_event_types": event_types, "scl_c2_scopes": scopes,
    "scl_c3_source_level": source_levels, "scl_c4_headline_scores": headline_scores, "scl_c8_actions": actions,
    "scl_d1_datetimes": datetimes, "scl_d2_last_session": completed_sessions, "scl_d6_display_time": display_times,
    "flt14_visibility": visibility, "flt15_as_of": lenient_view, "flt19_find_events": found, "flt20_official_items": official,
    "set1_deduplicated": deduplicated, "set2_clusters": clusters, "join15_store_matches": store_matches,
    "set6_ingest": store_after_ingest, "set6_store_clusters": store_clusters, "str2_first_observations": first_observations, "str3_streamed_view": streamed_view,
    "set3_headlines": headlines, "top6_headlines": top_headlines,
    "agg17_agg18_scores": news_scores, "agg22_counts": audit_counts, "agg22_quality": audit_quality, "agg22_coverage": coverage,
    "scl_c7_organisations": organisations, "agg22_relevance_replay": relevance_replay, "agg22_quarantine": relevance_quarantine,
    "agg22_multi_article_clusters": multi_article_clusters,
    "agg24_lineage": lineage, "agg24_counts": snapshot_counts, "agg24_running_counts": running_counts, "snk10_capture": capture_records, "join16_missing_lineage": missing_lineage,
    "snk12_outcomes": snapshot_outcomes,
}
