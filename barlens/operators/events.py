"""News and filing evidence: visibility, de-duplication, clustering, store merge, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions import classify, fixed_values as fixed, text as t
from barlens.operators import environment
from barlens.operators.leaders import HEADS, SCOPE, WINDOW_HOURS, cluster_name, comparable, order, rarity, settle
from barlens.session import cut


def prepared_events(events: DataFrame) -> DataFrame:
    """Add the derived keys every evidence operator compares."""
    ref = F.col("raw_reference")
    key = F.coalesce(*[F.nullif(F.try_element_at(ref, F.lit(k)), F.lit("")) for k in (
        "gdelt_event_id", "accession_number", "receipt_number")], F.lit(""))
    return events.withColumns({
        "url_key": t.canonical_url(F.col("source_url")),
        "title_key": t.normalize_title(F.col("title")),
        "event_type": classify.event_type(F.col("title")),
        "scope": classify.scope(F.col("title"), F.when(F.col("symbol") == "*", "MARKET").otherwise("COMPANY")),
        "source_level": classify.source_level(F.col("source_type")),
        "explicit_key": key,
    })


def quarantine() -> Column:
    """Name of the closed-set field an event violates; null when it is valid."""
    checks = [("event_type", fixed.EVENT_TYPES), ("pit_trust", fixed.TRUST_LEVELS), ("scope", fixed.EVENT_SCOPES),
              ("relevance_status", fixed.RELEVANCE_STATUSES)]
    result = F.when(~F.coalesce(F.col("source_level").isin(1, 2, 3), F.lit(False)), "source_level")
    for name, allowed in checks:
        result = result.when(~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), name)
    return result


# ---- visibility ----------------------------------------------------------------------


def visibility(as_of: Column) -> Column:
    """Reason code of an event at a time; only ``visible`` may be used."""
    return (
        F.when(F.col("event_time") > as_of, "event_after_as_of")
        .when(F.col("first_seen_at").isNull(), "first_seen_unknown")
        .when(F.col("first_seen_at") > as_of, "first_seen_after_as_of")
        .otherwise("visible")
    )


def events_as_of(events: DataFrame, as_of: Column, market: str | None = None, symbol: str | None = None,
                 require_first_seen: bool = True) -> DataFrame:
    if market:
        events = events.filter(F.upper("market") == market.upper())
    if symbol:
        events = events.filter(F.upper("symbol") == symbol.upper())
    allowed = ("visible",) if require_first_seen else ("visible", "first_seen_unknown")
    return events.filter(visibility(as_of).isin(*allowed)).orderBy("event_time", "event_id")


def find_events(events: DataFrame, market: str | None = None, symbol: str | None = None,
                source_type: str | None = None) -> DataFrame:
    """Predicate query; the filters reach the scan of a table partitioned by market."""
    for name, value in (("market", market and market.upper()), ("symbol", symbol and symbol.upper()), ("source_type", source_type)):
        if value:
            events = events.filter(F.col(name) == value)
    return events.orderBy("event_time", "event_id")


# ---- article de-duplication ---------------------------------------------------------------


def _winners(keys: DataFrame, group: list[str]) -> DataFrame:
    """Rows that come first in every one of their key groups."""
    heads = keys.groupBy(*group).agg(F.min("ord").alias("head"))
    placed = keys.join(heads, group)
    return placed.groupBy("event_id").agg(F.min((F.col("ord") == F.col("head")).cast("int")).alias("first")).filter(
        "first = 1").select("event_id")


def deduplicate(events: DataFrame) -> DataFrame:
    """Articles kept by the sequential rule, found in parallel rounds.

    In time order a row is dropped when an already kept row of the same market
    and symbol shares its article id, URL or title; keys of dropped rows do not
    count.  A row that is first in all its key groups is certainly kept, and then
    closes those groups; the rest go to the next round.  Groups are reduced to
    their first row map-side, so a group of copies never meets in one task, and
    equal (id, URL, title) rows collapse to one before the rounds begin.
    """
    kinds = {"article_id": "a", "url_key": "u", "title_key": "t"}
    ident = [*SCOPE, *[F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256).alias(f"k_{k}") for c, k in kinds.items()]]
    present = [F.coalesce(F.col(c), F.lit("")) != "" for c in kinds]
    rows = cut(events.select(*ident, order().alias("ord"), "event_id", *[p.alias(f"has_{k}") for p, k in zip(present, kinds.values())]))
    anything = reduce(lambda a, b: a | b, [F.col(f"has_{k}") for k in kinds.values()])
    free = rows.filter(~anything).select("event_id")
    unique = rows.filter(anything).groupBy(*SCOPE, "k_a", "k_u", "k_t", "has_a", "has_u", "has_t").agg(F.min("ord").alias("ord"))
    keys = F.array_compact(F.array(*[
        F.when(F.col(f"has_{k}"), F.concat(F.lit(f"{k}|"), F.col(f"k_{k}"))) for k in kinds.values()]))
    open_keys = cut(unique.select(*SCOPE, "ord", F.col("ord.event_id").alias("event_id"), F.explode(keys).alias("key")))
    group = [*SCOPE, "key"]
    kept = free
    while not open_keys.isEmpty():
        winners = cut(_winners(open_keys, group))
        closed = open_keys.join(winners, "event_id", "left_semi").select(*group)
        settled = open_keys.join(closed, group, "left_semi").select("event_id").distinct()
        open_keys = cut(open_keys.join(settled, "event_id", "left_anti"))
        kept = kept.unionByName(winners)
    return events.join(kept, "event_id", "left_semi")


# ---- event clusters -------------------------------------------------------------------------


def cluster(events: DataFrame, batch: int = HEADS) -> DataFrame:
    """Leader clusters: (event_id, leader_id, cluster_id, cluster_method).

    In time order a row joins the first earlier leader that matches it, else it leads; ``batch`` bounds how many
    rows of a key the others are compared with at a time (see ``leaders``).  Callers run ``deduplicate`` first.
    """
    rows = cut(comparable(events))
    settled = settle(rows, rarity(rows), most_heads=batch)
    names = events.select(F.col("event_id").alias("leader_id"), cluster_name().alias("cluster_id"))
    return settled.join(names, "leader_id").select("event_id", "leader_id", "cluster_id", F.col("method").alias("cluster_method"))


# ---- store merge ------------------------------------------------------------------------------


def match_store(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Add matched_id and match_kind: same event, else article, else URL, else title.

    The newest stored copy of a key counts; stored rows keep their first-seen time.  Keys travel as digests; a row
    without a key gets one of its own, which no stored row has, so that such rows do not meet in one task.
    """
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    known_key = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    newest = F.struct("event_time", "event_id")
    out = incoming.join(store.select("event_id", F.col("event_id").alias("by_id")), "event_id", "left")
    for kind, key in (("article", "article_id"), ("url", "url_key"), ("title", "title_key")):
        known = store.groupBy(*SCOPE, digest(key).alias("_key")).agg(F.max_by("event_id", newest).alias(f"by_{kind}"), F.max(known_key(key)).alias("_known"))
        known = known.filter("_known").drop("_known")
        out = out.withColumn("_key", F.when(known_key(key), digest(key)).otherwise(F.concat(F.lit("-"), "event_id")))
        out = out.join(known, [*SCOPE, "_key"], "left").drop("_key")
    kinds = ["id", "article", "url", "title"]
    which = reduce(lambda acc, k: acc.when(F.col(f"by_{k}").isNotNull(), k), kinds, F.when(F.lit(False), ""))
    return out.withColumns({
        "matched_id": F.coalesce(*[F.col(f"by_{k}") for k in kinds]), "match_kind": which.otherwise("new"),
    }).drop(*[f"by_{k}" for k in kinds])


def ingest(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Events to append: the incoming articles nothing in the store matches."""
    return match_store(deduplicate(incoming), store).filter(F.col("match_kind") == "new").drop("matched_id", "match_kind")


def touched(store: DataFrame, new: DataFrame) -> DataFrame:
    """Stored events whose clusters a new event can bear on.

    Rows of one market, symbol and type more than 36 hours apart never match, so
    clusters stay inside runs without such a gap: all rows of a run that holds a new
    event are taken, its first leader included, and nothing of the other runs.
    """
    group = [*SCOPE, "event_type"]
    marks = store.select(*group, "event_id", "event_time", F.lit(0).alias("_new")).unionByName(
        new.select(*group, "event_id", "event_time", F.lit(1).alias("_new")))
    # A group without new events cannot change.
    marks = marks.join(new.select(*group).distinct(), group, "left_semi")
    turn = Window.partitionBy(*group).orderBy("event_time", "event_id")
    gap = F.unix_micros("event_time") - F.unix_micros(F.lag("event_time").over(turn)) > WINDOW_HOURS * 3_600_000_000
    runs = marks.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("_run", F.sum("_gap").over(turn))
    hit = runs.filter("_new = 1").select(*group, "_run").distinct()
    ids = runs.filter("_new = 0").join(hit, [*group, "_run"], "left_semi").select("event_id")
    return store.join(ids, "event_id", "left_semi")


def ingest_clustered(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Events to append, each with its cluster_id and cluster_method.

    They are clustered together with the stored events they can meet; stored events
    keep the cluster they were given.
    """
    plain = [c for c in incoming.columns if c not in ("cluster_id", "cluster_method")]
    new = cut(ingest(incoming.select(*plain), store).select(*plain))
    near = touched(store, new).select(*plain)
    found = cluster(near.unionByName(new)).select("event_id", "cluster_id", "cluster_method")
    return new.join(found, "event_id")


# ---- headlines ------------------------------------------------------------------------------------


def first_headlines(items: DataFrame, limit: int | None = None, key_length: int | None = None) -> DataFrame:
    """One item per headline key and scope, the first by order; optionally the first ``limit``.

    The key is the whole folded headline, or its first ``key_length`` characters; it travels as a digest.
    """
    keyed = items.withColumn("_text", t.headline_key(F.col("title"), key_length))
    keyed = keyed.withColumns({"_key": F.sha2(F.col("_text").cast("binary"), 256), "_length": F.length("_text")})
    # Blank keys leave after the grouping: a filter on the text would run in the tasks that scan it.
    first = keyed.groupBy(*SCOPE, "_key").agg(F.min(order()).alias("o"), F.max("_length").alias("_length")).filter("_length > 0").select(*SCOPE, "_key", "o.*")
    if limit is None:
        return first.drop("_key")
    w = Window.partitionBy(*SCOPE).orderBy("event_time", "source_type", "event_id")
    return first.drop("_key").withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def official_items(events: DataFrame, now: Column, limit: int = 8) -> DataFrame:
    """Newest filings already first seen, at most eight per symbol."""
    seen = events.filter((F.col("source_level") == 1) & (F.col("first_seen_at") <= now))
    w = Window.partitionBy(*SCOPE).orderBy(F.col("event_time").desc(), F.col("event_id").desc())
    return seen.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def market_overview(markets: DataFrame, items: DataFrame, failures: DataFrame) -> DataFrame:
    """The news side of every market's overview; a score is null only where its source failed.

    ``markets``: market, market_score.  ``items``: market, feed (``news``, ``events``, ``fallback``), title, scope and
    the order columns.  ``failures``: market, feed of the requests that failed.  Where the event feed failed, fallback
    items, if there are any, take its place and the failure is made good.  Result: market, market_score, news_score,
    event_risk, environment_score and its label, feeds (those that gave items), headlines (the first 8 ids of distinct headlines),
    event_headlines (the first 6, with scope and relevance to the market).
    """
    has = lambda feed: F.max((F.col("feed") == feed).cast("int"))
    failed = failures.groupBy("market").agg(*[has(f).alias(f"failed_{f}") for f in ("news", "events")])
    given = items.groupBy("market").agg(*[has(f).alias(f"has_{f}") for f in ("news", "events", "fallback")])
    state = markets.join(failed, "market", "left").join(given, "market", "left").fillna(0, [f"{p}_{f}" for p, f in (
        ("failed", "news"), ("failed", "events"), ("has", "news"), ("has", "events"), ("has", "fallback"))])
    state = state.withColumn("replaced", (F.col("failed_events") == 1) & (F.col("has_fallback") == 1))
    rows = items.join(state.select("market", "replaced"), "market")
    news = rows.filter(F.col("feed") == "news")
    used = rows.filter(F.col("feed") == F.when(F.col("replaced"), "fallback").otherwise("events"))
    detail = {
        "scope": classify.scope(F.col("title"), F.coalesce(F.nullif("scope", F.lit("")), F.lit("GLOBAL_EVENT"))),
        "relevance": classify.context_relevance(F.col("title"), F.col("market"), F.lit(""), F.lit(""))}
    scored = news.withColumn("sentiment", classify.sentiment(F.col("title"))).groupBy("market").agg(environment.news_score().alias("_news"))
    risky = used.withColumn("risk", classify.headline_risk(F.col("title"))).groupBy("market").agg(environment.event_risk().alias("_risk"))

    def listed(df: DataFrame, limit: int, name: str, more: dict[str, Column]) -> DataFrame:
        first = first_headlines(df.withColumn("symbol", F.lit("*")), limit).select("market", "event_id", "position")
        # Texts are classified once they are listed.
        first = first.join(df.select("market", "event_id", *(("title", "scope") if more else ())), ["market", "event_id"]).withColumns(more)
        return first.groupBy("market").agg(F.sort_array(F.collect_list(F.struct("position", "event_id", *more))).alias(name))

    out = state.join(scored, "market", "left").join(risky, "market", "left")
    out = out.join(listed(news, 8, "headlines", {}), "market", "left").join(listed(used, 6, "event_headlines", detail), "market", "left")
    no_events = (F.col("failed_events") == 1) & ~F.col("replaced") & (F.col("has_events") == 0)
    out = out.withColumns({
        "news_score": F.when(~((F.col("failed_news") == 1) & (F.col("has_news") == 0)), F.coalesce("_news", F.lit(50))),
        "event_risk": F.when(~no_events, F.coalesce("_risk", F.lit(15)))})
    feeds = F.array_compact(F.array(F.when(F.col("has_news") == 1, "news"), F.when(F.col("has_events") == 1, "events"), F.when(F.col("replaced"), "fallback")))
    return environment.with_environment(out.select("market", "market_score", "news_score", "event_risk", feeds.alias("feeds"), "headlines", "event_headlines"))


# ---- audit and snapshots ------------------------------------------------------------------------------


def audit_counts(events: DataFrame) -> DataFrame:
    """(dimension, value, events): all counters in one pass over the events."""
    dims = {
        "by_source": F.col("source_type"), "by_market": F.col("market"), "by_symbol": F.concat_ws(":", "market", "symbol"),
        "source_levels": F.concat(F.lit("LEVEL_"), F.col("source_level")), "scopes": F.col("scope"),
        "normalized_event_types": F.col("event_type"),
    }
    for name in ("pit_trust", "relevance_status"):
        if name in events.columns:
            dims[name] = F.col(name)
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("value")) for k, v in dims.items()])
    return events.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("events"))


def audit_quality(events: DataFrame) -> DataFrame:
    """One row: first-seen problems and duplicate counts per key kind."""
    seen = events.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("first_seen_at").isNull()).alias("unknown_first_seen_count"),
        F.count_if(F.col("first_seen_at") < F.col("event_time")).alias("first_seen_before_event_count"),
    )
    for name, key in (("article_id", "article_id"), ("canonical_url", "url_key"), ("normalized_title", "title_key")):
        known = F.coalesce(F.col(key), F.lit("")) != ""
        groups = events.groupBy(*SCOPE, F.sha2(F.col(key).cast("binary"), 256).alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.max(known).alias("_known")).filter("_known")
        # Both sides are one row.
        extra = groups.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias(f"duplicate_{name}_count"))
        seen = seen.withColumn("_one", F.lit(1)).join(extra.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return seen


def relevance_replay(events: DataFrame) -> DataFrame:
    """Stored organisation-graph events put through the organisation gate again: the events with ``verdict``.

    Needs ``organizations``, ``company_name``, ``symbol`` and ``matched_aliases`` as they were recorded.  Other
    sources have no organisations and are left out.
    """
    return events.filter(F.col("source_type") == "GDELT_GKG").withColumn("verdict", classify.organisation_relevance(
        F.col("organizations"), F.col("company_name"), F.col("symbol"), F.col("matched_aliases")))


def relevance_quarantine(replayed: DataFrame) -> DataFrame:
    """The events that the gate rejects now, with its reason and the names it met."""
    return replayed.filter(~F.col("verdict.accepted")).select(*SCOPE, "event_id", "verdict.status", "verdict.reason", "verdict.matches")


def replay_counts(replayed: DataFrame) -> DataFrame:
    """Candidates, accepted and rejected ones by symbol; the row without a symbol is all of them."""
    accepted = F.col("verdict.accepted")
    return replayed.rollup("symbol").agg(
        F.count(F.lit(1)).alias("before_candidate_count"), F.count_if(accepted).alias("accepted_candidate_count"),
        F.count_if(~accepted).alias("rejected_candidate_count"))


def multi_article_clusters(clustered: DataFrame) -> DataFrame:
    """One row: how many clusters hold several events, and the events in them."""
    sizes = clustered.filter(F.coalesce("cluster_id", F.lit("")) != "").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    return sizes.agg(F.count_if(several).alias("multi_article_cluster_count"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("clustered_events"))


def coverage(events: DataFrame) -> DataFrame:
    return events.groupBy("source_type").agg(F.min("event_time").alias("start"), F.max("event_time").alias("end"))


SOURCE_GROUPS = {
    "OPENDART": "dart_event_ids", "SEC_EDGAR": "edgar_event_ids", "NAVER_NEWS": "naver_news_ids",
    "GOOGLE_NEWS_RSS": "google_news_ids", "GDELT_GKG": "gdelt_candidate_ids", "GDELT_DOC": "gdelt_candidate_ids",
}


def snapshot_lineage(analyses: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence of each analysis in long form: one row per visible event.

    ``analyses``: analysis_id, market, symbol, analysis_timestamp.  A popular
    symbol's evidence stays many rows; it is never folded into one array.
    """
    group = F.when(F.lit(False), "")
    for source, name in SOURCE_GROUPS.items():
        group = group.when(F.col("source_type") == source, name)
    joined = events.join(analyses, SCOPE)
    seen = joined.filter(visibility(F.col("analysis_timestamp")) == "visible")
    return seen.select(
        "analysis_id", *SCOPE, "event_id", group.alias("source_group"), "source_type", "event_type", "source_level", "scope",
        F.element_at("raw_reference", "raw_hash").alias("raw_hash"), "event_time",
    ).dropDuplicates(["analysis_id", "event_id"])


def snapshot_counts(lineage: DataFrame) -> DataFrame:
    g = lineage.groupBy("analysis_id")
    return g.agg(
        *[F.count_if(F.col("source_group") == name).alias(name) for name in dict.fromkeys(SOURCE_GROUPS.values())],
        F.count(F.lit(1)).alias("visible_events"), F.count_distinct("raw_hash").alias("raw_hashes"))


def visible_from() -> Column:
    """When an event first may be used; null while its first sighting is unknown."""
    return F.when(F.col("first_seen_at").isNotNull(), F.greatest("event_time", "first_seen_at"))


def lineage_deltas(analyses: DataFrame, events: DataFrame) -> DataFrame:
    """The evidence that each analysis sees and none of its symbol's earlier ones did: one row per event.

    An analysis's whole evidence is its delta and those before it, so daily analyses cost the events once, not once a
    day.  Every event joins its scope's analyses of one day, and the first one of a later day.
    """
    day = [*SCOPE, "_day"]
    runs = analyses.groupBy(*SCOPE, F.to_date("analysis_timestamp").alias("_day")).agg(F.sort_array(F.collect_list(F.struct("analysis_timestamp", "analysis_id"))).alias("_runs"))
    seen = events.withColumn("visible_from", visible_from()).filter("visible_from is not null").withColumn("_day", F.to_date("visible_from"))
    calendar = seen.select(*day).distinct().join(runs, day, "full")
    after = Window.partitionBy(*SCOPE).orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    calendar = calendar.withColumn("_later", F.first(F.get("_runs", F.lit(0)), ignorenulls=True).over(after))
    joined = seen.join(calendar, day).withColumn("_run", F.coalesce(F.get(F.filter("_runs", lambda r: r["analysis_timestamp"] >= F.col("visible_from")), F.lit(0)), F.col("_later")))
    return joined.filter("_run is not null").select(F.col("_run.analysis_id").alias("analysis_id"), F.col("_run.analysis_timestamp").alias("analysis_timestamp"),
                                                    *SCOPE, "event_id", "source_type", "visible_from")


def running_counts(analyses: DataFrame, events: DataFrame) -> DataFrame:
    """Visible events of every analysis, by source group and in all: running sums of the deltas."""
    group = F.when(F.lit(False), "")
    for source, name in SOURCE_GROUPS.items():
        group = group.when(F.col("source_type") == source, name)
    names = [*dict.fromkeys(SOURCE_GROUPS.values())]
    new = lineage_deltas(analyses, events).withColumn("_group", group).groupBy("analysis_id").agg(
        *[F.count_if(F.col("_group") == n).alias(n) for n in names], F.count(F.lit(1)).alias("visible_events"))
    so_far = Window.partitionBy(*SCOPE).orderBy("analysis_timestamp", "analysis_id")
    rows = analyses.join(new, "analysis_id", "left")
    return rows.select("analysis_id", *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(n) for n in (*names, "visible_events")])


def missing_lineage(lineage: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Lineage rows whose event or raw artifact is gone."""
    no_event = lineage.join(events.select("event_id").distinct(), "event_id", "left_anti").select(
        "analysis_id", F.col("event_id").alias("reference"), F.lit("event").alias("missing"))
    no_raw = lineage.filter(F.coalesce("raw_hash", F.lit("")) != "").join(
        artifacts.select("raw_hash").distinct(), "raw_hash", "left_anti").select(
        "analysis_id", F.col("raw_hash").alias("reference"), F.lit("raw").alias("missing"))
    return no_event.unionByName(no_raw)


def attach_outcomes(analyses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Later outcomes of a snapshot, horizons 1/5/10/20 only, as a map by horizon."""
    return analyses.join(outcomes.filter(F.col("horizon").isin(1, 5, 10, 20)), "analysis_id").groupBy("analysis_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", "forward_return_pct")))).alias("outcomes"))
