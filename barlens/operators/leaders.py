"""Leader clusters of events over verified candidate edges.

In time order an event joins the first earlier leader that matches it, else it leads.  Two events can only match
if they share a key: a prefix of their rarest title words (per similarity threshold), an explicit id, each with a
36-hour slot.  ``settle`` decides all events in rounds.  A round compares every open event with the first few open
events of each of its keys; an event that is among those first ones under all its keys has met everything earlier
that could match it, and leads once no earlier open event matches it.  Whoever matches a leader follows and leaves,
so a family of near copies is gone after its leader's round; rounds follow the chains of leaders, not group sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.functions import text as t
from barlens.session import cut

SCOPE = ["market", "symbol"]
GROUP = [*SCOPE, "event_type"]
WINDOW_HOURS = 36
SIMILAR, SIMILAR_WITH_NUMBERS = 0.58, 0.35
#: Events of a key that the first round compares all others with, and most that one does; each takes four times as many as the last.
FIRST_HEADS, HEADS = 4, 64
#: Cells that count words for their rarity; the counts are one short literal whatever the corpus.
CELLS = 1 << 14


def order() -> Column:
    return F.struct("event_time", "source_type", "event_id")


def comparable(events: DataFrame) -> DataFrame:
    return events.select(
        *SCOPE, "event_type", "event_id", "event_time", "explicit_key", order().alias("ord"),
        t.title_tokens(F.col("title_key")).alias("tokens"),
        F.array_sort(t.numeric_facts(F.col("title"))).alias("numbers"),
        F.array_distinct(F.filter(F.transform("entities", t.normalize_title), lambda x: x != "")).alias("names"),
        (F.coalesce("title", F.lit("")) != "").alias("titled"),
    )


def match_method(a: str, b: str) -> Column:
    """How row ``a`` matches representative ``b``; null when it does not."""
    x = lambda c: F.col(f"{a}.{c}")
    y = lambda c: F.col(f"{b}.{c}")
    apart = F.abs(F.unix_micros(x("event_time")) - F.unix_micros(y("event_time"))) > WINDOW_HOURS * 3_600_000_000
    disjoint = lambda c: (F.size(x(c)) > 0) & (F.size(y(c)) > 0) & ~F.arrays_overlap(x(c), y(c))
    blocked = apart | disjoint("numbers") | disjoint("names")
    near = t.jaccard(x("tokens"), y("tokens"))
    titled = x("titled") & y("titled")
    return (
        F.when(blocked, None)
        .when((x("explicit_key") != "") & (x("explicit_key") == y("explicit_key")), "source_event_id")
        .when(titled & (near >= SIMILAR), "title_entity_time_candidate")
        .when(titled & (F.size(x("numbers")) > 0) & (x("numbers") == y("numbers")) & (near >= SIMILAR_WITH_NUMBERS),
              "title_number_entity_time_candidate")
    )


def slot() -> Column:
    """36-hour slot of an event: events in reach of each other lie in one slot or in neighbouring ones."""
    return F.floor(F.unix_seconds("event_time") / (WINDOW_HOURS * 3600)).cast("int")


def _cell(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(CELLS)).cast("int")


def rarity(rows: DataFrame) -> str:
    """In how many events the words of each cell occur, as one text; any fixed counts give right results."""
    counts = dict(rows.select(F.explode("tokens").alias("w")).groupBy(_cell(F.col("w")).alias("cell")).count().collect())
    return ",".join(str(counts.get(k, 0)) for k in range(CELLS))


def _prefix(tokens: Column, threshold: float, counts: str) -> Column:
    """Rarest tokens, of which two sets at least this similar must share one."""
    known = F.split(F.lit(counts), ",").cast("array<bigint>")
    ranked = F.array_sort(F.transform(tokens, lambda w: F.struct(F.get(known, _cell(w)).alias("a"), F.xxhash64(w).alias("b"), w.alias("w"))))
    keep = F.size(tokens) - F.ceil(F.size(tokens) * threshold).cast("int") + 1
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(keep, F.lit(0))), lambda x: x["w"])


def match_keys(rows: DataFrame, counts: str) -> DataFrame:
    """(event_id, ord, key): every matching pair shares a key (linear in tokens, no pairs)."""
    none = F.array().cast("array<string>")
    numbered = F.concat(F.lit("n|"), F.array_join("numbers", ","), F.lit("|"))
    names = F.concat(
        F.transform(_prefix(F.col("tokens"), SIMILAR, counts), lambda w: F.concat(F.lit("j|"), w)),
        F.when(F.size("numbers") > 0, F.transform(_prefix(F.col("tokens"), SIMILAR_WITH_NUMBERS, counts), lambda w: F.concat(numbered, w))).otherwise(none),
        F.when(F.col("explicit_key") != "", F.array(F.concat(F.lit("x|"), F.col("explicit_key")))).otherwise(none),
    )
    spread = rows.select(*GROUP, "event_id", "ord", slot().alias("slot"), F.explode(names).alias("name"))
    both = spread.select(*GROUP, "event_id", "ord", "name", F.explode(F.array("slot", F.col("slot") + 1)).alias("s"))
    return both.select("event_id", "ord", F.xxhash64(*GROUP, "name", "s").alias("key")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (event_id, other_id) that match, the second earlier: with its order and the method."""
    a, b = rows.alias("a"), others.alias("b")
    checked = pairs.alias("p").join(a, F.col("p.event_id") == F.col("a.event_id")).join(b, F.col("p.other_id") == F.col("b.event_id"))
    same = F.lit(True)
    for c in GROUP:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return checked.filter(same & (F.col("b.ord") < F.col("a.ord"))).select(
        "p.event_id", "p.other_id", F.col("b.ord").alias("other_ord"), match_method("a", "b").alias("method")).filter("method is not null")


def first_leaders(rows: DataFrame, keys: DataFrame, leaders: DataFrame, leader_keys: DataFrame) -> DataFrame:
    """The first earlier leader that each row matches: (event_id, leader_id, method)."""
    led = leader_keys.select("key", F.col("event_id").alias("other_id"), F.col("ord").alias("other_ord"))
    pairs = keys.join(led, "key").filter(F.col("other_ord") < F.col("ord")).select("event_id", "other_id").distinct()
    first = _verified(pairs, rows, leaders).groupBy("event_id").agg(F.min_by(F.struct("other_id", "method"), "other_ord").alias("m"))
    return first.select("event_id", F.col("m.other_id").alias("leader_id"), "m.method")


def _decide(rows: DataFrame, keys: DataFrame, most_heads: int) -> DataFrame:
    """The leaders among ``rows``: (event_id)."""
    leaders = rows.select("event_id").join(keys.select("event_id").distinct(), "event_id", "left_anti")  # nothing to match by
    open_keys, width = keys, min(FIRST_HEADS, most_heads)
    turn = Window.partitionBy("key").orderBy("ord")
    while not open_keys.isEmpty():
        heads = cut(open_keys.withColumn("place", F.row_number().over(turn)).filter(F.col("place") <= width).drop("place"))
        firsts = heads.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).join(
            open_keys.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("all")), F.col("event_id") == F.col("id"))
        ready = cut(firsts.filter(F.col("n") == F.col("all")).select("event_id"))
        known = heads.select("key", F.col("event_id").alias("other_id"), F.col("ord").alias("other_ord"))
        pairs = open_keys.join(known, "key").filter(F.col("other_ord") < F.col("ord")).select("event_id", "other_id").distinct()
        edges = cut(_verified(pairs, rows, rows).select("event_id", "other_id"))
        gone = []
        while not ready.isEmpty():
            blocked = not edges.isEmpty()
            found = cut(ready.join(edges.select("event_id").distinct(), "event_id", "left_anti")) if blocked else ready
            gone.append(found)
            if not blocked or found.isEmpty():
                break
            followers = cut(edges.join(found.select(F.col("event_id").alias("other_id")), "other_id", "left_semi").select("event_id").distinct())
            gone.append(followers)
            now = found.unionByName(followers)
            edges = edges.join(now, "event_id", "left_anti").join(now.select(F.col("event_id").alias("other_id")), "other_id", "left_anti")
            ready, edges = cut(ready.join(now, "event_id", "left_anti")), cut(edges.select("event_id", "other_id"))
        leaders = reduce(DataFrame.unionByName, gone[::2], leaders)
        # The earliest open event is always ready and without an edge, so each round settles some.
        open_keys = cut(open_keys.join(reduce(DataFrame.unionByName, gone), "event_id", "left_anti"))
        width = min(width * 4, most_heads)
    return leaders


def settle(rows: DataFrame, counts: str, before: DataFrame | None = None, most_heads: int = HEADS) -> DataFrame:
    """(event_id, leader_id, method) of ``rows`` (see ``comparable``), method ``singleton`` for leaders.

    ``before``: leaders that are settled already and may be followed, earlier than a row or not.
    """
    keys = cut(match_keys(rows, counts))
    open_rows, open_keys = rows, keys
    if before is not None:
        before_keys = cut(match_keys(before, counts))
        led = cut(first_leaders(rows, keys, before, before_keys).select("event_id"))
        open_rows, open_keys = rows.join(led, "event_id", "left_anti"), cut(keys.join(led, "event_id", "left_anti"))
    leaders = cut(_decide(open_rows, open_keys, most_heads))
    leading, leading_keys = rows.join(leaders, "event_id", "left_semi"), keys.join(leaders, "event_id", "left_semi")
    if before is not None:
        leading, leading_keys = leading.select(*before.columns).unionByName(before), leading_keys.unionByName(before_keys)
    followers = first_leaders(rows.join(leaders, "event_id", "left_anti"), keys.join(leaders, "event_id", "left_anti"), leading, leading_keys)
    return cut(leaders.select("event_id", F.col("event_id").alias("leader_id"), F.lit("singleton").alias("method")).unionByName(followers))


def cluster_name() -> Column:
    """Cluster id that a leader gives: from its scope, type, day and most explicit identity."""
    seed = F.coalesce(F.nullif("explicit_key", F.lit("")), F.nullif("title_key", F.lit("")), F.nullif("article_id", F.lit("")), F.col("event_id"))
    return t.stable_id("cluster", F.col("market"), F.col("symbol"), F.col("event_type"), F.to_date("event_time"), seed)
