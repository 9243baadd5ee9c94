"""Passages of held-out texts in the articles a model is to learn from.

A text is lower-cased (A-Z) and read as words, runs of digits, letters a-z and characters beyond ASCII.
Every ``window`` words in a row of a held-out text are one window; a shorter text that has words is one
window itself.  The hashes of all windows are a set that each task probes for every window of its articles;
a hit counts once the words themselves are equal.  Column functions only.

The set is broadcast while its counted bytes fit the bound of ``common.bounded``; beyond it the probing is a
join dealt by hash.  What the probes find is gathered by text, so copies of one text are checked once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.llm.common import BROADCAST_BYTES, bounded
from barlens.session import stored

#: Words of a window.
WINDOW = 10
#: A class that names its ASCII characters one by one: Java looks these up in a table, while it tries the ranges of a negated class in turn.
WORD = f"[{string.digits}{string.ascii_letters}\\x{{80}}-\\x{{10FFFF}}]+"
#: A word with what stands before it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column | str, lowered: bool = True) -> Column:
    """The words of a text in their order; no text has none."""
    if lowered:
        text = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _folded(text: Column | str) -> Column:
    """The text with all letters lower-cased, faster than A-Z alone: texts of equal words have equal words here.

    The one letter that is lower-cased by what surrounds it, be it in other words, is replaced before."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _window_hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, start + k) for k in range(length)])


def held_out_windows(held_out: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the held-out texts: length, hash of the folded words, words joined by one space, and the item's id as text
    (items without an id are one item, with the empty string as its id)."""
    rows = held_out.select(F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("item"), words("title").alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    keys = F.array_distinct(F.transform(starts, lambda s: F.array_join(F.slice("words", s, F.col("length")), " ")))
    rows = rows.select("item", "length", F.explode(keys).alias("key")).distinct()
    by_length = F.coalesce(*[F.when(F.col("length") == n, _window_hash(F.col("_words"), F.lit(0), n)) for n in range(1, window + 1)])
    return rows.withColumn("_words", F.split(_folded("key"), " ", -1)).withColumn("hash", by_length).drop("_words")


def _probed(articles: DataFrame, windows: DataFrame) -> DataFrame:
    """Per text (its digest) where windows begin whose hash is in the set."""
    probes = stored(windows.select("length", "hash").distinct(), "held-out-hashes")
    lengths = [r["length"] for r in probes.select("length").distinct().orderBy("length").collect()]
    rows = articles.select(_digest("title").alias("digest"), words(_folded("title"), lowered=False).alias("words"))
    # One row a word; no function of arrays, so that Spark compiles all of it.  The outer form spares a filter that would cut the text into words once more.
    rows = rows.select("digest", "words", F.posexplode_outer("words").alias("start", "first"))
    hashes = [F.when(F.get("words", F.col("start") + (n - 1)).isNotNull(), _window_hash(F.col("words"), F.col("start"), n)) for n in lengths]
    rows = rows.select("digest", "start", hashes[0].alias("hash") if len(hashes) == 1 else F.explode(F.array(*hashes).cast("array<bigint>")).alias("hash"))
    rows = rows.filter("hash is not null").join(bounded(probes, 32), "hash")
    return rows.groupBy("digest").agg(F.collect_set(F.struct("start", "length")).alias("places"))


def _runs(hits: DataFrame) -> DataFrame:
    """Per text the maximal runs (start, end) of hit words; a partition holds the hits of one text."""
    order = Window.partitionBy("digest").orderBy("start", "length")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.select("digest", "start", "length", (F.col("start") + F.col("length")).alias("end")).distinct()
    rows = rows.withColumn("opens", F.when(F.col("start") > F.coalesce(reached, F.lit(-1)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("opens").over(order))
    runs = rows.groupBy("digest", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def flag_held_out(articles: DataFrame, held_out: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every article with the words that a held-out text shares with it.

    ``articles`` has event_id and title, the whole text; ``held_out`` the same two columns: events kept back to
    measure a model with.  Result, one row per article row: event_id, title, n_words, n_hit (words inside any
    window, long), items (ids of held-out texts with a window in the article, sorted as text), spans (arrays of
    start and end: maximal runs of neighbouring hit words, counted in words from 0, end exclusive), contaminated.

    No text (null) or no word: nothing hit.  Repeated rows and rows without an id are judged by their text like
    any other; other columns are ignored.  A held-out text without words matches nothing; held-out rows of one
    id are one item; without an id they share the empty id.  Empty tables give empty results or no hits.
    """
    windows = stored(held_out_windows(held_out, window), "held-out-windows")
    found = stored(_probed(articles, windows), "held-out-places")
    texts = articles.select("title", _digest("title").alias("digest")).join(bounded(found.select("digest"), 48), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.min("title").alias("title")).join(found, "digest").withColumn("words", words("title"))
    seen = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), F.array_join(F.slice("words", p["start"] + 1, p["length"]), " ").alias("key")))
    seen = texts.select("digest", F.explode(seen).alias("p")).select("digest", "p.*")
    keys = windows.select("length", "key").distinct()
    size = windows.agg(F.sum(F.octet_length("key") + F.octet_length("item") + 64)).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    hits = stored(seen.join(small(keys), ["length", "key"]), "held-out-hits")
    spans = _runs(hits)
    items = hits.select("digest", "key", "length").distinct().join(small(windows.select("length", "key", "item")), ["length", "key"])
    items = items.groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    results = stored(spans.join(items, "digest"), "held-out-results")
    size = results.agg(F.sum(F.size("spans") * 32 + F.octet_length(F.array_join("items", ",")) + F.size("items") * 16 + 96)).first()[0] or 0
    results = F.broadcast(results) if size <= BROADCAST_BYTES else results
    rows = articles.select("event_id", "title", F.size(words("title", lowered=False)).cast("bigint").alias("n_words"), _digest("title").alias("digest")).join(results, "digest", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return rows.select(
        "event_id", "title", "n_words", F.coalesce(n_hit, F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.col("spans").isNotNull().alias("contaminated"))


def without_spans(text: Column | str, spans: Column | str) -> Column:
    """The text without the words of ``spans`` and what stands before each of them; the end after the last word stays."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    # What stays is cut between the runs: from the end of one to the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda r: r["end"]))
    starts = F.concat(F.transform(spans, lambda r: r["start"]), F.array(F.size(pieces)))
    kept = F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a), ""))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(kept, ""), F.regexp_extract(text, PIECE.split("]*")[0] + r"]*\z", 0)))
