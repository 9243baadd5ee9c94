"""Near duplicates among article titles by min-max hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import bounded
from barlens.session import stored

#: Permutations (each gives a minimum and a maximum), values per band.  At a similarity of
#: 0.8 a pair shares none of the 36 bands with a probability below one in a million.
PERMUTATIONS, BAND_VALUES = 90, 5
SHINGLE_WORDS = 5
#: Links have 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 80
#: Shingles hashed at once: bounds the memory of very long texts.
CHUNK = 4096
#: Members of one block of a bucket.
BLOCK_MEMBERS = 256
WORD_CACHE = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(title: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased; words
    end at spaces and ASCII controls 9 to 13); a shorter text is one shingle."""
    parts = (title or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(known) > WORD_CACHE:
        known.clear()
    for w in set(parts).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width) * _ODD)
        for j in range(width):
            out = _mixed(out ^ h[j:j + n]) + _ODD
    return np.unique(out)


def min_max_bands(shingles: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """One hash per band of the signature: the minima of all permutations, then their maxima."""
    low, high = np.full(len(odd), np.uint64(2**64 - 1)), np.zeros(len(odd), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), CHUNK):
            moved = odd[:, None] * shingles[None, at:at + CHUNK] + shift[:, None]
            np.minimum(low, moved.min(axis=1), out=low)
            np.maximum(high, moved.max(axis=1), out=high)
        values = np.concatenate([low, high]).reshape(-1, BAND_VALUES)
        out = np.arange(len(values), dtype=np.uint64) * _ODD
        for j in range(BAND_VALUES):
            out = _mixed(out ^ values[:, j]) + _ODD
    return out.view(np.int64)


def signatures(articles: DataFrame, shingle_words: int, seed: int = 7) -> DataFrame:
    """(event_id, n_shingles, set_key, bands); set_key is a 128-bit digest of the whole set, null without words."""
    schema = f"event_id {articles.schema['event_id'].dataType.simpleString()}, n_shingles bigint, set_key binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        odd = draw.integers(0, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1)
        shift = draw.integers(0, 2**64, PERMUTATIONS, np.uint64)
        known: dict[bytes, int] = {}
        for batch in batches:
            counts, keys, bands = [], [], []
            for title in batch.column("title"):
                s = shingle_set(title.as_py(), shingle_words, known)
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(min_max_bands(s, odd, shift) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("event_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["event_id", "n_shingles", "set_key", "bands"])

    return articles.select("event_id", "title").mapInArrow(run, schema)


def shingle_sets(articles: DataFrame, shingle_words: int) -> DataFrame:
    """(event_id, shingles): full sets, to confirm links on."""
    schema = f"event_id {articles.schema['event_id'].dataType.simpleString()}, shingles array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle_words, known).view(np.int64) for t in batch.column("title")]
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(sets, pa.list_(pa.int64()))], ["event_id", "shingles"])

    return articles.select("event_id", "title").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): the smallest node each node is connected with.

    Rounds of taking the smallest label of all neighbours, then the label's own label, until
    nothing changes; each round is written to the shared folder."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        after = stored(moved.join(jump, "low").select("node", F.least("low", "further").alias("label"), F.col("label").alias("before")), "labels")
        if after.filter("label <> before").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the similarity of their full sets."""
    one, other = sets.select(F.col("event_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("event_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return (pairs.join(other, "b").join(one, "a").withColumn("common", common)
            .withColumn("union", F.size("sa") + F.size("sb") - F.col("common")).drop("sa", "sb"))


def _between(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of different components in one bucket.

    Blocks of a bucket meet in pairs, so a group is two blocks at most; intersections are
    counted there, on full sets, and only links come out."""
    kind = left.schema["id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rows = (left.join(sets.withColumnRenamed("event_id", "id"), "id").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").drop_duplicates("id")
        ids, labels, own = (group[c].to_numpy() for c in ("id", "label", "own"))
        sizes = group["shingles"].map(len).to_numpy()
        values, places = np.unique(np.concatenate(group["shingles"].to_list()), return_inverse=True)
        # Shingles that one member alone has add to no intersection.
        column = np.cumsum(np.bincount(places) > 1) - 1
        shared = (np.bincount(places) > 1)[places]
        row, col = np.repeat(np.arange(len(ids)), sizes)[shared], column[places][shared]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for begin in range(0, int(col[-1]) + 1 if len(col) else 0, CHUNK):
            lo, hi = np.searchsorted(col, [begin, begin + CHUNK])
            part = np.zeros((len(ids), CHUNK), np.float32)
            part[row[lo:hi], col[lo:hi] - begin] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        fine = 100 * common >= LINK_PERCENT * (sizes[:, None] + sizes[None, :] - common)
        fine &= labels[:, None] != labels[None, :]
        if key[1] != key[2]:
            fine &= own[:, None] != own[None, :]
        x, y = np.nonzero(np.triu(fine, 1))
        return pd.DataFrame({"a": ids[x], "b": ids[y]})

    return rows.select("band", "low", "high", "id", "label", "own", "shingles").groupBy("band", "low", "high").applyInPandas(
        run, f"a {kind}, b {kind}")


def near_duplicates(articles: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Components of articles whose titles are near duplicates.

    Input: ``event_id``, ``title`` (the whole text; other columns are ignored).  Output per
    input row: ``event_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links,
    itself included) and ``kept`` (``event_id = component_id``).

    Texts with one shingle set form one class.  A class is compared with the smallest member
    of every band bucket it falls in; buckets that still hold several components then
    compare members of different components, in pairs of bounded blocks.  Every link is
    confirmed on full sets; no pair that is no link leaves a block.

    A null or empty title, or one without words, has no shingles and stands alone.  Rows
    without an id take part in no link: their component is null, they are kept.  Repeated
    rows get the same component.  An empty table gives an empty result.
    """
    signed = stored(signatures(articles, shingle_words), "signatures")
    classes = stored(
        signed.filter("set_key is not null and event_id is not null").groupBy("set_key")
        .agg(F.min("event_id").alias("id"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "classes")
    banded = classes.select("id", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = stored(banded.join(buckets.drop("members"), "band").select(
        "band", "id", "n", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "bucket-members")
    near_size = lambda x, y: 100 * F.least(x, y) >= LINK_PERCENT * F.greatest(x, y)
    wanted = stored(members.select(F.col("id").alias("event_id")).distinct(), "bucket-ids")
    texts = articles.select("event_id", "title").join(bounded(wanted, 16), "event_id")
    sets = stored(shingle_sets(texts, shingle_words).dropDuplicates(["event_id"]), "shingle-sets")
    stars = (members.filter(F.col("id") != F.col("pivot")).filter(near_size(F.col("n"), F.col("pivot_n")))
             .select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    stars = stored(_linked(stars, sets), "star-pairs")
    link = F.col("common") * 100 >= LINK_PERCENT * F.col("union")
    links = stars.filter(link).select("a", "b")
    labels = components(links)
    placed = members.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = (placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
             .filter("low <> high").select("band", F.ceil(F.col("members") / BLOCK_MEMBERS).alias("blocks")))
    left = stored(placed.join(mixed, "band").select("band", "blocks", "id", "label"), "mixed-members")
    more = stored(_between(left, sets).distinct(), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    rows = signed.select("event_id", "n_shingles", "set_key").join(classes.select("set_key", "id"), "set_key", "left")
    rows = rows.join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    found = F.when(F.col("event_id").isNotNull(), F.coalesce("label", "id", "event_id"))
    return rows.select("event_id", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("event_id") == F.col("component_id"), F.lit(True)))
