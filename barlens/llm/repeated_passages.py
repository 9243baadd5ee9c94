"""Removal of repeated passages found by sampled fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import bounded
from barlens.session import stored

#: Bytes of a string that makes its other places repeated.
LENGTH = 400
#: Every run of GAP positions holds a sampled one, chosen by the content of SEED bytes.
GAP, SEED = 128, 16
#: Half of the first rank's bytes: a sampled position and twice as many bytes lie in every
#: string of LENGTH bytes that starts up to GAP - 1 before it.
HALF = 128
#: Words of a passage that counts as shared between articles however few bytes it has; every run of
#: WORD_GAP word positions holds a sampled one, chosen by WORD_SEED words.
PASSAGE, WORD_GAP, WORD_SEED = 51, 26, 2
#: Texts and bytes that are named together: arrays of so many numbers stay in a core's cache.
GROUP, GROUP_BYTES = 256, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a byte counts in the names of runs, and in those of seeds.
_BYTES = _spread(np.arange(256, dtype=np.uint64))
_SEED_BYTES = (_BYTES >> np.uint64(32)).astype(np.uint32)


class Ranks:
    """64-bit names of the runs of values (bytes or word names) of one text or several in a row: equal values, equal names."""

    #: Powers of the base and of its inverse, as far as needed up to now.
    _powers, _back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray) -> None:
        n = self.size = len(values)
        if len(Ranks._powers) <= n:
            Ranks._powers, Ranks._back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, x))) for x in (_BASE, _INVERSE))
        x = _BYTES[values] if values.dtype == np.uint8 else _spread(values)
        self.back = Ranks._back[:n + 1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * Ranks._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _spread((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def of_all(self, width: int) -> np.ndarray:
        """Of every run of ``width`` values."""
        n = max(0, self.size - width + 1)
        return _spread((self.sums[width:width + n] - self.sums[:n]) * self.back[:n] + np.uint64(width))


def seed_names(data: np.ndarray) -> np.ndarray:
    """32-bit names of the strings of SEED bytes, a power of two, that tell which positions are sampled."""
    x, width = _SEED_BYTES[data], 1
    while width < SEED:
        x = x[:-width] * np.uint32(0x9E3779B1 + 2 * width) + x[width:]
        width *= 2
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def _rolling(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` over every window of ``width`` values, from windows of half as many."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = take(x[:-step], x[step:])
        done += step
    return x


def sampled(names: np.ndarray, bounds: np.ndarray, gap: int, seed: int, least: int) -> np.ndarray:
    """Positions whose seed name is the smallest of some ``gap`` successive positions of one text.

    Texts are the values between successive ``bounds``; those under ``least`` values have none.
    A seed has ``seed`` values: ``names`` has none for the last ones of all."""
    if len(names) < gap:
        return np.empty(0, np.int64)
    names = np.maximum(names, 1)
    low = _rolling(names, gap, np.minimum)
    for start, end in pairwise(bounds.tolist()):
        # Windows that end in another text or at its border.
        low[start if end - start < least else max(start, end - gap - seed + 2):end] = 0
    # A position has the minimum of some window around it if the largest of their minima is its own.
    around = np.zeros(len(names) + gap - 1, names.dtype)
    around[gap - 1:gap - 1 + len(low)] = low
    return np.flatnonzero(_rolling(around, gap, np.maximum) == names)


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _before(n: int, anchors: np.ndarray) -> np.ndarray:
    """Which string starts have one of ``anchors`` among their first GAP positions."""
    marks = np.zeros(max(0, n - LENGTH + 1) + 1, np.int32)
    if len(marks) > 1:
        np.add.at(marks, np.clip(anchors - GAP + 1, 0, len(marks) - 1), 1)
        np.add.at(marks, np.clip(anchors + 1, 0, len(marks) - 1), -1)
    return np.cumsum(marks)[:-1] > 0


_IN_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, the bytes between successive ``bounds`` (no text is empty)."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = _IN_WORD[data]
    starts, ends = (edge[1:-1] > edge[:-2]), (edge[1:-1] > edge[2:])
    inside = edge[1:-1].view(bool)
    starts[bounds[:-1]] |= inside[bounds[:-1]]
    ends[bounds[1:] - 1] |= inside[bounds[1:] - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_names(ranks: Ranks, data: bytes) -> np.ndarray:
    """64-bit names of the words of a text, from those of its bytes."""
    return ranks.of(*word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)])))


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, bytes and bounds of the texts that can hold a passage, about GROUP_BYTES at a time."""
    for first in range(0, len(batch), GROUP):
        # A passage has two bytes a word at least, but for the last one.
        part = batch.slice(first, GROUP)
        part = part.filter(pc.greater_equal(pc.binary_length(part.column("title")).fill_null(0), 2 * PASSAGE - 1))
        if not len(part):
            continue
        titles = part.column("title").cast(pa.large_binary())
        offsets = np.frombuffer(titles.buffers()[1], np.int64)[titles.offset:titles.offset + len(titles) + 1]
        data = np.frombuffer(titles.buffers()[2], np.uint8)
        at = 0
        while at < len(titles):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
            yield part.column("text_key").slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end
        # What Arrow keeps for later would count beside the executor's heap.
        pa.default_memory_pool().release_unused()


def _positions(articles: DataFrame) -> DataFrame:
    """(text_key, words, pos, back, rank, wide): sampled positions, of bytes and of words.

    Of bytes: the step from the position before, the rank of the pair of 128-byte strings there, and
    the rank of what all strings share that start between the two positions (null where the text
    ends before).  Of words: the ranks of the WORD_GAP words and of the PASSAGE words there (null
    where the text ends before)."""
    names = ["text_key", "words", "pos", "back", "rank", "wide"]

    def rows(keys: pa.Array, words: bool, text: np.ndarray, pos: np.ndarray, back: np.ndarray, rank: np.ndarray, wide: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(text)), pa.array(np.full(len(text), words)), pa.array(pos.astype(np.int32)), pa.array(back.astype(np.int32)),
                                           pa.array(rank.view(np.int64)), pa.array(wide.view(np.int64), mask=none)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data, bounds in _grouped(batch):
                ranks = Ranks(data)
                at = sampled(seed_names(data), bounds, GAP, SEED, LENGTH)
                text = np.searchsorted(bounds, at, "right") - 1
                fits = at + 2 * HALF <= bounds[text + 1]
                at, text = at[fits], text[fits]
                pos = at - bounds[text]
                back = np.minimum(np.where(np.diff(text, prepend=-1) == 0, np.diff(at, prepend=0), pos + 1), GAP)
                rank = _spread(ranks.of(at, at + HALF) ^ _spread(ranks.of(at + HALF, at + 2 * HALF)))
                ends = bounds[text + 1]
                yield rows(keys, False, text, pos, back, rank, ranks.of(at - back + 1, np.minimum(at + LENGTH, ends)), at + LENGTH > ends)
                starts, ends = word_bounds(data, bounds)
                ranks, bounds = Ranks(ranks.of(starts, ends)), np.searchsorted(starts, bounds)
                at = sampled(ranks.of_all(WORD_SEED), bounds, WORD_GAP, WORD_SEED, PASSAGE)
                text = np.searchsorted(bounds, at, "right") - 1
                fits = at + WORD_GAP <= bounds[text + 1]
                at, text = at[fits], text[fits]
                ends = bounds[text + 1]
                yield rows(keys, True, text, at - bounds[text], np.zeros(len(at)), ranks.of(at, at + WORD_GAP), ranks.of(at, np.minimum(at + PASSAGE, ends)), at + PASSAGE > ends)

    return articles.select("text_key", "title").mapInArrow(run, "text_key binary, words boolean, pos int, back int, rank bigint, wide bigint")


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """Values of ``name`` at two places at least; copies of a text are one place."""
    place = F.xxhash64("text_key", "pos")
    return rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select(name)


def _resolved(documents: DataFrame) -> DataFrame:
    """Per text: the starts that are settled as repeated (runs), and the ranks whose places
    must be looked at one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends, ranks = [], [], [], []
            for row in batch.to_pylist():
                places = sorted((p["pos"], p["back"], p["rank"], p["settled"]) for p in row["places"])
                anchors = np.array([p[0] for p in places])
                n = row["n_bytes"]
                settled = np.zeros(max(0, n - LENGTH + 1), bool)
                for pos, back, _, fine in places:
                    if fine:
                        settled[max(0, pos - back + 1):pos + 1] = True
                open_ = np.concatenate([[0], np.cumsum(_before(n, anchors) & ~settled)])
                lo = np.clip(anchors - GAP + 1, 0, len(settled))
                hi = np.clip(anchors + 1, 0, len(settled))
                dirty = open_[hi] > open_[lo]
                a, b = runs_of(settled)
                keys.append(row["text_key"]), starts.append(a.tolist()), ends.append(b.tolist())
                ranks.append([p[2] for p, d in zip(places, dirty.tolist(), strict=True) if d])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, ints), pa.array(ends, ints), pa.array(ranks, pa.list_(pa.int64()))],
                                             ["text_key", "starts", "ends", "ranks"])

    return documents.mapInArrow(run, "text_key binary, starts array<int>, ends array<int>, ranks array<bigint>")


def _strings(texts: DataFrame) -> DataFrame:
    """(name, text, pos): every string of LENGTH bytes that has a named anchor among its first positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row["title"].encode()
                at = np.flatnonzero(_before(len(data), np.array(row["anchors"])))
                names = Ranks(np.frombuffer(data, np.uint8)).of(at, at + LENGTH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(at), row["text"])), pa.array(at.astype(np.int32))], ["name", "text", "pos"])

    return texts.select("text", "title", "anchors").mapInArrow(run, "name bigint, text bigint, pos int")


def _starts(rows: DataFrame) -> DataFrame:
    """(text_key, starts, ends): runs of repeated string starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for row in batch.to_pylist():
                marked = _before(row["n_bytes"], np.array(row["anchors"] or [], np.int64))
                marked[np.array(row["single"] or [], np.int64)] = False
                for a, b in zip(row["starts"], row["ends"], strict=True):
                    marked[a:b] = True
                a, b = runs_of(marked)
                keys.append(row["text_key"]), starts.append(a.tolist()), ends.append(b.tolist())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, ints), pa.array(ends, ints)], ["text_key", "starts", "ends"])

    return rows.mapInArrow(run, "text_key binary, starts array<int>, ends array<int>")


def _word_windows(texts: DataFrame) -> DataFrame:
    """(name, text): every run of PASSAGE words that has a given anchor among its first WORD_GAP positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, title, anchors in zip(batch.column("text"), batch.column("title"), batch.column("anchors"), strict=True):
                data = title.as_py().encode()
                ranks = Ranks(word_names(Ranks(np.frombuffer(data, np.uint8)), data))
                anchors = np.array(anchors.as_py())
                marks = np.zeros(ranks.size - PASSAGE + 2, np.int32)
                np.add.at(marks, np.clip(anchors - WORD_GAP + 1, 0, len(marks) - 1), 1)
                np.add.at(marks, np.clip(anchors + 1, 0, len(marks) - 1), -1)
                at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ranks.of(at, at + PASSAGE).view(np.int64)), pa.array(np.full(len(at), text.as_py()))], ["name", "text"])

    return texts.select("text", "title", "anchors").mapInArrow(run, "name bigint, text bigint")


def _in_two_texts(rows: DataFrame, name: str) -> DataFrame:
    return (rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min("text").alias("x"), F.max("text").alias("y")).filter("x <> y").select(name))


def shared_texts(rows: DataFrame, positions: DataFrame, copied: DataFrame) -> DataFrame:
    """Those texts (``text``: a 64-bit name; ``title``) that hold a passage of PASSAGE words which another row holds too.

    Any such passage has one of the sampled ``positions`` (text, pos, rank, wide) among its first WORD_GAP, followed by WORD_GAP words
    of it.  Texts that share the whole passage from a sampled position on are told at once; those
    that share only the WORD_GAP words are looked at passage by passage, together with their partners.
    Texts in ``copied`` share all they have."""
    wide = stored(_in_two_texts(positions, "wide"), "shared-wide-ranks")
    told = positions.join(bounded(wide, 16), "wide").select("text").union(positions.join(copied, "text", "left_semi").select("text"))
    told = stored(told.distinct(), "shared-texts")
    ranks = stored(_in_two_texts(positions, "rank"), "shared-word-ranks")
    left = stored(positions.join(bounded(ranks, 16), "rank").select("text", "pos", "rank").distinct(), "shared-positions")
    open_ = stored(left.join(bounded(told, 16), "text", "left_anti").select("rank").distinct(), "open-word-ranks")
    anchors = stored(left.join(bounded(open_, 16), "rank").groupBy("text").agg(F.collect_set("pos").alias("anchors")), "open-word-texts")
    texts = rows.join(bounded(anchors.select("text"), 16), "text").groupBy("text").agg(F.any_value("title").alias("title"))
    windows = stored(_word_windows(texts.join(anchors, "text")).distinct(), "word-windows")
    names = stored(_in_two_texts(windows, "name"), "shared-windows")
    return told.union(windows.join(bounded(names, 16), "name").select("text")).distinct()


def repeated_passages(articles: DataFrame) -> DataFrame:
    """Bytes of article titles that lie in a 400-byte string which also starts elsewhere.

    Input: ``event_id``, ``title`` (the whole text, read as UTF-8; other columns are
    ignored).  Output per input row: ``event_id``, ``n_bytes``, ``runs`` (removed byte ranges,
    end exclusive, maximal, in order), ``kept`` (the remaining bytes) and ``shared`` (the title holds a
    passage of 51 words, told apart by white space, that another row's title holds too, be it under
    400 bytes; such a passage is reported, not removed).

    Fingerprints of windows at positions sampled by content, one at least in any 128 in a row
    and the same ones in every copy of a string: pairs of 128-byte ranks at offset 128 are
    hashed and counted, positions with a unique pair drop out; the others are ranked past
    the threshold, over all strings that start since the sampled position before.  What
    that leaves open, at the edges of a repeated passage, is ranked string by string.
    Ranks are 64-bit names, equal for equal bytes.  Copies of a text count as one text
    that is repeated as a whole.

    A null or empty title has no bytes; strings never cross titles; titles under 400 bytes
    lose nothing; rows without an id and repeated rows are treated like any other (a
    repeated row is a copy); an empty table gives an empty result.
    """
    rows = articles.select("event_id", F.coalesce("title", F.lit("")).alias("title")).withColumn("text_key", F.unhex(F.md5(F.col("title").cast("binary"))))
    # A passage has two bytes a word at least, but for the last one.
    sizes = stored(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("title")).alias("n_bytes"))
                   .filter(F.col("n_bytes") >= 2 * PASSAGE - 1), "text-sizes")
    whole = sizes.filter(F.col("n_bytes") >= LENGTH)
    named = F.xxhash64("text_key").alias("text")
    sampled_rows = stored(_positions(rows), "sampled-positions")
    shared = stored(shared_texts(rows.select(named, "title"), sampled_rows.filter("words").select(named, "pos", "rank", "wide"),
                                 sizes.filter("copies > 1").select(named)), "texts-with-shared-passages")
    positions = sampled_rows.filter("not words").drop("words")
    ranks = stored(_repeated(positions, "rank"), "repeated-ranks")
    left = stored(positions.join(bounded(ranks, 16), "rank").distinct(), "repeated-positions")
    wide = stored(_repeated(left, "wide"), "repeated-wide-ranks").withColumn("settled", F.lit(True))
    marked = left.join(bounded(wide, 16), "wide", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    places = marked.groupBy("text_key").agg(F.collect_list(F.struct("pos", "back", "rank", "settled")).alias("places"))
    documents = places.join(whole, "text_key").select("text_key", "n_bytes", "places")
    found = stored(_resolved(documents), "settled-texts")
    dirty = stored(found.select(F.explode("ranks").alias("rank")).distinct(), "open-ranks")
    anchors = stored(left.join(bounded(dirty, 16), "rank").groupBy("text_key").agg(F.sort_array(F.collect_set("pos")).alias("anchors"))
                     .join(whole, "text_key").withColumn("text", F.monotonically_increasing_id()), "open-texts")
    texts = rows.join(bounded(anchors.select("text_key"), 32), "text_key").groupBy("text_key").agg(F.any_value("title").alias("title"))
    strings = _strings(texts.join(anchors, "text_key"))
    single = (strings.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"), F.min("pos").alias("pos")).filter("n = 1")
              .groupBy("text").agg(F.collect_list("pos").alias("single")))
    told = found.join(anchors.select("text_key", "text", "anchors"), "text_key", "left").join(single, "text", "left").join(whole, "text_key")
    starts = stored(_starts(told.select("text_key", "n_bytes", "starts", "ends", "anchors", "single")), "repeated-starts")
    empty = F.array().cast("array<int>")
    # A text with copies is repeated from its first string to its last.
    info = stored(whole.join(starts, "text_key", "left").filter("copies > 1 or size(starts) > 0").select(
        "text_key", F.when(F.col("copies") > 1, F.array(F.lit(0))).otherwise(F.coalesce("starts", empty)).alias("starts"),
        F.when(F.col("copies") > 1, F.array((F.col("n_bytes") - LENGTH + 1).cast("int"))).otherwise(F.coalesce("ends", empty)).alias("ends")), "repeated-texts")
    # Runs of starts cover LENGTH - 1 bytes more; those that then touch become one.
    spans = F.aggregate(
        F.arrays_zip("starts", "ends"), F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["starts"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), (x["ends"] + LENGTH - 1).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(x["starts"].alias("start"), (x["ends"] + LENGTH - 1).alias("end"))))))
    out = rows.join(bounded(info, 200), "text_key", "left").withColumn("runs", F.when(F.col("starts").isNotNull(), spans).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")))
    out = out.withColumn("text", named).join(bounded(shared.withColumn("shared", F.lit(True)), 16), "text", "left")
    data = F.col("title").cast("binary")
    kept = F.aggregate(
        F.concat("runs", F.array(F.struct(F.octet_length("title").alias("start"), F.octet_length("title").alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit(b"").alias("data")),
        lambda done, r: F.struct(r["end"].alias("at"), F.concat(done["data"], F.substring(data, done["at"] + 1, r["start"] - done["at"])).alias("data")))["data"]
    return out.select("event_id", F.octet_length("title").cast("bigint").alias("n_bytes"), "runs",
                      F.when(F.size("runs") > 0, kept).otherwise(data).alias("kept"), F.coalesce("shared", F.lit(False)).alias("shared"))
