"""Hard negatives of pattern rows by zone maps over Hilbert-ordered blocks.

Candidates are stored as Parquet in the order of a Hilbert curve through their most varied features, in blocks of
``BLOCK`` rows; a zone map holds every feature's least and greatest value in a block, and its labels.  A window
(an anchor, a score interval, same or other label) gets its first floor from the anchor's own block.  Interval
arithmetic then bounds the scores that a block can hold, and only blocks that may reach into some window of a chunk
of anchors are joined with it.  Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barlens.llm.common import in_order
from barlens.operators.similarity import COLUMNS
from barlens.session import stored

#: Rows of a candidate block, anchors of a chunk, blocks of a page of the zone map.
BLOCK, CHUNK, PAGE = 2048, 1024, 1024
#: Curve: so many features, so many bits each.
AXES, BITS = 8, 7
#: Features beyond this (after scaling) do not fit the exact scores.
LIMIT = 1 << 26


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below 2**bits (Skilling's transform, vectorised)."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in doubles where every partial sum is exact there."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _moments(dims: int) -> Callable:
    def run(batches):
        n, sums, squares = 0, np.zeros(dims), np.zeros(dims)
        for rows in batches:
            v = _matrix(rows["v"], dims).astype(np.float64)
            n, sums, squares = n + len(v), sums + v.sum(axis=0), squares + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n] * dims, "axis": list(range(dims)), "s": list(sums), "q": list(squares)})
    return run


def _with_curve(rows: DataFrame, dims: int) -> DataFrame:
    """Add ``hilbert``: the place along a curve through the features that vary most, over the middle six deviations."""
    moments = rows.select("v").mapInArrow(_moments(dims), "n bigint, axis bigint, s double, q double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    axes = moments.filter("n > 0").select("axis", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("spread"))
    picked = axes.orderBy(F.desc("spread"), "axis").limit(AXES).collect()
    use = np.array([r["axis"] for r in picked], int)
    low = np.array([r["mean"] - 3 * r["spread"] for r in picked])
    step = np.array([max(6 * r["spread"], 1.0) for r in picked]) / (1 << BITS)

    def run(batches):
        for b in batches:
            v = _matrix(b["v"], dims)[:, use]
            place = hilbert_index(np.clip((v - low) / step, 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield b.append_column("hilbert", pa.array(place, pa.int64()))

    schema = StructType([*rows.schema.fields, StructField("hilbert", LongType())])
    return rows.mapInArrow(run, schema) if len(use) else rows.withColumn("hilbert", F.lit(0).cast("bigint"))


def _key_order(keys: list[dict]) -> np.ndarray:
    """Rank of each key within the block, nulls last; scores tie by it."""
    order = sorted(range(len(keys)), key=lambda j: [(v is None, v) if v is not None else (True, 0) for v in keys[j].values()])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return rank


def _ends(windows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return (np.array([least if w["low"] is None else w["low"] for w in windows], np.int64), np.array([most if w["high"] is None else w["high"] for w in windows], np.int64))


def _best(anchors: pa.Table, block: pa.Table, dims: int, k: int, same: bool):
    """(anchor row, window, score, block row) of the first ``k`` of every window in the block."""
    scores = _products(_matrix(anchors["v"], dims), _matrix(block["v"], dims))
    labels, own, at = np.array(block["label"].to_pylist(), object), block["at"].to_numpy(), anchors["anchor"].to_numpy()
    rank = None
    for i, (label, windows) in enumerate(zip(anchors["label"].to_pylist(), anchors["windows"].to_pylist(), strict=True)):
        usable = ((labels == label) if same else (labels != label)) & (own != at[i])
        lows, highs = _ends(windows)
        for w, low, high in zip(windows, lows, highs, strict=True):
            rows = np.flatnonzero(usable & (scores[i] >= low) & (scores[i] <= high))
            if len(rows) > k:
                cut = np.partition(scores[i][rows], len(rows) - k)[len(rows) - k]
                rows = rows[scores[i][rows] >= cut]
            if not len(rows):
                continue
            if rank is None:
                rank = _key_order(block["key"].to_pylist())
            for j in rows[np.lexsort((rank[rows], -scores[i][rows]))][:k]:
                yield i, w["window"], int(scores[i][j]), int(j)


_WINDOWS = pa.list_(pa.struct([("window", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))


def _seed(dims: int, k: int, same: bool) -> Callable:
    """Raise the floor of every window to the k-th score that the anchor's own block has for it."""
    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        found: dict[tuple, list[int]] = {}
        for i, window, score, _ in _best(anchors, block, dims, k, same):
            found.setdefault((i, window), []).append(score)
        windows = [[w | {"low": found[i, w["window"]][-1]} if len(found.get((i, w["window"]), ())) == k else w for w in ws] for i, ws in enumerate(anchors["windows"].to_pylist())]
        return anchors.drop_columns(["block", "windows"]).append_column("windows", pa.array(windows, _WINDOWS))
    return run


def _reached(dims: int, same: bool) -> Callable:
    """Blocks of a page whose bounds reach into a window of the chunk."""
    def run(key: tuple, anchors: pa.Table, zones: pa.Table) -> pa.Table:
        need = np.zeros(len(zones), bool)
        if len(anchors) and len(zones):
            v, lo, hi = (_matrix(c, dims).astype(np.float64) for c in (anchors["v"], zones["least"], zones["most"]))
            up, down = np.maximum(v, 0), np.minimum(v, 0)
            top, bottom = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
            slack = 1e-9 * (np.abs(top) + np.abs(bottom)) + 0.5
            held = zones["labels"].to_pylist()
            for i, (label, windows) in enumerate(zip(anchors["label"].to_pylist(), anchors["windows"].to_pylist(), strict=True)):
                fits = np.array([label in x if same else len(x) > 1 or label not in x for x in held])
                for w in windows:
                    ok = fits if w["low"] is None else fits & (top[i] + slack[i] >= w["low"])
                    need |= ok if w["high"] is None else ok & (bottom[i] - slack[i] <= w["high"])
        chunk = key[0].as_py()
        blocks = zones["block"].to_numpy()[need]
        return pa.table({"chunk": pa.array([chunk] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64())})
    return run


def search(candidates: DataFrame, zones: DataFrame, anchors: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """First ``k`` candidates of every window: anchor, window, rank, key, score.

    ``anchors`` has chunk, anchor, label, v and windows (array of window, low, high; null: open)."""
    label_type, key_type = dict(candidates.dtypes)["label"], dict(candidates.dtypes)["key"]
    shape = f"chunk bigint, anchor bigint, label {label_type}, v array<int>, windows array<struct<window:int,low:bigint,high:bigint>>"
    own = anchors.withColumn("block", F.expr(f"anchor div {BLOCK}")).groupBy("block").cogroup(candidates.groupBy("block"))
    seeded = stored(own.applyInArrow(_seed(dims, k, same), shape), "anchors-seeded")
    pages = max(1, -(-zones.count() // PAGE))
    page = F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int")
    chunks = seeded.select(F.col("chunk").alias("chunk")).distinct().withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    near = zones.withColumn("page", page).join(chunks, "page").groupBy("chunk", "page")
    asked = seeded.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).groupBy("chunk", "page")
    needed = stored(asked.cogroup(near).applyInArrow(_reached(dims, same), "chunk bigint, block bigint"), "blocks-reached")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_best(left, right, dims, k, same))
        i, window, score, j = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pa.table({"anchor": left["anchor"].take(pa.array(i, pa.int64())), "window": pa.array(window, pa.int32()), "score": pa.array(score, pa.int64()), "key": right["key"].take(pa.array(j, pa.int64()))})

    read = candidates.join(needed, "block").groupBy("chunk", "block")
    sides = seeded.join(needed.select(F.col("chunk").alias("chunk"), F.col("block").alias("block")), "chunk").groupBy("chunk", "block")
    found = sides.cogroup(read).applyInArrow(run, f"anchor bigint, window int, score bigint, key {key_type}")
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), *[F.asc_nulls_last(f"key.{c}") for c in candidates.schema["key"].dataType.names])
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    patterns: DataFrame, anchors: Column, key: Sequence[str] = ("market", "symbol", "session_date"), label: str = "pattern_hit",
    features: str | Sequence[str] = tuple(COLUMNS), scale: int = 256, positives: int = 5, negatives: int = 5, at_least: int = 80,
) -> DataFrame:
    """Patterns of another label that score nearly as high as an anchor's best patterns of its own label.

    ``patterns``: pattern rows told apart by the ``key`` columns, with their ``features`` (columns, or one array
    column) and ``label``.  A feature x counts as the integer floor(scale * x); two patterns score their integer
    inner product, higher first, equal ones by the key (ascending, nulls last).  ``anchors`` is a condition over the
    columns of ``patterns``.  Positives are an anchor's first other rows of its label.  For each of them come the
    first rows of other labels with at_least * positive score <= 100 * score <= 100 * positive score.

    Result: anchor, positive, negative (structs of the key columns), rank (int from 1 among the negatives of that
    positive), positive_score, negative_score (long).  A row takes no part if its label or features are null, if a
    feature is null, not finite or beyond 2**26 after scaling, or if it has another number of features than most
    rows (of equally frequent numbers the larger).  Repeated rows are rows of their own, as anchors too.  Empty
    tables and no anchors give no rows; other columns are ignored.
    """
    vector = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    rows = patterns.select(F.struct(*key).alias("key"), F.col(label).alias("label"), vector.alias("x"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    fits = F.forall("x", lambda x: F.coalesce(F.abs(x * scale) <= LIMIT, F.lit(False)))
    rows = rows.filter(F.col("label").isNotNull() & F.coalesce(fits, F.lit(False)) & (F.size("x") > 0))
    rows = stored(rows.withColumn("v", F.transform("x", lambda x: F.floor(x * scale).cast("int"))).drop("x"), "pattern-rows")
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 1
    rows = rows.filter(F.size("v") == dims)
    candidates = in_order(_with_curve(rows, dims), ["hilbert", "key"], "pattern-candidates").withColumn("block", F.expr(f"at div {BLOCK}"))
    by_axis = candidates.select("block", F.posexplode("v").alias("axis", "value")).groupBy("block", "axis").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    in_axis = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("axis", c))), lambda s: s[c]).alias(c)
    zones = by_axis.groupBy("block").agg(in_axis("least"), in_axis("most"))
    zones = stored(zones.join(candidates.groupBy("block").agg(F.collect_set("label").alias("labels")), "block"), "pattern-zones")
    wanted = in_order(candidates.filter("is_anchor").select(F.col("at").alias("anchor"), "label", "v"), ["anchor"], "pattern-anchors", "number")
    wanted = wanted.select(F.expr(f"number div {CHUNK}").alias("chunk"), "anchor", "label", "v")
    bound = F.lit(None).cast("bigint")
    everything = F.array(F.struct(F.lit(0).alias("window"), bound.alias("low"), bound.alias("high")))
    candidates = candidates.select("at", "block", "key", "label", "v")
    own = stored(search(candidates, zones, wanted.withColumn("windows", everything), dims, positives, True), "pattern-positives")
    low = F.col("score") * at_least
    least = F.expr(f"(score * {at_least}) div 100") + F.when((low > 0) & (low % 100 != 0), 1).otherwise(0)
    windows = own.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("window"), least.alias("low"), F.col("score").alias("high"))).alias("windows"))
    found = search(candidates, zones, wanted.join(windows, "anchor"), dims, negatives, False)
    positive = own.select("anchor", F.col("rank").alias("window"), F.col("key").alias("positive"), F.col("score").alias("positive_score"))
    keys = candidates.join(wanted.select(F.col("anchor").alias("at")), "at").select(F.col("at").alias("anchor"), F.col("key").alias("of_anchor"))
    out = found.select("anchor", "window", "rank", F.col("key").alias("negative"), F.col("score").alias("negative_score")).join(positive, ["anchor", "window"]).join(keys, "anchor")
    return out.select(F.col("of_anchor").alias("anchor"), "positive", "rank", "negative", "positive_score", "negative_score")
