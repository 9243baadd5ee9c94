"""Nearest pattern vectors by collision counting over single projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barlens.llm.common import bucket_count
from barlens.session import stored

#: Sorted projections per block, and on how many of them a candidate must collide.
PROJECTIONS, THRESHOLD = 128, 100
#: First half-width of a query's window and its growth, as shares of a projection's spread.
WIDTH, GROWTH = 1.2, 1.25
#: A query stops once so many candidates per wanted neighbour, and this share of the block, passed the threshold.
PER_NEIGHBOUR, CHECKED = 16, 0.05
#: Vectors of one block, queries of one block.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component to 0.5 to 1: no cosine changes, and no square
    overflows or vanishes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, seed: int = 11):
    """Per query the ``k`` best verified candidates of the block: (query, vector, cosine) positions."""
    unit, asked = _unit(vectors), _unit(queries)
    draw, dims = np.random.default_rng(seed), vectors.shape[1]
    # Directions at right angles to each other, a fresh set whenever the dimensions are used up.
    sets = [np.linalg.qr(draw.standard_normal((dims, dims)))[0] for _ in range(-(-PROJECTIONS // dims))]
    lines = np.concatenate(sets, axis=1)[:, :PROJECTIONS]
    values = unit @ lines
    order = np.asfortranarray(np.argsort(values, axis=0, kind="stable"))
    columns = np.asfortranarray(np.take_along_axis(values, order, axis=0))  # one sorted array per projection
    centres = asked @ lines
    spread = np.maximum(values.std(axis=0), 1e-12)
    n = len(ids)
    # Slack keeps equal vectors in each other's narrowest window.
    enough = min(n, max(PER_NEIGHBOUR * (k + 1), int(CHECKED * n)))
    def edges(width: float) -> tuple[np.ndarray, np.ndarray]:
        half = width * spread + 1e-9
        pairs = [(np.searchsorted(columns[:, j], centres[:, j] - half[j], "left"), np.searchsorted(columns[:, j], centres[:, j] + half[j], "right"))
                 for j in range(PROJECTIONS)]
        return tuple(np.stack(side, axis=1) for side in zip(*pairs, strict=True))

    levels: list[tuple[np.ndarray, np.ndarray]] = []
    out = []
    for q in range(len(queries)):
        counts, level = np.zeros(n, np.int64), 0
        while True:
            if level == len(levels):
                levels.append(edges(WIDTH * GROWTH**level))
            lo, hi = levels[level][0][q], levels[level][1][q]
            if level:  # virtual rehashing: only what the wider windows add is counted
                was_lo, was_hi = levels[level - 1][0][q], levels[level - 1][1][q]
                new = [order[a:b, j] for j, (a, b) in enumerate(zip(lo, was_lo, strict=True))] + [order[a:b, j] for j, (a, b) in enumerate(zip(was_hi, hi, strict=True))]
            else:
                new = [order[a:b, j] for j, (a, b) in enumerate(zip(lo, hi, strict=True))]
            counts += np.bincount(np.concatenate(new), minlength=n)
            found = np.flatnonzero(counts >= THRESHOLD)
            if len(found) >= enough or (lo == 0).all() and (hi == n).all():
                break
            level += 1
        found = found[ids[found] != query_ids[q]]
        if not len(found):
            continue
        a, b = vectors[found], queries[q]
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), q), found[best], score[best]))
    return out


def nearest_patterns(patterns: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest patterns of every query by cosine.

    ``patterns`` and ``queries``: ``pattern_id`` (long), ``features`` (array of
    numbers).  Output: ``query_id``, ``rank`` (from 1), ``pattern_id``, ``score``; nearest
    first, ties to the smaller id; a pattern with the query's id is no candidate.

    Every pattern is indexed, in hashed blocks of bounded size: a block holds one sorted
    array per random projection.  A query opens a window around its own projection in
    each array and widens them until enough patterns lie in at least ``THRESHOLD`` windows;
    those are verified with the exact measure, and the best of all blocks are merged.
    Query blocks meet all pattern blocks, so no group grows with the data.

    Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do
    rows without an id, nor vectors of another length than most patterns have (of equally
    frequent lengths the longer counts); finite numbers may be of any size.  Repeated rows are
    candidates each; an empty side gives an empty result.
    """
    def usable(rows: DataFrame) -> DataFrame:
        values = F.col("features").cast("array<double>")
        fine = (F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                & F.exists(values, lambda x: x != 0))
        return rows.filter(F.col("pattern_id").isNotNull() & fine).select(F.col("pattern_id").cast("bigint").alias("pattern_id"), values.alias("features"))

    indexed, asked = stored(usable(patterns), "patterns"), stored(usable(queries), "pattern-queries")
    length = indexed.groupBy(F.size("features").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is not None:
        indexed, asked = (rows.filter(F.size("features") == length["n"]) for rows in (indexed, asked))
    v_blocks, q_blocks = bucket_count(indexed.count(), BLOCK_VECTORS), bucket_count(asked.count(), BLOCK_QUERIES)
    blocks = indexed.withColumn("v", F.pmod(F.xxhash64("pattern_id", F.lit(1)), F.lit(v_blocks))).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    wanted = asked.withColumn("q", F.pmod(F.xxhash64("pattern_id", F.lit(2)), F.lit(q_blocks)).cast("int")).withColumn(
        "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(v_blocks - 1).cast("bigint"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "pattern_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "pattern_id": np.empty(0, np.int64), "score": np.empty(0)})
        ids, query_ids = left["pattern_id"].to_numpy(np.int64), right["pattern_id"].to_numpy(np.int64)
        found = search_block(_scaled(np.stack(left["features"].to_numpy())), ids, _scaled(np.stack(right["features"].to_numpy())), query_ids, k)
        if not found:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "pattern_id": np.empty(0, np.int64), "score": np.empty(0)})
        q, v, score = (np.concatenate(part) for part in zip(*found, strict=True))
        return pd.DataFrame(dict(zip(names, (query_ids[q], ids[v], score), strict=True)))

    best = wanted.groupBy("v", "q").cogroup(blocks.groupBy("v", "q")).applyInPandas(
        lambda right, left: run(left, right), "query_id bigint, pattern_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pattern_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "pattern_id", "score")
