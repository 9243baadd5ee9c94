"""Price levels of a bar: flat span-B runs and volume-profile peaks of 140 rows.

Spark windows attach the last 140 values to each row as bounded arrays; a
vectorised Pandas UDF turns Arrow batches of such rows into levels.  The rows
are independent, so the work follows Spark's partitions and never groups.
(The same logic as nested array expressions re-evaluates its inner lambdas per
bin and was measured about twenty times slower.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barlens.operators.indicators import back

DEPTH = 140
BINS = 18
KEEP = 4
RESULT = "flat_levels array<double>, profile_levels array<double>, profile_weights array<double>"


def with_windows(df: DataFrame) -> DataFrame:
    usable = F.coalesce("volume", F.lit(0.0)) > 0
    return df.withColumns({
        "_typical": F.when(usable, (F.col("high") + F.col("low") + F.col("close")) / 3.0),
        "_weight": F.when(usable, F.col("volume")),
    }).withColumns({
        # collect_list skips rows without a value: unused volume, a span not started.
        "_span_b": F.collect_list("cloud_b").over(back(DEPTH)),
        "_prices": F.collect_list("_typical").over(back(DEPTH)),
        "_weights": F.collect_list("_weight").over(back(DEPTH)),
    }).drop("_typical", "_weight")


def _padded(lists: pd.Series) -> np.ndarray:
    sizes = lists.str.len().to_numpy()
    out = np.full((len(lists), DEPTH), np.nan)
    mask = np.arange(DEPTH) < sizes[:, None]
    if mask.any():
        out[mask] = np.concatenate(lists.to_numpy())
    return out


def _pick_spaced(ranked: np.ndarray, far_enough) -> list[np.ndarray]:
    """Greedy pick per row, left to right: far enough from every kept level, at most four."""
    kept = np.full((len(ranked), KEEP), np.nan)
    count = np.zeros(len(ranked), dtype=int)
    for column in range(ranked.shape[1]):
        level = ranked[:, column]
        distance = np.abs(level[:, None] - kept)
        ok = np.isfinite(level) & (count < KEEP) & (np.isnan(distance) | far_enough(distance)).all(axis=1)
        kept[ok, count[ok]] = level[ok]
        count[ok] += 1
    return [np.sort(row[:n]) for row, n in zip(kept, count)]


def _flat(values: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Medians of runs of at least five near-equal values, longest first, then nearest."""
    tolerance = np.maximum(close * 0.0005, 0.005)
    present = np.isfinite(values)
    starts = present.copy()
    with np.errstate(invalid="ignore"):
        starts[:, 1:] &= ~(np.abs(np.diff(values, axis=1)) <= tolerance[:, None])
    row, pos = np.nonzero(present)
    run = np.cumsum(starts[row, pos]) - 1
    length = np.bincount(run) if len(run) else np.zeros(0, dtype=int)
    first = np.nonzero(starts[row, pos])[0]
    candidates: list[list[tuple]] = [[] for _ in range(len(values))]
    flat = values[row, pos]
    for r in np.nonzero(length >= 5)[0]:
        a = first[r]
        level = float(np.median(flat[a:a + length[r]]))
        owner = row[a]
        candidates[owner].append((-length[r], abs(level - close[owner]), a, level))
    width = max((len(c) for c in candidates), default=0)
    ranked = np.full((len(values), max(width, 1)), np.nan)
    for k, c in enumerate(candidates):
        ranked[k, :len(c)] = [x[3] for x in sorted(c)]
    return _pick_spaced(ranked, lambda d: d > tolerance[:, None] * 2)


def _profile(price: np.ndarray, weight: np.ndarray, close: np.ndarray):
    """Volume per equal-width price bin and the centres of the heaviest bins."""
    usable = np.isfinite(price).sum(axis=1)
    low = np.nanmin(np.where(usable[:, None] > 0, price, 0.0), axis=1)
    high = np.nanmax(np.where(usable[:, None] > 0, price, 0.0), axis=1)
    width = np.where(high > low, high - low, 1.0)
    step = width / BINS
    row, pos = np.nonzero(np.isfinite(price))
    p, lo, st = price[row, pos], low[row], step[row]
    b = np.minimum(np.floor((p - lo) / width[row] * BINS), BINS - 1).astype(int)
    # The bin edges decide where the division rounded across one; the last bin is closed.
    down = p < lo + b * st
    up = (p >= lo + (b + 1) * st) & (b != BINS - 1) & ~down
    b = b - down + up
    weights = np.bincount(row * BINS + b, weights=weight[row, pos], minlength=len(price) * BINS).reshape(-1, BINS)
    k = np.arange(BINS)
    centres = ((low[:, None] + k * step[:, None]) + (low[:, None] + (k + 1) * step[:, None])) / 2.0
    # Heaviest first; equal weights go to the higher bin.
    order = np.argsort(weights[:, ::-1] * -1.0, axis=1, kind="stable")
    order = BINS - 1 - order
    ranked = np.take_along_axis(np.where(weights > 0, centres, np.nan), order, axis=1)
    gap = np.maximum(close * 0.01, step)
    picked = _pick_spaced(ranked, lambda d: d >= gap[:, None])
    for r in np.nonzero(high <= low)[0]:
        picked[r] = np.array([low[r]] if low[r] > 0 else [])
    for r in np.nonzero(usable < 20)[0]:
        picked[r] = np.array([])
    return picked, weights


def _batch_levels(span_b: pd.Series, prices: pd.Series, weights: pd.Series, close: pd.Series) -> pd.DataFrame:
    price_now = close.to_numpy(dtype=float)
    profile, binned = _profile(_padded(prices), _padded(weights), price_now)
    return pd.DataFrame({
        "flat_levels": _flat(_padded(span_b), price_now),
        "profile_levels": profile,
        "profile_weights": list(binned),
    })


def add_levels(df: DataFrame) -> DataFrame:
    """Add flat_levels, profile_levels (price order) and the 18 profile weights."""
    levels_udf = F.pandas_udf(_batch_levels, RESULT)
    df = df.withColumn("_levels", levels_udf("_span_b", "_prices", "_weights", "close"))
    return df.select(
        *[c for c in df.columns if c not in ("_span_b", "_prices", "_weights", "_levels")], "_levels.*"
    )
