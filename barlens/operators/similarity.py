"""Nearest earlier patterns of a bar, without look-ahead.

Candidates share the symbol and all five states and lie at least ten rows back.
Spark brings one (symbol, states) series to a task (at most one row per
session); a numpy helper ranks its history for each decision row, and Spark
aggregates the chosen neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.indicators import FEATURES, KEYS, series, STATES

HORIZON = 10
NEIGHBORS = 30
MIN_HISTORY = 25
COLUMNS = [f"f_{name}" for name in FEATURES]
GROUP = [*KEYS, *STATES]
NEIGHBOR_SCHEMA = (
    "market string, symbol string, i int, neighbor_i int, distance double, "
    "pattern_return_pct double, pattern_hit boolean"
)


def _complete() -> Column:
    ok = F.lit(True)
    for c in COLUMNS:
        ok = ok & F.col(c).isNotNull()
    return ok


def with_candidates(frame: DataFrame) -> DataFrame:
    """Add history_count (usable rows ten back) and candidate_count (same states too).

    Two running counts; no pair of rows is formed.
    """
    usable = _complete() & F.col("pattern_return_pct").isNotNull()
    frame = frame.withColumns({"_complete": _complete(), "_usable": usable})
    same = Window.partitionBy(*GROUP).orderBy("i").rangeBetween(Window.unboundedPreceding, -HORIZON)
    return frame.withColumns({
        "history_count": F.count(F.when(F.col("_usable"), 1)).over(
            series().rowsBetween(Window.unboundedPreceding, -HORIZON)),
        "candidate_count": F.count(F.when(F.col("_usable"), 1)).over(same),
    })


def robust_scale(history: np.ndarray) -> np.ndarray:
    """1.4826 x median absolute deviation, else population deviation, else 1, per feature."""
    mad = np.median(np.abs(history - np.median(history, axis=0)), axis=0) * 1.4826
    scale = np.where(mad > 1e-8, mad, history.std(axis=0))
    return np.where(scale > 1e-8, scale, 1.0)


class Expanding:
    """Robust scale of a history that grows row by row.

    Each feature's values stay sorted, so the median is read off, and the median deviation from it is found by
    halving: the values nearest to the median are a stretch of the sorted ones.  A decision costs the logarithm of
    its history instead of a sort of it.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, 0
        self.ordered = np.empty((rows.shape[1], len(rows)))

    def grow(self, n: int) -> None:
        """Take in the rows up to ``n``."""
        for row in self.rows[self.n:n]:
            for values, x in zip(self.ordered, row, strict=True):
                at = int(np.searchsorted(values[:self.n], x))
                values[at + 1:self.n + 1] = values[at:self.n]
                values[at] = x
            self.n += 1

    def _deviation(self, median: np.ndarray, k: int) -> np.ndarray:
        """The k-th smallest deviation from the median, per feature."""
        every = np.arange(len(median))
        low, high = np.zeros(len(median), int), np.full(len(median), self.n - k)
        while (low < high).any():
            middle = (low + high) // 2
            move = (low < high) & (median - self.ordered[every, middle] > self.ordered[every, np.minimum(middle + k, self.n - 1)] - median)
            low, high = np.where(move, middle + 1, low), np.where(move | (low >= high), high, middle)
        return np.maximum(median - self.ordered[every, low], self.ordered[every, low + k - 1] - median)

    def scale(self) -> np.ndarray:
        """As ``robust_scale`` of the rows taken in."""
        n = self.n
        median = (self.ordered[:, (n - 1) // 2] + self.ordered[:, n // 2]) / 2
        upper = self._deviation(median, n // 2 + 1)
        mad = (upper if n % 2 else (self._deviation(median, n // 2) + upper) / 2) * 1.4826
        flat = ~(mad > 1e-8)
        if flat.any():
            mad[flat] = self.rows[:n, flat].std(axis=0)
        return np.where(mad > 1e-8, mad, 1.0)


def purged(order: np.ndarray, positions: np.ndarray, limit: int, embargo: int = HORIZON) -> list[int]:
    """Indices kept in order, each more than ``embargo`` rows from every kept one."""
    kept: list[int] = []
    blocked = np.zeros(int(positions.max()) + embargo + 2, dtype=bool)
    for k in order:
        p = int(positions[k])
        if blocked[p]:
            continue
        kept.append(int(k))
        blocked[max(0, p - embargo):p + embargo + 1] = True
        if len(kept) >= limit:
            break
    return kept


def _nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    rows = pdf["i"].to_numpy()
    x = pdf[COLUMNS].to_numpy(dtype=float)
    usable = pdf["_usable"].to_numpy(dtype=bool)
    hist_rows, hist_x = rows[usable], x[usable]
    out_i, out_k, out_d = [], [], []
    seen = Expanding(hist_x)
    for at in np.nonzero(pdf["_decide"].to_numpy(dtype=bool))[0]:
        n = int(np.searchsorted(hist_rows, rows[at] - HORIZON, side="right"))
        if n == 0:
            continue
        history = hist_x[:n]
        seen.grow(n)
        difference = np.abs((history - x[at]) / seen.scale())
        largest = difference.max(axis=1)
        # A taken row keeps at most 2 * HORIZON others out, so rows beyond that many times the limit are never asked.
        most = (2 * HORIZON + 1) * max(10, NEIGHBORS)
        near = np.arange(n) if n <= most else np.flatnonzero(largest <= np.partition(largest, most - 1)[most - 1])
        order = near[np.lexsort((difference[near].mean(axis=1), largest[near]))]
        kept = purged(order, hist_rows[:n], min(max(10, NEIGHBORS), n))
        out_i.extend([rows[at]] * len(kept))
        out_k.extend(kept)
        out_d.extend(largest[kept])
    hist = pdf[usable]
    k = np.array(out_k, dtype=int)
    return pd.DataFrame({
        "market": pdf["market"].iloc[0], "symbol": pdf["symbol"].iloc[0],
        "i": np.array(out_i, dtype="int32"), "neighbor_i": hist_rows[k].astype("int32"),
        "distance": np.array(out_d, dtype=float),
        "pattern_return_pct": hist["pattern_return_pct"].to_numpy(dtype=float)[k],
        "pattern_hit": hist["pattern_hit"].astype(bool).to_numpy()[k],
    })


def neighbors(frame: DataFrame, decide: Column) -> DataFrame:
    """Chosen neighbours (at most 30) of the rows where ``decide`` holds.

    ``frame`` comes from ``with_candidates``.
    """
    wanted = decide & F.col("_complete") & (F.col("history_count") >= MIN_HISTORY) & (F.col("candidate_count") > 0)
    rows = frame.withColumn("_decide", wanted).filter(F.col("_usable") | F.col("_decide"))
    rows = rows.select(*GROUP, "i", *COLUMNS, "pattern_return_pct", "pattern_hit", "_usable", "_decide")
    return rows.groupBy(*GROUP).applyInPandas(_nearest, NEIGHBOR_SCHEMA)


def _scales(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    rows, usable = pdf["i"].to_numpy(), pdf["_usable"].to_numpy(dtype=bool)
    hist_rows, hist_x = rows[usable], pdf.loc[usable, COLUMNS].to_numpy(dtype=float)
    out, seen = [], Expanding(hist_x)
    for at in np.nonzero(pdf["_decide"].to_numpy(dtype=bool))[0]:
        n = int(np.searchsorted(hist_rows, rows[at] - HORIZON, side="right"))
        if n:
            seen.grow(n)
            out.extend((pdf["session_date"].iloc[at], f, n, x) for f, x in zip(FEATURES, seen.scale(), strict=True))
    made = pd.DataFrame(out, columns=["session_date", "feature", "candidates", "scale"])
    return made.assign(market=pdf["market"].iloc[0], symbol=pdf["symbol"].iloc[0])


def decision_scales(frame: DataFrame, decide: Column) -> DataFrame:
    """Robust scale per feature of the candidates of each row where ``decide`` holds and
    there are any (``frame`` from ``with_candidates``)."""
    rows = frame.withColumn("_decide", decide).filter(F.col("_usable") | F.col("_decide"))
    rows = rows.select(*GROUP, "i", "session_date", *COLUMNS, "_usable", "_decide")
    return rows.groupBy(*GROUP).applyInPandas(
        _scales, "market string, symbol string, session_date date, feature string, candidates bigint, scale double")


def summarise(chosen: DataFrame) -> DataFrame:
    """Outcome summary of each decision row's neighbours (at most 30 rows per group)."""
    ret = F.col("pattern_return_pct")
    up = ret > 0
    g = chosen.groupBy(*KEYS, "i").agg(
        F.count(F.lit(1)).cast("int").alias("sample_count"),
        F.count_if(up).cast("int").alias("up_count"),
        F.median(ret).alias("median_return_pct"),
        F.min("distance").alias("nearest_distance"),
        F.avg(F.when(up, ret)).alias("average_up_return_pct"),
        F.avg(F.when(~up, ret)).alias("average_down_return_pct"),
        F.count_if(F.col("pattern_hit")).cast("int").alias("invalidation_count"),
        F.avg(ret).alias("expected_return_pct"),
        F.percentile(ret, F.lit(0.25)).alias("downside_p25_pct"),
        F.sort_array(F.collect_list(F.struct(F.col("neighbor_i").alias("k"), ret.alias("r"))), asc=False).alias("_newest"),
    )
    n = F.col("sample_count")
    recent = F.slice("_newest", F.lit(1), F.greatest(F.lit(1), F.ceil(n * 0.25).cast("int")))
    g = g.withColumns({
        "up_rate": F.col("up_count") / n * 100.0,
        "recent_sample_count": F.size(recent),
        "recent_up_count": F.size(F.filter(recent, lambda x: x["r"] > 0)),
        "invalidation_rate": F.col("invalidation_count") / n * 100.0,
        "payoff_ratio": F.col("average_up_return_pct")
        / F.abs(F.nullif(F.col("average_down_return_pct"), F.lit(0.0))),
    })
    g = g.withColumn("recent_up_rate", F.col("recent_up_count") / F.col("recent_sample_count") * 100.0)
    status = (
        F.when(n < 15, "small_sample").when(n < MIN_HISTORY, "caution")
        .when((F.col("up_rate") >= 65) & (F.col("recent_up_rate") >= 50), "favourable")
        .when(F.col("up_rate") < 45, "unfavourable").otherwise("no_edge")
    )
    return g.withColumn("similarity_status", status).drop("_newest")


def with_similarity(frame: DataFrame, decide: Column) -> DataFrame:
    """Decision rows with their 18-field pattern summary (``frame`` from ``with_candidates``)."""
    summary = summarise(neighbors(frame, decide))
    df = frame.filter(decide).join(summary, [*KEYS, "i"], "left")
    ready = F.col("_complete") & (F.col("history_count") >= MIN_HISTORY)
    status = F.when(~ready, "too_little_history").otherwise(F.coalesce("similarity_status", F.lit("no_match")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in (
        "sample_count", "up_count", "recent_sample_count", "recent_up_count", "invalidation_count")}
    return df.withColumns({**zero, "similarity_status": status}).drop("_complete", "_usable")
