"""Quality classifier: histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barlens.llm.common import fold
from barlens.llm.statistics import FEATURES, features, text_statistics
from barlens.session import stored

#: Labelled rows the fit sees at most (chosen by hash of the id): its only bound.
MAX_LABELLED = 20_000
#: Rows of every HELD_OUT-th fold are never learned from.
HELD_OUT = 5
#: A score from here on predicts an accepted article.
ACCEPT = 0.3


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: node k splits ``feature[k]`` at ``cut[k]`` and goes to
    ``left[k]`` or the node after it; a leaf points to itself and adds ``value[k]``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability per row of ``x`` (rows, features)."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.cut[at]
                at = self.left[at] + right * (self.left[at] != at)
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        least: int = 10, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss; splits come from histograms of binned values."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    total = np.full(n, base)
    feature, cut, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0), cut.append(np.inf), left.append(len(left)), value.append(0.0)
        return len(left) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, levels: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if levels and len(rows) >= 2 * least:
            for f in range(width):
                b, size = binned[rows, f], len(edges[f]) + 1
                gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                count = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(count < least) | (len(rows) - count < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            value[at] = float(-rate * gs / (hs + ridge))
            total[rows] += value[at]
            return
        _, f, k = best
        feature[at], cut[at] = f, float(edges[f][k])
        lower, upper = node(), node()
        left[at] = lower
        goes = binned[rows, f] > k
        grow(lower, rows[~goes], g, h, levels - 1)
        grow(upper, rows[goes], g, h, levels - 1)

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        roots.append(node())
        grow(roots[-1], np.arange(n), p - y, p * (1 - p), depth)
    return Forest(*[np.array(a) for a in (roots, feature, cut, left, value)], base, depth)


def _learned(labelled: DataFrame, max_labelled: int) -> Forest:
    sample = (labelled.orderBy(F.xxhash64("event_id"), "event_id").limit(max_labelled)
              .select("accepted", *[f"f_{f}" for f in FEATURES]).toPandas())
    x, y = sample.iloc[:, 1:].to_numpy(float), sample["accepted"].to_numpy(float)
    if len(np.unique(y)) < 2:  # nothing to tell apart
        none = np.zeros(1, int)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Forest(none, none, np.array([np.inf]), none, np.zeros(1), float(np.log(share / (1 - share))), 1)
    return fit(x, y)


def score_articles(articles: DataFrame, judgements: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Probability that an article is accepted.

    ``articles``: ``event_id``, ``title`` (the whole text); ``judgements``: ``event_id``,
    ``accepted`` (0 or 1).  Output per input row: ``event_id``, ``held_out`` (crc32 of the
    id's text modulo 5 is 0), ``score``, ``predicted`` (1 from 0.3 on).  Only statistics of
    the text enter a score.  Trees are fitted on at most ``max_labelled`` judged rows that
    are not held out.

    A null or empty title is scored from zero statistics; a row without an id is scored
    but neither held out nor learned from; an id judged both ways teaches nothing; without
    judgements, or with one kind only, every score is the share of accepted rows (0.5).
    """
    made = stored(features(text_statistics(articles, "event_id"), "event_id"), "text-features")
    held = F.coalesce(fold("event_id", HELD_OUT) == 0, F.lit(False))
    labels = (judgements.filter(F.col("accepted").isin(0, 1) & F.col("event_id").isNotNull())
              .groupBy("event_id").agg(F.min("accepted").alias("accepted"), F.max("accepted").alias("other"))
              .filter((F.col("accepted") == F.col("other")) & (fold("event_id", HELD_OUT) != 0)))
    forest = _learned(made.join(labels, "event_id"), max_labelled)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    value: Column = score(*[f"f_{f}" for f in FEATURES])
    return made.select("event_id", held.alias("held_out"), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= ACCEPT).cast("int"))
