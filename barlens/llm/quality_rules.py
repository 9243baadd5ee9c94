"""Quality rules: learned decision lists over text statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from barlens.llm.common import fold
from barlens.llm.statistics import FEATURES, features, text_statistics
from barlens.session import stored

#: Cuts per feature, conditions per rule, rules per list.
CUTS, CONDITIONS, RULES = 64, 3, 8
#: A rule must reject bad texts with this precision, and at least so many, in the rows kept for pruning.
PRECISION, SUPPORT = 0.9, 5
#: One labelled row in three judges rules that grew on the others.
PRUNE_FOLDS = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self) -> Column:
        return F.col(f"f_{self.feature}") > self.cut if self.above else F.col(f"f_{self.feature}") <= self.cut


def matches(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.holds() for c in rule])


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression: number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(matches(rule), number).otherwise(out)
    return out


def _best(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> tuple[float, Condition, int, int] | None:
    """The condition with the largest information gain, from one pass of counts by bin."""
    counts = (
        rows.select("accepted", F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("bin")) for f in cuts])).alias("x"))
        .groupBy("x.feature", "x.bin").agg(F.sum(1 - F.col("accepted")).alias("bad"), F.sum("accepted").alias("good")).collect())
    best = None
    for feature, edges in cuts.items():
        by_bin = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["feature"] == feature}
        b = g = 0
        for k, edge in enumerate(edges):
            b, g = b + by_bin.get(k, (0, 0))[0], g + by_bin.get(k, (0, 0))[1]
            for above, p, n in ((False, b, g), (True, bad - b, good - g)):
                if p:
                    gain = p * (log2(p / (p + n)) - log2(bad / (bad + good)))
                    if best is None or (gain, p) > (best[0], best[2]):
                        best = (gain, Condition(feature, above, edge), p, n)
    return best if best and best[0] > 0 else None


def learn_rules(labelled: DataFrame) -> list[list[Condition]]:
    """Sequential covering over ``event_id``, ``accepted`` (0 or 1) and the ``f_`` features.

    Each round grows a conjunction of thresholds on two thirds of the labelled rows, by
    information gain over the rows no earlier rule rejects, prunes it from the end on the
    last third, and keeps it if it is precise there.  Every step is one aggregate whose
    result has a row per feature and bin, however many rows are labelled.  Rows without a
    label teach nothing; without bad or without good rows the list is empty.
    """
    rows = labelled.filter(F.col("accepted").isin(0, 1)).withColumn("prune", F.coalesce(fold("event_id", PRUNE_FOLDS) == 0, F.lit(False)))
    found = rows.agg(*[F.percentile_approx(f"f_{f}", [i / CUTS for i in range(CUTS)], 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({float(x) for x in found[f] or []}) for f in FEATURES}
    bins = {f"b_{f}": _bin(F.col(f"f_{f}"), edges) for f, edges in cuts.items()}
    rows = stored(rows.withColumns(bins), "labelled-statistics")
    rules: list[list[Condition]] = []
    while len(rules) < RULES:
        left = rows.filter(verdict(rules).isNull()) if rules else rows
        covered, rule = left.filter(~F.col("prune")), []
        bad, good = covered.agg(F.coalesce(F.sum(1 - F.col("accepted")), F.lit(0)), F.coalesce(F.sum("accepted"), F.lit(0))).first()
        while bad and good and len(rule) < CONDITIONS:
            step = _best(covered, cuts, bad, good)
            if step is None:
                break
            rule.append(step[1])
            bad, good, covered = step[2], step[3], covered.filter(step[1].holds())
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        judged = left.filter("prune").agg(*[
            F.coalesce(F.sum(F.when(matches(h) & (F.col("accepted") == a), 1)), F.lit(0)) for h in heads for a in (0, 1)]).first()
        worth = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k, (p, n) in enumerate(zip(judged[::2], judged[1::2], strict=True))]
        value, k, p, n = max(worth)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(heads[-k])
    return rules


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < value))


def judge_articles(articles: DataFrame, judgements: DataFrame, *keep: str) -> DataFrame:
    """Statistics and verdict of every article.

    ``articles``: ``event_id``, ``title`` (the whole text); ``judgements``: ``event_id``,
    ``accepted`` (1 good, 0 bad).  Output per input row: ``event_id``, the counts,
    ``base_failed`` (under 50 words, or over half of them in repeated 3-word windows),
    ``rule`` (number of the learned rule that rejects it, or null) and ``kept``; the columns
    of ``articles`` named in ``keep`` are passed through.

    A null or empty title has zero counts and fails the base.  Rows without an id get a
    verdict but teach nothing; repeated rows are judged alike; an id judged both ways
    teaches nothing; without judgements only the base rejects.
    """
    counts = stored(text_statistics(articles, "event_id", *keep), "text-statistics")
    labels = (judgements.filter(F.col("accepted").isin(0, 1) & F.col("event_id").isNotNull())
              .groupBy("event_id").agg(F.min("accepted").alias("accepted"), F.max("accepted").alias("other"))
              .filter(F.col("accepted") == F.col("other")).drop("other"))
    rules = learn_rules(features(counts, "event_id").join(labels, "event_id"))
    made = features(counts, *counts.columns).withColumn("rule", verdict(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.select(*counts.columns, failed.alias("base_failed"), "rule", (~failed & F.col("rule").isNull()).alias("kept"))
