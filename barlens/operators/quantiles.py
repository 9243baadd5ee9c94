"""Exact order statistics by radix selection, without bringing a group into one task.

``percentile``/``median`` keep every distinct value of a group in one hash map and a rank window sorts the group in
one task; neither survives a group of billions.  A double's bits, read as a signed integer, order like the doubles
themselves, so a wanted rank is found digit by digit: rows are counted by their leading digit (combined map-side), the
digit that holds the rank is kept, and only rows with that digit are counted by their next one.  Three digits of
at most 23 bits settle a rank whatever the values; what one task sorts are the counts of one digit, at most 2**23 rows.

Groups may be any number of any columns, null included.  The places found so far are broadcast while their counted
rows are few; beyond that the passes are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.session import cut

#: Bits below the first digit, and below the second.
FIRST, SECOND = 46, 23
#: So many located places (a few numbers each) may be broadcast.
MOST_BROADCAST = 1 << 16


def ordered_image(v: Column) -> Column:
    """The double's bits as a long that orders like it; both zeros are 0, NaN comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("bigint")
    # Below zero the bits without the sign count downwards; -0.0 + 0.0 is 0.0.
    return F.when(F.isnan(v) | (v >= 0), bits).otherwise(-bits.bitwiseAND((1 << 63) - 1))


def _digits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(g, v, d1, d2, d3) of all values; ``g`` is the group as a struct, whose nulls are equal."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()).withColumn("image", ordered_image(F.col("v")))
    low = (1 << SECOND) - 1
    return rows.select("g", "v", F.shiftright("image", FIRST).alias("d1"), F.shiftright("image", SECOND).bitwiseAND(low).alias("d2"), F.col("image").bitwiseAND(low).alias("d3"))


def _at(places: DataFrame) -> DataFrame:
    return F.broadcast(places) if places.count() <= MOST_BROADCAST else places


def _within(counts: DataFrame, on: list[str], digit: str, wanted: Column, carry: list[str]) -> DataFrame:
    """The digits that hold wanted ranks: ``wanted`` is an array of (rank, rest), rest counted within ``on``."""
    upto = Window.partitionBy(*on).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
    inside = F.filter(wanted, lambda w: (w["rest"] >= F.col("before")) & (w["rest"] < F.col("before") + F.col("c")))
    rows = rows.withColumn("wanted", F.transform(inside, lambda w: F.struct(w["rank"].alias("rank"), (w["rest"] - F.col("before")).alias("rest")))).filter(F.size("wanted") > 0)
    return rows.select(*on, digit, "wanted", *carry)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a linearly interpolated quantile per name in ``probs``; groups without a value have none.

    Three passes over the input (keep it persisted), each a map-side combined count.
    """
    rows = _digits(df, keys, value)
    spots = [(F.col("n") - 1) * p for p in probs.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(s).cast("bigint"), F.ceil(s).cast("bigint")) for s in spots])))
    counts = rows.groupBy("g", "d1").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy("g")))
    every = F.transform(ranks, lambda k: F.struct(k.alias("rank"), k.alias("rest")))
    places = cut(_within(counts, ["g"], "d1", every, ["n"]))
    counts = rows.join(_at(places), ["g", "d1"]).groupBy("g", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("wanted").alias("asked"))
    places = cut(_within(counts, ["g", "d1"], "d2", F.col("asked"), ["n"]))
    counts = rows.join(_at(places), ["g", "d1", "d2"]).groupBy("g", "d1", "d2", "d3").agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("v"), F.first("n").alias("n"), F.first("wanted").alias("asked"))
    found = _within(counts, ["g", "d1", "d2"], "d3", F.col("asked"), ["n", "v"])
    found = found.select("g", "n", F.explode(F.transform("wanted", lambda w: w["rank"])).alias("rank"), "v")
    found = found.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = []
    for (name, _), s in zip(probs.items(), spots, strict=True):
        low, high = (F.element_at("at", f(s).cast("bigint")) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * (s - F.floor(s))).alias(name))
    return found.select(*[F.col(f"g.{k}").alias(k) for k in keys], *out)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(v, rank): average rank of every distinct value over the whole input.

    Ranks add up from the counts of the first digit (at most 2**18 rows) and, within it, of the values.
    """
    rows = _digits(df, [], value)
    values = rows.groupBy("d1", "d2", "d3").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
    inner = Window.partitionBy("d1").orderBy("d2", "d3").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.sum("c").over(inner))
    cells = rows.groupBy("d1").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy(F.lit(1)).orderBy("d1").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("d1", (F.sum("c").over(over) - F.col("c")).alias("before"))
    first = F.col("before") + F.col("_upto") - F.col("c")
    return values.join(cells, "d1").select("v", (first + (F.col("c") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row (n, spearman): Pearson correlation of average ranks over all rows.

    Pairs are combined before the rank joins, so repeated values do not travel.
    Null with fewer than three pairs or a constant side.
    """
    pairs = df.select(F.col(left).cast("double").alias("x"), F.col(right).cast("double").alias("y")).dropna()
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    rx = average_ranks(pairs, "x").select(F.col("v").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(pairs, "y").select(F.col("v").alias("y"), F.col("rank").alias("ry"))
    joined = counted.join(rx, "x").join(ry, "y")
    c, x, y = F.col("c"), F.col("rx"), F.col("ry")
    m = joined.agg(
        F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"),
        F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"), F.sum(c * x * y).alias("xy"),
    )
    n = F.col("n")
    vx = F.col("xx") - F.col("sx") * F.col("sx") / n
    vy = F.col("yy") - F.col("sy") * F.col("sy") / n
    cov = F.col("xy") - F.col("sx") * F.col("sy") / n
    return m.select("n", F.when((n >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("spearman"))
