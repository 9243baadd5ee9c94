"""Wilder smoothing as windowed sums: no recursion, no Python, any series length.

With q = 13/14 the recursion y = q*y' + (1-q)*x unrolls to a weighted running
sum.  The weights q**-k overflow near k = 9,500, so the sum restarts in blocks
of ``BLOCK`` rows and every block adds the decayed end of the blocks before it;
two blocks back the remaining weight is q**BLOCK, far below double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERIOD = 14
ALPHA = 1.0 / PERIOD
Q = 13.0 / PERIOD
GROWTH = PERIOD / 13.0
BLOCK = 4000


def wilder(df: DataFrame, keys: list[str], specs: dict[str, tuple[Column, int]], block: int = BLOCK) -> DataFrame:
    """Add one smoothed column per ``{name: (input, seed row)}``.

    ``df`` carries ``i`` (0-based row number of the series) and ``blk`` =
    floor(i / block).  The first value counts in full, the output starts after
    ``PERIOD`` inputs, and inputs must be non-null from the seed row on.
    """
    in_block = Window.partitionBy(*keys, "blk").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.partitionBy(*keys).orderBy("blk")
    i = F.col("i")
    j = i - F.col("blk") * block
    cols = {}
    for name, (value, seed) in specs.items():
        weight = F.when(i == seed, 1.0).otherwise(ALPHA)
        term = F.when(i >= seed, weight * value * F.pow(F.lit(GROWTH), j)).otherwise(0.0)
        cols[f"_{name}"] = F.sum(term).over(in_block) * F.pow(F.lit(Q), j)
    df = df.withColumns(cols)
    ends = {}
    for name in specs:
        end = F.when(j == block - 1, F.col(f"_{name}"))
        ends[f"_{name}_1"] = F.max(end).over(by_block.rangeBetween(-1, -1))
        ends[f"_{name}_2"] = F.max(end).over(by_block.rangeBetween(-2, -2))
    df = df.withColumns(ends)
    out = {}
    for name, (_, seed) in specs.items():
        carried = F.coalesce(F.col(f"_{name}_1"), F.lit(0.0)) + Q**block * F.coalesce(F.col(f"_{name}_2"), F.lit(0.0))
        out[name] = F.when(i >= seed + PERIOD - 1, F.col(f"_{name}") + F.pow(F.lit(Q), j + 1) * carried)
    return df.withColumns(out).drop(*cols, *ends)
