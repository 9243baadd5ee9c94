"""What happened after a decision: future rows are touched here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.indicators import KEYS, MIN_BARS, series

HORIZONS = (1, 5, 10, 20)
PRICES = ("open", "high", "low", "close")


def price_views(bars: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(signal bars, outcome bars, policy): raw prices signal, adjusted prices pay."""
    raw = all(f"raw_{c}" in bars.columns for c in PRICES)
    adjusted = all(f"adjusted_{c}" in bars.columns for c in PRICES)

    def view(prefix: str, present: bool, amounts: tuple[str, ...]) -> DataFrame:
        swap = {c: F.col(f"{prefix}_{c}") for c in PRICES} if present else {}
        swap |= {c: F.col(f"{prefix}_{c}") for c in amounts if present and f"{prefix}_{c}" in bars.columns}
        plain = [c for c in bars.columns if not c.startswith(("raw_", "adjusted_", "adjustment_"))]
        return bars.select(*[swap.get(c, F.col(c)).alias(c) for c in plain])

    policy = "raw_for_signal_adjusted_for_outcome" if raw and adjusted else "single_price_series_unverified"
    return view("raw", raw, ("volume", "trade_value")), view("adjusted", adjusted, ("volume",)), policy


def drawdown(entry: Column, closes: Column) -> Column:
    """Deepest fall from the running peak along entry and the closes, in percent."""
    start = F.struct(entry.alias("peak"), F.lit(0.0).alias("worst"))
    return F.aggregate(
        closes, start,
        lambda acc, c: F.struct(
            F.greatest(acc["peak"], c).alias("peak"),
            F.least(acc["worst"], (c / F.greatest(acc["peak"], c) - 1.0) * 100.0).alias("worst"),
        ),
        lambda acc: acc["worst"],
    )


def decision_grid(numbered: DataFrame, step: int = 1, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add ``on_grid``: row 79 onward, every ``step`` rows, the longest horizon still ahead."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    i = F.col("i")
    grid = (i >= MIN_BARS - 1) & ((i - (MIN_BARS - 1)) % step == 0) & (i <= n - 1 - max(horizons))
    return numbered.withColumn("on_grid", grid)


def forward_paths(numbered: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add ``paths``: one struct per horizon, from the rows after each row."""
    df = numbered.withColumn("_entry", F.lead("open", 1).over(series()))
    longest = max(horizons)
    df = df.withColumn("_closes", F.collect_list("close").over(series().rowsBetween(1, longest)))
    cols = {}
    for h in horizons:
        ahead = series().rowsBetween(1, h)
        cols[f"_exit_{h}"] = F.lead("close", h).over(series())
        cols[f"_low_{h}"] = F.min("low").over(ahead)
        cols[f"_high_{h}"] = F.max("high").over(ahead)
    df = df.withColumns(cols)
    entry = F.col("_entry")
    paths = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"), entry.alias("entry_price"), F.col(f"_exit_{h}").alias("exit_price"),
            ((F.col(f"_exit_{h}") / entry - 1.0) * 100.0).alias("forward_return_pct"),
            ((F.col(f"_low_{h}") / entry - 1.0) * 100.0).alias("mae_pct"),
            ((F.col(f"_high_{h}") / entry - 1.0) * 100.0).alias("mfe_pct"),
            drawdown(entry, F.slice("_closes", 1, h)).alias("max_drawdown_pct"),
            F.col(f"_low_{h}").alias("path_low"),
        )
        for h in horizons
    ])
    return df.withColumn("paths", paths).drop("_entry", "_closes", *cols)


def outcomes(signals: DataFrame, invalidation: str, large_loss_pct: float = -10.0,
             signal_lows: str | None = None) -> DataFrame:
    """Signals x horizons.  ``signals`` carry ``paths``; with separate price views
    ``signal_lows`` names the matching array of lows in signal prices."""
    keep = [c for c in signals.columns if c not in ("paths", signal_lows)]
    source = F.col("paths") if not signal_lows else F.zip_with(
        "paths", signal_lows, lambda p, low: p.withField("path_low", low))
    df = signals.select(*keep, F.inline(source))
    df = df.filter(F.col("exit_price").isNotNull())
    return df.withColumns({
        "invalidation_hit": F.col("path_low") <= F.col(invalidation),
        "large_loss": F.col("forward_return_pct") <= large_loss_pct,
    }).drop("path_low")
