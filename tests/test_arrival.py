"""Arrival numbers of delivered bars."""

import random

from pyspark.sql import functions as F

from barlens.operators import quality
from barlens.plans import catalog_data


def test_numbers_follow_order_part_and_supplier(spark):
    """Also for part keys beyond 10,000 and suppliers that agree in their last two digits."""
    draw = random.Random(4)
    rows = [("US", f"S{k % 3}", draw.choice([5, 6, 999_999, 1_000_000, 5_000_000]) + draw.randrange(3), draw.choice([3, 9_999, 10_000, 250_000]),
             draw.choice([1, 101, 7]), None, float(k), 1.0, 1.0, 1.0) for k in range(600)]
    d = spark.createDataFrame(rows, "market string, symbol string, ingest_order bigint, l_partkey bigint, l_suppkey bigint, session_date date, open double, high double, close double, volume double")
    got = {(r["symbol"], r["open"]): r["ingest_order"] for r in catalog_data.arrival_numbers(d).collect()}
    for symbol in ("S0", "S1", "S2"):
        mine = sorted((r for r in rows if r[1] == symbol), key=lambda r: (*r[2:5], r[6]))
        assert [got[symbol, r[6]] for r in mine] == list(range(1, len(mine) + 1))


def test_stamps_as_delivered(spark):
    """An unreadable stamp hides the symbol's other issues; an offset that is not the market's is a warning."""
    rows = [("US", "BAD", "2024-01-02", 0), ("US", "BAD", "soon", 1), ("US", "BAD", "2024-01-06", 2), ("US", "OFF", "2024-01-02T00:00:00Z", 0), ("US", "OFF", "2024-01-06T00:00:00Z", 1),
            ("US", "NY", "2024-01-02 00:00:00-05:00", 0), ("US", "NY", "2024-07-02 00:00:00-04:00", 1), ("US", "DAY", "2024-01-03", 0), ("US", "DAY", "2024-01-02", 1)]
    d = spark.createDataFrame([(m, s, t, k, 1.0, 1.0, 1.0, 1.0, 1.0) for m, s, t, k in rows], "market string, symbol string, stamp string, ingest_order bigint, open double, high double, low double, close double, volume double")
    got = {(r["symbol"], r["code"]) for r in quality.inspect_stamped(d, F.lit("America/New_York")).collect()}
    own = {("BAD", "invalid_datetime_index"), ("OFF", "timezone_mismatch"), ("OFF", "weekend_rows"), ("DAY", "not_sorted")}
    assert own <= got and not {c for s, c in got if s == "BAD"} - {"invalid_datetime_index"} and not {c for s, c in got if s in ("NY", "DAY")} & {"timezone_mismatch", "invalid_datetime_index"}
