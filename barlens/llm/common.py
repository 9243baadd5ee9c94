"""Small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlens.session import stored

#: Words are maximal runs of anything but the space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 16 << 20


def fold(event_id: Column | str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; 0 marks held-out rows (no id: null)."""
    key = F.col(event_id) if isinstance(event_id, str) else event_id
    return F.crc32(key.cast("string").cast("binary")) % folds


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if its counted rows fit the bound; else
    it is left as it is, and a join with it shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def bucket_count(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def in_order(df: DataFrame, order: list[str], name: str, at: str = "at") -> DataFrame:
    """``df`` stored in the order of the named columns (ascending, nulls first), rows numbered from 0.

    Rows are dealt to the tasks by range; rows that are equal in all columns of ``order`` are spread over
    tasks too.  Only the number of rows of each partition comes to the driver.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_salt"]
    rows = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("_salt")
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33).cast("int")
    counts = dict(rows.groupBy(part.alias("part")).count().collect())
    starts = [0]
    for k in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(k, 0))
    start = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in starts]), part + 1)
    return rows.withColumn(at, start + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
