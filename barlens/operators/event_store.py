"""An event store that grows by batches: matching and clustering cost what the batch touches.

Folders below ``path``: the stored events (``batch=<name>``), ``_keys`` (an index of the store by event id, article
id, URL and title, in hash shards), ``_leads`` (what clustering compares, and who leads, by 36-hour slot) and
``_rarity`` (the fixed word counts that order title words).  A batch reads the shards its keys fall into and the slots
it can reach; partition filters keep the rest of the store unread.  Every batch writes one folder of each table under
its own name and does not read that folder, so a batch that is run again replaces what it wrote.

Stored events keep the cluster they were given.  Who leads is kept apart from that and follows the sequential rule
over all events: an event that arrives late opens its slot and the next one anew, and slots are opened on for as long
as a stored event's role changes in them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from barlens.operators import events as ev, leaders as ld
from barlens.session import cut, stored

#: Shards of the key index.
SHARDS = 64
KINDS = ("id", "article", "url", "title")
_KEYS = "kind string, key string, event_id string, event_time timestamp, shard int"


def store_keys(events: DataFrame) -> DataFrame:
    """(event_id, event_time, kind, key, shard) of every identity of the events; blank ones are none."""
    scoped = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.sha2(F.concat_ws("\x1f", *ld.SCOPE, c).cast("binary"), 256))
    keys = {"id": F.col("event_id"), "article": scoped("article_id"), "url": scoped("url_key"), "title": scoped("title_key")}
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()])
    rows = events.select("event_id", "event_time", F.inline(pairs)).filter("key is not null")
    return rows.withColumn("shard", F.pmod(F.xxhash64("kind", "key"), F.lit(SHARDS)).cast("int"))


class EventStore:
    """Stored events with their clusters; ``ingest`` adds a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, folder: str, schema: StructType | str, but: str | None = None) -> DataFrame:
        """A table of the store, all batches but one; empty before the first."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        whole = StructType([*schema.fields]).add("batch", "string")
        try:
            rows = self.spark.read.schema(whole).parquet(f"{self.path}{folder}")
        except Exception as error:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], whole)
        return rows if but is None else rows.filter(F.col("batch") != but)

    def events(self, schema: StructType) -> DataFrame:
        return self._read("", schema).drop("batch")

    def _write(self, rows: DataFrame, folder: str, batch: str, *by: str) -> None:
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}{folder}/batch={batch}")

    def _rarity(self, rows: DataFrame) -> str:
        """Word counts of the first batch that came; they stay, as the keys of stored events are ordered by them."""
        known = self._read("/_rarity", "counts string, written bigint").orderBy("written", "batch").first()
        if known is None:
            counts = ld.rarity(rows)
            self._write(self.spark.createDataFrame([(counts, time.time_ns())], "counts string, written bigint").coalesce(1), "/_rarity", "first")
            return counts
        return known["counts"]

    def match(self, incoming: DataFrame, but: str | None = None) -> DataFrame:
        """(event_id, matched_id, match_kind) of incoming events that the store holds: by id, else article, else URL,
        else title; of several stored copies of a key the newest."""
        keys = cut(store_keys(incoming))
        shards = [r["shard"] for r in keys.select("shard").distinct().collect()]  # at most SHARDS
        index = self._read("/_keys", _KEYS, but).filter(F.col("shard").isin(shards))
        known = index.groupBy("kind", "key").agg(F.max_by("event_id", F.struct("event_time", "event_id")).alias("matched_id"))
        found = keys.select("event_id", "kind", "key").join(known, ["kind", "key"])
        turn = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        return found.groupBy("event_id").agg(F.min_by(F.struct("matched_id", F.col("kind").alias("match_kind")), turn).alias("m")).select("event_id", "m.*")

    def ingest(self, incoming: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the events of a batch that neither an earlier event of it nor the store matches; returns them with
        cluster_id and cluster_method.  ``incoming`` carries the keys of ``prepared_events``."""
        batch = batch or uuid.uuid4().hex
        plain = [c for c in incoming.columns if c not in ("cluster_id", "cluster_method")]
        once = cut(ev.deduplicate(incoming.select(*plain)))
        new = stored(once.join(self.match(once, batch).select("event_id"), "event_id", "left_anti").select(*plain), "ingest-new")
        out = new.withColumns({"cluster_id": F.lit(None).cast("string"), "cluster_method": F.lit(None).cast("string")})
        if new.isEmpty():
            return out
        clustered, roles = self._cluster(new, batch)
        out = new.join(clustered, "event_id").select(*out.columns)
        self._write(roles, "/_leads", batch, "slot")
        self._write(store_keys(new), "/_keys", batch, "shard")
        self._write(out, "", batch)
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/batch={batch}")

    def _cluster(self, new: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
        """Clusters of the new events, and the rows of ``_leads`` that the batch writes."""
        slot = ld.slot()
        mine = cut(ld.comparable(new).join(new.select("event_id", ld.cluster_name().alias("cluster_name")), "event_id"))
        rows = cut(mine.withColumn("leads", F.lit(None).cast("boolean")).withColumn("written", F.lit(None).cast("bigint")).withColumn("slot", slot))
        counts = self._rarity(mine)
        schema = StructType([f for f in rows.schema.fields if f.name != "slot"]).add("slot", "integer")
        group = [*ld.GROUP, "slot"]
        # A new event bears on its own slot and the next one.
        opened = cut(rows.select(*ld.GROUP, F.explode(F.array("slot", F.col("slot") + 1)).alias("slot")).distinct())
        while True:
            slots = sorted({r["slot"] + d for r in opened.select("slot").distinct().collect() for d in (-1, 0)})  # one a 36 hours touched
            known = self._read("/_leads", schema, batch).filter(F.col("slot").isin(slots))
            known = known.join(rows.select(*ld.GROUP).distinct(), ld.GROUP, "left_semi")
            newest = known.groupBy("event_id").agg(F.max("written").alias("written"))
            known = cut(known.join(newest, ["event_id", "written"]).select(*rows.columns))
            again = cut(known.join(opened, group, "left_semi"))
            before = known.filter("leads").join(again.select("event_id"), "event_id", "left_anti")
            everyone = rows.unionByName(again)
            plain = [c for c in everyone.columns if c not in ("slot", "leads", "written", "cluster_name")]
            found = ld.settle(everyone.select(*plain), counts, before.select(*plain))
            roles = everyone.join(found, "event_id").withColumn("now", F.col("method") == "singleton")
            changed = cut(roles.filter("leads is not null and leads != now").select(*group))
            more = changed.select(*ld.GROUP, F.explode(F.array("slot", F.col("slot") + 1)).alias("slot")).distinct().join(opened, group, "left_anti")
            more = cut(more)
            if more.isEmpty():
                break
            opened = cut(opened.unionByName(more))
        names = everyone.select("event_id", "cluster_name").unionByName(before.select("event_id", "cluster_name"))
        clustered = found.join(rows.select("event_id"), "event_id", "left_semi").join(
            names.select(F.col("event_id").alias("leader_id"), F.col("cluster_name").alias("cluster_id")), "leader_id")
        written = roles.filter("leads is null or leads != now").withColumn("leads", F.col("now")).withColumn("written", F.lit(time.time_ns()))
        return (cut(clustered.select("event_id", "cluster_id", F.col("method").alias("cluster_method"))), cut(written.select(*rows.columns)))
