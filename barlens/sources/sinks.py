"""Writers: partitioned, append-only or content-addressed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlens.operators.events import SOURCE_GROUPS

UNIVERSE_COLUMNS = ("date", "market", "symbol", "eligible", "source", "point_in_time_level")


def store_artifacts(spark: SparkSession, files: DataFrame, folder: str) -> None:
    """Append raw payloads (source, day, content) whose SHA-256 is not stored yet."""
    hashed = files.withColumn("data_hash", F.sha2("content", 256)).dropDuplicates(["source", "data_hash"])
    try:
        known = spark.read.parquet(folder).select("source", "data_hash")
        hashed = hashed.join(known, ["source", "data_hash"], "left_anti")
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    hashed.write.mode("append").partitionBy("source", "day").parquet(folder)


def damaged_artifacts(stored: DataFrame) -> DataFrame:
    """Artifacts whose content no longer has the hash that names them."""
    return stored.filter(F.sha2("content", 256) != F.col("data_hash"))


def publish_bars(bars: DataFrame, folder: str) -> None:
    bars.write.mode("overwrite").partitionBy("market").parquet(folder)


def required_first(rows: DataFrame, required: tuple[str, ...] = UNIVERSE_COLUMNS) -> DataFrame:
    """Required columns first, absent ones as null, then the rest."""
    head = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in required]
    return rows.select(*head, *[c for c in rows.columns if c not in required])


def append_events(events: DataFrame, folder: str) -> None:
    """JSON lines by source, year and month of the event."""
    out = events.withColumns({"source": F.lower("source_type"), "year": F.date_format("event_time", "yyyy"), "month": F.date_format("event_time", "MM")})
    out.write.mode("append").partitionBy("source", "year", "month").json(folder)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    manifest.write.mode("append").json(folder)


def manifest_index(manifests: DataFrame) -> DataFrame:
    """Newest entry per dataset id."""
    newest = manifests.groupBy("dataset_id").agg(F.max_by(F.struct(*[c for c in manifests.columns if c != "dataset_id"]), "updated_at").alias("m"))
    return newest.select("dataset_id", "m.*").orderBy("dataset_id")


def append_failures(failures: DataFrame, folder: str) -> None:
    failures.withColumn("failed_at", F.current_timestamp()).write.mode("append").json(folder)


#: Events of one snapshot record; an analysis with more evidence has several.
RECORD_EVENTS = 1000
_EVENT = "event_id string, source_type string, event_type string, source_level int, scope string, raw_hash string, event_time timestamp"


def write_snapshots(analyses: DataFrame, lineage: DataFrame, folder: str) -> None:
    """Full analysis snapshots as nested JSON lines: a record has the analysis, its five source lists of event ids and
    the events themselves.

    ``lineage`` comes from ``events.snapshot_lineage``.  A record holds about ``RECORD_EVENTS`` events, dealt by their
    id, so that a popular symbol's evidence is several records and never one; ``part`` and ``parts`` tell them apart.
    """
    size = lineage.groupBy("analysis_id").agg(F.ceil(F.count(F.lit(1)) / RECORD_EVENTS).cast("int").alias("parts"))
    rows = lineage.join(size, "analysis_id").withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int"))
    event = F.struct(*[f.split()[0] for f in _EVENT.split(", ")])
    lists = [F.sort_array(F.collect_list(F.when(F.col("source_group") == g, F.col("event_id")))).alias(g) for g in dict.fromkeys(SOURCE_GROUPS.values())]
    records = rows.groupBy("analysis_id", "part", "parts").agg(*lists, F.sort_array(F.collect_list(event)).alias("lineage"))
    analyses.join(records, "analysis_id", "left").write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "true").json(folder)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot records read back; absent keys have their defaults: empty lists, part 0 of 1."""
    groups = list(dict.fromkeys(SOURCE_GROUPS.values()))
    schema = "analysis_id string, market string, symbol string, analysis_timestamp timestamp, part int, parts int, " + ", ".join(
        f"{g} array<string>" for g in groups) + f", lineage array<struct<{', '.join(': '.join(f.split()) for f in _EVENT.split(', '))}>>"
    rows = spark.read.schema(schema).json(folder)
    empty = {c: F.coalesce(c, F.array().cast(t)) for c, t in rows.dtypes if t.startswith("array")}
    return rows.withColumns({**empty, "part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))})


def snapshot_events(records: DataFrame) -> DataFrame:
    """Evidence of snapshot records in long form: one row per event, with the list that its source goes to."""
    group = F.when(F.lit(False), "")
    for source, name in SOURCE_GROUPS.items():
        group = group.when(F.col("e.source_type") == source, name)
    return records.select("analysis_id", "market", "symbol", F.explode("lineage").alias("e")).select(
        "analysis_id", "market", "symbol", group.alias("source_group"), "e.*")
