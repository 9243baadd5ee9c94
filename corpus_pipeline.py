"""A training-corpus pipeline: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlens.llm import catalog, mixing, near_duplicates, quality_rules, secrets, token_codec
from barlens.session import prepare, stored
from barlens.llm.common import bounded

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words with the white space before them.
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _articles(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("title"), F.col("source").alias("source_name"),
                       *[c for c in ("lang", "n_chars") if c in docs.columns])


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("doc_id"), F.col("title").alias("text"), "lang", F.col("source_name").alias("source"), "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base thresholds nor a learned rule reject."""
    prepare(spark)
    judged = quality_rules.judge_articles(_articles(docs), catalog.judgements(spark, sf_dir), "title", "source_name", "lang", "n_chars")
    return _documents(judged.filter("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id.

    Of rows that repeat an id one stays; rows without an id all stay."""
    prepare(spark)
    found = stored(near_duplicates.near_duplicates(_articles(docs)).select("event_id", "kept"), "kept-documents")
    ids = stored(found.filter(F.col("kept") & F.col("event_id").isNotNull()).groupBy(F.col("event_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("times")), "kept-ids")
    rows = docs.select(*COLUMNS).join(bounded(ids, 24), "doc_id")
    once = rows.filter("times = 1").select(*COLUMNS)
    if not ids.filter("times > 1").isEmpty():
        again = rows.filter("times > 1").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
        once = once.unionByName(again.select("doc_id", "row.*"))
    return once.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    prepare(spark)
    rows = secrets.scan_secrets(_articles(docs))
    text = secrets.redact(F.col("title"), F.col("spans"))
    return _documents(rows.withColumn("title", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("title").cast("bigint")).otherwise(F.col("n_chars"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document and pass over its source, with the words of
    that pass (the whole text where all are taken)."""
    prepare(spark)
    mixed, _ = mixing.mix_articles(_articles(docs))
    parts = mixed.filter("taken > 0").select("event_id", "source_name", F.col("text_key").alias("key"), F.col("copy").alias("of_copy"), "size", "parts")
    # A row is told from its equals by its number among them, as in the layout.
    equal = Window.partitionBy("event_id", "source_name", "text_key").orderBy("lang", "n_chars")
    rows = _articles(docs).withColumn("text_key", F.xxhash64("title"))
    rows = rows.withColumn("copy", F.row_number().over(equal).cast("bigint") - 1).alias("d")
    same = (F.col("d.event_id").eqNullSafe(F.col("m.event_id")) & F.col("d.source_name").eqNullSafe(F.col("m.source_name"))
            & (F.col("text_key") == F.col("m.key")) & (F.col("copy") == F.col("of_copy")))
    rows = rows.join(parts.alias("m"), same).withColumn("pass", F.explode(F.array_distinct(F.transform("parts", lambda p: p["pass"]))))
    mine = F.sort_array(F.transform(F.filter("parts", lambda p: p["pass"] == F.col("pass")), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    rows = rows.select("d.*", "size", mine.alias("runs"), F.regexp_extract_all("title", F.lit(PIECE), F.lit(0)).alias("pieces"))
    whole = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"]) == F.col("size")
    cut = F.ltrim(F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("pieces", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), ""))
    rows = rows.withColumn("title", F.when(whole, F.col("title")).otherwise(cut)).withColumn("n_chars", F.length("title").cast("bigint"))
    return _documents(rows)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    prepare(spark)
    path = catalog.tokenizer_file()
    rows = token_codec.decode_articles(token_codec.encode_articles(_articles(docs), path), path)
    return rows.select(F.col("event_id").alias("doc_id"), "lang", F.col("source_name").alias("source"), F.size("token_ids").cast("bigint").alias("n_tokens"),
                       "token_ids", (F.col("decoded") == F.coalesce("title", F.lit(""))).alias("exact"))


STAGES = [("quality rules", quality), ("near duplicates", deduplicate), ("secrets", redact), ("mixing", mix), ("tokens", tokens)]
#: Signatures, learned rules, seeded draws and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
