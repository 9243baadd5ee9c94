"""The numbered queries: the given tables mapped to the operators' records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.llm import classifier, conversations, hard_negatives, held_out_passages, language_model, mixing, near_duplicates, neighbours, oracle, page_text, quality_rules, repeated_passages, secrets, token_codec
from barlens.session import prepare, stored


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles: the id, the whole text as title, the source."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("title"), F.col("source").alias("source_name"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("event_id"), F.col("quality").alias("accepted"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_secrets(articles(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        F.col("event_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_articles(articles(spark, sf_dir))[0].select(
        F.col("event_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_articles(articles(spark, sf_dir), judgements(spark, sf_dir)).withColumnRenamed("event_id", "doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_articles(articles(spark, sf_dir), judgements(spark, sf_dir)).select(
        F.col("event_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(articles(spark, sf_dir), shingle_words=4).withColumnRenamed("event_id", "doc_id")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("event_id").alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    rows = articles(spark, sf_dir).select("event_id", "title")
    # Stored in between: in one stage every task would hold the Python workers and Arrow buffers of both.
    encoded = stored(token_codec.encode_articles(rows, path).drop("title"), "token-ids")
    return token_digests(token_codec.decode_articles(encoded, path))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("article_id"), F.col("url").alias("source_url"), "html")
    return page_text.extract_pages(pages).select(
        F.col("article_id").alias("page_id"), F.col("source_url").alias("url"), "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("pattern_id"), F.col("embedding").alias("features"))
    return neighbours.nearest_patterns(patterns, patterns.filter("pattern_id % 50 = 0")).select(
        "query_id", "rank", F.col("pattern_id").alias("vec_id"), "score")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_titles(articles(spark, sf_dir)).withColumnRenamed("event_id", "doc_id")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_passages.repeated_passages(articles(spark, sf_dir))
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return rows.select(F.col("event_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"), "shared")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    damaged = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    patterns = rows.select(F.col("vec_id").alias("symbol"), F.col("embedding").alias("features"), damaged.alias("outcome"))
    found = hard_negatives.mine_hard_negatives(patterns, F.col("symbol") % 100 == 0, key=("symbol",), label="outcome", features="features")
    return found.select(F.col("anchor.symbol").alias("anchor_id"), F.col("positive.symbol").alias("positive_id"), "rank",
                        F.col("negative.symbol").alias("negative_id"), "positive_score", "negative_score")


def op12_held_out_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("event_id"), F.col("text").alias("title"))
    rows = held_out_passages.flag_held_out(articles(spark, sf_dir).select("event_id", "title"), held_out)
    return rows.select(F.col("event_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """The given damage, drawn from each row's conversation and turn: a row lost, emptied, without its full stops, repeated, or of the wrong role."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), draw.alias("draw")).filter("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report = conversations.conversation_report(conversations.repair_conversations(damaged_turns(turns))).alias("r")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    rows = ids.join(report, F.col("id").eqNullSafe(F.col("r.conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_near_duplicates, op3_mixing, op4_quality_classifier, op5_quality_rules, op6_page_text, op7_token_codec, op8_neighbours, op9_language_model, op10_repeated_passages,
                              op11_hard_negatives, op12_held_out_passages, op13_conversation_repair)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(run: Callable) -> Callable:
        return lambda spark, sf_dir: run(prepare(spark), sf_dir)

    return {name: ready(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
