"""Mixing article sources to target weights in fixed-length word blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from barlens.llm.common import WORD, bucket_count
from barlens.session import stored

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: The mix has so many words per word of all sources; a source at most so many times its own.
BUDGET, MOST = 1.5, 2.0
BLOCK_WORDS = 64
#: Blocks per output shard.
SHARD_BLOCKS = 4096
#: Articles of one source that are laid out together, block takes made by one row, and blocks
#: of a source's stream whose takes are gathered in one row.
ARTICLES_PER_BUCKET, TAKES_PER_CHUNK, STRETCH_BLOCKS = 4096, 10_000, 64


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source_name, source_size, target) from (source_name, source_size).

    Sources share ``budget`` times all words by weight; a share stops at ``most`` times the
    source's size and the excess goes to the others by weight.  The fixed point is a level:
    target = min(most * size, level * weight), found by running sums over the sources in
    the order in which they stop."""
    by_name = Window.orderBy(F.col("source_name").isNull(), "source_name")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source_name").isNull(), "source_name").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spent, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (budget * F.sum("source_size").over(everything) - spent) / (F.sum("weight").over(everything) - gone)
    rows = rows.withColumn("level", level)
    # The level of the first source, in that order, that does not stop.
    first = F.struct(F.col("cap") / F.col("weight"), F.col("source_name").isNull(), "source_name", "level")
    final = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), first)).over(everything)["level"]
    return rows.select("source_name", "source_size", F.coalesce(F.least("cap", final * F.col("weight")), "cap").alias("target"))


@F.pandas_udf(LongType())
def permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    """A pseudorandom permutation of 0..size-1, keyed: a Feistel network over the next power
    of four, walked until the value falls inside."""
    size, key = size.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.to_numpy(np.int64).astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            a, b = out[todo] >> h, out[todo] & m
            for turn in range(4):
                x = (b + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                a, b = b, (a ^ (x >> np.uint64(31))) & m
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return pd.Series(out.astype(np.int64))


def laid_out(articles: DataFrame) -> DataFrame:
    """(event_id, source_name, size, text_key, copy, start): each article's first word in its
    source's stream.  ``copy`` numbers the rows that are equal in all else, from 0.

    A source's stream is laid out in buckets of hashed ids, so that no window sees more
    than a bucket of one source; bucket totals are summed first.  Copies are counted in the
    tasks and lie one after the other, so that thousands of them are one row until then."""
    rows = stored(articles.select(
        "event_id", "source_name", F.coalesce(F.regexp_count("title", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("title").alias("text_key")), "article-sizes")
    buckets = bucket_count(rows.count(), ARTICLES_PER_BUCKET)
    rows = rows.groupBy("event_id", "source_name", "size", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("words", F.col("size") * F.col("copies")).withColumn("bucket", F.pmod(F.xxhash64("event_id", "text_key"), F.lit(buckets)))
    totals = rows.groupBy("source_name", "bucket").agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("source_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source_name", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source_name", "bucket").orderBy("event_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0)))
    same = F.col("a.source_name").eqNullSafe(F.col("b.source_name")) & (F.col("a.bucket") == F.col("b.bucket"))
    return rows.alias("a").join(offsets.alias("b"), same).select(
        "a.event_id", "a.source_name", "a.size", "a.text_key", (F.col("offset") + F.col("inside")).alias("first"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")).select(
        "event_id", "source_name", "size", "text_key", "copy", (F.col("first") + F.col("copy") * F.col("size")).alias("start"))


def block_takes(sources: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, source_name, block, pass): which block fills each slot of each output shard.

    Every source gets the whole number of blocks nearest its target.  All takes are dealt
    to the slots of the shards by one pseudorandom permutation, so a shard's counts by
    source are a multinomial draw conditioned on those totals; a source's n-th take is
    mapped through the source's own index permutation, a fresh one for each pass over it."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source_name").isNull(), "source_name").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sources.filter("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("bigint"))
        .withColumn("takes", F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("bigint"), (MOST * F.col("blocks")).cast("bigint")))
        .withColumn("ahead", F.coalesce(F.sum("takes").over(order), F.lit(0))).withColumn("all", F.sum("takes").over(everything)))
    chunks = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("takes") - 1) / TAKES_PER_CHUNK)))).filter("takes > 0")
    # One row per chunk is dealt out anew before it grows into its takes; the number of tasks is
    # given, as Spark would put so few bytes into one.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    takes = chunks.repartition(tasks, "source_name", "chunk").withColumn("take", F.explode(F.sequence(
        F.col("chunk") * TAKES_PER_CHUNK, F.least((F.col("chunk") + 1) * TAKES_PER_CHUNK, F.col("takes")) - 1)))
    takes = takes.withColumn("pass", F.floor(F.col("take") / F.col("blocks")))
    slot = permuted(F.col("ahead") + F.col("take"), F.col("all"), F.lit(seed).cast("bigint"))
    block = permuted(F.col("take") % F.col("blocks"), F.col("blocks"), F.xxhash64("source_name", "pass", F.lit(seed)))
    return takes.select("source_name", "pass", slot.alias("at"), block.alias("block")).select(
        F.floor(F.col("at") / shard_blocks).alias("shard"), (F.col("at") % shard_blocks).alias("slot"), "source_name", "block", "pass")


def mix_articles(articles: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Mix ``event_id``, ``title`` (the whole text), ``source_name`` to the target weights.

    Returns the articles, one row per input row: ``event_id``, ``source_name``, ``size``
    (words), ``text_key`` (hash of the title), ``copy`` (number among equal rows), ``source_size``, ``target``, ``taken`` (words
    the mix takes, repeats counted) and ``parts``, the taken runs of words as (pass, start,
    end); and the slots of the output shards (see ``block_takes``).

    Null and empty titles have size 0 and are never taken; null is a source of its own;
    rows without an id and repeated rows are laid out like others; an empty table mixes to
    an empty table.  Reruns agree: order and draws depend on hashes and ``seed`` alone.
    """
    rows = stored(laid_out(articles), "article-layout")
    sources = stored(targets(rows.groupBy("source_name").agg(F.sum("size").alias("source_size"))), "source-targets")
    slots = block_takes(sources, seed, block_words)
    # Articles meet the takes of their blocks by stretches of blocks.  Both sides grow with the
    # words, which the small table of sources does not tell Spark: the join is sorted, as
    # Spark would send the takes to every executor.  Articles without words have no takes.
    stream = [F.coalesce("source_name", F.lit("")).alias("name"), F.col("source_name").isNull().alias("unnamed")]
    takes = slots.select(*stream, F.floor(F.col("block") / STRETCH_BLOCKS).alias("stretch"), F.struct("block", "pass").alias("take"))
    takes = takes.groupBy("name", "unnamed", "stretch").agg(F.collect_list("take").alias("takes"))
    key = ["event_id", "source_name", "size", "text_key", "copy"]
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = rows.filter("size > 0").select(*key, "start", *stream, F.explode(F.sequence(F.floor(first / STRETCH_BLOCKS), F.floor(last / STRETCH_BLOCKS))).alias("stretch"))
    lo = lambda t: F.greatest(t["block"] * block_words - F.col("start"), F.lit(0))
    hi = lambda t: F.least((t["block"] + 1) * block_words - F.col("start"), F.col("size"))
    runs = F.transform(F.filter("takes", lambda t: t["block"].between(first, last)), lambda t: F.struct(t["pass"].alias("pass"), lo(t).alias("start"), hi(t).alias("end")))
    taken = (
        pieces.join(takes.hint("merge"), ["name", "unnamed", "stretch"], "left")
        .groupBy(*key).agg(F.flatten(F.collect_list(runs)).alias("parts")))
    none = F.array().cast(taken.schema["parts"].dataType)
    taken = taken.unionByName(rows.filter("size = 0").select(*key, none.alias("parts")))
    words: Column = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    out = taken.alias("a").join(F.broadcast(sources).alias("s") if sources.count() <= 100_000 else sources.alias("s"),
                                F.col("a.source_name").eqNullSafe(F.col("s.source_name")))
    return out.select("event_id", "a.source_name", "size", "text_key", "copy", "source_size", "target", words.alias("taken"),
                      F.sort_array("parts").alias("parts")), slots
