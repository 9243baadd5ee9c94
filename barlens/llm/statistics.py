"""Statistics of whole article texts, with column functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import WORD

#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"
#: Up to so many repeated windows are looked up one by one.
FEW = 16

#: Counts per text; the ratios below are derived from them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper",
          "n_digits", "n_stops")
#: What rules and classifiers may look at: statistics of the text, nothing else.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
            "digit_share", "stop_share", "words_per_line")


def text_statistics(articles: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of every ``title``, one row per input row.

    ``n_repeat_words`` counts the words inside any 3-word window found at least twice in
    the text; windows are compared by 64-bit hashes chained over their words.  A null or
    empty title, or one of white space alone, has zeros throughout."""
    # The kept columns travel apart, so that none clashes with what is made here.
    words = articles.select(F.struct(*keep).alias("kept_columns"), F.coalesce("title", F.lit("")).alias("title")).withColumn(
        "words", F.array_remove(F.split("title", GAP), ""))
    n = F.size("words")
    window = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    lines = F.filter(F.split("title", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    rows = words.withColumns({
        "windows": F.slice(window, 1, F.greatest(n - 2, F.lit(0))), "lines": lines})
    # Values beside an equal one in sorted order are repeated.
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array("windows")))
    rows = rows.withColumn("twice", F.array_distinct(F.filter("ordered", lambda h, k: (k > 0) & (F.get("ordered", k - 1) == h))))
    # Places of repeated windows: by look-up while the repeated values are few, else by sorting values with their places.
    looked_up = F.filter(F.transform("windows", lambda h, i: F.when(F.array_contains("twice", h), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("paired", F.when(F.size("twice") > FEW, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    sorted_out = F.sort_array(F.transform(F.filter("paired", lambda x, k: (
        F.get("paired", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("paired", k - 1)["h"] == x["h"]))), lambda x: x["i"]))
    rows = rows.withColumn("places", F.when(F.size("twice") > FEW, sorted_out).when(F.size("twice") > 0, looked_up))
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    big = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(
        *[F.col("kept_columns")[c].alias(c) for c in keep], big(n).alias("n_words"), big(F.length(F.array_join("words", ""))).alias("word_chars"),
        big(F.regexp_count("title", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        big(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        big(covered).alias("n_repeat_words"), big(F.size("lines")).alias("n_lines"),
        big(F.size(F.array_distinct("words"))).alias("n_distinct_words"),
        big(F.regexp_count("title", F.lit("[A-Z]"))).alias("n_upper"), big(F.regexp_count("title", F.lit("[0-9]"))).alias("n_digits"),
        big(F.regexp_count("title", F.lit("[.!?]"))).alias("n_stops"))


def features(statistics: DataFrame, *keep: str) -> DataFrame:
    """The feature columns as doubles; a ratio over nothing is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    made = {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "stop_share": share("n_stops", "n_words"), "words_per_line": share("n_words", "n_lines")}
    return statistics.select(*keep, *[c.alias(f"f_{name}") for name, c in made.items()])
