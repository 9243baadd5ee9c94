"""Audit of price datasets: issues with counts and examples, reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlens.operators.cleaning import PRICES, finite
from barlens.operators.indicators import KEYS
from barlens.session import cut, stored

CHUNK = 1_000_000  # ingest positions per window partition
STRETCH = 4096  # positions whose issues are counted together
SHOWN = 5  # examples per issue


def previous_row(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add prev_close and prev_date in ingest order.

    Copies can make a symbol arbitrarily long, so the lag runs inside chunks of
    the ingest order and each chunk's first row takes the end of the chunk before.
    """
    df = bars.withColumn("_chunk", F.floor(F.col("ingest_order") / chunk))
    inside = Window.partitionBy(*KEYS, "_chunk").orderBy("ingest_order")
    # The last position is a hashed maximum; only its rows are compared whole.
    last = df.groupBy(*KEYS, "_chunk").agg(F.max("ingest_order").alias("_last"))
    ends = df.join(last, [*KEYS, "_chunk"]).filter(F.col("ingest_order") == F.col("_last")).groupBy(*KEYS, "_chunk").agg(
        F.max_by(F.struct("close", "session_date"), "ingest_order").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*KEYS).orderBy("_chunk")))
    df = df.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(F.struct("close", "session_date")).over(inside)})
    df = df.join(ends, [*KEYS, "_chunk"])
    before = F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_lag"))
    return df.withColumns({"prev_close": before["close"], "prev_date": before["session_date"]}).drop("_chunk", "_first", "_lag", "_end")


def gap_flags() -> tuple[Column, Column, Column]:
    """(gap, is large, looks like a split) against the previous row; zero prices count as unknown."""
    close, prev = F.nullif(F.col("close"), F.lit(0.0)), F.nullif(F.col("prev_close"), F.lit(0.0))
    ratio = close / prev
    gap = F.abs(ratio - 1.0)
    return gap, F.coalesce(gap >= 0.45, F.lit(False)), F.coalesce(ratio.between(0.18, 0.55) | ratio.between(1.8, 5.5), F.lit(False))


def _row_issues(columns: list[str]) -> list[tuple[str, str, Column, Column | None]]:
    """(severity, code, count, example) of every issue a row can have."""
    day = F.col("session_date").cast("string")

    def issue(severity: str, code: str, count: Column, example: Column | None = None) -> tuple[str, str, Column, Column | None]:
        return severity, code, count, None if example is None else F.when(count > 0, example)

    def cells(test) -> Column:
        total = F.lit(0)
        for c in test:
            total = total + F.coalesce(c, F.lit(False)).cast("int")
        return total

    broken = (F.col("high") < F.greatest(*PRICES)) | (F.col("low") > F.least(*PRICES))
    gap, large, split = gap_flags()
    out = [
        issue("warning", "weekend_rows", (F.weekday("session_date") >= 5).cast("int"), day),
        issue("error", "non_finite_values", cells([~finite(F.col(c)) for c in [*PRICES, "volume"]])),
        issue("error", "non_positive_price", cells([F.col(c) <= 0 for c in PRICES])),
        issue("error", "negative_volume", cells([F.col("volume") < 0])),
        issue("error", "invalid_ohlc_relation", cells([broken]), day),
        issue("warning", "large_gap", large.cast("int"), F.concat(day, F.lit(":"), F.format_number(gap * 100, 1), F.lit("%"))),
        issue("warning", "suspected_split", split.cast("int"), day),
        issue("error", "before_listing", cells([F.col("session_date") < F.col("listing_date")])),
        issue("error", "after_delisting", cells([F.col("session_date") > F.col("delisting_date")])),
        issue("error", "duplicate_session", cells([F.col("copies") > 1]), day),
    ]
    raw, adjusted = [f"raw_{c}" for c in PRICES], [f"adjusted_{c}" for c in PRICES]
    have = [c in columns for c in raw + adjusted]
    if all(have):
        ratios = [F.col(a) / F.nullif(F.col(r), F.lit(0.0)) for a, r in zip(adjusted, raw)]
        spread = F.greatest(*ratios) - F.least(*ratios)
        out.append(issue("error", "inconsistent_ohlc_adjustment", cells([spread > 1e-6])))
        if "adjustment_factor" in columns:
            close = F.col("adjusted_close") / F.nullif(F.col("raw_close"), F.lit(0.0))
            wrong = F.coalesce(F.abs(F.col("adjustment_factor") - close) > 1e-10 + 1e-8 * F.abs(close), F.lit(True))
            out.append(issue("error", "adjustment_factor_mismatch", cells([wrong])))
    return out


def _schema_issues(bars: DataFrame) -> list[tuple[str, str]]:
    raw = [f"raw_{c}" in bars.columns for c in PRICES]
    adjusted = [f"adjusted_{c}" in bars.columns for c in PRICES]
    if not any(raw + adjusted):
        return []
    if not all(raw + adjusted):
        return [("error", "incomplete_adjustment_columns")]
    return [] if "adjustment_factor" in bars.columns else [("warning", "adjustment_factor_missing")]


def missing_columns(bars: DataFrame) -> list[str]:
    """Required columns the dataset lacks; such a dataset is failed before any row is read."""
    return [c for c in (*PRICES, "volume") if c not in bars.columns]


def session_gaps(bars: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """(market, symbol, session_date, code): expected days without a bar and bars off the calendar.

    Without a calendar the expected days are the weekdays of the symbol's range.
    The expected grid is one row per symbol and calendar day.
    """
    return _gaps(bars.groupBy(*KEYS, "session_date").agg(F.count(F.lit(1)).alias("copies")), sessions)


def _gaps(counted: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """``session_gaps`` from the rows per symbol and day (``copies``)."""
    actual = counted.select(*KEYS, "session_date")
    grid = counted.groupBy(*KEYS).agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"), F.sum("copies").alias("n"))
    grid = grid.select(*KEYS, "n", F.explode(F.sequence("lo", "hi")).alias("session_date"))
    if sessions is None:
        missing = grid.filter((F.col("n") > 1) & (F.weekday("session_date") < 5)).join(actual, [*KEYS, "session_date"], "left_anti")
        return missing.select(*KEYS, "session_date", F.lit("possible_missing_or_holiday").alias("code"))
    days = sessions.select("session_date").distinct()
    missing = grid.join(days, "session_date", "left_semi").join(actual, [*KEYS, "session_date"], "left_anti")
    extra = actual.join(days, "session_date", "left_anti")
    return missing.select(*KEYS, "session_date", F.lit("missing_exchange_session").alias("code")).unionByName(
        extra.select(*KEYS, "session_date", F.lit("non_session_date").alias("code")))


_OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def read_stamps(bars: DataFrame, zone: Column) -> DataFrame:
    """Add session_date, readable and off_zone from the text ``stamp`` as delivered.

    The day is the one the text shows.  A stamp with an offset is off its zone when the market's clock (``zone``)
    shows another time at that instant; one without an offset is not checked.
    """
    wall = F.try_to_timestamp(F.regexp_replace("stamp", _OFFSET, ""))
    shown = F.from_utc_timestamp(F.try_to_timestamp("stamp"), zone)
    has_offset = F.col("stamp").rlike(r"[0-9]{2}:[0-9]{2}.*" + _OFFSET)
    return bars.withColumns({"readable": F.try_to_timestamp("stamp").isNotNull(), "session_date": F.to_date(F.when(has_offset, wall).otherwise(F.try_to_timestamp("stamp"))),
                             "off_zone": F.coalesce(has_offset & (shown != wall), F.lit(False))})


def inspect_stamped(bars: DataFrame, zone: Column, sessions: DataFrame | None = None, stale_after: str | None = None) -> DataFrame:
    """``inspect`` of bars whose days are still text: a symbol with an unreadable stamp has that one issue and no
    other; a symbol with stamps off its market's zone has a warning beside the rest."""
    rows = read_stamps(bars, zone)
    state = rows.groupBy(*KEYS).agg(F.min(F.col("readable").cast("int")).alias("_ok"), F.max(F.col("off_zone").cast("int")).alias("_off"))
    code = F.when(F.col("_ok") == 0, F.struct(F.lit("error").alias("severity"), F.lit("invalid_datetime_index").alias("code"))).when(
        F.col("_off") == 1, F.struct(F.lit("warning").alias("severity"), F.lit("timezone_mismatch").alias("code")))
    stamps = state.withColumn("_i", code).filter("_i is not null").select(*KEYS, "_i.*", F.lit(1).cast("long").alias("count"), F.array().cast("array<string>").alias("examples"))
    good = rows.join(state.filter("_ok = 1").select(*KEYS), KEYS, "left_semi").drop("stamp", "readable", "off_zone")
    return inspect(good, sessions, stale_after).select(*stamps.columns).unionByName(stamps)


def inspect(bars: DataFrame, sessions: DataFrame | None = None, stale_after: str | None = None) -> DataFrame:
    """issues(market, symbol, severity, code, count, examples) of bars as delivered.

    Nothing is sorted, removed or corrected.  ``bars`` carry ingest_order and may
    carry listing_date, delisting_date, raw_*/adjusted_* and adjustment_factor.
    """
    for c in ("listing_date", "delisting_date"):
        if c not in bars.columns:
            bars = bars.withColumn(c, F.lit(None).cast("date"))
    copies = stored(bars.groupBy(*KEYS, "session_date").agg(F.count(F.lit(1)).alias("copies")), "bar-days")
    rows = previous_row(bars).join(copies, [*KEYS, "session_date"])
    found = _row_issues(bars.columns)
    counted = [F.coalesce(n, F.lit(0)).cast("int").alias(f"n{k}") for k, (_, _, n, _) in enumerate(found)]
    shown = {k: x for k, (*_, x) in enumerate(found) if x is not None}
    marks = stored(rows.select(
        *KEYS, "session_date", F.col("ingest_order").alias("pos"), F.floor(F.col("ingest_order") / STRETCH).alias("stretch"),
        (F.col("session_date") < F.col("prev_date")).cast("int").alias("unsorted"), *counted, *[x.alias(f"x{k}") for k, x in shown.items()]), "bar-issues")
    # Plain sums by stretch; the whole symbol's are sums of those.
    parts = cut(marks.groupBy(*KEYS, "stretch").agg(
        *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(found))], *[F.count(f"x{k}").alias(f"x{k}") for k in shown],
        F.max("unsorted").alias("unsorted"), F.max("session_date").alias("latest")))
    once = parts.groupBy(*KEYS).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(found))], F.max("unsorted").alias("unsorted"), F.max("latest").alias("latest"))
    kind = lambda k: (F.lit(found[k][0]).alias("severity"), F.lit(found[k][1]).alias("code"))
    of_rows = once.select(*KEYS, F.inline(F.array(*[F.struct(*kind(k), F.col(f"n{k}").alias("count")) for k in range(len(found))]))).filter("count > 0")
    # The stretches that hold an issue's first examples, and the rows of those alone.
    turn = Window.partitionBy(*KEYS, "code").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    held = parts.select(*KEYS, "stretch", F.inline(F.array(*[F.struct(*kind(k), F.col(f"x{k}").alias("n")) for k in shown]))).filter("n > 0")
    held = held.withColumn("_before", F.coalesce(F.sum("n").over(turn), F.lit(0))).filter(F.col("_before") < SHOWN)
    early = marks.join(held.select(*KEYS, "stretch").distinct(), [*KEYS, "stretch"], "left_semi")
    examples = early.select(*KEYS, "pos", F.inline(F.array(*[F.struct(*kind(k), F.col(f"x{k}").alias("example")) for k in shown]))).filter("example is not null")
    gaps = _gaps(copies, sessions)
    level = F.when(F.col("code") == "possible_missing_or_holiday", "info").otherwise("warning")
    gaps = gaps.select(*KEYS, F.datediff("session_date", F.lit("1970-01-01").cast("date")).cast("long").alias("pos"), level.alias("severity"), "code",
                       F.col("session_date").cast("string").alias("example"))
    whole = [F.when(F.col("unsorted") > 0, F.struct(F.lit("error").alias("severity"), F.lit("not_sorted").alias("code")))]
    if stale_after:
        whole.append(F.when(F.col("latest") < F.lit(stale_after).cast("date"), F.struct(F.lit("error").alias("severity"), F.lit("stale_data").alias("code"))))
    whole += [F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code")) for s, c in _schema_issues(bars)]
    kinds = [*KEYS, "severity", "code"]
    counts = of_rows.unionByName(gaps.groupBy(*kinds).agg(F.count(F.lit(1)).alias("count"))).unionByName(
        once.select(*KEYS, F.inline(F.array_compact(F.array(*whole)))).withColumn("count", F.lit(1).cast("long")))
    first = F.row_number().over(Window.partitionBy(*kinds).orderBy("pos"))
    listed = examples.unionByName(gaps.filter("example is not null")).withColumn("_r", first).filter(F.col("_r") <= SHOWN)
    listed = listed.groupBy(*kinds).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "example"))), lambda x: x["example"]).alias("examples"))
    return counts.join(listed, kinds, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def reports(issues: DataFrame, symbols: DataFrame) -> DataFrame:
    """One report per symbol: error and warning counts, failed / warning / passed."""
    g = issues.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("severity") == "error", F.col("count")).otherwise(0)).alias("error_count"),
        F.sum(F.when(F.col("severity") == "warning", F.col("count")).otherwise(0)).alias("warning_count"))
    r = symbols.select(*KEYS).distinct().join(g, KEYS, "left")
    r = r.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("error_count", "warning_count")})
    return r.withColumn("status", F.when(F.col("error_count") > 0, "failed").when(F.col("warning_count") > 0, "warning").otherwise("passed"))


def report_rows(report: DataFrame, issues: DataFrame) -> DataFrame:
    """Flat issue rows; a clean symbol keeps one blank row."""
    flat = issues.select(*KEYS, "severity", "code", "count", F.concat_ws(" | ", "examples").alias("examples"))
    blank = {"severity": "", "code": "", "count": 0, "examples": ""}
    return report.join(flat, KEYS, "left").fillna(blank)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace the existing ones with the same key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def publishable(bars: DataFrame, report: DataFrame) -> DataFrame:
    """Bars of the symbols whose report has no error."""
    return bars.join(report.filter(F.col("error_count") > 0).select(*KEYS), KEYS, "left_anti")


def asset_manifest(bars: DataFrame, issues: DataFrame, report: DataFrame) -> DataFrame:
    bounds = bars.groupBy(*KEYS).agg(
        F.min("session_date").alias("start_date"), F.max("session_date").alias("end_date"), F.count(F.lit(1)).alias("rows"))
    pick = lambda code: F.sum(F.when(F.col("code") == code, F.col("count")).otherwise(0))
    counted = issues.groupBy(*KEYS).agg(pick("missing_exchange_session").alias("missing_days"), pick("duplicate_session").alias("duplicate_rows"))
    m = bounds.join(counted, KEYS, "left").join(report.select(*KEYS, F.col("status").alias("quality_status")), KEYS, "left")
    return m.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("missing_days", "duplicate_rows")})


def dataset_manifest(assets: DataFrame, survivorship_safe: Column, universe_given: bool) -> DataFrame:
    """One row: never more than EXPLORATORY; promotion is a separate audit."""
    g = assets.agg(
        F.count(F.lit(1)).alias("asset_count"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
        F.sum("rows").alias("rows"), F.sum("missing_days").alias("missing_days"), F.sum("duplicate_rows").alias("duplicate_rows"),
        F.count_if(F.col("quality_status") == "failed").alias("failed_assets"), F.bool_and(survivorship_safe).alias("_safe"))
    safe = F.coalesce(F.col("_safe"), F.lit(False)) & F.lit(universe_given)
    return g.withColumns({
        "survivorship_safe": safe, "status": F.when(F.col("failed_assets") > 0, "partial").otherwise("collected"),
        "trust_level": F.lit("EXPLORATORY")}).drop("_safe")


def manifest_flags(assets: DataFrame, survivorship_safe: bool, universe_given: bool, corporate_action_verified: bool) -> DataFrame:
    """Trust flags of a dataset from its stock assets (kind, survivorship_safe, quality_status, policies)."""
    stock = assets.filter(F.col("kind") == "stock")
    clear = (
        (F.col("quality_status") != "failed") & ~F.contains(F.lower("corporate_action_policy"), F.lit("unknown"))
        & ~F.contains(F.lower("price_adjustment"), F.lit("unspecified")))
    g = stock.agg(F.count(F.lit(1)).alias("n"), F.bool_and("survivorship_safe").alias("s"), F.bool_and(clear).alias("c"))
    some = F.col("n") > 0
    return g.select(
        (some & F.coalesce("s", F.lit(False)) & F.lit(survivorship_safe and universe_given)).alias("point_in_time_verified"),
        (some & F.coalesce("c", F.lit(False)) & F.lit(corporate_action_verified)).alias("price_policy_verified"))


def to_collect(requests: DataFrame, completed: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests still open: not completed, or completed with a hash no stored artifact has."""
    intact = completed.join(stored.select("data_hash").distinct(), "data_hash", "left_semi").select("key")
    return requests.join(intact, "key", "left_anti")


def session_status(days: DataFrame, sessions: DataFrame, closed: DataFrame, early: DataFrame) -> DataFrame:
    """CLOSED, REGULAR or EARLY_CLOSE per (calendar, session_date).

    ``sessions``: calendar, session_date, minutes.  Early means shorter than the
    usual length; overrides close a session or shorten it.
    """
    keys = ["calendar", "session_date"]
    usual = sessions.groupBy("calendar").agg(F.mode("minutes").alias("_usual"))
    open_days = sessions.join(closed, keys, "left_anti").join(usual, "calendar")
    marked = open_days.join(early.select(*keys).withColumn("_early", F.lit(True)), keys, "left").select(
        *keys, F.when((F.col("minutes") < F.col("_usual")) | F.coalesce("_early", F.lit(False)), "EARLY_CLOSE").otherwise("REGULAR").alias("status"))
    return days.join(marked, keys, "left").withColumn("status", F.coalesce("status", F.lit("CLOSED")))
