"""Secret scan of article texts through a trigram inverted index."""

from __future__ import annotations

import re
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, functions as F

from barlens.llm.common import bounded, bucket_count
from barlens.session import stored

#: kind, pattern, group that holds the secret, least characters of that group.
RULES = (
    ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
               r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("repository", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)
#: Texts of one block of the index: bounds a posting list.
BLOCK_TEXTS = 2048
#: More spellings than this end a run of known characters.
SPELLINGS = 16

SPAN = "array<struct<kind:string,start:int,end:int>>"


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """The Boolean query of a pattern over lower-case trigrams: every entry must hold, an
    entry holds if one of its alternatives does, an alternative if all its trigrams occur.
    Empty when nothing is mandatory: such a rule scans everything."""
    clauses: list[list[list[str]]] = []
    run = [""]

    def close() -> None:
        nonlocal run
        parts = [sorted({s[i:i + 3] for i in range(len(s) - 2)}) for s in dict.fromkeys(run)]
        if all(parts):
            clauses.append(parts)
        run = [""]

    def spell(items) -> list[str] | None:
        """All spellings of a part, or None if they are too many."""
        found = [""]
        for op, arg in items:
            if op is sre.LITERAL:
                more = [chr(arg).lower()]
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                more = list(dict.fromkeys(chr(a).lower() for _, a in arg))
            elif op is sre.SUBPATTERN:
                more = spell(arg[3])
            elif op is sre.BRANCH:
                several = [spell(b) for b in arg[1]]
                more = None if None in several else [s for b in several for s in b]
            elif op is sre.MAX_REPEAT and arg[1] == 1:
                once = spell(arg[2])
                more = once and ([""] if arg[0] == 0 else []) + once
            elif op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
                more = spell(list(arg[2]) * arg[0])
            else:
                more = None
            if more is None or len(more) * len(found) > SPELLINGS:
                return None
            found = list(dict.fromkeys(a + b for a in found for b in more))
        return found

    for item in _parser.parse(pattern):
        more = spell([item])
        if more is None or len(more) * len(run) > SPELLINGS:
            close()
            run = more if more is not None else [""]
        else:
            run = list(dict.fromkeys(a + b for a in run for b in more))
    close()
    return clauses


def trigram_index(articles: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (block, trigram, postings): which texts hold which of ``trigrams``.

    A posting is the text's 64-bit key, so copies share one entry and rows without an id
    take part; a block holds about ``BLOCK_TEXTS`` texts, whatever the corpus' size."""
    blocks = bucket_count(articles.count(), BLOCK_TEXTS)
    low = articles.select(F.xxhash64("title").alias("text_key"), F.lower("title").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return (
        low.select(F.pmod("text_key", F.lit(blocks)).alias("block"), "text_key", F.explode(found).alias("trigram"))
        .groupBy("block", "trigram").agg(F.collect_set("text_key").alias("postings")))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(text_key, kinds): texts whose postings satisfy a rule's Boolean query."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def merged(parts: list[Column], join) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    def hit(postings: Column, kind: str) -> Column:
        return F.transform(postings, lambda k: F.struct(k.alias("text_key"), F.lit(kind).alias("kind")))

    hits = []
    for kind, pattern, _, _ in rules:
        query = trigram_query(pattern)
        if query:
            postings = merged([
                merged([merged([F.coalesce(F.element_at("lists", F.lit(t)), none) for t in alternative], F.array_intersect)
                        for alternative in clause], F.array_union)
                for clause in query], F.array_intersect)
            hits.append(hit(postings, kind))
    return (lists.select(F.explode(F.concat(*hits)).alias("hit")).groupBy("hit.text_key")
            .agg(F.sort_array(F.collect_set("hit.kind")).alias("kinds")))


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one rule in ``title``: leftmost non-overlapping matches whose group is long
    enough.  Positions come from the lengths of the matches and of the pieces between."""
    lengths = lambda parts: F.transform(parts, F.length)
    matches = F.regexp_extract_all("title", F.lit(pattern), F.lit(0))
    both = F.arrays_zip(
        lengths(matches).alias("match"), lengths(F.split("title", pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all("title", F.lit(pattern), F.lit(group))).alias("secret"))
    empty = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + part["gap"]
        # The last piece has no match after it.
        end = begin + F.coalesce(part["match"], F.lit(0))
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["secret"] >= least, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.when(F.regexp_like("title", F.lit(pattern)), F.aggregate(both, start, step)["spans"]).otherwise(empty)


def scan_secrets(articles: DataFrame, rules=RULES) -> DataFrame:
    """Secrets in every title.

    Input: ``event_id``, ``title`` (the whole text; other columns are passed through).
    Output: one row per input row with ``spans``, an array of (kind, start, end) in code
    points, end exclusive, ordered by start, then rule.  Each rule's pattern gives a
    Boolean query over trigrams; postings of the inverted index are combined by it, and
    only texts it leaves are verified with the pattern.  Rules without mandatory trigrams
    (``hex``) are run on every text.

    A null or empty title has no spans; rows without an id, repeated rows and ties are
    scanned like any other; an empty table gives an empty result.  A column named
    ``spans`` is replaced; ``text_key`` and ``kinds`` are used inside and dropped.
    """
    columns = [c for c in articles.columns if c not in ("spans", "text_key", "kinds")]
    queries = {kind: trigram_query(pattern) for kind, pattern, _, _ in rules}
    trigrams = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    found = stored(candidates(trigram_index(articles, trigrams), rules), "secret-candidates")
    rows = articles.select(*columns, F.xxhash64("title").alias("text_key")).join(bounded(found, 64), "text_key", "left")
    parts = [
        _spans(*rule) if not queries[rule[0]]
        else F.when(F.array_contains("kinds", rule[0]), _spans(*rule)).otherwise(F.array().cast(SPAN))
        for rule in rules]
    order = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule[0], i)])
    keyed = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rule"), s.alias("span")))
    spans = F.when(F.col("title").isNotNull(), F.transform(F.sort_array(keyed), lambda s: s["span"]))
    return rows.select(*columns, F.coalesce(spans, F.array().cast(SPAN)).alias("spans"))


def redact(title: Column, spans: Column) -> Column:
    """``title`` with every span replaced by ``[kind]``; overlapping spans become one."""
    step = lambda done, s: F.when(
        s["end"] <= done["at"], done).otherwise(F.struct(
            F.concat(done["text"], F.when(s["start"] >= done["at"], F.concat(
                F.substring(title, done["at"] + 1, s["start"] - done["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")).alias("text"),
            s["end"].alias("at")))
    done = F.aggregate(spans, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step,
                       lambda d: F.concat(d["text"], F.substring(title, d["at"] + 1, F.length(title))))
    return F.when(F.size(spans) > 0, done).otherwise(title)
