"""Text functions as column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from barlens.functions import fixed_values as fixed

WORDS = "[^0-9a-z가-힣]+"


def fold(text: Column) -> Column:
    """Lower case with the one expansion case folding makes in European text."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Does the text contain one of the terms?  Plain byte searches, no regular expression."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def normalize_title(title: Column) -> Column:
    """Folded title without a trailing " - source", letters, digits and Hangul only."""
    t = F.regexp_replace(fold(title), r"(?U)\s+[-|–—]\s+[^-|–—]{2,40}$", "")
    return F.trim(F.regexp_replace(t, WORDS, " "))


def title_tokens(normal: Column) -> Column:
    """Token set of a normalised title: two characters or more, no stop words."""
    words = F.filter(F.split(normal, " "), lambda w: F.length(w) >= 2)
    return F.array_except(words, F.array(*[F.lit(w) for w in fixed.TITLE_STOPWORDS]))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two token sets (arrays without repeats); 0 when one is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(
        both / (F.size(left) + F.size(right) - both))


def numeric_facts(title: Column) -> Column:
    """Set of amounts with unit, spaces removed, in order of appearance."""
    units = "|".join(fixed.NUMBER_UNITS)
    pattern = rf"(?:[$₩€£]\s*)?[0-9]+(?:\.[0-9]+)?\s*(?:{units})?"
    found = F.regexp_extract_all(F.replace(fold(title), F.lit(","), F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def entity_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(fold(name), WORDS, " "))


def corporate_root(name: Column) -> Column:
    """Entity name without trailing legal suffixes."""
    suffixes = "|".join(fixed.LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(entity_name(name), f"(?:(?:^| )(?:{suffixes}))+$", ""))


def contains_name(text: Column, name: Column) -> Column:
    """Whole-word containment of a non-empty entity name."""
    needle = entity_name(name)
    return (needle != "") & F.contains(F.concat(F.lit(" "), entity_name(text), F.lit(" ")),
                                       F.concat(F.lit(" "), needle, F.lit(" ")))


def alias_matches(values: Column, alias: Column) -> Column:
    """Equal to a value, or inside one when the alias has five characters or more."""
    squeeze = lambda c: F.trim(F.regexp_replace(fold(c), r"(?U)\s+", " "))
    needle = squeeze(alias)
    return (F.length(needle) >= 2) & F.exists(
        values, lambda v: (v != "") & ((squeeze(v) == needle) | ((F.length(needle) >= 5) & F.contains(squeeze(v), needle))))


def matched_aliases(values: Column, aliases: Column) -> Column:
    return F.array_distinct(F.filter(aliases, lambda a: alias_matches(values, a)))


def canonical_url(url: Column) -> Column:
    """Lower-case host without www, no tracking keys, sorted query, no fragment, no trailing slash."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            plain(F.regexp_extract(p, r"^([^=]*)", 1)).alias("key"),
            plain(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("item"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(*fixed.TRACKING_KEYS)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["key"]), F.lit("="), coded(p["item"]))), "&")
    full = F.concat(
        F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host,
        F.when(path == "", "/").otherwise(path), F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(full)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 24 hex digits of SHA-256 over the parts joined by the unit separator."""
    joined = F.concat_ws("\x1f", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 24))


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda s: html.unescape(s) if isinstance(s, str) and "&" in s else s)


def clean_html(text: Column) -> Column:
    """Text without tags, entities decoded (the full HTML table, hence Arrow), spaces squeezed."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    decoded = F.pandas_udf(_unescape, "string")(stripped)
    return F.trim(F.regexp_replace(decoded, r"(?U)\s+", " "))


def semicolon_values(text: Column, strip_offsets: bool = False) -> Column:
    """Distinct trimmed items of a semicolon list; optionally without a ",offset" tail."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), F.trim), lambda x: x != "")
    if strip_offsets:
        items = F.transform(items, lambda x: F.trim(F.regexp_replace(x, ",[^,]*$", "")))
        items = F.filter(items, lambda x: x != "")
    return F.array_distinct(items)


def headline_key(title: Column, length: int | None = None) -> Column:
    """Headline identity: folded word characters, all of them or the first ``length``.

    For one-line headlines 120 characters are the customary key; texts of several sentences need the whole.
    """
    key = F.regexp_replace(fold(title), r"(?U)\W+", "")
    return key if length is None else F.substring(key, 1, length)

