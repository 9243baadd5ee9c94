"""Classification of texts and sources as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barlens.functions import fixed_values as fixed, text as t


def event_type(text: Column, form: Column | None = None, items: Column | None = None) -> Column:
    """Form rules, then filing items, then the first event type with a term hit."""
    form = F.coalesce(form if form is not None else F.lit(""), F.lit(""))
    items = F.coalesce(items if items is not None else F.lit(""), F.lit(""))
    joined = t.fold(F.concat_ws(" ", F.coalesce(text, F.lit("")), form, items))
    numbers = F.split(items, "[,; ]+")

    def decide(words: Column) -> Column:
        result = F.when(F.upper(form).isin(*fixed.EARNINGS_FORMS), "EARNINGS")
        for item, kind in fixed.ITEM_TYPES:
            result = result.when(F.startswith(F.upper(form), F.lit("8-K")) & F.array_contains(numbers, item), kind)
        for kind, terms in fixed.EVENT_TERMS:
            result = result.when(t.any_term(words, terms), kind)
        return result.otherwise("OTHER")

    return t.let(joined, decide)


def scope(text: Column, default: Column | str = "COMPANY") -> Column:
    default = F.lit(default) if isinstance(default, str) else default
    return t.let(t.fold(text), lambda joined: (
        F.when(t.any_term(joined, fixed.GLOBAL_TERMS), "GLOBAL_EVENT")
        .when(t.any_term(joined, fixed.MACRO_TERMS), "MACRO")
        .when(t.any_term(joined, fixed.MARKET_TERMS), "MARKET")
        .otherwise(default)
    ))


def source_level(source_type: Column) -> Column:
    kind = F.upper(F.coalesce(source_type, F.lit("")))
    return F.when(kind.isin(*fixed.OFFICIAL_SOURCES), 1).when(kind.isin(*fixed.NEWS_SOURCES), 2).otherwise(3)


def sentiment(title: Column) -> Column:
    hits = t.let(t.fold(title), lambda text: F.struct(
        t.term_hits(text, fixed.POSITIVE_TERMS).alias("good"), t.term_hits(text, fixed.NEGATIVE_TERMS).alias("bad")))
    return (hits["good"] - hits["bad"]) / F.greatest(F.lit(1.0), hits["good"] + hits["bad"])


def headline_risk(title: Column) -> Column:
    return t.let(t.fold(title), lambda text: F.least(
        F.lit(1.0), 0.28 * t.term_hits(text, fixed.RISK_TERMS) + 0.35 * t.term_hits(text, fixed.STRONG_RISK_TERMS)))


def canonical_action(text: Column) -> Column:
    """Action by its leading word; anything else is ``other``."""
    result = F.when(F.lit(False), "")
    for action, word in (("interest", "관심"), ("wait", "기다림"), ("avoid", "피하기")):
        result = result.when(F.startswith(text, F.lit(word)) | F.startswith(text, F.lit(action)), action)
    return result.otherwise("other")


def company_relevance(title: Column, company: Column, symbol: Column, aliases: Column, organizations: Column) -> Column:
    """struct(accepted, status, scope, matches, reason) of a title for one company.

    Search membership and a bare ticker never suffice.
    """
    sym = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    names = F.array_distinct(F.filter(F.concat(F.array(company), aliases), lambda n: F.trim(n) != ""))
    roots = F.array_distinct(F.filter(F.transform(names, t.corporate_root), lambda r: r != ""))
    entity = t.entity_name(title)
    guard = fixed.AFFILIATE_GUARD
    guarded = (sym == guard["symbol"]) | F.exists(names, lambda n: t.entity_name(n) == guard["name"])
    affiliate = F.lit(False)
    for name in guard["affiliates"]:
        affiliate = affiliate | t.contains_name(title, F.lit(name))
    affiliate = guarded & affiliate & ~t.contains_name(title, F.lit(guard["name"]))
    impact = t.any_term(entity, fixed.IMPACT_TERMS)
    product = F.lit(False)
    for code, phrases in fixed.PRODUCT_ONLY.items():
        product = product | ((sym == code) & t.any_term(entity, phrases))
    product = product & ~impact

    def hit(name: Column) -> Column:
        root = t.corporate_root(name)
        by_root = (root != "") & t.contains_name(title, root) & (~root.isin(*fixed.GENERIC_NAMES) | impact)
        return F.when(t.contains_name(title, name), name).when(by_root, root)

    direct = F.array_compact(F.transform(names, hit))
    matches = F.array_distinct(F.concat(direct, t.matched_aliases(organizations, F.concat(names, roots))))
    accepted = (F.size(matches) > 0) & ~product
    raw = F.lower(F.coalesce(title, F.lit("")))
    low = F.lower(sym)
    ticker = (sym != "") & (
        F.contains(raw, F.concat(F.lit("("), low, F.lit(")")))
        | F.regexp(raw, F.concat(F.lit(r"\$\Q"), low, F.lit(r"\E(?U:\b)"))))
    default_scope = scope(title, "SECTOR")
    nothing = F.array().cast("array<string>")

    def verdict(ok: bool, status: Column | str, where: Column | str, found: Column, reason: Column | str) -> Column:
        as_col = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(F.lit(ok).alias("accepted"), as_col(status).alias("status"), as_col(where).alias("scope"),
                        found.alias("matches"), as_col(reason).alias("reason"))

    return (
        F.when(affiliate, verdict(False, "REJECTED_GENERIC", default_scope, nothing, "different_samsung_affiliate"))
        .when(accepted, verdict(True, "DIRECT_COMPANY", "COMPANY", matches, "exact_company_name_or_verified_alias"))
        .otherwise(verdict(
            False, F.when(product | ticker, "REJECTED_GENERIC").otherwise("UNASSESSED"), default_scope, matches,
            F.when(product, "product_only_context").when(ticker, "ticker_only_low_trust").otherwise("no_direct_company_mention")))
    )


def organisation_relevance(organizations: Column, company: Column, symbol: Column, aliases: Column) -> Column:
    """struct(accepted, status, scope, matches, reason) of a record's organisations for one company.

    An organisation counts if it bears one of the company's names, or its legal root together with a legal
    suffix; a bare ticker or a part of a name never does.  One-word aliases must be the company's own name or
    carry a corporate suffix, and generic words always need the suffix.  Missing arrays are empty.
    """
    nothing = F.array().cast("array<string>")
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    words = lambda name: F.split(t.entity_name(name), " ")
    orgs = F.array_distinct(F.filter(F.transform(F.coalesce(organizations, nothing), t.entity_name), lambda o: o != ""))
    legal = F.filter(orgs, lambda o: F.arrays_overlap(F.split(o, " "), listed(fixed.LEGAL_SUFFIXES)))
    roots = F.filter(F.transform(legal, t.corporate_root), lambda r: r != "")
    names = F.array_distinct(F.concat(F.array(F.coalesce(company, F.lit(""))), F.coalesce(aliases, nothing)))
    named = F.filter(names, lambda a: (t.entity_name(a) != "") & (t.entity_name(a) != t.entity_name(symbol)) & (
        F.array_contains(orgs, t.entity_name(a)) | F.array_contains(roots, t.corporate_root(a))))
    own = t.entity_name(company)
    qualified = F.filter(named, lambda a: F.arrays_overlap(words(a), listed(fixed.CORPORATE_SUFFIXES)) | (
        ~t.entity_name(a).isin(*fixed.GENERIC_NAMES) & ((F.size(words(a)) > 1) | (t.entity_name(a) == own))))

    def verdict(found: Column, reason: str, ok: bool = False) -> Column:
        return F.struct(F.lit(ok).alias("accepted"), F.lit("DIRECT_COMPANY" if ok else "REJECTED_GENERIC").alias("status"),
                        F.lit("COMPANY" if ok else "SECTOR").alias("scope"), found.alias("matches"), F.lit(reason).alias("reason"))

    return (F.when(F.size(qualified) > 0, verdict(qualified, "exact_organization_alias", True))
            .when(F.size(named) > 0, verdict(named, "generic_name_without_legal_qualifier"))
            .otherwise(verdict(nothing, "no_exact_organization_alias")))


def context_relevance(title: Column, market: Column, sector: Column, company: Column) -> Column:
    """struct(market, sector, company) relevance of a text: HIGH, MEDIUM, LOW or UNASSESSED."""
    return t.let(t.entity_name(title), lambda joined: _context(joined, title, market, sector, company))


def _context(joined: Column, title: Column, market: Column, sector: Column, company: Column) -> Column:
    chain = t.any_term(joined, fixed.SUPPLY_CHAIN_TERMS)
    m = F.upper(F.coalesce(market, F.lit("")))
    on_market = (
        F.when((m == "US") & t.any_term(joined, fixed.US_CONTEXT_TERMS), "HIGH")
        .when((m == "KR") & t.any_term(joined, fixed.KR_CONTEXT_TERMS), "HIGH")
        .when(t.any_term(joined, fixed.DISTANT_TERMS) & ~chain, "LOW")
        .when(chain, "MEDIUM").otherwise("LOW")
    )
    s = t.entity_name(sector)
    on_sector = (
        F.when((s != "") & t.any_term(joined, fixed.CHIP_TERMS) & t.any_term(s, fixed.CHIP_TERMS), "HIGH")
        .when(F.coalesce(sector, F.lit("")) != "", "LOW").otherwise("UNASSESSED")
    )
    named = (F.coalesce(company, F.lit("")) != "") & t.contains_name(title, t.corporate_root(company))
    return F.struct(on_market.alias("market"), on_sector.alias("sector"), F.when(named, "HIGH").otherwise("LOW").alias("company"))
