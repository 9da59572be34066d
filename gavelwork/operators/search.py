"""Search terms and search plans for catalog items.

Terms are array expressions over the item's columns; an item never leaves its row until
the chosen terms are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.functions.text import any_contains
from gavelwork.rules import fixed

Parts = Sequence[object]


def _has(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def _term(*parts: object, when: Column | None = None) -> Column:
    """Parts joined with blanks; NULL when the condition does not hold."""
    text = F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return text if when is None else F.when(when, text)


def _array(terms: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*terms))


def card_terms(name: Column, set_name: Column, number: Column) -> Column:
    """Plain terms for a card: name, set, number, then condition terms."""
    has_set, has_number = _has(set_name), _has(number)
    terms = [
        _term(name, "pokemon card"),
        _term(name, set_name, "pokemon", when=has_set),
        _term(name, set_name, number, "pokemon", when=has_set & has_number),
    ]
    for condition in ("PSA 10", "BGS 10", "mint"):
        terms += [_term(name, "pokemon", condition), _term(name, set_name, condition, when=has_set)]
    return _array(terms)


def sealed_terms(name: Column, set_name: Column, kind: Column) -> Column:
    """Plain terms for a sealed product."""
    low = F.lower(name)
    both = _has(set_name) & _has(kind)
    box = low.contains("booster box")
    special = any_contains(low, ("collection", "premium", "elite"))
    return _array([
        _term(name, "pokemon"),
        _term(name, "sealed"),
        _term(set_name, kind, "pokemon", when=both),
        _term(set_name, kind, "sealed", when=both),
        *[_term(set_name, tail, when=box) for tail in ("booster box", "sealed booster box", "booster case")],
        *[_term(set_name, tail, when=special)
          for tail in ("collection box", "premium collection", "elite trainer box")],
    ])


def graded_terms(terms: Column, companies: Sequence[str] = ("PSA", "BGS", "CGC"),
                 grades: Sequence[str] = ("10", "9.5", "9")) -> Column:
    """Every term with every grading company, alone and with each grade."""
    tails = [t for company in companies for t in (company, *[f"{company} {g}" for g in grades])]
    return _cross(terms, tails)


def condition_terms(terms: Column, conditions: Sequence[str] = ("mint", "near mint", "nm", "lp", "light played")) -> Column:
    return _cross(terms, conditions)


def _cross(terms: Column, tails: Sequence[str]) -> Column:
    endings = F.array(*[F.lit(t) for t in tails])
    return F.flatten(F.transform(terms, lambda t: F.transform(endings, lambda e: F.concat_ws(" ", t, e))))


def set_variations(set_name: Column) -> Column:
    """Known abbreviations of a set, else the name, its acronym and its first word."""
    low = F.lower(F.trim(set_name))
    words = F.split(F.trim(set_name), r"\s+")
    acronym = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    many = F.size(words) > 1
    unknown = _array([set_name, F.when(many, acronym), F.when(many, F.get(words, F.lit(0)))])
    chain = None
    for key, forms in fixed.SET_ABBREVIATIONS.items():
        value = F.array(*[F.lit(f) for f in forms])
        chain = F.when(low == key, value) if chain is None else chain.when(low == key, value)
    return chain.otherwise(unknown)


def name_variants(name: Column) -> Column:
    """The bare name, the name with TCG, and the name without its type suffix."""
    plain = F.trim(name)
    terms = [plain, _term(plain, "TCG")]
    for suffix in fixed.CARD_SUFFIXES:
        quoted = suffix.replace(".", r"\.")
        without = F.regexp_replace(plain, rf"(?i)\s*{quoted}\s*$", "")
        terms.append(F.when(
            F.lower(plain).contains(suffix.lower()) & (without != plain), _term(without, "pokemon card")
        ))
    return _array(terms)


# -- platform terms ------------------------------------------------------------------------------


def platform_card_terms(platform: str, name: Column, set_name: Column, number: Column) -> Column:
    has_set, has_number = _has(set_name), _has(number)
    both = has_set & has_number
    if platform == "pricecharting":
        bracket = F.concat(F.lit("("), set_name, F.lit(")"))
        return _array([
            _term(name, number, when=has_number),
            _term(name, set_name, number, when=both),
            _term(name, bracket, number, when=both),
            _term(name, bracket, when=has_set),
            _term(name, "-", set_name, when=has_set),
            _term(name),
        ])
    if platform == "ebay":
        terms = [_term(name, number, set_name, tail, when=both) for tail in ("near mint", "nm", "mint")]
        for tail in ("psa 10", "psa 9", "bgs 10", "cgc 10"):
            terms.append(F.when(both, _term(name, number, set_name, tail)).when(has_set, _term(name, set_name, tail)))
        terms.append(F.when(both, _term(name, number, set_name)).when(has_set, _term(name, set_name)))
        return _array(terms)
    return _array([_term(name), _term(name, set_name, when=has_set), _term(name, "TCG")])


def platform_sealed_terms(platform: str, name: Column, set_name: Column, kind: Column) -> Column:
    low = F.lower(name)
    both = _has(set_name) & _has(kind)
    box, elite = low.contains("booster box"), low.contains("elite trainer")
    if platform == "pricecharting":
        return _array([
            _term(name),
            _term(set_name, kind, when=both),
            _term(set_name, "Booster Box", when=box),
            _term(set_name, "Box", when=box),
            _term(set_name, "Elite Trainer Box", when=elite),
            _term(set_name, "ETB", when=elite),
        ])
    if platform == "ebay":
        base = F.when(both, _term(set_name, kind)).otherwise(name)
        return _array([
            *[_term(base, tail) for tail in ("factory sealed", "sealed english", "new sealed", "sealed new")],
            *[_term(set_name, tail, when=box) for tail in (
                "booster box factory sealed", "booster box english sealed", "booster box new", "display box sealed")],
            *[_term(set_name, tail, when=elite) for tail in (
                "elite trainer box sealed", "ETB factory sealed", "ETB new sealed")],
            base,
        ])
    return _array([_term(name), _term(set_name, kind, when=both), _term(name, "sealed")])


def clean_terms(terms: Column) -> Column:
    """Blanks squeezed, terms under three characters dropped, first of equal terms kept
    (ignoring case)."""
    kept = squeezed_terms(terms)
    return first_terms(kept, F.transform(kept, F.lower))


def squeezed_terms(terms: Column) -> Column:
    squeezed = F.transform(terms, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.filter(squeezed, lambda t: F.length(t) >= 3)


def first_terms(kept: Column, lowered: Column) -> Column:
    """The first of equal terms; ``lowered`` is asked for every term, so it had better be a stored column."""
    return F.filter(kept, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with more columns, each computed once per row: expressions are not moved through a generator."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns], *[c.alias(n) for n, c in columns.items()]))))


def _ordered(terms: Column, priority) -> Column:
    """Stable sort of the terms by a priority number."""
    keyed = F.transform(
        terms, lambda t, i: F.struct(priority(t).alias("p"), i.alias("i"), t.alias("t"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def by_specificity(terms: Column, set_name: Column, number: Column) -> Column:
    """Terms with set and number first, then those with either, then the rest."""
    def priority(term: Column) -> Column:
        has_set = _has(set_name) & F.lower(term).contains(F.lower(F.coalesce(set_name, F.lit(""))))
        has_number = _has(number) & term.contains(F.coalesce(number, F.lit("")))
        return F.when(has_set & has_number, 0).when(has_set | has_number, 1).otherwise(2)

    return _ordered(F.array_distinct(terms), priority)


def by_platform(terms: Column, platform: str, name: Column, number: Column) -> Column:
    """Platform order: numbered then exact terms, or condition then sealed-state terms."""
    def priority(term: Column) -> Column:
        low = F.lower(term)
        if platform == "pricecharting":
            numbered = _has(number) & term.contains(F.coalesce(number, F.lit("")))
            return F.when(numbered, 0).when(F.trim(term) == F.trim(name), 1).otherwise(2)
        if platform == "ebay":
            return (
                F.when(any_contains(low, fixed.CONDITION_KEYWORDS), 0)
                .when(any_contains(low, fixed.SEALED_STATE_KEYWORDS), 1)
                .otherwise(2)
            )
        return F.lit(0)

    return _ordered(terms, priority)


# -- plans -----------------------------------------------------------------------------------------


def search_items(cards: DataFrame, sealed: DataFrame) -> DataFrame:
    """Cards and sealed products in one shape for planning."""
    none = F.lit(None).cast("string")
    return cards.select(
        F.col("card_id").alias("item_id"), F.lit("card").alias("item_type"), F.col("card_name").alias("item_name"),
        "set_name", "card_number", none.alias("product_type"),
    ).unionByName(sealed.select(
        F.col("sealed_product_id").alias("item_id"), F.lit("sealed_product").alias("item_type"),
        F.col("product_name").alias("item_name"), "set_name", none.alias("card_number"), "product_type",
    ))


def search_plan(items: DataFrame, platform: str | None = None, max_terms: int = 3) -> DataFrame:
    """The first ``max_terms`` terms of every item, in priority order.

    Without a platform the plain generator is used, else the platform's own terms.
    """
    name, set_name = F.col("item_name"), F.coalesce(F.col("set_name"), F.lit(""))
    number, kind = F.coalesce(F.col("card_number"), F.lit("")), F.coalesce(F.col("product_type"), F.lit(""))
    sealed = F.col("item_type") == "sealed_product"
    terms = F.col("_terms")
    if platform is None:
        plain = F.when(sealed, sealed_terms(name, set_name, kind)).otherwise(card_terms(name, set_name, number))
        rows = _once(items, _terms=plain)
        ordered = by_specificity(terms, set_name, F.when(~sealed, number).otherwise(""))
    else:
        own = F.when(sealed, platform_sealed_terms(platform, name, set_name, kind)).otherwise(
            platform_card_terms(platform, name, set_name, number))
        rows = _once(items, _terms=squeezed_terms(own))
        rows = _once(rows, _lowered=F.transform(terms, F.lower))
        ordered = by_platform(first_terms(terms, F.col("_lowered")), platform, name, F.when(~sealed, number).otherwise(""))
    rows = _once(rows, search_terms=F.slice(ordered, 1, max_terms)).select(*[F.col(f"`{c}`") for c in items.columns], "search_terms")
    return rows.withColumn("term_count", F.size("search_terms").cast("bigint"))


def plan_terms(plan: DataFrame) -> DataFrame:
    """One row per item and chosen term, with its position."""
    return plan.select(
        "item_id", "item_type", "item_name", F.posexplode("search_terms").alias("position", "search_term")
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    sealed = F.col("item_type") == "sealed_product"
    return plan.agg(
        F.count("*").alias("total_items"),
        F.coalesce(F.sum("term_count"), F.lit(0)).alias("total_searches"),
        F.count_if(~sealed).alias("cards_count"),
        F.count_if(sealed).alias("sealed_products_count"),
    )
