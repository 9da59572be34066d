"""Names, titles, prices and dates as they appear in listing text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelwork.rules import fixed


def literal_words(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def any_contains(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains any of the words (plain substrings)."""
    return F.exists(literal_words(words), lambda w: text.contains(w))


def all_contain(text: Column, words: Iterable[str]) -> Column:
    test = F.lit(True)
    for word in words:
        test = test & text.contains(word)
    return test


def required_literal(pattern: str) -> str:
    """A piece of plain text every match of the pattern must contain, or empty text.

    The longest run of letters outside groups, classes and optional characters.
    """
    plain = pattern
    while True:
        fewer = re.sub(r"\([^()]*\)[?*+]?", "#", plain)
        if fewer == plain:
            break
        plain = fewer
    if "|" in plain:
        return ""
    plain = re.sub(r"\[[^\]]*\][?*+]?", "#", plain)
    plain = re.sub(r"\\.[?*+]?", "#", plain)
    plain = re.sub(r".[?*]", "#", plain)
    return max(re.findall(r"[a-z/ -]+", plain), key=lambda run: len(run.strip()), default="").strip()


def matches(text: Column, pattern: str) -> Column:
    """Regex test on lower-case text, tried only where the pattern's literal part occurs.

    A substring test costs a fraction of a regex search, and most rules do not apply to
    most titles. Patterns without any regex syntax need no regex at all.
    """
    if re.fullmatch(r"[a-z0-9 |]+", pattern):
        return any_contains(text, pattern.split("|"))
    literal = required_literal(pattern)
    return text.contains(literal) & text.rlike(pattern) if literal else text.rlike(pattern)


def any_matches(text: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern is found: one regex for all of them, tried only on texts that
    hold the literal part of one."""
    patterns = list(patterns)
    literals = list(dict.fromkeys(required_literal(p) for p in patterns))
    found = text.rlike("|".join(f"(?:{p})" for p in patterns))
    return found if "" in literals else F.exists(literal_words(literals), lambda w: text.contains(w)) & found


def any_alone(text: Column, patterns: Iterable[str]) -> Column:
    """:func:`any_matches` with a search for each pattern: a text that holds the literal part of one is searched for that one alone,
    not for all of them at every position.

    The text is tested many times, so it should be a column, not an expression to be worked out for every test.
    """
    by_literal: dict[str, list[str]] = {}
    for pattern in patterns:
        by_literal.setdefault(required_literal(pattern), []).append(pattern)
    test = F.lit(False)
    for literal, same in by_literal.items():
        found = text.rlike("|".join(f"(?:{p})" for p in same))
        test = test | (text.contains(literal) & found if literal else found)
    return test


def first_match(tests: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    chain = None
    for test, value in tests:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL when there is no match."""
    return empty_to_null(F.regexp_extract(text, pattern, group))


def product_key(product_type: str = "product_type", product_id: str = "product_id") -> Column:
    """Key of a product in series and analyses: card n and sealed product n are two products."""
    return F.concat_ws("-", product_type, F.col(product_id).cast("string"))


# -- prices and dates ------------------------------------------------------------------


def clean_price(text: Column) -> Column:
    """Number in a price text; 0 when none.

    A range ("$1 to $2") takes its first part; a lone comma followed by exactly two
    digits is a decimal comma, any other comma groups thousands.
    """
    first = F.when(F.lower(text).contains("to"), F.split(text, "to")[0]).otherwise(text)
    digits = F.regexp_replace(first, r"[^\d.,]", "")
    has_comma, has_dot = digits.contains(","), digits.contains(".")
    after_comma = F.get(F.split(digits, ","), F.lit(1))
    normal = (
        F.when(has_comma & ~has_dot & (F.length(after_comma) == 2), F.replace(digits, F.lit(","), F.lit(".")))
        .otherwise(F.replace(digits, F.lit(","), F.lit("")))
    )
    return F.coalesce(normal.try_cast("double"), F.lit(0.0))


# Accepted date texts, tried in this order (shape test, parse pattern).
DATE_FORMATS = (
    (r"^[A-Za-z]{3} +\d{1,2}, +\d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3} +\d{1,2} +\d{4}$", "MMM d yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
)


def parse_sale_date(text: Column, year: Column) -> Column:
    """Sale date text to timestamp; NULL when no format fits.

    ``year`` is used for texts such as "Jun 28".
    """
    plain = F.trim(F.regexp_replace(F.trim(text), r"(?i)^(Sold|Ended)\s*", ""))
    plain = F.regexp_replace(plain, r"\s+", " ")
    month_day = F.initcap(F.lower(plain))

    def attempt(shape: str, pattern: str) -> Column:
        value = F.try_to_timestamp(month_day if pattern.startswith("MMM") else plain, F.lit(pattern))
        if pattern.endswith("/yy"):
            # two-digit years from 69 on belong to the last century
            value = F.when(F.year(value) >= 2069, value - F.expr("INTERVAL 100 YEARS")).otherwise(value)
        return F.when(plain.rlike(shape), value)

    tries = [attempt(shape, pattern) for shape, pattern in DATE_FORMATS]
    with_year = F.concat_ws(" ", month_day, year.cast("string"))
    tries.append(
        F.when(
            plain.rlike(r"^[A-Za-z]{3} +\d{1,2}$"),
            F.try_to_timestamp(with_year, F.lit("MMM d yyyy")),
        )
    )
    return F.coalesce(*tries)


def sold_text(text: Column) -> Column:
    """The sale-date part of free listing text; first pattern that matches."""
    return F.coalesce(*[extract(text, p) for p in fixed.SOLD_TEXT_PATTERNS])


# -- titles ----------------------------------------------------------------------------


def grading_company(title: Column) -> Column:
    return F.upper(F.regexp_extract(title, fixed.GRADE_PATTERN, 1))


def grade(title: Column) -> Column:
    return F.regexp_extract(title, fixed.GRADE_PATTERN, 2)


def is_graded(title: Column) -> Column:
    return F.coalesce(title.rlike(fixed.GRADE_PATTERN), F.lit(False))


def card_number(title: Column) -> Column:
    """First ``n/m`` in the title, empty text when none."""
    return F.regexp_extract(title, fixed.CARD_NUMBER_PATTERN, 0)


def title_numbers(title: Column) -> Column:
    """Every ``n/m`` in the title."""
    return F.regexp_extract_all(title, F.lit(r"\b\d+/\d+\b"), F.lit(0))


def title_set(title: Column, patterns=fixed.TITLE_SETS) -> Column:
    low = F.lower(title)
    return first_match([(matches(low, p), F.lit(name)) for name, p in patterns], F.lit(""))


def title_name(title: Column, names=fixed.TITLE_NAMES) -> Column:
    """First known name in the title, else a capitalised word before or after a marker."""
    low = F.lower(title)
    known = first_match([(low.contains(n), F.lit(n.title())) for n in names])
    guesses = [extract(title, p) for p in fixed.TITLE_NAME_PATTERNS]
    return F.coalesce(known, *guesses, F.lit(""))


def condition_slot(graded: Column, condition_category: Column) -> Column:
    """graded / sealed / raw, the condition part of a series key."""
    return (
        F.when(graded, "graded").when(condition_category == "sealed", "sealed").otherwise("raw")
    )


def normal_condition(condition: Column) -> Column:
    """Eight condition classes; the order of the tests matters."""
    low = F.lower(F.trim(F.coalesce(condition, F.lit(""))))
    return (
        F.when(low.contains("psa 10"), "PSA 10")
        .when(low.contains("psa 9"), "PSA 9")
        .when(low.contains("psa"), "PSA Other")
        .when(low.contains("bgs"), "BGS")
        .when(low.contains("cgc"), "CGC")
        .when(low.isin("new (other)", "new", "mint"), "Raw NM")
        .when(low.isin("pre-owned", "used"), "Raw Used")
        .otherwise("Other")
    )


def search_strategy(terms: Column, sealed: Column) -> Column:
    """How a listing was searched for, from the search terms."""
    low = F.lower(terms)
    card = F.when(low.contains("psa 10"), "psa_10").when(low.contains("psa 9"), "psa_9").otherwise("raw_nm")
    box = (
        F.when(low.contains("elite trainer box"), "sealed_etb")
        .when(low.contains("collection box"), "sealed_collection")
        .otherwise("sealed_box")
    )
    return F.when(sealed, box).otherwise(card)


def whole_grade(text: Column) -> Column:
    """Grade as integer; "9.5" is not a whole number and gives NULL."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


# -- names -------------------------------------------------------------------------------


def clean_name(name: Column) -> Column:
    """Lower case, every non-word character a space, spaces squeezed."""
    spaced = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def main_name(clean: Column, names=fixed.MAIN_NAMES) -> Column:
    """First known name in a cleaned text (:func:`clean_name`), else its first word.

    The names are an array, not a branch each: with the branches the method made for a plan with two texts
    passes the 8,000 bytes above which the JVM leaves it uncompiled.
    """
    known = F.get(F.filter(literal_words(names), lambda n: clean.contains(n)), F.lit(0))
    return F.coalesce(known, F.split(clean, " ")[0], F.lit(""))


def has_set_phrase(low: Column, phrases=fixed.SET_PHRASES) -> Column:
    """A phrase of a set in a title in lower case, a column that is not worked out anew for every phrase."""
    return any_contains(low, phrases)


def fuzzy_match(left: Column, right: Column, stop_words=fixed.MATCH_STOP_WORDS) -> Column:
    """Substring either way, or word overlap of at least 60 % of the smaller word set.

    Both sides must be cleaned already (:func:`clean_name`).
    """
    stops = literal_words(stop_words)
    a = F.array_except(F.split(left, " "), stops)
    b = F.array_except(F.split(right, " "), stops)
    overlap = F.size(F.array_intersect(a, b))
    smaller = F.least(F.size(a), F.size(b))
    return F.when((left == "") | (right == ""), False).otherwise(
        F.coalesce(
            right.contains(left) | left.contains(right)
            | (F.try_divide(overlap, smaller) >= 0.6),
            F.lit(False),
        )
    )


def name_match_score(title: Column, expected: Column, variations: Mapping = fixed.NAME_VARIATIONS) -> Column:
    """1 on containment, else matched long words / all words, + 0.2 per variation, at most 1."""
    return low_match_score(F.lower(title), F.lower(expected), variations)


def low_match_score(low: Column, want: Column, variations: Mapping = fixed.NAME_VARIATIONS) -> Column:
    """:func:`name_match_score` of texts in lower case, which are tested once per word and form."""
    words = F.filter(F.split(want, r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 2) & low.contains(w)))
    score = F.coalesce(F.try_divide(hits.cast("double"), F.size(words)), F.lit(0.0))
    for key, forms in variations.items():
        score = score + F.when(want.contains(key) & any_contains(low, forms), 0.2).otherwise(0.0)
    return F.when(low.contains(want), F.lit(1.0)).otherwise(F.least(score, F.lit(1.0)))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-zA-Z0-9]+", "-"), F.lit("-"))


def lookup(value: Column, table: Mapping, otherwise: Column | None = None) -> Column:
    """Map a column through a small rule table."""
    return first_match([(value == k, F.lit(v)) for k, v in table.items()], otherwise)


def rarity_name(rarity: Column) -> Column:
    return lookup(rarity, fixed.RARITY_NAMES, F.lower(rarity))


def series_alias(series: Column) -> Column:
    return lookup(series, fixed.SERIES_ALIASES)


def rarity_rank(rarity: Column) -> Column:
    return lookup(rarity, fixed.RARITY_RANKS, F.lit(0))


def product_kind(name: Column, product_type: Column, patterns=fixed.KIND_PATTERNS) -> Column:
    """Kind of product from its name, first pattern that matches."""
    low = F.lower(name)
    chain = first_match([(matches(low, p), F.lit(kind)) for p, kind in patterns])
    return F.coalesce(
        chain,
        F.when(product_type == "card", F.lit("card")).otherwise(F.lit(fixed.DEFAULT_SEALED_KIND)),
    )


# -- checks on scraped values ---------------------------------------------------------------


def sane_price(price: Column, strict: bool = False) -> Column:
    low, high = fixed.SCRAPED_PRICE_RANGE
    test = price.between(low, high) & (price != fixed.SUBSCRIPTION_PRICE)
    return test & ~price.isin(*fixed.NON_PRODUCT_PRICES) if strict else test


def sane_description(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return (
        (F.length(low) >= 10)
        & any_contains(low, fixed.PRODUCT_WORDS)
        & ~any_contains(low, fixed.SUBSCRIPTION_WORDS)
    )


def price_cell(text: Column, numeric_class: Column) -> Column:
    """A table cell that mostly is a price: ``$n``, no subscription words, 30 % price characters."""
    low = F.lower(text)
    kept = F.length(F.regexp_replace(text, r"[^\d.$]", ""))
    dense = F.coalesce(F.try_divide(kept.cast("double"), F.length(F.trim(text))) > 0.3, F.lit(False))
    return (
        text.rlike(r"\$\d+\.?\d*")
        & ~any_contains(low, ("subscribe", "month", "subscription"))
        & (numeric_class | dense)
    )


def price_reasonableness(price: Column, kind: Column, ranges: Mapping = fixed.TYPICAL_PRICES) -> Column:
    """0.1 outside the bounds, 1 in the typical range, 0.3-0.7 between, 0.5 for unknown kinds."""
    p = price.cast("double")

    def score(low, high, typical_low, typical_high):
        return (
            F.when((p < low) | (p > high), 0.1)
            .when(p.between(typical_low, typical_high), 1.0)
            .when(p < typical_low, 0.3 + 0.4 * (p - low) / (typical_low - low))
            .otherwise(0.3 + 0.4 * (high - p) / (high - typical_high))
        )

    return first_match([(kind == k, score(*v)) for k, v in ranges.items()], F.lit(0.5))


def liquidity_level(recent_sales: Column) -> Column:
    return F.when(recent_sales >= 20, "high").when(recent_sales >= 5, "medium").otherwise("low")


def search_url(base: str, keywords: Column, page: Column, sort: str = "12",
               min_price: Column | None = None, max_price: Column | None = None) -> Column:
    """Search address with query parameters; price bounds only where given."""
    parts = [
        F.concat(F.lit("_nkw="), F.url_encode(keywords)),
        F.lit(f"_sop={sort}"),
        F.lit("LH_Sold=1"),
        F.lit("LH_Complete=1"),
        F.concat(F.lit("_pgn="), page.cast("string")),
        F.lit("_ipg=60"),
    ]
    for name, bound in (("_udlo", min_price), ("_udhi", max_price)):
        if bound is not None:
            parts.append(F.when(bound.isNotNull() & (bound != 0), F.concat(F.lit(f"{name}="), bound.cast("string"))))
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))
