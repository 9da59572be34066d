"""Price bounds, title rules, IQR outliers and quality gates for listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.functions.numbers import flag, half_up, ratio, total
from gavelwork.operators.histogram import exclusive_quartiles, price_histogram
from gavelwork.rules import fixed


# -- price bounds and titles ----------------------------------------------------------------


def by_kind(build, name: str = "product_name", product_type: str = "product_type") -> Column:
    """An expression that depends on the product kind, ``build(kind)``.

    Each name pattern is tested once and leads straight to the rules of its kind. (With
    the kind as a column, every rule would repeat the whole classification once a filter
    on the result is pushed towards the scan.)
    """
    low = F.lower(F.col(name))
    tail = F.when(F.col(product_type) == "card", build("card")).otherwise(build(fixed.DEFAULT_SEALED_KIND))
    return text.first_match([(text.matches(low, p), build(k)) for p, k in fixed.KIND_PATTERNS], tail)


def with_kind(listings: DataFrame) -> DataFrame:
    """Product kind from the product's name and type."""
    return listings.withColumn("kind", text.product_kind(F.col("product_name"), F.col("product_type")))


def price_in_bounds(price: Column, kind: str, bounds: Mapping = fixed.PRICE_BOUNDS) -> Column:
    low, high = bounds.get(kind, bounds[fixed.FALLBACK_KIND])
    return price.between(F.lit(low), F.lit(high))


def suspicious_title(title: Column, kind: str, patterns: Mapping = fixed.SUSPICIOUS_TITLES,
                     required: Mapping = fixed.REQUIRED_WORDS) -> Column:
    """A title with a bad pattern of the kind, or without the words the kind requires."""
    low = F.lower(title)
    test = text.any_matches(low, patterns[kind]) if kind in patterns else F.lit(False)
    if kind == "booster_box":
        test = test | ~(
            low.contains("booster box")
            | text.all_contain(low, ("box", "booster"))
            | ((low.contains("36") | low.contains("24")) & low.contains("pack"))
        )
    elif kind in required:
        test = test | ~text.all_contain(low, required[kind])
    return test


def rule_reason(bounds: Mapping = fixed.PRICE_BOUNDS, patterns: Mapping = fixed.SUSPICIOUS_TITLES,
                title_sources: Sequence[str] = ("ebay",), kind: str | None = None) -> Column:
    """price_threshold, title_pattern or NULL (kept). ``kind`` forces one kind's rules."""
    checked = F.col("title").isNotNull() & F.col("source").isin(*title_sources)

    def reason(k: str) -> Column:
        return F.when(~price_in_bounds(F.col("price"), k, bounds), "price_threshold").when(
            checked & suspicious_title(F.col("title"), k, patterns), "title_pattern"
        )

    return by_kind(reason) if kind is None else reason(kind)


def rule_stage(listings: DataFrame, **rules) -> DataFrame:
    """Adds ``rule_reason`` to every listing."""
    return listings.withColumn("rule_reason", rule_reason(**rules))


# -- IQR outliers -----------------------------------------------------------------------------

PRODUCT = ["product_type", "product_id"]
GROUP = [*PRODUCT, "source", "condition_category"]


def iqr_bounds(rows: DataFrame, keys: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Quartiles (exclusive method) and outlier limits per group."""
    spread = F.col("q3") - F.col("q1")
    return (
        exclusive_quartiles(price_histogram(rows, keys), keys)
        .withColumn("lower_bound", F.col("q1") - multiplier * spread)
        .withColumn("upper_bound", F.col("q3") + multiplier * spread)
    )


def group_limits(rows: DataFrame, product: Sequence[str] = PRODUCT, group: Sequence[str] = GROUP,
                 multiplier: float = 1.5, min_total: int = 5, min_group: int = 3) -> DataFrame:
    """Outlier limits of the groups that are large enough, one row per group.

    Only where a product has at least ``min_total`` rows and the group ``min_group``.
    """
    limits = iqr_bounds(rows, group, multiplier).withColumn(
        "_product_rows", F.sum("n_total").over(Window.partitionBy(*product))
    )
    return limits.filter((F.col("n_total") >= min_group) & (F.col("_product_rows") >= min_total)).select(
        *group, "lower_bound", "upper_bound"
    )


def join_groups(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on the keys where NULL is a value of its own, as it is in a grouping."""
    renamed = other.select([F.col(c).alias(f"_by_{c}") if c in keys else F.col(c) for c in other.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]
    return rows.join(renamed, same, how).drop(*[f"_by_{k}" for k in keys])


def _with_limits(rows: DataFrame, limits: DataFrame, group: Sequence[str]) -> DataFrame:
    price = F.col("price").cast("double")
    return join_groups(rows, limits, group).withColumn(
        "stat_reason",
        F.when(price < F.col("lower_bound"), "extreme_low").when(price > F.col("upper_bound"), "extreme_high"),
    )


def with_statistical_reason(rows: DataFrame, product: Sequence[str] = PRODUCT, group: Sequence[str] = GROUP,
                            multiplier: float = 1.5, min_total: int = 5, min_group: int = 3) -> DataFrame:
    """Adds ``stat_reason`` (extreme_low, extreme_high or NULL) to every row.

    The join partner of a hot group is a single row of limits, so a hot group can be
    split over tasks.
    """
    return _with_limits(rows, group_limits(rows, product, group, multiplier, min_total, min_group), group)


def filter_listings(listings: DataFrame, **rules) -> DataFrame:
    """Every listing with the reason it is removed for; ``removed_by`` NULL means kept.

    Rules come first; the outlier limits are taken from what the rules keep.
    """
    staged = rule_stage(listings, **rules)
    limits = group_limits(keep_where(staged, F.col("rule_reason").isNull()))
    judged = _with_limits(staged, limits, GROUP)
    return judged.withColumn(
        "stat_reason", F.when(F.col("rule_reason").isNull(), F.col("stat_reason"))
    ).withColumn("removed_by", F.coalesce("rule_reason", F.when(F.col("stat_reason").isNotNull(), "statistical")))


def keep_where(rows: DataFrame, test: Column) -> DataFrame:
    """Rows that pass a costly test, by exploding a one-element array.

    A filter would be pushed through the projections below it, where every mention of a
    computed column in the test works that column out again.
    """
    return rows.withColumn("_kept", F.explode(F.when(test, F.array(F.lit(1))))).drop("_kept")


def clean_listings(listings: DataFrame, **rules) -> DataFrame:
    """The listings that pass price bounds, title rules and the outlier limits."""
    passed = keep_where(listings, rule_reason(**rules).isNull())
    return with_statistical_reason(passed).filter(F.col("stat_reason").isNull()).drop(
        "stat_reason", "lower_bound", "upper_bound"
    )


def filter_counts(listings: DataFrame, multiplier: float = 1.5, min_total: int = 5, min_group: int = 3,
                  by: Sequence[str] = (), **rules) -> DataFrame:
    """Listings counted by kind, group, price, removal reason and the further columns ``by``.

    The outcome of a listing depends on its group, price and rule reason only, so the
    limits are found and applied on the counted rows: one scan, no join, and no listing
    row is shuffled. Everything the filter reports is read off this table.
    """
    counts = (
        rule_stage(with_kind(listings), **rules)
        .groupBy(*GROUP, "kind", "rule_reason", "price", *by)
        .agg(F.count("*").alias("n_rows"))
    )
    passed = F.when(F.col("rule_reason").isNull(), F.col("n_rows")).otherwise(0)
    product, whole = Window.partitionBy(*PRODUCT), Window.partitionBy(*GROUP)
    by_price = whole.orderBy("price", "kind", "rule_reason", *by).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({
        "_price": F.col("price").cast("double"), "_passed": passed,
    }).withColumn("_product_rows", F.sum("_passed").over(product)).withColumns({
        "_upto": F.sum("_passed").over(by_price), "_n": F.sum("_passed").over(whole),
    })
    n, upto = F.col("_n"), F.col("_upto")

    def rank(i: int) -> Column:
        return F.greatest(F.lit(1), F.least(F.floor((n + 1) * i / 4), n - 1))

    def value_at(position: Column) -> Column:
        inside = (F.col("_passed") > 0) & (upto >= position) & (upto - F.col("_passed") < position)
        return F.max(F.when(inside, F.col("_price"))).over(whole)

    def quartile(i: int) -> Column:
        weight = (n + 1) * i - rank(i) * 4
        return (value_at(rank(i)) * (4 - weight) + value_at(rank(i) + 1) * weight) / 4

    limited = ranked.withColumns({"_q1": quartile(1), "_q3": quartile(3)})
    spread = F.col("_q3") - F.col("_q1")
    judged = F.col("rule_reason").isNull() & (n >= min_group) & (F.col("_product_rows") >= min_total)
    reason = (
        F.when(judged & (F.col("_price") < F.col("_q1") - multiplier * spread), "extreme_low")
        .when(judged & (F.col("_price") > F.col("_q3") + multiplier * spread), "extreme_high")
    )
    return limited.withColumn("stat_reason", reason).select(
        *GROUP, "kind", *by, "price", "n_rows", "stat_reason",
        F.coalesce("rule_reason", F.when(F.col("stat_reason").isNotNull(), "statistical")).alias("removed_by"),
    )


def filter_report(counts: DataFrame) -> DataFrame:
    """Rows and price range per kind and removal reason, from :func:`filter_counts`."""
    return (
        counts.filter(F.col("removed_by").isNotNull())
        .groupBy("kind", "removed_by", "stat_reason")
        .agg(
            F.sum("n_rows").alias("removed"),
            F.min("price").cast("double").alias("lowest_price"),
            F.max("price").cast("double").alias("highest_price"),
        )
    )


def removed_prices(counts: DataFrame) -> DataFrame:
    """Prices removed per class with their row counts: the price lists in bounded form."""
    removal = F.when(F.col("removed_by") == "statistical", "statistical").otherwise("suspicious")
    return counts.filter(F.col("removed_by").isNotNull()).groupBy(removal.alias("removal_class"), "price").agg(
        F.sum("n_rows").alias("n_rows")
    )


def filter_funnel(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows removed at each stage (price, title, statistics), rows kept, shares of the original."""
    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n_rows"))), F.lit(0))

    by = F.col("removed_by")
    sums = counts.groupBy(*keys).agg(
        F.sum("n_rows").alias("original_count"),
        rows(by == "price_threshold").alias("price_removed"),
        rows(by == "title_pattern").alias("title_removed"),
        rows(by == "statistical").alias("stat_removed"),
        rows(by.isNull()).alias("final_count"),
    )
    names = ("price_removed", "title_removed", "stat_removed", "final_count")
    shares = [half_up(ratio(F.col(c), F.col("original_count")) * 100, 2).alias(f"{c}_pct") for c in names]
    return sums.select("*", *shares)


def card_outliers(listings: DataFrame, min_group: int = 5) -> DataFrame:
    """Listings outside 1.5 (moderate) or 3 (extreme) quartile spreads of card x condition."""
    keys = ["product_type", "product_id", "normal_condition"]
    keys = keys if "product_type" in listings.columns else keys[1:]
    rows = listings.filter(F.col("product_id").isNotNull() & (F.col("price") > 0)).withColumn(
        "normal_condition", text.normal_condition(F.col("condition"))
    )
    spread = F.col("q3") - F.col("q1")
    limits = exclusive_quartiles(price_histogram(rows, keys), keys).filter(F.col("n_total") >= min_group).select(
        *keys, "q1", "q3", "median",
        (F.col("q1") - 1.5 * spread).alias("lower_bound"),
        (F.col("q3") + 1.5 * spread).alias("upper_bound"),
        (F.col("q1") - 3 * spread).alias("_extreme_low"),
        (F.col("q3") + 3 * spread).alias("_extreme_high"),
    )
    price = F.col("price").cast("double")
    flagged = join_groups(rows, limits, keys, "inner").withColumn(
        "outlier_type",
        F.when((price < F.col("_extreme_low")) | (price > F.col("_extreme_high")), "extreme")
        .when((price < F.col("lower_bound")) | (price > F.col("upper_bound")), "moderate"),
    )
    return (
        flagged.filter(F.col("outlier_type").isNotNull())
        .withColumn(
            "expected_range", F.format_string("$%.2f - $%.2f", F.col("lower_bound"), F.col("upper_bound"))
        )
        .drop("_extreme_low", "_extreme_high")
    )


# -- quality gates -----------------------------------------------------------------------------


def _invalid_category(title: Column, rules: Mapping) -> Column:
    """First rule class with a pattern in the title."""
    return text.first_match([(text.any_alone(title, p), F.lit(c)) for c, p in rules.items()])


def _hits(title: Column, patterns: Sequence[str]) -> Column:
    return total([flag(text.matches(title, p)) for p in patterns])


def _staged(listings: DataFrame, rules: Mapping) -> tuple[DataFrame, Column, Column]:
    """Listings with what the rule rows find in their titles; the title and price that gates test.

    The title in lower case is a column: as an expression it would be worked out for every word and pattern.
    """
    title = F.col("_low")
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    staged = listings.withColumn("_low", F.lower(F.coalesce(F.col("title"), F.lit("")))).withColumns({
        "_invalid": _invalid_category(title, rules["invalid"]),
        "_named": text.any_contains(title, rules["names"]),
        "_valid": _hits(title, rules["valid"]),
    })
    return staged, title, price


def _first_reason(title: Column, price: Column, own: Sequence[tuple[Column, object]]) -> Column:
    """The first rule that fails: those of all gates around the gate's own."""
    return text.first_match([
        (title == "", F.lit("No title")),
        (F.col("_invalid").isNotNull(), F.concat(F.lit("Invalid: "), F.col("_invalid"))),
        (price <= 0, F.lit("Invalid price")),
        (price < 0.5, F.lit("Price too low (likely damaged/fake)")),
        *own,
        (F.length(title) < 10, F.lit("Title too short")),
        (F.length(title) - F.length(F.replace(title, F.lit(" "), F.lit(""))) < 2, F.lit("Title too simple")),
    ], F.lit("Passed quality checks"))


#: Rule rows of the two gates; a caller's own mapping with the same keys takes their place.
RULES_V2 = {
    "invalid": fixed.GATE_V2_INVALID, "names": fixed.GATE_V2_NAMES, "valid": fixed.GATE_V2_VALID,
    "indicators": fixed.GATE_V2_INDICATORS,
}
RULES_V1 = {
    "invalid": fixed.GATE_V1_INVALID, "names": fixed.GATE_V1_NAMES, "valid": fixed.GATE_V1_VALID,
    "card_types": fixed.GATE_V1_CARD_TYPES,
}


def gate_v2(listings: DataFrame, expected: str | None = "product_name", sealed: Column | None = None,
            rules: Mapping = RULES_V2) -> DataFrame:
    """Quality gate for cards and sealed products.

    Adds ``is_valid``, ``reason``, ``reason_class``, ``invalid_category`` and
    ``quality_score``. The first failing rule names the reason.
    """
    is_sealed = F.lit(False) if sealed is None else sealed
    wanted = F.lit(None).cast("string") if expected is None else F.lower(F.col(expected))
    staged, title, price = _staged(listings.withColumn("_want", wanted), rules)
    staged = staged.withColumns({
        "_indicators": _hits(title, rules["indicators"]),
        "_match": F.lit(None).cast("double") if expected is None else text.low_match_score(title, F.col("_want")),
    })
    named, indicators, match = F.col("_named"), F.col("_indicators"), F.col("_match")
    mismatch = F.lit(None).cast("string") if expected is None else F.concat(
        F.lit("Item name mismatch: expected '"), F.col(expected), F.lit("' not well matched")
    )
    reason = _first_reason(title, price, [
        (match < 0.3, mismatch),
        (~named & (indicators == 0) & is_sealed, F.lit("No Pokemon indicators found for sealed product")),
        (~named & (indicators == 0), F.lit("No Pokemon name or 'pokemon' found in title")),
    ])
    score = (
        F.lit(0.4)
        + F.when(named, 0.3).otherwise(0.0)
        + F.least(indicators * 0.1, F.lit(0.3))
        + F.when(match > 0.7, 0.2).otherwise(0.0)
        + F.least(F.col("_valid") * 0.05, F.lit(0.2))
    )
    return _verdict(staged, reason, F.least(score, F.lit(1.0)), {
        "No title": 1.0, "Invalid": 0.9, "Invalid price": 0.8, "Price too low (likely damaged/fake)": 0.7,
        "Item name mismatch": 0.8, "No Pokemon indicators found for sealed product": 0.7,
        "No Pokemon name or 'pokemon' found in title": 0.8, "Title too short": 0.7, "Title too simple": 0.6,
    })


def gate_v1(listings: DataFrame, expected: str | None = "product_name", rules: Mapping = RULES_V1) -> DataFrame:
    """Stricter gate for single cards; the score has no upper cap."""
    staged, title, price = _staged(listings, rules)
    types = F.lit(False)
    for kind in rules["card_types"]:
        types = types | title.contains(f" {kind}") | title.contains(f"{kind} ")
    contained = F.lit(False) if expected is None else title.contains(F.lower(F.col(expected)))
    named, word = F.col("_named"), title.contains("pokemon")
    mismatch = F.lit(None).cast("string") if expected is None else F.concat(
        F.lit("Card name mismatch: expected '"), F.col(expected), F.lit("' not found in title")
    )
    reason = _first_reason(title, price, [
        (F.lit(expected is not None) & ~contained, mismatch),
        (~named & ~word, F.lit("No Pokemon name or 'pokemon' found in title")),
    ])
    score = (
        F.lit(0.5)
        + F.when(named, 0.2).otherwise(0.0)
        + F.when(types, 0.1).otherwise(0.0)
        + F.least(F.col("_valid") * 0.1, F.lit(0.3))
        + F.when(word, 0.1).otherwise(0.0)
        + F.when(contained, 0.2).otherwise(0.0)
    )
    return _verdict(staged, reason, score, {
        "No title": 1.0, "Invalid": 0.9, "Invalid price": 0.8, "Price too low (likely damaged/fake)": 0.7,
        "Card name mismatch": 0.9, "No Pokemon name or 'pokemon' found in title": 0.8,
        "Title too short": 0.7, "Title too simple": 0.6,
    })


def reason_class(reason: Column) -> Column:
    """Reason before " - ", then before ":"; all regex classes fold into "Invalid"."""
    return F.substring_index(F.substring_index(reason, " - ", 1), ":", 1)


def _verdict(staged: DataFrame, reason: Column, score: Column, confidence: Mapping[str, float]) -> DataFrame:
    passed = F.col("reason") == "Passed quality checks"
    return (
        staged.withColumn("reason", reason)
        .withColumn("reason_class", F.when(~passed, reason_class(F.col("reason"))))
        .withColumn("is_valid", passed)
        .withColumn(
            "quality_score",
            F.when(passed, half_up(score, 4)).otherwise(text.lookup(F.col("reason_class"), confidence)),
        )
        .withColumnRenamed("_invalid", "invalid_category")
        .drop("_indicators", "_named", "_valid", "_match", "_low", "_want")
    )


def rejection_stats(gated: DataFrame) -> DataFrame:
    """Rejected listings per reason class and regex category.

    Rejections are counted, not filtered: a filter would be pushed below the gate and
    run all its rules a second time.
    """
    counts = gated.groupBy("reason_class", "invalid_category").agg(F.count_if(~F.col("is_valid")).alias("rejected"))
    return counts.filter(F.col("rejected") > 0)


# -- titles against the catalog ------------------------------------------------------------------


def title_mismatches(listings: DataFrame) -> DataFrame:
    """Listings whose title disagrees with their card: up to four reasons, confidence = count.

    Needs ``card_name``, ``set_name``, ``card_number`` beside the listing. Rows without a
    reason are dropped by exploding, not by a filter: a filter would be pushed below the
    cleaned names and work them out again for every test.
    """
    blank = F.lit("")
    present = (F.coalesce("card_name", blank) != "") & (F.coalesce("title", blank) != "")
    cleaned = listings.filter(present).withColumns({
        "_name": text.clean_name(F.col("card_name")),
        "_title": text.clean_name(F.col("title")),
        "_set": text.clean_name(F.col("set_name")),
        "_numbers": text.title_numbers(F.col("title")),
        "_low": F.lower("title"),
    })
    name, title, wanted_set, numbers = (F.col(c) for c in ("_name", "_title", "_set", "_numbers"))
    named = cleaned.withColumns({"_expected": text.main_name(name), "_found": text.main_name(title)})
    expected, found = F.col("_expected"), F.col("_found")
    set_differs = (
        (F.length("set_name") > 3)
        & ~title.contains(wanted_set)
        & text.has_set_phrase(F.col("_low"))
        & ~text.fuzzy_match(wanted_set, title)
    )
    number_differs = (
        (F.coalesce(F.col("card_number"), blank) != "")
        & (F.size(numbers) > 0)
        & ~F.array_contains(numbers, F.col("card_number"))
    )
    reasons = F.array_compact(F.array(
        F.when(~text.fuzzy_match(name, title), "Card name not found in title"),
        F.when(
            (expected != "") & (found != "") & (expected != found),
            F.concat(F.lit("Different Pokemon: expected "), expected, F.lit(", found "), found),
        ),
        F.when(set_differs, F.concat(F.lit("Potential set mismatch: expected "), F.col("set_name"))),
        F.when(number_differs, F.concat(F.lit("Card number mismatch: expected "), F.col("card_number"))),
    ))
    judged = named.withColumn("_reasons", reasons).drop(
        "_name", "_title", "_set", "_numbers", "_low", "_expected", "_found"
    )
    return (
        judged.withColumn("mismatch_reasons", F.explode(F.when(F.size("_reasons") > 0, F.array("_reasons"))))
        .drop("_reasons")
        .withColumn("confidence", F.size("mismatch_reasons").cast("bigint"))
    )


def worst_mismatches(mismatches: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    return mismatches.filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "listing_id").limit(limit)
