"""Price bounds, title rules, outliers, quality gates and audits."""

from pyspark.sql import functions as F

from gavelwork.functions.numbers import half_up
from gavelwork.operators import audits, decide, quality
from gavelwork.plans import analysis
from gavelwork.registry.base import (
    CARDS, LISTINGS, PRODUCT_KEY, SERIES, all_in, any_in, any_match, daily_series, day, days_as_text, hu, listings, matches,
    query, quoted, when, with_, words,
)
from gavelwork.rules import fixed
from gavelwork.sources import starviews as views


def kind_sql(name="product_name", kind="product_type"):
    pairs = [(matches(f"lower({name})", p), quoted(k)) for p, k in fixed.KIND_PATTERNS]
    return when(pairs, f"CASE WHEN {kind} = 'card' THEN 'card' ELSE {quoted(fixed.DEFAULT_SEALED_KIND)} END")


_LOW = "lower(title)"
_IN_BOUNDS = when(
    [(f"kind = {quoted(k)}", f"price BETWEEN {a} AND {b}") for k, (a, b) in fixed.PRICE_BOUNDS.items()],
    "price BETWEEN {} AND {}".format(*fixed.PRICE_BOUNDS["card"]),
)
# the strict box patterns need look-ahead, which this SQL dialect has not; no product is of that kind
_BAD = when(
    [(f"kind = {quoted(k)}", any_match(_LOW, p)) for k, p in fixed.SUSPICIOUS_TITLES.items() if k != "booster_box"],
    "false",
)
_MISSING = when([(f"kind = {quoted(k)}", f"NOT {all_in(_LOW, w)}") for k, w in fixed.REQUIRED_WORDS.items()], "false")
SUSPICIOUS = f"(({_BAD}) OR ({_MISSING}))"

STAGED = f"""
kinds AS (SELECT *, {kind_sql()} AS kind FROM listings),
staged AS (
  SELECT *, CASE WHEN NOT ({_IN_BOUNDS}) THEN 'price_threshold'
    WHEN source = 'ebay' AND {SUSPICIOUS} THEN 'title_pattern' END AS rule_reason
  FROM kinds
)"""


def exclusive(name, i):
    """Exclusive quartile i of the sorted list column ``name``."""
    n = f"len({name})"
    j = f"greatest(1, least(({n} + 1) * {i} // 4, {n} - 1))"
    weight = f"(({n} + 1) * {i} - ({j}) * 4)"
    return f"({name}[{j}] * (4 - {weight}) + {name}[{j} + 1] * {weight}) / 4"


_GROUP = ", ".join(quality.GROUP)
FILTERED = f"""
passed AS (SELECT * FROM staged WHERE rule_reason IS NULL),
groups AS (SELECT {_GROUP}, list_sort(list(price)) AS a FROM passed GROUP BY ALL),
limits AS (
  SELECT {_GROUP}, len(a) AS n, {exclusive('a', 1)} AS q1, {exclusive('a', 3)} AS q3,
    sum(len(a)) OVER (PARTITION BY product_type, product_id) AS product_rows
  FROM groups WHERE len(a) >= 2
  UNION ALL SELECT {_GROUP}, len(a), NULL, NULL, NULL FROM groups WHERE len(a) < 2
),
totals AS (SELECT product_type, product_id, count(*) AS total FROM passed GROUP BY ALL),
judged AS (
  SELECT p.*, CASE WHEN l.n >= 3 AND t.total >= 5 THEN
      CASE WHEN price < q1 - 1.5 * (q3 - q1) THEN 'extreme_low' WHEN price > q3 + 1.5 * (q3 - q1) THEN 'extreme_high' END
    END AS stat_reason
  FROM passed p JOIN limits l USING ({_GROUP}) JOIN totals t USING (product_type, product_id)
),
filtered AS (
  SELECT *, CASE WHEN stat_reason IS NOT NULL THEN 'statistical' END AS removed_by FROM judged
  UNION ALL BY NAME
  SELECT *, NULL AS stat_reason, rule_reason AS removed_by FROM staged WHERE rule_reason IS NOT NULL
)"""
ALL_RULES = (LISTINGS, STAGED, FILTERED)


@query("threshold_filter", with_(LISTINGS, STAGED) + f"""
SELECT kind, count(*) AS listings, count(*) FILTER (WHERE {_IN_BOUNDS}) AS in_bounds,
  {hu('min(price)', 2)} AS min_price, {hu('max(price)', 2)} AS max_price
FROM staged GROUP BY kind""")
def threshold_filter(spark, sf_dir):
    rows = quality.with_kind(listings(spark, sf_dir))
    return rows.groupBy("kind").agg(
        F.count("*").alias("listings"),
        F.count_if(quality.by_kind(lambda k: quality.price_in_bounds(F.col("price"), k))).alias("in_bounds"),
        half_up(F.min("price"), 2).alias("min_price"), half_up(F.max("price"), 2).alias("max_price"),
    )


@query("suspicious_titles", with_(LISTINGS, STAGED) + f"""
SELECT listing_id, kind, title FROM staged WHERE {SUSPICIOUS}""")
def suspicious_titles(spark, sf_dir):
    rows = listings(spark, sf_dir).filter(quality.by_kind(lambda k: quality.suspicious_title(F.col("title"), k)))
    return quality.with_kind(rows).select("listing_id", "kind", "title")


@query("iqr_outliers", with_(*ALL_RULES) + """
SELECT listing_id, product_id, source, condition_category, price, stat_reason FROM filtered WHERE stat_reason IS NOT NULL""")
def iqr_outliers(spark, sf_dir):
    rows = quality.filter_listings(listings(spark, sf_dir))
    return quality.keep_where(rows, F.col("stat_reason").isNotNull()).select(
        "listing_id", "product_id", "source", "condition_category", "price", "stat_reason"
    )


@query("filter_report", with_(*ALL_RULES) + """
SELECT kind, removed_by, coalesce(stat_reason, '') AS stat_reason, count(*) AS removed, min(price) AS lowest_price,
  max(price) AS highest_price
FROM filtered WHERE removed_by IS NOT NULL GROUP BY ALL""")
def filter_report(spark, sf_dir):
    rows = quality.filter_report(quality.filter_counts(listings(spark, sf_dir)))
    return rows.withColumn("stat_reason", F.coalesce("stat_reason", F.lit("")))


@query("removed_prices", with_(*ALL_RULES) + """
SELECT CASE WHEN removed_by = 'statistical' THEN 'statistical' ELSE 'suspicious' END AS removal_class, price, count(*) AS n_rows
FROM filtered WHERE removed_by IS NOT NULL GROUP BY ALL""")
def removed_prices(spark, sf_dir):
    return quality.removed_prices(quality.filter_counts(listings(spark, sf_dir)))


_FUNNEL = f"""
SELECT {{keys}} count(*) AS original_count, count(*) FILTER (WHERE removed_by = 'price_threshold') AS price_removed,
  count(*) FILTER (WHERE removed_by = 'title_pattern') AS title_removed,
  count(*) FILTER (WHERE removed_by = 'statistical') AS stat_removed, count(*) FILTER (WHERE removed_by IS NULL) AS final_count,
  {hu("count(*) FILTER (WHERE removed_by = 'price_threshold') / count(*) * 100", 2)} AS price_removed_pct,
  {hu("count(*) FILTER (WHERE removed_by = 'title_pattern') / count(*) * 100", 2)} AS title_removed_pct,
  {hu("count(*) FILTER (WHERE removed_by = 'statistical') / count(*) * 100", 2)} AS stat_removed_pct,
  {hu("count(*) FILTER (WHERE removed_by IS NULL) / count(*) * 100", 2)} AS final_count_pct
FROM filtered"""


@query("filter_funnel", with_(*ALL_RULES) + _FUNNEL.format(keys="kind,") + " GROUP BY kind")
def filter_funnel(spark, sf_dir):
    return quality.filter_funnel(quality.filter_counts(listings(spark, sf_dir)), ["kind"])


@query("removal_patterns", with_(*ALL_RULES) + f"""
SELECT count(*) AS title_removed, count(*) FILTER (WHERE contains({_LOW}, 'pack') AND NOT contains({_LOW}, 'box')) AS single_pack,
  count(*) FILTER (WHERE contains({_LOW}, 'blister')) AS blister,
  count(*) FILTER (WHERE {any_in(_LOW, ('empty', 'damaged', 'opened'))}) AS damaged,
  count(*) FILTER (WHERE {any_in(_LOW, ('4 pack', '8 pack', '12 pack'))}) AS multi_pack
FROM filtered WHERE removed_by = 'title_pattern'""")
def removal_patterns(spark, sf_dir):
    # only the rules matter here; the outlier stage cannot move a row into the title class
    rows = quality.rule_stage(listings(spark, sf_dir)).withColumn("removed_by", F.col("rule_reason"))
    return audits.removal_patterns(rows)


@query("wrongly_removed", with_(LISTINGS, STAGED) + f"""
SELECT listing_id, product_name, title, price FROM staged
WHERE rule_reason = 'title_pattern' AND contains({_LOW}, 'booster box') AND price BETWEEN 50 AND 500""")
def wrongly_removed(spark, sf_dir):
    rows = quality.rule_stage(listings(spark, sf_dir)).withColumn("removed_by", F.col("rule_reason"))
    return audits.wrongly_removed(rows).select("listing_id", "product_name", "title", "price")


@query("clean_daily_series", with_(*ALL_RULES) + f"""
SELECT product_type, {PRODUCT_KEY} AS product_id, {day('sold_date')} AS price_date, source, condition_category,
  {hu('median(price)', 2)} AS price, {hu('least(1.0, count(*) / 10.0)', 2)} AS data_confidence, count(*) AS listing_count
FROM filtered WHERE removed_by IS NULL AND price > 0 GROUP BY 1, 2, 3, 4, 5""")
def clean_daily_series(spark, sf_dir):
    return days_as_text(analysis.aggregate_listings(views.listings(spark, sf_dir)))


_NORMAL = """CASE WHEN contains(lower(condition), 'psa 10') THEN 'PSA 10' WHEN contains(lower(condition), 'psa 9') THEN 'PSA 9'
  WHEN contains(lower(condition), 'psa') THEN 'PSA Other' WHEN contains(lower(condition), 'bgs') THEN 'BGS'
  WHEN contains(lower(condition), 'cgc') THEN 'CGC' WHEN lower(condition) IN ('new (other)', 'new', 'mint') THEN 'Raw NM'
  WHEN lower(condition) IN ('pre-owned', 'used') THEN 'Raw Used' ELSE 'Other' END"""


@query("card_outliers", with_(LISTINGS, f"""
normal AS (SELECT *, {_NORMAL} AS normal_condition FROM listings WHERE price > 0),
arrays AS (SELECT product_type, product_id, normal_condition, list_sort(list(price)) AS a FROM normal GROUP BY ALL HAVING count(*) >= 5),
bounds AS (SELECT product_type, product_id, normal_condition, {exclusive('a', 1)} AS q1, {exclusive('a', 3)} AS q3, list_median(a) AS median FROM arrays)""") + f"""
SELECT listing_id, product_id, normal_condition, price, {hu('q1', 4)} AS q1, {hu('q3', 4)} AS q3, {hu('median', 4)} AS median,
  CASE WHEN price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1) THEN 'extreme' ELSE 'moderate' END AS outlier_type
FROM normal JOIN bounds USING (product_type, product_id, normal_condition)
WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)""")
def card_outliers(spark, sf_dir):
    rows = quality.card_outliers(listings(spark, sf_dir))
    return rows.select(
        "listing_id", "product_id", "normal_condition", "price", half_up(F.col("q1"), 4).alias("q1"),
        half_up(F.col("q3"), 4).alias("q3"), half_up(F.col("median"), 4).alias("median"), "outlier_type",
    )


@query("series_outlier_audit", with_(LISTINGS, SERIES, f"""
arrays AS (SELECT product_id, source, condition_category, list_sort(list(price)) AS a FROM series GROUP BY ALL HAVING count(*) >= 3),
bounds AS (SELECT *, {exclusive('a', 1)} AS q1, {exclusive('a', 3)} AS q3 FROM arrays)""") + f"""
SELECT product_id, source, condition_category, len(a) AS points, a[1] AS min_price, a[-1] AS max_price,
  {hu('list_median(a)', 4)} AS median_price,
  len(list_filter(a, lambda p: p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1))) AS outliers,
  len(list_filter(a, lambda p: p < q1 - 3 * (q3 - q1) OR p > q3 + 3 * (q3 - q1))) AS extreme_outliers
FROM bounds""")
def series_outlier_audit(spark, sf_dir):
    return audits.series_outlier_audit(daily_series(spark, sf_dir))


@query("series_statistics", with_(LISTINGS, SERIES) + f"""
SELECT count(*) AS total_points, min(price) AS min_price, max(price) AS max_price, {hu('avg(price)', 2)} AS mean_price,
  {hu('median(price)', 2)} AS median_price FROM series""")
def series_statistics(spark, sf_dir):
    return audits.series_statistics(daily_series(spark, sf_dir))


# -- quality gates -------------------------------------------------------------------------------


def _count_hits(patterns):
    return " + ".join(f"{matches('t', p)}::INT" for p in patterns)


def _category(rules):
    return when([(any_match("t", p), quoted(c)) for c, p in rules.items()])


def _variation():
    parts = [
        f"CASE WHEN contains(w, {quoted(k)}) AND {any_in('t', forms)} THEN 0.2 ELSE 0.0 END"
        for k, forms in fixed.NAME_VARIATIONS.items()
    ]
    return " + ".join(parts)


_MATCH = f"""CASE WHEN contains(t, w) THEN 1.0 ELSE least(1.0,
  len(list_filter(string_split(w, ' '), lambda x: length(x) > 2 AND contains(t, x))) / len(string_split(w, ' ')) + {_variation()}) END"""
_SPACES = "length(t) - length(replace(t, ' ', ''))"
_CLASS = "split_part(split_part(reason, ' - ', 1), ':', 1)"


def _gate_output(scores):
    confidence = when([(f"{_CLASS} = {quoted(k)}", repr(v)) for k, v in scores.items()])
    return f"""
SELECT listing_id, reason = 'Passed quality checks' AS is_valid, reason,
  CASE WHEN reason <> 'Passed quality checks' THEN {_CLASS} END AS reason_class, invalid AS invalid_category,
  CAST(CASE WHEN reason = 'Passed quality checks' THEN {hu('score', 4)} ELSE {confidence} END AS DOUBLE) AS quality_score
FROM gated"""


_GATE2 = f"""
prepared AS (SELECT *, lower(title) AS t, lower(product_name) AS w FROM listings),
hits AS (
  SELECT *, {_category(fixed.GATE_V2_INVALID)} AS invalid, {_count_hits(fixed.GATE_V2_INDICATORS)} AS indicators,
    {any_in('t', fixed.GATE_V2_NAMES)} AS named, {_count_hits(fixed.GATE_V2_VALID)} AS valid, {_MATCH} AS m
  FROM prepared
),
gated AS (
  SELECT *, CASE WHEN t = '' THEN 'No title' WHEN invalid IS NOT NULL THEN 'Invalid: ' || invalid
      WHEN price <= 0 THEN 'Invalid price' WHEN price < 0.5 THEN 'Price too low (likely damaged/fake)'
      WHEN m < 0.3 THEN 'Item name mismatch: expected ''' || product_name || ''' not well matched'
      WHEN NOT named AND indicators = 0 AND product_type = 'sealed' THEN 'No Pokemon indicators found for sealed product'
      WHEN NOT named AND indicators = 0 THEN 'No Pokemon name or ''pokemon'' found in title'
      WHEN length(t) < 10 THEN 'Title too short' WHEN {_SPACES} < 2 THEN 'Title too simple'
      ELSE 'Passed quality checks' END AS reason,
    least(1.0, 0.4 + CASE WHEN named THEN 0.3 ELSE 0 END + least(indicators * 0.1, 0.3)
      + CASE WHEN m > 0.7 THEN 0.2 ELSE 0 END + least(valid * 0.05, 0.2)) AS score
  FROM hits
)"""
_SCORES2 = {
    "No title": 1.0, "Invalid": 0.9, "Invalid price": 0.8, "Price too low (likely damaged/fake)": 0.7,
    "Item name mismatch": 0.8, "No Pokemon indicators found for sealed product": 0.7,
    "No Pokemon name or 'pokemon' found in title": 0.8, "Title too short": 0.7, "Title too simple": 0.6,
}


def gated(spark, sf_dir):
    return quality.gate_v2(listings(spark, sf_dir), sealed=F.col("product_type") == "sealed")


_GATE_COLUMNS = ("listing_id", "is_valid", "reason", "reason_class", "invalid_category", "quality_score")


@query("quality_gate", with_(LISTINGS, _GATE2) + _gate_output(_SCORES2))
def quality_gate(spark, sf_dir):
    return gated(spark, sf_dir).select(*_GATE_COLUMNS)


@query("rejection_stats", with_(LISTINGS, _GATE2) + f"""
SELECT {_CLASS} AS reason_class, coalesce(invalid, '') AS invalid_category, count(*) AS rejected
FROM gated WHERE reason <> 'Passed quality checks' GROUP BY ALL""")
def rejection_stats(spark, sf_dir):
    rows = quality.rejection_stats(gated(spark, sf_dir))
    return rows.withColumn("invalid_category", F.coalesce("invalid_category", F.lit("")))


_TYPES = " OR ".join(
    f"contains(t, {quoted(' ' + k)}) OR contains(t, {quoted(k + ' ')})" for k in fixed.GATE_V1_CARD_TYPES
)
_GATE1 = f"""
prepared AS (SELECT *, lower(title) AS t, lower(product_name) AS w FROM listings),
hits AS (
  SELECT *, {_category(fixed.GATE_V1_INVALID)} AS invalid, {matches('t', '|'.join(fixed.GATE_V1_NAMES))} AS named,
    {_count_hits(fixed.GATE_V1_VALID)} AS valid
  FROM prepared
),
gated AS (
  SELECT *, CASE WHEN t = '' THEN 'No title' WHEN invalid IS NOT NULL THEN 'Invalid: ' || invalid
      WHEN price <= 0 THEN 'Invalid price' WHEN price < 0.5 THEN 'Price too low (likely damaged/fake)'
      WHEN NOT contains(t, w) THEN 'Card name mismatch: expected ''' || product_name || ''' not found in title'
      WHEN NOT named AND NOT contains(t, 'pokemon') THEN 'No Pokemon name or ''pokemon'' found in title'
      WHEN length(t) < 10 THEN 'Title too short' WHEN {_SPACES} < 2 THEN 'Title too simple'
      ELSE 'Passed quality checks' END AS reason,
    0.5 + CASE WHEN named THEN 0.2 ELSE 0 END + CASE WHEN {_TYPES} THEN 0.1 ELSE 0 END + least(valid * 0.1, 0.3)
      + CASE WHEN contains(t, 'pokemon') THEN 0.1 ELSE 0 END + CASE WHEN contains(t, w) THEN 0.2 ELSE 0 END AS score
  FROM hits
)"""
_SCORES1 = {
    "No title": 1.0, "Invalid": 0.9, "Invalid price": 0.8, "Price too low (likely damaged/fake)": 0.7,
    "Card name mismatch": 0.9, "No Pokemon name or 'pokemon' found in title": 0.8, "Title too short": 0.7,
    "Title too simple": 0.6,
}


@query("quality_gate_v1", with_(LISTINGS, _GATE1) + _gate_output(_SCORES1))
def quality_gate_v1(spark, sf_dir):
    return quality.gate_v1(listings(spark, sf_dir)).select(*_GATE_COLUMNS)


# -- titles against the catalog --------------------------------------------------------------------


def clean_sql(value):
    return rf"trim(regexp_replace(regexp_replace(lower({value}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words_left(value):
    stops = words(fixed.MATCH_STOP_WORDS)
    return f"list_distinct(list_filter(string_split({value}, ' '), lambda x: NOT list_contains({stops}, x)))"


def fuzzy_sql(a, b):
    left, right = words_left(a), words_left(b)
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN false ELSE coalesce(contains({b}, {a}) OR contains({a}, {b})
      OR len(list_intersect({left}, {right})) / nullif(least(len({left}), len({right})), 0) >= 0.6, false) END"""


def main_sql(clean):
    return when([(f"contains({clean}, {quoted(n)})", quoted(n)) for n in fixed.MAIN_NAMES], f"split_part({clean}, ' ', 1)")


_MISMATCH = f"""
matched AS (
  SELECT l.listing_id, l.title, l.search_terms, c.*, {clean_sql('c.card_name')} AS cn, {clean_sql('l.title')} AS ct,
    {clean_sql('c.set_name')} AS cs
  FROM listings l JOIN cards c ON c.card_id = l.product_id
),
tested AS (
  SELECT *, {main_sql('cn')} AS expected, {main_sql('ct')} AS found,
    regexp_extract_all(title, '\\b\\d+/\\d+\\b') AS numbers, {fuzzy_sql('cn', 'ct')} AS name_ok, {fuzzy_sql('cs', 'ct')} AS set_ok
  FROM matched
),
reasons AS (
  SELECT *, list_filter([
    CASE WHEN NOT name_ok THEN 'Card name not found in title' END,
    CASE WHEN expected <> '' AND found <> '' AND expected <> found
      THEN 'Different Pokemon: expected ' || expected || ', found ' || found END,
    CASE WHEN length(set_name) > 3 AND NOT contains(ct, cs) AND NOT set_ok AND {any_in('lower(title)', fixed.SET_PHRASES)}
      THEN 'Potential set mismatch: expected ' || set_name END,
    CASE WHEN len(numbers) > 0 AND NOT list_contains(numbers, card_number)
      THEN 'Card number mismatch: expected ' || card_number END], lambda r: r IS NOT NULL) AS r
  FROM tested
)"""


def mismatches(spark, sf_dir):
    rows = listings(spark, sf_dir).select("listing_id", "product_id", "title", "search_terms")
    cards = views.cards(spark, sf_dir).withColumnRenamed("card_id", "product_id")
    return quality.title_mismatches(rows.join(cards, "product_id"))


@query("title_mismatch", with_(LISTINGS, CARDS, _MISMATCH) + """
SELECT listing_id, card_name, title, array_to_string(r, '; ') AS reasons, len(r) AS confidence FROM reasons WHERE len(r) > 0""")
def title_mismatch(spark, sf_dir):
    return mismatches(spark, sf_dir).select(
        "listing_id", "card_name", "title", F.array_join("mismatch_reasons", "; ").alias("reasons"), "confidence"
    )


@query("worst_mismatches", with_(LISTINGS, CARDS, _MISMATCH) + """
SELECT listing_id, card_name, title, len(r) AS confidence FROM reasons WHERE len(r) >= 2
ORDER BY len(r) DESC, listing_id LIMIT 10""")
def worst_mismatches(spark, sf_dir):
    return quality.worst_mismatches(mismatches(spark, sf_dir)).select("listing_id", "card_name", "title", "confidence")


# -- audits --------------------------------------------------------------------------------------------


_SUSPECT = f"""
suspect AS (
  SELECT *, unnest(list_filter([
    CASE WHEN product_type = 'sealed' AND contains(lower(product_name), 'booster box') AND price < 50
      THEN 'Suspiciously low for booster box' END,
    CASE WHEN {any_in(_LOW, fixed.EMPTY_BOX_WORDS)} THEN 'Likely empty box' END,
    CASE WHEN {any_in(_LOW, fixed.DAMAGE_WORDS)} THEN 'Likely damaged/opened' END], lambda r: r IS NOT NULL)) AS reason
  FROM listings
)"""


@query("suspicious_listings", with_(LISTINGS, _SUSPECT) + """
SELECT product_type, product_id, reason, count(*) AS listings, min(price) AS lowest_price FROM suspect GROUP BY ALL""")
def suspicious_listings(spark, sf_dir):
    return audits.suspicious_counts(listings(spark, sf_dir))


@query("audit_advice", with_(LISTINGS, _SUSPECT, f"""
suspects AS (SELECT product_type, product_id, count(*) AS suspicious_count FROM suspect GROUP BY ALL),
arrays AS (SELECT product_type, product_id, source, condition_category, list_sort(list(price)) AS a FROM listings GROUP BY ALL),
bounds AS (SELECT *, {exclusive('a', 1)} AS q1, {exclusive('a', 3)} AS q3 FROM arrays WHERE len(a) >= 3),
outs AS (
  SELECT product_type, product_id, CAST(sum(len(list_filter(a, lambda p: p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1)))) AS BIGINT) AS outlier_count
  FROM bounds GROUP BY ALL
),
base AS (SELECT product_type, product_id, min(product_name) AS product_name, min(price) AS min_price FROM listings GROUP BY ALL),
audit AS (
  SELECT b.*, coalesce(suspicious_count, 0) AS suspicious_count, coalesce(outlier_count, 0) AS outlier_count
  FROM base b LEFT JOIN suspects USING (product_type, product_id) LEFT JOIN outs USING (product_type, product_id)
)""") + """
SELECT product_type, product_id, suspicious_count, outlier_count, min_price, concat_ws(' | ',
  CASE WHEN box THEN 'Add minimum price filter: Booster boxes should be at least $50' END,
  CASE WHEN box THEN 'Filter titles containing: ''empty'', ''box only'', ''just box'', ''no cards''' END,
  CASE WHEN box THEN 'Filter damaged indicators: ''damaged'', ''torn'', ''opened'', ''resealed''' END,
  CASE WHEN suspicious_count > 10 THEN 'High number of suspicious listings detected - implement stricter filtering' END,
  CASE WHEN outlier_count > 5 THEN 'Consider more aggressive IQR-based outlier removal' END,
  CASE WHEN min_price < 10 THEN 'Implement minimum price threshold based on product type' END) AS advice
FROM (SELECT *, product_type = 'sealed' AND contains(lower(product_name), 'booster box') AS box FROM audit)""")
def audit_advice(spark, sf_dir):
    audit = audits.product_audit(listings(spark, sf_dir), quality.GROUP)
    return decide.audit_advice(audit).select(
        "product_type", "product_id", "suspicious_count", "outlier_count", "min_price", F.array_join("advice", " | ").alias("advice"))


def _category_sql():
    box = f"contains({_LOW}, 'booster box')"
    return when([
        (any_in(_LOW, ("empty", "box only", "damaged", "opened")), "'damaged_empty'"),
        (any_in(_LOW, ("etb", "elite trainer")), "'elite_trainer_boxes'"),
        (f"contains({_LOW}, 'blister')", "'blister_packs'"),
        (matches(_LOW, r"\b(?:1|2|3|4|5|6|7|8|9|10|11|12)\s*pack[s]?\b") + f" AND NOT {box}", "'small_bundles'"),
        (any_in(_LOW, ("booster pack", "single pack")) + f" AND NOT {box}", "'single_packs'"),
        (f"{box} OR (contains({_LOW}, '36') AND {any_in(_LOW, ('pack', 'box'))})", "'actual_booster_boxes'"),
        (any_in(_LOW, fixed.CATEGORY_OTHER_SETS) + f" AND NOT contains({_LOW}, 'brilliant stars')", "'wrong_set'"),
    ], "'other_products'")


_CLASSES = when([(f"category = {quoted(k)}", quoted(v)) for k, v in audits.CATEGORY_CLASSES.items()])
_PROFILE = f"""
categories AS (SELECT *, {_category_sql()} AS category FROM listings),
profile AS (
  SELECT category, count(*) AS listings, min(price) AS min_price, max(price) AS max_price, {hu('avg(price)', 4)} AS avg_price,
    {_CLASSES} AS filter_class FROM categories GROUP BY category
)"""


@query("category_profile", with_(LISTINGS, _PROFILE) + "SELECT * FROM profile")
def category_profile(spark, sf_dir):
    return audits.category_profile(listings(spark, sf_dir))


def _class_sum(kind):
    return f"CAST(coalesce(sum(listings) FILTER (WHERE filter_class = '{kind}'), 0) AS BIGINT)"


@query("filter_rates", with_(LISTINGS, _PROFILE) + f"""
SELECT CAST(sum(listings) AS BIGINT) AS total_listings, {_class_sum('keep')} AS should_keep, {_class_sum('filter')} AS should_filter,
  {_class_sum('questionable')} AS questionable, {hu(f"{_class_sum('filter')} / sum(listings) * 100", 4)} AS should_filter_pct
FROM profile""")
def filter_rates(spark, sf_dir):
    return audits.filter_rates(audits.category_profile(listings(spark, sf_dir)))


@query("price_buckets", with_(LISTINGS, CARDS) + """
SELECT CASE WHEN price < 5 THEN 'Under $5' WHEN price < 10 THEN '$5-$10' WHEN price < 25 THEN '$10-$25'
  WHEN price < 50 THEN '$25-$50' ELSE '$50+' END AS price_range, rarity, count(*) AS listings
FROM listings JOIN cards ON card_id = product_id GROUP BY ALL""")
def price_buckets(spark, sf_dir):
    cards = views.cards(spark, sf_dir).select(F.col("card_id").alias("product_id"), "rarity")
    return audits.price_buckets(listings(spark, sf_dir).select("product_id", "price").join(cards, "product_id"))


@query("price_distribution", with_(LISTINGS) + f"""
SELECT product_type, count(*) AS listings, min(price) AS min_price, max(price) AS max_price, {hu('avg(price)', 4)} AS avg_price,
  (list_sort(list(price)))[count(*) // 2 + 1] AS upper_median,
  {hu('count(*) FILTER (WHERE price < 50) / count(*) * 100', 4)} AS under_50_pct,
  {hu('count(*) FILTER (WHERE price < 75) / count(*) * 100', 4)} AS under_75_pct,
  {hu('count(*) FILTER (WHERE price > 200) / count(*) * 100', 4)} AS over_200_pct,
  {hu('count(*) FILTER (WHERE price > 500) / count(*) * 100', 4)} AS over_500_pct
FROM listings GROUP BY product_type""")
def price_distribution(spark, sf_dir):
    return audits.price_distribution(listings(spark, sf_dir), ["product_type"])


@query("low_price_audit", with_(LISTINGS) + """
SELECT listing_id, title, price, condition FROM listings WHERE price < 10 ORDER BY price, listing_id LIMIT 20""")
def low_price_audit(spark, sf_dir):
    return audits.low_prices(listings(spark, sf_dir)).select("listing_id", "title", "price", "condition")


@query("range_audit", with_(LISTINGS, SERIES) + f"""
SELECT count(*) AS total_points, min(price) AS min_price, max(price) AS max_price, {hu('avg(price)', 4)} AS avg_price,
  count(*) FILTER (WHERE price < 50) AS below_50, count(*) FILTER (WHERE price > 1000) AS above_1000,
  count(*) FILTER (WHERE price < 25 OR price > 2000) AS unrealistic_count,
  {hu('count(*) FILTER (WHERE price < 25 OR price > 2000) / count(*) * 100', 4)} AS unrealistic_pct
FROM series""")
def range_audit(spark, sf_dir):
    return audits.range_audit(daily_series(spark, sf_dir))


