"""Text functions over whole tables: prices, dates, titles, names, verdicts."""

from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.functions.numbers import half_up
from gavelwork.operators import decisions, ingest
from gavelwork.registry.base import (
    CARDS, LISTINGS, hu, matches, query, quoted, stamp, strategy, when, with_,
)
from gavelwork.registry.quality_queries import _MATCH, clean_sql, fuzzy_sql, main_sql, _NORMAL
from gavelwork.rules import fixed
from gavelwork.sources import starviews as views

# -- prices: the extended price written in six ways -----------------------------------------------

_AMOUNT = "printf('%.2f', l_extendedprice)"
_PRICE_TEXTS = f"""
texts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id, CAST(l_extendedprice AS DOUBLE) AS amount, l_linenumber AS way,
    CASE l_linenumber WHEN 1 THEN '$' || {_AMOUNT} WHEN 2 THEN 'US $' || {_AMOUNT} || ' to $99999.00'
      WHEN 3 THEN replace({_AMOUNT}, '.', ',') WHEN 4 THEN '$' || format('{{:,}}', CAST(floor(l_extendedprice) AS BIGINT)) || '.50'
      WHEN 5 THEN '$' || format('{{:,}}', CAST(floor(l_extendedprice) AS BIGINT)) WHEN 6 THEN 'free' ELSE '' END AS price_text
  FROM lineitem
)"""
_COMMA = "replace(digits, ',', '')"
_PRICE_SQL = f"""
firsts AS (SELECT *, regexp_replace(CASE WHEN contains(lower(price_text), 'to') THEN split_part(price_text, 'to', 1) ELSE price_text END, '[^\\d.,]', '', 'g') AS digits FROM texts),
prices AS (
  SELECT listing_id, price_text, coalesce(TRY_CAST(CASE WHEN contains(digits, ',') AND NOT contains(digits, '.') AND length(split_part(digits, ',', 2)) = 2
    THEN replace(digits, ',', '.') ELSE {_COMMA} END AS DOUBLE), 0.0) AS price FROM firsts
)"""


def price_texts(spark, sf_dir):
    amount = F.format_string("%.2f", F.col("l_extendedprice"))
    grouped = F.format_number(F.floor("l_extendedprice"), 0)
    way = F.col("l_linenumber")
    return views.read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
        F.when(way == 1, F.concat(F.lit("$"), amount))
        .when(way == 2, F.concat(F.lit("US $"), amount, F.lit(" to $99999.00")))
        .when(way == 3, F.replace(amount, F.lit("."), F.lit(",")))
        .when(way == 4, F.concat(F.lit("$"), grouped, F.lit(".50")))
        .when(way == 5, F.concat(F.lit("$"), grouped))
        .when(way == 6, "free").otherwise("").alias("price_text"),
    )


@query("clean_price", with_(_PRICE_TEXTS, _PRICE_SQL) + "SELECT listing_id, price_text, price FROM prices")
def clean_price(spark, sf_dir):
    return price_texts(spark, sf_dir).withColumn("price", text.clean_price(F.col("price_text")))


# -- dates: the ship date written in eight ways -----------------------------------------------------

_YEAR = 2003


def _date_texts():
    d = "l_shipdate"
    return f"""
texts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id, l_suppkey % 8 AS way, {d} AS d,
    CASE l_suppkey % 8 WHEN 0 THEN 'Sold ' || strftime({d}, '%b %-d, %Y') WHEN 1 THEN 'Ended ' || strftime({d}, '%b %-d %Y')
      WHEN 2 THEN strftime({d}, '%-m/%-d/%Y') WHEN 3 THEN strftime({d}, '%-m/%-d/') || strftime({d}, '%y')
      WHEN 4 THEN strftime({d}, '%Y-%m-%d') WHEN 5 THEN 'sold  ' || strftime({d}, '%b %-d') WHEN 6 THEN 'yesterday' ELSE '' END AS sold_text
  FROM lineitem
)"""


def date_texts(spark, sf_dir):
    d, way = F.col("l_shipdate"), F.col("l_suppkey") % 8
    return views.read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
        F.when(way == 0, F.concat(F.lit("Sold "), F.date_format(d, "MMM d, yyyy")))
        .when(way == 1, F.concat(F.lit("Ended "), F.date_format(d, "MMM d yyyy")))
        .when(way == 2, F.date_format(d, "M/d/yyyy"))
        .when(way == 3, F.date_format(d, "M/d/yy"))
        .when(way == 4, F.date_format(d, "yyyy-MM-dd"))
        .when(way == 5, F.concat(F.lit("sold  "), F.date_format(d, "MMM d")))
        .when(way == 6, "yesterday").otherwise("").alias("sold_text"),
    )


_PARSED = f"""CASE WHEN way < 5 THEN {stamp('d')}
  WHEN way = 5 AND strftime(d, '%m-%d') <> '02-29' THEN '{_YEAR}-' || strftime(d, '%m-%d') || ' 00:00:00' END"""


@query("parse_sale_dates", with_(_date_texts()) + f"SELECT listing_id, sold_text, {_PARSED} AS sold_date FROM texts")
def parse_sale_dates(spark, sf_dir):
    when_sold = text.parse_sale_date(F.col("sold_text"), F.lit(_YEAR))
    return date_texts(spark, sf_dir).withColumn("sold_date", F.date_format(when_sold, "yyyy-MM-dd HH:mm:ss"))


@query("sold_text", with_(_date_texts()) + """
SELECT listing_id, CASE WHEN way = 0 THEN strftime(d, '%b %-d, %Y') WHEN way = 1 THEN strftime(d, '%b %-d')
  WHEN way = 5 THEN strftime(d, '%b %-d') END AS found FROM texts""")
def sold_text(spark, sf_dir):
    wrapped = F.concat(F.lit("Free returns. "), F.col("sold_text"), F.lit(" from seller"))
    return date_texts(spark, sf_dir).select("listing_id", text.sold_text(wrapped).alias("found"))


# -- titles -----------------------------------------------------------------------------------------

_LOW = "lower(title)"
_SET = when([(matches(_LOW, p), quoted(n)) for n, p in fixed.TITLE_SETS], "''")
_NAME = when([(f"contains({_LOW}, {quoted(n)})", quoted(n.title())) for n in fixed.TITLE_NAMES])
_GUESSES = ", ".join(f"nullif(regexp_extract(title, {quoted(p)}, 1), '')" for p in fixed.TITLE_NAME_PATTERNS)


@query("title_parse", with_(LISTINGS) + f"""
SELECT listing_id, upper(regexp_extract(title, {quoted(fixed.GRADE_PATTERN)}, 1)) AS grading_company,
  regexp_extract(title, {quoted(fixed.GRADE_PATTERN)}, 2) AS grade, {matches('title', fixed.GRADE_PATTERN)} AS is_graded,
  regexp_extract(title, {quoted(fixed.CARD_NUMBER_PATTERN)}, 0) AS card_number, {_SET} AS set_name,
  coalesce({_NAME}, {_GUESSES}, '') AS card_name
FROM listings""")
def title_parse(spark, sf_dir):
    t = F.col("title")
    return views.listings(spark, sf_dir).select(
        "listing_id", text.grading_company(t).alias("grading_company"), text.grade(t).alias("grade"),
        text.is_graded(t).alias("is_graded"), text.card_number(t).alias("card_number"),
        text.title_set(t).alias("set_name"), text.title_name(t).alias("card_name"),
    )


@query("condition_classes", with_(LISTINGS) + f"""
SELECT condition, {_NORMAL} AS normal_condition, condition_category, count(*) AS listings FROM listings GROUP BY ALL""")
def condition_classes(spark, sf_dir):
    slot = text.condition_slot(F.col("is_graded"), F.col("condition_category"))
    return views.listings(spark, sf_dir).groupBy(
        "condition", text.normal_condition(F.col("condition")).alias("normal_condition"), slot.alias("condition_category")
    ).agg(F.count("*").alias("listings"))


@query("prepare_listings", with_(LISTINGS) + f"""
SELECT listing_id, title, price, {strategy('search_terms', "product_type = 'sealed'")} AS search_strategy,
  CASE WHEN product_type = 'sealed' THEN 'sealed' WHEN is_graded THEN 'graded' ELSE 'raw' END AS condition_category,
  CASE WHEN product_type <> 'sealed' AND regexp_matches(grade, '^\\d+$') THEN CAST(grade AS INT) END AS grade_numeric,
  coalesce(grade, '') AS grade, {stamp('sold_date')} AS sold_date, product_type <> 'sealed' AND is_graded AS is_graded
FROM listings""")
def prepare_listings(spark, sf_dir):
    raw = views.listings(spark, sf_dir).withColumn(
        "sold_text", F.concat(F.lit("Sold "), F.date_format("sold_date", "MMM d, yyyy"))
    ).withColumn("title", F.concat(F.col("title"), F.lit("  ")))
    rows = ingest.prepare_listings(raw.drop("sold_date"), F.col("product_type") == "sealed", F.lit("2001-11-05").cast("timestamp"))
    return rows.select(
        "listing_id", "title", F.col("price").cast("double").alias("price"), "search_strategy", "condition_category",
        "grade_numeric", "grade", F.date_format("sold_date", "yyyy-MM-dd HH:mm:ss").alias("sold_date"), "is_graded",
    )


_PAIRED = f"""
paired AS (
  SELECT l.listing_id, l.title, c.card_name, c.set_name, {clean_sql('l.title')} AS ct, {clean_sql('c.card_name')} AS cn,
    {clean_sql("c.set_name || ' ' || c.card_name")} AS full_name
  FROM listings l JOIN cards c ON c.card_id = l.product_id
)"""


def paired(spark, sf_dir):
    cards = views.cards(spark, sf_dir).select(F.col("card_id").alias("product_id"), "card_name", "set_name")
    return views.listings(spark, sf_dir).select("listing_id", "product_id", "title").join(cards, "product_id")


@query("fuzzy_match", with_(LISTINGS, CARDS, _PAIRED) + f"""
SELECT listing_id, ct AS clean_title, {main_sql('ct')} AS title_name, {fuzzy_sql('cn', 'ct')} AS name_matches,
  {fuzzy_sql('full_name', 'ct')} AS full_name_matches FROM paired""")
def fuzzy_match(spark, sf_dir):
    rows = paired(spark, sf_dir).withColumns({
        "clean_title": text.clean_name(F.col("title")), "name": text.clean_name(F.col("card_name")),
        "full_name": text.clean_name(F.concat_ws(" ", "set_name", "card_name")),
    })
    title = F.col("clean_title")
    return rows.select(
        "listing_id", title, text.main_name(title).alias("title_name"),
        text.fuzzy_match(F.col("name"), title).alias("name_matches"),
        text.fuzzy_match(F.col("full_name"), title).alias("full_name_matches"),
    )


@query("name_match_score", with_(LISTINGS) + f"""
SELECT listing_id, {hu(_MATCH, 4)} AS score FROM (SELECT *, lower(title) AS t, lower(product_name) AS w FROM listings)""")
def name_match_score(spark, sf_dir):
    return views.listings(spark, sf_dir).select(
        "listing_id", half_up(text.name_match_score(F.col("title"), F.col("product_name")), 4).alias("score")
    )


# -- prices and verdicts -------------------------------------------------------------------------------


def _reasonable(kind, price):
    pairs = []
    for name, (low, high, t_low, t_high) in fixed.TYPICAL_PRICES.items():
        pairs.append((f"{kind} = {quoted(name)}", f"""CASE WHEN {price} < {low} OR {price} > {high} THEN 0.1
          WHEN {price} BETWEEN {t_low} AND {t_high} THEN 1.0
          WHEN {price} < {t_low} THEN 0.3 + 0.4 * ({price} - {low}) / ({t_low - low}) ELSE 0.3 + 0.4 * ({high} - {price}) / ({high - t_high}) END"""))
    return when(pairs, "0.5")


_KINDS = list(fixed.TYPICAL_PRICES) + ["unknown"]


@query("price_reasonableness", with_(LISTINGS) + f"""
SELECT listing_id, kind, {hu(_reasonable('kind', 'price'), 4)} AS reasonableness
FROM (SELECT *, ([{', '.join(quoted(k) for k in _KINDS)}])[product_id % {len(_KINDS)} + 1] AS kind FROM listings)""")
def price_reasonableness(spark, sf_dir):
    kind = views.pick(tuple(_KINDS), F.col("product_id"))
    return views.listings(spark, sf_dir).select(
        "listing_id", kind.alias("kind"), half_up(text.price_reasonableness(F.col("price"), kind), 4).alias("reasonableness")
    )


@query("scraped_price_checks", """
SELECT event_type, count(*) AS prices,
  count(*) FILTER (WHERE value BETWEEN 1 AND 100000 AND value <> 6.0) AS sane,
  count(*) FILTER (WHERE value BETWEEN 1 AND 100000 AND value NOT IN (1.0, 1.99, 2.0, 2.99, 3.0, 4.99, 5.0, 6.0, 9.99)) AS strictly_sane
FROM events GROUP BY event_type""")
def scraped_price_checks(spark, sf_dir):
    price = F.col("price")
    return views.chart_points(spark, sf_dir).groupBy(F.col("source").alias("event_type")).agg(
        F.count("*").alias("prices"), F.count_if(text.sane_price(price)).alias("sane"),
        F.count_if(text.sane_price(price, strict=True)).alias("strictly_sane"),
    )


_DESCRIBED = "length(trim(t)) >= 10 AND regexp_matches(t, 'pokemon|charizard|pikachu|card|booster|tcg') AND NOT regexp_matches(t, 'subscribe|month|subscription')"


@query("description_checks", f"""
SELECT doc_id, {_DESCRIBED} AS sane FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)
UNION ALL SELECT -1 - conv_id * 1000 - turn, {_DESCRIBED} FROM (SELECT conv_id, turn, lower(trim(text || ' card')) AS t FROM conversations)""")
def description_checks(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents").select("doc_id", text.sane_description(F.col("text")).alias("sane"))
    talk = views.read(spark, sf_dir, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"),
        text.sane_description(F.concat("text", F.lit(" card"))).alias("sane"),
    )
    return docs.unionByName(talk)


_VERDICTS = f"""
verdicts AS (
  SELECT d.doc_id AS listing_id, CAST(n_chars % 300 + 1 AS DOUBLE) AS price,
    CASE WHEN quality IS NULL THEN 'flag' WHEN toxic = 1 THEN 'remove' WHEN quality = 1 THEN 'keep' ELSE 'flag' END AS action,
    CASE WHEN quality = 1 THEN 0.9 ELSE 0.5 END AS confidence,
    CASE WHEN quality IS NULL THEN 'unknown' ELSE lang END AS detected_language,
    CASE WHEN quality IS NULL THEN 'unknown' ELSE (['booster_box', 'tin', 'single_card', 'bundle'])[d.doc_id % 4 + 1] END AS detected_product_type,
    CASE WHEN quality IS NULL THEN 'No reason provided' ELSE source END AS reason
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
decided AS (SELECT *, CASE action WHEN 'keep' THEN 'kept' WHEN 'remove' THEN 'removed' ELSE 'flagged' END AS route FROM verdicts)"""


def decided(spark, sf_dir):
    return decisions.parse_verdicts(views.verdicts(spark, sf_dir))


@query("decisions", with_(_VERDICTS) + f"""
SELECT listing_id, price, action, CAST(confidence AS DOUBLE) AS confidence, reason, detected_language, detected_product_type,
  'unknown' AS detected_condition, true AS is_authentic, {hu(_reasonable('detected_product_type', 'price'), 4)} AS price_reasonableness, route
FROM decided""")
def decisions_query(spark, sf_dir):
    return decided(spark, sf_dir).withColumn("price_reasonableness", half_up(F.col("price_reasonableness"), 4))


@query("decisions_kept", with_(_VERDICTS) + "SELECT listing_id, price, detected_language FROM decided WHERE route = 'kept'")
def decisions_kept(spark, sf_dir):
    return decisions.kept(decided(spark, sf_dir)).select("listing_id", "price", "detected_language")


@query("decision_summary", with_(_VERDICTS) + f"""
SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE route = 'kept') AS kept_count, count(*) FILTER (WHERE route = 'removed') AS removed_count,
  count(*) FILTER (WHERE route = 'flagged') AS flagged_count, {hu("count(*) FILTER (WHERE route = 'kept') / count(*)", 4)} AS keep_rate,
  {hu("count(*) FILTER (WHERE route = 'removed') / count(*)", 4)} AS removal_rate,
  {hu("count(*) FILTER (WHERE route = 'flagged') / count(*)", 4)} AS flag_rate, {hu('avg(confidence)', 4)} AS avg_confidence
FROM decided""")
def decision_summary(spark, sf_dir):
    return decisions.decision_summary(decided(spark, sf_dir))


@query("decisions_by_language", with_(_VERDICTS) + "SELECT detected_language, count(*) AS listings FROM decided GROUP BY ALL")
def decisions_by_language(spark, sf_dir):
    return decisions.decisions_by(decided(spark, sf_dir), "detected_language")


@query("decisions_by_type", with_(_VERDICTS) + "SELECT detected_product_type, count(*) AS listings FROM decided GROUP BY ALL")
def decisions_by_type(spark, sf_dir):
    return decisions.decisions_by(decided(spark, sf_dir), "detected_product_type")
