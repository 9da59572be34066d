"""Registration and the SQL text shared by many queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelwork.sources import starviews as views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = views.AS_OF


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result on the same tables."""
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def days_as_text(rows: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so both engines print them alike."""
    columns = []
    for name, kind in rows.dtypes:
        if kind == "date":
            columns.append(F.col(name).cast("string").alias(name))
        elif kind in ("timestamp", "timestamp_ntz"):
            columns.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif kind.startswith("decimal"):
            columns.append(F.col(name).cast("double").alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns)


# -- SQL text --------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: Sequence[str]) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def pick(items: Sequence[str], position: str) -> str:
    return f"({words(items)})[({position}) % {len(items)} + 1]"


def hu(value: str, digits: int) -> str:
    """Round half away from zero on the decimal text of the value."""
    v = f"CAST({value} AS DOUBLE)"
    return f"coalesce(CAST(round(TRY_CAST({v} AS DECIMAL(28,10)), {digits}) AS DOUBLE), round({v}, {digits}))"


def day(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def any_match(text: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(matches(text, p) for p in patterns) + ")"


def any_in(text: str, items: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(i)})" for i in items) + ")"


def all_in(text: str, items: Sequence[str]) -> str:
    return "(" + " AND ".join(f"contains({text}, {quoted(i)})" for i in items) + ")"


def when(pairs: Sequence[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {otherwise} END"


def div(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


def card_name(key: str) -> str:
    return f"concat_ws(' ', {pick(views.NAMES, key)}, {pick(views.SUFFIXES, key)})"


def set_name(key: str) -> str:
    return pick(views.SETS, f"({key}) // 8")


def sealed_name(key: str) -> str:
    return f"concat_ws(' ', {set_name(key)}, {pick(views.KINDS, key)})"


def strategy(terms: str, sealed: str) -> str:
    low = f"lower({terms})"
    return (
        f"CASE WHEN {sealed} THEN CASE WHEN contains({low}, 'elite trainer box') THEN 'sealed_etb'"
        f" WHEN contains({low}, 'collection box') THEN 'sealed_collection' ELSE 'sealed_box' END"
        f" ELSE CASE WHEN contains({low}, 'psa 10') THEN 'psa_10' WHEN contains({low}, 'psa 9') THEN 'psa_9'"
        " ELSE 'raw_nm' END END"
    )


_SHOWN = "(l_partkey + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END)"
_CENTS = (
    "((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + 10 * CAST(l_quantity AS BIGINT))"
    " // (20 * CAST(l_quantity AS BIGINT)))"
)
_TERMS = f"concat_ws(' ', {card_name('l_partkey')}, {pick(views.TERMS, 'l_linenumber - 1')})"

LISTINGS = f"""
listings AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id,
    concat_ws('-', l_orderkey, l_linenumber) AS listing_url,
    CASE WHEN l_returnflag = 'A' THEN 'sealed' ELSE 'card' END AS product_type,
    l_partkey AS product_id,
    CASE WHEN l_returnflag = 'A' THEN {sealed_name('l_partkey')} ELSE {card_name('l_partkey')} END AS product_name,
    concat_ws(' ', {card_name(_SHOWN)}, {set_name(_SHOWN)}, {pick(views.PHRASES, 'l_suppkey + l_linenumber')},
      concat(l_partkey % 200 + 1 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END, '/200')) AS title,
    {_CENTS} / 100.0 AS price,
    l_shipdate AS sold_date,
    CASE WHEN l_linestatus = 'O' THEN 'ebay' ELSE 'pricecharting' END AS source,
    l_returnflag = 'R' AS is_graded,
    CASE WHEN l_returnflag = 'R' THEN 'graded' WHEN l_returnflag = 'A' THEN 'sealed' ELSE 'raw' END AS condition_category,
    {pick(views.CONDITIONS, 'l_linenumber - 1')} AS condition,
    {_TERMS} AS search_terms,
    CASE WHEN l_returnflag = 'R' THEN {pick(views.GRADES, 'l_suppkey')} END AS grade,
    CASE WHEN l_returnflag = 'R' THEN {pick(views.GRADERS, 'l_suppkey')} END AS grading_company,
    {strategy(_TERMS, "l_returnflag = 'A'")} AS search_strategy,
    l_orderkey
  FROM lineitem
)"""

CREATED = """
created AS (
  SELECT l.*, o.o_orderdate AS created_at FROM listings l JOIN orders o ON o.o_orderkey = l.l_orderkey
)"""

CARDS = f"""
cards AS (
  SELECT p_partkey AS card_id, {card_name('p_partkey')} AS card_name, {set_name('p_partkey')} AS set_name,
    concat(p_partkey % 200 + 1, '/200') AS card_number,
    {when([(f"p_type = {quoted(k)}", quoted(v)) for k, v in views.RARITIES.items()])} AS rarity,
    p_name AS variant, p_brand AS series
  FROM part
)"""

SEALED = f"""
sealed AS (
  SELECT p_partkey AS sealed_product_id, {sealed_name('p_partkey')} AS product_name,
    {set_name('p_partkey')} AS set_name, {pick(views.KINDS, 'p_partkey')} AS product_type, p_retailprice AS msrp
  FROM part
)"""

CHART_NOW = """
chart_now AS (
  SELECT p_partkey AS card_id, p_retailprice / 10 AS pc_current_price, p_retailprice / 12 AS pc_loose_price,
    p_retailprice / 5 AS pc_graded_price, p_retailprice / 4 AS pc_new_price,
    concat('https://chart.example/', p_partkey) AS pc_url
  FROM part WHERE p_size > 10
)"""

PRODUCT_KEY = "concat_ws('-', product_type, product_id)"
SERIES = f"""
series AS (
  SELECT {PRODUCT_KEY} AS product_id, CAST(sold_date AS DATE) AS price_date, source, condition_category,
    {hu('median(price)', 2)} AS price,
    {hu('least(1.0, count(*) / 10.0)', 2)} AS data_confidence,
    count(*) AS listing_count
  FROM listings WHERE price > 0 GROUP BY ALL
)"""

EVENT_SERIES = f"""
series AS (
  SELECT user_id AS product_id, CAST(ts AS DATE) AS price_date, event_type AS source, 'market' AS condition_category,
    {hu('median(value)', 2)} AS price
  FROM events WHERE value > 0 GROUP BY ALL
)"""

POINTS = """
lagged AS (
  SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY price_date, source, condition_category) AS previous
  FROM series
),
points AS (
  SELECT *, coalesce(price / previous - 1, 0.0) AS returns,
    coalesce(ln(price / previous), 0.0) AS log_returns,
    row_number() OVER (PARTITION BY product_id ORDER BY price_date, source, condition_category) AS ord,
    count(*) OVER (PARTITION BY product_id) AS n,
    count(*) OVER (PARTITION BY product_id)
      - row_number() OVER (PARTITION BY product_id ORDER BY price_date, source, condition_category) + 1 AS back
  FROM lagged
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def listings(spark: SparkSession, sf_dir: str, created: bool = False) -> DataFrame:
    """Listings with their search strategy."""
    from gavelwork.functions.text import search_strategy

    rows = views.listings(spark, sf_dir, with_created=created)
    return rows.withColumn(
        "search_strategy", search_strategy(F.col("search_terms"), F.col("product_type") == "sealed")
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavelwork.operators.series import daily_median_series

    return daily_median_series(views.listings(spark, sf_dir))
