"""Catalog selection, product search, targets, set roll-ups, search plans."""

from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.operators import audits, catalog, ingest, search
from gavelwork.plans import preparation
from gavelwork.registry.base import CARDS, LISTINGS, SEALED, any_in, query, quoted, when, with_, words
from gavelwork.rules import fixed
from gavelwork.session import scratch_path, spread
from gavelwork.sources import starviews as views

COLUMNS = "card_id, card_name, set_name, card_number, rarity"
NAMES = COLUMNS.split(", ")


def cards(spark, sf_dir):
    return views.cards(spark, sf_dir)


@query("custom_filter", with_(CARDS) + f"""
SELECT {COLUMNS} FROM cards WHERE rarity IN ('Rare Holo', 'Ultra Rare') AND set_name = 'Base Set'""")
def custom_filter(spark, sf_dir):
    return catalog.custom_filter(
        cards(spark, sf_dir), {"rarity": ["Rare Holo", "Ultra Rare"], "set_name": "Base Set"}
    ).select(*NAMES)


@query("cards_by_name", with_(CARDS) + f"""
SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY card_name, set_name, card_number ORDER BY card_id) AS rn
  FROM cards WHERE card_name ILIKE '%charizard%' OR card_name ILIKE '%zard v%') WHERE rn = 1""")
def cards_by_name(spark, sf_dir):
    return catalog.by_names(cards(spark, sf_dir), ["charizard", "zard v"]).select(*NAMES)


@query("cards_by_set", with_(CARDS) + f"""
SELECT {COLUMNS} FROM cards WHERE set_name IN ('Celebrations', 'Lost Origin')""")
def cards_by_set(spark, sf_dir):
    return catalog.by_sets(cards(spark, sf_dir), ["Celebrations", "Lost Origin"]).select(*NAMES)


@query("catalog_page", with_(CARDS) + f"SELECT {COLUMNS} FROM cards ORDER BY card_id LIMIT 50 OFFSET 100")
def catalog_page(spark, sf_dir):
    return catalog.page(cards(spark, sf_dir), 50, 100).select(*NAMES)


@query("catalog_sample", with_(CARDS) + f"SELECT {COLUMNS} FROM cards ORDER BY card_id LIMIT 10")
def catalog_sample(spark, sf_dir):
    return catalog.sample(cards(spark, sf_dir)).select(*NAMES)


@query("high_value_cards", with_(CARDS) + f"""
SELECT {COLUMNS} FROM cards WHERE {any_in('lower(card_name)', fixed.HIGH_VALUE_NAMES)}
  OR {any_in('lower(rarity)', fixed.HIGH_VALUE_RARITIES)}""")
def high_value_cards(spark, sf_dir):
    return catalog.high_value(cards(spark, sf_dir)).select(*NAMES)


@query("distinct_cards", with_(CARDS) + f"""
SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY card_name, set_name, card_number ORDER BY card_id) AS rn FROM cards)
WHERE rn = 1""")
def distinct_cards(spark, sf_dir):
    return catalog.distinct_cards(cards(spark, sf_dir)).select(*NAMES)


_QUERIES = ("charizard", "Elite Trainer", "stars", "no such thing", "mew_wo")


def _find(order_card, order_sealed):
    asked = " UNION ALL ".join(f"SELECT {quoted(q)} AS query" for q in _QUERIES)
    return f"""
asked AS ({asked}),
hits AS (
  SELECT query, 'card' AS product_type, card_id AS product_key, card_name AS product_name, set_name, {order_card} AS catalog_rank
  FROM asked JOIN cards ON card_name ILIKE '%' || query || '%'
  UNION ALL SELECT query, 'sealed', sealed_product_id, product_name, set_name, {order_sealed}
  FROM asked JOIN sealed ON product_name ILIKE '%' || query || '%'
),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, catalog_rank ORDER BY product_key) AS rank FROM hits) WHERE rank <= 5)"""


@query("product_search", with_(CARDS, SEALED, _find(0, 1)) + """
SELECT query, product_type, product_key, product_name, set_name, catalog_rank, rank FROM found""")
def product_search(spark, sf_dir):
    return catalog.find_products(_QUERIES, cards(spark, sf_dir), views.sealed_products(spark, sf_dir))


@query("product_search_first", with_(CARDS, SEALED, _find(1, 0)) + """
SELECT query, product_type, product_key, product_name, set_name, match_count FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY catalog_rank, rank) AS best, count(*) OVER (PARTITION BY query) AS match_count
  FROM found) WHERE best = 1""")
def product_search_first(spark, sf_dir):
    matches = catalog.find_products(_QUERIES, cards(spark, sf_dir), views.sealed_products(spark, sf_dir), sealed_first=True)
    return catalog.first_match(matches)


# some of these have an exact card, some only a name-and-set match, some nothing
TARGETS = (
    ("Charizard V", "Base Set", "1/200"),
    ("Pikachu VMAX", "Base Set", "2/200"),
    ("Mewtwo", "Base Set", "999/200"),
    ("Lugia", "Celebrations", "1/200"),
    ("Umbreon VSTAR", "Evolving Skies", "110/200"),
    ("Gengar V", "No Such Set", "4/200"),
)


def _targets_sql(targets):
    rows = " UNION ALL ".join(
        f"SELECT {i} AS target, {quoted(n)} AS target_name, {quoted(s)} AS target_set, {quoted(c)} AS target_number"
        for i, (n, s, c) in enumerate(targets)
    )
    return f"""
targets AS ({rows}),
exact AS (SELECT c.*, target, target_name, 'exact' AS match_kind FROM targets JOIN cards c
  ON c.card_name = target_name AND c.set_name = target_set AND c.card_number = target_number),
near AS (SELECT c.*, t.target, target_name, 'partial' AS match_kind, row_number() OVER (PARTITION BY t.target ORDER BY card_id) AS rn
  FROM targets t JOIN cards c ON c.card_name ILIKE '%' || target_name || '%' AND c.set_name ILIKE '%' || target_set || '%'
  WHERE t.target NOT IN (SELECT target FROM exact)),
found AS (SELECT card_id, card_name, set_name, card_number, target_name, match_kind FROM exact
  UNION ALL SELECT card_id, card_name, set_name, card_number, target_name, match_kind FROM near WHERE rn = 1)"""


@query("target_match", with_(CARDS, _targets_sql(TARGETS)) + "SELECT * FROM found")
def target_match(spark, sf_dir):
    return catalog.target_matches(cards(spark, sf_dir), TARGETS).select(
        "card_id", "card_name", "set_name", "card_number", "target_name", "match_kind"
    )


@query("curated_targets", with_(CARDS, SEALED, _targets_sql(fixed.CURATED_TARGETS)) + """
SELECT target_type, target_id, target_name, set_name FROM (
  SELECT 'card' AS target_type, min(card_id) AS target_id, card_name AS target_name, set_name, 0 AS o FROM found
  GROUP BY card_name, set_name, card_number
  UNION ALL SELECT 'sealed', sealed_product_id, product_name, set_name, 1 FROM sealed)
ORDER BY o, target_id LIMIT 40""")
def curated_targets(spark, sf_dir):
    return catalog.select_items("curated", cards(spark, sf_dir), views.sealed_products(spark, sf_dir), 40)


@query("diverse_sample", with_(CARDS) + f"""
SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY card_name, set_name, card_number ORDER BY card_id) AS rn FROM (
  SELECT * FROM cards WHERE card_name ILIKE '%charizard%' OR card_name ILIKE '%pikachu%'
  UNION ALL (SELECT * FROM cards ORDER BY card_id LIMIT 4))) WHERE rn = 1""")
def diverse_sample(spark, sf_dir):
    return catalog.select_items("diverse_sample", cards(spark, sf_dir), views.sealed_products(spark, sf_dir)).select(*NAMES)


@query("tracking_summary", with_(CARDS) + f"""
SELECT count(*) AS total, count(DISTINCT set_name) AS sets, count(DISTINCT card_name) AS names, count(DISTINCT rarity) AS rarities
FROM cards WHERE {any_in('lower(card_name)', fixed.HIGH_VALUE_NAMES)} OR {any_in('lower(rarity)', fixed.HIGH_VALUE_RARITIES)}""")
def tracking_summary(spark, sf_dir):
    return catalog.tracking_summary(catalog.high_value(cards(spark, sf_dir)))


@query("rarity_breakdown", with_(CARDS) + """
SELECT set_name, coalesce(rarity, 'Unknown') AS rarity, count(*) AS cards FROM cards GROUP BY ALL""")
def rarity_breakdown(spark, sf_dir):
    return catalog.rarity_breakdown(cards(spark, sf_dir))


# Brands play sets and part sizes card numbers; a tenth of the numbers are no numbers.
_BRANDS = """
numbered AS (SELECT p_brand AS set_name, CASE WHEN p_partkey % 10 = 0 THEN 'TG' ELSE '' END || p_size AS card_number, p_type AS rarity FROM part),
brands AS (SELECT set_name, max(TRY_CAST(card_number AS INT)) - 10 AS printed_total, count(*) AS total FROM numbered GROUP BY set_name)"""


def brand_cards(spark, sf_dir):
    prefix = F.when(F.col("p_partkey") % 10 == 0, "TG").otherwise("")
    return views.read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("set_name"), F.concat(prefix, F.col("p_size").cast("string")).alias("card_number"),
        F.col("p_type").alias("rarity"),
    )


def brands(spark, sf_dir):
    return brand_cards(spark, sf_dir).groupBy("set_name").agg(
        (F.max(F.col("card_number").try_cast("int")) - 10).alias("printed_total"), F.count("*").alias("total")
    )


@query("secret_rares", with_(_BRANDS) + """
SELECT set_name, printed_total, count(*) FILTER (WHERE TRY_CAST(card_number AS INT) > printed_total) AS secret_rare_count
FROM brands JOIN numbered USING (set_name) GROUP BY ALL""")
def secret_rares(spark, sf_dir):
    return catalog.secret_rare_counts(brand_cards(spark, sf_dir), brands(spark, sf_dir).drop("total"))


@query("set_rollup", with_(_BRANDS) + """
, by_rarity AS (SELECT set_name, rarity, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(card_number AS INT) > printed_total) AS s
  FROM numbered JOIN brands USING (set_name) GROUP BY ALL)
SELECT set_name, CAST(max(total) AS BIGINT) AS total_cards, CAST(max(printed_total) AS BIGINT) AS base_cards,
  CAST(sum(s) AS BIGINT) AS secret_rare_count, string_agg(rarity || '=' || n, ',' ORDER BY rarity) AS rarities, set_name AS api_id
FROM by_rarity JOIN brands USING (set_name) GROUP BY set_name""")
def set_rollup(spark, sf_dir):
    sets = brands(spark, sf_dir).select(
        F.col("set_name").alias("id"), F.col("set_name").alias("name"), F.lit("2000/01/01").alias("releaseDate"),
        F.col("total"), F.col("printed_total").alias("printedTotal"), F.lit("all").alias("series"),
    )
    members = brand_cards(spark, sf_dir).select(F.col("set_name").alias("set_id"), F.col("card_number").alias("number"), "rarity")
    rows = catalog.set_rows(sets, members)
    pairs = F.transform(
        F.array_sort(F.map_entries("rarity_breakdown")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.select(
        "set_name", F.col("total_cards").cast("bigint").alias("total_cards"), F.col("base_cards").cast("bigint").alias("base_cards"),
        "secret_rare_count", F.array_join(pairs, ",").alias("rarities"), F.col("structure.api_id").alias("api_id"),
    )


@query("variant_groups", with_(CARDS) + """
SELECT split_part(trim(card_name), ' ', 1) AS base_name, count(*) AS variants FROM cards GROUP BY ALL HAVING count(*) > 1""")
def variant_groups(spark, sf_dir):
    return audits.variant_groups(cards(spark, sf_dir))


@query("rarity_and_slug", with_(CARDS) + f"""
SELECT DISTINCT set_name, rarity, trim(regexp_replace(lower(set_name), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS slug,
  {when([(f"rarity = {quoted(k)}", quoted(v)) for k, v in fixed.RARITY_NAMES.items()], 'lower(rarity)')} AS rarity_name FROM cards""")
def rarity_and_slug(spark, sf_dir):
    rows = cards(spark, sf_dir).select("set_name", "rarity").distinct()
    return rows.withColumn("slug", text.slug(F.col("set_name"))).withColumn("rarity_name", text.rarity_name(F.col("rarity")))


# -- search terms -------------------------------------------------------------------------------------------


def items(spark, sf_dir):
    return spread(search.search_items(cards(spark, sf_dir), views.sealed_products(spark, sf_dir)))


_ITEMS = """
items AS (
  SELECT card_id AS item_id, 'card' AS item_type, card_name AS name, set_name AS s, card_number AS c, '' AS k FROM cards
  UNION ALL SELECT sealed_product_id, 'sealed_product', product_name, set_name, '', product_type FROM sealed
)"""
_PLAIN = """
terms AS (
  SELECT *, CASE WHEN item_type = 'card' THEN
    [name || ' pokemon card', name || ' ' || s || ' pokemon', name || ' ' || s || ' ' || c || ' pokemon', name || ' pokemon PSA 10',
     name || ' ' || s || ' PSA 10', name || ' pokemon BGS 10', name || ' ' || s || ' BGS 10', name || ' pokemon mint', name || ' ' || s || ' mint']
  ELSE list_filter([name || ' pokemon', name || ' sealed', s || ' ' || k || ' pokemon', s || ' ' || k || ' sealed',
     CASE WHEN contains(lower(name), 'booster box') THEN s || ' booster box' END,
     CASE WHEN contains(lower(name), 'booster box') THEN s || ' sealed booster box' END,
     CASE WHEN contains(lower(name), 'booster box') THEN s || ' booster case' END,
     CASE WHEN regexp_matches(lower(name), 'collection|premium|elite') THEN s || ' collection box' END,
     CASE WHEN regexp_matches(lower(name), 'collection|premium|elite') THEN s || ' premium collection' END,
     CASE WHEN regexp_matches(lower(name), 'collection|premium|elite') THEN s || ' elite trainer box' END], lambda x: x IS NOT NULL) END AS t
  FROM items
),
rows AS (SELECT item_id, item_type, name, s, c, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM terms),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_type, item_id, term ORDER BY i) AS dup FROM rows) WHERE dup = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY
    CASE WHEN contains(lower(term), lower(s)) AND c <> '' AND contains(term, c) THEN 0
         WHEN contains(lower(term), lower(s)) OR (c <> '' AND contains(term, c)) THEN 1 ELSE 2 END, i) - 1 AS position
  FROM kept
)"""


@query("search_plan", with_(CARDS, SEALED, _ITEMS, _PLAIN) + """
SELECT item_id, item_type, name AS item_name, position, term AS search_term FROM ranked WHERE position < 3""")
def search_plan(spark, sf_dir):
    return search.plan_terms(search.search_plan(items(spark, sf_dir)))


@query("search_plan_totals", with_(CARDS, SEALED, _ITEMS, _PLAIN) + """
SELECT (SELECT count(*) FROM items) AS total_items, count(*) AS total_searches,
  (SELECT count(*) FROM items WHERE item_type = 'card') AS cards_count,
  (SELECT count(*) FROM items WHERE item_type = 'sealed_product') AS sealed_products_count
FROM ranked WHERE position < 3""")
def search_plan_totals(spark, sf_dir):
    return search.plan_totals(search.search_plan(items(spark, sf_dir)))


_MARKET = f"""
terms AS (
  SELECT *, CASE WHEN item_type = 'card' THEN
    list_transform(['near mint', 'nm', 'mint', 'psa 10', 'psa 9', 'bgs 10', 'cgc 10'], lambda x: name || ' ' || c || ' ' || s || ' ' || x)
      || [name || ' ' || c || ' ' || s]
  ELSE list_filter(list_transform(['factory sealed', 'sealed english', 'new sealed', 'sealed new'], lambda x: s || ' ' || k || ' ' || x)
      || list_transform(['booster box factory sealed', 'booster box english sealed', 'booster box new', 'display box sealed'],
           lambda x: CASE WHEN contains(lower(name), 'booster box') THEN s || ' ' || x END)
      || list_transform(['elite trainer box sealed', 'ETB factory sealed', 'ETB new sealed'],
           lambda x: CASE WHEN contains(lower(name), 'elite trainer') THEN s || ' ' || x END)
      || [s || ' ' || k], lambda x: x IS NOT NULL) END AS t
  FROM items
),
rows AS (SELECT item_id, item_type, name, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM terms),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_type, item_id, lower(term) ORDER BY i) AS dup FROM rows) WHERE dup = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY
    CASE WHEN {any_in('lower(term)', fixed.CONDITION_KEYWORDS)} THEN 0 WHEN {any_in('lower(term)', fixed.SEALED_STATE_KEYWORDS)} THEN 1 ELSE 2 END, i) - 1 AS position
  FROM kept
)"""


@query("market_search_plan", with_(CARDS, SEALED, _ITEMS, _MARKET) + """
SELECT item_id, item_type, name AS item_name, position, term AS search_term FROM ranked WHERE position < 5""")
def market_search_plan(spark, sf_dir):
    return search.plan_terms(search.search_plan(items(spark, sf_dir), "ebay", 5))


_CHART = """
terms AS (
  SELECT *, CASE WHEN item_type = 'card' THEN
    [name || ' ' || c, name || ' ' || s || ' ' || c, name || ' (' || s || ') ' || c, name || ' (' || s || ')', name || ' - ' || s, name]
  ELSE list_filter([name, s || ' ' || k,
     CASE WHEN contains(lower(name), 'booster box') THEN s || ' Booster Box' END, CASE WHEN contains(lower(name), 'booster box') THEN s || ' Box' END,
     CASE WHEN contains(lower(name), 'elite trainer') THEN s || ' Elite Trainer Box' END,
     CASE WHEN contains(lower(name), 'elite trainer') THEN s || ' ETB' END], lambda x: x IS NOT NULL) END AS t
  FROM items
),
rows AS (SELECT item_id, item_type, name, c, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM terms),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_type, item_id, lower(term) ORDER BY i) AS dup FROM rows) WHERE dup = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY
    CASE WHEN c <> '' AND contains(term, c) THEN 0 WHEN trim(term) = trim(name) THEN 1 ELSE 2 END, i) - 1 AS position FROM kept
)"""


@query("chart_search_plan", with_(CARDS, SEALED, _ITEMS, _CHART) + """
SELECT item_id, item_type, name AS item_name, position, term AS search_term FROM ranked WHERE position < 4""")
def chart_search_plan(spark, sf_dir):
    return search.plan_terms(search.search_plan(items(spark, sf_dir), "pricecharting", 4))


@query("graded_search_terms", with_(CARDS, SEALED, _ITEMS, _PLAIN) + """
SELECT item_id, count(*) AS terms, max(term || ' ' || tail) AS last_term
FROM ranked, (SELECT unnest(['PSA', 'PSA 10', 'PSA 9.5', 'PSA 9', 'BGS', 'BGS 10', 'BGS 9.5', 'BGS 9', 'CGC', 'CGC 10', 'CGC 9.5', 'CGC 9',
  'mint', 'near mint', 'nm', 'lp', 'light played']) AS tail)
WHERE item_type = 'card' GROUP BY item_id""")
def graded_search_terms(spark, sf_dir):
    base = search.card_terms(F.col("card_name"), F.col("set_name"), F.col("card_number"))
    both = F.concat(search.graded_terms(F.col("base")), search.condition_terms(F.col("base")))
    rows = cards(spark, sf_dir).withColumn("base", base).withColumn("terms", both)
    return rows.select(
        F.col("card_id").alias("item_id"), F.size("terms").cast("bigint").alias("terms"), F.array_max("terms").alias("last_term")
    )


_ABBREVIATIONS = when([(f"lower(trim(set_name)) = {quoted(k)}", words(v)) for k, v in fixed.SET_ABBREVIATIONS.items()], """
  CASE WHEN len(string_split(set_name, ' ')) > 1 THEN [set_name, array_to_string(list_transform(string_split(set_name, ' '), lambda w: upper(w[1])), ''),
    split_part(set_name, ' ', 1)] ELSE [set_name] END""")


@query("name_variants", with_(CARDS) + f"""
SELECT card_id, array_to_string({_ABBREVIATIONS}, '|') AS set_forms,
  array_to_string(list_filter([card_name, card_name || ' TCG',
    {', '.join(f"CASE WHEN contains(lower(card_name), {quoted(x.lower())}) AND regexp_replace(card_name, {quoted('(?i)' + chr(92) + 's*' + x.replace('.', chr(92) + '.') + chr(92) + 's*$')}, '') <> card_name THEN regexp_replace(card_name, {quoted('(?i)' + chr(92) + 's*' + x.replace('.', chr(92) + '.') + chr(92) + 's*$')}, '') || ' pokemon card' END" for x in fixed.CARD_SUFFIXES)}],
    lambda x: x IS NOT NULL), '|') AS variants
FROM cards""")
def name_variants(spark, sf_dir):
    return cards(spark, sf_dir).select(
        "card_id", F.array_join(search.set_variations(F.col("set_name")), "|").alias("set_forms"),
        F.array_join(search.name_variants(F.col("card_name")), "|").alias("variants"),
    )


@query("search_urls", with_(CARDS) + """
SELECT card_id, 'https://market.example/sch?_nkw=' || replace(url_encode(card_name), '%20', '+') || '&_sop=12&LH_Sold=1&LH_Complete=1&_pgn=2&_ipg=60&_udlo=5' AS url
FROM cards""")
def search_urls(spark, sf_dir):
    url = text.search_url(
        "https://market.example/sch", F.col("card_name"), F.lit(2), min_price=F.lit(5), max_price=F.lit(None).cast("int")
    )
    return cards(spark, sf_dir).select("card_id", url.alias("url"))


# -- the other strategies, each a list of its own ---------------------------------------------------------

_PICKS = {
    "high_value": f"SELECT card_id FROM cards WHERE {any_in('lower(card_name)', fixed.HIGH_VALUE_NAMES)} OR {any_in('lower(rarity)', fixed.HIGH_VALUE_RARITIES)}",
    "by_set": "SELECT card_id FROM cards WHERE set_name = 'Lost Origin'",
    "by_name": "SELECT min(card_id) FROM cards WHERE card_name ILIKE '%umbreon%' GROUP BY card_name, set_name, card_number",
    "custom": "SELECT card_id FROM cards WHERE rarity IN ('Rare Holo', 'Secret Rare') AND set_name = 'Base Set'",
    "all_cards": "(SELECT card_id FROM cards ORDER BY card_id LIMIT 1000 OFFSET 50)",
    "sealed_only": "SELECT sealed_product_id FROM sealed",
}


@query("strategy_picks", with_(CARDS, SEALED) + " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, * FROM ({sql}) t(target_id)" for name, sql in _PICKS.items()))
def strategy_picks(spark, sf_dir):
    """What six strategies select from the whole catalog."""
    own, boxes = cards(spark, sf_dir), views.sealed_products(spark, sf_dir)
    options = {
        "high_value": {}, "by_set": {"set_name": "Lost Origin"}, "by_name": {"name": "Umbreon"},
        "custom": {"filters": {"rarity": ["Rare Holo", "Secret Rare"], "set_name": "Base Set"}}, "all_cards": {"offset": 50}, "sealed_only": {},
    }
    picks = None
    for name, more in options.items():
        key = "sealed_product_id" if name == "sealed_only" else "card_id"
        chosen = catalog.select_items(name, own, boxes, **more).select(F.lit(name).alias("strategy"), F.col(key).alias("target_id"))
        picks = chosen if picks is None else picks.unionByName(chosen)
    return picks


@query("tracked_listings", with_(LISTINGS, CARDS) + f"""
SELECT listing_id, card_id, l.price, c.card_name, c.rarity FROM listings l JOIN cards c ON c.card_id = l.product_id
WHERE {any_in('lower(card_name)', fixed.HIGH_VALUE_NAMES)} OR {any_in('lower(rarity)', fixed.HIGH_VALUE_RARITIES)}""")
def tracked_listings(spark, sf_dir):
    """Listings of the tracked cards alone, with the attributes of the card."""
    own = cards(spark, sf_dir)
    rows = preparation.listings_with_cards(views.listings(spark, sf_dir), own, catalog.high_value(own))
    return rows.select("listing_id", "card_id", "price", "card_name", "rarity")


@query("written_catalog", with_(CARDS, SEALED) + """
SELECT 'csv' AS kind, card_id AS id, card_name AS name, set_name, CAST(NULL AS DOUBLE) AS msrp FROM cards
UNION ALL SELECT 'json', sealed_product_id, product_name, set_name, msrp FROM sealed""")
def written_catalog(spark, sf_dir):
    """Both catalogs through the CSV and the JSON sink and back."""
    own = cards(spark, sf_dir).select(F.col("card_id").alias("id"), F.col("card_name").alias("name"), "set_name")
    boxes = views.sealed_products(spark, sf_dir).select(F.col("sealed_product_id").alias("id"), F.col("product_name").alias("name"), "set_name", "msrp")
    csv, json = scratch_path(spark, "catalog-csv"), scratch_path(spark, "catalog-json")
    ingest.write_csv(own, csv)
    ingest.write_json(boxes, json)
    one = spark.read.schema(own.schema).option("header", True).csv(csv).select(F.lit("csv").alias("kind"), "*", F.lit(None).cast("double").alias("msrp"))
    return one.unionByName(spark.read.schema(boxes.schema).json(json).select(F.lit("json").alias("kind"), "*"))
