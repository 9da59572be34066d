import pytest
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.operators import catalog, decisions, search


def values(spark, function, inputs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.x for r in frame.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_price(spark):
    texts = ["$12.34", "US $1,234.56", "1,234", "12,34", "$5.00 to $9.00", "free", "", None, "1.2.3", "$10"]
    assert values(spark, text.clean_price, texts) == [12.34, 1234.56, 1234.0, 12.34, 5.0, 0.0, 0.0, 0.0, 0.0, 10.0]


def test_parse_sale_date(spark):
    texts = [
        "Sold Jun 28, 2025", "ended Jun 8 2025", "6/28/2025", "6/28/25", "6/28/95", "2025-06-28", "Sold  jun 28", "soon", "",
        "Feb 30, 2025", None,
    ]
    got = values(spark, lambda c: text.parse_sale_date(c, F.lit(2024)), texts)
    days = [None if d is None else d.strftime("%Y-%m-%d") for d in got]
    assert days == [
        "2025-06-28", "2025-06-08", "2025-06-28", "2025-06-28", "1995-06-28", "2025-06-28", "2024-06-28", None, None, None, None,
    ]


def test_title_fields(spark):
    title = "2022 Pokemon Brilliant Stars Charizard V 154/172 psa 10"
    assert values(spark, text.grading_company, [title, "raw"]) == ["PSA", ""]
    assert values(spark, text.grade, [title, "BGS 9.5 mint"]) == ["10", "9.5"]
    assert values(spark, text.card_number, [title]) == ["154/172"]
    # the abbreviation is upper case and the title is lowered, so it never matches
    assert values(spark, text.title_set, [title, "charizard ES"]) == ["brilliant stars", ""]
    assert values(spark, text.title_name, [title, "Iron Valiant EX holo", "Pokemon Snorlax", "none"]) == [
        "Charizard", "Iron Valiant", "Snorlax", ""]


def test_conditions(spark):
    assert values(spark, text.normal_condition, ["PSA 10 gem", "psa 9", "PSA 8", "BGS 9", "CGC", "New", "Used", "x", None]) == [
        "PSA 10", "PSA 9", "PSA Other", "BGS", "CGC", "Raw NM", "Raw Used", "Other", "Other"]
    assert values(spark, text.whole_grade, ["10", "9.5", "", None]) == [10, None, None, None]


def test_names(spark):
    assert values(spark, text.clean_name, ["Mr. Mime - (Holo)", "Pokémon  V"]) == ["mr mime holo", "pokémon v"]
    pairs = spark.createDataFrame(
        [("charizard v", "pokemon charizard v holo"), ("charizard v", "blastoise ex"), ("dark blue star", "blue star cards"), ("", "x"), ("v", "ex")],
        "a string, b string",
    )
    got = [r.m for r in pairs.select(text.fuzzy_match(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [True, False, True, False, False]


def test_name_match_score(spark):
    rows = spark.createDataFrame(
        [("pokemon charizard v psa 10", "Charizard V"), ("zard v holo", "Charizard V"), ("nothing here", "Silver Tempest Booster Box"),
         ("silver box", "Silver Tempest Booster Box")], "t string, e string",
    )
    got = [round(r.s, 4) for r in rows.select(text.name_match_score(F.col("t"), F.col("e")).alias("s")).collect()]
    assert got == [1.0, 0.4, 0.0, 0.9]


def test_required_literal_never_rejects_a_match():
    import re

    from gavelwork.rules import fixed

    samples = [
        "box only", "box  only", "heavilyplayed", "lotof 5", "lot of 10", "12 cardlot", "3 pokemon lot", "yugioh", "yu-gi-oh",
        "creased", "crease", "1 pack", "12packs", "as is", "no cards", "5x card", "bulk sale", "plus extra",
    ]
    rules = [p for group in (fixed.GATE_V1_INVALID, fixed.GATE_V2_INVALID, fixed.SUSPICIOUS_TITLES) for ps in group.values() for p in ps]
    for pattern in [*rules, *fixed.GATE_V2_VALID, *fixed.GATE_V2_INDICATORS]:
        for sample in samples:
            if re.search(pattern, sample):
                assert text.required_literal(pattern) in sample


def test_kind(spark):
    rows = spark.createDataFrame(
        [("Lost Origin Booster Box", "sealed"), ("X ETB", "sealed"), ("Fire Theme Deck", "sealed"), ("Pikachu Tin", "sealed"),
         ("Giratina V", "card"), ("Premium Collection", "sealed"), ("Surprise", "sealed")], "n string, t string",
    )
    got = [r.k for r in rows.select(text.product_kind(F.col("n"), F.col("t")).alias("k")).collect()]
    assert got == ["booster_box_inclusive", "elite_trainer_box", "theme_deck", "tin", "card", "collection_box", "booster_box_inclusive"]


def test_price_reasonableness(spark):
    rows = spark.createDataFrame(
        [(100.0, "booster_box"), (70.0, "booster_box"), (500.0, "booster_box"), (10.0, "booster_box"), (1.0, "other")], "p double, k string")
    got = [round(r.s, 4) for r in rows.select(text.price_reasonableness(F.col("p"), F.col("k")).alias("s")).collect()]
    assert got == [1.0, 0.5, 0.5, 0.1, 0.5]


def test_verdict_defaults(spark):
    rows = spark.createDataFrame(
        [(1, 100.0, '{"action": "keep", "product_type": "booster_box"}'), (2, 5.0, None), (3, 5.0, "not json")],
        "listing_id int, price double, verdict string",
    )
    got = {r.listing_id: r for r in decisions.parse_verdicts(rows).collect()}
    assert (got[1].route, got[1].confidence, got[1].price_reasonableness) == ("kept", 0.5, 1.0)
    assert (got[2].route, got[2].detected_language, got[2].is_authentic) == ("flagged", "unknown", True)
    assert got[3].route == "flagged"
    assert decisions.decision_summary(decisions.parse_verdicts(rows).limit(0)).count() == 0


def test_search_terms(spark):
    one = spark.range(1)
    terms = lambda c: one.select(c.alias("t")).first().t
    assert terms(search.clean_terms(F.array(F.lit("A  b"), F.lit("a B"), F.lit("x"), F.lit("long one")))) == ["A b", "long one"]
    assert terms(search.card_terms(F.lit("Mew"), F.lit(""), F.lit("")))[:2] == ["Mew pokemon card", "Mew pokemon PSA 10"]
    assert terms(search.set_variations(F.lit("Evolving Skies"))) == ["evolving skies", "es", "evs"]
    assert terms(search.set_variations(F.lit("Crown Zenith"))) == ["Crown Zenith", "CZ", "Crown"]
    assert terms(search.name_variants(F.lit("Mew VMAX"))) == ["Mew VMAX", "Mew VMAX TCG", "Mew pokemon card"]


def test_like_wildcards(spark):
    names = spark.createDataFrame([("Mewtwo",), ("Mew_wo",)], "n string")
    assert names.filter(catalog.like(F.col("n"), "mew_wo")).count() == 2
    assert names.filter(catalog.like(F.col("n"), "mew_wo", escape=True)).count() == 1


@pytest.mark.parametrize("platform", ["ebay", "pricecharting"])
def test_terms_are_worked_out_once_per_item(spark, platform):
    items = spark.createDataFrame(
        [(1, "card", "Mew V", "Base Set", "3/200", None), (2, "sealed_product", "Base Set Tin", "Base Set", None, "Tin")],
        "item_id long, item_type string, item_name string, set_name string, card_number string, product_type string")
    plan = search.search_plan(items, platform, 2)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    got = {r.item_id: (r.search_terms, r.term_count) for r in plan.collect()}
    assert got == {
        "ebay": {1: (["Mew V 3/200 Base Set near mint", "Mew V 3/200 Base Set nm"], 2), 2: (["Base Set Tin factory sealed", "Base Set Tin sealed english"], 2)},
        "pricecharting": {1: (["Mew V 3/200", "Mew V Base Set 3/200"], 2), 2: (["Base Set Tin"], 1)},
    }[platform]
