import pytest
from pyspark.sql import functions as F

from gavelwork.functions import text
from gavelwork.operators import quality

# title, expected item, sealed, passes
CASES = [
    ("2022 Pokemon Sword & Shield Brilliant Stars Charizard V #154 PSA 10", "Charizard V", False, True),
    ("Pokemon Charizard V 154/172 Brilliant Stars Alt Art Ultra Rare NM", "Charizard V", False, True),
    ("Pikachu VMAX 188/185 Vivid Voltage Rainbow Rare Pokemon Card NM/M", "Pikachu VMAX", False, True),
    ("34 Pokemon Card Lot Mixed Condition Vintage", "Charizard V", False, False),
    ("Charizard V Damaged Creased Water Damage As Is", "Charizard V", False, False),
    ("Evolving Skies Booster Box Pokemon TCG Sealed", "Evolving Skies Booster Box", True, True),
    ("Pokemon Silver Tempest Elite Trainer Box ETB Sealed", "Silver Tempest Elite Trainer Box", True, True),
    ("Random Pokemon Card Mystery Box Lot", "Brilliant Stars Booster Box", True, False),
]


def test_gate_v2(spark):
    rows = spark.createDataFrame(
        [(i, t, 150.0 if s else 25.0, e, s) for i, (t, e, s, _) in enumerate(CASES)],
        "i int, title string, price double, product_name string, sealed boolean",
    )
    got = quality.gate_v2(rows, sealed=F.col("sealed")).orderBy("i").collect()
    assert [r.is_valid for r in got] == [c[3] for c in CASES]
    assert got[3].reason_class == "Invalid" and got[3].invalid_category == "vague"


@pytest.mark.parametrize("title, price, reason", [
    ("", 5.0, "No title"), (None, 5.0, "No title"), ("Charizard card fine", 0.0, "Invalid price"),
    ("Charizard card fine", 0.2, "Price too low (likely damaged/fake)"),
    ("some garden chair here", 5.0, "No Pokemon name or 'pokemon' found in title"),
    ("mew tcg", 5.0, "Title too short"), ("charizardtcg card", 5.0, "Title too simple"),
])
def test_gate_v2_reasons(spark, title, price, reason):
    rows = spark.createDataFrame([(title, price)], "title string, price double")
    assert quality.gate_v2(rows, expected=None).first().reason == reason


def test_gate_v1_score_has_no_cap(spark):
    rows = spark.createDataFrame(
        [("Pokemon Charizard V 079/073 Secret Rare PSA 10", 10.0, "Charizard")], "title string, price double, product_name string")
    got = quality.gate_v1(rows).first()
    assert got.is_valid and got.quality_score == pytest.approx(1.4)


def listing(i, price, title="Charizard V holo", product=("card", 1), source="ebay", condition="raw", name="Charizard V"):
    return (f"l{i:04d}", product[0], product[1], name, title, float(price), source, condition)


SCHEMA = (
    "listing_id string, product_type string, product_id int, product_name string, title string, price double,"
    " source string, condition_category string"
)


def test_filter_stages(spark):
    rows = [listing(i, 100 + i) for i in range(12)]
    rows += [listing(100, 20000), listing(101, 100, "Charizard damaged"), listing(102, 9000), listing(103, 100, "damaged", source="chart")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.listing_id: r.removed_by for r in quality.filter_listings(frame).collect()}
    assert got["l0100"] == "price_threshold"
    assert got["l0101"] == "title_pattern"
    assert got["l0102"] == "statistical"
    assert got["l0103"] is None  # title rules are for one source only
    assert sum(v is None for v in got.values()) == 13
    counts = quality.filter_counts(frame)
    funnel = quality.filter_funnel(counts).first()
    assert (funnel.original_count, funnel.price_removed, funnel.title_removed, funnel.stat_removed, funnel.final_count) == (16, 1, 1, 1, 13)
    assert quality.clean_listings(frame).count() == 13


def test_small_groups_are_kept(spark):
    few = spark.createDataFrame([listing(i, p) for i, p in enumerate([1, 1, 1, 5000])], SCHEMA)
    assert quality.clean_listings(few).count() == 4
    split = spark.createDataFrame(
        [listing(i, 10 + i) for i in range(4)] + [listing(10 + i, 9000 * i + 1, condition="graded") for i in range(2)], SCHEMA)
    assert quality.clean_listings(split).count() == 6


def test_strict_box_rules_by_explicit_kind(spark):
    rows = spark.createDataFrame([
        listing(1, 100, "brilliant stars booster box"), listing(2, 100, "booster pack of cards"), listing(3, 100, "36 pack case"),
        listing(4, 100, "pack box booster"), listing(5, 100, "display"), listing(6, 10, "booster box"),
    ], SCHEMA)
    got = {r.listing_id: r.rule_reason for r in quality.rule_stage(rows, kind="booster_box").collect()}
    assert got == {
        "l0001": None, "l0002": "title_pattern", "l0003": "title_pattern", "l0004": None, "l0005": "title_pattern",
        "l0006": "price_threshold",
    }


def test_hot_group(spark):
    """Two thirds of all rows in one group: limits and result stay exact."""
    hot = spark.range(30_000).select(
        F.format_string("h%06d", "id").alias("listing_id"), F.lit("card").alias("product_type"), F.lit(1).alias("product_id"),
        F.lit("Charizard V").alias("product_name"), F.lit("Charizard V").alias("title"),
        (F.lit(100.0) + F.col("id") % 100).alias("price"), F.lit("ebay").alias("source"), F.lit("raw").alias("condition_category"),
    )
    outliers = spark.createDataFrame([listing(1, 9000), listing(2, 1)], SCHEMA)
    rows = quality.filter_listings(hot.unionByName(outliers)).filter("removed_by = 'statistical'").collect()
    assert sorted(r.listing_id for r in rows) == ["l0001", "l0002"]


def test_title_mismatch(spark):
    rows = spark.createDataFrame([
        ("a", "Pikachu VMAX vivid voltage 188/185", "Charizard V", "Brilliant Stars", "154/172"),
        ("b", "Charizard V brilliant stars 154/172", "Charizard V", "Brilliant Stars", "154/172"),
        ("c", "Charizard V", "", "Brilliant Stars", "154/172"),
    ], "listing_id string, title string, card_name string, set_name string, card_number string")
    got = quality.title_mismatches(rows).collect()
    assert len(got) == 1
    assert got[0].mismatch_reasons == [
        "Card name not found in title", "Different Pokemon: expected charizard, found pikachu",
        "Potential set mismatch: expected Brilliant Stars", "Card number mismatch: expected 154/172",
    ]


def test_gates_take_other_rules(spark):
    rows = spark.createDataFrame([("Garden gnome mint boxed", 5.0), ("Garden gnome chipped mint", 5.0)], "title string, price double")
    rules = {**quality.RULES_V2, "names": ("gnome",), "invalid": {"damaged": (r"\bchipped\b",)}}
    got = [(r.is_valid, r.invalid_category) for r in quality.gate_v2(rows, expected=None, rules=rules).orderBy("title").collect()]
    assert got == [(False, "damaged"), (True, None)]
    rules = {**quality.RULES_V1, "names": ("gnome",), "invalid": {"damaged": (r"\bchipped\b",)}}
    assert [r.is_valid for r in quality.gate_v1(rows, expected=None, rules=rules).orderBy("title").collect()] == [False, True]


def test_titles_are_lowered_once(spark):
    rows = spark.createDataFrame(
        [(1, "Charizard V as is", "Charizard V", "Base Set", "1/200", 3.0)],
        "listing_id int, title string, product_name string, set_name string, card_number string, price double",
    ).withColumn("card_name", F.col("product_name"))
    for frame in (quality.gate_v2(rows), quality.gate_v1(rows), quality.title_mismatches(rows)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Contains(lower(" not in plan and "RLIKE(lower(" not in plan


def test_patterns_are_searched_alone(spark):
    rows = spark.createDataFrame([("as iss",), ("sold as is",), ("base set",), ("lot of 3",), ("7 of",), (None,)], "t string")
    found = rows.select(text.any_alone(F.col("t"), (r"\bas\s*is\b", r"\blot\s*of\s*\d+", r"\b\d+ of\b")).alias("f")).collect()
    assert [r.f for r in found] == [False, True, False, True, True, None]


def test_first_known_name_or_first_word(spark):
    rows = spark.createDataFrame([("shiny mewtwo lugia",), ("base set",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.main_name(F.col("t"))).collect()] == ["mew", "base", "", ""]
