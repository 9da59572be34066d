import json
import time

import pytest

from gavelwork.operators import catalog
from gavelwork.plans import preparation
from gavelwork.registry import page_queries
from gavelwork.rules import targets
from gavelwork.sources import catalog_files, pages
from gavelwork.sources.html_tree import parse

NEW = """<html><ul class="srp-results x"><li class="s-card s-card--h"><div class="s-card__title"><span class="su-styled-text">
Charizard V 154/172 PSA 10</span></div><div class="s-card__caption"><span class="su-styled-text">Sold  Jun 28, 2025</span></div>
<span class="s-card__price">$1,234.56</span><a class="su-link" href="http://x/1?a=1&amp;b=2">l</a><div class="s-card__attribute-row">12 bids</div>
<div class="s-card__attribute-row">+$4.99 delivery</div><img src="a.jpg"></li>
<li class="s-card"><div class="s-card__title"><span class="su-styled-text">Pikachu ex</span></div> Sold Jan 3</li>
<li class="s-card"><div class="s-card__title"></div></li></ul></html>"""
OLD = """<div class="s-item"><div class="s-item__title"><span>Umbreon VMAX</span></div><span class="s-item__price">$10.00 to $20.00</span>
<span class="s-item__ended-date">Ended Dec 15, 2023</span><span class="s-item__bids">3 bids</span>
<span class="s-item__purchase-options">or Best Offer</span></div>"""
CHART = """<h1>Item X</h1><div class="product-detail">Genre: Card</div><script>var x = "<table>"; y=[[1704067200000,1250],[1704153600000,0]]</script>
<table class="price-summary"><tr><th>Ungraded</th><td>$12.50</td></tr><tr><th>PSA 10</th><td>$99.50</td></tr><tr><th>Graded</th><td>$6</td></tr></table>
<table><tr><th>Date</th><th>Title</th><th>Price</th></tr><tr><td>2024-01-02</td><td>charizard card sold here</td><td class="numeric">$55.25</td></tr></table>
<p><span class="price">$7.50</span> loose</p><section class="tour"><div class="current-price">$44.10</div></section>"""


@pytest.fixture(scope="module")
def landed(spark):
    return spark.createDataFrame([("new", NEW), ("old", OLD), ("chart", CHART), ("none", None)], "url string, html string")


def test_listings_of_both_layouts(landed):
    got = {(r.url, r.position): r for r in pages.parse_listings(landed).collect()}
    assert set(got) == {("new", 0), ("new", 1), ("old", 0)}
    first, second, old = got["new", 0], got["new", 1], got["old", 0]
    assert (first.price, first.listing_url, first.bids, first.is_auction) == (1234.56, "http://x/1?a=1&b=2", 12, True)
    assert (first.shipping, first.sold_text, first.grade, first.card_name) == ("+$4.99 delivery", "Sold  Jun 28, 2025", "10", "Charizard")
    assert (second.sold_text, second.price, second.is_auction) == ("Jan 3", 0.0, False)
    assert (old.price, old.bids, old.sold_text, old.is_auction) == (10.0, 3, "Ended Dec 15, 2023", False)


def test_chart_page(landed):
    points = pages.chart_points(landed).collect()
    assert [(p.url, str(p.price_date), p.price) for p in points] == [("chart", "2024-01-01", 12.5)]
    tables = pages.page_tables(landed)
    assert [(r.date, r.price) for r in pages.table_prices(tables).collect()] == [("2024-01-02", 55.25)]
    assert [r.price for r in pages.sales_table_prices(tables).collect()] == [55.25]
    assert {r.condition: r.price for r in pages.summary_prices(tables).collect()} == {"ungraded": 12.5, "psa_10": 99.5}
    found = {(r.url, r.condition): r.price for r in pages.current_prices(landed).collect()}
    assert found["chart", "loose"] == 7.5 and found["chart", "current"] == 44.1
    assert [r for r in pages.display_prices(landed).collect() if r.url == "chart"] == []
    details = {r.url: r for r in pages.product_details(landed).collect()}
    assert details["chart"].title == "Item X" and details["chart"].details == {"genre": "Card"}


def test_chart_arrays(spark):
    html = '<script>chartData = [["2024-01-01","s","a card","$12.5","r"],["bad"]]; data: [{"date":"2024-02-01","price":"$33"},{"date":"2024-02-02","price":"6"}]</script>'
    rows = pages.chart_arrays(spark.createDataFrame([("a", html), ("b", CHART)], "url string, html string")).collect()
    assert [(r.url, r.date, r.price) for r in rows] == [("a", "2024-01-01", 12.5), ("a", "2024-02-01", 33.0)]


def test_tree_survives_bad_markup():
    page = parse('<div class="a"><p>one<p>two</div></span> x < 3 <b title=unclosed>t<!-- <i> --></b><style>p{a:"<b>"}</style>')
    assert [n.tag for n in page.walk()] == ["div", "p", "p", "b", "style"]
    assert page.first(lambda n: n.tag == "div").text() == "onetwo"
    assert "x < 3" in page.text()


def test_catalog_files(spark, tmp_path):
    cards = [
        {"name": "A", "number": "1", "rarity": "Common", "set_name": "One", "set_series": "S"},
        {"name": "B", "number": "TG1", "rarity": None, "set_name": "One", "set_series": "S"},
        {"name": "C", "number": "3", "rarity": "Common", "set_name": "One", "set_series": "S"},
    ]
    (tmp_path / "cards_one.json").write_text(json.dumps(cards))
    (tmp_path / "cards_two5.json").write_text(json.dumps(cards[:1]))
    (tmp_path / "sets.json").write_text(json.dumps([
        {"id": "one", "name": "One", "releaseDate": "1999/01/09", "total": 3, "printedTotal": 2, "series": "S"},
        {"id": "zzz", "name": "None", "releaseDate": None, "total": None, "printedTotal": None, "series": None},
    ]))
    files = catalog_files.card_files(spark, str(tmp_path))
    assert {r.set_id: r["count"] for r in files.groupBy("set_id").count().collect()} == {"one": 3, "two5": 1}
    rows = {r.set_name: r for r in catalog.set_rows(catalog_files.set_file(spark, str(tmp_path / "sets.json")), files).collect()}
    assert rows["One"].rarity_breakdown == {"Common": 2, "Unknown": 1}
    assert (rows["One"].secret_rare_count, rows["One"].structure.printed, rows["None"].total_cards) == (1, 2, 0)
    assert rows["None"].rarity_breakdown == {}
    assert {r.rarity for r in catalog.card_rows(files).collect()} == {"Common", "Unknown"}


def test_newest_history_file(spark, tmp_path):
    for day, price in (("20240101", 1.0), ("20240301", 3.0), ("20240201", 2.0)):
        body = {"cards": [{"card_id": "7", "pricecharting_data": {"current_prices": {"loose": price}, "url": "u",
                "historical_chart_data": [{"date": "2024-01-05", "price": price}]}}], "sealed_products": []}
        (tmp_path / f"pricecharting_historical_{day}.json").write_text(json.dumps(body))
    history = catalog_files.latest_history(spark, str(tmp_path))
    row = catalog_files.chart_prices(history).first()
    assert (row.card_id, row.pc_loose_price, row.pc_current_price) == ("7", 3.0, None)
    assert [(r.product_id, r.price) for r in catalog_files.history_points(history).collect()] == [("7", 3.0)]


def test_payloads(spark):
    body = json.dumps({"data": [{"name": "A", "number": "1", "rarity": "Rare", "set": {"name": "One", "series": "S"}}]})
    card = catalog_files.cards_from_payload(spark.createDataFrame([(body,)], "payload string")).first()
    assert (card.name, card.set_name, card.set_series) == ("A", "One", "S")
    body = json.dumps({"data": [{"id": "o", "name": "One", "total": 3}]})
    assert catalog_files.sets_from_payload(spark.createDataFrame([(body,)], "payload string")).first().total == 3


def test_watch_list(spark):
    assert targets.sealed_targets(spark).count() == 45
    assert targets.card_targets(spark).count() == 50
    assert targets.target_categories(spark).first().category in ("151_growth", "vintage_rare")


def test_sealed_fallback(spark):
    empty = spark.createDataFrame([], "sealed_product_id bigint, product_name string, set_name string, product_type string, msrp double")
    assert catalog.sealed_or_fallback(empty).count() == 5


def test_unified_without_chart(spark, tmp_path):
    listings = spark.sql("SELECT 'l' listing_id, 1 product_id, 5.0D price, timestamp '2024-01-01' sold_date, true is_graded, '9.5' grade")
    cards = spark.sql("SELECT 1 card_id, 'A' card_name, 'S' set_name, '1' card_number, 'Rare' rarity")
    from pyspark.sql import functions as F

    rows, stats = preparation.prepare(listings, cards, None, F.lit("2024-02-01").cast("timestamp"))
    row = rows.first()
    assert (row.price_vs_pc_current, row.price_premium_pc, row.rarity_rank, row.grade_numeric, row.day_of_week) == (1.0, None, 3, 9.5, 0)
    preparation.save(rows, stats, str(tmp_path), "x")
    assert spark.read.option("header", True).csv(str(tmp_path / "card_stats_x")).count() == 1


@pytest.mark.parametrize("strategy", ["high_value", "curated", "diverse_sample", "custom", "all_cards", "sealed_only"])
def test_strategies(spark, strategy):
    cards = spark.createDataFrame([(i, f"Charizard {i}", "Base Set", str(i), "Rare Holo") for i in range(8)],
                                  "card_id int, card_name string, set_name string, card_number string, rarity string")
    sealed = spark.createDataFrame([(1, "Box", "Base Set", "Booster Box", 1.0)],
                                   "sealed_product_id int, product_name string, set_name string, product_type string, msrp double")
    assert 0 < catalog.select_items(strategy, cards, sealed, 3).count() <= 3


def test_a_long_table_takes_seconds(spark):
    """The work on a page follows its size: 10,000 rows do not read the page's text 10,000 times."""
    begin = time.time()
    rows = "".join(f"<tr><td>2024-01-01</td><td>item {i}</td><td class='price'>${i % 90 + 1}.00</td></tr>" for i in range(10_000))
    page = spark.createDataFrame(
        [("u", f"<html><body><div><table><tr><th>Date</th><th>Title</th><th>Price</th></tr>{rows}</table></div></body></html>")], "url string, html string"
    )
    assert pages.page_tables(page).count() >= 10_000
    pages.current_prices(page).collect()
    assert time.time() - begin < 60


def test_pages_of_a_small_file_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"part {i}", "Brand#1", 7, 900.0 + i) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = page_queries.product_pages(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 4
    assert sorted((r.url, r.title) for r in pages.product_details(made).collect()) == sorted((str(i), f"part {i}") for i in range(40))


def test_tree_is_runs_of_the_page_lists():
    """Start tags of the same text are read once, and what lies below an element is a run of the page's elements and texts."""
    html = '<div class="a b">1<p id="x">2<br>3<i class="a b">4</i></p>5<p>6</div>7<p id="x">8<script><b>9</script></q>'
    page = parse(html)
    nodes = page.all(lambda n: True)
    first, last = page.all(lambda n: n.attrs.get("id") == "x")
    assert first.attrs is last.attrs and nodes[0].classes == ["a", "b"]
    for node in [page, *nodes]:
        assert node.walk() == [n for n in nodes if node in n.above()]
    assert [n.text() for n in nodes] == ["123456", "234", "", "4", "6", "8<b>9", "<b>9"] and page.text() == "12345678<b>9"
    assert first.text(strip=True) == "234" and last.first(lambda n: n.tag == "b") is None


def test_places_without_a_title_are_no_rows_and_a_page_is_freed():
    """In the older layout the parts of an item have item classes too; they count as places, but nothing is made of them."""
    import pyarrow as pa

    item = '<div class="s-item"><div class="s-item__title"><span>{0}</span></div><span class="s-item__ended-date">Ended Jan {0}, 2024</span></div>'
    html = '<div id="srp-river-results">' + "".join(item.format(t) for t in (1, "", 3)) + "</div>"
    rows = list(pages._item_rows(parse(html)))
    assert [(r[0], r[1], r[10]) for r in rows] == [(0, "1", "Ended Jan 1, 2024"), (4, "3", "Ended Jan 3, 2024")]
    seen = []

    def extract(page):
        seen.append(page)
        yield (len(page.walk()),)

    schema = pa.schema([("url", pa.string()), ("n", pa.int32())])
    batch = pa.RecordBatch.from_pydict({"url": ["a", "b"], "html": [html, None]})
    out = pa.Table.from_batches(pages._job(extract, schema)(iter([batch]))).to_pydict()
    assert out == {"url": ["a", "b"], "n": [13, 0]} and seen[0].walk() == []


def test_markup_is_the_same_with_and_without_raw_elements():
    """Pages are split at once unless they hold elements whose content is no markup."""
    body = '<ul class="srp-results a"><li title="x>y">1 &amp; 2<!-- <i> --><br/>3</LI><a"x y">4<b a=\'q>5</ul><?p?>6 < 7'
    known = {}
    plain, raw = parse(body, known), parse(body + "<SCRIPT>if (a<b) {}</script ><i>8<style>p{", known)
    assert [n.tag for n in plain.walk()] == ["ul", "li", "br", 'a', "b"] and raw.all(lambda n: True)[5].tag == "script"
    assert [(n.tag, n.attrs, n.text()) for n in raw.walk()[:5]] == [(n.tag, n.attrs, n.text()) for n in plain.walk()]
    assert raw.text() == plain.text() + "if (a<b) {}8p{" and [n.text() for n in raw.walk()[5:]] == ["if (a<b) {}", "8p{", "p{"]
