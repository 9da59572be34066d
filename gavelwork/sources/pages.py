"""Listings, tables, prices and chart points from landed pages (``url``, ``html``).

Python only turns markup into rows of text (one task batch at a time); prices, dates,
conditions and checks are column expressions on those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gavelwork.functions import text
from gavelwork.sources.html_tree import Element, parse, tagged

DATE_CELL = r"^20\d{2}-\d{1,2}-\d{1,2}"
PRICE = r"\$(\d+\.?\d*)"


def _job(extract: Callable[[Element], Iterator[tuple]], schema: pa.Schema):
    """``mapInArrow`` body: parse page after page, emit the extracted rows a few at a time."""
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        known: dict = {}
        for batch in batches:
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html")):
                page = parse(html.as_py(), known)
                for row in extract(page):
                    rows.append((url, *row))
                    if len(rows) >= 1000:
                        yield packed(rows)
                        rows = []
                page.page[0].clear()  # elements lead to this list and it to them: else they wait for the collector
        yield packed(rows)

    return run


def _extract(pages: DataFrame, extract: Callable[[Element], Iterator[tuple]], ddl: str) -> DataFrame:
    """Rows of every page, with the columns of a DDL text."""
    return pages.select("url", "html").mapInArrow(_job(extract, to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def _text(node: Element | None) -> str:
    return node.text(strip=True) if node is not None else ""


# -- result pages ------------------------------------------------------------------------------

ITEM_SCHEMA = (
    "url string, position int, title string, price_text string, listing_url string, condition string,"
    " attribute_rows array<string>, options_text string, bids_text string, shipping_text string,"
    " image_url string, caption string, item_text string, new_layout boolean"
)
# Elements that can hold the sale date in the older layout, in order.
OLD_DATE_ELEMENTS = (
    ("span", "s-item__ended-date", None),
    ("span", "s-item__time-left", None),
    ("div", "s-item__detail--primary", None),
    ("span", "s-item__time-end", None),
    ("span", None, "sold"),
    ("span", None, "date"),
)


def _items(page: Element) -> list[Element]:
    box = page.first(tagged("ul", like="srp-results")) or page.first(
        lambda n: n.tag == "div" and n.attrs.get("id") == "srp-river-results"
    )
    inside = box or page
    for tag, like in (("li", "s-card"), ("li", "s-item"), ("div", "s-item")):
        found = inside.all(tagged(tag, like=like))
        if found:
            return found
    return []


class _Index:
    """First element of every (tag, class) below an item, from one walk."""

    def __init__(self, item: Element):
        self.item = item
        self.found: dict[tuple[str, str], Element] = {}
        self.rows: list[Element] = []
        self.image: Element | None = None
        for node in item.walk():
            for name in node.classes:
                self.found.setdefault((node.tag, name), node)
            if node.tag == "img" and self.image is None:
                self.image = node
            elif node.tag == "div" and "s-card__attribute-row" in node.classes:
                self.rows.append(node)

    def text(self, tag: str, name: str) -> str:
        return _text(self.found.get((tag, name)))

    def span(self, tag: str, name: str, inner: str | None) -> str:
        """Text of the first span (of a class, when given) inside an element."""
        node = self.found.get((tag, name))
        for below in node.walk() if node is not None else ():
            if below.tag == "span" and (inner is None or inner in below.classes):
                return below.text(strip=True)
        return ""

    def first(self, tag: str, name: str | None, like: str | None) -> Element | None:
        """First element below the item that passes ``tagged(tag, name, like)``."""
        return self.found.get((tag, name)) if like is None and name is not None else self.item.first(tagged(tag, name, like))

    def link(self, name: str) -> str:
        node = self.found.get(("a", name))
        return "" if node is None else node.attrs.get("href") or ""


def _item_rows(page: Element) -> Iterator[tuple]:
    """Items that have a title, with their places among all items."""
    for position, item in enumerate(_items(page)):
        new = "s-card" in item.classes
        at = _Index(item)
        title = at.span("div", "s-card__title", "su-styled-text") if new else at.span("div", "s-item__title", None)
        if not title:
            continue
        image = at.image
        source = "" if image is None else image.attrs.get("data-defer-load") or image.attrs.get("src") or ""
        if new:
            caption = at.span("div", "s-card__caption", "su-styled-text")
            row = (
                title,
                at.text("span", "s-card__price"),
                at.link("su-link"),
                at.span("div", "s-card__subtitle", "su-styled-text"),
                [n.text(strip=True) for n in at.rows],
                "", "", "",
                source,
                caption if "sold" in caption.lower() else "",
            )
        else:
            dates = (_text(at.first(*where)) for where in OLD_DATE_ELEMENTS)
            row = (
                title,
                at.text("span", "s-item__price"),
                at.link("s-item__link"),
                at.span("div", "s-item__subtitle", "SECONDARY_INFO"),
                [],
                at.text("span", "s-item__purchase-options"),
                at.text("span", "s-item__bids"),
                at.text("span", "s-item__shipping"),
                source,
                next((d for d in dates if "sold" in d.lower() or "ended" in d.lower()), ""),
            )
        yield (position, *row, item.text(), new)


def parse_listings(pages: DataFrame) -> DataFrame:
    """One row per item of every result page, both layouts, with parsed title fields.

    Items without a title are dropped. ``sold_text`` is still text; see
    ``ingest.prepare_listings``.
    """
    raw = _extract(pages, _item_rows, ITEM_SCHEMA)  # with titles only
    new = F.col("new_layout")
    low_rows = F.transform("attribute_rows", F.lower)
    auction_rows = F.filter(low_rows, lambda t: t.contains("bid") | t.contains("auction"))
    counts = F.filter(auction_rows, lambda t: t.rlike(r"\d+\s+bid"))
    shipping_rows = F.filter(
        "attribute_rows",
        lambda t: ~(F.lower(t).contains("bid") | F.lower(t).contains("auction"))
        & (F.lower(t).contains("delivery") | F.lower(t).contains("shipping")),
    )
    last = lambda array: F.get(array, F.size(array) - 1)
    bids = F.when(new, text.extract(last(counts), r"(\d+)\s+bid")).otherwise(text.extract(F.col("bids_text"), r"(\d+)"))
    title = F.col("title")
    return raw.select(
        "url", "position", "title",
        text.clean_price(F.col("price_text")).alias("price"),
        "listing_url", "condition", "image_url",
        F.when(new, F.size(auction_rows) > 0).otherwise(
            F.lower("options_text").rlike("bid|auction")
        ).alias("is_auction"),
        F.coalesce(bids.try_cast("int"), F.lit(0)).alias("bids"),
        F.when(new, F.coalesce(last(shipping_rows), F.lit(""))).otherwise(F.col("shipping_text")).alias("shipping"),
        F.coalesce(text.empty_to_null(F.col("caption")), text.sold_text(F.col("item_text"))).alias("sold_text"),
        text.is_graded(title).alias("is_graded"),
        text.grading_company(title).alias("grading_company"),
        text.grade(title).alias("grade"),
        text.card_number(title).alias("card_number"),
        text.title_set(title).alias("set_name"),
        text.title_name(title).alias("card_name"),
    )


# -- chart points ---------------------------------------------------------------------------------


def chart_points(pages: DataFrame) -> DataFrame:
    """``[epoch ms, cents]`` pairs of a page as dated prices; zero prices are dropped."""
    pairs = F.regexp_extract_all("html", F.lit(r"\[(\d{13}),(\d+)\]"), F.lit(0))
    pair = F.col("_pair")
    ms = F.regexp_extract(pair, r"\[(\d{13}),", 1).cast("bigint")
    cents = F.regexp_extract(pair, r",(\d+)\]", 1).try_cast("bigint")
    return (
        pages.select("url", F.posexplode(pairs).alias("position", "_pair"))
        .select(
            "url", "position", ms.alias("timestamp_ms"), F.timestamp_millis(ms).alias("ts"),
            F.to_date(F.timestamp_millis(ms)).alias("price_date"), cents.alias("raw_price_cents"),
            (cents / 100).alias("price"),
        )
        .filter(F.col("raw_price_cents") > 0)
    )


# Assignments that can hold a chart array, tried in this order.
ARRAY_PATTERNS = (
    r"(?s)chartData\s*=\s*(\[.*?\]);",
    r"(?s)priceData\s*=\s*(\[.*?\]);",
    r"(?s)historyData\s*=\s*(\[.*?\]);",
    r"(?s)data:\s*(\[.*?\])",
    r"(?s)series:\s*\[\s*\{\s*data:\s*(\[.*?\])",
    r'(?s)"data":\s*(\[.*?\])',
    r"(?s)price_history\s*=\s*(\[.*?\]);",
)


def variant_list(value: Column) -> Column:
    """The entries of a VARIANT that is a list, NULL if it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def variant_text(entry: Column, *paths: str) -> Column:
    """The first of the paths that a VARIANT has a plain value at, as trimmed text."""
    return F.trim(F.coalesce(*[F.try_variant_get(entry, path, "string") for path in paths]))


def is_record(entry: Column) -> Column:
    """True for a VARIANT that is a list or an object."""
    return F.schema_of_variant(entry).rlike("^(ARRAY|OBJECT)<")


def chart_arrays(pages: DataFrame) -> DataFrame:
    """Dated prices from chart arrays, for pages without ``[epoch ms, cents]`` pairs.

    An entry is a list (date, _, description, price, ...) or an object with date and price; an
    array may mix them, as each entry is a VARIANT whose fields are asked for by path. Text that is no JSON
    is no array. Per pattern the first array of such entries counts.
    """
    def entries(pattern: str) -> Column:
        texts = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
        lists = F.transform(texts, lambda t: variant_list(F.try_parse_json(t)))
        fine = F.filter(lists, lambda a: a.isNotNull() & (F.size(a) > 0) & is_record(F.get(a, F.lit(0))))
        return F.coalesce(F.get(fine, F.lit(0)), F.array().cast("array<variant>"))

    rows = pages.filter(~F.col("html").rlike(r"\[(\d{13}),(\d+)\]")).select(
        "url", F.posexplode(F.concat(*[entries(p) for p in ARRAY_PATTERNS])).alias("position", "_e"))
    entry = F.col("_e")
    first, description, last = variant_text(entry, "$[0]"), variant_text(entry, "$[2]"), variant_text(entry, "$[3]")
    size = F.size(variant_list(entry))
    listed = (
        (size >= 4)
        & first.rlike(DATE_CELL)
        & ~F.lower(description).contains("subscribe")
        & ~F.lower(description).contains("$6/month")
    )
    date, price = variant_text(entry, "$.date"), variant_text(entry, "$.price")
    keyed = date.isNotNull() & price.isNotNull()
    found = rows.select(
        "url", "position",
        F.when(listed, first).when(keyed, date).alias("date"),
        F.when(listed, text.extract(last, r"\$?(\d+\.?\d*)"))
        .when(keyed, text.extract(price, r"(\d+\.?\d*)"))
        .cast("double").alias("price"),
        F.when(listed, description).alias("description"),
    )
    return found.filter(F.col("date").isNotNull() & text.sane_price(F.col("price")))


# -- tables and prices on chart pages -----------------------------------------------------------------

TABLE_SCHEMA = (
    "url string, table_index int, row_index int, headers array<string>,"
    " cells array<struct<text: string, header: boolean, numeric: boolean, off: boolean>>,"
    " price_table int, sales_table boolean"
)
# Class words of page areas that are no prices.
AREA_CLASSES = ("tour", "subscription", "subscribe", "help", "modal")
AREA_TEXTS = ("subscribe", "$6/month", "time warp")
CELL_CLASSES = ("tour", "help", "subscription", "nav", "menu", "button")


def _in_subscription_area(node: Element) -> bool:
    for depth, parent in enumerate(node.above()):
        if depth == 5 or parent.parent is None:
            return False
        if parent.once("area", _is_area):
            return True
    return False


def _is_area(node: Element) -> bool:
    names, words = str(node.classes).lower(), node.text().lower()
    return any(c in names for c in AREA_CLASSES) or any(t in words for t in AREA_TEXTS)


def _price_table(table: Element) -> int | None:
    """Which price-table selector a table meets first, None when none."""
    if "price-summary" in table.classes:
        return 0
    if "price" in (table.attrs.get("class") or ""):
        return 1
    if any("price-chart-container" in p.classes for p in table.above()):
        return 2
    if table.first(tagged("*", "price")) is not None:
        return 3
    return None


def _table_rows(page: Element) -> Iterator[tuple]:
    for index, table in enumerate(page.all(tagged("table"))):
        heads = [n.text().strip() for n in table.all(lambda n: n.tag in ("th", "thead"))]
        head_text = " ".join(n.text().lower() for n in table.all(tagged("th")))
        body = table.text().lower()
        sales = any(w in head_text for w in ("date", "sale", "price", "title")) and not any(
            w in body for w in ("subscribe", "navigation", "menu")
        )
        rank = _price_table(table)
        shown = [h for h in heads if h and "subscribe" not in h.lower()]
        for number, row in enumerate(table.all(tagged("tr"))):
            cells = []
            for cell in row.all(lambda n: n.tag in ("td", "th")):
                names = str(cell.classes).lower()
                off = any(c in names for c in CELL_CLASSES) or _in_subscription_area(cell)
                cells.append({"text": cell.text().strip(), "header": cell.tag == "th", "numeric": "numeric" in names, "off": off})
            if any(c["text"] for c in cells):
                yield index, number, shown, cells, rank, sales


def page_tables(pages: DataFrame) -> DataFrame:
    """Every non-empty table row with its cells and the table's headers."""
    return _extract(pages, _table_rows, TABLE_SCHEMA)


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def _number(cell_text: Column) -> Column:
    return text.extract(cell_text, PRICE).try_cast("double")


def table_prices(tables: DataFrame) -> DataFrame:
    """Rows with both an ISO date and a sane price (the last of each in the row)."""
    texts = F.transform("cells", lambda c: c["text"])
    dates = F.filter(texts, lambda t: t.rlike(DATE_CELL))
    prices = F.filter(F.transform(texts, _number), lambda p: text.sane_price(p))
    return tables.select(
        "url", "table_index", "row_index", "headers", _last(dates).alias("date"), _last(prices).alias("price")
    ).filter(F.col("date").isNotNull() & F.col("price").isNotNull())


def sales_table_prices(tables: DataFrame) -> DataFrame:
    """Dated prices of sales tables under the strict cell, price and description rules."""
    cells = F.col("cells")
    texts = F.transform(cells, lambda c: c["text"])
    dates = F.filter(texts, lambda t: t.rlike(DATE_CELL))
    good = F.filter(cells, lambda c: ~c["off"] & text.price_cell(c["text"], c["numeric"]))
    prices = F.filter(F.transform(good, lambda c: _number(c["text"])), lambda p: text.sane_price(p, strict=True))
    words = F.filter(texts, lambda t: (F.length(t) > 10) & ~t.rlike(DATE_CELL))
    return (
        tables.filter(F.col("sales_table") & (F.size("cells") >= 3) & ~F.exists(cells, lambda c: c["header"]))
        .select(
            "url", "table_index", "row_index", _last(dates).alias("date"), _last(prices).alias("price"),
            F.array_join(words, " ").alias("description"),
        )
        .filter(F.col("date").isNotNull() & F.col("price").isNotNull() & text.sane_description(F.col("description")))
    )


def label_condition(label: Column, column: Column) -> Column:
    """Condition a price-table label stands for."""
    low = F.lower(label)
    at = column.cast("string")
    return (
        F.when(low.contains("ungraded") | low.contains("loose"), "ungraded")
        .when(low.contains("graded"), F.concat(F.lit("graded_"), at))
        .when(low.contains("psa 10") | low.contains("gem mint"), "psa_10")
        .when(low.contains("psa 9"), "psa_9")
        .when(low.contains("new") | low.contains("sealed"), "new")
        .otherwise(F.concat(F.lit("condition_"), at))
    )


def summary_prices(tables: DataFrame) -> DataFrame:
    """Prices by condition from price tables; the first price of a condition counts."""
    labelled = (
        tables.filter(F.col("price_table").isNotNull() & (F.size("cells") >= 2))
        .withColumn("_label", F.lower(F.get("cells", F.lit(0))["text"]))
        .select("url", "price_table", "table_index", "row_index", "_label", F.posexplode("cells").alias("_at", "_cell"))
        .filter(F.col("_at") > 0)
        .withColumn("price", _number(F.col("_cell.text")))
        .filter(text.sane_price(F.col("price"), strict=True))
        .withColumn("condition", label_condition(F.col("_label"), F.col("_at")))
    )
    order = F.struct("price_table", "table_index", "row_index", "_at")
    return labelled.groupBy("url", "condition").agg(F.min_by("price", order).alias("price"))


NODE_SCHEMA = (
    "url string, selector int, position int, text string, class_text string, parent_text string, off boolean"
)


def _class_test(token: str) -> Callable[[Element], bool]:
    return tagged("*", token)


# Elements that show prices, in order.
LOOSE_SELECTORS = (
    _class_test("price-display"), _class_test("current-price"), _class_test("price-value"),
    lambda n: n.tag == "span" and "price" in (n.attrs.get("class") or ""),
    lambda n: n.tag == "div" and "price" in (n.attrs.get("class") or ""),
    _class_test("loose-price"), _class_test("cib-price"), _class_test("new-price"),
)
STRICT_SELECTORS = (
    lambda n: "price" in n.classes and any("price-display" in p.classes for p in n.above()),
    _class_test("current-price"), _class_test("price-value"), _class_test("chart-price"),
    _class_test("product-price"),
)


def _node_rows(selectors) -> Callable[[Element], Iterator[tuple]]:
    def rows(page: Element) -> Iterator[tuple]:
        for number, test in enumerate(selectors):
            for position, node in enumerate(page.all(test)):
                parent = node.parent.once("text", Element.text) if node.parent is not None else ""
                yield (
                    number, position, node.text().strip(), " ".join(node.classes), parent,
                    _in_subscription_area(node),
                )

    return rows


def _price_nodes(pages: DataFrame, selectors) -> DataFrame:
    return (
        _extract(pages, _node_rows(selectors), NODE_SCHEMA)
        .withColumn("price", _number(F.col("text")))
        .withColumn("_context", F.lower(F.concat_ws(" ", "class_text", "parent_text")))
    )


def _last_per_condition(nodes: DataFrame) -> DataFrame:
    order = F.struct("selector", "position")
    return nodes.groupBy("url", "condition").agg(F.max_by("price", order).alias("price"))


def current_prices(pages: DataFrame) -> DataFrame:
    """Prices by condition from price elements; the last one of a condition counts."""
    c = F.col("_context")
    condition = (
        F.when(c.contains("loose") | c.contains("ungraded"), "loose")
        .when(c.contains("cib") | c.contains("complete"), "complete")
        .when(c.contains("new") | c.contains("sealed"), "new")
        .when(c.contains("graded"), "graded")
        .otherwise("current")
    )
    nodes = _price_nodes(pages, LOOSE_SELECTORS).filter(text.sane_price(F.col("price")))
    return _last_per_condition(nodes.withColumn("condition", condition))


def display_prices(pages: DataFrame) -> DataFrame:
    """Prices of designated display elements outside subscription areas, strict checks."""
    c = F.col("_context")
    condition = (
        F.when(c.contains("loose") | c.contains("ungraded"), "loose")
        .when(c.contains("graded"), "graded")
        .when(c.contains("new") | c.contains("sealed"), "new")
        .otherwise("current")
    )
    nodes = _price_nodes(pages, STRICT_SELECTORS).filter(~F.col("off") & text.sane_price(F.col("price"), strict=True))
    return _last_per_condition(nodes.withColumn("condition", F.concat(F.lit("display_"), condition)))


DETAIL_SCHEMA = "url string, title string, details map<string, string>"


def _detail_rows(page: Element) -> Iterator[tuple]:
    heading = page.first(tagged("h1"))
    details = {}
    for node in page.all(tagged("div", "product-detail")):
        key, colon, value = node.text().strip().partition(":")
        if colon:
            details[key.strip().lower()] = value.strip()
    yield (None if heading is None else heading.text().strip()), list(details.items())


def product_details(pages: DataFrame) -> DataFrame:
    """Heading and ``key: value`` lines of every page."""
    return _extract(pages, _detail_rows, DETAIL_SCHEMA)


