"""Benchmark decontamination by winnowing: fingerprints of word windows are joined and hits extended.

A window of words is marked by the smallest hash of its word k-grams. The mark depends on the
window's words alone, so a window that a document shares with an item has the same mark in both: no
shared window is missed, though neighbouring windows mostly share a mark and a document has far
fewer of them than words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelwork.llm.common import lower_ascii, saved, text_or_empty

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a k-gram.
GRAM = 5
#: Marks of items that are sent to every task; beyond, runs of windows are shuffled to the marks with their words.
SENT_MARKS = 2_000_000
#: Fixed value: what stands between words once A-Z are in lower case.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def held(rows: DataFrame, *columns) -> DataFrame:
    """The columns, each computed once per row: expressions are not moved through a generator."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def word_table(rows: DataFrame, text: str, *columns: Column) -> DataFrame:
    """The columns with ``words``, the words of a text in lower case; a null text has none."""
    words = F.filter(F.split(lower_ascii(text_or_empty(text)), SEPARATORS), lambda w: w != "")
    return held(rows, *columns, words.alias("words"))


def window_marks(rows: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """Rows (.., words) with a column ``marks_<length>`` for every length: the mark of the window from
    every place, null where too few words follow."""
    others = [c for c in rows.columns if c != "words"]

    def from_each(array: str, width: int, length: int, value) -> Column:
        """value(the next ``width`` members) wherever ``length`` words are left."""
        return F.transform(F.col(array), lambda _, i: F.when(i <= F.size(array) - length, value(*[F.get(F.col(array), i + j) for j in range(width)])))

    sizes = {length: min(gram, length) for length in lengths}
    rows = held(rows, *others, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = held(rows, *others, "words", *[from_each("hashes", k, k, F.xxhash64).alias(f"grams_{k}") for k in sorted(set(sizes.values()))])
    marks = [
        (from_each(f"grams_{k}", n - k + 1, n, F.least) if n > k else F.col(f"grams_{k}")).alias(f"marks_{n}") for n, k in sizes.items()
    ]
    return held(rows, *others, "words", *marks)


def runs(rows: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """(row, words, length, mark, first, last) from rows (row, words): neighbouring windows of one mark."""
    def of(n: int) -> Column:
        marks, firsts = F.col(f"marks_{n}"), F.col(f"firsts_{n}")
        ends = F.size(marks) - n + 1
        return F.transform(firsts, lambda first, j: F.struct(
            F.lit(n).alias("length"), F.get(marks, first).alias("mark"), first.alias("first"), (F.coalesce(F.get(firsts, j + 1), ends) - 1).alias("last"),
        ))

    def firsts(n: int) -> Column:
        marks = F.col(f"marks_{n}")
        places = F.transform(marks, lambda m, i: F.when(m.isNotNull() & ~m.eqNullSafe(F.get(marks, i - 1)), i))
        return F.filter(places, lambda i: i.isNotNull()).alias(f"firsts_{n}")

    marked = window_marks(rows, lengths, gram)
    marked = held(marked, "row", "words", *[f"marks_{n}" for n in lengths], *map(firsts, lengths))
    return marked.select("row", "words", F.inline(F.concat(*map(of, lengths))))


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows of the items (item, words), a stored table: (text, mark, class) of every different window,
    (class, items) of the sets of items that share one, and the lengths of windows."""
    sized = items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    lengths = sorted(r["length"] for r in sized.select("length").distinct().collect())  # at most ``window`` numbers

    def of(n: int) -> DataFrame:
        marked = window_marks(sized.filter(F.col("length") == n).select("item", "words"), [n], gram)
        each = F.transform(f"marks_{n}", lambda m, i: F.when(m.isNotNull(), F.struct(F.array_join(F.slice("words", i + 1, n), " ").alias("text"), m.alias("mark"))))
        return marked.select("item", F.inline(F.filter(each, lambda w: w.isNotNull())))

    every = reduce(DataFrame.unionByName, map(of, lengths or [window]))
    sets = every.groupBy("text").agg(F.min("mark").alias("mark"), F.array_sort(F.collect_set("item")).alias("items"))
    stored = saved(sets.withColumn("class", F.unhex(F.sha2(F.to_json("items"), 256))), "windows")
    classes = stored.select("class", "items").dropDuplicates(["class"])
    return stored.select("text", "mark", "class"), classes, lengths or [window]


def extended(hits: Column, window: int) -> Column:
    """Spans (begin, end) of neighbouring or overlapping hits, which have ``begin``, ``end`` and
    ``reach``, the end of what the hits before them cover."""
    opens = F.filter(F.transform(hits, lambda h, j: F.when(h["reach"] < h["begin"], j)), lambda j: j.isNotNull())
    last = F.greatest(F.lit(-1), *[F.get(hits, F.size(hits) - j)["end"] for j in range(1, window + 1)])
    spans = F.transform(opens, lambda first, k: F.struct(
        F.get(hits, first)["begin"].alias("begin"), F.coalesce(F.get(hits, F.get(opens, k + 1))["reach"], last).alias("end"),
    ))
    return spans


def found_in(stored: DataFrame, windows: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """(row, spans, classes) of the rows (row, words) of a stored table that hold a window."""
    marks = windows.select("mark").distinct()
    part = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("length")).alias("part")
    marked, own = runs(stored.select("row", "words"), lengths, gram), ["row", "length", "first", "last"]
    # the words of a document stay in its task: only those of runs with a mark of an item go on
    if marks.count() <= SENT_MARKS:
        met = marked.join(F.broadcast(marks), "mark", "left_semi").select(*own, part)
    else:
        met = held(marked, *own, "mark", part).join(marks, "mark", "left_semi")
    text = F.array_join(F.slice("part", F.col("i") - F.col("first") + 1, F.col("length")), " ").alias("text")
    each = met.select("*", F.explode(F.sequence("first", "last")).alias("i")).select(
        "row", F.col("i").alias("begin"), (F.col("i") + F.col("length")).alias("end"), text)
    shared = each.join(windows.select("text", "class"), "text")
    hits = shared.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("hits"), F.array_sort(F.collect_set("class")).alias("classes"),
    )
    # the longest of each place; then windows more than ``window`` places before reach no further than those between
    hits = held(hits, "row", "classes", F.filter("hits", lambda h, j: ~h["begin"].eqNullSafe(F.get("hits", j + 1)["begin"])).alias("hits"))
    reach = F.transform("hits", lambda h, j: F.struct(
        h["begin"].alias("begin"), h["end"].alias("end"), F.greatest(F.lit(-1), *[F.get("hits", j - b)["end"] for b in range(1, max(window, 2))]).alias("reach"),
    ))
    hits = held(hits, "row", "classes", reach.alias("hits"))
    return held(hits, "row", "classes", extended(F.col("hits"), window).alias("spans"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, n_items, items, items_sha256, contaminated) of every document.

    A window is ``window`` consecutive words of an item, or all words of an item of fewer. ``spans`` are
    the (begin, end) of words inside windows that the document holds, ``n_hit`` the number of these words,
    ``items`` the sorted ids, as text, of the items with such windows.

    A null or empty text has no words and no hits; an item without words has no windows. Repeated
    documents have a row each, repeated items count once by id, and a null item id counts as an empty
    text. Other columns are ignored; an empty table of documents gives no rows, one of items no hits.
    """
    items = saved(word_table(benchmark, item_text, F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item")), "items")
    windows, classes, lengths = item_windows(items, window, gram)
    words = word_table(docs, text, F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    stored = saved(words.withColumn("n_words", F.size("words").cast("long")), "words")
    found = saved(found_in(stored, windows, lengths, window, gram), "hits")
    # documents that hold the same windows share one list of items
    sets = found.select("classes").distinct()
    members = sets.select("classes", F.explode("classes").alias("class")).join(classes, "class")
    lists = members.groupBy("classes").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    lists = lists.select("classes", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    known = found.join(lists, "classes").drop("classes")
    rows = stored.select("row", "doc_id", "n_words").join(known, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select(
        "doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<begin: int, end: int>>")).alias("spans"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
    )
