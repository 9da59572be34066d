"""Mixing of sources to target weights: exact word budgets by subset sums over length counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.llm.common import named_rows, saved, scratch, sized

#: Weights of the sources in code-point order, repeating; null is the last source.
WEIGHTS = (5.0, 2.0, 1.0)
#: Part of all words that the mix has, and times that a source may be repeated at most.
SHARE, REPEAT = 1.5, 2
WORD = "[^\\x20\\x09-\\x0D]+"
#: Documents of one source and length are dealt by a seeded hash into so many buckets.
BUCKETS = 1024
#: Sums that the knapsack's table holds.
TABLE = 1 << 19


def words_in(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """Rows (source, source_size) with the target of each source.

    Targets share ``share`` times all words by weight; one that would exceed ``repeat`` times its
    source stops there and its excess goes to the others by weight, until none is above. The
    sources that stop are those with the smallest size for their weight, so running sums over
    that order give the level of the rest. One row per source: windows over all are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("most", (repeat * F.col("source_size")).cast("double"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(up), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    )
    # The first source, in order of room, that the level leaves below its most sets the level of all the rest.
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    common = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every).getField("level")
    target = F.least(F.col("most"), F.coalesce(common * F.col("weight"), F.col("most")))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def subset_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to the budget.

    An even part of every length is taken first, then single documents from the longest down
    while they leave room to spare; the rest is a bounded knapsack by dynamic programming over
    the sums up to ``table``: each length's count is cut into binary parts, and the part that
    first reached a sum leads back to the documents. The nearest sum that can be reached counts.
    Documents longer than half the table are taken while they fit; the shortest one that is left
    is taken in place of the shorter single documents and the last sum if that is nearer.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    even = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    taken = even.copy()
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable").tolist()
    spare = min(4 * int(lengths.max()), table // 2)
    for i in order:
        length, free = int(lengths[i]), int(counts[i] - taken[i])
        if length:
            n = min(free, max(0, rest if length > table // 2 else rest - spare) // length)
            taken[i] += n
            rest -= n * length
    longer = np.where(lengths > table // 2, taken, even)
    left = [i for i in order if lengths[i] > table // 2 and counts[i] > taken[i]]
    longer[left[-1:]] += 1
    over = int((lengths * longer).sum()) - budget if left else budget
    if rest > table:
        return longer if over < rest else taken
    short = lengths[(lengths > 0) & (lengths <= table // 2)]
    room = rest + (int(short.max()) if len(short) else 0)  # of use above the budget: one document more
    reach, first, parts = np.zeros(room + 1, bool), np.full(room + 1, -1, np.int32), []
    reach[0] = True
    for i in reversed(order):
        length, chunk = int(lengths[i]), 1
        free = min(int(counts[i] - taken[i]), room // length) if length else 0
        while free > 0 and not reach[rest]:
            n = min(chunk, free)
            fresh = np.flatnonzero(reach[:room + 1 - n * length] & ~reach[n * length:]) + n * length
            first[fresh] = len(parts)
            reach[fresh] = True
            parts.append((i, n))
            free, chunk = free - n, 2 * chunk
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    if over < abs(at - rest):
        return longer
    while at:
        i, n = parts[first[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def mix_plan(docs: DataFrame, seed: int = 42, source: str = "source", text: str = "text", doc_id: str = "doc_id",
             weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """Every row of ``docs`` as (doc_id, size, source_size, target, times).

    ``times`` is how often the mix takes the row (0 to ``repeat``): as many whole passes over its source as
    the target holds, and once more if it is among the documents that fill the rest. Those are
    picked by length count, within a source and length by a seeded hash of id and size. Null
    sources are one source, the last; null texts have size 0 and are taken with the whole passes
    only. Sources without words have target 0.
    """
    return _decide(saved(docs.select(*_drawn(seed, F.col(source), F.col(text), F.col(doc_id))), "sizes"), weights, share, repeat)


def mixed(docs: DataFrame, seed: int = 42, source: str = "source", text: str = "text", doc_id: str = "doc_id",
          weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``mix_plan`` takes it.

    Which documents of a source and length are taken once more is one limit in the order of bucket,
    draw and id, so the documents meet a small table of limits and are not ranked themselves. Rows that are equal in
    all of this are told apart by their place in the input.
    """
    rows = named_rows(docs)
    drawn = _drawn(seed, F.col(f"doc.`{source}`"), F.col(f"doc.`{text}`"), F.col(f"doc.`{doc_id}`"))
    with scratch(docs.sparkSession):
        narrow = sized(saved(rows.select(*drawn, "file", "place"), "sizes")).withColumn("bucket", _bucket())
        shares = saved(_shares(narrow, weights, share, repeat), "shares")
        cut = shares.filter("pick > 0 AND pick < n").select(*CELL, "pick")
        order = Window.partitionBy(*CELL).orderBy("draw", _id_order(), "file", "place")
        near = saved(_keyed(narrow, "source").join(cut, CELL).withColumn("at", F.row_number().over(order)), "near")
        last = near.filter("at = pick").select(*CELL, F.col("draw").alias("last_draw"), _id_order().alias("last_id"), F.lit(True).alias("_cut"))
        # rows that are equal to the last one taken, of which some are taken and some are not
        even = near.join(last, CELL).filter((F.col("draw") == F.col("last_draw")) & (_id_order() == F.col("last_id")))
        chosen = saved(even.filter("at <= pick").select("file", "place", F.lit(1).alias("equal")), "equal", stays=True)
        full = shares.filter("pick = n").groupBy("no_source", "of_source", "size").agg(F.max("bucket").alias("upto"))
        goals = shares.select("no_source", "of_source", "size", "passes").distinct()
        limits = goals.join(full, ["no_source", "of_source", "size"], "left").join(
            last.withColumnRenamed("bucket", "at_bucket").drop("_cut"), ["no_source", "of_source", "size"], "left")
        limits = saved(limits, "limits", stays=True)
    named = _keyed(rows.select("doc", "file", "place", *drawn).withColumn("bucket", _bucket()), "source")
    met = named.join(sized(limits), ["no_source", "of_source", "size"]).join(sized(chosen), ["file", "place"], "left")
    below = (F.col("draw") < F.col("last_draw")) | ((F.col("draw") == F.col("last_draw")) & (_id_order() < F.col("last_id")))
    extra = (F.col("bucket") <= F.col("upto")) | ((F.col("bucket") == F.col("at_bucket")) & below) | F.col("equal").isNotNull()
    times = F.col("passes") + F.coalesce(extra.cast("int"), F.lit(0))
    return met.select("doc", times.cast("int").alias("times")).filter("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def _id_order() -> Column:
    """Ids in ascending order, nulls with the smallest."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def _bucket() -> Column:
    return F.pmod(F.col("draw"), F.lit(BUCKETS)).cast("int")


#: A cell of documents that are drawn from: source (in a form without nulls), size and bucket of the draw.
CELL = ["no_source", "of_source", "size", "bucket"]


def _keyed(frame: DataFrame, name: str) -> DataFrame:
    source = F.col(name)
    return frame.withColumns({"no_source": source.isNull(), "of_source": F.coalesce(source.cast("string"), F.lit(""))}).drop(name)


def _drawn(seed: int, source: Column, text: Column, doc_id: Column) -> list[Column]:
    size, key = words_in(text), doc_id.cast("long")
    return [key.alias("doc_id"), source.alias("source"), size.alias("size"), F.xxhash64(key, size, F.lit(seed)).alias("draw")]


def _shares(rows: DataFrame, weights, share: float, repeat: int) -> DataFrame:
    """(CELL, source_size, target, passes, n, pick): how many of the n rows of every cell are taken once more."""
    counted = saved(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "lengths")
    lengths = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes, weights, share, repeat)
    joined = lengths.join(goal.withColumnRenamed("source", "goal_of"), F.col("source").eqNullSafe(F.col("goal_of"))).drop("goal_of")

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", kind="stable")
        size, goal = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        passes = min(repeat, int(goal // size)) if size else 0
        budget = round(goal) - passes * size if size and passes < repeat else 0
        extra = subset_counts(frame["size"].to_numpy(), frame["n"].to_numpy(), budget)
        return frame.assign(passes=passes, extra=extra)

    kinds = joined.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    plans = joined.groupBy("source").applyInPandas(plan, f"{kinds}, passes long, extra long".replace(",", ", "))
    plans = plans.select(F.col("source").alias("s"), F.col("size").alias("l"), "source_size", "target", "passes", "extra")
    up = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l"))
    before = F.coalesce(F.sum("n").over(up), F.lit(0))
    return _keyed(counted.withColumn("before", before).join(plans, same).drop("source"), "s").select(
        *CELL, "source_size", "target", "passes", "n",
        F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("pick"),
    )


def _decide(rows: DataFrame, weights, share: float, repeat: int) -> DataFrame:
    rows = rows.withColumn("bucket", _bucket())
    # the key of the join has no nulls, so that join and window deal the rows alike and they move once
    at = F.row_number().over(Window.partitionBy(*CELL).orderBy("draw", "doc_id"))
    met = _keyed(rows, "source").join(saved(_shares(rows, weights, share, repeat), "shares"), CELL)
    extra = F.when(F.col("pick") == 0, 0).when(F.col("pick") == F.col("n"), 1).otherwise((at <= F.col("pick")).cast("int"))
    return met.withColumn("times", (F.col("passes") + extra).cast("long")).drop(
        "no_source", "of_source", "bucket", "n", "pick", "passes", "draw")
