"""Catalog cards for a table of targets, found through an inverted index of character grams.

A card contains a target's text only if it contains every gram of it. Each target is looked up by the one gram of
its texts that is rarest in the catalog; what the index gives is then checked. Both sides may have any
number of rows, and no card is compared with targets that it shares no rare gram with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelwork.session import spread

#: Characters of a gram; shorter texts are looked up whole.
GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """The different grams of ``size`` characters of a text."""
    n = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size))
    return F.when((size > 0) & (n > 0), F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def postings_of(name: str, size: Column) -> Column:
    return F.transform(grams(F.col(name), size), lambda g: F.struct(F.lit(name).alias("_field"), g.alias("_gram")))


def containing(texts: DataFrame, parts: DataFrame, fields: tuple[str, ...], gram: int = GRAM) -> DataFrame:
    """Pairs of a row of ``texts`` and a row of ``parts`` where every field of the first contains that of the second.

    Both have the ``fields`` in lower case and columns of their own otherwise. A null field of a part or
    text matches nothing; an empty one is contained in every text, and a part of empty fields alone
    names nothing and has no pairs.
    """
    keyed = parts.withColumn("_part", F.struct(*[F.col(f"`{c}`") for c in parts.columns]))
    filled = F.lit(True)
    for name in fields:
        filled = filled & F.col(name).isNotNull()
    wanted = keyed.filter(filled).select("_part", F.inline(F.concat(*[postings_of(name, F.least(F.lit(gram), F.length(name))) for name in fields])))
    sizes = [r["n"] for r in wanted.select(F.length("_gram").alias("n")).distinct().collect()]  # at most ``gram`` numbers
    whole = texts.withColumn("_text", F.struct(*[F.col(f"`{c}`") for c in texts.columns]))
    postings = whole.select("_text", F.inline(F.concat(*[postings_of(name, F.lit(size)) for name in fields for size in sizes or [gram]])))
    frequency = postings.groupBy("_field", "_gram").agg(F.count("*").alias("_n"))
    # a gram that the catalog lacks is the rarest of all: such a part has no pairs
    rarest = F.row_number().over(Window.partitionBy("_part").orderBy(F.coalesce("_n", F.lit(0)), "_field", "_gram"))
    asked = wanted.join(frequency, ["_field", "_gram"], "left").withColumn("_rank", rarest).filter(F.col("_rank") == 1)
    met = asked.select("_part", "_field", "_gram").join(postings, ["_field", "_gram"])
    for name in fields:
        met = met.filter(F.contains(F.col(f"_text.{name}"), F.col(f"_part.{name}")))
    return met.select("_text", "_part")


def target_match_table(cards: DataFrame, targets: DataFrame, gram: int = GRAM) -> DataFrame:
    """Cards of every target (target_id, target_name, target_set, target_number), as ``catalog.target_matches`` finds them
    for a literal list: all exact matches; without any, the card with the smallest id whose name and
    set contain the target's, upper or lower case alike.

    Names and sets are indexed once each, however many cards have them. A target that is null in
    name or set has no partial match.
    """
    cards, targets = spread(cards), spread(targets)  # an exact target may match very many cards
    exact = targets.join(cards, (F.col("card_name") == F.col("target_name")) & (F.col("set_name") == F.col("target_set"))
                         & (F.col("card_number") == F.col("target_number")))
    exact = exact.select("target_id", "card_id", "card_name", "set_name", "card_number", F.lit("exact").alias("match_kind"))
    known = cards.select("card_name", "set_name", "card_number").distinct()
    met = targets.join(known, (F.col("card_name") == F.col("target_name")) & (F.col("set_name") == F.col("target_set"))
                       & (F.col("card_number") == F.col("target_number")), "left_semi")
    rest = targets.join(met.select("target_id").distinct(), "target_id", "left_anti")
    pairs = cards.groupBy(F.lower("card_name").alias("name"), F.lower("set_name").alias("series")).agg(
        F.min_by(F.struct("card_id", "card_name", "set_name", "card_number"), "card_id").alias("card"))
    parts = rest.select(F.lower("target_name").alias("name"), F.lower("target_set").alias("series")).distinct()
    found = containing(pairs, parts, ("name", "series"), gram).groupBy("_part").agg(F.min_by("_text.card", "_text.card.card_id").alias("card"))
    near = rest.withColumns({"name": F.lower("target_name"), "series": F.lower("target_set")}).join(
        found.select("_part.*", "card"), ["name", "series"]).select("target_id", "card.*", F.lit("partial").alias("match_kind"))
    return exact.unionByName(near)
