"""Which short texts contain which: an equi-join on the rarest gram of the contained side, verified in the row.

A name that a text contains has all its grams (pairs of characters; of a single
character that one) in the text.  So each name is filed under that one of its
grams that the fewest texts have, and only texts with this gram are compared with
it.  Texts and names are taken once each, so work grows with what is different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.columns import let


def grams(text: Column) -> Column:
    """The different pairs of neighbouring characters, and the characters themselves."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    pairs = lambda c: F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return let(chars(text), lambda c: F.array_distinct(F.concat(c, F.filter(pairs(c), lambda p: p.isNotNull()))))


def contained(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """(text, name), each once: the pairs of a text and a name that stands in it, character by character; empty names in none."""
    every = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_t")).distinct()
    few = names.where(F.length(name) > 0).select(F.col(name).alias("_n")).distinct()
    wanted = few.select("_n", F.explode(F.filter(grams(F.col("_n")), lambda g: (F.length(g) == 2) | (F.length("_n") == 1))).alias("_g"))
    marks = every.select("_t", F.explode(grams(F.col("_t"))).alias("_g")).join(wanted.select("_g").distinct(), "_g", "left_semi")
    counts = marks.groupBy("_g").agg(F.count("*").alias("_c"))
    # a name with a gram that no text has stands in none
    filed = wanted.join(counts, "_g", "left").groupBy("_n").agg(F.bool_or(F.col("_c").isNull()).alias("_never"), F.min_by("_g", F.struct("_c", "_g")).alias("_g")).where(~F.col("_never"))
    return marks.join(filed, "_g").where(F.col("_t").contains(F.col("_n"))).select(F.col("_t").alias(text), F.col("_n").alias(name))


def first_match(texts: DataFrame, names: DataFrame, text: str, name: str, place: str) -> DataFrame:
    """(text, name): for each different text that isn't blank the name of the least ``place`` that it contains or is contained in."""
    trimmed = texts.select(F.col(text).alias("_raw"), F.trim(text).alias("_t")).where("_t <> ''").distinct()
    own = names.where(F.length(name) > 0).groupBy(F.col(name).alias("_n")).agg(F.min(place).alias("_p"))
    short = trimmed.select("_t").distinct()
    inside = contained(short, own, "_t", "_n")
    around = contained(own.withColumnRenamed("_n", "_long"), short, "_long", "_t").select("_t", F.col("_long").alias("_n"))
    best = inside.unionByName(around).join(own, "_n").groupBy("_t").agg(F.min_by("_n", F.struct("_p", "_n")).alias("_n"))
    return trimmed.join(best, "_t").select(F.col("_raw").alias(text), F.col("_n").alias(name))
