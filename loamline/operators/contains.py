"""Which texts contain which strings, in any case, by an inverted index of trigrams.

A string of three letters or more is looked up by the rarest of its trigrams, and what is found there is verified; a
shorter one is itself a gram of the texts that have it. So strings and texts meet by equality and never as a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """Distinct pieces of n characters; none of a shorter text."""
    at = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))


def trigram_index(texts: DataFrame, text: str = "text") -> DataFrame:
    """(gram, text) of distinct texts; it may be stored, by gram, and used for many strings."""
    own = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    return own.select(F.explode(grams(F.lower("text"), 3)).alias("gram"), "text")


def containing(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(needle, text): distinct strings and the distinct texts that contain them, in any case. Nulls take no part, nor does
    the empty string. index: trigram_index of the texts."""
    wanted = needles.select(F.col(needle).alias("needle")).where("needle IS NOT NULL AND needle <> ''").distinct()
    own = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    index = trigram_index(own) if index is None else index
    long = wanted.where(F.char_length(F.lower("needle")) >= 3)
    each = long.select("needle", F.explode(grams(F.lower("needle"), 3)).alias("gram"))
    counts = index.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("grams"), F.count("n").alias("known")).where("grams = known")
    found = rarest.join(index, "gram").where(F.contains(F.lower("text"), F.lower("needle"))).select("needle", "text")
    for n in (1, 2):
        short = wanted.where(F.char_length(F.lower("needle")) == n)
        pieces = own.select(F.explode(grams(F.lower("text"), n)).alias("gram"), "text")
        found = found.unionByName(pieces.join(short.withColumn("gram", F.lower("needle")), "gram").select("needle", "text"))
    return found
