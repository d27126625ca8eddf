"""An inverted index for keyword scores: postings of the characters, pairs and triples of a text.

A term counts for a text that has it as a part, so a text that scores has all triples of one of the
query's terms (or the term itself, if it is shorter). Postings are lists of places for each gram and
block of ``BLOCK`` places; a search reads the grams of its terms alone, which row-group bounds and
bloom filters on the sorted column pick out, intersects the lists of each term block by block, and
only the texts that are left are scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a block: a list has at most as many.
BLOCK = 1 << 14
GRAM = 3
POSTINGS = "gram string, block long, places array<int>"


def grams(text: Column) -> Column:
    """The distinct parts of one to three characters of a lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(parts(n) for n in range(1, GRAM + 1))))


def grams_of(term: str) -> list[str]:
    """The grams that a text with this (lower-case) term has to have."""
    return [term] if len(term) <= GRAM else list(dict.fromkeys(term[i : i + GRAM] for i in range(len(term) - GRAM + 1)))


def postings(rows: DataFrame, text_col: str = "content_preview", place: str = "place") -> DataFrame:
    """``gram, block, places``, sorted, of rows with their ``place``; no list is longer than a block."""
    at = rows.select((F.col(place) / BLOCK).cast("long").alias("block"), (F.col(place) % BLOCK).cast("int").alias("at"), F.explode(grams(F.col(text_col))).alias("gram"))
    lists = at.groupBy("gram", "block").agg(F.sort_array(F.collect_list("at")).alias("places"))
    return lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").select("gram", "block", "places")


def candidates(index: DataFrame, query: str, first: str | None = None) -> DataFrame:
    """``ordinal`` of every text with one of the query's terms, from postings (with their batch's ``first`` ordinal).

    A text with all triples of a longer term may not have the term; those are for the caller to drop.
    """
    needed = {t: grams_of(t) for t in dict.fromkeys(query.lower().split())}
    every = list(dict.fromkeys(g for gs in needed.values() for g in gs))
    begin = F.col(first) if first else F.lit(0).cast("long")
    if not every:
        return index.select(begin.alias("ordinal")).limit(0)
    own = index.where(F.col("gram").isin(every)).groupBy(begin.alias("first"), "block").agg(*(F.first(F.when(F.col("gram") == g, F.col("places")), True).alias(f"g{i}") for i, g in enumerate(every)))
    none = F.array().cast("array<int>")
    has = lambda term: reduce(F.array_intersect, [F.coalesce(f"g{every.index(g)}", none) for g in needed[term]])
    met = own.select("first", "block", F.explode(reduce(F.array_union, map(has, needed))).alias("at"))
    return met.select((F.col("first") + F.col("block") * BLOCK + F.col("at")).alias("ordinal"))
