"""Text expressions: Python-like strip, previews, paths, tokens and keyword scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 150
#: What a keyword score is multiplied with, by fragment type; others get the last.
TYPE_WEIGHTS = {"component": 1.3, "javascript": 1.2, "script": 1.2, "template": 1.1, "css": 0.9, "style": 0.9}
OTHER_WEIGHT = 0.8


def strip(x: Column) -> Column:
    """Without white space (Unicode's) at both ends; ``trim`` alone takes blanks only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def preview(x: Column, n: int = PREVIEW) -> Column:
    """The first ``n`` characters, and three dots if there are more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, dots at its start aside; empty if there is none."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def relative_path(path: Column, root: str) -> Column:
    """From the first occurrence of ``root`` on; the whole path if there is none."""
    at = F.instr(path, root)
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)


def tokens(x: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != "")


def type_weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def keyword_score(text: Column, kind: Column, query: str) -> Column:
    """3 for each term of the query that is a word of the text, 1 for one that is a part of it; times the type's weight.

    Terms that repeat count each time. The terms are literals, so the score is one expression.
    """
    low, words, score = F.lower(F.coalesce(text, F.lit(""))), tokens(F.coalesce(text, F.lit(""))), F.lit(0.0)
    for term in query.lower().split():
        score = score + F.when(F.array_contains(words, term), F.lit(3.0)).when(F.contains(low, F.lit(term)), F.lit(1.0)).otherwise(F.lit(0.0))
    return score * type_weight(kind)


def coverage(text: Column, query: str) -> Column:
    """The default pair score: the share of a query's distinct terms that are words (1) or parts (1/2) of a text."""
    terms = list(dict.fromkeys(query.lower().split()))
    low, words, score = F.lower(F.coalesce(text, F.lit(""))), tokens(F.coalesce(text, F.lit(""))), F.lit(0.0)
    for term in terms:
        score = score + F.when(F.array_contains(words, term), F.lit(1.0)).when(F.contains(low, F.lit(term)), F.lit(0.5)).otherwise(F.lit(0.0))
    return score / F.lit(float(max(1, len(terms))))


def pair_coverage(text: Column, query: Column) -> Column:
    """``coverage`` for queries in a column; a query without terms covers nothing."""
    terms = F.array_distinct(tokens(F.coalesce(query, F.lit(""))))
    low, words = F.lower(F.coalesce(text, F.lit(""))), tokens(F.coalesce(text, F.lit("")))
    part = lambda t: F.when(F.array_contains(words, t), F.lit(1.0)).when(F.contains(low, t), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + part(t)) / F.greatest(F.lit(1.0), F.size(terms).cast("double"))
