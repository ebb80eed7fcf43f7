"""Tokens and character grams of raw text, and similarities of sets and strings."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.functions.dictionaries import STOPWORDS
from kindred.functions.entities import let
from kindred.functions.text import WORD


def lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def block_tokens(name: Column, address: Column) -> Column:
    """Words of name and address of three letters or more that are no stopwords; repeats stay."""
    found = F.regexp_extract_all(lower(F.concat_ws(" ", name, address)), F.lit(f"([{WORD}]+)"), 1)
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower(text), F.lit(f"([{WORD}]+)"), 1))


def characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def runs(items: Column, n: int, between: str = "") -> Column:
    """All runs of n neighbours of an array of strings, joined; linear, since neighbours are zipped and not looked up."""
    out = items
    for k in range(2, n + 1):
        size = F.greatest(F.size(items) - (k - 1), F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), size), F.slice(items, F.lit(k), size), lambda x, y: F.concat(x, F.lit(between), y))
    return F.when(F.size(items) >= n, out).otherwise(F.array().cast("array<string>"))


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters of the lower-cased text; none if it is shorter."""
    return F.array_distinct(let(characters(lower(text)), lambda c: runs(c, n)))


def flat(text: Column) -> Column:
    """Lower case with each mark as a space; inner spaces stay."""
    return F.regexp_replace(F.regexp_replace(lower(text), rf"[^{WORD}\s]", " "), r"^\s+|\s+$", "")


def digit_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{Nd}+)"), 1))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Overlap over union of two arrays of distinct elements; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    value = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).otherwise(value) if both_empty else value


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """As ``jaccard`` over grams, but texts shorter than n are equal or not."""
    short = (F.length(a) < n) | (F.length(b) < n)
    return F.when(short, F.when(a == b, 1.0).otherwise(0.0)).otherwise(jaccard(grams(a, n), grams(b, n)))


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def common_prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common beginning over the shorter length; 0 if one is empty."""
    shorter = F.least(F.length(a), F.length(b))
    differ = F.array_position(F.zip_with(characters(a), characters(b), lambda x, y: x == y), F.lit(False))
    same = F.when(differ > 0, F.least(differ - 1, shorter)).otherwise(shorter)
    return F.when(shorter == 0, 0.0).otherwise(same / shorter)


def smoothed_length_ratio(a: Column, b: Column) -> Column:
    return (F.least(F.length(a), F.length(b)) + 1) / (F.greatest(F.length(a), F.length(b)) + 1)


def length_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longer)


@F.pandas_udf(DoubleType())
def matching_ratio(a, b):
    """Twice the matched characters over all, by longest matching blocks; 1 for two empty strings. Not symmetric.

    The one similarity that Spark has no function for. Equal pairs are computed once per batch.
    """
    import pandas as pd

    seen: dict = {}

    def ratio(x, y):
        if x == y:
            return 1.0
        if (x, y) not in seen:
            seen[x, y] = SequenceMatcher(None, x or "", y or "").ratio()
        return seen[x, y]

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


def space_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    in_order = lambda t: F.array_join(F.array_sort(space_words(t)), " ")
    return matching_ratio(in_order(a), in_order(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio between the shared words and each side's; 0 if a side has no words."""
    x, y = F.array_distinct(space_words(a)), F.array_distinct(space_words(b))
    shared = F.array_sort(F.array_intersect(x, y))
    text = lambda ws: F.array_join(ws, " ")
    base = text(shared)
    left, right = (text(F.concat(shared, F.array_sort(F.array_except(s, shared)))) for s in (x, y))
    best = F.greatest(F.when(base != "", matching_ratio(base, left)).otherwise(0.0), F.when(base != "", matching_ratio(base, right)).otherwise(0.0), matching_ratio(left, right))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(best)


def scaled_idf(score: Column, n: Column) -> Column:
    return score / F.greatest(F.log(n + 1), F.lit(1e-6))
