"""Similarity of short texts such as titles and skill names, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the share of characters to change: 1 for equal texts, 1 for two empty ones, NULL with a NULL."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two plain texts; 0 if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(t, " "), lambda w: w != "")) for t in (a, b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def sounds_alike(a: Column, b: Column) -> Column:
    """Whether two words have the same Soundex code."""
    return F.soundex(a) == F.soundex(b)


def best_match(text: Column, wanted: list[str]) -> Column:
    """The largest similarity, by edits or by words, of a text to any of the wanted ones; 0 without a text."""
    own = plain(text)
    each = [F.greatest(edit_similarity(own, plain(F.lit(w))), word_similarity(own, plain(F.lit(w)))) for w in wanted]
    return F.coalesce(reduce(F.greatest, each) if len(each) > 1 else each[0] if each else F.lit(0.0), F.lit(0.0))
