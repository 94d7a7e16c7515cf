"""Fuzzy text matching: trigrams, accents, case-insensitive equality. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what stands for each without; both strings have the same length.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def unaccent(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words, each padded by two spaces before and one behind; null gives null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams; 0 if neither text has any."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, shared / every).otherwise(F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0)))


def is_similar(a: Column, b: Column, least: float = 0.3) -> Column:
    return similarity(a, b) >= least


def trigram_distance(a: Column, b: Column) -> Column:
    return (1 - similarity(a, b)).cast("float")


def word_similarity(short: Column, text: Column) -> Column:
    """The share of the short text's trigrams that the other text has."""
    x = trigrams(short)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, trigrams(text))) / F.size(x)).otherwise(F.lit(0.0))
