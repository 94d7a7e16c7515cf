"""Maps of strings: what a key-value column type offers, on MapType."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """A map from `"a"=>"1", "b"=>NULL`."""
    parts = F.regexp_extract_all(text, F.lit(r'"([^"]*)"\s*=>\s*("[^"]*"|NULL)'), F.lit(0))
    keys = F.transform(parts, lambda p: F.regexp_extract(p, r'^"([^"]*)"', 1))
    values = F.transform(parts, lambda p: F.when(p.endswith("=>NULL"), F.lit(None).cast("string")).otherwise(F.regexp_extract(p, r'=>\s*"([^"]*)"$', 1)))
    return F.map_from_arrays(keys, values)


def has_all(m: Column, *keys: str) -> Column:
    return F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(m, k))


def has_any(m: Column, *keys: str) -> Column:
    return F.exists(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(m, k))


def merged(a: Column, b: Column) -> Column:
    """b's values win."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def without(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def contains(m: Column, part: Column) -> Column:
    return F.forall(F.map_entries(part), lambda e: F.map_contains_key(m, e["key"]) & m[e["key"]].eqNullSafe(e["value"]))
