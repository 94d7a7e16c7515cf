"""Intervals with a lower and an upper end, parsed from text: `a .. b`, `a(+-)d`, `a`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\s*([-+]?[0-9]*\.?[0-9]+)\s*"


def interval(text: Column) -> Column:
    """struct(lo, hi) of doubles; null where the text is none of the forms."""
    number = lambda p, g: F.regexp_extract(text, p, g).cast("double")
    span, around, point = f"^{_NUMBER}\\.\\.{_NUMBER}$", rf"^{_NUMBER}\(\+-\){_NUMBER}$", f"^{_NUMBER}$"
    make = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    return F.when(text.rlike(span), make(number(span, 1), number(span, 2))).when(text.rlike(around), make(number(around, 1) - number(around, 2), number(around, 1) + number(around, 2))).when(text.rlike(point), make(number(point, 1), number(point, 1)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])


def contains(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"])
