"""Identifiers: version-3, -5 and -7 UUIDs, ISBN and ISSN check digits, short ids from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name spaces of named UUIDs, and the empty UUID.
NAMESPACES = {"dns": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "url": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "oid": "6ba7b812-9dad-11d1-80b4-00c04fd430c8", "x500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8"}
NIL = "00000000-0000-0000-0000-000000000000"


def _dashed(h: Column) -> Column:
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _named(name: Column, namespace: str, version: int) -> Column:
    data = F.concat(F.unhex(F.lit(NAMESPACES[namespace].replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.md5(data) if version == 3 else F.sha1(data)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return _dashed(F.concat(F.substring(h, 1, 12), F.lit(str(version)), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def uuid3(name: Column, namespace: str = "dns") -> Column:
    return _named(name, namespace, 3)


def uuid5(name: Column, namespace: str = "dns") -> Column:
    return _named(name, namespace, 5)


def uuid7(millis: Column, randomness: Column) -> Column:
    """A version-7 UUID of a time in milliseconds and 20 hex digits or more to fill it up."""
    h = F.concat(F.lpad(F.lower(F.hex(millis)), 12, "0"), F.lit("7"), F.substring(randomness, 1, 3), F.lit("8"), F.substring(randomness, 4, 15))
    return _dashed(h)


def uuid7_time(uuid: Column) -> Column:
    """The time in a version-7 UUID."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(uuid, F.lit("-")), 1, 12), 16, 10).cast("bigint"))


def _digits(text: Column, n: int) -> list[Column]:
    return [F.substring(text, i, 1).cast("int") for i in range(1, n + 1)]


def isbn13(isbn10: Column) -> Column:
    """The 13-digit form of a ten-character ISBN without dashes."""
    body = F.concat(F.lit("978"), F.substring(isbn10, 1, 9))
    total = sum((d * (3 if i % 2 else 1) for i, d in enumerate(_digits(body, 12))), F.lit(0))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def isbn13_valid(isbn: Column) -> Column:
    total = sum((d * (3 if i % 2 else 1) for i, d in enumerate(_digits(isbn, 13))), F.lit(0))
    return isbn.rlike("^[0-9]{13}$") & (total % 10 == 0)


def issn_check(seven: Column) -> Column:
    """An ISSN's last character from its first seven digits."""
    total = sum((d * (8 - i) for i, d in enumerate(_digits(seven, 7))), F.lit(0))
    last = (11 - total % 11) % 11
    return F.when(last == 10, "X").otherwise(last.cast("string"))
