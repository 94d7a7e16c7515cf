"""Short reversible ids from numbers: the public hashids scheme, as Arrow-batched functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scheme: the default alphabet, separators, and how many of the rest become separators and guards.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890"
SEPARATORS = "cfhistuCFHISTU"
PER_SEPARATOR, PER_GUARD = 3.5, 12


def _shuffled(text: str, salt: str) -> str:
    if not salt:
        return text
    out, total = list(text), 0
    for step, i in enumerate(range(len(out) - 1, 0, -1)):
        at = step % len(salt)
        total += ord(salt[at])
        j = (ord(salt[at]) + at + total) % i
        out[i], out[j] = out[j], out[i]
    return "".join(out)


class Hashids:
    def __init__(self, salt: str = "", least: int = 0, alphabet: str = ALPHABET) -> None:
        self.salt, self.least = salt, least
        seps = "".join(c for c in SEPARATORS if c in alphabet)
        letters = "".join(c for c in dict.fromkeys(alphabet) if c not in seps)
        seps = _shuffled(seps, salt)
        wanted = max(2, math.ceil(len(letters) / PER_SEPARATOR))
        if (not seps or len(letters) / len(seps) > PER_SEPARATOR) and wanted > len(seps):
            take = wanted - len(seps)
            seps, letters = seps + letters[:take], letters[take:]
        letters = _shuffled(letters, salt)
        guards = math.ceil(len(letters) / PER_GUARD)
        if len(letters) < 3:
            self.guards, self.seps, self.letters = seps[:guards], seps[guards:], letters
        else:
            self.guards, self.seps, self.letters = letters[:guards], seps, letters[guards:]

    def encode(self, *values: int) -> str:
        if not values or min(values) < 0:
            return ""
        mark = sum(v % (i + 100) for i, v in enumerate(values))
        letters = self.letters
        first = out = letters[mark % len(letters)]
        for i, v in enumerate(values):
            letters = _shuffled(letters, (first + self.salt + letters)[: len(letters)])
            digits, rest = "", v
            while True:
                digits, rest = letters[rest % len(letters)] + digits, rest // len(letters)
                if not rest:
                    break
            out += digits
            if i + 1 < len(values):
                out += self.seps[v % (ord(digits[0]) + i) % len(self.seps)]
        if len(out) < self.least:
            out = self.guards[(mark + ord(out[0])) % len(self.guards)] + out
            if len(out) < self.least:
                out += self.guards[(mark + ord(out[2])) % len(self.guards)]
        half = len(letters) // 2
        while len(out) < self.least:
            letters = _shuffled(letters, letters)
            out = letters[half:] + out + letters[:half]
            if (over := len(out) - self.least) > 0:
                out = out[over // 2 : over // 2 + self.least]
        return out

    def decode(self, text: str) -> list[int]:
        """The numbers of an id; none if it isn't one of this salt."""
        parts = "".join(" " if c in self.guards else c for c in text).split(" ")
        body = parts[1] if len(parts) in (2, 3) else parts[0]
        if not body:
            return []
        first, letters, out = body[0], self.letters, []
        for part in "".join(" " if c in self.seps else c for c in body[1:]).split(" "):
            letters = _shuffled(letters, (first + self.salt + letters)[: len(letters)])
            value = 0
            for c in part:
                if c not in letters:
                    return []
                value = value * len(letters) + letters.index(c)
            out.append(value)
        return out if self.encode(*out) == text else []


def encode(number: Column, salt: str = "", least: int = 0, alphabet: str = ALPHABET) -> Column:
    """The id of a number; null stays null, a negative number gives an empty id."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        ids = Hashids(salt, least, alphabet)
        return values.map(lambda v: None if pd.isna(v) else ids.encode(int(v)))

    return run(number)


def decode(text: Column, salt: str = "", least: int = 0, alphabet: str = ALPHABET) -> Column:
    """The number of an id that has one; null otherwise."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        ids = Hashids(salt, least, alphabet)
        found = [ids.decode(v) if isinstance(v, str) else [] for v in values]
        return pd.Series([f[0] if len(f) == 1 else None for f in found], dtype="Int64")

    return run(text)
