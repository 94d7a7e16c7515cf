"""Label paths such as `a.b.c`: ancestors, levels, parts, common ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def is_descendant(path: Column, of: Column | str) -> Column:
    """Whether path is `of` or lies below it, label by label."""
    top = _path(of)
    return (path == top) | path.startswith(F.concat(top, F.lit(".")))


def levels(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, offset: int, length: int | None = None) -> Column:
    labels = F.split(path, r"\.")
    return F.array_join(F.slice(labels, offset + 1, F.lit(length) if length is not None else F.size(labels)), ".")


def common_ancestor(a: Column, b: Column) -> Column:
    """The longest path above both, the last label of a path being no part of it."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i))
    return F.array_join(F.slice(x, F.lit(1), F.array_max(same)), ".")
