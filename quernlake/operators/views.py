"""Views that are kept up by deltas: counts and sums by group are stored, signed changes are added to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partials(df: DataFrame, keys: list[str], sums: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Stored form of a view: rows and sums for each group. weight is 1 for added rows (the default) and -1 for removed ones."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys).agg(F.sum(w).alias("rows"), *[F.sum(w * e).alias(n) for n, e in sums.items()])


def refresh(stored: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Add a delta's partials to the stored ones; groups without rows go. Averages are sums over rows."""
    both = stored.unionByName(delta)
    return both.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in sums]).where("rows > 0")


def signed(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Changes with a weight column, for partials()."""
    return added.withColumn("weight", F.lit(1)).unionByName(removed.withColumn("weight", F.lit(-1)))


def join_delta(a: DataFrame, delta_a: DataFrame, b: DataFrame, delta_b: DataFrame, keys: list[str]) -> DataFrame:
    """What signed changes of two tables (weight 1 or -1) do to their join: changes of one meet the other as it was, or, for the second, as the first now is.

    a and b are the tables before the changes; the result has a weight too, and costs joins with changes alone.
    """
    now_a = a.withColumn("weight", F.lit(1)).unionByName(delta_a)
    first = delta_a.join(b, keys)
    second = now_a.join(delta_b.withColumnRenamed("weight", "_w"), keys).withColumn("weight", F.col("weight") * F.col("_w")).drop("_w")
    return first.unionByName(second)


def distinct_partials(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Stored form of a DISTINCT view: how often each row is there. refresh() with all columns as keys drops what is there no more."""
    columns = [c for c in df.columns if c != "weight"]
    return partials(df, columns, {}, weight)
