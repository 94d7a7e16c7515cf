"""Row operators that Spark SQL lacks or spells otherwise: the first row of each key, positional crosstab, frames by groups, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nulls_last(*columns: str | Column) -> list[Column]:
    """Ascending order with nulls at the end."""
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in columns]


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def crosstab(df: DataFrame, row: str, category: str, value: str, names: list[str]) -> DataFrame:
    """A row's values side by side: the n-th by category fills the n-th name, whatever the category is; missing ones are null."""
    numbered = df.withColumn("_k", F.row_number().over(Window.partitionBy(row).orderBy(category)))
    return numbered.groupBy(row).agg(*[F.max(F.when(F.col("_k") == i + 1, F.col(value))).alias(n) for i, n in enumerate(names)])


def groups_frame(df: DataFrame, keys: list[str], order: str, before: int, after: int, aggregate: Column, name: str) -> DataFrame:
    """An aggregate over the peers of a row and those of so many distinct order values before and after."""
    ranked = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    frame = Window.partitionBy(*keys).orderBy("_peer").rangeBetween(-before, after)
    return ranked.withColumn(name, aggregate.over(frame)).drop("_peer")


def sum_excluding_current(value: str, window) -> Column:
    """The sum over a frame without the current row's own value."""
    return F.sum(value).over(window) - F.coalesce(F.col(value), F.lit(0))


def keyset_page(df: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next `size` rows in the order of unique columns, after a given row's values: a cursor that rereads nothing."""
    if after is not None:
        past = F.lit(False)
        same = F.lit(True)
        for c, v in zip(order, after, strict=True):
            past, same = past | (same & (F.col(c) > F.lit(v))), same & (F.col(c) == F.lit(v))
        df = df.where(past)
    return df.orderBy(*order).limit(size)


def normal_rand(spark: SparkSession, n: int, mean: float, deviation: float, seed: int) -> DataFrame:
    """n normally distributed numbers, the same for the same seed and number of partitions."""
    return spark.range(n).select((F.randn(seed) * deviation + mean).alias("value"))


def match_counts(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, most: int = 10_000) -> DataFrame:
    """How many texts contain each pattern: pattern, n (patterns that none contains are left out).

    The texts are scanned once. Up to `most` patterns go to every task as one array; more are joined, in a nested loop over parts of both tables.
    """
    if patterns.count() > most:
        pairs = texts.join(patterns.hint("shuffle_replicate_nl"), F.col(text).contains(F.col(pattern)))
        return pairs.groupBy(pattern).agg(F.count("*").alias("n"))
    held = F.array(*[F.lit(r[0]) for r in patterns.select(pattern).collect()]).cast("array<string>")  # `most` strings
    return texts.select(F.explode(F.filter(held, lambda p: F.col(text).contains(p))).alias(pattern)).groupBy(pattern).agg(F.count("*").alias("n"))


def page_with_total(df: DataFrame, order: list[str], offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows offset .. offset + limit in order, each with the number of all rows as total_count. Offset and limit come together, or neither does."""
    if (offset is None) != (limit is None):
        raise ValueError("offset and limit must be provided together")
    if offset is None:
        return df.orderBy(*order)
    if not all(isinstance(n, int) and not isinstance(n, bool) for n in (offset, limit)):
        raise ValueError("offset and limit must be numbers")
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(df.agg(F.count("*").alias("total_count"))))


def frame_excluding(df: DataFrame, keys: list[str], order: str, value: str, name: str, exclude: str) -> DataFrame:
    """The sum of a value over a partition, from its start to the row's last peer in the order, without the row's peers ("group") or without its peers but itself ("ties")."""
    if exclude not in ("group", "ties"):
        raise ValueError("exclude is group or ties")
    upto = F.sum(value).over(Window.partitionBy(*keys).orderBy(order))
    peers = F.sum(value).over(Window.partitionBy(*keys, order))
    return df.withColumn(name, upto - peers + (F.lit(0) if exclude == "group" else F.col(value)))
