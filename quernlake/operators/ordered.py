"""What needs one order over a whole table, without one task getting all rows: the table is dealt into ranges of the order, written once, and
what each range needs of the ones before it comes from a table with one row for each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import write_and_reread

PART, WITHIN = "__part__", "__within__"


def in_ranges(df: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df with the number of its range and its place there. Written, so that every reader sees the same ranges.

    Rows that are equal in the order fall into one range; make the order unique if one value may have very many rows.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn(PART, F.spark_partition_id()).withColumn(WITHIN, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return write_and_reread(placed, "ranges")


def numbered(df: DataFrame, column: str, order: list[str | Column], start: int = 1, total: str | None = None, parts: int | None = None) -> DataFrame:
    """Numbers from start on, in order; under the name `total` also how many rows there are."""
    ranged = in_ranges(df, order, parts)
    sizes = ranged.groupBy(PART).agg(F.count("*").alias("__n__"))
    by_part = Window.orderBy(PART)  # over one row for each range
    before = F.coalesce(F.sum("__n__").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sizes.select(PART, before.alias("__before__"), F.sum("__n__").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total__"))
    out = ranged.join(F.broadcast(told), PART).withColumn(column, F.col("__before__") + F.col(WITHIN) + start)
    if total:
        out = out.withColumn(total, F.col("__total__"))
    return out.drop(PART, WITHIN, "__n__", "__before__", "__total__")


def percent_ranks(df: DataFrame, by: list[str], rank: str = "percent_rank", dist: str = "cume_dist", parts: int | None = None) -> DataFrame:
    """percent_rank and cume_dist over the whole table, rows that are equal in `by` being peers."""
    rows = numbered(df, "__row__", [F.col(c) for c in by], total="__rows__", parts=parts)
    peers = rows.groupBy(*by).agg(F.min("__row__").alias("__first__"), F.max("__row__").alias("__last__"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by]
    met = rows.alias("r").join(peers.alias("p"), same)
    first, last, n = F.col("__first__"), F.col("__last__"), F.col("__rows__")
    return met.select("r.*", "__first__", "__last__").select(*df.columns, F.when(n > 1, (first - 1) / (n - 1)).otherwise(F.lit(0.0)).alias(rank), (last / n).alias(dist))


def ntile(df: DataFrame, column: str, buckets: int, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """The number of one of so many buckets of the order, the first ones having a row more where they can't be equal."""
    rows = numbered(df, "__row__", order, start=0, total="__rows__", parts=parts)
    small, longer = F.floor(F.col("__rows__") / buckets), F.col("__rows__") % buckets
    row, edge = F.col("__row__"), longer * (small + 1)
    at = F.when(row < edge, F.floor(row / (small + 1))).otherwise(longer + F.floor((row - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn(column, (at + 1).cast("int")).drop("__row__", "__rows__")


def with_previous(df: DataFrame, column: str, of: str, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """A column of the row before: lag() over the whole table. A range's first row gets it from the last row of the range before."""
    ranged = in_ranges(df, order, parts)
    lasts = ranged.groupBy(PART).agg(F.max_by(F.struct(of), WITHIN).alias("__last__"))
    carried = lasts.select(PART, F.lag("__last__").over(Window.orderBy(PART)).alias("__carried__"))  # one row for each range
    inside = F.lag(of).over(Window.partitionBy(PART).orderBy(WITHIN))
    out = ranged.withColumn(column, inside).join(F.broadcast(carried), PART)
    return out.withColumn(column, F.when(F.col(WITHIN) == 0, F.col(f"__carried__.{of}")).otherwise(F.col(column))).drop(PART, WITHIN, "__carried__")
