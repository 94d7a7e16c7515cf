"""Changes to tables as DataFrames: each function returns the table after the change, and where asked the rows that changed.

Nothing is changed in place: write the result to a new folder, or a new partition, and read that from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True).select(table.columns)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the condition holds (not where it is null)."""
    hit = F.coalesce(where, F.lit(False))
    return table.select([F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def updated_rows(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """What an update returns: the changed rows, as they are after it."""
    return update(table.where(where), F.lit(True), values)


def deleted_rows(table: DataFrame, where: Column) -> DataFrame:
    """What a delete returns: the rows that go."""
    return table.where(F.coalesce(where, F.lit(False)))


def inserted_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """What an insert returns: the added rows, with all columns of the table."""
    return insert(table.where("false"), rows)


def affected(*changed: DataFrame) -> DataFrame:
    """Rows that each of several statements changed, and their sums so far: statement, rows, affected."""
    counts = None
    for i, df in enumerate(changed):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(i + 1).alias("statement"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.withColumn("affected", F.sum("rows").over(Window.orderBy("statement")))  # one row for each statement


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_matching(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(other.select(keys).distinct(), keys, "left_anti").select(table.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with the same key. rows has at most one row for a key."""
    return delete_matching(table, rows, keys).unionByName(rows.select(table.columns))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks are added, others ignored."""
    return table.unionByName(rows.join(table.select(keys), keys, "left_anti").select(table.columns))


def merge(table: DataFrame, rows: DataFrame, keys: list[str], updates: dict[str, Column], delete_when: Column | None = None) -> DataFrame:
    """Rows meet the table on keys (one row for a key): `updates` are expressions over both, the incoming columns being named `new_<column>`;
    matched rows for which delete_when holds go; unmatched rows are added."""
    new = rows.select(*[F.col(c).alias(f"new_{c}") for c in rows.columns], F.lit(True).alias("_met"))
    on = [F.col(k) == F.col(f"new_{k}") for k in keys]
    joined = table.join(new, on, "left")
    met = F.coalesce(F.col("_met"), F.lit(False))
    if delete_when is not None:
        joined = joined.where(~(met & F.coalesce(delete_when, F.lit(False))))
    kept = joined.select([F.when(met, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in table.columns])
    return kept.unionByName(rows.join(table.select(keys), keys, "left_anti").select(table.columns))


def with_serial(rows: DataFrame, column: str, start: int, order: list[str], parts: int | None = None) -> DataFrame:
    """Ids from start on, in order, without one task getting all rows."""
    return numbered(rows, column, order, start, parts=parts)


def check_unique(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: empty where the constraint holds."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
