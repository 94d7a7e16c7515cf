"""SQL over named DataFrames: bound values, quoted names, lists of statements, schemas without running, what a view reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, values: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL whose {table} placeholders stand for DataFrames, and whose :names (or ?) stand for values, which are never part of the text."""
    return spark.sql(text, args=values, **tables) if values is not None else spark.sql(text, **tables)


def identifier(name: str) -> str:
    """A name as it stands in Spark's SQL: each part in back-quotes, those inside doubled."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def literal(value) -> str:
    """A value as it stands in Spark's SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).upper() if isinstance(value, bool) else repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def formatted(text: str, *values) -> str:
    """The text with $1, $2 ... replaced by literals; for logs and views, which take no bound values."""
    for n in range(len(values), 0, -1):
        text = text.replace(f"${n}", literal(values[n - 1]))
    return text


def run(spark: SparkSession, statements: list[str], **tables: DataFrame) -> list[DataFrame]:
    """Run statements one after the other; the result of each. The first that fails ends the list with its error."""
    return [spark.sql(s, **tables) for s in statements]


def describe(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Columns of a query's result, name, data_type, nullable, from its plan alone."""
    fields = query(spark, text, **tables).schema.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "name string, data_type string, nullable boolean")


def reads(df: DataFrame) -> list[str]:
    """The files or folders that a DataFrame reads, through all views it is made of."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for i in range(leaves.size()):
        if leaves.apply(i).nodeName() == "LogicalRelation" or hasattr(leaves.apply(i), "relation"):
            paths = leaves.apply(i).relation().location().rootPaths()
            found |= {paths.apply(k).toString() for k in range(paths.size())}
    return sorted(found)
