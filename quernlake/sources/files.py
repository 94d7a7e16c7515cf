"""Sources and sinks beside Parquet: CSV as a bulk-copy format, text files as tables, binary files, JSON record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def copy_from_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = False, null: str = r"\N") -> DataFrame:
    """Rows of CSV files of a known schema; a row that doesn't fit it fails the read."""
    return spark.read.schema(schema).options(header=header, nullValue=null, mode="FAILFAST", escape='"').csv(path)


def copy_to_csv(df: DataFrame, path: str, header: bool = False, null: str = r"\N") -> None:
    """One CSV file for each partition. Nulls are written as the given mark."""
    df.write.options(header=header, nullValue=null, emptyValue="", escape='"').mode("errorifexists").csv(path)


def text_table(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """Lines of text files, as a table that is read anew each time."""
    return spark.read.text(path).withColumnRenamed("value", column)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def json_recordset(json: Column, schema: str) -> Column:
    """Rows of a JSON array of objects: an array of structs, for inline()."""
    return F.from_json(json, f"array<struct<{schema}>>")


def catalog_columns(spark: SparkSession) -> DataFrame:
    """Every column of every table and view of the current database: table_name, column_name, data_type, nullable."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")
