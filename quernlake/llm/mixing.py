"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_and_reread

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Consecutive ids that are numbered together; a source with many documents of one size is numbered in such pieces.
ID_RANGE = 4096
#: Sources up to which their targets are broadcast; beyond, they are joined.
MOST_SOURCES_BROADCAST = 100_000


def word_count(text):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")).cast("bigint")


def water_fill(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Targets by source: shares of the total size by weight, none above `most` times its source's size.

    sizes has source, source_size, one row for each source: a table as small as the list of sources. Sources take the
    weights in turn, by code point with null last. What a source can't take is dealt to the others by weight: with the sources in
    order of cap / weight, those before the first that stays under its cap take their caps.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left_size", F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(rest))
    s = s.withColumn("level", F.col("left_size") / F.col("left_weight"))
    s = s.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("first", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix", carry: bool = False) -> DataFrame:
    """How often a mix takes each document: doc_id, source, size (words), source_size, target, copies, taken.

    Within a source all documents have the same expected copies r = target / source_size. Ordered by (size, doc_id), document
    number i takes floor(u + r (i + 1)) - floor(u + r i) copies, u being one offset drawn from the source's name and the seed: an
    integer boundary crossed gives a copy. Order by size makes the words taken come near the target. Never more than ceil(r) copies.

    With carry, a column `row` holds all columns of the document, which have to include doc_id, source and text.

    A null text has size 0, a null source is a source, a null id comes first among equal sizes (rows that repeat an id, or
    lack one, are numbered among themselves in an order that only affects which of the equal rows counts). No source: no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    sized = sized.withColumn("range", F.coalesce(F.floor(F.col("doc_id") / ID_RANGE), F.lit(-(1 << 62))))
    rows = write_and_reread(sized.drop("row"), "sizes")
    cells = rows.groupBy("source", "size", "range").agg(F.count("*").alias("rows"))
    # Two sums over counts: sizes within a source, then id ranges within a size.
    by_size = cells.groupBy("source", "size").agg(F.sum("rows").alias("rows"))
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select(F.col("source").alias("s1"), F.col("size").alias("z1"), F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("smaller"))
    within = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("range").alias("r2"), F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("earlier"))
    targets = write_and_reread(water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    if targets.count() <= MOST_SOURCES_BROADCAST:
        targets = F.broadcast(targets)
    cells = cells.join(by_size, F.col("s2").eqNullSafe(F.col("s1")) & (F.col("z2") == F.col("z1"))).join(targets, F.col("s2").eqNullSafe(F.col("source")))
    cells = cells.select("s2", "z2", "r2", (F.col("smaller") + F.col("earlier")).alias("before"), "source_size", "target")
    numbered = (sized if carry else rows).withColumn("i", F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("doc_id")) - 1)
    j = numbered.join(cells, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("range") == F.col("r2")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("before") + F.col("i")
    copies = (F.floor(u + r * (i + 1)) - F.floor(u + r * i)).cast("bigint")
    return j.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight) AS first FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(first * weight, cap)) AS target FROM f),
i AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r,
        ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(u + r * (i + 1)) - floor(u + r * i)))::BIGINT AS taken FROM i
"""
