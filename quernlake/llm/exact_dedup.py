"""Exact deduplication by a log-structured merge index of digests. DataFrame functions only.

Every input task is a series of memtables: it sorts the digests of its documents and flushes them as runs, Parquet files of bounded length with
min/max statistics and a Parquet Bloom filter on the digest (level 0). Compaction merges runs, and the level below, into one sorted level with an entry
for each digest: the id that stays, and how many rows share it. Entries decide; digests with several rows are hits, and the bytes of those
alone are compared: a filter of the hits is probed with every document, and only texts that it holds are shuffled. An entry stands if all of its rows
have the very same bytes; rows of a digest that different texts share are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, scratch_path, write_and_reread

#: Rows of a memtable, and so of a run.
MEMTABLE_ROWS = 1 << 20
#: Parquet settings of a run: the filter on digests.
RUN_FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000", "maxRecordsPerFile": str(MEMTABLE_ROWS)}
#: Bits that the filter of hits has for each, its probes, and its largest size (4 MB). In a fuller filter more texts are found that are no hits; results stay exact.
BITS_EACH, PROBES, MOST_BITS = 16, 3, 1 << 25


class DigestIndex:
    """Entries by digest under one folder: runs of (digest, rest, doc_id) as flushed, and one level of (digest, keep_id, rows) as compacted."""

    RUN, ENTRY = "digest binary, rest binary, doc_id bigint", "digest binary, keep_id bigint, rows bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min") -> None:
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.path, self.keep = spark, path or scratch_path(spark, "digests"), keep
        self.batches: list[str] = []  # all that was flushed
        self.fresh: list[str] = []  # flushed since the last compaction
        self.level: str | None = None

    def flush(self, digests: DataFrame) -> None:
        """Add (digest, rest, doc_id): each task writes its digests as sorted runs with filters, without a shuffle."""
        at = f"{self.path}/level0/batch={len(self.batches)}"
        digests.select("digest", "rest", "doc_id").sortWithinPartitions("digest", "doc_id").write.options(**RUN_FILTER).parquet(at)
        self.batches.append(at)
        self.fresh.append(at)

    def runs(self) -> DataFrame:
        """Every row that was flushed."""
        return self.spark.read.schema(self.RUN).parquet(*self.batches)

    def entries(self) -> DataFrame:
        """One entry for each digest. Runs that were flushed since the last compaction are merged with the level first."""
        if self.fresh:
            pick = F.min if self.keep == "min" else F.max
            entries = self.spark.read.schema(self.RUN).parquet(*self.fresh).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("rows"))
            if self.level:
                entries = entries.unionByName(self.spark.read.schema(self.ENTRY).parquet(self.level))
            merged = entries.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("rows").alias("rows"))
            self.level = f"{self.path}/level1/{len(self.batches)}"
            merged.sortWithinPartitions("digest").write.options(**RUN_FILTER).parquet(self.level)
            self.fresh = []
        return self.spark.read.schema(self.ENTRY).parquet(self.level)

    def find(self, digests: list[bytes]) -> DataFrame:
        """The entries of a few digests: Parquet's statistics and filters tell which runs hold them."""
        return self.entries().where(F.col("digest").isin([F.lit(d) for d in digests]))


def digest_of(text: Column, bits: int = 256) -> tuple[Column, Column]:
    """SHA-256 of the UTF-8 bytes, cut in two; fewer than 256 bits for the first part (a multiple of 8) only serve to test colliding digests."""
    full = F.unhex(F.sha2(text, 256))
    return F.substring(full, 1, bits // 8), F.substring(full, bits // 8 + 1, 32)


def _places(digest: Column, bits: int) -> list[Column]:
    h = F.xxhash64(digest)
    step = F.shiftrightunsigned(h, 40).bitwiseOR(F.lit(1))
    return [(F.shiftrightunsigned(h, 7) + F.lit(i) * step).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def filter_of(hits: DataFrame, bits: int) -> Column:
    """A Bloom filter of digests as a scalar subquery: an array of bits / 64 numbers, gathered in one task (4 MB at most)."""
    places = hits.select(F.explode(F.array(*_places(F.col("digest"), bits))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("mask"))
    dense = hits.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left").select(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")).alias("w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["mask"])).scalar()


def holds(words: Column, digest: Column, bits: int) -> Column:
    out = F.lit(True)
    for p in _places(digest, bits):
        out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """Group rows by equal text after lower-casing A-Z; null counts as empty.

    Returns, for each row of docs: doc_id, keep_id (the smallest or largest id of its group, as keep says), group_size,
    kept, text_sha256. Rows with a null id are grouped like others, never stay if their group has an id, and where it has
    none, keep_id is null and kept is false. Rows that repeat an id are counted each; all that carry keep_id are kept.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digest, rest = digest_of(norm, digest_bits)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("norm"), digest.alias("digest"), rest.alias("rest"))
    index = DigestIndex(spark, keep=keep)
    index.flush(rows)
    hits = index.entries().where("rows > 1")
    n_hits = hits.count()
    told = F.lower(F.hex(F.concat("digest", "rest"))).alias("text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")
    if not n_hits:
        return index.runs().withColumn("keep_id", F.col("doc_id")).select("doc_id", "keep_id", F.lit(1).cast("bigint").alias("group_size"), kept, told)
    # Byte verification: of each suspected text a task sends one copy, however many it holds.
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(6, (n_hits * BITS_EACH - 1).bit_length()))
    # The running number, which is asked for below, keeps Spark from working out the digest anew for each probe.
    probed = rows.select("norm", "digest", F.monotonically_increasing_id().alias("number"))
    suspects = probed.where(holds(filter_of(hits, bits), F.col("digest"), bits))
    texts = write_and_reread(suspects.groupBy("digest", "norm").agg(F.count("*").alias("same"), F.max("number").alias("last")).select("digest", "same", "last"), "verified")
    apart = hits.join(texts, "digest").where("same < rows").select("digest").distinct()
    entries = hits.select("digest", "keep_id", F.col("rows").alias("group_size"))
    out = index.runs().join(entries, "digest", "left")
    single = F.col("group_size").isNull()
    out = out.select("digest", "rest", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    if apart.isEmpty():
        return out.select("doc_id", "keep_id", "group_size", kept, told)
    # Different texts under one digest: these go by their texts.
    pick = F.min if keep == "min" else F.max
    own = rows.join(apart, "digest", "left_semi")
    groups = own.groupBy("digest", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    both = out.join(apart, "digest", "left_anti").unionByName(own.join(groups, ["digest", "norm"]).select(out.columns))
    return both.select("doc_id", "keep_id", "group_size", kept, told)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
