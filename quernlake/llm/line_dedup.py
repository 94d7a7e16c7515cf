"""Line deduplication with two Bloom filters, of line hashes seen once and seen twice.

Each filter is cut into shards by hash range; the tasks that own the shards get packed 64-bit hashes, eight bytes for each line that a
task has, and keep what is seen for a second time. The twice-seen filter has a fixed largest size, so it can be broadcast;
lines that it holds are suspected repeats, and only their text is shuffled, to be confirmed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, write_and_reread

SPACE = b" \t\n\x0b\x0c\r"
SHARDS = 256
#: Bits of a filter that a line hash sets.
PROBES = 3
#: Largest size of a filter: 64 MB. Beyond the lines that this suits, more lines are suspected; the result stays exact.
MOST_BITS = 1 << 29


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a UTF-8 line: stripped of ASCII white space, A-Z lower-cased; None if it has fewer code points than asked."""
    key = line.strip(SPACE)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key.lower()


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for x in (text or "").encode().split(b"\n") if (k := line_key(x, min_chars)) is not None}


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places within a shard of so many bits, for each hash."""
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(i) * step) >> np.uint64(3)) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def _pack(hashes: np.ndarray, again: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted distinct hashes, and those seen more than once, by shard."""
    a, b = ((x >> np.uint64(56)).astype(np.int64) for x in (hashes, again))
    edges = np.arange(SHARDS + 1)
    i, j = np.searchsorted(a, edges), np.searchsorted(b, edges)
    full = [s for s in range(SHARDS) if i[s] < i[s + 1]]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([hashes[i[s] : i[s + 1]].tobytes() for s in full], pa.binary()), pa.array([again[j[s] : j[s + 1]].tobytes() for s in full], pa.binary())], names=["shard", "seen", "again"])


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(k) for t in batch.column(0).to_pylist() for k in _keys(t, min_chars)]
            hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            yield from _pack(hashes, hashes[counts > 1])

    return run


def _fill_filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, seen, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard not in once:
                    once[shard], twice[shard] = np.zeros(bits, bool), np.zeros(bits, bool)
                places = _places(np.frombuffer(seen, np.uint64), bits)
                known = once[shard][places].all(axis=0)
                twice[shard][places[:, known]] = True
                once[shard][places] = True
                twice[shard][_places(np.frombuffer(again, np.uint64), bits)] = True
        for shard, held in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["shard", "bits"])

    return run


def twice_seen(texts: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The twice-seen filter over all lines of the one column of texts: packed bits, SHARDS rows."""
    packed = texts.mapInArrow(_hash_lines(min_chars), "shard int, seen binary, again binary")
    shards = packed.repartition(min(SHARDS, 64), "shard").mapInArrow(_fill_filters(bits), "shard int, bits binary")
    out = np.zeros((SHARDS, bits // 8), np.uint8)
    for row in shards.collect():  # of a fixed size, see MOST_BITS
        out[row.shard] = np.frombuffer(row.bits, np.uint8)
    return out


def filter_bits(size: int) -> int:
    """Bits of one shard for texts of so many (Parquet) bytes: about 16 for each hundred, a power of two within bounds."""
    return 1 << int(np.clip(np.ceil(np.log2(max(size, 1) / 6 / SHARDS)), 10, np.log2(MOST_BITS // SHARDS)))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """The lines to lose: (doc_id, key) for every key that enough documents hold, but for its largest doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bits = bits or filter_bits(input_bytes(docs.select("text")))
    shared = spark.sparkContext.broadcast(twice_seen(rows.select("text"), min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            keys = [sorted(_keys(t, min_chars)) for t in batch.column("text").to_pylist()]
            flat = [k for ks in keys for k in ks]
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in flat], np.uint64)
            places, shard = _places(hashes, bits), (hashes >> np.uint64(56)).astype(np.int64)
            hit = ((held[shard, places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=0) if len(flat) else np.zeros(0, bool)
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[hit]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array([flat[i] for i in np.flatnonzero(hit)], pa.binary())], names=["doc_id", "key"])

    held = write_and_reread(rows.where("doc_id IS NOT NULL").mapInArrow(suspects, "doc_id bigint, key binary"), "suspects")
    once = held.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))  # a common key is spread over its documents first
    dead = once.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("key", "last")
    # Written, so that the join's sides are plain tables: a small one is broadcast, and else Spark splits a common key's rows.
    dead = write_and_reread(dead, "repeated-lines")
    return held.join(dead, "key").where("doc_id <> last").select("doc_id", "key")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """Drop lines that many documents share, except from the largest doc_id that holds them.

    Returns for each row of docs: doc_id, text (the lines that stay, joined by newlines), n_lines, n_dropped. Null and
    empty texts have one empty line and give an empty text. Documents are told apart by id: rows that repeat one count once as a holder, lose
    the lines that any of them has to lose, and all keep a line of which theirs is the largest id. Rows with a null id are no documents: they
    don't count, and keep all lines. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    gone = repeated_lines(docs, min_chars, min_docs, bits).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = rows.join(gone, "doc_id", "left").select("doc_id", "text", "keys")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                dead = set(keys or ())
                stay = [x for x in lines if line_key(x.encode(), min_chars) not in dead] if dead else lines
                texts.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(drop, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
