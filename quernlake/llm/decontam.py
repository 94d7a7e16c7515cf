"""Benchmark decontamination by winnowing.

Of every window of w consecutive k-gram hashes the smallest is kept as a fingerprint, so that two texts which share
k + w - 1 words share a fingerprint whatever stands around them. Test items and documents meet on fingerprints; each
hit is extended to the windows of words around it, which are then compared by 128-bit BLAKE2 hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, mix64, ngram_hashes, word_hashes, write_and_reread

#: Bits of the filter on test fingerprints that is broadcast: 1 MB. A fuller filter lets more documents' fingerprints through to the join, no more.
FILTER_BITS = 1 << 23
ROWS = "doc_id bigint, key binary, n_words bigint, hits array<struct<fp:bigint,size:int,hash:binary,start:bigint>>"


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hash of every window of w, each place once; the leftmost of equal ones. Fewer hashes make one window."""
    if not len(hashes):
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, min(w, len(hashes)))
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


class Words:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text after lower-casing A-Z; null has none. hashes: 64 bits of each."""

    def __init__(self, text: str | None) -> None:
        self.data = (text or "").encode().lower()
        self.hashes, self.starts, self.ends = word_hashes(self.data, ALNUM)
        self._joined: bytes | None = None

    def __len__(self) -> int:
        return len(self.hashes)

    def window(self, start: int, size: int) -> bytes:
        """A 128-bit hash of the words from start on."""
        if self._joined is None:
            self._joined = b" ".join([self.data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])
            self._offsets = np.append(0, np.cumsum(self.ends - self.starts + 1))
        return hashlib.blake2b(self._joined[self._offsets[start] : self._offsets[start + size] - 1], digest_size=16).digest()

    def key(self) -> bytes:
        """A 128-bit hash of the text: what is found in a text depends on nothing else."""
        return hashlib.blake2b(self.data, digest_size=16).digest()


def _filter_places(fps: np.ndarray) -> np.ndarray:
    return (fps >> np.uint64(40)).astype(np.int64) & (FILTER_BITS - 1)


class Shape:
    """Sizes: words of a window, and k of the k-grams. An item of fewer words than a window is a window of its own size, found by its whole hash."""

    def __init__(self, window: int, k: int) -> None:
        if not 1 <= k <= window:
            raise ValueError("k must lie between 1 and the words of a window")
        self.window, self.k = window, k

    def fingerprints(self, words: np.ndarray, sizes: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each window size asked for: the size, places and fingerprints of words. Short sizes count every place."""
        out = []
        for size in sizes:
            grams = ngram_hashes(words, self.k if size == self.window else size)
            at = winnow(grams, self.window - self.k + 1) if size == self.window else np.arange(len(grams))
            out.append((size, at, mix64(grams[at] ^ np.uint64(size))))
        return out


def _test_windows(shape: Shape):
    """Rows of an item: each window's hash and the fingerprint that finds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"item_id": [], "size": [], "hash": [], "fp": []}
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = Words(text)
                if not len(words):
                    continue
                size = min(shape.window, len(words))
                full = [words.window(s, size) for s in range(len(words) - size + 1)]
                ((_, at, fps),) = shape.fingerprints(words.hashes, [size])
                # a window has the fingerprint of every place within it
                reach = shape.window - shape.k if size == shape.window else 0
                for a, fp in zip(at.tolist(), fps.tolist(), strict=True):
                    for s in range(max(0, a - reach), min(a + 1, len(full))):
                        out["item_id"].append(item)
                        out["size"].append(size)
                        out["hash"].append(full[s])
                        out["fp"].append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["size"], pa.int32()), pa.array(out["hash"], pa.binary()), pa.array(np.array(out["fp"], np.uint64).view(np.int64))], names=list(out))

    return run


def _document_hits(shape: Shape, sizes: list[int], shared, carry: tuple[str, ...]):
    """A row of each document: its words, and the windows around each fingerprint that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("hash", pa.binary()), ("start", pa.int64())]))
        for batch in batches:
            keys, n_words, hits = [], [], []
            for text in batch.column("text").to_pylist():
                words = Words(text)
                own: list[dict] = []
                for size, at, fps in shape.fingerprints(words.hashes, sizes):
                    places = _filter_places(fps)
                    found = np.flatnonzero((held[places >> 3] >> (places & 7).astype(np.uint8)) & 1)
                    if not len(found):
                        continue
                    reach, last = shape.window - shape.k if size == shape.window else 0, len(words) - size
                    seen: dict[int, bytes] = {}
                    for a, fp in zip(at[found].tolist(), fps[found].view(np.int64).tolist(), strict=True):
                        for s in range(max(0, a - reach), min(a, last) + 1):
                            if s not in seen:
                                seen[s] = words.window(s, size)
                            own.append({"fp": fp, "size": size, "hash": seen[s], "start": s})
                keys.append(words.key() if own else None)
                n_words.append(len(words))
                hits.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(n_words, pa.int64()), pa.array(hits, kind), *map(batch.column, carry)], names=["doc_id", "key", "n_words", "hits", *carry])

    return run


def _filter_of(tests: DataFrame) -> np.ndarray:
    """The fixed-size filter on test fingerprints: the tasks' filters, joined by shard."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_places(batch.column("fp").to_numpy().view(np.uint64))] = True
        at = np.flatnonzero(np.packbits(bits, bitorder="little"))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.packbits(bits, bitorder="little")[at].astype(np.int32))], names=["at", "byte"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in tests.select("fp").mapInArrow(places, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).collect():  # FILTER_BITS / 8 rows at most
        out[row["at"]] = row["byte"]
    return out


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = 13, k: int = 5, share: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find the windows of test items in documents: (doc_id, n_words, n_hit, item_ids, contaminated) for each row of docs.

    docs has doc_id and text, tests has item_id and text; other columns are ignored. A document's word is hit if it lies in
    any occurrence of a window of an item; item_ids are the items with windows in the document, as strings, sorted;
    contaminated means that at least `share` of the words, and one at least, are hit. Null and empty texts have no words and no windows; null item ids
    are dropped from item_ids but their windows count. Rows that repeat an id are judged each by its own text. Without items nothing is hit; without
    documents the result is empty. `carry` names further columns of docs that the result has too.
    """
    spark, shape = docs.sparkSession, Shape(window, k)
    pairs = write_and_reread(tests.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_test_windows(shape), "item_id string, size int, hash binary, fp bigint"), "test-windows")
    sizes = sorted(r["size"] for r in pairs.select("size").distinct().collect())  # `window` values at most
    shared = spark.sparkContext.broadcast(_filter_of(pairs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    found = write_and_reread(rows.mapInArrow(_document_hits(shape, sizes, shared, carry), ", ".join([ROWS, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])), "document-hits")
    # By text from here on, once for all rows that have it.
    hits = found.where("key IS NOT NULL").select("key", F.explode("hits").alias("h")).select("key", "h.*")
    # Fingerprints join first, then whole windows; a window is found by several fingerprints.
    met = hits.join(pairs.select("fp", "size").distinct(), ["fp", "size"], "left_semi").drop("fp").distinct()
    matched = met.join(pairs.select("size", "hash").distinct(), ["size", "hash"], "left_semi")
    # Words covered: what each window adds beyond all windows that start before it.
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy("key").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    added = matched.select("key", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("added"))
    covered = added.groupBy("key").agg(F.sum("added").alias("n_hit"))
    items = matched.select("key", "size", "hash").distinct().join(pairs.select("size", "hash", "item_id").distinct(), ["size", "hash"])
    items = items.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    told = write_and_reread(covered.join(items, "key", "left"), "hit-texts")
    # Rows without a candidate have nothing to join.
    none = found.where("key IS NULL").select("doc_id", "n_words", *carry, F.lit(None).cast("bigint").alias("n_hit"), F.lit(None).cast("array<string>").alias("item_ids"))
    out = found.where("key IS NOT NULL").join(told, "key", "left").select(none.columns).unionByName(none)
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words"))).alias("contaminated"), *carry)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return done.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), listed, ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS size FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM bn)),
sizes AS (SELECT DISTINCT size FROM win),
dg AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS gram FROM (SELECT dw.*, sizes.size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, sizes)),
m AS (SELECT dg.doc_id, dg.size, dg.s, win.item_id FROM dg JOIN win ON dg.size = win.size AND dg.gram = win.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, size, s FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
"""
