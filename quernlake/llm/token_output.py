"""Token ids of documents in a compact binary form: Simple-8b words in blocks, in ascending document order.

The file format. A folder of Parquet files, one for each range of ids; a row is a block of consecutive documents:
part and block (order of the range and of the block within it), start_in_part (ids of the part before the block), doc_ids
(int64), counts (uint32: ids of each document, its end id included), n_ids, words (uint64, Simple-8b). A word's top four bits are a selector:
how many ids of how many bits its other 60 bits hold, lowest first. Selector 0 is the escape: the word after it is one id
of up to 64 bits as it is. Since a block says how many words and ids it has, blocks decode on their own, with array operations.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_bytes, scratch_path

#: Fixed values of the format, by selector: ids in a word, and bits of each. Selector 0 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 0
_STEPS = np.maximum(COUNTS, 1).astype(np.uint8)
#: Ids of which a word holds none beyond a multiple.
STRIDE = 512
#: The selector of the most ids that fit before so many.
_WITHIN = np.array([0, *(int(np.flatnonzero(COUNTS[1:] <= i)[0]) + 1 for i in range(1, 61))], np.uint8)
#: Bits of small ids.
_LENGTHS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
#: Ids after which a block ends.
BLOCK_IDS = 1 << 17
#: Bytes of text (as Parquet) that one output file takes.
FILE_BYTES = 8 << 20
#: Bytes of text whose fragments are told apart at once.
GROUP_BYTES = 16 << 20
#: Files up to which their totals are broadcast; beyond, they are joined.
MOST_FILES_BROADCAST = 100_000
BLOCK_SCHEMA = "part int, block int, start_in_part bigint, doc_ids binary, counts binary, n_ids bigint, words binary"


def simple8b_encode(ids: np.ndarray) -> np.ndarray:
    """Pack unsigned ids into 64-bit words, greedily within each STRIDE of ids: a word takes as many of the next ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    if ids.max() < len(_LENGTHS):
        bits = _LENGTHS[ids]
    else:
        bits = np.where(ids == 0, 0, np.frexp(ids.astype(np.float64))[1]).astype(np.uint8)
        for i in np.flatnonzero(ids >= np.uint64(1 << 52)):  # beyond what a float tells apart
            bits[i] = int(ids[i]).bit_length()
    # The most bits among the next 1, 2, 3 ... ids; each place takes the last selector that still fits. First everywhere, then only
    # at the few places where many small ids follow.
    bits = np.concatenate([bits, np.full(60, 255, np.uint8)])
    chosen = np.full(n, ESCAPE, np.uint8)
    most, width, selector = bits[:n].copy(), 1, len(COUNTS) - 1
    while selector and COUNTS[selector] <= 8:
        while width < COUNTS[selector]:
            np.maximum(most, bits[width : n + width], out=most)
            width += 1
        np.copyto(chosen, np.uint8(selector), where=most <= np.uint8(BITS[selector]))
        selector -= 1
    places = np.flatnonzero(most <= BITS[selector + 1])
    most = most[places]
    while selector and len(places):
        while width < COUNTS[selector]:
            most = np.maximum(most, bits[places + width])
            width += 1
        fits = most <= BITS[selector]
        places, most = places[fits], most[fits]
        chosen[places] = selector
        selector -= 1
    # No word goes on over a multiple of STRIDE ids, so that all strides find their words' places side by side.
    left = np.minimum(STRIDE - np.arange(min(n, STRIDE)), 60)
    chosen = np.where(chosen == ESCAPE, ESCAPE, np.maximum(chosen, np.resize(_WITHIN[left], n)))
    steps = _STEPS[chosen]
    starts = np.zeros(n, bool)
    at = np.arange(0, n, STRIDE)
    ends = np.minimum(at + STRIDE, n)
    while len(at):
        starts[at] = True
        at = at + steps[at]
        more = at < ends
        at, ends = at[more], ends[more]
    places = np.flatnonzero(starts)
    picked = chosen[places].astype(np.int64)
    slots = np.cumsum(np.where(picked == ESCAPE, 2, 1))
    out = np.zeros(slots[-1], np.uint64)
    first = slots - np.where(picked == ESCAPE, 2, 1)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for selector in np.unique(picked):
        mine = np.flatnonzero(picked == selector)
        at = places[mine]
        if selector == ESCAPE:
            out[first[mine] + 1] = ids[at]
            continue
        word = np.full(len(mine), np.uint64(selector) << np.uint64(60), np.uint64)
        for k in range(COUNTS[selector]):
            word |= padded[at + k] << np.uint64(k * BITS[selector])
        out[first[mine]] = word
    return out


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words."""
    words = np.ascontiguousarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE):  # words after an escape aren't selectors
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 1, COUNTS[np.minimum(selectors, len(COUNTS) - 1)])
    counts[(selectors == ESCAPE) & ~raw] = 0
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    out[starts[raw]] = words[raw]
    for selector in np.unique(selectors[~raw]):
        if selector == ESCAPE:
            continue
        mine = np.flatnonzero(~raw & (selectors == selector))
        w, s, mask = words[mine], starts[mine], np.uint64((1 << int(BITS[selector])) - 1)
        for k in range(COUNTS[selector]):
            out[s + k] = (w >> np.uint64(k * BITS[selector])) & mask
    return out[:n]


def _byte_letters() -> dict[int, int]:
    """The rule of byte-level vocabularies: bytes that print stand for themselves, the others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b if b in shown else 256 + hidden.index(b) for b in range(256)}


def _pairs() -> np.ndarray:
    """Whether a token always ends between two bytes, by 8 * class + class. See TextEncoder."""
    out = np.zeros(64, bool)
    for a, b in ((LETTER, MARK), (LETTER, NEWLINE), (LETTER, SPACE), (LETTER, WHITE), (LETTER, APOSTROPHE), (MARK, LETTER), (MARK, SPACE), (APOSTROPHE, SPACE), (NEWLINE, LETTER)):
        out[8 * a + b] = True
    return out


#: Classes of bytes: of other letters and signs; a-z, A-Z and letters from U+00C0 to U+024F; ASCII that prints, but for the apostrophe; white space.
OTHER, LETTER, MARK, NEWLINE, SPACE, WHITE, APOSTROPHE = range(7)
_CLASS = np.array([OTHER if b > 126 else LETTER if chr(b).isalpha() else NEWLINE if b == 10 else SPACE if b == 32 else WHITE if b < 32 else APOSTROPHE if b == 39 else MARK for b in range(256)], np.uint8)
_ENDS = _pairs()


class TextEncoder:
    """Ids of texts by the tokenizers library, each distinct fragment of a group of texts being encoded once.

    The byte-level vocabulary splits a text by a fixed pattern before it merges anything, and merges nothing over a split. Some of these splits follow from
    two neighbouring bytes: between a letter and an ASCII character that is no letter; between such a character, but for an apostrophe, and a letter; before a space
    that follows anything but white space; and between a newline and a letter, if no white space is before it. Texts are cut there, by array operations, and
    each distinct fragment is encoded: by the library's model if it is one unit of the pattern, by the whole library if not.
    A text that may hold a special token is one fragment.
    """

    #: Fragments that are one unit: letters, digits, or other signs, with a space before them at most.
    UNIT = r"^ ?([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\x{24f}]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        letters = _byte_letters()
        self.letters = np.array([letters[b] if b != 10 else 10 for b in range(256)], "<u4")

    @staticmethod
    def cuts(buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where fragments begin in buf, texts beginning at begins."""
        kind = _CLASS[buf]
        lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC9))
        if len(lead):
            lead = lead[(buf[lead] != 0xC3) | ((buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7))]  # but for the signs of times and division
            kind[lead] = LETTER
            kind[lead + 1] = LETTER
        edge = np.zeros(len(buf), bool)
        edge[1:] = _ENDS[(kind[:-1] << 3) | kind[1:]]
        lines = np.flatnonzero(edge[1:] & (kind[:-1] == NEWLINE)) + 1
        before = kind[np.maximum(lines - 2, 0)]
        edge[lines] = (lines > 1) & ((before == LETTER) | (before == MARK) | (before == APOSTROPHE))
        edge[begins] = True
        return edge

    def ids_of(self, fragments: pa.Array) -> pa.ListArray:
        """The ids of each fragment."""
        single = pc.match_substring_regex(fragments, self.UNIT).to_numpy(zero_copy_only=False)
        ids: list[int] = []
        counts: list[int] = []
        units = fragments.filter(pa.array(single))
        if len(units):
            tokenize = self.tokenizer.model.tokenize
            data = pc.binary_join(pa.ListArray.from_arrays([0, len(units)], units.cast(pa.string())), "\n")[0].as_py().encode()
            for unit in self.letters[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le").split("\n"):
                found = tokenize(unit)
                counts.append(len(found))
                ids += [t.id for t in found]
        for found in self.tokenizer.encode_batch_fast(fragments.filter(pa.array(~single)).to_pylist(), add_special_tokens=False):
            counts.append(len(found.ids))
            ids += found.ids
        # As they were: units and others in turn.
        order = np.argsort(np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)]), kind="stable")
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
        return found.take(pa.array(order))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none of them null), one text after the other, and how many each has. Special tokens are recognised as the library does by default."""
        lengths = np.asarray(pc.binary_length(texts), np.int64)
        ends = np.cumsum(lengths)
        if not len(texts) or not ends[-1]:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        data = b"".join(texts.cast(pa.large_binary()).to_pylist())
        buf, begins = np.frombuffer(data, np.uint8), ends - lengths
        edge = self.cuts(buf, begins[lengths > 0])
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
            edge[begins[i] + 1 : ends[i]] = False
        at = np.flatnonzero(edge)
        offsets = pa.py_buffer(np.append(at, len(buf)).astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_string(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        found = self.ids_of(parts.dictionary).take(parts.indices)
        after = found.offsets.to_numpy()  # ids before each fragment
        return found.flatten().to_numpy(), (after[np.searchsorted(at, ends)] - after[np.searchsorted(at, begins)]).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> TextEncoder:
    """The encoder of a vocabulary, made once in each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(vocabulary)


def _groups(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together have at most so many bytes; a longer text is alone."""
    a, ends = 0, np.cumsum(lengths)
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), side="right")))
        yield a, b
        a = b


def _write_blocks(batches: Iterator[pa.RecordBatch], encoder: TextEncoder, end_id: int) -> Iterator[pa.RecordBatch]:
    """Tokenize the documents of a range, in order, into blocks: runs of documents that end once they have a block's ids."""
    part, block, start = TaskContext.get().partitionId(), 0, 0
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    for batch in batches:
        ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("text")
        for a, b in _groups(np.asarray(pc.binary_length(texts), np.int64), GROUP_BYTES):
            tokens, counts = encoder.encode(texts.slice(a, b - a))
            ends = np.cumsum(counts)
            tokens = np.insert(tokens, ends, end_id)
            counts, ends = counts + 1, ends + np.arange(1, b - a + 1)
            last = np.unique(np.append(np.flatnonzero(np.diff(ends // BLOCK_IDS)) + 1, b - a))
            for i, j in zip(np.append(0, last[:-1]).tolist(), last.tolist(), strict=True):
                mine = tokens[ends[i] - counts[i] : ends[j - 1]]
                row = [part, block, start, ids[a + i : a + j].tobytes(), counts[i:j].astype(np.uint32).tobytes(), len(mine), simple8b_encode(mine.astype(np.uint64)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "block", "start_in_part", "doc_ids", "counts", "n_ids", "words"])
                block += 1
                start += len(mine)


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, files: int | None = None) -> int:
    """Tokenize docs and write their ids to a folder in the module's format, in ascending doc_id order. Returns how many files there may be.

    Only doc_id and text are read. A null text is empty: it has the end id alone. Rows that share an id follow one another, by
    text; a null id counts as the smallest 64-bit integer. An empty table gives a folder without blocks.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = files or max(1, -(-input_bytes(rows) // FILE_BYTES))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file; executors need not see the path
    ranged.mapInArrow(lambda it: _write_blocks(it, _encoder(vocabulary.value), end_id), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return n


def read_blocks(spark: SparkSession, path: str, files: int) -> DataFrame:
    """The blocks of a folder, each with start: how many ids all blocks before it hold. One row for each file is summed in one task."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    ids_of = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ids_of.select("part", before.cast("bigint").alias("part_start"))
    if files <= MOST_FILES_BROADCAST:
        starts = F.broadcast(starts)  # a row for each file
    return blocks.join(starts, "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start")


def decode_documents(blocks: DataFrame, function, schema: str) -> DataFrame:
    """Decode blocks and apply function(doc_ids, starts, counts, ids) -> arrays, in the order of schema, to each."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
                ids = simple8b_decode(np.frombuffer(row["words"], np.uint64), row["n_ids"])
                starts = row["start"] + np.cumsum(counts) - counts
                yield function(np.frombuffer(row["doc_ids"], np.int64), starts, counts, ids)

    return blocks.select("doc_ids", "counts", "n_ids", "words", "start").mapInArrow(decoded, schema)


def _digests(doc_ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    data = memoryview(ids.astype("<u4").tobytes())
    ends = np.cumsum(counts)
    crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    nulls = doc_ids == -(1 << 63)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=nulls), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs as token ids, read the files back, and return doc_id, start, n_tokens, ids_crc32 of each row."""
    path = scratch_path(docs.sparkSession, "tokens")
    files = write_token_ids(docs, path, tokenizer_path)
    return decode_documents(read_blocks(docs.sparkSession, path, files), _digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
