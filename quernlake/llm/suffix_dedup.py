"""Removal of byte strings that repeat across documents, by a distributed sparse suffix array.

A suffix array of every byte would be shuffled fifty times over. Here the suffixes that are sorted start where a content rule puts
an anchor: of all windows of `length` bytes, each belongs to the anchor at its smallest token (TOKEN bytes, compared by hash). Equal
windows have equal anchors, so windows can only be equal if their anchors' leading tokens are. The steps:

1. Documents are packed into blocks, a table in the shared folder.
2. Leading tokens are range-partitioned by sampled splitters, in the order of their first bytes (within equal ones, by hash); a bucket tells each block which of
   its tokens another block or document has too, and which of them very many blocks have.
3. The bytes around such anchors (all windows of the anchor) go to the bucket of their token. There the windows' suffixes are sorted by
   multikey quicksort, eight bytes at a time, ties only being refined; runs of equal windows get the smallest document that holds them.
   Splitters never part a token, and a bucket has all windows of its tokens, so neighbours over a boundary differ and no run crosses it.
   A token of very many blocks is parted itself: its windows that reach far to the left go by the bytes before it, the others by those behind it. Equal windows
   have their token at one place, and these bytes in common.
4. Each block learns the smallest document of its windows, and marks the bytes to remove.

A block sends a token, and the bytes around an anchor, once however many of its documents have them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, mix64, write_and_reread

#: Bytes of an anchor's token.
TOKEN = 20
#: Bytes of text that a block holds; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of Parquet input for which there is one bucket.
BUCKET_BYTES = 2 << 20
#: Anchors' tokens that each block gives to the choice of splitters.
SPLITTER_SAMPLE = 256
#: Places whose anchors are looked for at once.
PIECE_BYTES = 1 << 18
#: Blocks that have a token beyond which its windows are parted by the bytes beside it.
HOT_BLOCKS = 128
#: Bytes beside a token by which its windows are parted.
BESIDE = 8
NO_DOCUMENT = np.iinfo(np.int64).max
BLOCKS = "block bigint, doc_ids binary, lengths binary, data binary, sample array<bigint>"


def anchors(buf: np.ndarray, doc_of_window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, place of the anchor, token hash.

    buf holds documents end to end; doc_of_window says for each place whether a whole window of one document starts there.
    """
    n, token = len(buf), min(TOKEN, length)
    if n < length or not doc_of_window.any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    hashes = token_hashes(buf, token)
    reach = length - token + 1  # tokens in a window
    places = np.uint64((1 << 24) - 1)
    if n > places:
        raise ValueError("a block must stay under 16 MB")
    # Smallest hash, leftmost of equals: 40 bits of hash above the place.
    low = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    starts = np.flatnonzero(doc_of_window)
    at = (low[starts] & places).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[edge[1:] - 1, len(starts) - 1]
    return starts[edge], starts[last], at[edge], hashes[at[edge]]


def token_hashes(buf: np.ndarray, token: int) -> np.ndarray:
    """A hash of the `token` bytes from each place on, by words of eight bytes that may overlap."""
    n = len(buf) - token + 1
    if token < 8:
        out = np.zeros(n, np.uint64)
        for i in range(token):
            out = (out << np.uint64(8)) | buf[i : n + i].astype(np.uint64)
        return mix64(out)
    words = np.ndarray((len(buf) - 7,), "<u8", buf.tobytes(), strides=(1,))
    out = np.full(n, np.uint64(token))
    for i in [*range(0, token - 8, 8), token - 8]:
        out = (out ^ words[i : n + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(35)
    return mix64(out)


def leading_keys(buf: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What tokens are ordered by: their first four bytes (no more than a hash's half tell them apart otherwise), then half of their hash."""
    first = np.zeros(len(at), np.uint64)
    for i in range(4):
        first = (first << np.uint64(8)) | buf[np.minimum(at + i, len(buf) - 1)].astype(np.uint64)
    return (first << np.uint64(32)) | (hashes >> np.uint64(32))


def equal_runs(windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of equally long byte strings given as rows of 64-bit words.

    Returns the rows in groups of equal strings, and a group number for each. Each round sorts by one word, only rows that are still tied.
    """
    group = np.zeros(len(order), np.int64)  # by position: the first position of its run of ties
    open_ = np.arange(len(order))
    for k in range(windows.shape[1]):
        word = windows[order[open_], k]
        by = np.lexsort((word, group[open_])) if k else np.argsort(word, kind="stable")
        order[open_] = order[open_[by]]
        word, tied = word[by], group[open_]
        new = np.r_[True, (word[1:] != word[:-1]) | (tied[1:] != tied[:-1])]
        first = open_[np.flatnonzero(new)]
        group[open_] = first[np.cumsum(new) - 1]
        size = np.diff(np.r_[np.flatnonzero(new), len(open_)])
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            break
    return order, group


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, byte lengths, compressed bytes, and the tokens of some anchors for the splitters."""
    part, made = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, bytes]] = []

    def block() -> pa.RecordBatch:
        nonlocal made, held
        ids, lengths, data = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), b"".join(h[2] for h in held))
        held = []
        head = np.frombuffer(data[:PIECE_BYTES], np.uint8)  # anchors across documents serve as well here
        _, _, at, found = anchors(head, np.arange(len(head)) + length <= len(head), length)
        sample = leading_keys(head, at, found) if min(TOKEN, length) >= 4 else found
        sample = sample[:: max(1, len(sample) // SPLITTER_SAMPLE)].view(np.int64)
        row = [(part << 32) | made, ids.tobytes(), lengths.tobytes(), pa.compress(data, "zstd", asbytes=True), sample.tolist()]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["block", "doc_ids", "lengths", "data", "sample"])

    size = 0
    for batch in batches:
        ids, text = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text").cast(pa.large_binary())
        lengths = np.asarray(pc.binary_length(text), np.int64)
        a = 0
        while a < len(ids):
            room = np.searchsorted(np.cumsum(lengths[a:]), BLOCK_BYTES - size, side="right")
            b = a + max(int(room), 0 if held else 1)
            if b > a:
                held.append((ids[a:b], lengths[a:b], b"".join(text.slice(a, b - a).to_pylist())))
                size += int(lengths[a:b].sum())
            if b < len(ids):
                yield block()
                size = 0
            a = b
    if held:
        yield block()


class Block:
    """A block's documents, unpacked."""

    def __init__(self, doc_ids: bytes, lengths: bytes, data: bytes, length: int) -> None:
        self.doc_ids, self.lengths = np.frombuffer(doc_ids, np.int64), np.frombuffer(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        size = int(self.ends[-1]) if len(self.ends) else 0
        self.buf = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8) if size else np.empty(0, np.uint8)
        self.whole = np.ones(size, bool)  # a window of one document starts here
        for begin, end in zip(np.maximum(self.ends - self.lengths, self.ends - length + 1).tolist(), self.ends.tolist(), strict=True):
            self.whole[begin:end] = False
        self.first, self.last, self.at, self.token = self._anchors(length)
        if min(TOKEN, length) >= 4:
            self.token = leading_keys(self.buf, self.at, self.token)
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _anchors(self, length: int) -> tuple[np.ndarray, ...]:
        places = PIECE_BYTES
        if len(self.buf) <= places:
            return anchors(self.buf, self.whole, length)
        # In pieces that overlap by a window less a byte.
        found = []
        for a in range(0, len(self.buf), places):
            b = min(len(self.buf), a + places + length - 1)
            whole = self.whole[a:b].copy()
            whole[places:] = False
            first, last, at, token = anchors(self.buf[a:b], whole & (np.arange(b - a) + length <= b - a), length)
            found.append((first + a, last + a, at + a, token))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def shared_runs(self, shared: np.ndarray, hot: np.ndarray, length: int) -> None:
        """Keep the runs of windows around shared tokens, those of hot ones in two parts; `apart` says by which bytes a part goes (0: by its token)."""
        if not len(shared):
            shared = np.array([0], np.uint64)
        keep = shared[np.minimum(np.searchsorted(shared, self.token), len(shared) - 1)] == self.token
        first, last, at, token, doc = (x[keep] for x in (self.first, self.last, self.at, self.token, self.doc))
        apart = np.zeros(len(first), np.uint64)
        extra = length - min(TOKEN, length)
        if len(hot) and extra >= 2 * BESIDE:
            parted = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token)
            words = np.ndarray((len(self.buf) - 7,), "<u8", self.buf.tobytes(), strides=(1,))
            # A window that starts at s has the token's place - s bytes before it.
            middle = at[parted] - extra // 2
            left, right = first[parted] < middle, last[parted] >= middle
            l, r = parted[left], parted[right]  # noqa: E741
            rest = np.ones(len(first), bool)
            rest[parted] = False
            before = mix64(token[l] ^ mix64(words[at[l] - BESIDE])) | np.uint64(1)
            behind = mix64(token[r] + mix64(words[at[r] + min(TOKEN, length)])) | np.uint64(1)
            firsts = (first[rest], first[l], np.maximum(first[r], at[r] - extra // 2))
            lasts = (last[rest], np.minimum(last[l], at[l] - extra // 2 - 1), last[r])
            first, last, apart = np.concatenate(firsts), np.concatenate(lasts), np.concatenate([apart[rest], before, behind])
            token, doc = (np.concatenate([x[rest], x[l], x[r]]) for x in (token, doc))
        self.first, self.last, self.token, self.doc, self.apart = first, last, token, doc, apart

    def contexts(self, length: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct bytes of the windows of the runs, and which of them each run has."""
        data = self.buf.tobytes()
        seen: dict[tuple[bytes, int], int] = {}
        which = [seen.setdefault((data[a : b + length], p), len(seen)) for a, b, p in zip(self.first.tolist(), self.last.tolist(), self.apart.tolist(), strict=True)]
        return [text for text, _ in seen], np.array(which, np.int64)


def _rows(names: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names.split())


def _send_tokens(length: int, splitters: np.ndarray):
    """For each bucket the block's tokens, once each: those of one document, then those of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_ids", "lengths", "data")), strict=True):
                block = Block(ids, lengths, data, length)
                order = np.lexsort((block.doc, block.token))
                token, doc = block.token[order], block.doc[order]
                first = np.flatnonzero(np.r_[len(token) > 0, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
                several = doc[first] != doc[np.r_[first[1:] - 1, len(doc) - 1]] if len(first) else np.empty(0, bool)
                token = token[first]
                cuts = np.searchsorted(token, np.r_[splitters, np.uint64(2**64 - 1)], side="right")
                begin, rows = 0, []
                for bucket, end in enumerate(cuts.tolist()):
                    if end > begin:
                        t, s = token[begin:end], several[begin:end]
                        rows.append((bucket, number, t[~s].tobytes(), t[s].tobytes()))
                    begin = end
                yield _rows("bucket block single several", [pa.int32(), pa.int64(), pa.binary(), pa.binary()], rows)

    return run


def _shared_tokens(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block the tokens that more than one document has."""
    blocks, singles, severals = (table.column(c).to_pylist() for c in ("block", "single", "several"))
    parts = [np.frombuffer(a + b, np.uint64) for a, b in zip(singles, severals, strict=True)]
    token = np.concatenate(parts)
    more = np.concatenate([np.repeat([False, True], [len(a) // 8, len(b) // 8]) for a, b in zip(singles, severals, strict=True)])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(token, kind="stable")
    token, more, owner = token[order], more[order], owner[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[first, len(token)])
    held = np.repeat((size > 1) | np.logical_or.reduceat(more, first), size)
    hot = np.repeat(size > HOT_BLOCKS, size)[held]
    token, owner = token[held], owner[held]
    order = np.argsort(owner, kind="stable")
    token, owner, hot = token[order], owner[order], hot[order]
    cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
    own = [(blocks[i], token[a:b], hot[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
    return pa.Table.from_batches([_rows("block tokens hot", [pa.int64(), pa.binary(), pa.binary()], [(i, t.tobytes(), t[h].tobytes()) for i, t, h in own])])


def _sorted_tokens(table: pa.Table, column: str) -> np.ndarray:
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in table.column(column).to_pylist() if x is not None)]))


def _send_contexts(length: int, splitters: np.ndarray, buckets: int):
    """For each bucket the distinct bytes around the block's shared anchors, with the smallest document that has them."""

    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, tokens: pa.Table) -> pa.Table:
        rows = []
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        if blocks.num_rows and tokens.num_rows:
            block = Block(*(blocks.column(c)[0].as_py() for c in ("doc_ids", "lengths", "data")), length)
            block.shared_runs(_sorted_tokens(tokens, "tokens"), _sorted_tokens(tokens, "hot"), length)
            contexts, which = block.contexts(length)
            ids = block.doc_ids[block.doc]
            least, most = np.full(len(contexts), NO_DOCUMENT), np.full(len(contexts), np.iinfo(np.int64).min)
            np.minimum.at(least, which, ids)
            np.maximum.at(most, which, ids)
            to = np.zeros(len(contexts), np.int64)
            to[which] = np.where(block.apart > 0, (block.apart % np.uint64(buckets)).astype(np.int64), np.searchsorted(splitters, block.token))
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets), side="right")
            begin = 0
            for bucket, end in enumerate(cuts.tolist()):
                if end > begin:
                    mine = order[begin:end]
                    data = b"".join(contexts[i] for i in mine.tolist())
                    sizes = np.array([len(contexts[i]) for i in mine.tolist()], np.int32)
                    extents = np.stack([least[mine], most[mine]]).tobytes()
                    rows.append((bucket, key[0].as_py(), mine.astype(np.int32).tobytes(), sizes.tobytes(), extents, pa.compress(data, "zstd", asbytes=True)))
                begin = end
        return pa.Table.from_batches([_rows("bucket block numbers sizes extents data", kinds, rows)])

    return run


def _smallest_documents(length: int):
    """Of one bucket: for each block the runs of windows of its contexts that a smaller document has, and that document."""

    def run(table: pa.Table) -> pa.Table:
        blocks, numbers, sizes, extents, datas = [], [], [], [], []
        for b, n, s, e, d in zip(*(table.column(c).to_pylist() for c in ("block", "numbers", "sizes", "extents", "data")), strict=True):
            s = np.frombuffer(s, np.int32).astype(np.int64)
            blocks.append(np.full(len(s), b, np.int64))
            numbers.append(np.frombuffer(n, np.int32))
            sizes.append(s)
            extents.append(np.frombuffer(e, np.int64).reshape(2, -1))
            datas.append(pa.decompress(d, int(s.sum()), "zstd", asbytes=True))
        block, number, size, (least, most) = np.concatenate(blocks), np.concatenate(numbers), np.concatenate(sizes), np.concatenate(extents, axis=1)
        data = b"".join(datas)
        # The same bytes of several blocks are sorted once.
        ends = np.cumsum(size)
        unique: dict[bytes, int] = {}
        which = np.fromiter((unique.setdefault(data[e - n : e], len(unique)) for e, n in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(ends))
        texts = list(unique)
        low = np.full(len(texts), NO_DOCUMENT)
        np.minimum.at(low, which, least)
        width = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1  # windows of each
        end = np.cumsum(width + length - 1)
        owner = np.repeat(np.arange(len(texts)), width)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        start = (end - width - length + 1)[owner] + within
        buf = b"".join(texts) + bytes(8)
        words = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))  # the order of numbers is that of bytes
        offsets = [*range(0, max(length - 8, 0), 8), max(length - 8, 0)]
        keys = np.stack([words[start + o].astype(np.uint64) for o in offsets], axis=1)
        if length < 8:
            keys >>= np.uint64(8 * (8 - length))
        order, group = equal_runs(keys, np.arange(len(start)))
        del keys
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        smallest = np.minimum.reduceat(low[owner[order]], first)
        best = np.empty(len(start), np.int64)
        best[order] = np.repeat(smallest, np.diff(np.r_[first, len(group)]))
        # Runs of windows of one context with one smallest document.
        edge = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])])
        run_owner, run_from, run_doc = owner[edge], within[edge], best[edge]
        run_to = within[np.r_[edge[1:] - 1, len(owner) - 1]]
        begin = np.searchsorted(run_owner, np.arange(len(texts) + 1))
        many = (begin[1:] - begin[:-1])[which]
        row = np.repeat(np.arange(len(which)), many)
        run = np.repeat(begin[:-1][which] - (np.cumsum(many) - many), many) + np.arange(len(row))
        useful = run_doc[run] < most[row]
        row, run = row[useful], run[useful]
        order = np.argsort(block[row], kind="stable")
        row, run = row[order], run[order]
        names, firsts = np.unique(block[row], return_index=True)
        cuts = np.r_[firsts, len(row)]
        out = [(int(name), np.stack([number[row[a:b]].astype(np.int64), run_from[run[a:b]], run_to[run[a:b]], run_doc[run[a:b]]]).tobytes()) for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_batches([_rows("block runs", [pa.int64(), pa.binary()], out)])

    return run


def _remove(length: int, finish):
    """Mark a block's windows that a smaller document has, remove their bytes, and give finish() each document."""

    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, tokens: pa.Table) -> pa.Table:
        del key
        block = Block(*(blocks.column(c)[0].as_py() for c in ("doc_ids", "lengths", "data")), length)
        change = np.zeros(len(block.buf) + 1, np.int32)
        # Which runs were sent is told by the tokens; what was found is by the number of the context.
        runs = [x for x in tokens.column("runs").to_pylist() if x is not None]
        if runs:
            block.shared_runs(_sorted_tokens(tokens, "tokens"), _sorted_tokens(tokens, "hot"), length)
            _, which = block.contexts(length)
            first, doc = block.first, block.doc
            number, begin, end, smallest = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in runs], axis=1)
            order = np.argsort(number, kind="stable")
            number, begin, end, smallest = number[order], begin[order], end[order], smallest[order]
            lo, hi = np.searchsorted(number, which), np.searchsorted(number, which, side="right")
            many = hi - lo
            anchor = np.repeat(np.arange(len(which)), many)
            r = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(anchor))
            gone = smallest[r] < block.doc_ids[doc[anchor]]
            np.add.at(change, first[anchor[gone]] + begin[r[gone]], 1)
            np.add.at(change, first[anchor[gone]] + end[r[gone]] + length, -1)
        return finish(block, np.cumsum(change[:-1]) > 0)

    return run


def _digests(block: Block, gone: np.ndarray) -> pa.Table:
    data = block.buf
    begins = block.ends - block.lengths
    removed = np.r_[0, np.cumsum(gone)]
    starts = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
    starts[begins[block.lengths > 0]] = gone[begins[block.lengths > 0]]
    spans = np.r_[0, np.cumsum(starts)]
    hashes = []
    for a, b in zip(begins.tolist(), block.ends.tolist(), strict=True):
        part = data[a:b]
        hashes.append(hashlib.sha256(part[~gone[a:b]].tobytes() if removed[b] > removed[a] else part.tobytes()).hexdigest())
    ids = pa.array(block.doc_ids, mask=block.doc_ids == NO_DOCUMENT)
    return pa.table({"doc_id": ids, "n_bytes": block.lengths, "n_removed": removed[block.ends] - removed[begins], "n_spans": spans[block.ends] - spans[begins], "kept_sha256": pa.array(hashes, pa.string())})


def _spans(block: Block, gone: np.ndarray) -> pa.Table:
    begins = block.ends - block.lengths
    docs, starts, ends = [], [], []
    for d, (a, b) in enumerate(zip(begins.tolist(), block.ends.tolist(), strict=True)):
        edges = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False].astype(np.int8)))
        docs += [d] * (len(edges) // 2)
        starts += edges[::2].tolist()
        ends += edges[1::2].tolist()
    ids = block.doc_ids[docs] if docs else np.empty(0, np.int64)
    return pa.table({"doc_id": pa.array(ids, mask=ids == NO_DOCUMENT), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())})


def _kept_texts(block: Block, gone: np.ndarray) -> pa.Table:
    begins = block.ends - block.lengths
    kept = [block.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(begins.tolist(), block.ends.tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(block.doc_ids, mask=block.doc_ids == NO_DOCUMENT), "kept": pa.array(kept, pa.binary())})


#: What can be asked for, with the columns of each.
OUTPUTS = {
    "digests": (_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"),
    "spans": (_spans, "doc_id bigint, start bigint, end bigint"),
    "texts": (_kept_texts, "doc_id bigint, kept binary"),
}


def remove_repeats(docs: DataFrame, length: int = 50, output: str = "digests", buckets: int | None = None) -> DataFrame:
    """Remove each byte that a `length`-byte string covers which also starts in a document with a smaller doc_id.

    docs has doc_id and text (UTF-8, null is empty); other columns are ignored. output: "digests" gives n_bytes, n_removed, n_spans and
    the SHA-256 of what stays for each row; "spans" the removed runs, start and end in bytes; "texts" the bytes that stay (a cut may fall inside
    a character). Rows that share an id are one another's equals: they lose nothing to each other. A null id counts as larger than all; such rows
    lose nothing to each other. Texts shorter than length stay whole. An empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_DOCUMENT))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or max(1, -(-input_bytes(rows) // BUCKET_BYTES))
    blocks = write_and_reread(rows.mapInArrow(lambda it: _pack(it, length), BLOCKS), "blocks", compression="uncompressed")
    splitters = np.empty(0, np.uint64)
    if n > 1:
        # n - 1 quantiles of the sampled tokens; the unsigned order of hashes
        cut = blocks.select(F.explode("sample").alias("h")).select((F.col("h").cast("double") + F.when(F.col("h") < 0, F.lit(2.0**64)).otherwise(0.0)).alias("h"))
        got = cut.agg(F.percentile_approx("h", [i / n for i in range(1, n)], 10_000)).first()[0] or []
        splitters = np.unique(np.array(got, np.float64).astype(np.uint64))
    packed = blocks.drop("sample")
    tokens = packed.mapInArrow(_send_tokens(length, splitters), "bucket int, block bigint, single binary, several binary")
    shared = write_and_reread(tokens.groupBy("bucket").applyInArrow(_shared_tokens, "block bigint, tokens binary, hot binary"), "shared-tokens")
    contexts = packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_contexts(length, splitters, len(splitters) + 1), "bucket int, block bigint, numbers binary, sizes binary, extents binary, data binary")
    found = contexts.groupBy("bucket").applyInArrow(_smallest_documents(length), "block bigint, runs binary")
    told = found.unionByName(shared, allowMissingColumns=True).select("block", "tokens", "hot", "runs")
    finish, schema = OUTPUTS[output]
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_remove(length, finish), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
