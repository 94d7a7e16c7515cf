"""Near-duplicate documents by b-bit MinHash, every link being confirmed on the full sets of shingles.

A document's set is its distinct word shingles. Documents with equal sets form a class, which one row stands for from then on. MINIMA minima
of each class make bands of ROWS minima; classes that share a band are candidates (at similarity 0.85 all but one pair in 10^10 share one). Of the
minima only the lowest BITS bits are kept, packed into words; counting equal fields, corrected for fields that are equal by chance, estimates the similarity.

Candidates are confirmed in two rounds. First the pairs of small buckets, and for classes in larger ones the pairs with a few hubs, the smallest first class of
its buckets and some that have the same: those that the estimate leaves are confirmed pair by pair, and linked classes get one label. In most groups of copies that ends
it. Then the larger buckets that hold several labels: their signatures are compared in tiles of bounded size, never two classes of one label, and each tile returns a
spanning forest of what the estimate leaves. The classes of such a tree meet in tiles again, with their full sets. Chunks of a tile hold either one large label or many
small ones, so tiles of one label are left out, and a group of any size costs a comparison with its hub for each class, and one with the group for each class that isn't like the hub.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, mix64, ngram_hashes, word_hashes, write_and_reread
from .graph import connected_components

MINIMA, ROWS, BITS = 128, 4, 2
SMALL_BUCKET = 4
#: Classes that all classes with one smallest hub are compared with: the hub, and others of them.
HUBS = 4
#: Classes in a chunk, two of which make a tile: of signatures, and of full sets.
SIGNATURE_TILE, TILE = 1024, 400
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 6.0
#: Shingles whose minima are taken at once.
CHUNK = 1 << 16
_SEEDS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, (2, MINIMA), np.uint64).astype(np.uint32)
_SEEDS[0] |= 1
SIGNATURE = "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, packed array<bigint>"


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct `size`-word shingles of a text after lower-casing A-Z; of fewer words, the one sequence of all; null has none."""
    words = word_hashes((text or "").encode(errors="surrogatepass").lower(), NON_SPACE)[0]
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(words, min(size, len(words))))


def set_key(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each non-empty set: a row for each set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), MINIMA), np.uint32)
    for i in range(MINIMA):
        h = x ^ _SEEDS[1, i]
        h *= _SEEDS[0, i]
        h ^= h >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(h, begin)
    return out


def bands_of(least: np.ndarray) -> np.ndarray:
    groups = least.astype(np.uint64).reshape(len(least), MINIMA // ROWS, ROWS)
    out = np.broadcast_to(np.arange(MINIMA // ROWS, dtype=np.uint64), groups.shape[:2]).copy()
    for i in range(ROWS):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + groups[:, :, i])
    return out.view(np.int64)


def packed_of(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, 64 / BITS to a word."""
    per = 64 // BITS
    fields = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, per)
    return np.bitwise_or.reduce(fields << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: equal fields by bit counts, corrected for chance."""
    odd = 0
    for k in range(1, MINIMA * BITS // 64 + 1):
        x = F.element_at(a, k).bitwiseXOR(F.element_at(b, k))
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(F.element_at(a, k).bitwiseXOR(F.element_at(b, k)), shift))
        fields = sum(1 << i for i in range(0, 64, BITS))
        odd = odd + F.bit_count(x.bitwiseAND(F.lit(fields if fields < 1 << 63 else fields - (1 << 64))))
    equal = 1 - odd / F.lit(float(MINIMA))
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def least_estimate(percent: int) -> float:
    j = percent / 100
    p = j + (1 - j) * 2.0**-BITS
    return j - SLACK * (p * (1 - p) / MINIMA) ** 0.5 / (1 - 2.0**-BITS)


def _signatures(size: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            a, n = 0, len(texts)
            while a < n:
                sets: list[np.ndarray] = []
                total = 0
                while a + len(sets) < n and total < CHUNK:
                    sets.append(shingle_set(texts[a + len(sets)].as_py(), size))
                    total += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, packed = [None] * len(sets), [None] * len(sets)
                if full:
                    least = minima([sets[i] for i in full])
                    for i, x, y in zip(full, bands_of(least), packed_of(least), strict=True):
                        bands[i], packed[i] = x, y
                kind = pa.list_(pa.int64())
                columns = [batch.column("doc_id").slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(bands, kind), pa.array(packed, kind)]
                columns += [batch.column(c).slice(a, len(sets)) for c in carry]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "bands", "packed", *carry])
                a += len(sets)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])

    return run


def _linked(n_both: np.ndarray | int, n_a, n_b, percent: int):
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _confirm_pairs(percent: int):
    """Pairs with both sets: those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("hashes_a", "hashes_b"))
            good = []
            for a, b in zip(x, y, strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([a, b]))
                good.append(bool(_linked(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slabs of the incidence matrix."""
    n, sizes = len(sets), [len(s) for s in sets]
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    count = np.diff(np.r_[np.flatnonzero(new), len(hashes)])
    shared = np.repeat(count > 1, count)  # a hash of one set alone adds nothing
    owner, column = owner[shared], (np.cumsum(new & shared) - 1)[shared]
    out = np.zeros((n, n), np.int64)
    slab = np.zeros((n, columns), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        slab[:] = 0
        slab[owner[lo:hi], column[lo:hi] - a] = 1
        out += np.rint(slab @ slab.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = sizes
    return out


def _forest(linked: np.ndarray, names: list[bytes]) -> pa.Table:
    """A spanning forest of a graph given as a matrix: from smaller names on, so that tiles with the same rows give the same trees, and few links in all."""
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    names, linked = [names[i] for i in order], linked[order][:, order]
    seen = np.zeros(len(names), bool)
    a, b = [], []
    for s in np.flatnonzero(linked.any(axis=1)).tolist():
        stack = [] if seen[s] else [s]
        seen[s] = True
        while stack:
            u = stack.pop()
            fresh = np.flatnonzero(linked[u] & ~seen).tolist()
            seen[fresh] = True
            a += [names[u]] * len(fresh)
            b += [names[v] for v in fresh]
            stack += fresh
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _apart(table: pa.Table) -> np.ndarray:
    """Which pairs of a tile's rows have different labels."""
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    return label[:, None] != label[None, :]


def _estimate_tile(percent: int):
    """Of one tile: a spanning forest of the pairs of different labels that the estimate leaves."""
    fields = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    # the estimate as a bound on unequal fields
    most = int(np.floor(MINIMA * (1 - (least_estimate(percent) * (1 - 2.0**-BITS) + 2.0**-BITS)) + 1e-9))

    def run(table: pa.Table) -> pa.Table:
        packed = np.array(table.column("packed").to_pylist(), np.int64).view(np.uint64)
        odd = np.zeros((len(packed), len(packed)), np.uint8)
        for k in range(packed.shape[1]):
            x = packed[:, None, k] ^ packed[None, :, k]
            for shift in range(1, BITS):
                x |= x >> np.uint64(shift)
            odd += np.bitwise_count(x & fields)
        return _forest((odd <= most) & _apart(table), table.column("key").to_pylist())

    return run


def _confirm_tile(percent: int):
    """Of one tile: a spanning forest of the links between classes of different labels."""

    def run(table: pa.Table) -> pa.Table:
        both = intersections([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
        sizes = np.diag(both)
        return _forest(_linked(both, sizes[:, None], sizes[None, :], percent) & _apart(table), table.column("key").to_pylist())

    return run


def _tiles(members: DataFrame, most: int) -> DataFrame:
    """Deal members (grp, key, label) into tiles of two chunks: rows (grp, i, j, key, label) such that each two members of a group with different labels meet.

    A label of `most` members or more in a group has chunks of its own, the others share chunks; members of one label stay together where they can.
    """
    labels = members.groupBy("grp", "label").agg(F.count("*").alias("n"))
    pooled = labels.where(F.col("n") < most).groupBy("grp").agg(F.sum("n").alias("pool"))
    labels = labels.join(pooled, "grp", "left").select("grp", "label", F.when(F.col("n") >= most, F.col("label")).alias("owner"), F.ceil(F.when(F.col("n") >= most, F.col("n")).otherwise(F.col("pool")) * 2 / most).alias("parts"))
    dealt = members.join(labels, ["grp", "label"])
    part = F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("key")), F.greatest(F.lit(1), F.floor(F.col("parts") / 2)))
    dealt = write_and_reread(dealt.select("grp", "key", "label", "owner", F.xxhash64("owner", part).alias("chunk")), "chunks")
    chunks = dealt.groupBy("grp", "chunk", "owner").agg(F.min("label").alias("least"), F.max("label").alias("last"))
    x, y = (chunks.select("grp", F.col("chunk").alias(c), F.col("owner").alias(f"owner_{c}"), F.col("least").alias(f"least_{c}"), F.col("last").alias(f"last_{c}")) for c in ("i", "j"))
    pairs = x.join(y, "grp").where("i < j AND NOT coalesce(owner_i = owner_j, false) OR i = j AND least_i <> last_i").select("grp", "i", "j")
    pairs = write_and_reread(pairs, "tiles")
    sides = pairs.select("grp", "i", "j", F.col("i").alias("chunk")).unionByName(pairs.where("i < j").select("grp", "i", "j", F.col("j").alias("chunk")))
    return dealt.join(sides, ["grp", "chunk"]).select("grp", "i", "j", "key", "label")


def _full_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(key, hashes) of the classes needed, each computed from one of its documents."""
    ids = needed.join(classes.select("key", F.col("doc_id").alias("of_id")), "key")
    texts = docs.join(ids.select("of_id").distinct(), F.col("doc_id") == F.col("of_id")).select("text")
    return write_and_reread(texts.mapInArrow(_sets(size), "key binary, hashes binary").join(needed, "key", "left_semi").dropDuplicates(["key"]), "sets", compression="uncompressed")


def _components(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes (key, doc_id, bands, packed) that have links."""
    rows = classes.select("key", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("hub")).where("n > 1")
    met = write_and_reread(rows.join(sizes, "band"), "bands")
    # Pairs of small buckets, and of each class with the smallest hub of its larger ones.
    small = met.where(F.col("n") <= SMALL_BUCKET).groupBy("band").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # SMALL_BUCKET keys at most
    pairs = small.select(F.explode(F.expr("flatten(transform(sequence(1, size(keys) - 1), i -> transform(slice(keys, i + 1, size(keys)), y -> named_struct('a', keys[i - 1], 'b', y))))")).alias("p")).select("p.a", "p.b")
    stars = met.where(F.col("n") > SMALL_BUCKET).groupBy(F.col("key").alias("b")).agg(F.min("hub").alias("a"))
    hubs = stars.groupBy("a").agg(F.array(F.first("a"), *[F.min_by("b", F.xxhash64("b", F.lit(i))) for i in range(1, HUBS)]).alias("hubs"))
    stars = stars.join(hubs, "a").select("b", F.explode("hubs").alias("a")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    packed = classes.select("key", "packed")
    pairs = pairs.unionByName(stars).distinct()
    pairs = pairs.join(packed.select(F.col("key").alias("a"), F.col("packed").alias("packed_a")), "a").join(packed.select(F.col("key").alias("b"), F.col("packed").alias("packed_b")), "b")
    pairs = write_and_reread(pairs.where(estimate(F.col("packed_a"), F.col("packed_b")) >= least_estimate(percent)).select("a", "b"), "pairs")
    needed = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = _full_sets(docs, classes, needed, size)
    with_sets = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    labels = connected_components(with_sets.mapInArrow(_confirm_pairs(percent), "a binary, b binary"))
    # Larger buckets with several labels; of those that hold the same classes, one.
    named = met.where(F.col("n") > SMALL_BUCKET).select("band", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("label"))
    named = write_and_reread(named, "labelled")
    mixed = named.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("last"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")).where("least <> last")
    mixed = mixed.groupBy("x", "y").agg(F.min("band").alias("band")).select("band")
    mixed = write_and_reread(mixed, "mixed")
    if mixed.isEmpty():
        return labels
    tiles = _tiles(named.join(mixed, "band", "left_semi").withColumnRenamed("band", "grp"), SIGNATURE_TILE)
    near = write_and_reread(tiles.join(packed, "key").groupBy("grp", "i", "j").applyInArrow(_estimate_tile(percent), "a binary, b binary").distinct(), "near")
    if near.isEmpty():
        return labels
    trees = connected_components(near)
    more = trees.select(F.col("node").alias("key")).join(sets.select("key"), "key", "left_anti")
    sets = sets.unionByName(_full_sets(docs, classes, more, size))
    members = trees.select(F.col("node").alias("key"), F.col("component").alias("grp")).join(labels.withColumnRenamed("node", "key"), "key", "left").select("grp", "key", F.coalesce("component", "key").alias("label"))
    links = _tiles(members, TILE).join(sets, "key").groupBy("grp", "i", "j").applyInArrow(_confirm_tile(percent), "a binary, b binary")
    # Links between labels join their components.
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"label_{side}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()
    above = connected_components(joined).withColumnRenamed("node", "label").withColumnRenamed("component", "top")
    alone = above.select(F.col("label").alias("node"), F.col("label").alias("component")).join(labels, "node", "left_anti")
    return labels.unionByName(alone).withColumnRenamed("component", "label").join(above, "label", "left").select("node", F.coalesce("top", "label").alias("component"))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """Group documents whose sets of `size`-word shingles have a similarity of at least percent / 100, directly or through others.

    Returns for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept (doc_id = component_id). Texts that are
    null or without words have empty sets and stand alone. Rows that repeat an id are rows of their own; the group's smallest id keeps all its rows. A row without an id has
    the group of an equal set that has one, and is never kept; component_id is null if there is none. An empty table gives an empty result; columns
    other than doc_id and text are ignored, but for those that `carry` names, which the result has too.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    schema = ", ".join([SIGNATURE, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    signed = write_and_reread(rows.mapInArrow(_signatures(size, carry), schema), "signatures")
    first = signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("bands", "packed"), "doc_id").alias("s"))
    classes = write_and_reread(first.select("key", "doc_id", "s.bands", "s.packed"), "classes")
    found = _components(rows, classes, size, percent)
    named = classes.join(found, classes.key == found.node, "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "component").select(F.col("key").alias("at"), "component_id")
    out = signed.select("doc_id", "n_shingles", "key", *carry).join(of_class, F.col("key") == F.col("at"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), *carry)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)
