import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import table

from quernlake.llm import graph, near_dedup, suffix_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets[i] = frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def near_texts(words):
    rnd = random.Random(3)
    texts = []
    for base, copies, edits in ((60, 90, 4), (200, 5, 3), (30, 12, 2), (12, 6, 1)):
        w = [rnd.choice(words) for _ in range(base)]
        for _ in range(copies):
            v = list(w)
            for _ in range(rnd.randint(0, edits)):
                v[rnd.randrange(base)] = rnd.choice(words)
            texts.append(" ".join(v))
    return texts + [" ".join(rnd.choice(words) for _ in range(50)) for _ in range(30)]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_dedup(spark, edge_texts, words, size, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)  # several tiles for one group
    monkeypatch.setattr(near_dedup, "SIGNATURE_TILE", 8)
    texts = edge_texts + near_texts(words)
    expected = brute_near(list(enumerate(texts)), size, percent)
    assert sorted(map(tuple, near_dedup.near_dedup(table(spark, texts), size, percent).collect())) == expected
    assert sum(not r[3] for r in expected) > 30


def test_near_dedup_without_rows_or_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "A b c d"), (None, "z z"), (2, None)], "doc_id long, text string")
    assert near_dedup.near_dedup(docs.where("false")).collect() == []
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs, 3, 85).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (None, None, False), (2, 2, True)], key=str)


def test_near_dedup_judges_rows_that_share_an_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    docs = spark.createDataFrame([(3, b, "p"), (5, a, "q"), (5, b, "r"), (5, a, "s")], "doc_id long, text string, key string")
    got = sorted((r.key, r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs.withColumnRenamed("key", "tag"), 3, 85, carry=("tag",)).withColumnRenamed("tag", "key").collect())
    assert got == [("p", 3, 3, True), ("q", 5, 5, True), ("r", 5, 3, False), ("s", 5, 5, True)]


def test_estimate_follows_the_similarity(spark):
    rnd = np.random.Generator(np.random.PCG64(1))
    pool = rnd.integers(0, 1 << 63, 3000, np.uint64)
    for share in (0.5, 0.85):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:n], pool[1000 : 2000 - n]]))
        packed = near_dedup.packed_of(near_dedup.minima([a, b])).tolist()
        from pyspark.sql import functions as F

        got = spark.createDataFrame([tuple(packed)], "a array<long>, b array<long>").select(near_dedup.estimate(F.col("a"), F.col("b")).alias("e")).first().e
        assert abs(got - share) < 0.17


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 7), (200, 201), (5, 5)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 100: 0, 200: 200, 201: 200}


def brute_repeats(rows, length):
    first = {}
    data = [((i if i is not None else 2**63 - 1), i, (t or "").encode()) for i, t in rows]
    for k, _, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < k:
                gone[p : p + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, buckets, hot", [(50, 1, 1000), (50, 3, 1000), (50, 3, 1), (50, 5, 0), (7, 2, 0), (20, 2, 1000), (40, 3, 0), (3, 1, 0)])
def test_remove_repeats(spark, edge_texts, words, length, buckets, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)  # with 0, every shared token's windows are parted
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1 << 12)
    rnd = random.Random(5)
    shared = [" ".join(rnd.choice(words) for _ in range(25)) for _ in range(4)]
    texts = edge_texts + ["ab" * 400, "ba" * 90 + "zz" + "ab" * 50] + [" ".join([rnd.choice(shared), rnd.choice(words), rnd.choice(shared)[: rnd.randint(40, 70)], *rnd.choices(words, k=10)]) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, shared[0]), (None, shared[0] + "!"), (3, shared[1]), (3, shared[1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, length, buckets=buckets).collect()), key=str) == brute_repeats(rows, length)


def test_remove_repeats_in_a_text_beyond_a_block(spark):
    """A text longer than a block is whole: what repeats at its end is found."""
    rnd = np.random.Generator(np.random.PCG64(6))
    long = bytes(rnd.integers(97, 123, suffix_dedup.BLOCK_BYTES + 100_000, dtype=np.uint8)).decode()
    docs = spark.createDataFrame([(1, long), (2, "short " + long[-80:]), (3, long[:60])], "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs, output="spans").collect()))
    assert got == [(2, 6, 86), (3, 0, 60)]


def test_remove_repeats_spans_and_empty(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "ab" + "x" * 55 + "c")], "doc_id long, text string")
    assert list(map(tuple, suffix_dedup.remove_repeats(docs, output="spans").collect())) == [(2, 2, 57)]
    assert sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, output="texts").collect()) == [(1, b"x" * 60), (2, b"abc")]
    assert suffix_dedup.remove_repeats(docs.where("false")).collect() == []


def test_runs_of_hot_tokens_are_parted_by_their_neighbours():
    rnd = random.Random(8)
    text = bytes(rnd.randrange(97, 123) for _ in range(3000))
    block = suffix_dedup.Block(np.array([1], np.int64).tobytes(), np.array([len(text)], np.int64).tobytes(), suffix_dedup.pa.compress(text, "zstd", asbytes=True), 50)
    windows = {w for a, b in zip(block.first, block.last) for w in range(a, b + 1)}
    tokens = np.unique(block.token)
    block.shared_runs(tokens, tokens[::2], 50)
    assert {w for a, b in zip(block.first, block.last) for w in range(a, b + 1)} == windows == set(range(2951))
    assert (block.last >= block.first).all() and (block.apart > 0).any() and (block.apart == 0).any()


def test_buckets_are_in_the_order_of_leading_bytes():
    buf = np.frombuffer(b"banana bandana cabana abacus zebra", np.uint8)
    at = np.array([0, 7, 15, 22, 29])
    keys = suffix_dedup.leading_keys(buf, at, suffix_dedup.token_hashes(buf, 4)[at])
    told = [buf[i : i + 4].tobytes() for i in at]
    assert [told[i] for i in np.argsort(keys)] == sorted(told)


def test_equal_runs_group_equal_rows():
    rnd = np.random.Generator(np.random.PCG64(2))
    rows = rnd.integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = suffix_dedup.equal_runs(rows, np.arange(500))
    seen = {}
    for at, g in zip(order, group):
        assert seen.setdefault(int(g), tuple(rows[at])) == tuple(rows[at])
    assert len(seen) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_dedup_finds_the_links_of_the_given_texts(spark, sf_dir, size, percent):
    """Recall of links between different texts, by brute force over all pairs: bands, estimate and tiles lose next to none."""
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, size, percent).collect()}
    texts = [(r.doc_id, near_dedup.shingle_set(r.text, size)) for r in docs.select("doc_id", "text").collect()]
    texts = [(i, s) for i, s in texts if len(s)]
    both = near_dedup.intersections([s for _, s in texts])
    n = np.diag(both)
    a, b = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    found = [got[texts[i][0]] == got[texts[j][0]] for i, j in zip(a, b)]
    assert len(found) > 50 and sum(found) >= 0.99 * len(found)


def chain(n, step, length):
    """Texts that each share (length - step) / (length + step) of their words' runs, about, with the next."""
    return [" ".join(f"w{i * step + k}" for k in range(length)) for i in range(n)]


def test_weak_ties_make_no_tiles_of_full_sets(spark, monkeypatch):
    """A long chain of candidates that are alike by a third: signatures tell them apart, no full sets meet in tiles."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 1)

    def never(percent):
        raise AssertionError("full sets met")

    monkeypatch.setattr(near_dedup, "_confirm_tile", never)
    docs = table(spark, chain(1500, 30, 62))
    assert near_dedup.near_dedup(docs, 3, 85).where("NOT kept").count() == 0


def test_copies_of_one_text_need_no_tiles(spark, monkeypatch):
    """All are linked with their hub, so no bucket has two labels."""
    monkeypatch.setattr(near_dedup, "_tiles", None)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 400, 2)]
    got = near_dedup.near_dedup(table(spark, texts), 3, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_tiles_bring_labels_together(spark):
    rnd = random.Random(11)
    rows = [(g, f"k{g}-{i}".encode(), rnd.choice([b"a"] * 30 + [f"l{i % 7}".encode(), f"m{i}".encode()])) for g, n in ((1, 150), (2, 9), (3, 1)) for i in range(n)]
    members = spark.createDataFrame(rows, "grp long, key binary, label binary")
    met, largest = set(), 0
    tiles = defaultdict(list)
    for r in near_dedup._tiles(members, 16).collect():
        tiles[r.grp, r.i, r.j].append((bytes(r.key), bytes(r.label)))
    for (g, *_), inside in tiles.items():
        largest = max(largest, len(inside))
        met |= {(g, a, b) for a, la in inside for b, lb in inside if la != lb}
    assert met == {(g, a, b) for g, a, la in rows for h, b, lb in rows if g == h and la != lb}
    assert largest <= 60 and all(len({label for _, label in inside}) > 1 for inside in tiles.values())
