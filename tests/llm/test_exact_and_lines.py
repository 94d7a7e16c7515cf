import hashlib
from collections import Counter, defaultdict

from conftest import table

from quernlake.llm import exact_dedup, line_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_exact_dedup(spark, edge_texts):
    texts = edge_texts + ["Copy"] * 50 + ["copy"] * 30
    docs = table(spark, texts)
    expected = brute_exact(list(enumerate(texts)))
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, keep="max").collect())) == expected
    # eight bits of digest make different texts collide: the bytes still tell them apart
    many = table(spark, texts + [str(i % 400) for i in range(900)])
    full = sorted(map(tuple, exact_dedup.exact_dedup(many, keep="min").collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(many, keep="min", digest_bits=8).collect())) == full


def test_exact_dedup_without_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (3, "A"), (3, "a")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (None, None, 1, False), (3, 3, 3, True), (3, 3, 3, True)], key=str)
    assert exact_dedup.exact_dedup(docs.where("false")).collect() == []


def test_exact_dedup_sends_no_text_without_copies(spark, words):
    """No byte verification where no digest has two rows; of a few copies, only theirs and what the filter takes for them."""
    texts = [f"{w} {i}" for i, w in enumerate(words)]
    alone = exact_dedup.exact_dedup(table(spark, texts))
    assert "norm" not in alone._jdf.queryExecution().toString()
    assert {(r.keep_id == r.doc_id, r.group_size) for r in alone.collect()} == {(True, 1)}
    rows = table(spark, [*texts, "twice", "TWICE"]).select("doc_id", exact_dedup.ascii_lower(exact_dedup.F.col("text")).alias("norm"))
    digest, rest = exact_dedup.digest_of(exact_dedup.F.col("norm"))
    rows = rows.select("*", digest.alias("digest"), rest.alias("rest"))
    index = exact_dedup.DigestIndex(spark)
    index.flush(rows)
    hits = index.entries().where("rows > 1")
    assert hits.count() == 1
    assert 2 <= rows.where(exact_dedup.holds(exact_dedup.filter_of(hits, 1 << 12), exact_dedup.F.col("digest"), 1 << 12)).count() <= 6


def test_digest_index_merges_runs_and_levels(spark):
    index = exact_dedup.DigestIndex(spark, keep="max")
    batch = lambda rows: spark.createDataFrame([(bytes([d]) * 32, b"", i) for d, i in rows], index.RUN)
    index.flush(batch([(1, 5), (2, 6), (1, 9)]))
    assert sorted((r.digest[0], r.keep_id, r.rows) for r in index.entries().collect()) == [(1, 9, 2), (2, 6, 1)]
    index.flush(batch([(1, 7)]))
    index.flush(batch([(3, None), (2, 8)]))
    assert sorted((r.digest[0], r.keep_id, r.rows) for r in index.entries().collect()) == [(1, 9, 3), (2, 8, 2), (3, None, 1)]
    assert [(r.digest[0], r.rows) for r in index.find([bytes([2]) * 32, bytes([9]) * 32]).collect()] == [(2, 2)]
    assert index.runs().count() == 6


def brute_lines(rows, least, docs):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
        return k if len(k) >= least else None

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                held[key(line)].add(i)
    dead = {k: max(ids) for k, ids in held.items() if len(ids) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) in dead and dead[key(x)] != i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out)


def test_line_dedup(spark, edge_texts, words):
    long = [" ".join(words[i : i + 12]) for i in range(0, 200, 12)]
    texts = edge_texts + ["\n".join([long[i % 5], f"own {i}", "  " + long[(i * 7) % 13].upper() + "\t", long[i % 5]]) for i in range(40)] + ["é" * 40] * 6 + ["é" * 39] * 6
    expected = brute_lines(list(enumerate(texts)), 40, 5)
    docs = table(spark, texts)
    for bits in (None, 64):  # a filter that is too small suspects every line, no more
        assert sorted(map(tuple, line_dedup.line_dedup(docs, bits=bits).collect())) == expected
    assert Counter(r[3] > 0 for r in expected)[True] > 10
    assert line_dedup.line_dedup(docs.where("false")).collect() == []


def test_line_dedup_without_ids(spark):
    line = "x" * 50
    docs = spark.createDataFrame([(None, line), (None, line + "\nb"), (1, line), (2, line), (3, line), (4, line), (5, line)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(docs).collect()), key=str)
    assert got == sorted([(None, line), (None, line + "\nb"), (1, ""), (2, ""), (3, ""), (4, ""), (5, line)], key=str)


def test_line_dedup_counts_repeated_ids_once(spark):
    line, other = "x" * 50, "y" * 50
    rows = [(1, line), (1, line), (1, "a\n" + line), (2, line), (2, line), *[(i, f"{i}\n{other}") for i in range(3, 8)], (7, other), (3, other + "\nz")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # two documents hold the first line, five the second: of these the last keeps it, in both of its rows
    assert got == sorted([(1, line), (1, line), (1, "a\n" + line), (2, line), (2, line), (3, "3"), (4, "4"), (5, "5"), (6, "6"), (7, "7\n" + other), (7, other), (3, "z")])
