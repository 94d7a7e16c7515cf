import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import table
from hypothesis import given, settings
from hypothesis import strategies as st

from quernlake.llm import decontam, mixing, token_output

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, window):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    wins = {}
    for item, t in items:
        w = split(t)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in wins:
                    hit |= set(range(s, s + size))
                    found |= wins[tuple(w[s : s + size])]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontaminate(spark, edge_texts, words):
    items = [" ".join(words[i : i + n]) for i, n in ((0, 30), (40, 13), (60, 12), (80, 5), (90, 1), (5, 20))] + [None, "", "...", " ".join(words[60:72])]
    texts = edge_texts + [" ".join(words[a:b]).upper() for a, b in ((0, 13), (1, 12), (10, 45), (40, 53), (40, 52), (58, 75), (80, 85), (90, 91), (0, 400))] + ["-".join(words[0:30]), " ".join(words[0:40] * 30)]
    got = decontam.decontaminate(table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_contamination(list(enumerate(texts)), list(enumerate(items)), 13)


def test_decontaminate_by_row(spark, words):
    """Rows of one id and length are judged each; windows of an item without an id count; further columns are carried."""
    rows = [(1, " ".join(words[:13])), (1, " ".join(words[20:33])), (1, " ".join(words[:13])), (None, " ".join(words[:12])), (None, " ".join(words[40:60]))]
    docs = spark.createDataFrame([(i, t, f"tag {n}", "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, key string, n_words string").repartition(2)
    items = spark.createDataFrame([(None, " ".join(words[:13])), (4, " ".join(words[45:58]))], "item_id long, text string")
    got = sorted((r.tag, r.doc_id, r.n_hit, r.item_ids, r.contaminated) for r in decontam.decontaminate(docs.withColumnRenamed("key", "tag"), items, carry=("tag",)).collect())
    assert got == [("tag 0", 1, 13, [], True), ("tag 1", 1, 0, [], False), ("tag 2", 1, 13, [], True), ("tag 3", None, 0, [], False), ("tag 4", None, 13, ["4"], True)]


def test_decontaminate_empty_tables(spark):
    docs, none = table(spark, ["a b c", None]), spark.createDataFrame([], "item_id long, text string")
    assert sorted(tuple(r)[1:] for r in decontam.decontaminate(docs, none).collect()) == [(0, 0, [], False), (3, 0, [], False)]
    assert decontam.decontaminate(docs.where("false"), none).collect() == []


def test_winnowing_guarantee():
    rnd = np.random.Generator(np.random.PCG64(4))
    shared = rnd.integers(0, 1 << 62, 13).astype(np.uint64)
    for _ in range(50):
        prints = []
        for _ in range(2):
            w = np.concatenate([rnd.integers(0, 1 << 62, rnd.integers(0, 20)).astype(np.uint64), shared, rnd.integers(0, 1 << 62, rnd.integers(0, 20)).astype(np.uint64)])
            grams = decontam.ngram_hashes(w, 5)
            prints.append(set(grams[decontam.winnow(grams, 9)].tolist()))
        assert prints[0] & prints[1]


def test_mix_meets_targets(spark, words):
    rows = [(i, " ".join(words[: 1 + i * 7 % 90]), src, "x") for i, src in enumerate(["big"] * 500 + ["small"] * 60 + ["tiny"] * 20 + [None] * 80)]
    docs = spark.createDataFrame([*rows, (9999, None, "big", "x"), (None, "a", "big", "x")], "doc_id long, text string, source string, lang string").repartition(4)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert len(got) == len(rows) + 2
    sources = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        sources.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    total = sum(s[0] for s in sources.values())
    assert sum(s[1] for s in sources.values()) == pytest.approx(total)
    for size, target, taken in sources.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 0.03 * target + 100
    assert sources[None][1] == 3 * sources[None][0]  # the others share what this one cannot take
    assert sources["big"][1] / 5 == pytest.approx(sources["small"][1] / 2)
    assert mixing.mix(docs.where("false")).collect() == []
    carried = mixing.mix(docs, carry=True).select("row.*", "copies").collect()
    assert sorted((r.doc_id or -1, r.copies) for r in carried) == sorted((r.doc_id or -1, r.copies) for r in got)


def test_mix_of_columns_with_its_own_names_and_of_many_sources(spark, words, monkeypatch):
    rows = [(i, " ".join(words[: 1 + i % 9]), f"s{i % 4}" if i % 5 else None, "mine", i, "r", 1.5) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, size long, range string, target double").repartition(3)
    got = mixing.mix(docs, carry=True).collect()
    assert {tuple(r["row"]) for r in got} == set(rows) and sum(r["copies"] for r in got) > 0
    monkeypatch.setattr(mixing, "MOST_SOURCES_BROADCAST", 1)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == sorted((r.doc_id, r.taken) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 60_000), st.just(0)), max_size=1500))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words = token_output.simple8b_encode(ids)
    assert (token_output.simple8b_decode(words, len(ids)) == ids).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'.,aéZ1<|> "), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_text_encoder_is_the_library(texts):
    ours, theirs = _encoders()
    ids, counts = ours.encode(pa.array(texts, pa.string()))
    expected = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))


@functools.cache
def _encoders():
    from tokenizers import Tokenizer

    path = token_output.default_tokenizer()
    with open(path, encoding="utf-8") as f:
        return token_output.TextEncoder(f.read()), Tokenizer.from_file(path)


def test_text_encoder_on_the_given_texts(sf_dir):
    ours, theirs = _encoders()
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").combine_chunks().fill_null("")
    ids, counts = ours.encode(texts)
    expected = [theirs.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))


def test_token_output(spark, edge_texts):
    from tokenizers import Tokenizer

    path = token_output.default_tokenizer()
    library = Tokenizer.from_file(path)
    texts = edge_texts + ["the end."] * 40
    rows = [(500 - i, t) for i, t in enumerate(texts)] + [(None, "no id"), (500, "again")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(5)
    start, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_output(docs, path).collect()), key=lambda r: r[1]) == expected
    assert token_output.token_output(docs.where("false"), path).collect() == []
