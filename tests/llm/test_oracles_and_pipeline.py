"""The registered SQL of the training-data operators on the smallest tables, and the pipeline's decisions on a small one."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quernlake.llm import mixing, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    relation = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(relation.columns)
    assert Counter(plain(tuple(r)) for r in df.select(relation.columns).collect()) == Counter(plain(r) for r in relation.fetchall())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, words):
    """Documents with a near copy, a contaminated one, ones without a letter, an empty and a null one, and ones without an id."""
    at = tmp_path_factory.mktemp("corpus")
    texts = [" ".join(words[(i * 37 + k * (i + 3)) % 400] for k in range(60)) for i in range(20)]
    item = " ".join(words[(5 * k * k + 11) % 400] for k in range(20))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0] + " end"), (101, f"{texts[1][:40]} {item}"), (102, "123 456"), (103, ""), (104, None), (None, texts[2]), (None, "789")]
    spark.createDataFrame([(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def shingles(text):
    w = re.findall(r"\S+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = rows_of(docs)
    # language: texts without a letter go, with an id or without
    told = corpus_pipeline.identify_language(spark, docs, folder)
    assert told.columns == docs.columns
    assert rows_of(told) == Counter({r: n for r, n in everything.items() if re.search("[a-z]", r[1] or "")})
    # near copies: by plain pairs, the smallest id stays, and rows without an id stay
    texts = [(r[0], shingles(r[1])) for r in rows_of(told) if r[0] is not None]
    gone = {j for i, a in texts for j, b in texts if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert gone == {100}
    near = corpus_pipeline.drop_near_duplicates(spark, told, folder)
    assert near.columns == docs.columns
    assert rows_of(near) == Counter({r: n for r, n in rows_of(told).items() if r[0] not in gone})
    # contamination: the one that holds the item goes
    clean = corpus_pipeline.drop_contaminated(spark, near, folder)
    assert clean.columns == docs.columns
    assert rows_of(clean) == Counter({r: n for r, n in rows_of(near).items() if r[0] != 101})
    # the mix: each row as often as its copies say
    mixed = corpus_pipeline.mix_sources(spark, clean, folder)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in mixing.mix(clean, carry=True).collect():
        copies[tuple(r["row"])] += r["copies"]
    assert rows_of(mixed) == +copies
    # tokens: one row for each document
    tokens = corpus_pipeline.write_tokens(spark, mixed, folder)
    assert Counter(r["doc_id"] for r in tokens.collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())
    got = key(corpus_pipeline.run(spark, folder))
    assert got and got == key(docs)


def test_stages_judge_rows_that_share_an_id(spark, folder, words):
    """Of two texts under one id one may go and the other stay; columns with the stages' own names are theirs to keep."""
    a, b = (" ".join(words[i : i + 40]) for i in (100, 200))
    item = " ".join(words[(5 * k * k + 11) % 400] for k in range(20))
    rows = [(3, b), (5, a), (5, b), (7, a), (7, item), (8, "x y z"), (8, "x y z"), (9, None)]
    columns = "doc_id long, text string, lang string, source string, row_key string, lang_found string, kept string, row string"
    docs = spark.createDataFrame([(i, t, None, "s", "k", "l", "m", "r") for i, t in rows], columns).repartition(3)
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert near.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter([(3, b), (5, a), (7, item), (8, "x y z"), (8, "x y z"), (9, None)])
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r[1] != item)
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and set(pairs(mixed.where("text IS NOT NULL"))) <= {r for r in rows if r[1]}
    told = corpus_pipeline.identify_language(spark, docs.fillna("en", ["lang"]), folder)
    assert told.columns == docs.columns and Counter((r.doc_id, r.text) for r in told.collect()) == Counter(r for r in rows if r[1])
