"""Queries over tables that are longer, or dealt over more files, than the smallest ones."""

import math
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quernlake.functions import vector
from quernlake.operators import search
from quernlake.plans import registry


def test_log_is_applied_to_its_end(spark, tmp_path):
    events = [(i, i * 7919 % 97, float(i)) for i in range(3000)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    last = {u: (i, v) for i, u, v in events}
    got = registry.QUERIES["log_apply_whole"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((u, v) for u, (i, v) in last.items() if i % 5)


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sessions", "stream_first_seen"])
def test_streams_count_all_rows_of_many_files(spark, tmp_path, name):
    rnd, start = random.Random(11), datetime(2024, 1, 1)
    times = sorted(start + timedelta(minutes=rnd.randrange(60 * 24 * 30)) for _ in range(1200))
    events = [{"event_id": i, "ts": t, "user_id": rnd.randrange(20), "event_type": rnd.choice("abc")} for i, t in enumerate(times)]
    (tmp_path / "events.parquet").mkdir()
    parts = [events[i : i + 30] for i in range(0, len(events), 30)]  # 40 files, each a part of time
    rnd.shuffle(parts)
    for n, part in enumerate(parts):
        at = tmp_path / "events.parquet" / f"part-{n:05}.parquet"
        pq.write_table(pa.Table.from_pylist(part), at)
        os.utime(at, (1_700_000_000 + 60 * n,) * 2)
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    relation = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, str(tmp_path)).select(relation.columns)
    assert Counter(map(tuple, df.collect())) == Counter(relation.fetchall())


def plain_distance(metric, a, b):
    inner = lambda x, y: sum(p * q for p, q in zip(x, y))
    return {"l2": lambda: math.dist(a, b), "l1": lambda: sum(abs(x - y) for x, y in zip(a, b)), "inner": lambda: -inner(a, b), "cosine": lambda: 1 - inner(a, b) / math.sqrt(inner(a, a) * inner(b, b))}[metric]()


@pytest.mark.parametrize("metric", ["l2", "l1", "inner", "cosine"])
@pytest.mark.parametrize("most_queries", [7, 1000])
def test_nearest_and_counts_by_brute_force(spark, metric, most_queries, monkeypatch):
    """In one block and in many; a vector that others repeat, and one that is null."""
    monkeypatch.setattr(vector, "PACK_ROWS", 16)
    rnd = random.Random(13)
    vectors = {i: [rnd.random() + 0.1, rnd.random()] for i in range(150)} | {i: [0.5, 0.5] for i in range(150, 160)}
    rows = spark.createDataFrame([*vectors.items(), (999, None)], "vec_id long, embedding array<double>").repartition(3)
    queries = rows.where("vec_id % 3 = 0")
    got = vector.nearest(rows, queries, 3, "vec_id", "embedding", metric, most_queries)
    ranked = {q: sorted(vectors, key=lambda i: (round(plain_distance(metric, vectors[q], vectors[i]), 12), i)) for q in range(0, 160, 3)}
    expected = [(q, i, r) for q, order in ranked.items() for r, i in enumerate(order[:3], 1)]
    assert sorted(map(tuple, got.select("query_id", "vec_id", "rank").collect())) == sorted(expected)
    limit = {"l2": 0.2, "l1": 0.25, "inner": -0.6, "cosine": 0.01}[metric]
    counts = {q: sum(plain_distance(metric, vectors[q], v) < limit for v in vectors.values()) for q in ranked}
    found = vector.count_within(rows, queries, limit, "vec_id", "embedding", metric, most_queries)
    assert dict(map(tuple, found.collect())) == {q: n for q, n in counts.items() if n}


def test_many_queries_are_not_broadcast(spark):
    rows = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    plan = lambda most: vector.nearest(rows, rows, 1, "vec_id", "embedding", most_queries=most)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan(100) and "BroadcastExchange" not in plan(99)


def test_index_has_rare_terms_and_tells_positions(spark, tmp_path):
    def index(texts):
        at = tmp_path / str(len(list(tmp_path.iterdir())))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
        return {r["term"]: (r["df"], r["cf"], r["digest"]) for r in registry.QUERIES["inverted_index_whole"](spark, str(at)).collect()}

    one, other = index(["a rare b b", "a"]), index(["rare a b b", "a"])
    assert {t: v[:2] for t, v in one.items()} == {"a": (2, 2), "b": (1, 2), "rare": (1, 1)}
    assert one["b"] == other["b"] and one["a"] != other["a"] and one["rare"] != other["rare"]


def test_lateral_top_is_numbered_in_order(spark, tmp_path):
    """Ties by price, prices and keys that are null, a customer twice; the numbering itself asks for the order, as a shuffle keeps none."""
    spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(7, 2, 5.0), (6, 2, 5.0), (8, 2, 5.0), (9, 1, None), (10, 1, 1.0), (None, 3, 2.0), (11, 3, 2.0), (12, 3, 2.0), (13, 9, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES["lateral_top"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.sql(registry.ORACLE_SQL["lateral_top"]).fetchall(), key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(c_custkey" in plan and "o_totalprice" in plan.split("row_number() windowspecdefinition(")[1].split("specifiedwindowframe")[0]


@pytest.mark.parametrize("words", [1, 7, 1 << 20])
def test_postings_are_made_where_rows_are_read(spark, tmp_path, words, monkeypatch):
    """Ids that several rows share, or that are null; texts that are null or empty; no word goes through a shuffle where ids are unique."""
    monkeypatch.setattr("quernlake.operators.search.GROUP_WORDS", words)
    texts = [(1, "b a b"), (1, "a c"), (2, None), (3, ""), (4, "É é a"), (None, "a b"), (None, "b"), (5, "c c c c"), (6, "a")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    relation = con.sql(registry.ORACLE_SQL["inverted_index_whole"])
    df = registry.QUERIES["inverted_index_whole"](spark, str(tmp_path)).select(relation.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(relation.fetchall(), key=str)
    unique = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").coalesce(1)
    got = search.postings(unique)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, [1]), ("b", 1, 1, [2]), ("b", 2, 1, [1])]
