"""Change logs and feeds against plain Python; orders over whole tables against small partitions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quernlake.operators import changes, ordered, rows, tables
from quernlake.sources import scratch
from quernlake.streaming import events as ev


def plain_log(table, messages, done, frontier):
    """What a store does with the messages one by one: key 'k', columns 'v' and 'u'."""
    state = {k: dict(v=v, u=u) for k, v, u in table}
    for m in sorted(messages, key=lambda m: m["seq"]):
        if not m["move_in"] and not done < m["lsn"] <= frontier:
            continue
        new = {c: m[c] for c in m["present"] if c != "k"}
        if m["op"] == "insert" and m["move_in"] and m["k"] in state:
            state[m["k"]].update(new)
        elif m["op"] == "insert":
            state[m["k"]] = {"v": None, "u": None, **new}
        elif m["op"] == "update" and m["k"] in state:
            state[m["k"]].update(new)
        elif m["op"] == "delete":
            state.pop(m["k"], None)
    return sorted(((k, r["v"], r["u"]) for k, r in state.items()), key=str)


def test_log_is_applied_like_one_by_one(spark):
    rnd = random.Random(3)
    for trial in range(3):
        table = [(k, f"v{k}", f"u{k}") for k in range(12)]
        messages, lsn = [], 0
        for seq in range(160):
            lsn += rnd.randint(0, 2)
            op, move_in = rnd.choice([("insert", False), ("insert", True), ("update", False), ("update", False), ("update", False), ("delete", False)])
            present = ["k", *rnd.sample(["v", "u"], rnd.randint(0, 2))] if op == "update" else ["k", "v", "u"] if op == "insert" else ["k"]
            k = rnd.randrange(20)
            messages.append({"seq": seq, "lsn": None if move_in else lsn, "op": op, "k": k, "v": rnd.choice([None, f"n{seq}"]) if "v" in present else None, "u": f"m{seq}" if "u" in present else None, "present": present, "move_in": move_in})
        df = spark.createDataFrame([tuple(m.values()) for m in messages], "seq long, lsn long, op string, k long, v string, u string, present array<string>, move_in boolean").repartition(3)
        start = spark.createDataFrame(table, "k long, v string, u string")
        got = changes.apply_log(start, df, ["k"], frontier=lsn - 20, done=15)
        assert sorted(map(tuple, got.collect()), key=str) == plain_log(table, messages, 15, lsn - 20), trial


def test_update_of_some_columns_keeps_the_others(spark):
    m = spark.createDataFrame([(1, 0, "insert", 1, "a", "b", ["k", "v", "u"]), (2, 0, "update", 1, None, "c", ["k", "u"]), (3, 0, "update", 2, "x", None, ["k", "v"])], "lsn long, seq long, op string, k long, v string, u string, present array<string>")
    empty = spark.createDataFrame([], "k long, v string, u string")
    assert list(map(tuple, changes.apply_log(empty, m, ["k"]).collect())) == [(1, "a", "c")]


def test_stream_completes_what_is_up_to_date(spark):
    columns = "seq long, lsn long, op string, k long, v string"
    table = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    m = [(1, 5, "insert", 3, "a"), (2, 5, changes.UP_TO_DATE, None, None), (3, 9, "insert", 4, "late")]
    got = changes.apply_stream(table, spark.createDataFrame(m, columns), ["k"])
    assert got.done == 5 and sorted(map(tuple, got.table.collect())) == [(1, "old"), (2, "old"), (3, "a")]
    again = changes.apply_stream(got.table, spark.createDataFrame(m, columns), ["k"], done=got.done)
    assert again.done == 5 and sorted(map(tuple, again.table.collect())) == sorted(map(tuple, got.table.collect()))
    m += [(4, None, changes.MUST_REFETCH, None, None), (5, 3, "insert", 7, "new"), (6, 4, changes.UP_TO_DATE, None, None)]
    got = changes.apply_stream(got.table, spark.createDataFrame(m, columns), ["k"], done=got.done)
    assert got.done == 4 and list(map(tuple, got.table.collect())) == [(7, "new")]


def test_feed_tells_order_and_is_folded_in_order(spark):
    before = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id long, n long")
    after = spark.createDataFrame([(1, 10), (3, 5), (4, 40), (5, 25)], "id long, n long")
    feed = changes.changes(before, after, "id", ["n"])
    assert [(r[changes.OP], r.id, r.n, r[changes.AFTER], r[changes.CHANGED]) for r in changes.told(feed, "id").collect()] == [
        ("INSERT", 5, 25, 1, []),
        ("DELETE", 2, None, None, []),
        ("UPDATE", 1, None, 3, [changes.AFTER]),
        ("UPDATE", 3, 5, None, ["n", changes.AFTER]),
        ("UPDATE", 4, None, 5, [changes.AFTER]),
    ]
    folded = changes.fold(changes.with_predecessor(before, "id", ["n"]), feed, "id")
    assert sorted((r.position, r.id, r.n) for r in changes.in_list_order(folded, "id").collect()) == [(1, 3, 5), (2, 1, 10), (3, 5, 25), (4, 4, 40)]
    again = changes.fold(changes.with_predecessor(before, "id", ["n"]), changes.reset(after, "id", ["n"]), "id")
    assert sorted(r.id for r in again.collect()) == [1, 3, 4, 5]
    assert [r.payload for r in changes.notifications(changes.told(feed, "id"), "t", ["id"]).collect()][:2] == ["\"t\",I,\"id\"='5'", "\"t\",D,\"id\"='2'"]


def test_live_changes(spark, tmp_path):
    """A result over committed files, told by difference; the feed starts anew when its last state is lost."""
    import shutil

    seen = []
    commit = lambda n, data: spark.createDataFrame(data, "id long, n long").write.mode("append").parquet(f"{tmp_path}/in")

    def run(until):
        stream = ev.read_stream(spark, f"{tmp_path}/in", files_per_trigger=None)
        result = lambda: spark.read.parquet(f"{tmp_path}/in").groupBy("id").agg(F.sum("n").alias("n"))
        q = ev.live_changes(stream, result, "id", f"{tmp_path}/snapshots", lambda c: seen.append(sorted(((r[changes.OP], r.id, r.n) for r in c.collect()), key=str)), f"{tmp_path}/checkpoint")
        assert q.awaitTermination(120)
        assert len(seen) == until

    commit(0, [(1, 1), (2, 2)])
    run(1)
    time.sleep(1.1)
    commit(1, [(2, 5), (3, 3)])
    run(2)
    shutil.rmtree(f"{tmp_path}/snapshots/1")
    time.sleep(1.1)
    commit(2, [(4, 4)])
    run(3)
    assert seen[0] == [("INSERT", 1, 1), ("INSERT", 2, 2)]
    assert seen[1] == [("INSERT", 3, 3), ("UPDATE", 2, 7)]
    assert seen[2] == [("INSERT", 1, 1), ("INSERT", 2, 7), ("INSERT", 3, 3), ("INSERT", 4, 4), ("RESET", None, None)]


def test_sliding_windows_and_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    for n, minutes in enumerate([[0, 10, 70], [300], [5, 310], [900]]):  # the 5th minute comes after the watermark has passed
        spark.createDataFrame([(at(m), m) for m in minutes], "ts timestamp, m long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        time.sleep(1.1)
    stream = spark.readStream.schema("ts timestamp, m long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ev.drain(ev.sliding(stream, "ts", "1 hour", "30 minutes", "10 minutes", [], F.count("*").alias("n")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {int((r.start - start).total_seconds() // 60): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {-30: 2, 0: 2, 30: 1, 60: 1, 270: 2, 300: 2}


CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_serial_keeps_every_row(spark, small_partitions, tmp_path):
    """Wide rows, small advisory sizes, no broadcasts: adaptive execution changes how partitions are read, no row is lost."""
    wide = spark.range(60_000).select(F.col("id").alias("k"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 256).alias(f"c{i}") for i in range(6)]).orderBy(F.rand(1))
    tables.with_serial(wide, "id", 100, ["k"], parts=40).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 60_000 and out.where("id <> k + 100").isEmpty()


def test_whole_table_orders(spark, small_partitions):
    rnd = random.Random(2)
    data = [(i, rnd.choice([None, *range(6)])) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v long").repartition(5)
    by = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted((r.n, r.id) for r in ordered.numbered(df, "n", ["v", "id"]).collect()) == [(n, i) for n, (i, _) in enumerate(by, 1)]
    assert {r.id: r.b for r in ordered.with_previous(df, "b", "id", ["v", "id"]).collect()} == {i: by[n - 1][0] if n else None for n, (i, _) in enumerate(by)}
    df.createOrReplaceTempView("whole_order")
    expected = {r.id: (round(r.p, 9), round(r.c, 9), r.t) for r in spark.sql("SELECT id, percent_rank() OVER (ORDER BY v) p, cume_dist() OVER (ORDER BY v) c, ntile(7) OVER (ORDER BY v, id) t FROM whole_order").collect()}
    ranks = {r.id: (round(r.percent_rank, 9), round(r.cume_dist, 9)) for r in ordered.percent_ranks(df, ["v"]).collect()}
    tiles = {r.id: r.t for r in ordered.ntile(df, "t", 7, ["v", "id"]).collect()}
    assert {i: (*ranks[i], tiles[i]) for i in ranks} == expected
    assert ordered.numbered(df.where("false"), "n", ["v"]).collect() == []
    assert {r.t for r in ordered.ntile(df.where("id < 3"), "t", 5, ["id"]).collect()} == {1, 2, 3}


def test_pages(spark):
    df = spark.range(25)
    assert [(r.id, r.total_count) for r in rows.page_with_total(df, ["id"], 10, 3).collect()] == [(10, 25), (11, 25), (12, 25)]
    assert rows.page_with_total(df, ["id"]).count() == 25
    with pytest.raises(ValueError, match="provided together"):
        rows.page_with_total(df, ["id"], offset=1)
    with pytest.raises(ValueError, match="must be numbers"):
        rows.page_with_total(df, ["id"], offset="1", limit=2)


def test_many_patterns_are_joined(spark):
    texts = spark.createDataFrame([("abc",), ("bcd",), (None,)], "t string")
    patterns = spark.createDataFrame([("bc",), ("a",), ("zz",)], "p string")
    for most in (1, 100):
        assert sorted(map(tuple, rows.match_counts(texts, "t", patterns, "p", most).collect())) == [("a", 1), ("bc", 2)]


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Elsewhere)


def test_list_order_broadcasts_no_round(spark, tmp_path):
    """However small the packed tables are, no round sends one through the driver."""
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias(changes.AFTER))
    plans, kept = [], changes.write_and_reread
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(changes, "write_and_reread", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
        got = changes.in_list_order(rows, "k")
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
    assert {r["k"]: r["position"] for r in got.collect()} == {k: k + 1 for k in range(n)}
