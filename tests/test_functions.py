"""Known values of the function families, and row operators on small tables."""

import pytest
from pyspark.sql import functions as F

from quernlake.functions import arrays, geo, ids, pairs, paths, ranges, text, vector
from quernlake.operators import changes, queue, rows, search, tables, views
from quernlake.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def known_values():
    return [
        (F.levenshtein(F.lit("kitten"), F.lit("sitting")), 3),
        (F.soundex(F.lit("kitten")), "K350"),
        (text.unaccent(F.lit("Hôtel")), "Hotel"),
        (geo.cube_distance(F.array(*map(F.lit, (4.0, 5.0, 6.0))), F.array(*map(F.lit, (1.0, 2.0, 3.0)))), 5.196152422706632),
        (vector.l2_distance(F.array(*map(F.lit, (3, 1, 2))), F.array(*map(F.lit, (1, 2, 3)))), 2.449489742783178),
        (vector.hamming_distance(F.array(*map(F.lit, (1, 0, 1))), F.array(*map(F.lit, (1, 1, 0)))), 2),
        (vector.jaccard_distance(F.array(*map(F.lit, (1, 0, 1))), F.array(*map(F.lit, (1, 1, 0)))), 1 - 1 / 3),
        (ids.uuid5(F.lit("python.org")), "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
        (ids.uuid3(F.lit("python.org")), "6fa459ea-ee8a-3ca4-894e-db77e160355e"),
        (F.unix_millis(ids.uuid7_time(F.lit("018570bb-4a7d-7c7e-8df4-6d47afd8c8fc"))), 1672633600637),
        (ids.isbn13(F.lit("0393040029")), "9780393040029"),
        (ids.issn_check(F.lit("1436452")), "2"),
        (paths.common_ancestor(F.lit("a.b.c.d"), F.lit("a.b.x")), "a.b"),
        (ranges.interval(F.lit("7(+-)1"))["hi"], 8.0),
        (ranges.interval(F.lit("6.25 .. 6.50"))["lo"], 6.25),
        (pairs.parse(F.lit('"a"=>"1", "b"=>NULL'))["a"], "1"),
        (arrays.matches(F.array(F.lit(1), F.lit(4)), ("and", 1, ("or", 3, 4))), True),
        (search.has_phrase(F.lit("a quick brown fox"), ["quick", "brown"]), True),
        (search.has_phrase(F.lit(""), ["quick", "brown"]), False),
    ]


def test_known_values(spark):
    values = known_values()
    got = spark.range(1).select(*[c.alias(f"v{i}") for i, (c, _) in enumerate(values)]).first()
    for g, (_, value) in zip(got, values, strict=True):
        assert g == (pytest.approx(value) if isinstance(value, float) else value)


def test_trigram_distance(spark):
    assert one(spark, text.trigram_distance(F.lit("word"), F.lit("words"))) == pytest.approx(1 - 4 / 7)
    assert one(spark, text.similarity(F.lit(""), F.lit("a"))) == 0.0


def test_polygon(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0, 0.0)))
    assert one(spark, geo.polygon_area(xs, ys)) == 12.0
    assert one(spark, geo.within_polygon(F.lit(1.0), F.lit(1.0), xs, ys)) is True
    assert one(spark, geo.within_polygon(F.lit(5.0), F.lit(1.0), xs, ys)) is False


def test_nearest_of_one_query(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, v array<double>")
    got = vector.nearest(v, v.where("id = 0"), 2, "id", "v").collect()
    assert sorted((r.id, r["rank"]) for r in got) == [(0, 1), (1, 2)]


def test_change_feed_in_steps(spark):
    schema = "id long, number long"
    before = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], schema)
    after = spark.createDataFrame([(1, 10), (3, 15), (5, 50), (4, 4)], schema)
    d = {(r[changes.OP], r.id): (r.number, r[changes.CHANGED]) for r in changes.changes(before, after, "id").collect()}
    assert d == {("DELETE", 2): (None, []), ("UPDATE", 3): (15, ["number"]), ("INSERT", 5): (50, []), ("UPDATE", 4): (4, ["number"])}
    assert sorted(map(tuple, changes.fold(before, changes.changes(before, after, "id"), "id").collect())) == sorted(map(tuple, after.collect()))
    assert changes.changes(after, after, "id").isEmpty()


def test_log_apply_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a")], "k long, v string")
    log = spark.createDataFrame([(1, 0, "update", 1, "b"), (2, 0, "delete", 1, None), (3, 0, "insert", 1, "c"), (3, 1, "insert", 2, "d"), (9, 0, "delete", 2, None)], "lsn long, seq long, op string, k long, v string")
    once = changes.apply_log(table, log, ["k"], frontier=3)
    assert sorted(map(tuple, once.collect())) == [(1, "c"), (2, "d")]
    assert sorted(map(tuple, changes.apply_log(once, log, ["k"], frontier=3, done=3).collect())) == [(1, "c"), (2, "d")]


def test_views_equal_recomputation(spark):
    base = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").alias("x"))
    removed, added = base.where("x % 3 = 0"), base.where("x % 5 = 0")
    total = {"total": F.col("x")}
    kept = views.refresh(views.partials(base, ["g"], total), views.partials(views.signed(added, removed), ["g"], total, F.col("weight")), ["g"], ["total"])
    again = views.partials(base.where("x % 3 <> 0").unionByName(added), ["g"], total)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.collect()))


def test_queue_hides_what_is_read(spark):
    q = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "msg_id long, read_count int").withColumn("visible_at", F.timestamp_seconds(F.lit(0)))
    got, after = queue.read(q, F.timestamp_seconds(F.lit(10)), 30, 2)
    assert sorted(r.msg_id for r in got.collect()) == [1, 2]
    assert [r.msg_id for r in queue.readable(after, F.timestamp_seconds(F.lit(11)), 5).collect()] == [3]
    assert len(queue.readable(after, F.timestamp_seconds(F.lit(41)), 5).collect()) == 3


def test_crosstab_fills_by_position(spark):
    d = spark.createDataFrame([("r1", "b", 2), ("r1", "a", 1), ("r2", "c", 3)], "row string, cat string, v int")
    assert sorted(map(tuple, rows.crosstab(d, "row", "cat", "v", ["x", "y"]).collect())) == [("r1", 1, 2), ("r2", 3, None)]


def test_distinct_on_and_unique(spark):
    d = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "k int, v int")
    assert sorted(map(tuple, rows.distinct_on(d, ["k"], rows.nulls_last("v")).collect())) == [(1, 5), (2, 7)]
    assert [r.k for r in tables.check_unique(d, ["k"]).collect()] == [1]


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "test"), (2, None), (3, 'a,"b"')], "id int, test string")
    files.copy_to_csv(d, str(tmp_path / "copy"))
    assert sorted(map(tuple, files.copy_from_csv(spark, str(tmp_path / "copy"), "id int, test string").collect())) == sorted(map(tuple, d.collect()))
    (tmp_path / "lines.txt").write_text("a\nb\n")
    assert [r.line for r in files.text_table(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b"]


def test_json_recordset_keeps_large_integers(spark):
    d = spark.createDataFrame([('[{"id": 9007199254740993}]',)], "j string")
    assert d.select(F.inline(files.json_recordset(F.col("j"), "id bigint"))).first().id == 9007199254740993


def test_hashids(spark):
    from quernlake.functions import hashids

    salt = "This is my salt"
    assert [hashids.Hashids().encode(1001), hashids.Hashids(salt).encode(1234567), hashids.Hashids(salt, 10).encode(1234567)] == ["jNl", "Pdzxp", "PlRPdzxpR7"]
    assert hashids.Hashids(salt, 10, "abcdefghijABCDxFGHIJ1234567890").encode(1234567) == "3GJ956J9B9"
    for ids in (hashids.Hashids(), hashids.Hashids(salt, 8)):
        assert all(ids.decode(ids.encode(*v)) == list(v) for v in ((0,), (7, 8, 9), (2**53,)))
    d = spark.createDataFrame([(5,), (None,), (123456,)], "n long")
    got = d.select("n", hashids.encode(F.col("n"), salt).alias("h")).select("n", hashids.decode(F.col("h"), salt).alias("m")).collect()
    assert all(r.n == r.m for r in got)
