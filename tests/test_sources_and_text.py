"""Sources, SQL helpers, text functions, the queue and orders of values that no registered query covers."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quernlake.functions import arrays, crypto, dates, geo, pairs, strings, text, vector
from quernlake.operators import queue, rows, search, tables
from quernlake.sources import files, sql


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_catalog_and_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, name string").createOrReplaceTempView("listed_view")
    assert {(r.column_name, r.data_type) for r in files.catalog_columns(spark).where("table_name = 'listed_view'").collect()} == {("id", "bigint"), ("name", "string")}
    (tmp_path / "blob").write_bytes(b"\0\1\2")
    got = files.binary_files(spark, str(tmp_path)).select("length", "content").first()
    assert (got.length, bytes(got.content)) == (3, b"\0\1\2")


def test_statements(spark, tmp_path):
    t = spark.createDataFrame([(1, "it's"), (2, "b")], "id long, name string")
    assert [r.id for r in sql.query(spark, "SELECT id FROM {t} WHERE name = ?", ["it's"], t=t).collect()] == [1]
    assert [tuple(r) for r in sql.describe(spark, "SELECT id, name || '!' AS n, 1 AS k FROM {t}", t=t).collect()] == [("id", "bigint", True), ("n", "string", True), ("k", "int", False)]
    assert sql.identifier("a.we`ird name") == "`a`.`we``ird name`"
    text_ = sql.formatted("SELECT $1 AS a, $2 AS b, $10 AS c, $3 AS d", "it's", 2, None, 4, 5, 6, 7, 8, 9, True)
    assert tuple(spark.sql(text_).first()) == ("it's", 2, True, None)
    with pytest.raises(PySparkException):
        sql.run(spark, ["SELECT 1", "SELEC 2", "SELECT 3"])
    t.write.parquet(f"{tmp_path}/base")
    spark.read.parquet(f"{tmp_path}/base").createOrReplaceTempView("lower_view")
    spark.sql("SELECT id FROM lower_view WHERE id > 1").createOrReplaceTempView("upper_view")
    assert [os.path.basename(p) for p in sql.reads(spark.sql("SELECT count(*) FROM upper_view"))] == ["base"]


def test_text_by_language(spark):
    lit = F.lit
    assert one(spark, strings.upper(lit("hij")), strings.lower(lit("HIJ")), strings.initcap(lit("hELLO wORLD"))) == ("HIJ", "hij", "Hello World")
    assert one(spark, strings.lower(lit("I"), "tr"), strings.upper(lit("i"), "tr"), strings.initcap(lit("ıspanak istanbul"), "tr")) == ("ı", "İ", "Ispanak İstanbul")
    assert one(spark, strings.ilike(lit("TITLE"), "%i%"), strings.ilike(lit("TITLE"), "%i%", "tr"), strings.ilike(lit("TİTLE"), "%i%", "tr")) == (True, False, True)


def test_formatting_and_quoting(spark):
    lit, null = F.lit, F.lit(None).cast("string")
    assert one(spark, strings.format_text("%s %I %L %% %1$L", lit("it's"), lit("Na\"me"), null)) == ("it's \"Na\"\"me\" NULL % 'it''s'",)
    assert one(spark, strings.quote_ident(lit("plain_1")), strings.quote_ident(lit("1st")), strings.quote_literal(lit(5)), strings.format_text("a%sb", null)) == ("plain_1", '"1st"', "'5'", "ab")


def test_dictionaries_and_labels(spark):
    terms = F.array(*map(F.lit, ["abc", "40865854", "12"]))
    assert one(spark, strings.short_numbers(terms, 6), strings.short_numbers(terms, 6, reject=True)) == (["abc", "408658", "12"], ["abc", "12"])
    assert one(spark, strings.synonyms(terms, {"abc": ["x", "y"]}), strings.synonyms(terms, {"abc": ["x"]}, keep=False)) == (["abc", "x", "y", "40865854", "12"], ["x", "40865854", "12"])
    assert one(spark, strings.headline(F.lit("A cat, CATs and a Cat."), ["cat"])) == ("A <b>cat</b>, CATs and a <b>Cat</b>.",)
    moods = ["sad", "ok", "happy"]
    df = spark.createDataFrame([("happy",), ("sad",), (None,)], "m string")
    assert [r.m for r in df.orderBy(strings.enum_position(F.col("m"), moods).asc_nulls_last()).collect()] == ["sad", "happy", None]
    with pytest.raises(PySparkException, match="no such label"):
        spark.createDataFrame([("odd",)], "m string").select(strings.enum_position(F.col("m"), moods)).collect()


def test_codes_and_ciphers(spark):
    import hashlib
    import hmac

    for digest in crypto.DIGESTS:
        for key in (b"key", b"long" * 60):
            got = one(spark, F.hex(crypto.hmac(F.lit("The quick brown fox"), key, digest)))[0]
            assert got.lower() == hmac.new(key, b"The quick brown fox", getattr(hashlib, digest)).hexdigest()
    a, b = one(spark, *[crypto.encrypt(F.lit("abc"), b"0" * 16)] * 2)
    assert a != "abc" and one(spark, crypto.decrypt(F.lit(bytes(a)), b"0" * 16)) == ("abc",)


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert tuple(one(spark, dates.age(d("2001-04-10"), d("1957-06-13")))[0]) == (43, 9, 28)
    assert one(spark, dates.overlaps(d("2001-02-16"), d("2001-12-21"), d("2001-10-30"), d("2002-10-30")), dates.overlaps(d("2001-02-16"), d("2001-02-20"), d("2001-02-20"), d("2001-03-01"))) == (True, False)


def test_similarity_and_sets(spark):
    lit = F.lit
    same, word, close = one(spark, text.similarity(lit("word"), lit("word")), text.word_similarity(lit("word"), lit("two words")), text.is_similar(lit("word"), lit("wort")))
    assert same == 1.0 and 0.5 < word < 1 and close is True
    assert one(spark, search.has_any(lit("the quick fox"), ["fox", "dog"]), search.has_any(lit(""), ["fox"]), geo.point_wkt(lit(1), lit(2))) == (True, False, "POINT(1 2)")
    v = F.array(*map(F.lit, [0.0, 2.0, 3.0]))
    assert one(spark, vector.sparse(v), vector.sparse_inner(vector.sparse(v), vector.sparse(F.array(*map(F.lit, [1.0, 0.0, 2.0]))))) == ({2: 2.0, 3: 3.0}, 6.0)
    numbers = F.array(*map(F.lit, [3, 1, 3]))
    assert one(spark, arrays.sort_distinct(numbers), arrays.without(numbers, 3)) == ([1, 3], [1])
    assert one(spark, pairs.merged(F.create_map(lit("a"), lit("1")), F.create_map(lit("a"), lit("2"), lit("b"), lit("3")))) == ({"a": "2", "b": "3"},)


def test_queue(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "msg_id long, visible_at timestamp_ntz, read_count int, message string")
    told = lambda df: sorted((r.msg_id, r.message) for r in df.collect())
    q = queue.send(empty, spark.createDataFrame([("b",), ("a",)], "message string"), now, ["message"])
    q = queue.send(q, spark.createDataFrame([("c",)], "message string"), now, ["message"])
    assert told(q) == [(1, "a"), (2, "b"), (3, "c")]
    got, q2 = queue.pop(q, now)
    assert told(got) == [(1, "a")] and told(q2) == [(2, "b"), (3, "c")]
    left, kept = queue.archive(q2, q2.where("message = 'c'").select("msg_id"))
    assert told(left) == [(2, "b")] and told(kept) == [(3, "c")]
    assert told(queue.delete(left, left.select("msg_id"))) == []


def test_rows_that_statements_return(spark):
    t = spark.createDataFrame([(1, 5), (2, None)], "id long, n long")
    assert sorted(map(tuple, tables.deleted_rows(t, F.col("n") > 1).collect())) == [(1, 5)]
    assert list(map(tuple, tables.inserted_rows(t, spark.createDataFrame([(9,)], "id long")).collect())) == [(9, None)]
    assert sorted(map(tuple, tables.affected(t.where("id = 1"), t, t.where("false")).collect())) == [(1, 1, 1), (2, 2, 3), (3, 0, 3)]
    r = rows.normal_rand(spark, 20_000, 10.0, 2.0, 7).agg(F.count("*"), F.avg("value"), F.stddev("value")).first()
    assert r[0] == 20_000 and abs(r[1] - 10) < 0.1 and abs(r[2] - 2) < 0.1
