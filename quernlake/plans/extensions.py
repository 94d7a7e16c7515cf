"""Queries of the function families and DataFrame operators, each over the given tables, with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, geo, ids, pairs, paths, ranges, text, vector
from ..operators import changes, graphs, ordered, queue, rows, search, tables, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (read, spark), read being a function of a table's name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"WITH t AS (SELECT p_partkey, {_TRIGRAMS.format('p_name')} AS a, {_TRIGRAMS.format("'green lace'")} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS s FROM t WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.1")
def trigram_search(read):
    s = text.similarity(F.col("p_name"), F.lit("green lace"))
    return read("part").select("p_partkey", s.alias("s")).where("s >= 0.1").withColumn("s", F.round("s", 9))


@query("SELECT n_nationkey, levenshtein(n_name, 'NATION_15')::INTEGER AS d FROM nation")
def fuzzy_levenshtein(read):
    return read("nation").select("n_nationkey", F.levenshtein("n_name", F.lit("NATION_15")).alias("d"))


@query("SELECT lang, count(*) AS n, sum(len(text) - len(replace(strip_accents(text), 'e', '')))::BIGINT AS letters FROM documents GROUP BY lang")
def unaccent_count(read):
    plain = text.unaccent(F.col("text"))
    return read("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text") - F.length(F.replace(plain, F.lit("e"), F.lit("")))).alias("letters"))


@query("WITH a AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1) SELECT o_custkey, list_has_any(p, ['1-URGENT', '9-NONE']) AS overlap, list_has_all(p, ['1-URGENT', '2-HIGH']) AS has_both, list_has_all(['1-URGENT', '2-HIGH', '5-LOW'], p) AS inside, list_contains(p, '1-URGENT') AND (list_contains(p, '2-HIGH') OR NOT list_contains(p, '5-LOW')) AS matched FROM a")
def array_operators(read):
    a = read("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    of = lambda *v: F.array(*map(F.lit, v))
    p = F.col("p")
    matched = arrays.matches(p, ("and", "1-URGENT", ("or", "2-HIGH", ("not", "5-LOW"))))
    return a.select("o_custkey", arrays.overlaps(p, of("1-URGENT", "9-NONE")).alias("overlap"), arrays.contains(p, of("1-URGENT", "2-HIGH")).alias("has_both"), arrays.contained_by(p, of("1-URGENT", "2-HIGH", "5-LOW")).alias("inside"), matched.alias("matched"))


@query("WITH p AS (SELECT n_nationkey, 'world.' || lower(r_name) || '.' || lower(n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, len(string_split(path, '.'))::INTEGER AS n, path = 'world.asia' OR starts_with(path, 'world.asia.') AS below, array_to_string(string_split(path, '.')[2:], '.') AS rest FROM p")
def label_paths(read):
    p = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("world."), F.lower("r_name"), F.lit("."), F.lower("n_name")).alias("path"))
    path = F.col("path")
    return p.select("n_nationkey", paths.levels(path).alias("n"), paths.is_descendant(path, "world.asia").alias("below"), paths.subpath(path, 1).alias("rest"))


@query("WITH p AS (SELECT s_suppkey, [s_acctbal, s_nationkey::DOUBLE, 1.0::DOUBLE] AS v FROM supplier) SELECT s_suppkey, round(list_distance(v, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]), 6) AS d FROM p")
def point_distance(read):
    v = F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.lit(1.0))
    return read("supplier").select("s_suppkey", F.round(geo.cube_distance(v, F.array(*[F.lit(0.0)] * 3)), 6).alias("d"))


@query("WITH p AS (SELECT c_custkey, radians((c_custkey % 180 - 90)::DOUBLE) AS a, radians((c_nationkey * 14 - 170)::DOUBLE) AS b FROM customer), q AS (SELECT *, radians(48.85::DOUBLE) AS c, radians(2.35::DOUBLE) AS d FROM p) SELECT c_custkey, round(2 * asin(least(1.0, sqrt(pow(cos(a) * cos(b) - cos(c) * cos(d), 2) + pow(cos(a) * sin(b) - cos(c) * sin(d), 2) + pow(sin(a) - sin(c), 2)) / 2)) * 6378.168, 3) AS km FROM q")
def earth_distances(read):
    here = geo.earth_point((F.col("c_custkey") % 180 - 90).cast("double"), (F.col("c_nationkey") * 14 - 170).cast("double"))
    paris = geo.earth_point(F.lit(48.85), F.lit(2.35))
    return read("customer").select("c_custkey", F.round(geo.earth_distance(here, paris) / 1000, 3).alias("km"))


@query("SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AND c_nationkey > 2 AND c_nationkey < 12 AND c_acctbal < 5000 AND c_acctbal > 0 AS inside FROM customer WHERE c_nationkey NOT IN (2, 12)")
def points_in_polygon(read):
    xs, ys = (F.array(*[F.lit(float(v)) for v in vs]) for vs in ((0, 5000, 5000, 0, 0), (2, 2, 12, 12, 2)))
    inside = geo.within_polygon(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), xs, ys)
    return read("customer").where(~F.col("c_nationkey").isin(2, 12)).select("c_custkey", inside.alias("inside"))


@query("SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey * 100 - b.s_nationkey * 100, 2) <= 90000")
def spatial_join(read):
    s = read("supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100).alias("y"))
    b = s.select(F.col("s_suppkey").alias("b_key"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return geo.distance_join(s, b, 300.0, ("x", "y"), ("bx", "by")).where("s_suppkey < b_key").select(F.col("s_suppkey").alias("a_key"), "b_key")


_VEC = "embedding::DOUBLE[]"


@query(f"WITH q AS (SELECT vec_id AS query_id, {_VEC} AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, list_distance({_VEC}, q) AS distance FROM embeddings, q) SELECT query_id, vec_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10")
def knn_l2(read):
    e = read("embeddings")
    return vector.nearest(e, e.where("vec_id % 100 = 0"), 10, "vec_id", "embedding", "l2").select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH q AS (SELECT vec_id AS query_id, {_VEC} AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, list_cosine_distance({_VEC}, q) AS distance FROM embeddings, q) SELECT query_id, count(*) AS n FROM d WHERE distance < 0.9 GROUP BY query_id")
def cosine_within(read):
    e = read("embeddings")
    return vector.count_within(e, e.where("vec_id % 100 = 0"), 0.9, "vec_id", "embedding")


@query(f"SELECT vec_id, round(list_inner_product({_VEC}, {_VEC}), 6) AS ip, round(list_sum(list_transform({_VEC}, lambda x: abs(x - 0.5))), 6) AS l1 FROM embeddings")
def vector_metrics(read):
    e = F.col("embedding")
    half = F.transform(e, lambda x: F.lit(0.5))
    return read("embeddings").select("vec_id", F.round(vector.inner_product(e, e), 6).alias("ip"), F.round(vector.l1_distance(e, half), 6).alias("l1"))


@query("SELECT label, round(avg(list_sum(embedding::DOUBLE[])), 6) AS mean FROM embeddings GROUP BY label")
def vector_centroid(read):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read("embeddings").groupBy("label").agg(F.round(F.avg(total), 6).alias("mean"))


@query("SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INTEGER & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u FROM (SELECT n_nationkey, md5(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation)")
def uuid_named(read):
    return read("nation").select("n_nationkey", ids.uuid3(F.col("n_name")).alias("u"))


@query("SELECT event_id, date_trunc('millisecond', ts)::TIMESTAMP AS t FROM events")
def uuid_time_ordered(read):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return read("events").select("event_id", ids.uuid7_time(ids.uuid7(millis, F.md5(F.col("event_id").cast("string")))).cast("timestamp_ntz").alias("t"))


@query("WITH b AS (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS s FROM part) SELECT p_partkey, s || ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(s, i, 1)::INTEGER * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::VARCHAR AS isbn, true AS ok FROM b")
def isbn_check(read):
    isbn = ids.isbn13(F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("0")))
    return read("part").select("p_partkey", isbn.alias("isbn"), ids.isbn13_valid(isbn).alias("ok"))


@query("SELECT p_partkey, p_size - 5.0::DOUBLE AS lo, p_size + 5.0::DOUBLE AS hi, p_size - 5 <= 12.5 AND 10 <= p_size + 5 AS meets FROM part")
def interval_values(read):
    r = ranges.interval(F.concat(F.col("p_size").cast("string"), F.lit("(+-)5")))
    return read("part").select("p_partkey", r["lo"].alias("lo"), r["hi"].alias("hi"), ranges.overlaps(r, ranges.interval(F.lit("10 .. 12.5"))).alias("meets"))


@query("SELECT c_custkey, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, c_nationkey IS NOT NULL AS has_nation FROM customer")
def key_value_maps(read):
    m = pairs.parse(F.concat(F.lit('"segment"=>"'), F.col("c_mktsegment"), F.lit('", "nation"=>"'), F.col("c_nationkey").cast("string"), F.lit('"')))
    return read("customer").select("c_custkey", m["segment"].alias("segment"), m["nation"].alias("nation"), pairs.has_all(m, "segment", "nation").alias("has_nation"))


@query("SELECT o_custkey, max(CASE WHEN k = 1 THEN o_orderkey END) AS first, max(CASE WHEN k = 2 THEN o_orderkey END) AS second, max(CASE WHEN k = 3 THEN o_orderkey END) AS third FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_custkey")
def crosstab(read):
    return rows.crosstab(read("orders"), "o_custkey", "o_orderkey", "o_orderkey", ["first", "second", "third"])


@query("SELECT p_partkey, sum(1) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS near FROM part")
def window_groups_frame(read):
    return rows.groups_frame(read("part"), ["p_brand"], "p_size", 1, 1, F.count("*"), "near").select("p_partkey", "near")


@query("SELECT p_partkey, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 0)::BIGINT AS others FROM part")
def window_exclude_current(read):
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-2, 2)
    return read("part").select("p_partkey", rows.sum_excluding_current("p_size", w).cast("bigint").alias("others"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (100000, 0) ORDER BY o_totalprice, o_orderkey LIMIT 50")
def keyset_page(read):
    return rows.keyset_page(read("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 50, (100000.0, 0))


# one order over a whole table
@query("SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS p, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS c FROM supplier")
def window_percent(read):
    return ordered.percent_ranks(read("supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "p", "c").select("s_suppkey", F.round("p", 9).alias("p"), F.round("c", 9).alias("c"))


@query("SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INT) AS quarter FROM supplier")
def window_ntile(read):
    return ordered.ntile(read("supplier").select("s_suppkey", "s_acctbal"), "quarter", 4, ["s_acctbal", "s_suppkey"]).select("s_suppkey", "quarter")


@query("SELECT k, CAST(pos AS INT) AS pos FROM (SELECT k, row_number() OVER (ORDER BY k NULLS LAST, c_custkey) AS pos, c_custkey FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer)) WHERE pos > 5")
def order_nulls_last(read):
    c = read("customer").select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"), "c_custkey")
    return ordered.numbered(c, "pos", rows.nulls_last("k", "c_custkey")).where("pos > 5").select("k", F.col("pos").cast("int").alias("pos"))


# many ranges and patterns in one job
@query("SELECT r.lo, count(l_quantity) AS n, round(avg(l_quantity), 6) AS avg_quantity FROM (SELECT n_nationkey * 4 + k.k AS lo FROM nation, (VALUES (0), (1), (2), (3)) AS k(k)) r LEFT JOIN lineitem ON CAST(floor(l_partkey / 10) AS INT) = r.lo GROUP BY r.lo")
def range_agg_100(read):
    """The table is summed by range before the ranges asked for are joined: one scan, and as many rows as ranges to shuffle."""
    asked = read("nation").select("n_nationkey", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).select((F.col("n_nationkey") * 4 + F.col("k")).cast("int").alias("lo"))
    sums = read("lineitem").groupBy(F.floor(F.col("l_partkey") / 10).cast("int").alias("lo")).agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))
    return asked.join(sums, "lo", "left").select("lo", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "avg_quantity")


@query("SELECT n_name, count(p_partkey) AS n FROM nation LEFT JOIN part ON p_name LIKE concat('%', lower(substring(n_name, 1, 2)), '%') GROUP BY n_name")
def like_100(read):
    """One scan of the large table, each row counting for all patterns that it matches; patterns are one row for each nation."""
    n = read("nation").select("n_name", F.lower(F.substring("n_name", 1, 2)).alias("pattern"))
    hits = rows.match_counts(read("part").select("p_name"), "p_name", n.select("pattern").distinct(), "pattern")
    return n.join(hits, "pattern", "left").groupBy("n_name").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))


# changes to tables
_EDITED = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 13 = 0"


def _edited(customer: DataFrame) -> DataFrame:
    kept = tables.update(tables.delete(customer, F.col("c_custkey") % 11 == 0), F.col("c_custkey") % 7 == 0, {"c_acctbal": F.col("c_acctbal") + 1})
    return tables.insert(kept, customer.where("c_custkey % 13 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


@query(_EDITED)
def update_delete_insert(read):
    return _edited(read("customer").select("c_custkey", "c_name", "c_acctbal"))


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 7 = 0")
def update_returning(read):
    return tables.updated_rows(read("customer").select("c_custkey", "c_acctbal"), F.col("c_custkey") % 7 == 0, {"c_acctbal": F.col("c_acctbal") + 1})


@query("SELECT 1 AS statement, count(*) AS rows, count(*)::BIGINT AS affected FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 2, (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0), count(*)::BIGINT FROM (SELECT 1 FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 1 FROM customer WHERE c_custkey % 11 = 0)")
def affected_rows(read):
    c = read("customer").select("c_custkey", "c_acctbal")
    return tables.affected(tables.updated_rows(c, F.col("c_custkey") % 7 == 0, {"c_acctbal": F.col("c_acctbal") + 1}), tables.deleted_rows(c, F.col("c_custkey") % 11 == 0))


@query("WITH s AS (SELECT c_custkey + 50 AS c_custkey, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM s UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s)")
def upsert(read):
    t = read("customer").select("c_custkey", "c_acctbal")
    return tables.upsert(t, t.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 50).alias("c_custkey"), (-F.col("c_acctbal")).alias("c_acctbal")), ["c_custkey"])


@query("WITH s AS (SELECT c_custkey + 50 AS c_custkey, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_do_nothing(read):
    t = read("customer").select("c_custkey", "c_acctbal")
    return tables.insert_missing(t, t.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 50).alias("c_custkey"), (-F.col("c_acctbal")).alias("c_acctbal")), ["c_custkey"])


@query("WITH s AS (SELECT c_custkey + 50 AS k, c_acctbal AS b FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, CASE WHEN k IS NULL THEN c_acctbal ELSE round(c_acctbal + b, 4) END AS c_acctbal FROM customer LEFT JOIN s ON c_custkey = k WHERE NOT coalesce(b < 0, false) UNION ALL SELECT k, b FROM s WHERE k NOT IN (SELECT c_custkey FROM customer)")
def merge_into(read):
    t = read("customer").select("c_custkey", "c_acctbal")
    s = t.where("c_custkey % 3 = 0").withColumn("c_custkey", F.col("c_custkey") + 50)
    return tables.merge(t, s, ["c_custkey"], {"c_acctbal": F.round(F.col("c_acctbal") + F.col("new_c_acctbal"), 4)}, F.col("new_c_acctbal") < 0)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def merge_delete(read):
    return tables.delete_matching(read("customer").select("c_custkey"), read("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) + 99)::BIGINT AS id FROM orders")
def serial_ids(read):
    return tables.with_serial(read("orders").select("o_orderkey"), "id", 100, ["o_orderkey"]).select("o_orderkey", "id")


# change feeds
@query(f"WITH p AS (SELECT c_custkey, c_name, c_acctbal FROM customer), c AS ({_EDITED}) SELECT CASE WHEN p.c_custkey IS NULL THEN 'INSERT' WHEN c.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS __op__, coalesce(c.c_custkey, p.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NULL OR p.c_name IS DISTINCT FROM c.c_name THEN c.c_name END AS c_name, CASE WHEN p.c_custkey IS NULL OR p.c_acctbal IS DISTINCT FROM c.c_acctbal THEN c.c_acctbal END AS c_acctbal, CASE WHEN p.c_custkey IS NOT NULL AND c.c_custkey IS NOT NULL THEN 'c_acctbal' ELSE '' END AS changed FROM p FULL JOIN c ON p.c_custkey = c.c_custkey WHERE p.c_custkey IS NULL OR c.c_custkey IS NULL OR p.c_acctbal IS DISTINCT FROM c.c_acctbal")
def change_feed(read):
    before = read("customer").select("c_custkey", "c_name", "c_acctbal")
    d = changes.changes(before, _edited(before), "c_custkey")
    return d.select(changes.OP, "c_custkey", "c_name", "c_acctbal", F.array_join(changes.CHANGED, ",").alias("changed"))


@query(_EDITED)
def change_fold(read):
    before = read("customer").select("c_custkey", "c_name", "c_acctbal")
    return changes.fold(before, changes.changes(before, _edited(before), "c_custkey"), "c_custkey")


@query("SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey)::BIGINT AS position FROM (" + _EDITED + ")")
def change_order(read):
    """A result in order, rebuilt from its changes alone: rows, and the chain of their predecessors."""
    before = read("customer").select("c_custkey", "c_name", "c_acctbal")
    after, order = _edited(before), ["c_acctbal", "c_custkey"]
    first = changes.with_predecessor(before, "c_custkey", order)
    feed = changes.changes(before, after, "c_custkey", order)
    return changes.in_list_order(changes.fold(first, feed, "c_custkey"), "c_custkey").select("c_custkey", "c_name", "c_acctbal", "position")


@query("WITH c AS (" + _EDITED + ") SELECT 'RESET' AS op, NULL::BIGINT AS c_custkey, 1 AS rank UNION ALL SELECT 'INSERT', c_custkey, 2 FROM c")
def change_reset(read):
    """A feed whose last state is lost starts anew."""
    return changes.reset(_edited(read("customer").select("c_custkey", "c_name", "c_acctbal")), "c_custkey").select(F.col(changes.OP).alias("op"), F.col("c_custkey").cast("bigint").alias("c_custkey"), changes.op_rank().alias("rank"))


@query("WITH p AS (SELECT c_custkey, c_name, c_acctbal FROM customer), c AS (" + _EDITED + ") SELECT chr(34) || 'customer' || chr(34) || ',' || CASE WHEN p.c_custkey IS NULL THEN 'I' WHEN c.c_custkey IS NULL THEN 'D' ELSE 'U' END || ',' || chr(34) || 'c_custkey' || chr(34) || '=' || chr(39) || coalesce(c.c_custkey, p.c_custkey)::VARCHAR || chr(39) AS payload FROM p FULL JOIN c ON p.c_custkey = c.c_custkey WHERE p.c_custkey IS NULL OR c.c_custkey IS NULL OR p.c_acctbal IS DISTINCT FROM c.c_acctbal")
def change_notifications(read):
    before = read("customer").select("c_custkey", "c_name", "c_acctbal")
    return changes.notifications(changes.changes(before, _edited(before), "c_custkey"), "customer", ["c_custkey"])


@query("SELECT s_suppkey, s_acctbal, lag(s_suppkey) OVER (ORDER BY s_acctbal, s_suppkey) AS after FROM supplier")
def live_order(read):
    return changes.with_predecessor(read("supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", ["s_acctbal", "s_suppkey"]).withColumnRenamed(changes.AFTER, "after")


_LOG = "SELECT event_id AS lsn, user_id, value, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'insert' END AS op FROM events"


def _log(read) -> DataFrame:
    return read("events").select(F.col("event_id").alias("lsn"), F.lit(0).alias("seq"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("insert").alias("op"), "user_id", "value")


@query(f"WITH m AS ({_LOG}) SELECT user_id, value FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) = 1 AND op <> 'delete'")
def log_apply(read):
    """The whole log at once."""
    m = _log(read)
    return changes.apply_log(m.where("false").select("user_id", "value"), m, ["user_id"])


@query(f"WITH m AS ({_LOG}) SELECT user_id, value FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) = 1 AND op <> 'delete'")
def log_apply_whole(read):
    """The whole log, whatever its length, in two steps: up to half of its last lsn, then up to its end."""
    m = _log(read)
    empty = m.where("false").select("user_id", "value")
    last = m.agg(F.max("lsn")).first()[0]
    if last is None:
        return empty
    half = changes.apply_log(empty, m, ["user_id"], frontier=last // 2)
    return changes.apply_log(half, m, ["user_id"], frontier=last, done=last // 2)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def log_apply_partial(read):
    """Updates of one column each leave the other as it was; deletes follow them, and updates of rows that are gone change nothing."""
    c = read("customer").select("c_custkey", "c_name", "c_acctbal")
    message = lambda where, seq, op, present, **new: c.where(where).select("c_custkey", *[new.get(x, F.lit(None).cast(t)).alias(x) for x, t in c.dtypes[1:]], F.lit(seq).cast("bigint").alias("seq"), F.lit(10 + seq).cast("bigint").alias("lsn"), F.lit(op).alias("op"), F.array(*map(F.lit, present)).cast("array<string>").alias("present"))
    m = message("c_custkey % 3 = 0", 1, "update", ["c_custkey", "c_name"], c_name=F.concat("c_name", F.lit("!")))
    m = m.unionByName(message("c_custkey % 2 = 0", 2, "update", ["c_custkey", "c_acctbal"], c_acctbal=-F.col("c_acctbal")))
    m = m.unionByName(message("c_custkey % 7 = 0", 3, "delete", [])).unionByName(message("c_custkey % 14 = 0", 4, "update", ["c_name"], c_name=F.lit("lost")))
    return changes.apply_log(c, m, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved in' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0")
def log_refetch(read):
    """A must-refetch empties the table and what was told before; then inserts, and rows that a query moves in, over those that are there."""
    c = read("customer").select("c_custkey", "c_name")
    told = lambda df, seq, lsn, op, move_in: df.select("c_custkey", "c_name", F.lit(seq).cast("bigint").alias("seq"), F.lit(lsn).cast("bigint").alias("lsn"), F.lit(op).alias("op"), F.lit(move_in).alias("move_in"))
    nothing = c.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"))
    m = told(c, 1, 50, "insert", False).unionByName(told(nothing, 2, None, changes.MUST_REFETCH, False)).unionByName(told(c.where("c_custkey % 2 = 0"), 3, 7, "insert", False))
    m = m.unionByName(told(c.where("c_custkey % 5 = 0").withColumn("c_name", F.lit("moved in")), 4, None, "insert", True)).unionByName(told(nothing, 5, 8, changes.UP_TO_DATE, False))
    return changes.apply_stream(c, m, ["c_custkey"], done=60).table


@query("SELECT min(done)::BIGINT AS frontier FROM (SELECT event_type, max(event_id) AS done FROM events GROUP BY event_type)")
def log_frontier(read):
    return changes.frontier(read("events"), "event_type", "event_id")


@query("SELECT o_custkey, count(*)::BIGINT AS n, round(sum(p)::DOUBLE / count(*), 4) AS mean FROM (SELECT o_custkey, o_totalprice::DECIMAL(18, 2) AS p FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_custkey, 10.0 FROM orders WHERE o_orderkey % 9 = 0) GROUP BY o_custkey")
def incremental_view(read):
    o = read("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    stored = views.partials(o, ["o_custkey"], {"total": F.col("o_totalprice")})
    delta = views.signed(o.where("o_orderkey % 9 = 0").withColumn("o_totalprice", F.lit(10.0).cast("decimal(18,2)")), o.where("o_orderkey % 5 = 0"))
    after = views.refresh(stored, views.partials(delta, ["o_custkey"], {"total": F.col("o_totalprice")}, F.col("weight")), ["o_custkey"], ["total"])
    return after.select("o_custkey", F.col("rows").alias("n"), F.round(F.col("total").cast("double") / F.col("rows"), 4).alias("mean"))


@query("SELECT event_id AS msg_id, 1 AS read_count FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events) ORDER BY event_id LIMIT 25")
def queue_read(read):
    e = read("events")
    q = e.select(F.col("event_id").alias("msg_id"), F.col("ts").alias("visible_at"), F.lit(0).alias("read_count"), F.col("props").alias("message"))
    now = q.agg(F.min("visible_at").alias("t")).select((F.col("t") + F.make_dt_interval(F.lit(10))).alias("now"))
    at = F.lit(now.first()["now"])
    got, _ = queue.read(q, at.cast("timestamp_ntz"), 30, 25)
    return got.select("msg_id", "read_count")


# search
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents) SELECT doc_id FROM d WHERE list_has_all(t, ['the', 'that']) AND NOT list_has_any(t, ['trash'])")
def fts_boolean(read):
    t = F.col("text")
    return read("documents").where(search.has_all(t, ["the", "that"]) & search.has_none(t, ["trash"])).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents) SELECT doc_id FROM d WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def fts_phrase(read):
    return read("documents").where(search.has_phrase(F.col("text"), ["of", "the"])).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents) SELECT doc_id FROM d WHERE len(list_filter(t, lambda w: starts_with(w, 'thre'))) > 0")
def fts_prefix(read):
    return read("documents").where(search.has_prefix(F.col("text"), "thre")).select("doc_id")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def inverted_index(read):
    return search.postings(read("documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))



@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM w), p AS (SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM e GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, sum(('0x' || substr(md5(doc_id::VARCHAR || ':' || tf::VARCHAR || ':' || positions), 1, 8))::BIGINT)::BIGINT AS digest FROM p GROUP BY term")
def inverted_index_whole(read):
    """Every term, with a digest of its postings: the sum of a hash of each one's id, tf and positions."""
    told = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("tf").cast("string"), F.lit(":"), F.array_join(F.col("positions").cast("array<string>"), ","))
    hashed = F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("bigint")
    return search.postings(read("documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(hashed).alias("digest"))


_TF = "len(list_filter(t, lambda w: w = '{0}'))"
_PART = "ln(1 + (n - d{0} + 0.5::DOUBLE) / (d{0} + 0.5::DOUBLE)) * f{0} * 2.2::DOUBLE / (f{0} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))"


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS dl, {_TF.format('the')} AS f0, {_TF.format('license')} AS f1 FROM d), s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c) SELECT doc_id, round(-({_PART.format(0)} + {_PART.format(1)}), 6) AS score FROM c, s WHERE f0 > 0 OR f1 > 0")
def bm25(read):
    return search.bm25(read("documents"), ["the", "license"]).select("doc_id", F.round("score", 6).alias("score"))


# graphs
def _graph(read) -> tuple[DataFrame, DataFrame]:
    n, r, c, s = read("nation"), read("region"), read("customer"), read("supplier")
    vertex = lambda d, prefix, key, label: d.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"))
    edge = lambda d, a, k1, b, k2, kind: d.select(F.concat(F.lit(a), F.col(k1).cast("string")).alias("src"), F.concat(F.lit(b), F.col(k2).cast("string")).alias("dst"), F.lit(kind).alias("type"))
    v = vertex(n, "n", "n_nationkey", "Nation").unionByName(vertex(r, "r", "r_regionkey", "Region")).unionByName(vertex(c, "c", "c_custkey", "Customer")).unionByName(vertex(s, "s", "s_suppkey", "Supplier"))
    e = edge(n, "n", "n_nationkey", "r", "n_regionkey", "IN").unionByName(edge(c, "c", "c_custkey", "n", "c_nationkey", "IN")).unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey", "IN"))
    return v, e


@query("SELECT 's' || s_suppkey AS v0, 'n' || n_nationkey AS v1, 'r' || n_regionkey AS v2 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def graph_match(read):
    v, e = _graph(read)
    return graphs.match(v, e, ["Supplier", "Nation", "Region"], ["IN", "IN"])


@query("SELECT 's' || s_suppkey AS start, 'n' || n_nationkey AS end, 1 AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def graph_hops(read):
    v, e = _graph(read)
    return graphs.within_hops(v.where("label = 'Supplier'"), e, 1, 2, "IN")


@query("SELECT 'n' || n_nationkey AS id, 1::BIGINT AS out_degree, ((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::BIGINT AS in_degree FROM nation")
def graph_degrees(read):
    v, e = _graph(read)
    return graphs.degrees(v.where("label = 'Nation'"), e)
