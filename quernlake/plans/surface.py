"""Queries of the rest of the SQL surface: functions by family, statements, user functions, further joins, frames, views, queue, each with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, dates, geo, hashids, ids, strings, vector
from ..operators import graphs, ordered, queue, rows, views
from ..operators import tables as changed
from ..sources import sql as statements
from .relational import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Texts that both engines read, and pairs where they differ: Spark's, then the oracle's.
SHARED = {
    "trig_functions": "SELECT s_suppkey, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(tan(x), 9) AS t, round(atan2(x, 2), 9) AS a, round(asin(x / 10000), 9) AS i, round(acos(x / 10000), 9) AS o, round(degrees(x), 6) AS d, round(radians(x), 9) AS r, round(exp(x / 1000), 6) AS e, round(cbrt(x), 6) AS q FROM (SELECT s_suppkey, abs(s_acctbal) / 2 AS x FROM {supplier})",
    "regr_functions": "SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 8) AS r, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM {lineitem} GROUP BY l_returnflag",
    "join_natural": "SELECT k, n, m FROM (SELECT n_nationkey AS k, n_name AS n FROM {nation}) NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS m FROM {supplier} GROUP BY s_nationkey)",
    "join_theta_pure": "SELECT n_name, count(*) AS n FROM {nation} JOIN {supplier} ON s_acctbal > n_nationkey * 400 GROUP BY n_name",
    "join_on_scalar": "SELECT c_custkey, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey AND c_acctbal > (SELECT avg(s_acctbal) FROM {supplier})",
    "clock": "SELECT count(*) AS n FROM {orders} WHERE o_orderdate <= current_timestamp AND o_orderdate < current_date",
    "type_names": "SELECT DISTINCT lower(typeof(l_orderkey)) AS a, lower(typeof(l_quantity)) AS b, lower(typeof(l_quantity > 1)) AS c FROM {lineitem}",
}
PAIRED = {
    "string_more": (
        "SELECT p_partkey, overlay(p_name PLACING 'ZZ' FROM 2 FOR 3) AS o, regexp_count(p_name, 'a') AS n, octet_length(p_name) AS b, strpos AS at, rpad(p_brand, 12, '-') AS r, chr(65 + p_size % 26) AS c, regexp_substr(p_name, '[a-m]+') AS s FROM (SELECT *, locate('e', p_name) AS strpos FROM {part})",
        "SELECT p_partkey, p_name[1:1] || 'ZZ' || p_name[5:] AS o, len(regexp_extract_all(p_name, 'a'))::INTEGER AS n, octet_length(encode(p_name))::INTEGER AS b, strpos(p_name, 'e')::INTEGER AS at, rpad(p_brand, 12, '-') AS r, chr(65 + p_size::INTEGER % 26) AS c, nullif(regexp_extract(p_name, '[a-m]+'), '') AS s FROM part",
    ),
    "decode_functions": ("SELECT n_nationkey, decode(unhex(hex(n_name)), 'UTF-8') AS t, decode(unbase64(base64(CAST(n_name AS BINARY))), 'UTF-8') AS b FROM {nation}", "SELECT n_nationkey, n_name AS t, n_name AS b FROM nation"),
    "date_make": (
        "SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS first, CAST(last_day(o_orderdate) AS DATE) AS last, CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS next FROM {orders}",
        "SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS first, last_day(o_orderdate)::DATE AS last, (o_orderdate + INTERVAL 1 MONTH)::DATE AS next FROM orders",
    ),
    "array_edit": (
        "SELECT p_partkey, array_join(array_append(array_prepend(w, 'first'), 'last'), ' ') AS both, array_join(array_remove(w, w[0]), ' ') AS gone, array_join(transform(w, x -> IF(x = w[0], 'new', x)), ' ') AS changed, array_join(concat(w, w), ' ') AS twice, size(array_distinct(w)) AS n FROM (SELECT p_partkey, split(p_name, ' ') AS w FROM {part})",
        "SELECT p_partkey, 'first ' || p_name || ' last' AS both, array_to_string(list_filter(w, lambda x: x <> w[1]), ' ') AS gone, array_to_string(list_transform(w, lambda x: CASE WHEN x = w[1] THEN 'new' ELSE x END), ' ') AS changed, p_name || ' ' || p_name AS twice, len(list_distinct(w))::INTEGER AS n FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)",
    ),
    "map_edit": (
        "SELECT event_id, to_json(map_concat(m, map('z', user_id))) AS j, size(map_filter(m, (k, v) -> v > 50)) AS n, map_contains_key(m, 'k') AND m['k'] IS NOT NULL AS has FROM (SELECT event_id, user_id, from_json(props, 'map<string,bigint>') AS m FROM {events})",
        "SELECT event_id, json_merge_patch(props, json_object('z', user_id))::VARCHAR AS j, CASE WHEN json_extract_string(props, '$.k')::BIGINT > 50 THEN 1 ELSE 0 END AS n, json_extract(props, '$.k') IS NOT NULL AS has FROM events",
    ),
    "mode_value": (
        "SELECT o_orderpriority, mode() WITHIN GROUP (ORDER BY o_orderstatus) AS m FROM {orders} GROUP BY o_orderpriority",
        "SELECT o_orderpriority, o_orderstatus AS m FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) = 1",
    ),
}


def query(sql: str):
    """Register a function of (read, spark), read being a function of a table's name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables(spark, sf_dir, sql)


for _name, _sql in SHARED.items():
    QUERIES[_name] = _text(_sql)
    ORACLE_SQL[_name] = _sql.replace("{", "").replace("}", "")
for _name, (_sql, _oracle) in PAIRED.items():
    QUERIES[_name], ORACLE_SQL[_name] = _text(_sql), _oracle


# text by language, quoting, dictionaries
@query("SELECT n_nationkey, upper(replace(replace(lower(n_name), 'i', 'İ'), 'ı', 'I')) AS u, replace(replace(lower(replace(replace(n_name, 'I', 'ı'), 'İ', 'i')), 'İ', 'i'), 'x', 'x') AS l FROM nation")
def locale_case(read, spark):
    n = F.col("n_name")
    return read("nation").select("n_nationkey", strings.upper(F.lower(n), "tr").alias("u"), strings.lower(n, "tr").alias("l"))


@query("SELECT count(*) FILTER (WHERE lower(p_name) LIKE '%i%') AS en, count(*) FILTER (WHERE upper(p_name) LIKE '%ı%') AS tr FROM part")
def ilike_locale(read, spark):
    """In Turkish, a capital I is no i."""
    up = read("part").select(F.upper("p_name").alias("p"))
    return up.agg(F.count_if(strings.ilike(F.col("p"), "%i%")).alias("en"), F.count_if(strings.ilike(F.col("p"), "%i%", "tr")).alias("tr"))


@query("SELECT c_custkey, 'insert ' || CASE WHEN c_mktsegment ~ '^[a-z_][a-z0-9_$]*$' THEN c_mktsegment ELSE '\"' || c_mktsegment || '\"' END || ' ''' || c_name || ''' 100%' AS s FROM customer")
def format_quoted(read, spark):
    return read("customer").select("c_custkey", strings.format_text("insert %2$I %1$L 100%%", F.col("c_name"), F.col("c_mktsegment")).alias("s"))


@query("SELECT c_custkey, n::INTEGER AS position FROM (SELECT c_custkey, row_number() OVER (ORDER BY lower(c_name), c_name DESC) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS c_name FROM customer))")
def order_collated(read, spark):
    """Order by a language's rules: letters first, case only between equals, lower case before upper."""
    c = read("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"))
    return ordered.numbered(c, "position", [F.collate("name", "en")]).select("c_custkey", F.col("position").cast("int").alias("position"))


_LABELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(f"SELECT o_orderkey, list_position({_LABELS}, o_orderpriority)::INTEGER AS rank, list_position({_LABELS}, o_orderpriority) > 3 AS above FROM orders")
def enum_order(read, spark):
    rank = strings.enum_position(F.col("o_orderpriority"), _LABELS)
    return read("orders").select("o_orderkey", rank.alias("rank"), (rank > strings.enum_position(F.lit("3-MEDIUM"), _LABELS)).alias("above"))


_TERMS = "list_filter(string_split_regex(lower(c_name), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"SELECT c_custkey, array_to_string(flatten(list_transform({_TERMS}, lambda w: CASE WHEN w = 'customer' THEN ['customer', 'client', 'buyer'] WHEN regexp_matches(w, '^[0-9]+$') THEN [w[1:6]] ELSE [w] END)), ' ') AS t FROM customer")
def term_dictionaries(read, spark):
    from ..operators import search

    t = strings.synonyms(search.terms(F.col("c_name")), {"customer": ["client", "buyer"]})
    return read("customer").select("c_custkey", F.array_join(strings.short_numbers(t, 6), " ").alias("t"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\b(license|licence)\\b', '<b>\\1</b>', 'gi')) AS h FROM documents WHERE text ILIKE '%license%' AND text ~ '^[\\x00-\\x7F]*$'")
def search_headline(read, spark):
    told = strings.headline(F.col("text"), ["license", "licence"])
    return read("documents").where(F.col("text").ilike("%license%") & F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", F.md5(told).alias("h"))


# encryption
@query("SELECT n_nationkey, lower(sha256(unhex(repeat('37', 1)) || ''::BLOB)) IS NOT NULL AS ok, lower(sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode(n_name))))) AS mac FROM nation".replace("{o}", bytes(b ^ 0x5C for b in b"key".ljust(64, b"\0")).hex()).replace("{i}", bytes(b ^ 0x36 for b in b"key".ljust(64, b"\0")).hex()))
def hmac_digest(read, spark):
    return read("nation").select("n_nationkey", F.lit(True).alias("ok"), F.lower(F.hex(crypto.hmac(F.col("n_name"), b"key"))).alias("mac"))


@query("SELECT c_custkey, c_name AS back, true AS hidden FROM customer")
def aes_round_trip(read, spark):
    key = b"0123456789abcdef"
    c = read("customer").select("c_custkey", "c_name", crypto.encrypt(F.col("c_name"), key).alias("e"))
    return c.select("c_custkey", crypto.decrypt(F.col("e"), key).alias("back"), (F.locate("Customer", F.decode("e", "ISO-8859-1")) == 0).alias("hidden"))


# dates
@query("SELECT event_id, timezone('America/New_York', timezone('UTC', ts::TIMESTAMP))::TIMESTAMP AS local FROM events")
def time_zone(read, spark):
    return read("events").select("event_id", dates.at_time_zone(F.col("ts"), "America/New_York").alias("local"))


@query("SELECT o_orderkey, (m // 12)::INTEGER AS y, (m % 12)::INTEGER AS m, date_diff('day', (d + to_months(m))::DATE, DATE '2030-03-15')::INTEGER AS d FROM (SELECT o_orderkey, d, (date_diff('month', d, DATE '2030-03-15') - CASE WHEN d + to_months(date_diff('month', d, DATE '2030-03-15')::INTEGER) > DATE '2030-03-15' THEN 1 ELSE 0 END)::INTEGER AS m FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders))")
def date_age(read, spark):
    a = dates.age(F.lit("2030-03-15"), F.col("o_orderdate"))
    return read("orders").select("o_orderkey", a["years"].alias("y"), a["months"].alias("m"), a["days"].alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate = DATE '1995-06-01' OR (o_orderdate < DATE '1995-09-01' AND DATE '1995-06-01' < l_shipdate) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def period_overlaps(read, spark):
    j = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = dates.overlaps(F.col("o_orderdate"), F.col("l_shipdate"), F.lit("1995-06-01").cast("date"), F.lit("1995-09-01").cast("date"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", o.alias("o"))


# vectors
@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0 THEN x * x ELSE 0 END)), 6) AS ip FROM embeddings")
def sparse_vectors(read, spark):
    e = vector.sparse(F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")).otherwise(F.lit(0.0))))
    held = read("embeddings").select("vec_id", e.alias("e"), vector.sparse(F.transform("embedding", lambda x: x.cast("double"))).alias("all"))
    return held.select("vec_id", F.round(vector.sparse_inner(F.col("e"), F.col("all")), 6).alias("ip"))


# statements and user functions
@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 50000.5")
def bound_values(read, spark):
    return statements.query(spark, "SELECT o_orderkey FROM {orders} WHERE o_orderpriority = :priority AND o_totalprice > :least", {"priority": "1-URGENT", "least": 50000.5}, orders=read("orders"))


@query("SELECT n_nationkey, (CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 24 END)::BIGINT AS f FROM nation")
def sql_function(read, spark):
    """A function of its own, in SQL: a product over a sequence."""
    make = "CREATE OR REPLACE TEMPORARY FUNCTION factorial_of(n BIGINT) RETURNS BIGINT RETURN aggregate(sequence(1L, greatest(n, 1L)), 1L, (a, x) -> a * x)"
    return statements.run(spark, [make, "SELECT n_nationkey, factorial_of(CAST(n_regionkey AS BIGINT)) AS f FROM {nation}"], nation=read("nation"))[-1]


@query("SELECT n_nationkey, unnest(generate_series(0, n_regionkey, 2))::INTEGER AS k FROM nation")
def table_function(read, spark):
    """A function that returns rows, joined laterally."""
    make = "CREATE OR REPLACE TEMPORARY FUNCTION evens_up_to(n INT) RETURNS TABLE(k INT) RETURN SELECT explode(sequence(0, n, 2))"
    return statements.run(spark, [make, "SELECT n_nationkey, e.k FROM (SELECT n_nationkey, CAST(n_regionkey AS INT) AS r FROM {nation}) n, LATERAL evens_up_to(n.r) e"], nation=read("nation"))[-1]


@query("SELECT count(*) FILTER (WHERE c_acctbal > 5000) AS n, 'caught' AS ended FROM customer")
def procedure_block(read, spark):
    """A block with variables, a loop, a branch and a handler: the first of ever larger bounds that a raised condition stops at."""
    read("customer").createOrReplaceTempView("block_customer")
    block = """BEGIN
      DECLARE bound INT DEFAULT 1000;
      DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN
        SELECT count(*) AS n, 'caught' AS ended FROM block_customer WHERE c_acctbal > bound;
      END;
      WHILE true DO
        IF bound >= 5000 THEN
          SELECT raise_error('far enough');
        ELSE
          SET bound = bound + 1000;
        END IF;
      END WHILE;
    END"""
    return spark.sql(block)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def custom_aggregate(read, spark):
    """An aggregate of one's own, with a state that Spark merges: each part's sums in pandas, once for a batch, then the sums of all."""

    def sums(batches):
        for b in batches:
            w = b["l_quantity"]
            yield pd.DataFrame({"l_returnflag": b["l_returnflag"], "s": b["l_extendedprice"] * w, "w": w}).groupby("l_returnflag", as_index=False).sum()

    parts = read("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice").mapInPandas(sums, "l_returnflag string, s double, w double")
    return parts.groupBy("l_returnflag").agg(F.round(F.sum("s") / F.sum("w"), 4).alias("mean"))


# frames, pages, views, queue
@query("SELECT p_partkey, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)::BIGINT AS others FROM part")
def window_exclude_group(read, spark):
    return rows.frame_excluding(read("part"), ["p_brand"], "p_size", "p_size", "others", "group").select("p_partkey", F.col("others").cast("bigint").alias("others"))


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES)::BIGINT AS own FROM part")
def window_exclude_ties(read, spark):
    return rows.frame_excluding(read("part"), ["p_brand"], "p_size", "p_size", "own", "ties").select("p_partkey", F.col("own").cast("bigint").alias("own"))


@query("SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total_count FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
def page_total(read, spark):
    return rows.page_with_total(read("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 5, 10)


@query("SELECT c_nationkey, count(*) AS n FROM (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0 AND o_orderkey % 4 <> 0 UNION ALL SELECT c_nationkey FROM customer JOIN orders ON c_custkey + 7 = o_custkey WHERE c_custkey % 9 = 0 AND o_orderkey % 4 <> 0) GROUP BY c_nationkey")
def incremental_join_view(read, spark):
    """Counts over a join, kept up by the changes of both sides: customers go and come, orders go."""
    c, o = read("customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), read("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    stored = views.partials(c.join(o, "k"), ["c_nationkey"], {})
    delta_c = views.signed(c.where("k % 9 = 0").withColumn("k", F.col("k") + 7), c.where("k % 5 = 0"))
    delta_o = views.signed(o.where("false"), o.where("o_orderkey % 4 = 0"))
    delta = views.join_delta(c, delta_c, o, delta_o, ["k"])
    return views.refresh(stored, views.partials(delta, ["c_nationkey"], {}, F.col("weight")), ["c_nationkey"], []).select("c_nationkey", F.col("rows").cast("bigint").alias("n"))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def incremental_distinct_view(read, spark):
    o = read("orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    stored = views.distinct_partials(o.drop("o_orderkey"))
    gone = o.where("o_orderkey % 3 = 0").drop("o_orderkey").withColumn("weight", F.lit(-1))
    keys = ["o_custkey", "o_orderstatus"]
    return views.refresh(stored, views.distinct_partials(gone, F.col("weight")), keys, []).select(keys)


@query("SELECT row_number() OVER (ORDER BY event_id)::BIGINT AS msg_id, event_id FROM events ORDER BY 1 OFFSET 3")
def queue_cycle(read, spark):
    """Send the whole table, take three messages out, and look at what is left."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "msg_id long, visible_at timestamp_ntz, read_count int, message string")
    sent = queue.send(empty, read("events").select(F.col("event_id").cast("string").alias("message"), "event_id"), now, ["event_id"])
    _, left = queue.pop(sent, now, 3)
    return left.select("msg_id", F.col("message").cast("bigint").alias("event_id"))


# bits, ids, shapes, graphs, rows that statements return
@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN (x > 0) <> (i % 2 = 0) THEN 1 ELSE 0 END))::INTEGER AS hamming, round(1 - list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i % 2 = 0 THEN 1 ELSE 0 END)) / list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 OR i % 2 = 0 THEN 1 ELSE 0 END)), 9) AS jaccard FROM embeddings")
def vector_bits(read, spark):
    bits, other = F.transform("embedding", lambda x: (x > 0).cast("int")), F.transform("embedding", lambda x, i: ((i + 1) % 2 == 0).cast("int"))
    return read("embeddings").select("vec_id", vector.hamming_distance(bits, other).cast("int").alias("hamming"), F.round(vector.jaccard_distance(bits, other), 9).alias("jaccard"))


@query("SELECT c_custkey, c_custkey AS back, true AS longer FROM customer")
def short_ids(read, spark):
    c = read("customer").select("c_custkey", hashids.encode(F.col("c_custkey"), "salt", 8).alias("id"))
    return c.select("c_custkey", hashids.decode(F.col("id"), "salt", 8).alias("back"), (F.length("id") >= 8).alias("longer"))


@query("SELECT n_nationkey, true AS well_formed, count(DISTINCT n_name) OVER () AS n FROM nation")
def uuid_sha1(read, spark):
    n = read("nation").select("n_nationkey", ids.uuid5(F.col("n_name")).alias("u"))
    total = n.agg(F.countDistinct("u").alias("n"))  # one row
    return n.join(F.broadcast(total)).select("n_nationkey", F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("well_formed"), "n")


@query("SELECT p_partkey, p_size * 2.0::DOUBLE AS area, 2 * (p_size + 2.0::DOUBLE) AS around, p_size / 2.0::DOUBLE AS x, 1.0::DOUBLE AS y, p_size >= 10 AS meets FROM part")
def polygon_measures(read, spark):
    """Rectangles of a width that the row says and a height of 2."""
    w, zero, two = F.col("p_size").cast("double"), F.lit(0.0), F.lit(2.0)
    xs, ys = F.array(zero, w, w, zero, zero), F.array(zero, zero, two, two, zero)
    box = geo.bounds(F.array(F.lit(10.0), F.lit(20.0)), F.array(F.lit(1.0), F.lit(9.0)))
    centre = geo.polygon_centroid(xs, ys)
    return read("part").select("p_partkey", geo.polygon_area(xs, ys).alias("area"), geo.line_length(xs, ys).alias("around"), centre["x"].alias("x"), centre["y"].alias("y"), geo.bounds_overlap(geo.bounds(xs, ys), box).alias("meets"))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'rich' END AS kind, (c_nationkey <> 3)::INTEGER AS edges FROM customer WHERE c_custkey % 10 <> 0")
def graph_edit(read, spark):
    """Properties set, vertices deleted with their edges: what is left, and how many edges each vertex has."""
    c = read("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_acctbal", "c_nationkey")
    n = read("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey"))
    edges = c.select(F.col("id").alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    vertices = graphs.set_properties(c.unionByName(n, allowMissingColumns=True), F.col("c_acctbal") > 5000, {"kind": F.lit("rich")})
    vertices, edges = graphs.remove(vertices, edges, (F.col("c_custkey") % 10 == 0) | (F.col("n_nationkey") == 3))
    left = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return vertices.where("c_custkey IS NOT NULL").join(left, "id", "left").select("id", "kind", F.coalesce("n", F.lit(0)).cast("int").alias("edges"))


@query("SELECT 'deleted' AS what, c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'inserted', c_custkey + 1000000, NULL FROM customer WHERE c_custkey % 50 = 0")
def returned_rows(read, spark):
    c = read("customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"))
    gone = changed.deleted_rows(c, F.col("c_acctbal") < 0).select(F.lit("deleted").alias("what"), "*")
    return gone.unionByName(changed.inserted_rows(c, new).select(F.lit("inserted").alias("what"), "*"))
