"""Relational queries over the given tables: scans, predicates, joins, aggregation, windows, ordering, set operations, recursion.

Queries are SQL; `{table}` stands for a table of the given folder. Where both engines read one text, it stands once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL whose {table} placeholders stand for DataFrames over the given folder."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


#: Queries whose text Spark and the oracle share.
SHARED_SQL = {
    # scans, projections, predicates
    "range_agg": "SELECT count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity FROM {lineitem} WHERE l_partkey >= 100 AND l_partkey < 1000",
    "projection": "SELECT c_custkey, c_name AS name, c_acctbal * 2 AS twice FROM {customer}",
    "filter_compound": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag <> 'N'",
    "like_count": "SELECT count(*) AS n FROM {part} WHERE p_name LIKE '%an%'",
    "ilike_count": "SELECT count(*) AS n FROM {part} WHERE p_name ILIKE '%AN%'",
    "in_list": "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "in_subquery": "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "in_subquery_limit": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey IN (SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 1)",
    "not_in": "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3)",
    "exists_correlated": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "is_distinct_from": "SELECT a.l_orderkey, a.l_linenumber FROM {lineitem} a WHERE a.l_returnflag IS DISTINCT FROM 'N' AND nullif(a.l_linestatus, 'O') IS NOT DISTINCT FROM NULL",
    "null_tests": "SELECT count(*) AS n, count(nullif(l_returnflag, 'A')) AS not_a FROM {lineitem} WHERE nullif(l_linestatus, 'F') IS NULL",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size FROM {orders}",
    "coalesce_nullif": "SELECT p_partkey, coalesce(nullif(p_size, 1), -1) AS size FROM {part}",
    "casts": "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS label FROM {orders} WHERE o_totalprice = CAST(CAST(o_totalprice AS BIGINT) AS DOUBLE) OR o_orderkey < 100 AND o_totalprice - floor(o_totalprice) < 0.5",
    "concat_operator": "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS label FROM {nation}",
    "scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})",
    "scalar_subquery_correlated": "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "values_list": "SELECT n.n_name, v.label FROM {nation} n JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS v(k, label) ON n.n_regionkey = v.k",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 10) SELECT c_name, n FROM big JOIN {customer} ON c_custkey = o_custkey",
    # joins
    "join_inner": "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "join_right": "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey",
    "join_full": "SELECT a.k AS a_key, b.k AS b_key FROM (SELECT DISTINCT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 0) a FULL JOIN (SELECT DISTINCT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000) b ON a.k = b.k",
    "join_anti_left_null": "SELECT o.o_orderkey FROM {orders} o LEFT JOIN (SELECT * FROM {lineitem} WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL",
    "join_using": "SELECT count(*) AS n FROM (SELECT l_orderkey AS k FROM {lineitem}) JOIN (SELECT o_orderkey AS k FROM {orders} WHERE o_orderstatus = 'F') USING (k)",
    "join_theta": "SELECT count(*) AS n FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_star": "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_comma": "SELECT n_name, s_name FROM {supplier}, {nation} WHERE s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_self_pairs": "SELECT a.l_orderkey, count(*) AS pairs FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey",
    "join_in_list": "SELECT count(*) AS n FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey AND c.c_mktsegment IN ('BUILDING', 'MACHINERY')",
    # aggregation
    "group_agg": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "group_having": "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 5",
    "group_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INT) AS g FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "count_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem}",
    "agg_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) AS n FROM {orders} GROUP BY o_orderstatus",
    "bool_aggs": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_over, bool_or(o_orderstatus = 'P') AS some_open FROM {orders} GROUP BY o_custkey",
    "min_max": "SELECT l_shipdate IS NOT NULL AS dated, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem} GROUP BY l_shipdate IS NOT NULL",
    "variance": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS vp FROM {lineitem} GROUP BY l_returnflag",
    "correlation": "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_pop(l_quantity, l_discount), 8) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM {lineitem}",
    "max_by": "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best FROM {orders} GROUP BY o_custkey",
    "bit_aggs": "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM {part} GROUP BY p_brand",
    "any_match_mode": "SELECT CAST(count_if(l_tax > 0.05) AS BIGINT) AS n FROM {lineitem}",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    "group_ordinal": "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY 1, 2",
    # windows
    "window_row_number": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rn FROM {orders}",
    "window_rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS d FROM {part}",
    "window_lag": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM {orders}",
    "window_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_running": "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {lineitem}",
    "window_moving": "SELECT l_orderkey, l_linenumber, l_partkey, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS moving FROM {lineitem}",
    "window_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {part}",
    "window_agg_share": "SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) AS share FROM {part}",
    # order, limit, sets
    "top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT c_custkey FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 25",
    "order_expression": "SELECT s_suppkey FROM {supplier} ORDER BY abs(s_acctbal - 5000), s_suppkey LIMIT 7",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "except_distinct": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "distinct_on": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1",
    # scalar functions
    "string_functions": "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS INT) AS n, substring(p_name, 2, 3) AS s, replace(p_name, 'a', 'b') AS r, reverse(p_brand) AS v, lpad(p_brand, 12, '*') AS l, trim('  x ') AS t, left(p_name, 2) AS lf, right(p_name, 2) AS rt, ascii(p_name) AS a, repeat('ab', 2) AS rr FROM {part}",
    "string_split_part": "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second FROM {part}",
    "string_translate": "SELECT n_nationkey, translate(n_name, 'AEI', 'aei') AS t, concat_ws('/', n_name, CAST(n_regionkey AS STRING)) AS c, md5(n_name) AS m FROM {nation}",
    "regexp_replace": "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS masked FROM {customer}",
    "math_functions": "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, round(ln(abs(s_acctbal) + 1), 6) AS l, CAST(sign(s_acctbal) AS INT) AS sg, pow(2, s_nationkey % 5) AS p, greatest(s_nationkey, 10) AS g, least(s_nationkey, 10) AS m, s_suppkey % 7 AS md FROM {supplier}",
    "bit_functions": "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor_ AS x, CAST(bit_count(p_size) AS INT) AS n FROM (SELECT *, (p_size | 5) - (p_size & 5) AS xor_ FROM {part})",
    "date_parts": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(extract(hour FROM o_orderdate) AS INT) AS h FROM {orders}",
    "date_filter": "SELECT count(*) AS n FROM {orders} WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'",
}

#: Pairs of texts where the dialects differ: Spark's, then the oracle's.
PAIRED_SQL = {
    "generate_series": ("SELECT n_nationkey, s.k AS k FROM {nation} LATERAL VIEW explode(sequence(0, n_regionkey)) s AS k", "SELECT n_nationkey, unnest(generate_series(0, n_regionkey))::INTEGER AS k FROM nation"),
    "unnest_ordinality": ("SELECT p_partkey, pos + 1 AS ord, word FROM {part} LATERAL VIEW posexplode(split(p_name, ' ')) w AS pos, word", "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::INTEGER AS ord, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "recursive_cte": (
        "WITH RECURSIVE c(k, depth) AS (SELECT min(n_nationkey), 0 FROM {nation} UNION ALL SELECT k + 1, depth + 1 FROM c WHERE k < 20) SELECT c.k, c.depth, n.n_name FROM c JOIN {nation} n ON n.n_nationkey = c.k",
        "WITH RECURSIVE c(k, depth) AS (SELECT min(n_nationkey), 0 FROM nation UNION ALL SELECT k + 1, depth + 1 FROM c WHERE k < 20) SELECT c.k, c.depth, n.n_name FROM c JOIN nation n ON n.n_nationkey = c.k",
    ),
    "row_distinct_from": (
        "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE NOT (struct(l_returnflag, l_linestatus) <=> struct('N', 'O'))",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IS DISTINCT FROM ('N', 'O')",
    ),
    "any_array": ("SELECT c_custkey FROM {customer} WHERE array_contains(array(1, 3, 5), c_nationkey)", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY([1, 3, 5])"),
    "array_agg_ordered": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "string_agg": ("SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "percentile_cont": (
        "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM {lineitem} GROUP BY l_returnflag",
        "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
    ),
    "xml_aggregate": (
        "SELECT n_regionkey, concat('<r>', array_join(transform(array_sort(collect_list(n_name)), x -> concat('<n>', x, '</n>')), ''), '</r>') AS x FROM {nation} GROUP BY n_regionkey",
        "SELECT n_regionkey, '<r>' || string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) || '</r>' AS x FROM nation GROUP BY n_regionkey",
    ),
    "xml_xpath": ("SELECT n_nationkey, xpath_string(concat('<n><a>', n_name, '</a></n>'), 'n/a') AS a FROM {nation}", "SELECT n_nationkey, n_name AS a FROM nation"),
    # Not by ORDER BY and LIMIT in a LATERAL: Spark sorts the whole table, shuffles it by key, which keeps no order, and numbers the rows as they arrive.
    "lateral_top": (
        "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS rn FROM {customer} JOIN {orders} ON o_custkey = c_custkey) WHERE rn <= 2",
        "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn <= 2",
    ),
    "json_get": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events"),
    "json_variant": ("SELECT event_id, variant_get(parse_json(props), '$.k', 'int') + 1 AS k1 FROM {events}", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER + 1 AS k1 FROM events"),
    "json_recordset": (
        "SELECT event_id, r.k FROM (SELECT event_id, inline(from_json(concat('[', props, ']'), 'array<struct<k:bigint>>')) AS (k) FROM {events}) r",
        "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    ),
    "json_build": ("SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS j FROM {nation}", "SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS j FROM nation"),
    "date_trunc_month": (
        "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month, count(*) AS n FROM {orders} GROUP BY 1",
        "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY 1",
    ),
    "date_arithmetic": (
        "SELECT l_orderkey, l_linenumber, datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS days FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
        "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "date_format": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS ym FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders"),
    "day_of_week": ("SELECT o_orderkey, dayofweek(o_orderdate) - 1 AS dow FROM {orders}", "SELECT o_orderkey, dayofweek(o_orderdate)::INTEGER AS dow FROM orders"),
    "date_bin": (
        "SELECT CAST(timestamp_seconds(CAST(floor(unix_timestamp(CAST(ts AS TIMESTAMP)) / 900) AS BIGINT) * 900) AS TIMESTAMP_NTZ) AS bin, count(*) AS n FROM {events} GROUP BY 1",
        "SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS bin, count(*) AS n FROM events GROUP BY 1",
    ),
    "tumbling_window": (
        "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY window(CAST(ts AS TIMESTAMP), '1 hour')",
        "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    ),
    "array_functions": (
        "SELECT p_partkey, size(w) AS n, element_at(w, 1) AS first, array_join(array_sort(w), '-') AS sorted, array_position(w, 'x') AS at, array_join(slice(w, 1, 2), ' ') AS two FROM (SELECT p_partkey, split(p_name, ' ') AS w FROM {part})",
        "SELECT p_partkey, len(w)::INTEGER AS n, w[1] AS first, array_to_string(list_sort(w), '-') AS sorted, coalesce(list_position(w, 'x'), 0)::BIGINT AS at, array_to_string(w[1:2], ' ') AS two FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
    ),
    "map_functions": (
        "SELECT event_id, map_contains_key(m, 'k') AS has_k, m['k'] AS k, array_join(map_keys(m), ',') AS ks FROM (SELECT event_id, from_json(props, 'map<string,string>') AS m FROM {events})",
        "SELECT event_id, json_exists(props, '$.k') AS has_k, json_extract_string(props, '$.k') AS k, array_to_string(json_keys(props), ',') AS ks FROM events",
    ),
    "encoding_functions": ("SELECT n_nationkey, hex(n_name) AS h, base64(CAST(n_name AS BINARY)) AS b, sha2(n_name, 256) AS s FROM {nation}", "SELECT n_nationkey, hex(n_name) AS h, base64(encode(n_name)) AS b, sha256(n_name) AS s FROM nation"),
    "initcap": ("SELECT n_nationkey, initcap(lower(n_name)) AS c FROM {nation}", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS c FROM nation"),
    "collation_ci": (
        "SELECT CAST(lower(c) AS STRING) COLLATE UTF8_BINARY AS c, n FROM (SELECT s COLLATE UTF8_LCASE AS c, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS s FROM {customer}) GROUP BY s COLLATE UTF8_LCASE)",
        "SELECT lower(c_mktsegment) AS c, count(*) AS n FROM customer GROUP BY 1",
    ),
    "tablesample_rows": ("SELECT count(*) AS n FROM (SELECT * FROM {customer} TABLESAMPLE (100 ROWS))", "SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 100)"),
    "histogram_width_bucket": (
        "SELECT width_bucket(o_totalprice, 0, 500000, 20) AS bucket, count(*) AS n FROM {orders} GROUP BY 1",
        "SELECT (CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000) + 1 END)::BIGINT AS bucket, count(*) AS n FROM orders GROUP BY 1",
    ),
    "pivot": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM {orders}) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1",
    ),
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables(spark, sf_dir, sql)


QUERIES = {name: _query(sql) for name, sql in SHARED_SQL.items()} | {name: _query(pair[0]) for name, pair in PAIRED_SQL.items()}
ORACLE_SQL = {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in SHARED_SQL.items()} | {name: pair[1] for name, pair in PAIRED_SQL.items()}
