"""The SQL surface: one query per family a user may write over datasets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.regexes import register_sql
from gridweave.operators import reshape, sequence
from gridweave.operators.ranges import band_join
from gridweave.session import settle

from . import derived, query, table


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run a statement over the given tables, bound by name."""
    names = set(re.findall(r"\{([a-z]\w*)\}", text))
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def both(name: str, text: str, duck: str | None = None) -> None:
    """A statement both engines run as it stands, but for table binding."""
    def run(spark, sf, text=text):
        return sql(spark, sf, text)
    query(name, re.sub(r"\{(\w+)\}", r"\1", duck or text))(run)


@query("q01_query", """
    WITH r AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT count(*) AS row_count, false AS truncated FROM r""")
def q01(spark, sf):
    datasets = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    _, info = reshape.query(spark, datasets, """
        SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY 1, 2""")
    return info


@query("q01_query_truncated", "SELECT least(count(*), 5000) AS row_count, count(*) > 5000 AS truncated FROM orders")
def q01b(spark, sf):
    _, info = reshape.query(spark, {"orders": table(spark, sf, "orders")}, "SELECT o_orderkey FROM {orders}", max_rows=5000)
    return info.select(F.col("row_count").cast("bigint").alias("row_count"), "truncated")


for how in ("inner", "left", "right", "full"):
    both(f"q02_join_{how}", f"""
        SELECT coalesce(c_mktsegment, 'none') AS segment, count(c_custkey) AS customers, count(o_orderkey) AS orders
        FROM {{customer}} {how.upper() + (' OUTER' if how != 'inner' else '')} JOIN (SELECT * FROM {{orders}} WHERE o_totalprice > 250000) o ON o_custkey = c_custkey + 40 GROUP BY 1""")


@query("q03_theta_join", """
    SELECT b.band, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN bands b ON l_extendedprice >= b.lo AND l_extendedprice < b.hi GROUP BY 1""", uses=("bands",))
def q03(spark, sf):
    out = band_join(table(spark, sf, "lineitem"), "l_extendedprice", derived(spark, sf, "bands"), "lo", "hi")
    return out.groupBy("band").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("q03_interval_join", """
    SELECT p_brand, count(*) AS n FROM part JOIN (SELECT s_suppkey, abs(s_acctbal) / 10 + 900 AS lo, abs(s_acctbal) / 10 + 905 AS hi FROM supplier) s
    ON p_retailprice >= lo AND p_retailprice < hi GROUP BY 1""")
def q03b(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 10 + 900).alias("lo"), (F.abs("s_acctbal") / 10 + 905).alias("hi"))
    return band_join(table(spark, sf, "part").select("p_brand", "p_retailprice"), "p_retailprice", s, "lo", "hi").groupBy("p_brand").agg(F.count("*").alias("n"))


both("q04_semi_exists", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
both("q04_anti_not_exists", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
both("q04_in", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey IN (1, 3))")
both("q05_scalar_subquery", "SELECT p_partkey, p_retailprice FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})")
both("q05_correlated_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice >= (SELECT max(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
both("q06_aggregates", """
    SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount,
           min(l_shipdate) = max(l_shipdate) AS one_day, count(*) FILTER (WHERE l_linestatus = 'F') AS finished, coalesce(sum(CASE WHEN l_quantity > 1000 THEN l_quantity END), 0.0e0) AS total
    FROM {lineitem} GROUP BY l_returnflag HAVING count(*) > 10""")
both("q06_group_concat", """
    SELECT c_mktsegment, listagg(DISTINCT n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY c_mktsegment""",
     "SELECT c_mktsegment, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS names FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment")
both("q07_bare_column_of_max", """
    SELECT o_custkey, max(struct(o_totalprice, -o_orderkey)).o_totalprice AS price, max_by(o_orderkey, struct(o_totalprice, -o_orderkey)) AS o_orderkey FROM {orders} GROUP BY o_custkey""",
     "SELECT o_custkey, o_totalprice AS price, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")


@query("q08_window_ranking", """
    SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS row_number,
      rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS ntile,
      percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)""")
def q08(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey")
    out = sequence.rank_rows(li, ["l_suppkey"], "l_extendedprice", ties=["l_orderkey", "l_linenumber", "l_partkey"], buckets=4)
    return out.drop("l_extendedprice", "l_partkey").withColumn("ntile", F.col("ntile").cast("bigint"))


@query("q08_hot_ranking", """
    SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_linenumber, l_orderkey, l_partkey, l_suppkey) AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
      cume_dist() OVER w AS cume_dist FROM lineitem WINDOW w AS (ORDER BY l_linenumber)""")
def q08b(spark, sf):
    """A handful of order values and no key: every value is cut into blocks of its own."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = sequence.rank_rows(li, [], "l_linenumber", ties=["l_orderkey", "l_partkey", "l_suppkey"])
    return out.drop("l_suppkey", "percent_rank").withColumn("dense_rank", F.col("dense_rank").cast("bigint"))


@query("q09_wide_frames", """
    SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS total, count(v) OVER w AS n, min(v) OVER w AS low, max(v) OVER w AS high
    FROM (SELECT event_id, event_type, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS BIGINT) END AS v FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 4000 PRECEDING AND 500 FOLLOWING)""")
def q09d(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.floor("value").cast("bigint")).alias("v"))
    return sequence.rolling_totals(e, ["event_type"], "event_id", {"total": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "high": ("max", "v")},
                                   back=4000, ahead=500).select("event_id", "total", "n", "low", "high")


@query("q09_lag_lead", """
    SELECT event_id, lag(value) OVER w AS previous, lead(value) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def q09(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    back = sequence.neighbours(e, ["user_id"], "event_id", {"previous": "value"})
    return sequence.neighbours(back, ["user_id"], "event_id", {"following": "value"}, ahead=True).select("event_id", "previous", "following")


@query("q09_running_sum", """
    SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS so_far, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events""")
def q09b(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return sequence.running(e, ["user_id"], "event_id", {"so_far": F.floor("value").cast("bigint"), "nth": F.lit(1).cast("bigint")}).select("event_id", "so_far", "nth")


@query("q09_frames", """
    WITH e AS (SELECT event_id, user_id, value, CAST(floor(event_id / 50) AS BIGINT) AS slot FROM events)
    SELECT event_id, first_value(value) OVER w AS first_v, last_value(value) OVER w AS last_v, nth_value(value, 2) OVER w AS second_v,
      round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near_rows,
      round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 300 PRECEDING AND CURRENT ROW), 6) AS near_range,
      round(sum(value) OVER (PARTITION BY user_id ORDER BY slot GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS near_groups
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def q09c(spark, sf):
    """ROWS, RANGE and GROUPS frames, and first, last and n-th values."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.floor(F.col("event_id") / 50).cast("bigint").alias("slot"))
    e = settle(sequence.number_rows(e, "event_id", "rn", keys=["user_id"]), "numbered")
    ends = e.groupBy("user_id").agg(F.min_by("value", "rn").alias("first_v"), F.max_by("value", "rn").alias("last_v"),
                                    F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("second_v"))
    rows = sequence.rolling(e, ["user_id"], "rn", {"near_rows": F.sum("value")}, back=2, ahead=1)
    both_frames = sequence.rolling(rows, ["user_id"], "event_id", {"near_range": F.sum("value")}, back=300)
    groups = settle(sequence.rank_rows(both_frames, ["user_id"], "slot", ties=["event_id"]).drop("row_number", "rank", "percent_rank", "cume_dist"), "ranked")
    framed = sequence.rolling(groups, ["user_id"], "dense_rank", {"near_groups": F.sum("value")}, back=1)
    return framed.join(ends, "user_id").select("event_id", "first_v", "last_v", "second_v", *[F.round(c, 6).alias(c) for c in ("near_rows", "near_range", "near_groups")])


both("q10_cte", """
    WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12), named AS (SELECT c_name, n FROM big JOIN {customer} ON c_custkey = o_custkey)
    SELECT c_name, n FROM named""")
RECURSIVE = """
    WITH RECURSIVE chain(page_id, url, depth) AS (SELECT page_id, url, 0 FROM {pages} WHERE page_id % 10 = 0
      UNION ALL SELECT p.page_id, p.url, c.depth + 1 FROM chain c JOIN {pages} p ON p.page_id = c.page_id + 1 WHERE c.depth < 4)
    SELECT page_id, url, depth FROM chain"""


@query("q10_recursive_cte", RECURSIVE.replace("{pages}", "pages"))
def q10(spark, sf):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")    # the default stops at a million rows
    try:
        return settle(sql(spark, sf, RECURSIVE), "recursive")
    finally:
        spark.conf.set(limit, before)


both("q11_set_operations", """
    SELECT n_nationkey AS k FROM {nation} EXCEPT (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9000 AND c_nationkey % 3 = 0 INTERSECT SELECT s_nationkey FROM {supplier})""")
both("q12_order_limit_offset_distinct", "SELECT DISTINCT p_brand, p_type FROM {part} ORDER BY p_brand, p_type LIMIT 40 OFFSET 5")
both("q13_conditionals", """
    SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size, if(p_size % 2 = 0, 'even', 'odd') AS parity, coalesce(nullif(p_brand, 'Brand#1'), 'first') AS brand,
           ifnull(nullif(p_type, 'SMALL'), '-') AS type, p_size IN (1, 5, 9) AS listed, p_size BETWEEN 10 AND 20 AS mid, p_name LIKE '%red%' AS red, p_name RLIKE '^s[a-z]* .*$' AS globbed FROM {part}""",
     """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size, if(p_size % 2 = 0, 'even', 'odd') AS parity, coalesce(nullif(p_brand, 'Brand#1'), 'first') AS brand,
           ifnull(nullif(p_type, 'SMALL'), '-') AS type, p_size IN (1, 5, 9) AS listed, p_size BETWEEN 10 AND 20 AS mid, p_name LIKE '%red%' AS red, p_name GLOB 's* *' AS globbed FROM part""")
both("q14_json_extract", """
    SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, try_variant_get(parse_json(props), '$.none', 'string') AS none, json_array_length(concat('[', props, ',1,2]')) AS n FROM {events}""",
     """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS none, 3 AS n FROM events""")


@query("q14_json_each", """
    SELECT k AS key, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'k' AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events UNION ALL SELECT event_type, event_id FROM events) GROUP BY 1""")
def q14b(spark, sf):
    e = table(spark, sf, "events")
    doc = F.concat(F.substring("props", F.lit(1), F.length("props") - 1), F.lit(', "'), "event_type", F.lit('": '), F.col("event_id").cast("string"), F.lit("}"))
    each = e.select(F.explode(F.from_json(doc, "map<string,bigint>")).alias("key", "v"))
    return each.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


both("q14_json_group", """
    SELECT o_custkey, to_json(sort_array(collect_set(o_orderpriority))) AS priorities FROM {orders} GROUP BY o_custkey""",
     """SELECT o_custkey, '["' || string_agg(DISTINCT o_orderpriority, '","' ORDER BY o_orderpriority) || '"]' AS priorities FROM orders GROUP BY o_custkey""")
both("q15_date_time", """
    SELECT o_orderkey, CAST(date_format(o_orderdate, 'yyyy-MM-dd') AS STRING) AS day, date_format(o_orderdate, 'yyyy/MM HH:mm') AS month, timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) AS epoch,
           timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) / 86400.0e0 + 2440587.5e0 AS julian, year(o_orderdate) AS y, dayofyear(o_orderdate) AS doy, CAST(date_add(o_orderdate, 30) AS STRING) AS later FROM {orders}""",
     """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y/%m %H:%M') AS month, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, epoch(o_orderdate) / 86400.0e0 + 2440587.5e0 AS julian,
           year(o_orderdate) AS y, dayofyear(o_orderdate) AS doy, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS later FROM orders""")
both("q16_strings", """
    SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, trim(concat('  ', p_name, ' ')) AS trimmed, substr(p_name, -3) AS ending, instr(p_name, 'e') AS at, length(p_name) AS n, replace(p_name, 'e', 'E') AS swapped,
           format_string('%05d/%s', p_partkey, p_brand) AS printed, hex(p_brand) AS hexed, ascii(p_name) AS code, char(65 + p_partkey % 26) AS letter FROM {part}""",
     """SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, trim(concat('  ', p_name, ' ')) AS trimmed, right(p_name, 3) AS ending, instr(p_name, 'e') AS at, length(p_name) AS n, replace(p_name, 'e', 'E') AS swapped,
           printf('%05d/%s', p_partkey, p_brand) AS printed, hex(p_brand) AS hexed, ascii(p_name) AS code, chr(CAST(65 + p_partkey % 26 AS INT)) AS letter FROM part""")
both("q17_math", """
    SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, power(s_nationkey, 2) AS p, round(ln(1 + s_suppkey), 6) AS l,
           round(log10(1 + s_suppkey), 6) AS l10, s_suppkey % 7 AS m, CAST(sign(s_acctbal) AS INT) AS sg, greatest(s_suppkey, 50) AS g, CASE WHEN s_nationkey = 0 THEN NULL ELSE least(s_suppkey, s_nationkey) END AS le, s_suppkey div 7 AS d, try_divide(s_suppkey, s_nationkey) AS tq FROM {supplier}""",
     """SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, CAST(pow(s_nationkey, 2) AS DOUBLE) AS p, round(ln(1 + s_suppkey), 6) AS l,
           round(log10(1 + s_suppkey), 6) AS l10, s_suppkey % 7 AS m, CAST(sign(s_acctbal) AS INT) AS sg, greatest(s_suppkey, 50) AS g, CASE WHEN s_nationkey = 0 THEN NULL ELSE least(s_suppkey, s_nationkey) END AS le, s_suppkey // 7 AS d, s_suppkey / nullif(s_nationkey, 0) AS tq FROM supplier""")


@query("q18_sampling")
def q18(spark, sf):
    return table(spark, sf, "orders").sample(0.1, seed=7).select("o_orderkey", F.rand(7).alias("r"))


@query("u04_sql_functions", r"""
    SELECT page_id, regexp_matches(url, '^https') AS secure, CASE WHEN regexp_matches(url, '/([a-z]{2})/') THEN regexp_extract(url, '/([a-z]{2})/', 1) END AS lang,
           regexp_replace(url, '[?#].*$', '', 'g') AS bare FROM pages""")
def u04(spark, sf):
    register_sql(spark)
    return sql(spark, sf, r"""SELECT page_id, re_match('^https', url) AS secure, re_extract(url, '/([a-z]{{2}})/', 1) AS lang, re_replace(url, '[?#].*$', NULL) AS bare FROM {pages}""")
