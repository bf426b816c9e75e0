"""Governed SQL: one query per category a user can run, in Spark's dialect and in DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.operators.joins import asof_join
from tabulens.operators.ranges import range_join
from tabulens.plans.governed import GovernedSession
from workload.inputs import GAPPY_SQL, gappy_events, table


def _run(*views: str, max_rows: int | None = None):
    """A query over the named tables, read by a governed session of its own."""

    def build(text: str):
        def query(spark: SparkSession, sf: str) -> DataFrame:
            governed = GovernedSession(spark)
            for name in views:
                governed.register(name, lambda session, n=name: table(session, sf, n))
            return governed.frame(text, max_rows)

        return query

    return build


GOVERNED = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey"""

PROJECTION = """SELECT l_returnflag, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'small'
    WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS size_class,
  count(*) AS n, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge
  FROM lineitem WHERE l_linestatus IN ('O', 'F') AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'
    AND l_returnflag NOT LIKE 'N%' AND l_discount IS NOT NULL GROUP BY 1, 2"""

EQUI_JOINS = """SELECT r.r_name, n.n_name, count(c.c_custkey) AS customers,
  count(s.suppliers) AS rows_with_suppliers, round(sum(c.c_acctbal), 2) AS balance
  FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
  LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000
  FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) s
    ON s.s_nationkey = n.n_nationkey
  GROUP BY r.r_name, n.n_name"""

SEMI_ANTI = """SELECT 'with_big_order' AS kind, count(*) AS n FROM customer
  WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
  UNION ALL SELECT 'without_open_order', count(*) FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
  UNION ALL SELECT 'supplied', count(*) FROM part
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"""

THETA = """SELECT b.band, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o
  JOIN (VALUES ('low', 0.0, 100000.0), ('middle', 100000.0, 300000.0), ('high', 300000.0, 1e12))
    AS b(band, lo, hi) ON o.o_totalprice >= b.lo AND o.o_totalprice < b.hi
  GROUP BY b.band"""

RANGE = """SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS orders,
  round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders
  ON l_extendedprice BETWEEN o_totalprice * 0.9995 AND o_totalprice * 1.0005 GROUP BY 1, 2"""

NEARBY = """SELECT p.event_id AS purchase, count(*) AS n, count(DISTINCT e.user_id) AS users,
  count(*) FILTER (WHERE e.event_type = 'error') AS errors FROM events e
  JOIN (SELECT event_id, ts AS begins, ts + INTERVAL 90 SECONDS AS ends FROM events
    WHERE event_type = 'purchase') p ON e.ts >= p.begins AND e.ts < p.ends GROUP BY 1"""


def price_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose price lies within a two-thousandth of an order's total."""
    total = F.col("o_totalprice")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", (total * 0.9995).alias("lo"), (total * 1.0005).alias("hi")
    )
    items = table(spark, sf, "lineitem").select("l_extendedprice")
    totals = {"n": F.lit(1), "total": F.col("l_extendedprice")}
    found = range_join(items, orders, "l_extendedprice", "lo", "hi", totals=totals)
    return found.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.sum("n").alias("n"),
        F.count_distinct("o_orderkey").alias("orders"),
        F.round(F.sum("total"), 2).alias("total"),
    )


def events_nearby(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the 90 seconds from each purchase on."""
    events = table(spark, sf, "events")
    bought = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase"), F.col("ts").alias("begins"), F.expr("ts + INTERVAL 90 SECONDS").alias("ends")
    )
    seen = events.select("ts", "user_id", "event_type")
    totals = {"n": F.lit(1), "errors": F.when(F.col("event_type") == "error", 1).otherwise(0)}
    held = range_join(
        seen, bought, "ts", "begins", "ends", include_high=False, totals=totals, distinct=("users", "user_id")
    )
    found = held.groupBy("purchase").agg(F.sum("n").alias("n"), F.max("users").alias("users"), F.sum("errors").alias("errors"))
    # Rows of one id, or without one, at several times share their users: those are told apart by pairs.
    several = bought.groupBy("purchase").agg(F.min("begins").alias("one"), F.max("begins").alias("other")).where("one < other")
    if several.isEmpty():
        return found
    windows = bought.distinct().join(several.select(F.col("purchase").alias("id")), F.col("purchase").eqNullSafe(F.col("id")))
    pairs = range_join(seen, windows.drop("id"), "ts", "begins", "ends", include_high=False)
    shared = pairs.groupBy(F.col("purchase").alias("id")).agg(F.count_distinct("user_id").alias("shared"))
    return found.join(shared, F.col("purchase").eqNullSafe(F.col("id")), "left").select(
        "purchase", "n", F.coalesce("shared", "users").alias("users"), "errors"
    )


AGGREGATION = """SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS BIGINT) AS flag_rolled,
  count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
  count(*) FILTER (WHERE l_quantity > 25) AS bulky, round(avg(l_extendedprice), 4) AS avg_price
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())
  HAVING count(*) > 10"""

CUBE = """SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY CUBE (p_type, p_brand)"""

WINDOW = """SELECT event_type, day, n, total, last_n, place FROM (
  SELECT event_type, day, n,
    CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total,
    lag(n) OVER (PARTITION BY event_type ORDER BY day) AS last_n,
    CAST(rank() OVER (PARTITION BY event_type ORDER BY n DESC, day) AS INT) AS place
  FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) d) w
  WHERE place <= 10"""

TOP_K = """SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INT) AS place FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) w
  WHERE place <= 2"""

SORT_LIMIT = """SELECT p_partkey, p_name, p_retailprice FROM part
  ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 25"""

SET_OPS = """SELECT 'customer_and_supplier_nations' AS kind, count(*) AS n FROM
    (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500
     INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) a
  UNION ALL SELECT 'nations_without_supplier', count(*) FROM
    (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) b
  UNION ALL SELECT 'all_names', count(*) FROM
    (SELECT c_name FROM customer UNION SELECT s_name FROM supplier) c"""

CTE = """WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS orders_made
    FROM orders GROUP BY o_custkey),
  bar AS (SELECT avg(spent) AS mean_spent FROM totals)
  SELECT c_mktsegment, count(*) AS good_customers, round(avg(spent), 2) AS avg_spent
  FROM customer JOIN totals ON o_custkey = c_custkey
  WHERE spent > (SELECT mean_spent FROM bar)
    AND c_acctbal > (SELECT avg(i.c_acctbal) FROM customer i
                     WHERE i.c_mktsegment = customer.c_mktsegment)
  GROUP BY c_mktsegment"""

SCALAR_SPARK = """SELECT upper(substring(event_type, 1, 3)) AS code, count(*) AS n,
  sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum,
  sum(length(replace(props, ' ', ''))) AS chars,
  sum(datediff(DATE '2024-02-01', to_date(ts))) AS days_left,
  sum(hour(ts)) AS hours, round(sum(sqrt(abs(value)) + floor(value) % 7), 4) AS mixed,
  round(percentile(value, 0.9), 4) AS p90,
  sum(size(split(concat_ws('-', event_type, 'x', CAST(user_id AS STRING)), '-'))) AS parts,
  sum(coalesce(nullif(user_id, 0), -1)) AS users
  FROM events GROUP BY 1"""
SCALAR_DUCK = """SELECT upper(substring(event_type, 1, 3)) AS code, count(*) AS n,
  sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum,
  sum(length(replace(props, ' ', '')))::BIGINT AS chars,
  sum(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'))::BIGINT AS days_left,
  sum(hour(ts))::BIGINT AS hours, round(sum(sqrt(abs(value)) + floor(value) % 7), 4) AS mixed,
  round(quantile_cont(value, 0.9), 4) AS p90,
  sum(len(string_split(concat_ws('-', event_type, 'x', CAST(user_id AS VARCHAR)), '-')))::BIGINT
    AS parts,
  sum(coalesce(nullif(user_id, 0), -1))::BIGINT AS users
  FROM events GROUP BY 1"""

UNNEST_SPARK = """SELECT label, count(*) AS numbers, round(sum(x), 2) AS total,
  count_if(x > 0) AS positive FROM (SELECT label, explode(embedding) AS x FROM embeddings) e
  GROUP BY label"""
UNNEST_DUCK = """SELECT label, count(*) AS numbers, round(sum(x::DOUBLE), 2) AS total,
  count(*) FILTER (x > 0) AS positive
  FROM (SELECT label, unnest(embedding) AS x FROM embeddings) e GROUP BY label"""

PIVOT_SPARK = """SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders)
  PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))"""
PIVOT_DUCK = """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f,
  count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
  FROM orders GROUP BY 1"""

UNPIVOT_SPARK = """SELECT measure, count(*) AS n, round(sum(amount), 2) AS total
  FROM (SELECT l_quantity, l_extendedprice, l_tax FROM lineitem)
  UNPIVOT (amount FOR measure IN (l_quantity, l_extendedprice, l_tax)) GROUP BY measure"""
UNPIVOT_DUCK = """SELECT measure, count(*) AS n, round(sum(amount), 2) AS total
  FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_tax FROM lineitem)
    ON l_quantity, l_extendedprice, l_tax INTO NAME measure VALUE amount) GROUP BY measure"""


def sql_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the same user's last view before it; some users, times and kinds are null."""
    events = gappy_events(spark, sf).withColumn(
        "ts", F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    )
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    viewed = events.where("event_type = 'view'").select(
        "user_id", "ts", F.col("event_id").alias("id")
    )
    return asof_join(bought, viewed, ["user_id"], "ts", right_prefix="view_")


ASOF = f"""WITH gappy AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN ts END AS ts)
  FROM ({GAPPY_SQL}))
  SELECT b.user_id, b.ts, b.event_id, b.value, v.ts AS view_ts, v.event_id AS view_id
  FROM (SELECT * FROM gappy WHERE event_type = 'purchase') b
  ASOF LEFT JOIN (SELECT * FROM gappy WHERE event_type = 'view' AND ts IS NOT NULL) v
  ON b.user_id = v.user_id AND b.ts >= v.ts"""


def governed_result(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of an ad-hoc query under its row cap, each with the flag that the cap cut more off."""
    governed = GovernedSession(spark)
    governed.register("orders", lambda session: table(session, sf, "orders"))
    found = governed.execute(CAPPED, max_rows=CAP, timeout=600)
    if found.error:
        raise ValueError(found.error)
    rows = [(r["o_orderkey"], r["o_custkey"], found.truncated) for r in found.rows]
    return spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, truncated boolean")


CAP = 500
CAPPED = """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1000)
SELECT o_orderkey, o_custkey FROM big ORDER BY o_totalprice DESC, o_orderkey"""
CAPPED_DUCK = f"""SELECT o_orderkey, o_custkey, (SELECT count(*) FROM ({CAPPED})) > {CAP} AS truncated
  FROM ({CAPPED} LIMIT {CAP})"""

QUERIES = {
    "governed_query": _run("orders", max_rows=1000)(GOVERNED),
    "governed_result": governed_result,
    "sql_projection_filter": _run("lineitem")(PROJECTION),
    "sql_equi_joins": _run("region", "nation", "customer", "supplier")(EQUI_JOINS),
    "sql_semi_anti_joins": _run("customer", "orders", "part", "lineitem")(SEMI_ANTI),
    "sql_theta_join": _run("orders")(THETA),
    "sql_asof_join": sql_asof_join,
    "range_join_prices": price_ranges,
    "range_join_times": events_nearby,
    "sql_aggregation": _run("lineitem")(AGGREGATION),
    "sql_cube": _run("part")(CUBE),
    "sql_window": _run("events")(WINDOW),
    "sql_top_k_per_group": _run("orders")(TOP_K),
    "sql_sort_limit": _run("part")(SORT_LIMIT),
    "sql_set_operations": _run("customer", "supplier", "nation")(SET_OPS),
    "sql_subqueries_cte": _run("orders", "customer")(CTE),
    "sql_scalar_functions": _run("events")(SCALAR_SPARK),
    "sql_unnest": _run("embeddings")(UNNEST_SPARK),
    "sql_pivot": _run("orders")(PIVOT_SPARK),
    "sql_unpivot": _run("lineitem")(UNPIVOT_SPARK),
}

ORACLE = {
    "governed_result": CAPPED_DUCK,
    "governed_query": f"SELECT * FROM ({GOVERNED}) LIMIT 1000",
    "sql_projection_filter": PROJECTION,
    "sql_equi_joins": EQUI_JOINS,
    "sql_semi_anti_joins": SEMI_ANTI,
    "sql_theta_join": THETA,
    "sql_asof_join": ASOF,
    "range_join_prices": RANGE,
    "range_join_times": NEARBY,
    "sql_aggregation": AGGREGATION,
    "sql_cube": CUBE,
    "sql_window": WINDOW,
    "sql_top_k_per_group": TOP_K,
    "sql_sort_limit": SORT_LIMIT,
    "sql_set_operations": SET_OPS,
    "sql_subqueries_cte": CTE,
    "sql_scalar_functions": SCALAR_DUCK,
    "sql_unnest": UNNEST_DUCK,
    "sql_pivot": PIVOT_DUCK,
    "sql_unpivot": UNPIVOT_DUCK,
}
