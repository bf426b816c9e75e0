"""Input frames of the registered queries, and the same inputs as SQL for the checks.

The given tables hold no nulls, so null-sensitive queries null some values by one rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events with nulls in four columns.
GAPPY_SQL = """SELECT event_id,
  CASE WHEN event_type <> 'error' THEN ts END AS ts,
  CASE WHEN user_id >= 30 THEN user_id END AS user_id,
  nullif(event_type, 'click') AS event_type,
  CASE WHEN value >= 15 THEN value END AS value,
  props FROM events"""
GAPPY_COLUMNS = [
    ("event_id", "integer"), ("ts", "temporal"), ("user_id", "integer"), ("event_type", "string"),
    ("value", "float"), ("props", "string"),
]


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"),
        F.when(F.col("user_id") >= 30, F.col("user_id")).alias("user_id"),
        F.nullif("event_type", F.lit("click")).alias("event_type"),
        F.when(F.col("value") >= 15, F.col("value")).alias("value"),
        "props",
    )


# Events of which most cells are null: one measure per kind of event.
SPARSE_SQL = """SELECT event_id, event_type,
  CASE WHEN event_type = 'view' THEN user_id END AS viewer,
  CASE WHEN event_type = 'purchase' THEN value END AS paid,
  CASE WHEN event_type = 'error' THEN ts END AS failed_at FROM events"""
SPARSE_COLUMNS = [
    ("event_id", "integer"), ("event_type", "string"), ("viewer", "integer"), ("paid", "float"),
    ("failed_at", "temporal"),
]


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(kind == "view", F.col("user_id")).alias("viewer"),
        F.when(kind == "purchase", F.col("value")).alias("paid"),
        F.when(kind == "error", F.col("ts")).alias("failed_at"),
    )


# Line items renamed and reshaped so that every name, type, null and issue rule has a case.
SHOP_SQL = """SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS part_ref,
  CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_shipdate AS ship_date, l_extendedprice AS price,
  CASE WHEN l_discount <> 0.05 THEN l_discount END AS discount,
  CASE WHEN l_linenumber = 1 THEN l_quantity END AS gk_saves,
  CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS promo,
  CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'no' END AS paid,
  l_quantity > 25 AS bulky, 'EUR' AS currency, l_linenumber AS "weekNo",
  CASE WHEN l_suppkey >= 10 THEN l_suppkey END AS "vendorCode" FROM lineitem"""
SHOP_COLUMNS = [
    ("order_id", "integer"), ("part_ref", "string"), ("ship_year", "integer"),
    ("ship_date", "temporal"), ("price", "float"), ("discount", "float"), ("gk_saves", "float"),
    ("promo", "string"), ("paid", "string"), ("bulky", "boolean"), ("currency", "string"),
    ("weekNo", "integer"), ("vendorCode", "integer"),
]


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("order_id"),
        c("l_partkey").cast("string").alias("part_ref"),
        F.year("l_shipdate").alias("ship_year"),
        c("l_shipdate").alias("ship_date"),
        c("l_extendedprice").alias("price"),
        F.when(c("l_discount") != 0.05, c("l_discount")).alias("discount"),
        F.when(c("l_linenumber") == 1, c("l_quantity")).alias("gk_saves"),
        F.when(c("l_returnflag") == "R", c("l_linestatus")).alias("promo"),
        F.when(c("l_linestatus") == "F", "Yes").otherwise("no").alias("paid"),
        (c("l_quantity") > 25).alias("bulky"),
        F.lit("EUR").alias("currency"),
        c("l_linenumber").alias("weekNo"),
        F.when(c("l_suppkey") >= 10, c("l_suppkey")).alias("vendorCode"),
    )


ORDERS_COLUMNS = [
    ("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
    ("o_totalprice", "float"), ("o_orderdate", "temporal"), ("o_orderpriority", "string"),
]
LINEITEM_COLUMNS = [
    ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
    ("l_linenumber", "integer"), ("l_quantity", "float"), ("l_extendedprice", "float"),
    ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "temporal"),
]
CONVERSATIONS_COLUMNS = [
    ("conv_id", "integer"), ("turn", "integer"), ("role", "string"), ("text", "string"),
]
CUSTOMER_COLUMNS = [
    ("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
    ("c_acctbal", "float"), ("c_mktsegment", "string"),
]
