"""Chart plans: filters, aggregates, buckets and each chart shape over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.plans import charts
from tabulens.plans.chart_spec import AGGREGATIONS, ChartFilter, ChartSpec, filter_condition
from tabulens.plans.profile import infer_structure
from workload.inputs import GAPPY_SQL, gappy_events, table

FILTERS = {
    "eq": ChartFilter("event_type", "eq", "view"),
    "neq": ChartFilter("event_type", "neq", "view"),
    "gt": ChartFilter("value", "gt", "50.5"),
    "gte": ChartFilter("user_id", "gte", "100"),
    "lt": ChartFilter("ts", "lt", "2024-01-15"),
    "lte": ChartFilter("value", "lte", "20"),
    "contains": ChartFilter("props", "contains", ' "K": 6'),
    "starts_with": ChartFilter("event_type", "starts_with", "PUR"),
    "in": ChartFilter("user_id", "in", "31, 32,77 , "),
    "is_null": ChartFilter("value", "is_null"),
    "is_not_null": ChartFilter("event_type", "is_not_null"),
    "ignored": ChartFilter("value", "eq", "  "),
}
FILTER_SQL = {
    "eq": "event_type = 'view'",
    "neq": "event_type <> 'view'",
    "gt": "value > 50.5",
    "gte": "user_id >= 100",
    "lt": "ts < '2024-01-15'",
    "lte": "value <= 20",
    "contains": "contains(lower(CAST(props AS VARCHAR)), lower('\"K\": 6'))",
    "starts_with": "starts_with(lower(CAST(event_type AS VARCHAR)), lower('PUR'))",
    "in": "user_id IN (31, 32, 77)",
    "is_null": "value IS NULL",
    "is_not_null": "event_type IS NOT NULL",
    "ignored": "TRUE",
}


def chart_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows each filter keeps, all filters in one pass."""
    rows = gappy_events(spark, sf)
    kept = {name: filter_condition(rows, f) for name, f in FILTERS.items()}
    return rows.agg(
        *[
            (F.count("*") if cond is None else F.count_if(cond)).alias(f"rows_{name}")
            for name, cond in kept.items()
        ]
    )


def chart_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    rows = gappy_events(spark, sf).where("event_type is not null")
    frames = []
    for name in AGGREGATIONS[1:]:
        one = charts.chart_aggregate(rows, ["event_type"], {name: "value"}, name)
        frames.append(one.withColumn(name, F.round(F.col(name).cast("double"), 4)))
    return reduce(lambda a, b: a.join(b, "event_type"), frames)


AGGREGATE = f"""SELECT event_type, round(sum(value), 4) AS sum, round(avg(value), 4) AS avg,
  round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median,
  round(stddev_samp(value), 4) AS stddev, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.75), 4) AS p75, count(value)::DOUBLE AS count,
  count(DISTINCT value)::DOUBLE AS count_distinct FROM ({GAPPY_SQL})
  WHERE event_type IS NOT NULL GROUP BY event_type"""


def _line(**changes) -> ChartSpec:
    base = {
        "chart_type": "line", "x_column": "o_orderdate", "x_bucketable": True,
        "y_columns": ("o_totalprice",), "aggregation": "avg", "bucket": "month",
    }
    return ChartSpec(**{**base, **changes})


def time_bucket(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    parts = [
        charts.line_chart(orders, _line(bucket=b, aggregation="count")).select(
            F.lit(b).alias("bucket"), "x", F.col("o_totalprice").alias("n")
        )
        for b in ("day", "week", "month", "quarter", "year")
    ]
    return reduce(DataFrame.unionByName, parts)


BUCKETS = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{b}' AS bucket, date_trunc('{b}', o_orderdate)::TIMESTAMP AS x,
    count(o_totalprice) AS n FROM orders GROUP BY 2 ORDER BY 2 LIMIT 5000)"""
    for b in ("day", "week", "month", "quarter", "year")
)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


def histogram_split(spark: SparkSession, sf: str) -> DataFrame:
    spec = ChartSpec("histogram", value_column="p_size", bin_count=8, split_by="p_type")
    return charts.histogram_chart(table(spark, sf, "part"), spec)


def _int_bins(table_name: str, column: str, bins: int, split: str = "") -> str:
    key = ", split" if split else ""
    grid = (
        f"bins CROSS JOIN (SELECT DISTINCT CAST({split} AS VARCHAR) AS split FROM {table_name})"
        if split else "bins"
    )
    match = " AND r.split = g.split" if split else ""
    row_split = f", CAST({split} AS VARCHAR) AS split" if split else ""
    return f"""WITH s AS (SELECT min({column})::BIGINT AS lo, max({column})::BIGINT AS hi
      FROM {table_name}), shape AS (SELECT *, least({bins}, hi - lo + 1) AS k FROM s),
    bins AS (SELECT i::INTEGER AS bin_index,
      lo + i * ((hi - lo + 1) // k) + least(i, (hi - lo + 1) % k) AS lower_bound,
      lo + (i + 1) * ((hi - lo + 1) // k) + least(i + 1, (hi - lo + 1) % k) - 1 AS upper_bound
      FROM shape, range(k) r(i)), g AS (SELECT * FROM {grid}),
    r AS (SELECT {column} AS v{row_split} FROM {table_name})
    SELECT g.bin_index, g.lower_bound, g.upper_bound{", g.split" if split else ""},
      count(r.v) AS count FROM g LEFT JOIN r ON r.v BETWEEN g.lower_bound AND g.upper_bound{match}
    GROUP BY ALL ORDER BY bin_index{key} LIMIT 5000"""


FLOAT_CHART = """WITH rows AS (SELECT l_extendedprice AS v FROM lineitem
    WHERE l_returnflag = 'R'), s AS (SELECT min(v) AS lo, max(v) AS hi FROM rows),
  counted AS (SELECT least(19, greatest(0, CAST(floor((v - lo) / (hi - lo) * 20) AS INTEGER))) AS b,
    count(*) AS c FROM rows, s GROUP BY 1)
  SELECT i::INTEGER AS bin_index, round(lo + (hi - lo) / 20 * i, 4) AS lower_bound,
    round(lo + (hi - lo) / 20 * (i + 1), 4) AS upper_bound, coalesce(c, 0) AS count
  FROM s, range(20) r(i) LEFT JOIN counted ON b = i"""


def histogram_float_chart(spark: SparkSession, sf: str) -> DataFrame:
    spec = ChartSpec(
        "histogram", value_column="l_extendedprice", bin_count=20,
        filters=(ChartFilter("l_returnflag", "eq", "R"),),
    )
    return _rounded(
        charts.histogram_chart(table(spark, sf, "lineitem"), spec), "lower_bound", "upper_bound"
    )


def chart_pivot(spark: SparkSession, sf: str) -> DataFrame:
    spec = _line(bucket="quarter", aggregation="sum", split_by="o_orderstatus")
    series = charts.line_chart(table(spark, sf, "orders"), spec)
    return _rounded(charts.chart_pivot(series), "F", "O", "P")


PIVOT = """SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS x,
  round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F,
  round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O,
  round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1"""


def auto_chart(spark: SparkSession, sf: str) -> DataFrame:
    """The default chart of orders: a histogram of its best measure."""
    orders = table(spark, sf, "orders")
    drawn = charts.auto_chart(orders, infer_structure(orders, "orders"))
    return _rounded(drawn, "lower_bound", "upper_bound")


AUTO = """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
  counted AS (SELECT least(11, CAST(floor((o_totalprice - lo) / (hi - lo) * 12) AS INTEGER)) AS b,
    count(*) AS c FROM orders, s GROUP BY 1)
  SELECT i::INTEGER AS bin_index, round(lo + (hi - lo) / 12 * i, 4) AS lower_bound,
    round(lo + (hi - lo) / 12 * (i + 1), 4) AS upper_bound, coalesce(c, 0) AS count
  FROM s, range(12) r(i) LEFT JOIN counted ON b = i"""

QUERIES = {
    "chart_filter": chart_filter,
    "chart_aggregate": chart_aggregate,
    "time_bucket": time_bucket,
    "line_aggregate": lambda s, d: _rounded(
        charts.chart_frame(
            table(s, d, "orders"), _line(y_columns=("o_totalprice", "o_custkey"),
                                         aggregation="median")
        ),
        "o_totalprice", "o_custkey",
    ),
    "line_raw": lambda s, d: charts.chart_frame(
        table(s, d, "orders"), _line(aggregation="none", y_columns=("o_totalprice", "o_orderkey"))
    ),
    "line_split": lambda s, d: _rounded(
        charts.chart_frame(table(s, d, "orders"), _line(split_by="o_orderstatus")), "value"
    ),
    "histogram_float_chart": histogram_float_chart,
    "histogram_int_chart": lambda s, d: charts.chart_frame(
        table(s, d, "lineitem"), ChartSpec("histogram", value_column="l_orderkey", bin_count=100)
    ),
    "histogram_split": histogram_split,
    "bar_top_n": lambda s, d: charts.chart_frame(
        table(s, d, "part"), ChartSpec("bar", x_column="p_brand", aggregation="count", top_n=10)
    ),
    "bar_measure": lambda s, d: _rounded(
        charts.chart_frame(
            table(s, d, "lineitem"),
            ChartSpec("bar", x_column="l_suppkey", y_columns=("l_extendedprice",),
                      aggregation="median", top_n=25),
        ),
        "l_extendedprice",
    ),
    "bar_split": lambda s, d: charts.chart_frame(
        table(s, d, "customer"),
        ChartSpec("bar", x_column="c_nationkey", aggregation="count", split_by="c_mktsegment",
                  top_n=5),
    ),
    "bar_split_measure": lambda s, d: _rounded(
        charts.chart_frame(
            table(s, d, "orders"),
            ChartSpec("bar", x_column="o_orderpriority", y_columns=("o_totalprice",),
                      aggregation="avg", split_by="o_orderstatus", top_n=3),
        ),
        "value",
    ),
    "scatter": lambda s, d: charts.chart_frame(
        table(s, d, "lineitem"),
        ChartSpec("scatter", x_column="l_quantity", y_columns=("l_extendedprice",)),
    ),
    "scatter_split": lambda s, d: charts.chart_frame(
        table(s, d, "part"),
        ChartSpec("scatter", x_column="p_size", y_columns=("p_retailprice",), split_by="p_type"),
    ),
    "chart_pivot": chart_pivot,
    "auto_chart": auto_chart,
}

ORACLE = {
    "chart_filter": "SELECT "
    + ", ".join(f"count(*) FILTER ({c}) AS rows_{n}" for n, c in FILTER_SQL.items())
    + f" FROM ({GAPPY_SQL})",
    "chart_aggregate": AGGREGATE,
    "time_bucket": BUCKETS,
    "line_aggregate": """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x,
      round(median(o_totalprice), 4) AS o_totalprice, round(median(o_custkey), 4) AS o_custkey
      FROM orders GROUP BY 1 ORDER BY 1 LIMIT 5000""",
    "line_raw": """SELECT o_orderdate AS x, o_totalprice, o_orderkey FROM orders
      ORDER BY 1, 2, 3 LIMIT 5000""",
    "line_split": """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x,
      o_orderstatus AS split, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2
      ORDER BY 1, 2 LIMIT 5000""",
    "histogram_float_chart": FLOAT_CHART,
    "histogram_int_chart": _int_bins("lineitem", "l_orderkey", 100),
    "histogram_split": _int_bins("part", "p_size", 8, "p_type"),
    "bar_top_n": """SELECT p_brand AS x, count(*) AS count FROM part GROUP BY 1
      ORDER BY count DESC, x LIMIT 10""",
    "bar_measure": """SELECT CAST(l_suppkey AS VARCHAR) AS x,
      round(median(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1
      ORDER BY median(l_extendedprice) DESC, x LIMIT 25""",
    "bar_split": """WITH top AS (SELECT CAST(c_nationkey AS VARCHAR) AS x FROM customer GROUP BY 1
      ORDER BY count(*) DESC, x LIMIT 5) SELECT CAST(c_nationkey AS VARCHAR) AS x,
      c_mktsegment AS split, count(*) AS count FROM customer
      WHERE CAST(c_nationkey AS VARCHAR) IN (SELECT x FROM top) GROUP BY 1, 2""",
    "bar_split_measure": """WITH top AS (SELECT o_orderpriority AS x FROM orders GROUP BY 1
      ORDER BY avg(o_totalprice) DESC, x LIMIT 3) SELECT o_orderpriority AS x,
      o_orderstatus AS split, round(avg(o_totalprice), 4) AS value FROM orders
      WHERE o_orderpriority IN (SELECT x FROM top) GROUP BY 1, 2""",
    "scatter": """SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
      ORDER BY 1, 2 LIMIT 5000""",
    "scatter_split": """SELECT p_size AS x, p_retailprice AS y, p_type AS split FROM part
      ORDER BY 1, 3, 2 LIMIT 5000""",
    "chart_pivot": PIVOT,
    "auto_chart": AUTO,
}
