"""Column metrics, histograms, structure, quality: each operator over a whole table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.operators import columns as cols
from tabulens.operators import grain, quality, semantics, structure
from tabulens.operators.columns import column_facts
from tabulens.operators.duplicates import duplicate_row_pct
from tabulens.operators.histograms import profile_histograms
from tabulens.operators.keys import minimal_keys
from tabulens.plans.profile import infer_structure, profile
from tabulens.plans.profile import sampled_profile as sampled_profile_of
from tabulens.session import small_frame, together
from workload import check_sql as sql
from workload.inputs import (
    CONVERSATIONS_COLUMNS,
    GAPPY_COLUMNS,
    GAPPY_SQL,
    LINEITEM_COLUMNS,
    ORDERS_COLUMNS,
    SHOP_COLUMNS,
    SHOP_SQL,
    SPARSE_COLUMNS,
    SPARSE_SQL,
    gappy_events,
    shop,
    sparse_events,
    table,
)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- column metrics -----------------------------------------------------------------------------


def numeric_describe(spark: SparkSession, sf: str) -> DataFrame:
    found = cols.numeric_describe(table(spark, sf, "lineitem"))
    return _rounded(found, 4, "mean", "std", "p25", "median", "p75")


DESCRIBE = " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS column_name, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}::DOUBLE), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
    round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
    round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM lineitem"""
    for i, (c, kind) in enumerate(LINEITEM_COLUMNS)
    if kind in ("integer", "float")
)


def datetime_median(spark: SparkSession, sf: str) -> DataFrame:
    orders = cols.datetime_median(table(spark, sf, "orders"))
    events = cols.datetime_median(gappy_events(spark, sf))
    return orders.unionByName(events)


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the largest table: keys, doubles, texts and dates."""
    return cols.top_values(table(spark, sf, "lineitem"))


def top_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts: whole documents and web pages, by count and then by text."""
    documents = cols.top_values(table(spark, sf, "documents"), columns=["text", "lang"])
    pages = cols.top_values(table(spark, sf, "pages"), columns=["html"])
    return documents.unionByName(pages)


def _top_sql(source: str, columns: list[tuple[int, str]], k: int) -> str:
    parts = [
        f"""SELECT {i} AS ordinal, '{c}' AS column_name,
        CAST(row_number() OVER (ORDER BY n DESC, v NULLS LAST) AS INTEGER) AS rank, v AS value,
        n AS value_count FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM src GROUP BY 1)
        QUALIFY rank <= {k}"""
        for i, c in columns
    ]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


TOP_VALUE = (
    f"WITH src AS ({GAPPY_SQL}) "
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT {i} AS ordinal, '{c}' AS column_name,
        coalesce(CAST({c} AS VARCHAR), '(null)') AS top_value, count(*) AS top_count,
        round(count(*) * 100.0 / (SELECT count(*) FROM src), 4)::DOUBLE AS top_pct
        FROM src GROUP BY {c} ORDER BY top_count DESC, CAST({c} AS VARCHAR) NULLS LAST LIMIT 1)"""
        for i, (c, kind) in enumerate(GAPPY_COLUMNS)
        if kind in ("temporal", "string")
    )
)


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Shares over three columns, where rows repeat, and over all columns."""
    rows = gappy_events(spark, sf)
    some = rows.select("user_id", "event_type", F.floor("value").cast("bigint").alias("units"))
    twice = rows.unionAll(rows.where("event_type = 'purchase'"))
    frames = {"some columns": some, "all columns": rows, "some rows twice": twice}
    found = [duplicate_row_pct(df).withColumn("rows_of", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, found)


DUPLICATES = " UNION ALL ".join(
    f"""SELECT sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows,
    round(coalesce(sum(n) FILTER (n > 1), 0) * 100.0 / sum(n), 4)::DOUBLE AS duplicate_row_pct,
    '{name}' AS rows_of FROM (SELECT count(*) AS n FROM ({source}) GROUP BY {columns})"""
    for name, source, columns in (
        ("some columns", f"SELECT user_id, event_type, floor(value) AS units FROM ({GAPPY_SQL})",
         "user_id, event_type, units"),
        ("all columns", GAPPY_SQL, ", ".join(c for c, _ in GAPPY_COLUMNS)),
        ("some rows twice",
         f"{GAPPY_SQL} UNION ALL SELECT * FROM ({GAPPY_SQL}) WHERE event_type = 'purchase'",
         ", ".join(c for c, _ in GAPPY_COLUMNS)),
    )
)

UNIQUE = " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS column_name,
    count(DISTINCT {c}) + (count(*) > count({c}))::INT AS unique_count,
    round((count(DISTINCT {c}) + (count(*) > count({c}))::INT) * 100.0 / count(*), 4)::DOUBLE
      AS unique_pct FROM lineitem"""
    for i, (c, _) in enumerate(LINEITEM_COLUMNS)
)


def min_max(spark: SparkSession, sf: str) -> DataFrame:
    return cols.min_max(gappy_events(spark, sf)).drop("min_value", "max_value")


MIN_MAX = f"WITH src AS ({GAPPY_SQL}) " + " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS column_name,
    {f"min({c})::DOUBLE" if kind != "temporal" else "NULL::DOUBLE"} AS min_num,
    {f"max({c})::DOUBLE" if kind != "temporal" else "NULL::DOUBLE"} AS max_num,
    {f"min({c})" if kind == "temporal" else "NULL::TIMESTAMP"} AS min_time,
    {f"max({c})" if kind == "temporal" else "NULL::TIMESTAMP"} AS max_time FROM src"""
    for i, (c, kind) in enumerate(GAPPY_COLUMNS)
    if kind != "string"
)


def _bins(df: DataFrame) -> DataFrame:
    return _rounded(df, 4, "lower_bound", "upper_bound")


def _int_bins(ordinal: int, c: str) -> str:
    return f"""WITH s AS (SELECT min({c})::BIGINT AS lo, max({c})::BIGINT AS hi,
    count({c}) AS n FROM lineitem),
  shape AS (SELECT *, least(12, hi - lo + 1) AS k, (hi - lo + 1) // least(12, hi - lo + 1) AS w,
    (hi - lo + 1) % least(12, hi - lo + 1) AS extra FROM s),
  bins AS (SELECT i::INTEGER AS bin_index, lo + i * w + least(i, extra) AS a,
    lo + (i + 1) * w + least(i + 1, extra) - 1 AS b, n FROM shape, range(k) r(i))
  SELECT {ordinal} AS ordinal, '{c}' AS column_name, bin_index, a::DOUBLE AS lower_bound,
    b::DOUBLE AS upper_bound, true AS left_closed, true AS right_closed,
    (SELECT count(*) FROM lineitem WHERE {c} BETWEEN a AND b) AS bin_count,
    round((SELECT count(*) FROM lineitem WHERE {c} BETWEEN a AND b) * 100.0 / n, 4)::DOUBLE
      AS pct_non_null FROM bins"""


def _float_bins(ordinal: int, c: str) -> str:
    return f"""WITH s AS (SELECT min({c}) AS lo, max({c}) AS hi,
    count({c}) AS n FROM lineitem),
  bins AS (SELECT i::INTEGER AS bin_index, CASE WHEN i > 0 THEN lo + (hi - lo) / 12 * i END AS a,
    CASE WHEN i < 11 THEN lo + (hi - lo) / 12 * (i + 1) END AS b, n FROM s, range(12) r(i)),
  counted AS (SELECT bin_index, a, b, n, count(v) AS c FROM bins LEFT JOIN
    (SELECT {c} AS v FROM lineitem) ON (a IS NULL OR v > a) AND (b IS NULL OR v <= b)
    GROUP BY ALL)
  SELECT {ordinal} AS ordinal, '{c}' AS column_name, bin_index, round(a, 4) AS lower_bound,
    round(b, 4) AS upper_bound, false AS left_closed, bin_index < 11 AS right_closed,
    c AS bin_count, round(c * 100.0 / n, 4)::DOUBLE AS pct_non_null FROM counted"""


def _all_bins(kind: str) -> str:
    one = {"integer": _int_bins, "float": _float_bins}[kind]
    columns = [(i, c) for i, (c, k) in enumerate(LINEITEM_COLUMNS) if k == kind]
    return " UNION ALL ".join(f"SELECT * FROM ({one(i, c)})" for i, c in columns)


def _named(columns: list[tuple[str, str]], kind: str) -> list[str]:
    return [c for c, k in columns if k == kind]


# --- meaning, structure, quality ----------------------------------------------------------------


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Column metrics with meaning of three tables in one frame."""
    tables = {
        "shop": shop(spark, sf),
        "gappy": gappy_events(spark, sf),
        "conversations": table(spark, sf, "conversations"),
    }
    jobs = [lambda n=name, df=df: column_facts(df, n) for name, df in tables.items()]
    facts = reduce(DataFrame.unionByName, together(spark, *jobs))
    return small_frame(semantics.with_semantics(facts))


FACTS = sql.metrics_cte(
    {
        "shop": (SHOP_SQL, SHOP_COLUMNS),
        "gappy": (GAPPY_SQL, GAPPY_COLUMNS),
        "conversations": ("SELECT * FROM conversations", CONVERSATIONS_COLUMNS),
    }
)


def _flags_text(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_flags", F.array_join("quality_flags", "+"))


def _issues(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset", "issue", "severity", F.array_join("affected_columns", "+").alias("affected"),
        F.round("score_impact", 4).alias("score_impact"),
    )


def missing_mass(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables with many nulls and one with few."""
    jobs = [
        lambda: column_facts(sparse_events(spark, sf), "sparse"),
        lambda: column_facts(gappy_events(spark, sf), "gappy"),
        lambda: column_facts(table(spark, sf, "conversations"), "conversations"),
    ]
    facts = small_frame(reduce(DataFrame.unionByName, together(spark, *jobs)))
    return _issues(quality.missing_mass(semantics.with_semantics(facts)))


SPARSE_FACTS = sql.metrics_cte(
    {
        "sparse": (SPARSE_SQL, SPARSE_COLUMNS),
        "gappy": (GAPPY_SQL, GAPPY_COLUMNS),
        "conversations": ("SELECT * FROM conversations", CONVERSATIONS_COLUMNS),
    }
)


def _issue_sql(kind: str, facts: str = FACTS) -> str:
    return f"""{facts}{sql.ISSUES} SELECT dataset, issue, severity, affected,
      round(score_impact, 4) AS score_impact FROM issues WHERE issue = '{kind}'"""


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    m = _facts(spark, sf)
    keys = spark.createDataFrame(
        [("shop", ["order_id", "ship_date"]), ("conversations", ["conv_id", "turn"])],
        "dataset string, columns array<string>",
    )
    found = structure.column_roles(
        m, keys, structure.entity_columns(m), structure.temporal_columns(m)
    )
    return found.withColumn("roles", F.array_join("roles", "+"))


ROLES = f"""{FACTS}{sql.TEMPORAL}{sql.ENTITIES}
  , key_cols AS (SELECT * FROM (VALUES ('shop', 'order_id'), ('shop', 'ship_date'),
    ('conversations', 'conv_id'), ('conversations', 'turn')) v(dataset, column_name))
  , r AS (SELECT dataset, column_name, 0 AS role FROM key_cols
    UNION SELECT dataset, column_name, 1 FROM e UNION SELECT dataset, column_name, 2 FROM t)
  , g AS (SELECT dataset, column_name, count(*) AS n, min(role) AS best, string_agg(CASE role
    WHEN 0 THEN 'grain key' WHEN 1 THEN 'entity id' ELSE 'time' END, '+' ORDER BY role) AS roles
    FROM r GROUP BY ALL)
  SELECT m.dataset, m.column_name, m.ordinal, coalesce(g.roles,
    CASE WHEN semantic_type = 'numeric' THEN 'measure' ELSE '' END) AS roles,
    CAST(CASE WHEN g.n IS NOT NULL THEN g.n * 100 + 4 - g.best
      WHEN semantic_type = 'numeric' THEN 101 ELSE 0 END AS INTEGER) AS role_sort_key
  FROM m LEFT JOIN g ON m.dataset = g.dataset AND m.column_name = g.column_name"""

POOL = f"""{FACTS}{sql.TEMPORAL}
  , scored AS (SELECT dataset, ordinal, column_name, CASE semantic_type
      WHEN 'id_like' THEN 300.0 + s * 30 - null_pct
      WHEN 'categorical' THEN 150.0 + s * 20 - null_pct + CASE WHEN s >= 2 AND unique_count >=
        greatest(5, count(*) OVER (PARTITION BY dataset)) THEN 40 ELSE 0 END
      WHEN 'numeric' THEN CASE WHEN s >= 2
        THEN 115.0 + least(60.0, unique_count / 50) - null_pct END END AS score, null_pct FROM m)
  , best AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, ordinal DESC)
      AS place FROM scored WHERE null_pct <= 5 AND score > 0)
  , kept AS (SELECT b.dataset, b.ordinal, b.column_name, b.score, 0 AS block, place FROM best b
      WHERE place <= greatest(0, 10 - (SELECT count(*) FROM t WHERE t.dataset = b.dataset)))
  , axes AS (SELECT dataset, ordinal, column_name, NULL AS score, 1 AS block, row_number() OVER
      (PARTITION BY dataset ORDER BY confidence = 'high' DESC,
       temporal_kind = 'continuous_datetime' DESC, ordinal) AS place FROM t
      WHERE (dataset, ordinal) NOT IN (SELECT (dataset, ordinal) FROM kept))
  SELECT dataset, ordinal, column_name, round(score, 4)::DOUBLE AS score, CAST(row_number() OVER
    (PARTITION BY dataset ORDER BY block, place) AS INTEGER) AS position
  FROM (SELECT * FROM kept UNION ALL SELECT * FROM axes)"""

PRIMARY_TEMPORAL = f"""{FACTS}{sql.TEMPORAL} SELECT * FROM t QUALIFY row_number() OVER
  (PARTITION BY dataset ORDER BY confidence = 'high' DESC,
   temporal_kind = 'continuous_datetime' DESC, ordinal) = 1"""

MEASURES = f"""{FACTS}, scored AS (SELECT dataset, ordinal, column_name,
    0.5 * least(1.0, coalesce(std, 0) / 50) + 0.35 * greatest(0, 100 - null_pct) / 100
    + 0.15 * least(1.0, unique_count / row_count) AS raw FROM m WHERE semantic_type = 'numeric')
  SELECT dataset, ordinal, column_name, round(raw, 4) AS score, CASE WHEN raw >= 0.8 THEN 'high'
    WHEN raw >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, CAST(row_number() OVER
    (PARTITION BY dataset ORDER BY round(raw, 4) DESC, ordinal) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= 20"""

LINE_POOL = [name for name, _ in LINEITEM_COLUMNS]
EVENT_POOL = ["user_id", "event_id", "props", "event_type", "ts"]
EVENT_KEYS = [[c] for c in EVENT_POOL] + [
    [a, b] for i, a in enumerate(EVENT_POOL) for b in EVENT_POOL[i + 1 :]
]
LINE_KEYS = (
    [[c] for c in LINE_POOL]
    + [[a, b] for i, a in enumerate(LINE_POOL) for b in LINE_POOL[i + 1 :]]
    + [
        [a, b, c]
        for i, a in enumerate(LINE_POOL)
        for j, b in enumerate(LINE_POOL[i + 1 :], i + 1)
        for c in LINE_POOL[j + 1 :]
    ]
)


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumn("columns", F.array_join("columns", " + "))


def _keys_sql(dataset: str, source: str, keys: list[list[str]], keep: int) -> str:
    return f"""{sql.tuple_counts(source, keys)}{sql.RANKED_KEYS}
      SELECT '{dataset}' AS dataset, rank, columns, distinct_count, uniqueness_ratio, confidence
      FROM ranked WHERE rank <= {keep}"""


ORDER_NAMES = [name for name, _ in ORDERS_COLUMNS]
ORDER_SETS = [list(s) for size in range(1, 7) for s in combinations(ORDER_NAMES, size)]
# Every set of columns is counted; a key is minimal if no smaller one lies in it.
MINIMAL_KEYS = f"""{sql.tuple_counts("SELECT * FROM orders", ORDER_SETS)}
  , k AS (SELECT position, columns, size, string_split(columns, ' + ') AS parts FROM c
    WHERE distinct_count = row_count)
  SELECT 'orders' AS dataset, CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS rank,
    columns, CAST(size AS INTEGER) AS width FROM k
  WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.size < k.size AND list_has_all(k.parts, o.parts))"""

CONV_KEYS = [["conv_id"], ["conv_id", "turn"], ["conv_id", "role"], ["turn", "role"]]

PRIMARY_GRAIN = f"""{sql.tuple_counts("SELECT * FROM events", EVENT_KEYS)}{sql.RANKED_KEYS}
  SELECT 'events' AS dataset, columns, distinct_count, uniqueness_ratio, confidence, rank
  FROM ranked ORDER BY contains(columns, ' + ') AND list_contains(string_split(columns, ' + '), 'ts')
    AND (contains(columns, 'user_id') OR contains(columns, 'event_id')) DESC, rank LIMIT 1"""


def structure_warnings(spark: SparkSession, sf: str) -> DataFrame:
    jobs = [
        lambda n=name: profile(table(spark, sf, n), n).warnings for name in ("labels", "orders")
    ]
    return reduce(DataFrame.unionByName, together(spark, *jobs))


# labels has a unique id and no time column; orders has both.
WARNINGS = """SELECT 'labels' AS dataset,
    'no_time_axis: pick a column for trends by hand' AS warning FROM (SELECT 1) UNION ALL
  SELECT 'labels', 'no_grain: no set of columns identifies a row' FROM labels
    HAVING count(DISTINCT doc_id) < 0.98 * count(*) UNION ALL
  SELECT 'orders', 'no_grain: no set of columns identifies a row' FROM orders
    HAVING count(DISTINCT o_orderkey) < 0.98 * count(*)"""


def column_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = semantics.with_semantics(cols.column_metrics(table(spark, sf, "orders"), "orders"))
    found = _rounded(found, 4, "mean", "std", "p25", "median", "p75")
    return _flags_text(found).select(
        "dataset", "ordinal", "column_name", "physical_type", "semantic_type", "row_count",
        "null_count", "null_pct", "unique_count", "unique_pct", "min_num", "max_num", "min_time",
        "max_time", "mean", "std", "p25", "median", "p75", "median_time", "top_value", "top_count",
        "top_pct", "quality_flags", "metric_scope",
    )


def _column_metrics_sql() -> str:
    parts = []
    for i, (c, kind) in enumerate(ORDERS_COLUMNS):
        num, temporal, text = kind in ("integer", "float"), kind == "temporal", kind == "string"
        n = c if num else "NULL"
        t = c if temporal else "NULL::TIMESTAMP"
        first = f"(SELECT {c}, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"
        parts.append(
            f"""SELECT {i} AS ordinal, '{sql.PHYSICAL[kind]}' AS physical_type,
            min({n})::DOUBLE AS min_num, max({n})::DOUBLE AS max_num, min({t}) AS min_time,
            max({t}) AS max_time, round(avg({n}::DOUBLE), 4) AS mean,
            round(stddev_samp({n}::DOUBLE), 4) AS std,
            round(quantile_cont({n}::DOUBLE, 0.25), 4) AS p25,
            round(quantile_cont({n}::DOUBLE, 0.5), 4) AS median,
            round(quantile_cont({n}::DOUBLE, 0.75), 4) AS p75, make_timestamp(floor(quantile_cont(epoch_us({t}), 0.5))::BIGINT)
              AS median_time,
            {f"(SELECT {c} FROM {first})" if text else "NULL::VARCHAR"} AS top_value,
            {f"(SELECT n FROM {first})" if text else "NULL::BIGINT"} AS top_count FROM orders"""
        )
    facts = sql.metrics_cte({"orders": ("SELECT * FROM orders", ORDERS_COLUMNS)})
    return f"""{facts}, v AS ({" UNION ALL ".join(parts)})
      SELECT m.dataset, m.ordinal, m.column_name, v.physical_type, m.semantic_type, m.row_count,
        m.null_count, m.null_pct, m.unique_count,
        round(m.unique_count * 100.0 / m.row_count, 4)::DOUBLE AS unique_pct, v.min_num, v.max_num,
        v.min_time, v.max_time, v.mean, v.std, v.p25, v.median, v.p75, v.median_time, v.top_value,
        v.top_count, round(v.top_count * 100.0 / m.row_count, 4)::DOUBLE AS top_pct,
        {sql.FLAGS} AS quality_flags, 'full' AS metric_scope FROM m JOIN v USING (ordinal)"""



def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile(gappy_events(spark, sf), "gappy")
    return found.summary.drop("narrative")


DATASET_PROFILE = f"""{sql.metrics_cte({"gappy": (GAPPY_SQL, GAPPY_COLUMNS)})}{sql.ISSUES}
  , size AS (SELECT max(row_count) AS row_count, count(*) AS column_count,
    sum(null_count)::BIGINT AS null_cells, sum(row_count) AS cells,
    count(*) FILTER (semantic_type = 'numeric') AS numeric_column_count,
    count(*) FILTER (semantic_type = 'categorical') AS categorical_column_count,
    count(*) FILTER (semantic_type = 'datetime') AS datetime_column_count FROM m)
  , dup AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) AS n
    FROM (SELECT count(*) AS n FROM src0
    GROUP BY event_id, ts, user_id, event_type, value, props))
  , lost AS (SELECT coalesce(sum(score_impact), 0) AS lost FROM issues)
  SELECT 'gappy' AS dataset, row_count, column_count, null_cells,
    round(null_cells * 100.0 / cells, 4)::DOUBLE AS missing_cell_pct,
    round(dup.n * 100.0 / row_count, 4)::DOUBLE AS duplicate_row_pct, numeric_column_count,
    categorical_column_count, datetime_column_count,
    round(greatest(0, least(100, 100 - lost)), 2)::DOUBLE AS quality_score,
    'One row per event_id + ts.' AS likely_grain, 'v6' AS structure_version, 'full' AS metric_scope
  FROM size, dup, lost"""


def sampled_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A profile of the 5,000 orders of lowest key digest; the sample size is the operator's limit."""
    found = sampled_profile_of(table(spark, sf, "orders"), "orders", "o_orderkey", 5_000)
    return found.columns.select("column_name", "row_count", "null_count", "unique_count").join(
        found.summary.select("metric_scope"), F.lit(True)
    )


SAMPLED = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
    count(DISTINCT {c}) AS unique_count,
    (SELECT CASE WHEN count(*) > 5000 THEN 'sample' ELSE 'full' END FROM orders) AS metric_scope
    FROM (SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 5000)"""
    for c, _ in ORDERS_COLUMNS
)


def _narrative(spark: SparkSession, sf: str) -> DataFrame:
    return profile(table(spark, sf, "conversations"), "conversations").summary.select(
        "dataset", "likely_grain", "narrative"
    )


QUERIES = {
    "column_metrics": column_metrics,
    "null_counts": lambda s, d: cols.null_counts(gappy_events(s, d)),
    "missing_cell_pct": lambda s, d: cols.missing_cell_pct(gappy_events(s, d)),
    "duplicate_row_pct": duplicate_rows,
    "unique_count": lambda s, d: cols.unique_count(table(s, d, "lineitem")),
    "min_max": min_max,
    "numeric_describe": numeric_describe,
    "datetime_median": datetime_median,
    "top_values": top_values,
    "top_texts": top_texts,
    "top_value": lambda s, d: cols.top_value(gappy_events(s, d)),
    "histogram_int_profile": lambda s, d: _bins(
        profile_histograms(table(s, d, "lineitem"), _named(LINEITEM_COLUMNS, "integer"))
    ),
    "histogram_float_profile": lambda s, d: _bins(
        profile_histograms(table(s, d, "lineitem"), _named(LINEITEM_COLUMNS, "float"))
    ),
    "semantic_type": lambda s, d: _facts(s, d).select("dataset", "column_name", "semantic_type"),
    "quality_flags": lambda s, d: _flags_text(_facts(s, d)).select(
        "dataset", "column_name", "quality_flags"
    ),
    "type_counts": lambda s, d: semantics.type_counts(_facts(s, d)),
    "sampled_profile": sampled_profile,
    "temporal_columns": lambda s, d: structure.temporal_columns(_facts(s, d)),
    "discrete_periods": lambda s, d: structure.discrete_periods(_facts(s, d)),
    "primary_temporal": lambda s, d: structure.primary_temporal(
        structure.temporal_columns(_facts(s, d))
    ),
    "entity_columns": lambda s, d: structure.entity_columns(_facts(s, d)),
    "key_candidate_pool": lambda s, d: _rounded(
        (lambda m: structure.key_candidate_pool(m, structure.temporal_columns(m)))(_facts(s, d)),
        4, "score",
    ),
    "grain_key_candidates": lambda s, d: _keys(
        grain.grain_key_candidates(
            table(s, d, "lineitem"), "lineitem", LINE_POOL, max_pairs=None, max_triples=None
        )
    ),
    "minimal_keys": lambda s, d: _keys(minimal_keys(table(s, d, "orders"), "orders")),
    "validate_grain": lambda s, d: _keys(
        grain.validate_grain(table(s, d, "conversations"), "conversations", CONV_KEYS)
    ),
    "primary_grain": lambda s, d: _keys(infer_structure(table(s, d, "events"), "events").primary_grain),
    "measure_ranking": lambda s, d: structure.measure_ranking(_facts(s, d)),
    "column_roles": _roles,
    "structure_warnings": structure_warnings,
    "issue_missing_mass": missing_mass,
    "issue_duplicate_key": lambda s, d: _issues(quality.duplicate_keys(_facts(s, d))),
    "issue_high_null": lambda s, d: _issues(quality.high_nulls(_facts(s, d))),
    "issue_constant": lambda s, d: _issues(quality.constants(_facts(s, d))),
    "issue_high_cardinality": lambda s, d: _issues(quality.high_cardinality(_facts(s, d))),
    "quality_score": lambda s, d: (
        lambda m: quality.quality_score(m.select("dataset").distinct(), quality.quality_issues(m))
    )(_facts(s, d)),
    "rank_issues": lambda s, d: quality.quality_issues(_facts(s, d)).select(
        "dataset", "rank", "issue", "severity",
        F.array_join("affected_columns", "+").alias("affected"),
    ),
    "complete_rows": lambda s, d: quality.complete_rows(gappy_events(s, d)),
    "duplicate_key_values": lambda s, d: quality.duplicate_key_values(
        table(s, d, "orders"), "o_custkey"
    ),
    "null_count": lambda s, d: quality.null_count(gappy_events(s, d), "event_type"),
    "distinct_values": lambda s, d: quality.distinct_values(gappy_events(s, d), "event_type"),
    "top_categories": lambda s, d: quality.top_categories(gappy_events(s, d), "props"),
    "profile_narrative": _narrative,
    "column_severity": lambda s, d: semantics.column_severity(_facts(s, d)).select(
        "dataset", "column_name", "severity"
    ),
    "column_browser": lambda s, d: semantics.column_browser(
        _facts(s, d), search="R", flags="has_flags", sort_by="null_pct", descending=True
    ).select("dataset", "column_name", "semantic_type", "null_pct", "severity"),
    "dataset_profile": dataset_profile,
}

NARRATIVE = """SELECT 'conversations' AS dataset, NULL::VARCHAR AS likely_grain,
  concat_ws(chr(10) || chr(10), concat('conversations has ', format('{:,}', count(*)),
    ' rows and 4 columns.'), 'Likely identifiers: conv_id.', 'Main measures: turn.',
    CASE WHEN count(DISTINCT conv_id) < 0.99 * count(*)
      THEN 'Main risks: Repeated values in likely key conv_id.' END) AS narrative
  FROM conversations"""

SEVERITY = """CASE WHEN high_missingness OR id_with_nulls THEN 'critical'
  WHEN constant_column THEN 'warning' ELSE 'none' END"""

ORACLE = {
    "sampled_profile": SAMPLED,
    "column_metrics": _column_metrics_sql(),
    "null_counts": sql.null_counts(GAPPY_SQL, GAPPY_COLUMNS),
    "missing_cell_pct": f"""WITH src AS ({GAPPY_SQL}), n AS (SELECT count(*) * 6 AS total,
      {" + ".join(f"count({c})" for c, _ in GAPPY_COLUMNS)} AS filled FROM src)
      SELECT total - filled AS null_cells, total AS total_cells,
      round((total - filled) * 100.0 / total, 4)::DOUBLE AS missing_cell_pct FROM n""",
    "duplicate_row_pct": DUPLICATES,
    "unique_count": UNIQUE,
    "min_max": MIN_MAX,
    "numeric_describe": DESCRIBE,
    # Midway between two rows, cut to whole microseconds.
    "datetime_median": f"""SELECT 4 AS ordinal, 'o_orderdate' AS column_name,
      make_timestamp(floor(quantile_cont(epoch_us(o_orderdate), 0.5))::BIGINT) AS median_time
      FROM orders UNION ALL SELECT 1, 'ts',
      make_timestamp(floor(quantile_cont(epoch_us(ts), 0.5))::BIGINT) FROM ({GAPPY_SQL})""",
    "top_values": _top_sql(
        "SELECT * FROM lineitem",
        list(enumerate(c for c, _ in LINEITEM_COLUMNS)),
        8,
    ),
    "top_texts": " UNION ALL ".join(
        f"SELECT * FROM ({_top_sql(f'SELECT * FROM {t}', columns, 8)})"
        for t, columns in (("documents", [(1, "text"), (2, "lang")]), ("pages", [(2, "html")]))
    ),
    "top_value": TOP_VALUE,
    "histogram_int_profile": _all_bins("integer"),
    "histogram_float_profile": _all_bins("float"),
    "semantic_type": f"{FACTS} SELECT dataset, column_name, semantic_type FROM m",
    "quality_flags": f"{FACTS} SELECT dataset, column_name, {sql.FLAGS} AS quality_flags FROM m",
    "type_counts": f"""{FACTS} SELECT dataset,
      count(*) FILTER (semantic_type = 'numeric') AS numeric_column_count,
      count(*) FILTER (semantic_type = 'categorical') AS categorical_column_count,
      count(*) FILTER (semantic_type = 'datetime') AS datetime_column_count
      FROM m GROUP BY dataset""",
    "temporal_columns": f"{FACTS}{sql.TEMPORAL} SELECT * FROM t",
    "discrete_periods": f"""{FACTS}{sql.TEMPORAL}
      SELECT * FROM t WHERE temporal_kind = 'discrete_period'""",
    "primary_temporal": PRIMARY_TEMPORAL,
    "entity_columns": f"{FACTS}{sql.ENTITIES} SELECT * FROM e",
    "key_candidate_pool": POOL,
    "grain_key_candidates": _keys_sql("lineitem", "SELECT * FROM lineitem", LINE_KEYS, 15),
    "minimal_keys": MINIMAL_KEYS,
    "validate_grain": _keys_sql("conversations", "SELECT * FROM conversations", CONV_KEYS, 15),
    "primary_grain": PRIMARY_GRAIN,
    "measure_ranking": MEASURES,
    "column_roles": ROLES,
    "structure_warnings": WARNINGS,
    **{f"issue_{k}": _issue_sql(k, SPARSE_FACTS if k == "missing_mass" else FACTS) for k in
       ("missing_mass", "duplicate_key", "high_null", "constant", "high_cardinality")},
    "quality_score": f"""{FACTS}{sql.ISSUES} SELECT d.dataset,
      round(greatest(0, least(100, 100 - coalesce(sum(score_impact), 0))), 2)::DOUBLE
        AS quality_score FROM (SELECT DISTINCT dataset FROM m) d
      LEFT JOIN issues i ON d.dataset = i.dataset GROUP BY d.dataset""",
    "rank_issues": f"""{FACTS}{sql.ISSUES} SELECT dataset, CAST(row_number() OVER
      (PARTITION BY dataset ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2
        ELSE 3 END, score_impact DESC, CASE issue WHEN 'missing_mass' THEN 0
        WHEN 'duplicate_key' THEN 1 ELSE 2 END, ordinal, issue) AS INTEGER) AS rank,
      issue, severity, affected FROM issues""",
    "complete_rows": f"""SELECT count(*) FILTER (event_id IS NOT NULL AND ts IS NOT NULL AND
      user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL)
      AS complete_rows, count(*) AS total FROM ({GAPPY_SQL})""",
    "duplicate_key_values": """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1
      HAVING count(*) > 1 ORDER BY n DESC, 1 LIMIT 20""",
    "null_count": f"""SELECT count(*) FILTER (event_type IS NULL) AS nulls FROM ({GAPPY_SQL})""",
    "distinct_values": f"SELECT DISTINCT event_type FROM ({GAPPY_SQL})",
    "top_categories": f"""SELECT props, count(*) AS n FROM ({GAPPY_SQL}) GROUP BY 1
      ORDER BY n DESC, 1 LIMIT 20""",
    "column_severity": f"{FACTS} SELECT dataset, column_name, {SEVERITY} AS severity FROM m",
    "column_browser": f"""{FACTS} SELECT dataset, column_name, semantic_type, null_pct,
      {SEVERITY} AS severity FROM m WHERE contains(lower(column_name), 'r')
      AND (high_missingness OR id_with_nulls OR constant_column)""",
    "dataset_profile": DATASET_PROFILE,
    "profile_narrative": NARRATIVE,
}
