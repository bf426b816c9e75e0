"""Profile history. Events stand in for snapshots: one dataset per event type, ordered by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.operators.columns import null_counts
from tabulens.plans import history
from tabulens.plans.profile import profile
from tabulens.session import scratch_dir
from workload.inputs import gappy_events, table


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"),
        F.col("event_id").alias("history_id"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("quality_score"),
        F.col("user_id").alias("row_count"),
        F.when(F.col("value") < 20, "v5").otherwise("v6").alias("structure_version"),
    )


SNAPSHOTS = """(SELECT event_type AS dataset, event_id AS history_id, ts AS created_at,
  value AS quality_score, user_id AS row_count,
  CASE WHEN value < 20 THEN 'v5' ELSE 'v6' END AS structure_version FROM events)"""


def save_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of each of two tables, saved, pruned to one, and read back as the latest."""
    path = scratch_dir(spark, "history")
    for name, df in {
        "labels": table(spark, sf, "labels"), "gappy": gappy_events(spark, sf)
    }.items():
        found = profile(df, name)
        for day in ("2024-01-01", "2024-01-02"):
            history.save_profile(path, found, F.to_timestamp(F.lit(day)))
    history.rewrite_pruned(spark, path, keep=1)
    latest = history.latest_profiles(history.load_history(spark, path))
    kept = history.load_history(spark, path).groupBy("dataset").agg(F.count("*").alias("snapshots"))
    return latest.join(kept, "dataset").select(
        "dataset", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "row_count",
        "column_count", "missing_cell_pct", "structure_version", "snapshots",
    )


SAVED = """SELECT 'labels' AS dataset, TIMESTAMP '2024-01-02 00:00:00' AS created_at,
    count(*) AS row_count, 3::BIGINT AS column_count, 0.0::DOUBLE AS missing_cell_pct,
    'v6' AS structure_version, 1::BIGINT AS snapshots FROM labels
  UNION ALL SELECT 'gappy', TIMESTAMP '2024-01-02 00:00:00', count(*), 6,
    round((count(*) FILTER (event_type = 'error') + count(*) FILTER (user_id < 30)
      + count(*) FILTER (event_type = 'click') + count(*) FILTER (value < 15)) * 100.0
      / (count(*) * 6), 4)::DOUBLE, 'v6', 1 FROM events"""


def profile_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Customer against a copy with nulls, a dropped column and a new one."""
    before = table(spark, sf, "customer")
    after = before.select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("c_nationkey"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        "c_acctbal",
        F.upper("c_name").alias("c_label"),
    )
    return history.null_pct_changes(null_counts(before), null_counts(after))


DIFF = """WITH n AS (SELECT
    round(count(*) FILTER (c_nationkey = 3) * 100.0 / count(*), 4)::DOUBLE AS nations,
    round(count(*) FILTER (c_mktsegment = 'BUILDING') * 100.0 / count(*), 4)::DOUBLE AS segments
    FROM customer)
  SELECT 'null_pct' AS change, 'c_nationkey' AS column_name, 0.0::DOUBLE AS null_pct_before,
    nations AS null_pct_after, round(nations, 6) AS null_pct_delta FROM n
  UNION ALL SELECT 'null_pct', 'c_mktsegment', 0.0, segments, round(segments, 6) FROM n
  UNION ALL SELECT 'removed', 'c_name', NULL, NULL, NULL
  UNION ALL SELECT 'new', 'c_label', NULL, NULL, NULL"""

QUERIES = {
    "save_profile": save_profile,
    "profile_history": lambda s, d: history.profile_history(_snapshots(s, d), "view", 10),
    "prune_history": lambda s, d: history.prune_history(_snapshots(s, d), 50),
    "latest_profiles": lambda s, d: history.latest_profiles(_snapshots(s, d)),
    "profile_diff": profile_diff,
    "stale_profiles": lambda s, d: history.stale_profiles(_snapshots(s, d)).groupBy("dataset").agg(
        F.count("*").alias("stale"), F.max("created_at").alias("newest")
    ),
}

ORACLE = {
    "save_profile": SAVED,
    "profile_history": f"""SELECT * FROM {SNAPSHOTS} WHERE dataset = 'view'
      ORDER BY created_at DESC, history_id DESC LIMIT 10""",
    "prune_history": f"""SELECT * FROM {SNAPSHOTS} QUALIFY row_number() OVER
      (PARTITION BY dataset ORDER BY created_at DESC, history_id DESC) <= 50""",
    "latest_profiles": f"""SELECT * FROM {SNAPSHOTS} QUALIFY row_number() OVER
      (PARTITION BY dataset ORDER BY created_at DESC, history_id DESC) = 1""",
    "profile_diff": DIFF,
    "stale_profiles": f"""SELECT dataset, count(*) AS stale, max(created_at) AS newest
      FROM {SNAPSHOTS} WHERE structure_version <> 'v6' GROUP BY dataset""",
}

