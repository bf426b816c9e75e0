"""Profile history: snapshots in Parquet partitioned by dataset, pruning and comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.plans.profile import STRUCTURE_VERSION, Profile
from tabulens.session import scratch_dir

# How many snapshots are kept and listed.
KEEP_SNAPSHOTS = 50
DEFAULT_LISTED = 10
SNAPSHOT_FIELDS = [
    "dataset", "history_id", "created_at", "quality_score", "row_count", "column_count",
    "missing_cell_pct", "structure_version",
]


def snapshot(found: Profile, created_at: Column | None = None) -> DataFrame:
    """One row per dataset: the headline numbers and the null share of every column."""
    columns = found.columns.groupBy("dataset").agg(
        F.array_sort(
            F.collect_list(F.struct("ordinal", "column_name", "semantic_type", "null_pct"))
        ).alias("columns")
    )
    return (
        found.summary.withColumn("history_id", F.lit(uuid.uuid4().hex))
        .withColumn("created_at", F.current_timestamp() if created_at is None else created_at)
        .join(columns, "dataset")
        .select(*SNAPSHOT_FIELDS, "columns")
    )


def save_profile(path: str, found: Profile, created_at: Column | None = None) -> None:
    """Append a snapshot. The latest one of a dataset is its profile."""
    snapshot(found, created_at).write.mode("append").partitionBy("dataset").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _newest_first() -> W:
    return W.partitionBy("dataset").orderBy(F.desc("created_at"), F.desc("history_id"))


def with_age(history: DataFrame) -> DataFrame:
    """Snapshots numbered from the newest, 1, per dataset."""
    return history.withColumn("age", F.row_number().over(_newest_first()))


def latest_profiles(history: DataFrame) -> DataFrame:
    """The newest snapshot of each dataset, found by an aggregate that combines within tasks."""
    fields = [c for c in history.columns if c != "dataset"]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "history_id"))
    return history.groupBy("dataset").agg(newest.alias("_s")).select("dataset", "_s.*")


def profile_history(history: DataFrame, dataset: str, limit: int = DEFAULT_LISTED) -> DataFrame:
    """Newest snapshots of one dataset; the filter prunes to its partition."""
    listed = max(1, min(limit, KEEP_SNAPSHOTS))
    own = history.where(F.col("dataset") == dataset)
    return own.orderBy(F.desc("created_at"), F.desc("history_id")).limit(listed)


def prune_history(history: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` snapshots per dataset; each task drops its surplus before the shuffle."""
    return with_age(history).where(F.col("age") <= keep).drop("age")


def rewrite_pruned(spark: SparkSession, path: str, keep: int = KEEP_SNAPSHOTS) -> None:
    """Rewrite only the partitions that hold more than ``keep`` snapshots.

    What stays is first written beside them, in the shared scratch folder, so a failure while the
    partitions are replaced loses no snapshot.
    """
    history = load_history(spark, path)
    full = history.groupBy("dataset").count().where(F.col("count") > keep).select("dataset")
    beside = scratch_dir(spark, "pruned-history")
    prune_history(history.join(full, "dataset", "left_semi"), keep).write.parquet(beside)
    spark.read.schema(history.schema).parquet(beside).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("dataset").parquet(path)


def current_profiles(history: DataFrame, version: str = STRUCTURE_VERSION) -> DataFrame:
    """Snapshots made with the current structure rules."""
    return history.where(F.col("structure_version") == version)


def stale_profiles(history: DataFrame, version: str = STRUCTURE_VERSION) -> DataFrame:
    """Snapshots to profile anew: made with other rules, or with unknown ones."""
    return history.where(~F.col("structure_version").eqNullSafe(F.lit(version)))


def null_pct_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns of two metric tables compared by name: added, removed, or changed in null share."""
    a = before.select("column_name", F.col("null_pct").alias("a"), F.lit(True).alias("in_a"))
    b = after.select("column_name", F.col("null_pct").alias("b"), F.lit(True).alias("in_b"))
    old, new = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    change = (
        F.when(F.col("in_a").isNull(), "new")
        .when(F.col("in_b").isNull(), "removed")
        .when(old != new, "null_pct")
    )
    both = F.col("change") == "null_pct"
    return (
        a.join(b, "column_name", "full")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(
            "change",
            "column_name",
            F.when(both, old).alias("null_pct_before"),
            F.when(both, new).alias("null_pct_after"),
            F.when(both, F.round(new - old, 6)).alias("null_pct_delta"),
        )
    )


def profile_diff(
    history: DataFrame, dataset: str, before: str | None = None, after: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Compare two snapshots of a dataset, by default the last two.

    Returns the column changes and one row with the change of the score.
    """
    own = history.where(F.col("dataset") == dataset)
    if (before is None) != (after is None):
        raise ValueError("name both snapshots or none")
    if before is None:
        last = profile_history(own, dataset, 2).select("history_id").collect()
        if len(last) < 2:
            raise ValueError("a comparison needs two snapshots")
        after, before = last[0].history_id, last[1].history_id
    found = {r[0] for r in own.where(F.col("history_id").isin(before, after))
             .select("history_id").collect()}
    if not {before, after} <= found:
        raise ValueError("unknown snapshot")

    def side(history_id: str) -> DataFrame:
        return own.where(F.col("history_id") == history_id)

    def columns(history_id: str) -> DataFrame:
        return side(history_id).select(F.inline("columns"))

    scores = side(before).select("dataset", F.col("quality_score").alias("_a")).join(
        side(after).select("dataset", F.col("quality_score").alias("_b")), "dataset"
    )
    delta = scores.select(
        "dataset",
        F.lit(before).alias("before"),
        F.lit(after).alias("after"),
        (F.col("_b").cast("double") - F.col("_a").cast("double")).alias("quality_score_delta"),
    )
    return null_pct_changes(columns(before), columns(after)), delta
