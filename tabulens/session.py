"""Session settings, the shared scratch folder, and small driver-side frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# A frame of one row per column, bin, candidate or issue stays far below this.
SMALL_FRAME_MAX_ROWS = 200_000


def build_session(app_name: str = "tabulens", **extra: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one machine, may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tabulens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tabulens/{label}-{uuid.uuid4().hex}"


def small_frame(df: DataFrame) -> DataFrame:
    """Run ``df`` once and hold its few rows on the driver as a local relation.

    For results with one row per column, bin or candidate: later rules over them then cost no scan
    and no lineage. A result over the bound is an error, never cut.
    """
    table = df.limit(SMALL_FRAME_MAX_ROWS + 1).toArrow()
    if table.num_rows > SMALL_FRAME_MAX_ROWS:
        raise ValueError(f"result has more than {SMALL_FRAME_MAX_ROWS} rows; keep it distributed")
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Results of independent jobs submitted at once, so that one fills the idle cores of another."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]
