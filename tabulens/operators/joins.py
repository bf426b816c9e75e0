"""The as-of join, which Spark SQL lacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.slices import ROWS_PER_SLICE, SLICES, slice_bounds, slice_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    right_prefix: str = "right_",
    slices: int | None = None,
) -> DataFrame:
    """Every left row with the last right row of its keys at or before its time, nulls if none.

    A row without a key or time matches nothing; such left rows go round the windows.

    Both sides run through one window per (keys, time slice). Slices hold about equal shares of the
    rows, so a key with a third of them is spread over many tasks; what a slice must know about the
    past is one carried row per (keys, slice), found by an aggregate over at most ``slices`` rows.
    """
    carried = [c for c in right.columns if c not in keys]
    own = [c for c in left.columns if c not in keys and c != time]
    if slices is None:
        slices = max(SLICES, (left.count() + right.count()) // ROWS_PER_SLICE)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, time]])
    unmatched = left.where(~known).select(
        *keys, time, *own,
        *[F.lit(None).cast(right.schema[c].dataType).alias(f"{right_prefix}{c}") for c in carried],
    )
    left = left.where(known)
    l_rows = left.select(
        *keys, F.col(time).alias("_t"), F.struct(*own).alias("_left"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("_right"),
    )
    r_rows = right.select(
        *keys, F.col(time).alias("_t"),
        F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("_left"),
        F.lit(0).alias("_side"), F.struct(*carried).alias("_right"),
    ).dropna(subset=[*keys, "_t"])  # an unknown key or time matches nothing
    bounds = slice_bounds(left.select(time).unionAll(right.select(time)), time, slices)
    rows = l_rows.unionByName(r_rows).withColumn("_slice", slice_of(F.col("_t"), bounds))
    place = [*keys, "_slice"]

    within = W.partitionBy(*place).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    matched = rows.withColumn("_hit", F.last("_right", ignorenulls=True).over(within)).where(
        F.col("_side") == 1
    )
    ends = rows.groupBy(*place).agg(
        F.max_by("_right", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end")
    )
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    past = ends.select(*place, F.last("_end", ignorenulls=True).over(before).alias("_past"))
    joined = matched.join(past, place, "left").withColumn("_hit", F.coalesce("_hit", "_past"))
    return joined.select(
        *keys,
        F.col("_t").alias(time),
        *[F.col(f"_left.{c}").alias(c) for c in own],
        *[F.col(f"_hit.{c}").alias(f"{right_prefix}{c}") for c in carried],
    ).unionByName(unmatched)
