"""Duplicate rows of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.names import quoted
from tabulens.operators.columns import column_infos, pct

# Hashes of repeated rows are broadcast up to this number (eight bytes each).
MAX_BROADCAST_HASHES = 4_000_000


def duplicate_row_pct(df: DataFrame, max_hashes: int = MAX_BROADCAST_HASHES) -> DataFrame:
    """Rows that occur more than once, every copy counted, as a number and a share of all rows.

    A first pass shuffles an 8-byte hash per row and finds the hashes seen twice. None: no duplicates.
    Few: only rows with such a hash are grouped by all their columns, so wide unique rows never cross
    the network; rows that merely share a hash fall apart there, so the answer is exact. Many: the
    table is grouped by all columns at once, copies being added up within each task first.
    """
    infos = column_infos(df)
    rows = df.selectExpr(*[f"{c.groupable} as {c.sql}" for c in infos])
    names = [quoted(c.name) for c in infos]
    hashed = rows.withColumn("_h", F.xxhash64(*names))
    repeated = hashed.groupBy("_h").count().where(F.col("count") > 1).select("_h").persist()
    try:
        total, found = df.count(), repeated.count()
        if found and found <= max_hashes:
            hashed = hashed.join(F.broadcast(repeated), "_h", "left_semi")
        # Without a repeated hash there is nothing to group.
        copies = hashed.groupBy(*names).count().where(F.col("count") > 1) if found else None
        copied = copies.agg(F.sum("count")).first()[0] if found else 0
    finally:
        repeated.unpersist()
    return df.sparkSession.range(1).select(
        F.lit(total).cast("bigint").alias("row_count"),
        F.lit(copied or 0).cast("bigint").alias("duplicate_rows"),
    ).withColumn("duplicate_row_pct", pct(F.col("duplicate_rows"), F.col("row_count")))
