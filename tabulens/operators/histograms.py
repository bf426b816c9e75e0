"""Profile histograms of all numeric columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.bins import FloatEdges, IntBins
from tabulens.operators.columns import (
    ColumnInfo,
    column_infos,
    finite_sql,
    long_form,
    per_column_aggregate,
)
from tabulens.session import small_frame

DEFAULT_BINS = 12

BIN_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("bin_index", T.IntegerType(), False),
        T.StructField("lower_bound", T.DoubleType(), True),
        T.StructField("upper_bound", T.DoubleType(), True),
        T.StructField("left_closed", T.BooleanType(), False),
        T.StructField("right_closed", T.BooleanType(), False),
    ]
)


def finite_value(c: ColumnInfo) -> str:
    """The column as SQL, with null where a float is NaN or infinite."""
    return finite_sql(c.sql) if c.kind == "float" else c.sql


def _bins_of(c: ColumnInfo, low: str, high: str, bins: int) -> IntBins | FloatEdges:
    if c.kind == "integer":
        return IntBins.over(int(low), int(high), bins)
    return FloatEdges(float(low), float(high), bins)


def _bin_rows(c: ColumnInfo, shape: IntBins | FloatEdges) -> list[tuple]:
    rows = []
    for i in range(shape.bins):
        if isinstance(shape, IntBins):
            bounds = (float(shape.lower(i)), float(shape.upper(i)), True, True)
        else:
            first, last = i == 0, i == shape.bins - 1
            lower = None if first else shape.edge(i)
            upper = None if last else shape.edge(i + 1)
            bounds = (lower, upper, False, not last)
        rows.append((c.ordinal, c.name, i, *bounds))
    return rows


def profile_histograms(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = DEFAULT_BINS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Bins with counts for every numeric column; empty bins are kept.

    Integer columns: closed bins of near-equal width. Others: right-closed equal-width bins, open at
    both ends. Columns with fewer than two values or a single value have none. The ranges are one
    small row per column; the counting pass adds up each task's rows before its tiny shuffle.
    """
    infos = {c.ordinal: c for c in column_infos(df, columns) if c.numeric}
    if not infos:
        return df.sparkSession.createDataFrame([], _result_schema())
    if stats is None:
        stats = small_frame(
            per_column_aggregate(df, list(infos.values()), _finite_range, RANGE_TYPES)
        )
    shapes = {
        r.ordinal: _bins_of(infos[r.ordinal], r.low, r.high, bins)
        for r in stats.where(
            (F.col("filled") >= 2) & (F.col("low") != F.col("high"))
        ).select("ordinal", "low", "high").collect()
    }
    if not shapes:
        return df.sparkSession.createDataFrame([], _result_schema())
    counts = (
        long_form(df, [infos[o] for o in shapes], [_index(infos[o], s) for o, s in shapes.items()])
        .where(F.col("v").isNotNull())
        .groupBy("o", "v")
        .agg(F.count("*").alias("bin_count"))
        .select(F.col("o").cast("int").alias("ordinal"), F.col("v").alias("bin_index"), "bin_count")
    )
    grid = df.sparkSession.createDataFrame(
        [row for o, shape in shapes.items() for row in _bin_rows(infos[o], shape)], BIN_SCHEMA
    )
    totals = stats.select("ordinal", F.col("filled").alias("_total"))
    return (
        grid.join(counts, ["ordinal", "bin_index"], "left")
        .join(totals, "ordinal")
        .withColumn("bin_count", F.coalesce("bin_count", F.lit(0).cast("bigint")))
        .withColumn("pct_non_null", F.round(F.col("bin_count") / F.col("_total") * 100, 4))
        .select(*[f.name for f in _result_schema().fields])
    )


RANGE_TYPES = {"filled": "bigint", "low": "string", "high": "string"}


def _finite_range(c: ColumnInfo) -> dict[str, str]:
    value = f"double({c.sql})" if c.kind == "decimal" else finite_value(c)
    return {"filled": f"count({value})", "low": f"min({value})", "high": f"max({value})"}


def _index(c: ColumnInfo, shape: IntBins | FloatEdges) -> str:
    if isinstance(shape, IntBins):
        return shape.index_sql(c.sql)
    value = finite_value(c)
    return f"if({value} is null, null, {shape.right_closed_sql(f'double({c.sql})')})"


def _result_schema() -> T.StructType:
    extra = [
        T.StructField("bin_count", T.LongType(), False),
        T.StructField("pct_non_null", T.DoubleType(), True),
    ]
    return T.StructType([*BIN_SCHEMA.fields, *extra])


def value_range(df: DataFrame, column: str) -> tuple[int, str | None, str | None]:
    """Count, lowest and highest finite value of one column, exact as text."""
    ranges = per_column_aggregate(df, column_infos(df, [column]), _finite_range, RANGE_TYPES)
    row = ranges.first()
    return row.filled, row.low, row.high
