"""Chart specifications as DataFrame plans: line, histogram, bar, scatter, and the wide form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.bins import FloatEdges, IntBins
from tabulens.functions.names import col
from tabulens.functions.quantiles import DIRECT_LIMIT, exact_percentiles
from tabulens.functions.topk import first_rows
from tabulens.operators.columns import column_infos
from tabulens.operators.histograms import finite_value, value_range
from tabulens.plans.chart_spec import (
    MAX_BINS,
    MAX_PIVOT,
    MAX_ROWS,
    MAX_TOP_N,
    ChartSpec,
    ChartSpecError,
    auto_spec,
    chart_filter,
    check_spec,
)
from tabulens.plans.profile import Structure
from tabulens.session import small_frame

PERCENTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def time_bucket(df: DataFrame, spec: ChartSpec) -> Column:
    """The X value: truncated to the bucket when X is a continuous time and rows are aggregated."""
    x = col(spec.x_column)
    if spec.aggregation == "none" or spec.bucket == "none" or not spec.x_bucketable:
        return x
    if isinstance(df.schema[spec.x_column].dataType, T.TimestampType):
        return F.date_trunc(spec.bucket, x)
    # date_trunc answers in the session zone; a time without zone stays one.
    return F.date_trunc(spec.bucket, x).cast("timestamp_ntz")


def _simple_aggregate(aggregation: str, value: Column) -> Column:
    return {
        "sum": F.sum,
        "avg": F.avg,
        "min": F.min,
        "max": F.max,
        "stddev": F.stddev_samp,
        "count": F.count,
        "count_distinct": F.count_distinct,
    }[aggregation](value)


def chart_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, str],
    aggregation: str,
    direct_limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """One aggregate per measure (output name to column) grouped by ``keys``.

    All but the percentiles combine within each task first, so a hot group is no hot task; the
    percentiles go through the exact operator that splits large groups.
    """
    if aggregation not in PERCENTILES:
        return df.groupBy(*keys).agg(
            *[_simple_aggregate(aggregation, F.col(c)).alias(out) for out, c in measures.items()]
        )
    result = None
    for out, column in measures.items():
        one = exact_percentiles(
            df, keys, column, [PERCENTILES[aggregation]], [out], direct_limit
        )
        # Chart keys are never null (the where-clause removed those rows), so a plain join will do.
        result = one if result is None else result.join(one, list(keys))
    return result


def line_chart(
    df: DataFrame, spec: ChartSpec, direct_limit: int = DIRECT_LIMIT, max_rows: int = MAX_ROWS
) -> DataFrame:
    """X with one aggregate per measure, or the raw measures; split gives x, split, value rows."""
    rows = chart_filter(df, spec, spec.x_column)
    x = time_bucket(rows, spec).alias("x")
    split = [col(spec.split_by).alias("split")] if spec.split_by else []
    keys = ["x", "split"] if split else ["x"]
    if spec.aggregation == "none":
        measures = [col(y) for y in spec.y_columns]
        raw = rows.select(x, *split, *measures)
        # Equal X at the cap: all output columns settle which rows stay.
        return first_rows(raw, [*keys, *[y for y in spec.y_columns if y not in keys]], max_rows)
    inner = {y: f"_y{i}" for i, y in enumerate(spec.y_columns)}
    picked = rows.select(x, *split, *[col(y).alias(n) for y, n in inner.items()])
    names = {"value": "_y0"} if split else inner
    grouped = chart_aggregate(picked, keys, names, spec.aggregation, direct_limit)
    return grouped.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(max_rows)


def histogram_chart(df: DataFrame, spec: ChartSpec, max_rows: int = MAX_ROWS) -> DataFrame:
    """Counts per bin, empty bins kept; with a split, per bin and split value.

    One pass for the range, one for the counts. Counts are gathered per split value into at most 100
    entries, and the empty bins are filled in from there, so no bin table is joined.
    """
    info = column_infos(df, [spec.value_column])[0]
    filtered = chart_filter(df, spec, spec.value_column)
    value = finite_value(info)
    filled, low, high = value_range(filtered, spec.value_column)
    bins = min(max(spec.bin_count, 1), MAX_BINS)
    whole = info.kind == "integer"
    split = [col(spec.split_by).cast("string").alias("split")] if spec.split_by else []
    keys = ["split"] if split else []
    bound = "bigint" if whole else "double"
    if not filled:
        empty = [F.lit(None).cast("string").alias("split")] if split else []
        return df.limit(0).select(
            F.lit(0).alias("bin_index"), F.lit(None).cast(bound).alias("lower_bound"),
            F.lit(None).cast(bound).alias("upper_bound"), *empty,
            F.lit(0).cast("bigint").alias("count"),
        )
    if whole:
        shape = IntBins.over(int(low), int(high), bins)
        index = shape.index_sql(value)
        bounds = [(shape.lower(i), shape.upper(i)) for i in range(shape.bins)]
    elif float(low) == float(high):
        index = "0"
        bounds = [(float(low), float(high))]
    else:
        shape = FloatEdges(float(low), float(high), bins)
        index = shape.left_closed_sql(f"double({value})")
        bounds = [(shape.edge(i), shape.edge(i + 1)) for i in range(bins)]
    counts = (
        filtered.select(F.expr(value).alias("_v"), F.expr(index).alias("_bin"), *split)
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_n"))
    )
    if keys:
        # In (bin, split) order no split value beyond the row cap can be among the first rows.
        shown = counts.select("split").distinct().orderBy("split").limit(max_rows)
        counts = counts.join(F.broadcast(shown), "split", "left_semi")
    gathered = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts")
    )
    grid = ", ".join(
        f"named_struct('bin_index', {i}, 'lower_bound', cast('{a!r}' as {bound}), "
        f"'upper_bound', cast('{b!r}' as {bound}))"
        for i, (a, b) in enumerate(bounds)
    )
    dense = gathered.selectExpr(*keys, "_counts", f"inline(array({grid}))")
    return (
        dense.select(
            "bin_index", "lower_bound", "upper_bound", *keys,
            F.coalesce(F.element_at("_counts", F.col("bin_index")), F.lit(0).cast("bigint")).alias(
                "count"
            ),
        )
        .orderBy("bin_index", *keys)
        .limit(max_rows)
    )


def bar_chart(df: DataFrame, spec: ChartSpec, direct_limit: int = DIRECT_LIMIT) -> DataFrame:
    """The top categories by row count or by the aggregate of a measure, optionally broken down.

    Equal ranks go in category order. Without a split the ranking is the answer: one group-by and a
    top-k. With a split the at most 100 winners are broadcast back to the rows.
    """
    measure = "" if spec.counts_rows else spec.y_columns[0]
    rows = chart_filter(df, spec, spec.x_column, measure)
    x = col(spec.x_column).cast("string").alias("x")
    split = [col(spec.split_by).cast("string").alias("split")] if spec.split_by else []
    value = [col(measure).alias("_v")] if measure else []
    picked = rows.select(x, *split, *value)

    def measured(frame: DataFrame, keys: list[str], out: str) -> DataFrame:
        if not measure:
            return frame.groupBy(*keys).agg(F.count("*").alias(out))
        return chart_aggregate(frame, keys, {out: "_v"}, spec.aggregation, direct_limit)

    top_n = min(max(spec.top_n, 1), MAX_TOP_N)
    best = [F.col("_rank_by").desc_nulls_last(), F.col("x").asc()]
    ranked = measured(picked, ["x"], "_rank_by").orderBy(*best).limit(top_n)
    if not split:
        return ranked.select("x", F.col("_rank_by").alias(measure or "count"))
    out = "value" if measure else "count"
    detail = measured(picked.join(F.broadcast(ranked), "x"), ["x", "split", "_rank_by"], out)
    return detail.orderBy(*best, "split").select("x", "split", out)


def scatter_chart(df: DataFrame, spec: ChartSpec, max_rows: int = MAX_ROWS) -> DataFrame:
    """X and Y pairs in X order, at most ``max_rows``; Y settles equal X."""
    rows = chart_filter(df, spec, spec.x_column, spec.y_columns[0])
    split = [col(spec.split_by).cast("string").alias("split")] if spec.split_by else []
    names = ["x", *(["split"] if split else []), "y"]
    points = rows.select(
        col(spec.x_column).alias("x"), col(spec.y_columns[0]).alias("y"), *split
    )
    return first_rows(points, names, max_rows)


def chart_frame(
    df: DataFrame, spec: ChartSpec, direct_limit: int = DIRECT_LIMIT,
    columns: DataFrame | None = None, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Check a specification and build its plan, of ``max_rows`` rows at most."""
    check_spec(spec, columns)
    if spec.chart_type == "histogram":
        return histogram_chart(df, spec, max_rows)
    if spec.chart_type == "bar":
        return bar_chart(df, spec, direct_limit)
    if spec.chart_type == "scatter":
        return scatter_chart(df, spec, max_rows)
    return line_chart(df, spec, direct_limit, max_rows)


@dataclass(frozen=True)
class ChartResult:
    """The rows of a chart; ``truncated`` says that the cap cut more rows off."""

    frame: DataFrame
    truncated: bool


def chart_result(
    df: DataFrame, spec: ChartSpec, columns: DataFrame | None = None, max_rows: int = MAX_ROWS
) -> ChartResult:
    """The rows of a chart, held on the driver (``max_rows`` at most), and whether there are more."""
    rows = small_frame(chart_frame(df, spec, columns=columns, max_rows=max_rows + 1))
    return ChartResult(rows.limit(max_rows), rows.count() > max_rows)


def chart_pivot(
    series: DataFrame, x: str = "x", split: str = "split", value: str = "value",
    max_columns: int = MAX_PIVOT,
) -> DataFrame:
    """Long chart rows to one column per split value; a null split is ``(blank)``, text no number null.

    More split values than ``max_columns`` are an error: none is left out.
    """
    long = series.select(
        F.col(x).alias("x"),
        F.coalesce(F.col(split).cast("string"), F.lit("(blank)")).alias("_split"),
        F.expr(f"try_cast(`{value}` as double)").alias("_value"),
    )
    found = long.select("_split").distinct().orderBy("_split").limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ChartSpecError(f"more than {max_columns} split values")
    names = [r[0] for r in found]
    return long.groupBy("x").pivot("_split", names).agg(F.max("_value"))


def auto_chart(df: DataFrame, found: Structure, chart_type: str | None = None) -> DataFrame:
    """The default chart of a profiled table."""
    spec = auto_spec(
        found.columns, found.measures, found.temporal, found.primary_temporal, chart_type
    )
    return chart_frame(df, spec)
