"""Chart specifications: fields, checks, filters, and defaults from a profile."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.names import col

# Limits and defaults of charts.
MAX_ROWS = 5_000
MAX_PIVOT = 5_000
DEFAULT_BINS, MAX_BINS = 12, 100
DEFAULT_TOP_N, MAX_TOP_N = 25, 100
DEFAULT_LINE_MEASURES = 3
CATEGORY_MIN, CATEGORY_MAX = 2, 50
CHART_TYPES = ["histogram", "line", "bar", "scatter"]
AGGREGATIONS = [
    "none", "sum", "avg", "min", "max", "median", "stddev", "p25", "p75", "count", "count_distinct",
]
BUCKETS = ["none", "day", "week", "month", "quarter", "year"]
OPERATORS = [
    "eq", "neq", "gt", "gte", "lt", "lte", "contains", "starts_with", "in", "is_null", "is_not_null",
]
# Which filters suit which semantic type; other types take all of them.
OPERATORS_BY_TYPE = {
    "numeric": ["eq", "neq", "gt", "gte", "lt", "lte", "in", "is_null", "is_not_null"],
    "datetime": ["eq", "neq", "gt", "gte", "lt", "lte", "in", "is_null", "is_not_null"],
    "text": ["eq", "neq", "contains", "starts_with", "in", "is_null", "is_not_null"],
    "categorical": ["eq", "neq", "in", "is_null", "is_not_null"],
    "boolean_like": ["eq", "neq", "in", "is_null", "is_not_null"],
    "id_like": ["eq", "neq", "in", "is_null", "is_not_null"],
}
NUMBER = re.compile(r"-?\d+(\.\d+)?")


class ChartSpecError(ValueError):
    """A specification that cannot be drawn."""


@dataclass(frozen=True)
class ChartFilter:
    column: str
    operator: str
    value: str = ""


@dataclass(frozen=True)
class ChartSpec:
    chart_type: str
    value_column: str = ""
    bin_count: int = DEFAULT_BINS
    x_column: str = ""
    x_bucketable: bool = False
    y_columns: tuple[str, ...] = ()
    aggregation: str = "none"
    bucket: str = "none"
    filters: tuple[ChartFilter, ...] = ()
    split_by: str = ""
    top_n: int = DEFAULT_TOP_N

    @property
    def counts_rows(self) -> bool:
        """A bar chart of row counts has no measure."""
        return self.aggregation == "count" and not self.y_columns


def filter_operators(semantic: str) -> list[str]:
    return OPERATORS_BY_TYPE.get(semantic, OPERATORS)


def check_spec(spec: ChartSpec, columns: DataFrame | None = None) -> ChartSpec:
    """The spec itself, or an error naming what is missing. ``columns`` adds checks by meaning."""

    def need(condition: bool, problem: str) -> None:
        if not condition:
            raise ChartSpecError(problem)

    need(spec.chart_type in CHART_TYPES, f"unknown chart type: {spec.chart_type}")
    need(spec.aggregation in AGGREGATIONS, f"unknown aggregation: {spec.aggregation}")
    need(spec.bucket in BUCKETS, f"unknown time bucket: {spec.bucket}")
    for f in spec.filters:
        need(f.operator in OPERATORS, f"unknown filter: {f.operator}")
    if spec.chart_type == "histogram":
        need(bool(spec.value_column), "a histogram needs a numeric column")
        need(1 <= spec.bin_count <= MAX_BINS, f"bins must be 1 to {MAX_BINS}")
        return spec
    need(bool(spec.x_column), "the chart needs an X column")
    if spec.split_by and not spec.counts_rows:
        need(len(spec.y_columns) == 1, "a split chart takes exactly one measure")
    if spec.chart_type == "bar":
        need(spec.aggregation != "none", "a bar chart needs an aggregation")
        need(spec.counts_rows or bool(spec.y_columns), "a bar chart needs a measure or a row count")
        need(1 <= spec.top_n <= MAX_TOP_N, f"top N must be 1 to {MAX_TOP_N}")
        if columns is not None:
            need(spec.x_column in category_columns(columns), "bars need a category on X")
    else:
        need(bool(spec.y_columns), "the chart needs a measure")
    if spec.chart_type == "scatter":
        need(spec.x_column != spec.y_columns[0], "a scatter plot needs two different columns")
        if columns is not None:
            known = numeric_columns(columns)
            need(spec.x_column in known and spec.y_columns[0] in known,
                 "a scatter plot needs numeric columns")
    return spec


def normalise_spec(spec: ChartSpec) -> ChartSpec:
    """Out-of-range bins and N fall to their default or limit; a split keeps one measure."""

    def within(number: int, default: int, highest: int) -> int:
        return min(number, highest) if number > 0 else default

    measures = tuple(dict.fromkeys(y for y in spec.y_columns if y))
    if spec.split_by and spec.chart_type != "histogram":
        measures = measures[:1]
    fixed = replace(
        spec,
        bin_count=within(spec.bin_count, DEFAULT_BINS, MAX_BINS),
        top_n=within(spec.top_n, DEFAULT_TOP_N, MAX_TOP_N),
        y_columns=measures,
    )
    if fixed.chart_type == "scatter":
        fixed = replace(fixed, aggregation="none", bucket="none")
    return fixed


# --- filters ------------------------------------------------------------------------------------


def _operand(df: DataFrame, name: str, raw: str) -> tuple[Column, Column]:
    """The column and the literal to compare, with the literal cast so that the scan can use it."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        # Numbers and words for a truth value; any other text matches nothing.
        word = str(Decimal(raw) != 0) if NUMBER.fullmatch(raw) else raw
        return col(name), F.expr(f"try_cast({_quoted(word)} as boolean)")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name), F.expr(f"try_cast({_quoted(raw)} as {dtype.simpleString()})")
    if not NUMBER.fullmatch(raw):
        if isinstance(dtype, T.NumericType):
            raise ChartSpecError(f"{raw} is no number to compare {name} with")
        return col(name), F.lit(raw).cast(dtype)
    if isinstance(dtype, T.StringType):
        # Text against a number compares as numbers; text that is none never matches.
        return F.expr(f"try_cast(`{name.replace('`', '``')}` as double)"), F.lit(float(raw))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col(name), F.lit(float(raw))
    if "." not in raw and abs(int(raw)) < 2**63:
        return col(name), F.lit(int(raw))
    if len(raw.lstrip("-").replace(".", "")) > 38:
        raise ChartSpecError(f"{raw} has more than 38 digits")
    if "." not in raw and isinstance(dtype, T.IntegralType):
        # Beyond all whole numbers of the column: only the side matters, and doubles tell that.
        return col(name).cast("double"), F.lit(float(raw))
    return col(name), F.lit(Decimal(raw))


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def filter_condition(df: DataFrame, f: ChartFilter) -> Column | None:
    """The predicate of one filter; none for a filter without column or without its value."""
    if not f.column:
        return None
    value = f.value.strip()
    if f.operator == "is_null":
        return col(f.column).isNull()
    if f.operator == "is_not_null":
        return col(f.column).isNotNull()
    if not value:
        return None
    text = F.lower(col(f.column).cast("string"))
    if f.operator == "contains":
        return F.contains(text, F.lit(value.lower()))
    if f.operator == "starts_with":
        return F.startswith(text, F.lit(value.lower()))
    if f.operator == "in":
        parts = [part.strip() for part in value.split(",") if part.strip()]
        choices = [_operand(df, f.column, part) for part in parts]
        if not choices:
            return None
        hit = choices[0][0] == choices[0][1]
        for left, right in choices[1:]:
            hit = hit | (left == right)
        return hit
    left, right = _operand(df, f.column, value)
    return {
        "eq": left == right,
        "neq": left != right,
        "gt": left > right,
        "gte": left >= right,
        "lt": left < right,
        "lte": left <= right,
    }[f.operator]


def chart_filter(df: DataFrame, spec: ChartSpec, *required: str) -> DataFrame:
    """Rows with the required columns and the split filled in that pass every filter."""
    for name in (*required, spec.split_by):
        if name:
            df = df.where(col(name).isNotNull())
    for f in spec.filters:
        condition = filter_condition(df, f)
        if condition is not None:
            df = df.where(condition)
    return df


# --- defaults from a profile --------------------------------------------------------------------


def _names(columns: DataFrame) -> list[str]:
    return [r.column_name for r in columns.orderBy("ordinal").select("column_name").collect()]


def category_columns(columns: DataFrame) -> list[str]:
    short_text = (F.col("semantic_type") == "text") & (F.col("unique_count") <= CATEGORY_MAX)
    grouped = F.col("semantic_type").isin("categorical", "boolean_like", "id_like")
    return _names(columns.where(grouped | short_text))


def numeric_columns(columns: DataFrame, measures: DataFrame | None = None) -> list[str]:
    """Numeric columns, the ranked measures first."""
    names = _names(columns.where(F.col("semantic_type") == "numeric"))
    if measures is None:
        return names
    ranked = [r.column_name for r in measures.orderBy("rank").select("column_name").collect()]
    if not names:
        return ranked
    return list(dict.fromkeys([*(n for n in ranked if n in names), *names]))


def default_category(columns: DataFrame) -> str:
    """The first category with 2 to 50 values, else the first category."""
    names = category_columns(columns)
    handy = columns.where(F.col("unique_count").between(CATEGORY_MIN, CATEGORY_MAX))
    preferred = [n for n in _names(handy) if n in names]
    return next(iter(preferred or names), "")


def auto_spec(
    columns: DataFrame, measures: DataFrame, temporal: DataFrame, primary_axis: DataFrame,
    chart_type: str | None = None,
) -> ChartSpec:
    """The default chart of a profile: histogram, else bar, else line, else scatter."""
    numbers = numeric_columns(columns, measures)
    category = default_category(columns)
    axes = [r.column_name for r in primary_axis.select("column_name").collect()]
    axes += [n for n in _names(temporal) if n not in axes]
    kinds = {r.column_name: r.temporal_kind for r in temporal.collect()}
    times = _names(columns.where(F.col("semantic_type") == "datetime"))
    axis = next(iter(dict.fromkeys([*axes, *times])), "")
    bucketable = kinds.get(axis, "continuous_datetime" if axis in times else "") == (
        "continuous_datetime"
    )
    if chart_type is None:
        chart_type = "histogram" if numbers else "bar" if category else "line" if axis else "scatter"
    if chart_type == "histogram":
        spread = _names(columns.where(F.col("min_num") < F.col("max_num")))
        binned = next((n for n in numbers if n in spread), next(iter(numbers), ""))
        return ChartSpec("histogram", value_column=binned)
    if chart_type == "bar":
        return ChartSpec(
            "bar", x_column=category, y_columns=tuple(numbers[:1]),
            aggregation="sum" if numbers else "count",
        )
    if chart_type == "line":
        shown = [n for n in numbers if n != axis][:DEFAULT_LINE_MEASURES]
        return ChartSpec(
            "line", x_column=axis, x_bucketable=bucketable, y_columns=tuple(shown),
            aggregation="avg", bucket="month" if bucketable else "none",
        )
    pair = (numbers[:2] + numbers[:1])[:2]
    return ChartSpec(
        "scatter", x_column=pair[0] if pair else "", y_columns=tuple(pair[1:2]), aggregation="none"
    )
