"""Meaning of columns, as rules over the rows of the column-metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.names import is_date_name, is_identifier_name

# Thresholds of the flags, in percent.
HIGH_MISSINGNESS_PCT = 30.0
ID_NULLS_PCT = 5.0
CATEGORICAL_MAX_RATIO = 0.5


def semantic_type(strict_dates: bool = False) -> Column:
    """The first rule that fits. Text rules look at all distinct values, so row order plays no part."""
    name = F.col("column_name")
    rows, unique, kind = F.col("row_count"), F.col("unique_count"), F.col("kind")
    words = F.col("boolean_words_only") & (F.col("boolean_words") <= 2)
    few = (rows == 0) | (unique < rows * CATEGORICAL_MAX_RATIO)
    text = (
        F.when(is_date_name(name, strict_dates), "datetime")
        .when(F.coalesce(words, F.lit(True)), "boolean_like")
        .when(few, "categorical")
        .otherwise("text")
    )
    return (
        F.when(is_identifier_name(name), "id_like")
        .when((kind == "integer") & (unique == rows) & (rows > 0), "id_like")
        .when(kind.isin("integer", "float", "decimal"), "numeric")
        .when(kind == "boolean", "boolean_like")
        .when(kind == "temporal", "datetime")
        .when(kind == "string", text)
        .otherwise("unknown")
    )


def quality_flags() -> Column:
    """Flags of one column; null counts as a value for the constant test."""
    null_share = F.col("null_count") * 100.0 / F.nullif(F.col("row_count"), F.lit(0).cast("bigint"))
    flags = [
        F.when(null_share > HIGH_MISSINGNESS_PCT, F.lit("high_missingness")),
        F.when((null_share > ID_NULLS_PCT) & (F.col("semantic_type") == "id_like"),
               F.lit("id_with_nulls")),
        F.when((F.col("row_count") > 0) & (F.col("unique_count") == 1), F.lit("constant_column")),
    ]
    return F.filter(F.array(*flags), lambda flag: flag.isNotNull())


def with_semantics(metrics: DataFrame, strict_dates: bool = False) -> DataFrame:
    """Column metrics plus semantic type and flags, with top values cut to the type's number."""
    typed = metrics.withColumn("semantic_type", semantic_type(strict_dates))
    kept = F.when(F.col("semantic_type").isin("datetime", "unknown"), F.lit(0)).when(
        (F.col("semantic_type") == "id_like") & ~F.col("physical_type").isin(*NUMERIC_BRANCH),
        F.lit(5),
    ).otherwise(F.lit(8))
    shown = kept > 0
    return (
        typed.withColumn("quality_flags", quality_flags())
        .withColumn("top_values", F.slice("top_values", F.lit(1), kept))
        .withColumns(
            {n: F.when(shown, F.col(n)) for n in ("top_value", "top_count", "top_pct")}
        )
    )


# The types profiled as numbers whatever their meaning.
NUMERIC_BRANCH = ["int", "bigint", "float", "double"]


def type_counts(metrics: DataFrame) -> DataFrame:
    """Number of numeric, categorical and datetime columns per dataset."""
    kinds = ["numeric", "categorical", "datetime"]
    return metrics.groupBy("dataset").agg(
        *[F.count_if(F.col("semantic_type") == k).alias(f"{k}_column_count") for k in kinds]
    )


def column_severity(metrics: DataFrame) -> DataFrame:
    """Critical for missing mass or null identifiers, warning for any other flag."""
    critical = F.arrays_overlap(
        "quality_flags", F.array(F.lit("high_missingness"), F.lit("id_with_nulls"))
    )
    level = F.when(critical, "critical").when(F.size("quality_flags") > 0, "warning").otherwise("none")
    return metrics.withColumn("severity", level)


def column_browser(
    metrics: DataFrame,
    search: str = "",
    semantic: str = "all",
    flags: str = "all",
    sort_by: str = "ordinal",
    descending: bool = False,
) -> DataFrame:
    """Columns whose name holds ``search``, of one semantic type, by flags, in the wanted order.

    ``flags`` is ``all``, ``has_flags`` or ``critical_only``. Missing numbers sort lowest.
    """
    found = column_severity(metrics)
    if search.strip():
        found = found.where(F.contains(F.lower("column_name"), F.lit(search.lower())))
    if semantic != "all":
        found = found.where(F.col("semantic_type") == semantic)
    if flags == "has_flags":
        found = found.where(F.size("quality_flags") > 0)
    elif flags == "critical_only":
        found = found.where(F.col("severity") == "critical")
    key = F.col(sort_by)
    if dict(found.dtypes)[sort_by] in ("float", "double"):
        key = F.when(~F.isnan(key), key)
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return found.orderBy(order, "ordinal")
