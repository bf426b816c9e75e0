"""Quality issues, their score, their drill-downs and the text that sums a profile up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.names import col

# Thresholds and impacts of the issues.
MISSING_MASS_SHARE = 0.15
MISSING_COLUMN_PCT = 15.0
MISSING_COLUMNS_SHOWN = 20
HIGH_NULL_PCT = 25.0
UNIQUE_KEY_SHARE = 0.99
HIGH_CARDINALITY = 200
SPARSE_PREFIX = "gk_"
SPARSE_NULL_PCT = 60.0
SPARSE_COLUMN_SHARE = 0.08
SEVERITIES = ["critical", "warning", "info"]
COMPLETE_ROW_COLUMNS = 8
DRILL_DOWN_ROWS = 20
NAMED_COLUMNS = 5
NAMED_RISKS = 5


def _issue(
    frame: DataFrame, kind: str, severity: Column, category: str, title: Column, impact: Column,
    columns: Column | None = None,
) -> DataFrame:
    return frame.select(
        "dataset",
        F.lit(kind).alias("issue"),
        severity.alias("severity"),
        F.lit(category).alias("category"),
        title.alias("title"),
        (F.array("column_name") if columns is None else columns).alias("affected_columns"),
        impact.cast("double").alias("score_impact"),
        F.col("ordinal").cast("int").alias("ordinal"),
    )


def missing_mass(metrics: DataFrame) -> DataFrame:
    """One issue per dataset whose cells are null beyond the threshold."""
    sparse = F.collect_list(
        F.when(F.col("null_pct") > MISSING_COLUMN_PCT, F.struct("ordinal", "column_name"))
    )
    shown = F.transform(
        F.slice(F.array_sort(F.col("_sparse")), 1, MISSING_COLUMNS_SHOWN), lambda s: s["column_name"]
    )
    cells = F.nullif(F.sum("row_count"), F.lit(0).cast("bigint"))
    totals = (
        metrics.groupBy("dataset")
        .agg((F.sum("null_count") / cells).alias("_share"), sparse.alias("_sparse"))
        .where(F.col("_share") > MISSING_MASS_SHARE)
        .withColumn("ordinal", F.lit(-1))
    )
    return _issue(
        totals, "missing_mass", F.lit("warning"), "missingness",
        F.lit("Many null cells in the table"),
        F.least(F.lit(25.0), F.col("_share") * 40), shown,
    )


def duplicate_keys(metrics: DataFrame, grain: DataFrame | None = None) -> DataFrame:
    """Identifier columns with repeats, but for the members of a composite row key."""
    keys = metrics.where(
        (F.col("semantic_type") == "id_like")
        & (F.col("row_count") > 0)
        & (F.col("unique_count") < F.col("row_count") * UNIQUE_KEY_SHARE)
    )
    if grain is not None:
        members = grain.where(F.size("columns") > 1).select(
            "dataset", F.explode("columns").alias("column_name")
        )
        keys = keys.join(members, ["dataset", "column_name"], "left_anti")
    repeats = (1 - F.col("unique_count") / F.col("row_count")) * 100
    return _issue(
        keys, "duplicate_key", F.lit("critical"), "keys",
        F.concat(F.lit("Repeated values in likely key "), "column_name"),
        F.least(F.lit(35.0), repeats / 2),
    )


def high_nulls(metrics: DataFrame, sparse_prefix: str = SPARSE_PREFIX) -> DataFrame:
    """Columns with many nulls; a family of columns meant to be sparse weighs less."""
    in_family = F.lower("column_name").startswith(sparse_prefix)
    family = (in_family & (F.col("null_pct") >= SPARSE_NULL_PCT)).cast("int")
    share = F.avg(family).over(W.partitionBy("dataset"))
    found = metrics.withColumn("_share", share).where(F.col("null_pct") > HIGH_NULL_PCT)
    expected = in_family & (F.col("_share") >= SPARSE_COLUMN_SHARE)
    return _issue(
        found, "high_null", F.when(expected, "info").otherwise("warning"), "missingness",
        F.concat(F.lit("Many nulls in "), "column_name"),
        F.when(expected, F.least(F.lit(4.0), F.col("null_pct") / 10)).otherwise(
            F.least(F.lit(15.0), F.col("null_pct") / 3)
        ),
    )


def constants(metrics: DataFrame) -> DataFrame:
    found = metrics.where(F.array_contains("quality_flags", "constant_column"))
    return _issue(
        found, "constant", F.lit("info"), "variance",
        F.concat(F.lit("A single value in "), "column_name"), F.lit(2.0),
    )


def high_cardinality(metrics: DataFrame) -> DataFrame:
    found = metrics.where(
        (F.col("semantic_type") == "categorical") & (F.col("unique_count") > HIGH_CARDINALITY)
    )
    return _issue(
        found, "high_cardinality", F.lit("info"), "cardinality",
        F.concat(F.lit("Many categories in "), "column_name"), F.lit(3.0),
    )


def quality_issues(
    metrics: DataFrame, grain: DataFrame | None = None, sparse_prefix: str = SPARSE_PREFIX
) -> DataFrame:
    """All issues of all datasets, ranked."""
    found = (
        missing_mass(metrics)
        .unionByName(duplicate_keys(metrics, grain))
        .unionByName(high_nulls(metrics, sparse_prefix))
        .unionByName(constants(metrics))
        .unionByName(high_cardinality(metrics))
    )
    return rank_issues(found)


def rank_issues(issues: DataFrame) -> DataFrame:
    """Critical, warning, info; the larger impact first; then the order the rules found them in."""
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    group = F.when(F.col("issue") == "missing_mass", 0).when(F.col("issue") == "duplicate_key", 1)
    order = W.partitionBy("dataset").orderBy(
        level, F.desc("score_impact"), group.otherwise(2), "ordinal", "issue"
    )
    return issues.withColumn("rank", F.row_number().over(order))


def quality_score(datasets: DataFrame, issues: DataFrame) -> DataFrame:
    """100 less all impacts, within 0 and 100; a dataset without issues scores 100."""
    lost = issues.groupBy("dataset").agg(F.sum("score_impact").alias("_lost"))
    left = 100.0 - F.coalesce("_lost", F.lit(0.0))
    return (
        datasets.select("dataset")
        .join(lost, "dataset", "left")
        .select(
            "dataset",
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), left)), 2).alias("quality_score"),
        )
    )


# --- drill-downs: the rows behind an issue ------------------------------------------------------


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null in the given columns, by default the first eight, against all rows."""
    names = list(columns or df.columns[:COMPLETE_ROW_COLUMNS])
    filled = F.lit(True)
    for name in names:
        filled = filled & col(name).isNotNull()
    return df.agg(F.count_if(filled).alias("complete_rows"), F.count("*").alias("total"))


def duplicate_key_values(df: DataFrame, column: str, limit: int = DRILL_DOWN_ROWS) -> DataFrame:
    """The most repeated values of a key column."""
    counted = df.groupBy(col(column)).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return counted.orderBy(F.desc("n"), col(column).asc_nulls_last()).limit(limit)


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(col(column).isNull()).alias("nulls"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).distinct()


def top_categories(df: DataFrame, column: str, limit: int = DRILL_DOWN_ROWS) -> DataFrame:
    counted = df.groupBy(col(column)).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), col(column).asc_nulls_last()).limit(limit)


# --- summary text -------------------------------------------------------------------------------


def _first_names(frame: DataFrame, order: str, keep: int, alias: str) -> DataFrame:
    """The first ``keep`` column names per dataset as one text; one short list per dataset."""
    ranked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "column_name")))
    return frame.groupBy("dataset").agg(
        F.array_join(F.transform(F.slice(ranked, 1, keep), lambda s: s["column_name"]), ", ").alias(
            alias
        )
    )


def likely_grain(grain: DataFrame) -> DataFrame:
    return grain.select(
        "dataset",
        F.concat(F.lit("One row per "), F.array_join("columns", " + "), F.lit(".")).alias(
            "likely_grain"
        ),
    )


def profile_narrative(
    datasets: DataFrame, grain: DataFrame, entities: DataFrame, primary_axis: DataFrame,
    measures: DataFrame, issues: DataFrame,
) -> DataFrame:
    """A short text per dataset: size, row key or identifiers, time axis, measures, risks.

    ``datasets`` has one row per dataset with ``row_count`` and ``column_count``.
    """
    titles = issues.where(F.col("rank") <= NAMED_RISKS).groupBy("dataset").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))),
                        lambda s: s["title"]),
            "; ",
        ).alias("_risks")
    )
    axis = primary_axis.select("dataset", F.col("column_name").alias("_axis"))
    facts = datasets
    for part in (
        likely_grain(grain),
        _first_names(entities, "rank", NAMED_COLUMNS, "_ids"),
        axis,
        _first_names(measures, "rank", NAMED_COLUMNS, "_measures"),
        titles,
    ):
        facts = facts.join(part, "dataset", "left")

    def sentence(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value, F.lit("."))

    size = F.concat(
        F.col("dataset"), F.lit(" has "), F.format_number("row_count", 0), F.lit(" rows and "),
        F.col("column_count").cast("string"), F.lit(" columns."),
    )
    return facts.select(
        "dataset",
        "likely_grain",
        F.concat_ws(
            "\n\n",
            size,
            F.coalesce("likely_grain", sentence("Likely identifiers: ", F.col("_ids"))),
            sentence("Time axis: ", F.col("_axis")),
            sentence("Main measures: ", F.col("_measures")),
            sentence("Main risks: ", F.col("_risks")),
        ).alias("narrative"),
    )
