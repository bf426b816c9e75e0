"""Time axes, entities, measures, key pool, roles: rules over column metrics, one window per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.names import is_period_name, name_strength
from tabulens.operators.semantics import NUMERIC_BRANCH

# Result sizes and the thresholds of a confidence.
MAX_ENTITIES = 15
MAX_MEASURES = 20
MAIN_MEASURES = 8
MEASURE_HIGH, MEASURE_MEDIUM = 0.8, 0.55
MAX_KEY_COLUMNS = 10
YEAR_LOW, YEAR_HIGH = 1900, 2100
ROLES = ["grain key", "entity id", "time", "measure"]


def _profiled_as_number() -> Column:
    return (F.col("semantic_type") == "numeric") | F.col("physical_type").isin(NUMERIC_BRANCH)


def _continuous() -> Column:
    return (
        ~_profiled_as_number()
        & ~F.col("semantic_type").isin("categorical", "boolean_like")
        & ((F.col("semantic_type") == "datetime") | F.col("physical_type").isin("date", "timestamp",
                                                                               "timestamp_ntz"))
    )


def _discrete() -> Column:
    """A period by name and shape: a year range, few distinct numbers, or text of digits."""
    named = is_period_name(F.col("column_name"))
    filled = F.col("non_null_count") > 0
    distinct = F.col("unique_count") - F.when(F.col("null_count") > 0, 1).otherwise(0)
    compact = distinct <= F.greatest(F.lit(24), F.floor(F.col("row_count") * 0.1))
    years = (F.col("min_num") >= YEAR_LOW) & (F.col("max_num") <= YEAR_HIGH)
    digits = F.col("digit_rows") >= 0.8 * F.col("non_null_count")
    return F.when(
        F.col("kind") == "integer", F.when(filled, years | (named & compact)).otherwise(named)
    ).when(F.col("kind") == "string", named & (~filled | digits)).otherwise(F.lit(False))


def temporal_columns(metrics: DataFrame) -> DataFrame:
    """Continuous time columns and discrete periods, with a confidence."""
    high = _continuous() | is_period_name(F.col("column_name"))
    return metrics.where(_continuous() | _discrete()).select(
        "dataset",
        "ordinal",
        "column_name",
        F.when(_continuous(), "continuous_datetime").otherwise("discrete_period").alias(
            "temporal_kind"
        ),
        F.when(high, "high").otherwise("medium").alias("confidence"),
    )


def discrete_periods(metrics: DataFrame) -> DataFrame:
    return temporal_columns(metrics).where(F.col("temporal_kind") == "discrete_period")


def primary_temporal(temporal: DataFrame) -> DataFrame:
    """The first time axis per dataset: high confidence, then continuous, then column order."""
    order = W.partitionBy("dataset").orderBy(
        (F.col("confidence") == "high").desc(),
        (F.col("temporal_kind") == "continuous_datetime").desc(),
        "ordinal",
    )
    return temporal.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def entity_columns(metrics: DataFrame) -> DataFrame:
    """Identifier columns with a confidence, ranked. Callers show the first MAX_ENTITIES."""
    strength = name_strength(F.col("column_name"))
    nulls, kind = F.col("null_pct"), F.col("semantic_type")
    seed = (kind == "id_like") & ~_profiled_as_number() & ~_continuous()
    wide_enough = (strength >= 3) & (F.col("unique_count") >= 25)
    merged = (nulls <= 10) & (strength >= 2) & (
        F.when(kind.isin("categorical", "text"), wide_enough)
        .when(kind == "numeric", strength >= 3)
        .otherwise(kind == "id_like")
    )
    sure_below = F.when(~seed & (strength >= 3), 2).otherwise(1)
    order = W.partitionBy("dataset").orderBy((F.col("confidence") == "high").desc(), "column_name")
    return (
        metrics.where(seed | merged)
        .withColumn("confidence", F.when(nulls <= sure_below, "high").otherwise("medium"))
        .withColumn("rank", F.row_number().over(order))
        .select("dataset", "ordinal", "column_name", "confidence", "rank")
    )


def key_candidate_pool(
    metrics: DataFrame, temporal: DataFrame, max_columns: int = MAX_KEY_COLUMNS
) -> DataFrame:
    """Columns worth testing as keys: the best scored ones, then every time axis.

    Ties go to the later column. A time axis already in the pool is listed once.
    """
    strength, nulls = name_strength(F.col("column_name")), F.col("null_pct")
    unique, kind = F.col("unique_count"), F.col("semantic_type")
    width = F.count("*").over(W.partitionBy("dataset"))
    entity_like = (strength >= 2) & (unique >= F.greatest(F.lit(5), F.col("_width")))
    # The scores of the pool by meaning, name and nulls.
    score = (
        F.when(kind == "id_like", 300.0 + strength * 30.0 - nulls)
        .when(kind == "categorical",
              150.0 + strength * 20.0 - nulls + F.when(entity_like, 40.0).otherwise(0.0))
        .when((kind == "numeric") & (strength >= 2),
              115.0 + F.least(F.lit(60.0), unique / 50.0) - nulls)
    )
    axes = temporal.groupBy("dataset").agg(F.count("*").alias("_axes"))
    best = W.partitionBy("dataset").orderBy(F.desc("score"), F.desc("ordinal"))
    scored = (
        metrics.withColumn("_width", width)
        .where(nulls <= 5)
        .withColumn("score", score)
        .where(F.col("score") > 0)
        .withColumn("_place", F.row_number().over(best))
        .join(axes, "dataset", "left")
        .where(F.col("_place") <= F.greatest(F.lit(0), max_columns - F.coalesce("_axes", F.lit(0))))
        .select("dataset", "ordinal", "column_name", "score", F.lit(0).alias("_block"), "_place")
    )
    axis_order = W.partitionBy("dataset").orderBy(
        (F.col("confidence") == "high").desc(),
        (F.col("temporal_kind") == "continuous_datetime").desc(),
        "ordinal",
    )
    added = temporal.select(
        "dataset", "ordinal", "column_name", F.lit(None).cast("double").alias("score"),
        F.lit(1).alias("_block"), F.row_number().over(axis_order).alias("_place"),
    ).join(scored.select("dataset", "ordinal"), ["dataset", "ordinal"], "left_anti")
    position = W.partitionBy("dataset").orderBy("_block", "_place")
    return (
        scored.unionByName(added)
        .withColumn("position", F.row_number().over(position))
        .select("dataset", "ordinal", "column_name", "score", "position")
    )


def measure_ranking(metrics: DataFrame, keep: int = MAX_MEASURES) -> DataFrame:
    """Numeric columns by spread, completeness and variety."""
    spread = F.least(F.lit(1.0), F.coalesce("std", F.lit(0.0)) / 50.0)
    complete = F.greatest(F.lit(0.0), 100.0 - F.col("null_pct")) / 100.0
    variety = F.least(F.lit(1.0), F.col("unique_count") / F.greatest(F.lit(1), F.col("row_count")))
    raw = spread * 0.5 + complete * 0.35 + variety * 0.15
    order = W.partitionBy("dataset").orderBy(F.desc("score"), "ordinal")
    return (
        metrics.where(F.col("semantic_type") == "numeric")
        .withColumn("score", F.round(raw, 4))
        .withColumn(
            "confidence",
            F.when(raw >= MEASURE_HIGH, "high").when(raw >= MEASURE_MEDIUM, "medium").otherwise("low"),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= keep)
        .select("dataset", "ordinal", "column_name", "score", "confidence", "rank")
    )


def primary_grain(
    candidates: DataFrame, entities: DataFrame, primary_axis: DataFrame
) -> DataFrame:
    """The candidate that defines one row: an (entity, time) panel first, then by rank."""
    named = entities.groupBy("dataset").agg(F.collect_set("column_name").alias("_entities"))
    axis = primary_axis.select("dataset", F.col("column_name").alias("_axis"))
    panel = (
        (F.size("columns") >= 2)
        & F.coalesce(F.array_contains("columns", F.col("_axis")), F.lit(False))
        & F.coalesce(F.arrays_overlap("columns", "_entities"), F.lit(False))
    )
    order = W.partitionBy("dataset").orderBy(F.desc("_panel"), "rank")
    return (
        candidates.join(named, "dataset", "left")
        .join(axis, "dataset", "left")
        .withColumn("_panel", F.when(panel, 2).otherwise(0))
        .withColumn("_at", F.row_number().over(order))
        .where("_at = 1")
        .select("dataset", "columns", "distinct_count", "uniqueness_ratio", "confidence", "rank")
    )


def column_roles(
    metrics: DataFrame, grain: DataFrame, entities: DataFrame, temporal: DataFrame
) -> DataFrame:
    """Roles of each column, best first, and the sort key of the role column."""
    key = ["dataset", "column_name"]

    def role(frame: DataFrame, index: int) -> DataFrame:
        return frame.select(*key, F.lit(index).alias("_role"))

    structural = (
        role(grain.withColumn("column_name", F.explode("columns")), 0)
        .unionByName(role(entities, 1))
        .unionByName(role(temporal, 2))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("_role")).alias("_roles"))
    )
    numeric = F.when(F.col("semantic_type") == "numeric", F.array(F.lit(3)))
    names = F.array(*[F.lit(r) for r in ROLES])
    return (
        metrics.select(*key, "ordinal", "semantic_type")
        .join(structural, key, "left")
        .withColumn("_roles", F.coalesce("_roles", numeric, F.array().cast("array<int>")))
        .select(
            *key,
            "ordinal",
            F.transform("_roles", lambda r: F.get(names, r)).alias("roles"),
            F.when(F.size("_roles") == 0, 0)
            .otherwise(F.size("_roles") * 100 + len(ROLES) - F.array_min("_roles"))
            .alias("role_sort_key"),
        )
    )


def structure_warnings(
    datasets: DataFrame, grain: DataFrame, primary_axis: DataFrame, sampled: bool = False
) -> DataFrame:
    """What the structure search could not settle, one row per warning."""
    scope = "sample" if sampled else "full table"
    facts = (
        datasets.select("dataset")
        .join(grain.select("dataset", F.col("confidence").alias("_grain")), "dataset", "left")
        .join(primary_axis.select("dataset", F.col("column_name").alias("_axis")), "dataset", "left")
    )
    warnings = F.array(
        F.when(F.lit(sampled), F.lit("sampled: metrics come from a sample of the rows")),
        F.when(F.col("_grain").isNull(), F.lit("no_grain: no set of columns identifies a row")),
        F.when(F.col("_axis").isNull(), F.lit("no_time_axis: pick a column for trends by hand")),
        F.when(F.col("_grain") == "medium",
               F.lit(f"medium_grain: the likely key has a few repeats ({scope})")),
    )
    return facts.select(
        "dataset", F.explode(F.filter(warnings, lambda w: w.isNotNull())).alias("warning")
    )
