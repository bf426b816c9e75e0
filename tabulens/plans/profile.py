"""A full dataset profile as a set of small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.names import col
from tabulens.functions.quantiles import DIRECT_LIMIT
from tabulens.operators import quality, structure
from tabulens.operators.columns import TOP_VALUES, column_metrics, pct
from tabulens.operators.duplicates import duplicate_row_pct
from tabulens.operators.grain import MAX_CANDIDATES, grain_key_candidates, search_is_cut
from tabulens.operators.histograms import profile_histograms
from tabulens.operators.semantics import type_counts, with_semantics
from tabulens.session import small_frame, together

# Fixed value: the version of the structure rules a stored profile was made with.
STRUCTURE_VERSION = "v6"
# A hash bound keeps this many times the wanted rows, so a bound that keeps too few is rare.
SAMPLE_SLACK = 4


@dataclass(frozen=True)
class Structure:
    """Structure tables of one or more datasets, all small."""

    columns: DataFrame
    temporal: DataFrame
    primary_temporal: DataFrame
    entities: DataFrame
    measures: DataFrame
    pool: DataFrame
    grain_candidates: DataFrame
    primary_grain: DataFrame
    # More sets of columns than the key search may try.
    key_search_cut: bool = False


@dataclass(frozen=True)
class Profile:
    summary: DataFrame
    structure: Structure
    histograms: DataFrame
    issues: DataFrame
    warnings: DataFrame
    roles: DataFrame

    @property
    def columns(self) -> DataFrame:
        return self.structure.columns


def infer_structure(
    df: DataFrame, dataset: str, strict_dates: bool = False, direct_limit: int = DIRECT_LIMIT
) -> Structure:
    """Column metrics with meaning, time axes, entities, measures and the row key."""
    metrics = column_metrics(df, dataset, TOP_VALUES, direct_limit)
    columns = small_frame(with_semantics(metrics, strict_dates))
    temporal = small_frame(structure.temporal_columns(columns))
    axis, entities, pool, measures = together(
        df.sparkSession,
        lambda: small_frame(structure.primary_temporal(temporal)),
        lambda: small_frame(structure.entity_columns(columns)),
        lambda: small_frame(structure.key_candidate_pool(columns, temporal)),
        lambda: small_frame(structure.measure_ranking(columns)),
    )
    counted = {r.column_name: r for r in columns.select(
        "column_name", "unique_count", "row_count").collect()}
    rows = next(iter(counted.values())).row_count if counted else 0
    names = [r.column_name for r in pool.orderBy("position").collect()]
    # The key is chosen among all candidates; only what is shown is cut.
    candidates = grain_key_candidates(
        df, dataset, names, rows, {name: r.unique_count for name, r in counted.items()}, keep=None
    )
    return Structure(
        columns=columns,
        temporal=temporal,
        primary_temporal=axis,
        entities=entities,
        measures=measures,
        pool=pool,
        grain_candidates=candidates.where(F.col("rank") <= MAX_CANDIDATES),
        key_search_cut=search_is_cut(names),
        primary_grain=small_frame(structure.primary_grain(candidates, entities, axis)),
    )


def profile(
    df: DataFrame,
    dataset: str,
    strict_dates: bool = False,
    sparse_prefix: str = quality.SPARSE_PREFIX,
    direct_limit: int = DIRECT_LIMIT,
) -> Profile:
    """Profile a whole table. The heavy work is a fixed number of jobs; all results are small."""
    named = F.lit(dataset)
    found, duplicates, histograms = together(
        df.sparkSession,
        lambda: infer_structure(df, dataset, strict_dates, direct_limit),
        lambda: small_frame(duplicate_row_pct(df).withColumn("dataset", named)),
        lambda: small_frame(profile_histograms(df).withColumn("dataset", named)),
    )
    metrics, grain, axis = found.columns, found.primary_grain, found.primary_temporal
    sizes = metrics.groupBy("dataset").agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.sum("null_count").alias("null_cells"),
    )
    cells = F.col("row_count") * F.col("column_count")
    sizes = sizes.withColumn("missing_cell_pct", pct(F.col("null_cells"), cells))
    shown = found.entities.where(F.col("rank") <= structure.MAX_ENTITIES)
    sizes, issues, roles = together(
        df.sparkSession,
        lambda: small_frame(sizes),
        lambda: small_frame(quality.quality_issues(metrics, grain, sparse_prefix)),
        lambda: small_frame(structure.column_roles(metrics, grain, shown, found.temporal)),
    )

    def summary() -> DataFrame:
        text = quality.profile_narrative(sizes, grain, found.entities, axis, found.measures, issues)
        return small_frame(
            sizes.join(duplicates.select("dataset", "duplicate_row_pct"), "dataset")
            .join(type_counts(metrics), "dataset")
            .join(quality.quality_score(sizes, issues), "dataset")
            .join(text, "dataset")
            .withColumn("structure_version", F.lit(STRUCTURE_VERSION))
            .withColumn("metric_scope", F.lit("full"))
        )

    headline, warnings = together(
        df.sparkSession,
        summary,
        lambda: small_frame(structure.structure_warnings(sizes, grain, axis)),
    )
    return Profile(headline, found, histograms, issues, warnings, roles)


def sampled_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose key has the lowest MD5: the same rows on every run and in any layout.

    A bound on the digest first cuts the table to a few times the sample, so only that much is
    ordered. Ties of the digest are settled by the key, so the key should be unique.
    """
    total = df.count()
    hashed = df.withColumn("_h", F.md5(col(key).cast("string")))
    share = SAMPLE_SLACK * rows / max(1, total)
    if share < 1:
        bound = F.col("_h") < f"{int(share * 2**52):013x}"
        if hashed.where(bound).count() >= rows:
            hashed = hashed.where(bound)
    return hashed.orderBy("_h", col(key).asc_nulls_last()).limit(rows).drop("_h")


def sampled_profile(df: DataFrame, dataset: str, key: str, rows: int) -> Profile:
    """A profile of a deterministic sample; its scope says so unless the sample is the table."""
    sample = sampled_rows(df, key, rows)
    found = profile(sample, dataset)
    whole = df.count() <= rows
    scope = F.lit("full" if whole else "sample")
    return Profile(
        summary=found.summary.withColumn("metric_scope", scope),
        structure=found.structure,
        histograms=found.histograms,
        issues=found.issues,
        warnings=small_frame(
            structure.structure_warnings(
                found.summary, found.structure.primary_grain, found.structure.primary_temporal,
                sampled=not whole,
            )
        ),
        roles=found.roles,
    )
