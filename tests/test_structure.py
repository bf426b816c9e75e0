"""Structure inference and quality rules on the shapes they are about."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabulens.operators import grain, quality, semantics, structure
from tabulens.operators.columns import column_facts
from tabulens.plans.profile import infer_structure, profile, sampled_profile, sampled_rows


def facts(df, name="t"):
    return semantics.with_semantics(column_facts(df, name))


def names(df):
    return {r.column_name for r in df.collect()}


@pytest.fixture(scope="module")
def panel(spark):
    """Rents of 31 tenants over four seasons."""
    rows = [(t, s, "east wing", 400 + t * 7.25 - s / 8) for s in range(2015, 2019) for t in range(31)]
    return spark.createDataFrame(rows, "tenant_id int, season int, wing string, rent double")


def test_panel_grain_is_entity_and_period(panel):
    found = profile(panel, "panel")
    axis = found.structure.primary_temporal.first()
    assert (axis.column_name, axis.temporal_kind) == ("season", "discrete_period")
    assert set(found.structure.primary_grain.first().columns) == {"tenant_id", "season"}
    summary = found.summary.first()
    assert summary.likely_grain == "One row per tenant_id + season."
    # Members of a composite key are no duplicate-key issue.
    assert found.issues.where("issue = 'duplicate_key'").count() == 0
    roles = {r.column_name: r for r in found.roles.collect()}
    assert roles["season"].roles == ["grain key", "time"] and roles["season"].role_sort_key == 204
    assert roles["tenant_id"].roles == ["grain key", "entity id"]
    assert roles["rent"].roles == ["measure"] and roles["rent"].role_sort_key == 101
    assert roles["wing"].roles == [] and roles["wing"].role_sort_key == 0


def test_wide_panel_finds_the_late_id(spark):
    rows = spark.range(37 * 6).select((F.col("id") % 37).alias("v"), F.floor(F.col("id") / 37).alias("s"))
    shelves = [F.pmod(F.col("v") * (i + 3), F.lit(5 + i)).alias(f"shelf{i}") for i in range(14)]
    df = rows.select(
        *shelves, F.col("v").cast("int").alias("vendorNo"), (F.col("s") + 2011).cast("int").alias("season"),
        (F.col("v") / 3 + F.col("s")).alias("margin"),
    )
    assert set(infer_structure(df, "wide").primary_grain.first().columns) == {"vendorNo", "season"}


def test_the_key_is_chosen_before_the_list_is_cut(spark):
    """Nineteen columns are unique alone; the panel key still leads, and 15 candidates are shown."""
    ids = [F.col("id").alias(f"code_{i}") if i % 2 else (F.col("id") * 3).alias(f"code_{i}") for i in range(19)]
    df = spark.range(400).select(
        *ids, (F.col("id") % 40).alias("member_id"), F.make_date(F.lit(2020), F.lit(1), F.floor(F.col("id") / 40) + 1).alias("day"),
    )
    found = infer_structure(df, "t")
    assert found.grain_candidates.count() <= grain.MAX_CANDIDATES
    assert found.key_search_cut == grain.search_is_cut([r.column_name for r in found.pool.collect()])
    everything = grain.grain_key_candidates(df, "t", [f"code_{i}" for i in range(19)], keep=None, max_pairs=None)
    assert everything.count() > grain.MAX_CANDIDATES and grain.search_is_cut([f"code_{i}" for i in range(19)])


def test_late_key_duplicates_rule_a_key_out(spark):
    rows = spark.range(950).select(
        F.when(F.col("id") < 800, F.col("id") * 11).otherwise(33).alias("booking_code"), (F.col("id") % 9).alias("seats")
    )
    found = grain.grain_key_candidates(rows, "t", ["booking_code"])
    assert found.count() == 0


def test_bounds_never_change_the_search(spark):
    df = spark.range(600).select(
        (F.col("id") % 20).alias("a"), F.floor(F.col("id") / 20).alias("b"),
        (F.col("id") % 7).alias("c"), F.lit(1).alias("d"),
    )
    pool = ["a", "b", "c", "d"]
    found = {tuple(r.columns): r for r in grain.grain_key_candidates(df, "t", pool).collect()}
    brute = grain.distinct_tuples(
        df, [(x, y) for i, x in enumerate(pool) for y in pool[i + 1 :]]
    )
    good = {k for k, n in brute.items() if n / 600 >= 0.98}
    assert set(found) == good and ("a", "b") in found


def test_triples_only_without_a_sure_pair(spark):
    df = spark.range(1000).select(
        (F.col("id") % 10).alias("x_id"), (F.floor(F.col("id") / 10) % 10).alias("y_id"),
        F.floor(F.col("id") / 100).alias("z_id"),
    )
    found = grain.grain_key_candidates(df, "t", ["x_id", "y_id", "z_id"]).collect()
    assert [r.columns for r in found] == [["x_id", "y_id", "z_id"]]


def test_validate_grain_counts_nulls_as_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, None)], "a int, b int")
    r = grain.validate_grain(df, "t", [("a", "b"), ("a",)]).collect()
    assert [(x.columns, x.distinct_count, x.confidence) for x in r] == [(["a", "b"], 4, "high")]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("customerId", "id_like"), ("custkey", "numeric"), ("SKU", "id_like"), ("paid", "numeric"),
     ("order key", "id_like"), ("member_no", "id_like"), ("uid", "id_like"), ("codex", "numeric")],
)
def test_name_rules(spark, name, expected):
    df = spark.createDataFrame([(1.5,), (1.5,)], "v double").toDF(name)
    assert facts(df).first().semantic_type == expected


def test_text_rules(spark):
    rows = [("Yes", "2024", "x", "same"), ("no", "2025", "y", "same"), (None, "2026", "z", "same"),
            ("YES", "n/a", "w", "other")]
    df = spark.createDataFrame(rows, "answer string, mktsegment string, free string, kind string")
    kinds = {r.column_name: r.semantic_type for r in facts(df).collect()}
    # The loose date pattern finds 'ts' inside mktsegment.
    assert kinds == {"answer": "boolean_like", "mktsegment": "datetime", "free": "text",
                     "kind": "text"}
    strict = semantics.with_semantics(column_facts(df, "t"), strict_dates=True)
    assert {r.column_name: r.semantic_type for r in strict.collect()}["mktsegment"] == "text"


def test_discrete_periods(spark):
    df = spark.createDataFrame(
        [(i, 1950 + i % 100, i % 12, f"{2000 + i % 9}", f"w{i}") for i in range(300)],
        "n int, made int, month int, season string, week string",
    )
    found = {r.column_name: r for r in structure.discrete_periods(facts(df)).collect()}
    assert set(found) == {"made", "month", "season"}
    assert found["made"].confidence == "medium" and found["month"].confidence == "high"


def test_long_texts_are_digits_only_as_a_whole(spark):
    texts = ["7" * 128 + "abc", "8" * 128 + "abc", " " + "9" * 200 + " ", "12", "3" * 128, "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "week string")
    assert facts(df).first().digit_rows == 3


def test_null_heavy_columns_are_flagged(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (1, 4), (2, 5)], "a bigint, b bigint")
    found = {r.column_name: r for r in facts(df).collect()}
    assert found["a"].quality_flags == ["high_missingness"] and found["a"].metric_scope == "full"


def test_sparse_family_weighs_less(spark):
    filled = F.col("id") >= 6
    df = spark.range(10).select(
        F.col("id").alias("tenant_id"), F.when(filled, F.col("id") * 2.5).alias("gk_heat"),
        F.lit("west").alias("wing"), F.when(filled, F.col("id") % 3).alias("gk_light"),
    )
    m = facts(df)
    found = quality.high_nulls(m).collect()
    assert {(r.severity, r.score_impact) for r in found} == {("info", 4.0)}
    plain = quality.high_nulls(m, sparse_prefix="zz_").collect()
    assert {(r.severity, r.score_impact) for r in plain} == {("warning", 15.0)}


def test_quality_mix(spark):
    rows = [(None if i % 5 == 0 else i, f"n{i}", i % 3, i * 1.0, "x", 1) for i in range(50)]
    df = spark.createDataFrame(
        rows, "id_flag int, name_label string, cat_dim int, measure double, note string, const_x int"
    )
    found = profile(df, "mix")
    assert {r.issue for r in found.issues.collect()} >= {"duplicate_key", "constant"}
    flags = {r.column_name: r.quality_flags for r in found.columns.collect()}
    assert flags["id_flag"] == ["id_with_nulls"] and flags["const_x"] == ["constant_column"]
    score = found.summary.first().quality_score
    lost = found.issues.agg(F.sum("score_impact")).first()[0]
    assert score == round(max(0.0, 100 - lost), 2)
    ranks = [r.severity for r in found.issues.orderBy("rank").collect()]
    assert ranks == sorted(ranks, key=quality.SEVERITIES.index)


def test_rules_keep_datasets_apart(spark, panel):
    other = spark.createDataFrame([(1, "a"), (2, None)], "thing_id int, label string")
    both = facts(panel, "panel").unionByName(facts(other, "other"))
    pool = structure.key_candidate_pool(both, structure.temporal_columns(both))
    assert names(pool.where("dataset = 'other'")) == {"thing_id"}
    assert {r.dataset for r in quality.quality_score(
        both.select("dataset").distinct(), quality.quality_issues(both)).collect()} == {
        "panel", "other"}


def test_pool_lists_a_time_axis_once_and_keeps_room_for_all(spark):
    df = spark.range(40).select(
        (F.col("id") % 4 + 2000).alias("year_id"),
        *[F.col("id").alias(f"k{i}_id") for i in range(12)],
    )
    m = facts(df)
    pool = structure.key_candidate_pool(m, structure.temporal_columns(m)).orderBy("position")
    found = [r.column_name for r in pool.collect()]
    # Ties go to later columns; the axis takes the tenth place.
    assert found == [f"k{i}_id" for i in range(11, 2, -1)] + ["year_id"]


def test_column_browser_sorts_missing_numbers_lowest(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 3.5)], "a int, name string, score double")
    m = facts(df)
    shown = semantics.column_browser(m, sort_by="mean").collect()
    assert shown[0]["mean"] is None and shown[-1].column_name in {"score", "a"}
    assert names(semantics.column_browser(m, search="NAM")) == {"name"}
    assert names(semantics.column_browser(m, flags="critical_only")) == {"score"}


def test_warnings_and_narrative(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "amount double")
    found = profile(df, "plain")
    kinds = {r.warning.split(":")[0] for r in found.warnings.collect()}
    assert kinds == {"no_grain", "no_time_axis"}
    text = found.summary.first().narrative
    assert text.startswith("plain has 3 rows and 1 columns.") and "Main measures: amount." in text


def test_sample_is_deterministic_and_says_so(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 10)
    one = {r.id for r in sampled_rows(df, "id", 100).collect()}
    two = {r.id for r in sampled_rows(df.repartition(7), "id", 100).collect()}
    assert one == two and len(one) == 100
    found = sampled_profile(df, "t", "id", 100)
    assert found.summary.first().metric_scope == "sample"
    assert any(r.warning.startswith("sampled") for r in found.warnings.collect())
