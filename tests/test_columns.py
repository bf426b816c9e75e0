"""Column metrics, histograms, percentiles and duplicates on hand-made frames."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulens.functions.bins import FloatEdges, IntBins
from tabulens.functions.quantiles import exact_percentiles
from tabulens.operators import columns as cols
from tabulens.operators.duplicates import duplicate_row_pct
from tabulens.operators.histograms import profile_histograms
from tabulens.operators.semantics import with_semantics


def rows_of(df, key="column_name"):
    return {r[key]: r for r in df.collect()}


def linear(values, q):
    ordered = sorted(values)
    at = q * (len(ordered) - 1)
    low = math.floor(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - (at - low)) + ordered[high] * (at - low)


@given(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(1, 100))
def test_int_bins_cover_the_domain_without_gaps(a, b, wanted):
    shape = IntBins.over(min(a, b), max(a, b), wanted)
    assert shape.lower(0) == min(a, b) and shape.upper(shape.bins - 1) == max(a, b)
    widths = [shape.upper(i) - shape.lower(i) + 1 for i in range(shape.bins)]
    assert min(widths) >= 1 and max(widths) - min(widths) <= 1
    assert widths == sorted(widths, reverse=True)
    assert all(shape.upper(i) + 1 == shape.lower(i + 1) for i in range(shape.bins - 1))


@pytest.mark.parametrize(
    ("low", "high", "wanted"),
    [(0, 10, 12), (1, 50, 12), (-7, 1000, 100), (-(2**63), 2**63 - 1, 12), (3, 14, 5)],
)
def test_int_bin_expression_finds_the_bin(spark, low, high, wanted):
    shape = IntBins.over(low, high, wanted)
    edges = {e for i in range(shape.bins) for e in (shape.lower(i), shape.upper(i))}
    df = spark.createDataFrame([(v,) for v in sorted(edges)], "v bigint")
    for v, b in df.selectExpr("v", shape.index_sql("v")).collect():
        assert shape.lower(b) <= v <= shape.upper(b)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=3, max_size=40, unique=True))
def test_float_bins_agree_with_brute_force(spark, values):
    shape = FloatEdges(min(values), max(values), 12)
    if shape.width <= 0:
        return
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, b in df.selectExpr("v", shape.right_closed_sql("v")).collect():
        assert b == sum(v > shape.edge(i) for i in range(1, 12))


def test_profile_histograms_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [(1, 0.0, 5, None, 1.0), (2, 1.0, 5, None, inf), (3, 2.0, 5, 7, nan), (9, 12.0, 5, None, 3.0)],
        "a int, f double, constant int, single int, odd double",
    )
    found = profile_histograms(df).collect()
    by = {}
    for r in found:
        by.setdefault(r.column_name, []).append(r)
    assert set(by) == {"a", "f", "odd"}
    ints = sorted(by["a"], key=lambda r: r.bin_index)
    assert len(ints) == 9 and [r.bin_count for r in ints] == [1, 1, 1, 0, 0, 0, 0, 0, 1]
    floats = sorted(by["f"], key=lambda r: r.bin_index)
    # Right-closed: 1.0 and 2.0 are inner edges and stay in the lower bin.
    assert [r.bin_count for r in floats] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert floats[0].lower_bound is None and floats[-1].upper_bound is None
    assert not floats[0].left_closed and floats[0].right_closed and not floats[-1].right_closed
    assert sum(r.bin_count for r in by["odd"]) == 2  # only the finite values
    assert abs(sum(r.pct_non_null for r in floats) - 100) < 1e-9


def test_large_groups_take_the_bracket_path_and_agree(spark):
    rng = random.Random(7)
    rows = [("hot", rng.gauss(0, 1e3)) for _ in range(6000)]
    rows += [("hot", 5.0)] * 3000  # one value holds a third of the hot group
    rows += [("ties", float(rng.randrange(4))) for _ in range(3000)]
    rows += [(None, float(i)) for i in range(2500)]
    rows += [("small", 1.0), ("small", 2.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs, names = [0.25, 0.5, 0.75], ["a", "b", "c"]
    found = rows_of(exact_percentiles(df, ["g"], "v", probs, names, direct_limit=300), "g")
    assert set(found) == {"hot", "ties", "small", "empty", None}
    for group in ("hot", "ties", "small", None):
        values = [v for g, v in rows if g == group]
        for p, n in zip(probs, names):
            assert math.isclose(found[group][n], linear(values, p), rel_tol=1e-12, abs_tol=1e-9)
    assert found["empty"].a is None


@pytest.mark.parametrize("limit", [500, 3])
def test_global_percentiles_by_brackets(spark, limit):
    """A limit of 3 rows takes several rounds of narrowing."""
    df = spark.range(20_001).select((F.col("id") * 0.5).alias("v"))
    found = exact_percentiles(df, [], "v", [0.25, 0.5, 0.99], ["a", "b", "c"], direct_limit=limit)
    assert [tuple(r) for r in found.collect()] == [(2500.0, 5000.0, 9900.0)]


def test_describe_of_one_row_and_of_non_finite_values(spark):
    df = spark.createDataFrame([(4.0, float("inf"))], "one double, wild double")
    found = rows_of(cols.numeric_describe(df))
    assert found["one"]["mean"] == 4.0 and found["one"]["std"] is None
    assert found["wild"]["mean"] is None and found["wild"]["median"] is None


def test_describe_matches_the_textbook(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = cols.numeric_describe(df).first()
    assert math.isclose(r.std, statistics.stdev(values))
    assert (r.p25, r.median, r.p75) == (1.75, 3.5, 5.25)


def test_null_counts_as_a_value(spark):
    df = spark.range(700).select(
        F.when(F.col("id") == 699, None).when(F.col("id") == 350, "thaw").otherwise("frost").alias("phase")
    )
    assert cols.unique_count(df).first().unique_count == 3
    facts = with_semantics(cols.column_metrics(df, "t")).first()
    assert "constant_column" not in facts.quality_flags


def test_late_majority(spark):
    df = spark.range(900).select(F.when(F.col("id") < 240, "low").otherwise("high").alias("tide"))
    r = cols.top_value(df).first()
    assert (r.top_value, r.top_count, r.top_pct) == ("high", 660, 73.3333)


def test_late_dates_set_the_range(spark):
    df = spark.range(640).select(
        "id", F.when(F.col("id") > 636, F.date_add(F.lit("2015-03-31"), F.col("id").cast("int") - 637)).alias("harvested")
    )
    r = rows_of(cols.min_max(df))["harvested"]
    assert (r.min_value, r.max_value) == ("2015-03-31", "2015-04-02")


def test_top_values_break_ties_by_text_with_null_last(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("c",)], "v string")
    assert [r.value for r in cols.top_values(df).orderBy("rank").collect()] == ["c", "a", "b", None]


@pytest.mark.parametrize("tied", [False, True])
def test_long_texts_rank_by_their_whole_text(spark, tied):
    base = "p" * 200
    texts = [f"{i % 3}{'x' * 150}{i}" for i in range(30)] + ["short"] * 3 + ["3" + base + "b"] * 2
    if tied:
        texts = [f"{base}{chr(97 + i)}" for i in range(26)] + ["z" * 300] * 2
    df = spark.createDataFrame([(t,) for t in texts + texts[:1] * 4 + [None]], "t string")
    expected = {}
    for t in texts + texts[:1] * 4 + [None]:
        expected[t] = expected.get(t, 0) + 1
    order = sorted(expected.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:8]
    found = [(r.value, r.value_count) for r in cols.top_values(df).orderBy("rank").collect()]
    assert found == order
    assert cols.unique_count(df).first().unique_count == len(expected)
    assert cols.top_value(df).first().top_value == order[0][0]
    facts = cols.column_metrics(df, "t").first()
    assert [(r["value"], r["n"]) for r in facts.top_values] == order


def test_top_null_prints_as_text(spark):
    df = spark.createDataFrame([(None,), (None,), ("x",)], "v string")
    assert cols.top_value(df).first().top_value == "(null)"


def test_late_duplicates(spark):
    df = spark.range(800).select(F.least("id", F.lit(797)).alias("crate"), F.lit("oak").alias("wood"))
    r = duplicate_row_pct(df).first()
    assert (r.row_count, r.duplicate_rows, r.duplicate_row_pct) == (800, 3, 0.375)


def test_duplicates_treat_nulls_zeros_and_maps_as_values(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (CAST(NULL AS INT), 0.0D, map('a', 1, 'b', 2)),
        (NULL, -0.0D, map('b', 2, 'a', 1)), (1, 0.0D, map('a', 1)) AS t(k, z, m)"""
    )
    assert duplicate_row_pct(df).first().duplicate_rows == 2


def test_maps_at_any_depth(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (array(map('a', 1, 'b', 2)), named_struct('m', map('x', array(map('p', 0.0D))), 'n', 1)),
        (array(map('b', 2, 'a', 1)), named_struct('m', map('x', array(map('p', -0.0D))), 'n', 1)),
        (array(map('b', 2)), CAST(NULL AS struct<m: map<string, array<map<string, double>>>, n: int>)),
        (CAST(NULL AS array<map<string, int>>), named_struct('m', NULL, 'n', 2)) AS t(`a b`, s)"""
    )
    assert duplicate_row_pct(df).first().duplicate_rows == 2
    assert rows_of(cols.unique_count(df))["a b"].unique_count == 3


def test_many_duplicates_take_the_direct_path_and_agree(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("a"), F.lit("x").alias("b"))
    hot = df.unionByName(spark.range(1500).select(F.lit(-1).alias("a"), F.lit("y").alias("b")))
    both = [duplicate_row_pct(hot, max_hashes=m).first() for m in (10, 10_000)]
    assert both[0] == both[1] and both[0].duplicate_rows == 4500


def test_duplicates_of_an_empty_table(spark):
    r = duplicate_row_pct(spark.createDataFrame([], "a int")).first()
    assert (r.row_count, r.duplicate_rows, r.duplicate_row_pct) == (0, 0, None)


def test_odd_names_and_nested_types_profile(spark):
    df = spark.sql(
        """SELECT array(1, 2) AS weird, map('k', 1) AS `my map`, named_struct('x', 1) AS `a.b`,
        CAST(1.5 AS DECIMAL(10, 2)) AS `it's`, X'00FF' AS bin, CAST(3 AS TINYINT) AS tiny,
        true AS flag, DATE'2024-01-01' AS `back``tick`"""
    )
    found = rows_of(with_semantics(cols.column_metrics(df, "t")))
    assert {n: r.semantic_type for n, r in found.items()} == {
        "weird": "unknown", "my map": "unknown", "a.b": "unknown", "it's": "numeric",
        "bin": "unknown", "tiny": "id_like", "flag": "boolean_like", "back`tick": "datetime",
    }
    assert found["it's"]["mean"] == 1.5 and found["back`tick"]["unique_count"] == 1


def test_wide_tables_are_cut_into_several_aggregates(spark):
    names = [f"c{i}" for i in range(400)]
    df = spark.range(10).select(*[(F.col("id") % (i + 1)).alias(n) for i, n in enumerate(names)])
    found = cols.null_counts(df).collect()
    assert len(found) == 400 and all(r.row_count == 10 for r in found)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    found = rows_of(with_semantics(cols.column_metrics(df, "t")))
    assert found["a"].row_count == 0 and found["a"].null_pct == 0.0
    assert found["b"].unique_count == 0 and found["b"].quality_flags == []


def test_approximate_unique_count(spark):
    df = spark.range(10_000).withColumn("n", F.lit(None).cast("int"))
    found = rows_of(cols.unique_count(df, approximate=True))
    assert abs(found["id"].unique_count - 10_000) < 500 and found["n"].unique_count == 1
