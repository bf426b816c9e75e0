"""The range join against comparing every pair."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabulens.operators import ranges
from tabulens.operators.ranges import range_join


def both(spark, points, intervals, kind="double"):
    return (
        spark.createDataFrame(points, f"k int, x {kind}"),
        spark.createDataFrame(intervals, f"j int, a {kind}, b {kind}"),
    )


def pairs(points, intervals, include_high=True):
    return sorted(
        (k, j) for k, x in points for j, a, b in intervals
        if None not in (x, a, b) and x == x and a <= x and (x <= b if include_high else x < b) and a <= b
    )


@pytest.mark.parametrize(("cell_rows", "hot"), [(1000, 16000), (1, 3), (2, 50)])
@pytest.mark.parametrize("include_high", [True, False])
def test_every_pair_once(spark, monkeypatch, cell_rows, hot, include_high):
    monkeypatch.setattr(ranges, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(ranges, "HOT_ROWS", hot)
    monkeypatch.setattr(ranges, "SLICES", 8)
    rng = random.Random(cell_rows)
    points = [(k, rng.choice([rng.gauss(0, 1), 0.5, float(rng.randrange(5)), rng.lognormvariate(0, 3)])) for k in range(600)]
    points += [(600 + k, 0.5) for k in range(200)] + [(900, None), (901, float("nan")), (902, 1e300), (903, -1e300)]
    intervals = []
    for j in range(150):
        a = rng.gauss(0, 2)
        intervals.append((j, a, a + rng.choice([0.0, 0.001, 0.5, 30.0, -1.0, 1e6])))
    intervals += [(200, -1e301, 1e301), (201, None, 1.0), (202, 0.0, None), (203, 0.5, 0.5), (204, float("nan"), 1.0)]
    left, right = both(spark, points, intervals)
    found = sorted((r.k, r.j) for r in range_join(left, right, "x", "a", "b", include_high=include_high).collect())
    assert found == pairs(points, [i for i in intervals if i[1] == i[1]], include_high)


def test_other_types_and_keys(spark):
    day = datetime.datetime(2024, 1, 1)
    points = [(k % 3, day + datetime.timedelta(hours=k)) for k in range(200)]
    intervals = [(j % 3, day + datetime.timedelta(hours=7 * j), day + datetime.timedelta(hours=7 * j + 9)) for j in range(20)]
    left = spark.createDataFrame(points, "g int, x timestamp_ntz")
    right = spark.createDataFrame(intervals, "g int, a timestamp_ntz, b timestamp_ntz")
    found = sorted((r.g, r.x, r.a) for r in range_join(left, right, "x", "a", "b", on=["g"]).collect())
    assert found == sorted((g, x, a) for g, x in points for h, a, b in intervals if g == h and a <= x <= b)
    big = 2**60
    left, right = both(spark, [(k, big + k) for k in range(50)], [(0, big + 10, big + 12)], "long")
    assert sorted(r.k for r in range_join(left, right, "x", "a", "b").collect()) == [10, 11, 12]


def test_empty_sides_and_names(spark):
    left, right = both(spark, [(1, 1.0)], [(1, 0.0, 2.0)])
    for one, two in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        assert range_join(one, two, "x", "a", "b").collect() == []
    with pytest.raises(ValueError):
        range_join(left, right.withColumnRenamed("j", "k"), "x", "a", "b")
    with pytest.raises(TypeError):
        range_join(left.selectExpr("k", "'t' as x"), right, "x", "a", "b")


def test_plan_has_no_nested_loop(spark):
    left, right = both(spark, [(k, float(k)) for k in range(1000)], [(j, float(j), j + 3.0) for j in range(1000)])
    plan = range_join(left, right, "x", "a", "b")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("cell_rows", "hot"), [(1000, 16000), (1, 3), (2, 50)])
@pytest.mark.parametrize("include_high", [True, False])
def test_totals_without_pairs(spark, monkeypatch, cell_rows, hot, include_high):
    monkeypatch.setattr(ranges, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(ranges, "HOT_ROWS", hot)
    monkeypatch.setattr(ranges, "HOT_PARTS", 10**9)
    monkeypatch.setattr(ranges, "SLICES", 8)
    rng = random.Random(cell_rows)
    values = [rng.choice([rng.gauss(0, 1), 0.5, float(rng.randrange(5)), rng.lognormvariate(0, 3)]) for _ in range(500)]
    points = [(rng.choice([None, 1, 2, 3, 4, *range(100)]), x) for x in [*values, *[0.5] * 100, None, float("nan"), 1e300, -1e300]]
    intervals = []
    for j in range(120):
        a = rng.gauss(0, 2)
        intervals.append((j, a, a + rng.choice([0.0, 0.001, 0.5, 30.0, -1.0, 1e6])))
    intervals += [(200, -1e301, 1e301), (201, None, 1.0), (202, 0.0, None), (203, 0.5, 0.5), (203, 0.5, 0.5), (204, 5e301, 6e301)]
    left, right = both(spark, points, intervals)
    totals = {"n": F.lit(1), "total": F.col("x"), "k_sum": F.col("k")}
    found = range_join(left, right, "x", "a", "b", include_high=include_high, totals=totals, distinct=("users", "k"))
    expected = []
    for j, a, b in intervals:
        inside = [(k, x) for k, x in points if pairs([(0, x)], [(0, a, b)], include_high)]
        if inside:
            users = {k for k, _ in inside if k is not None}
            expected.append((j, a, b, len(inside), sum(x for _, x in inside), sum(k or 0 for k, _ in inside), len(users)))
    found = sorted(tuple(r) for r in found.collect())
    expected.sort()
    assert [(*r[:4], *r[5:]) for r in found] == [(*r[:4], *r[5:]) for r in expected]
    # The sum over 1e300, -1e300 and all between depends on its order, in any engine.
    assert [r[4] for r in found if r[0] != 200] == pytest.approx([r[4] for r in expected if r[0] != 200])


def test_totals_of_times_and_kinds(spark):
    day = datetime.datetime(2024, 1, 1)
    left = spark.createDataFrame([(k % 7, day + datetime.timedelta(seconds=k // 2)) for k in range(500)], "g int, x timestamp")
    right = left.selectExpr("g AS j", "x AS a", "x + INTERVAL 9 SECONDS AS b")
    totals = {"n": F.lit(1)}
    found = range_join(left, right, "x", "a", "b", include_high=False, totals=totals, distinct=("groups", "g"))
    slow = range_join(left, right.distinct(), "x", "a", "b", include_high=False).groupBy("j", "a")
    slow = slow.agg(F.count("*").alias("n"), F.count_distinct("g").alias("groups"))
    assert sorted(map(tuple, found.drop("b").collect())) == sorted(map(tuple, slow.collect()))
    assert range_join(left.limit(0), right, "x", "a", "b", totals=totals).collect() == []
    with pytest.raises(TypeError):
        range_join(left.selectExpr("1.5 AS x"), right, "x", "a", "b", totals=totals)


def test_pairs_of_the_registered_totals_are_not_made(spark):
    """Rows leaving the join grow with intervals, not with pairs: 4,000,000 of them here."""
    left = spark.range(2000).selectExpr("id AS k", "double(id) AS x")
    right = spark.range(2000).selectExpr("id AS j", "double(-id) AS a", "double(2000 + id) AS b")
    found = range_join(left, right, "x", "a", "b", totals={"n": F.lit(1)})
    assert found.count() == 2000 and found.agg(F.sum("n")).first()[0] == 4_000_000
