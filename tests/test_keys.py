"""Minimal keys against counting every set of columns."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from tabulens.operators.keys import minimal_keys


def every_key(rows, names):
    keys = []
    for size in range(1, len(names) + 1):
        for s in combinations(range(len(names)), size):
            if not any(set(k) <= set(s) for k in keys):
                if rows and len({tuple(r[c] for c in s) for r in rows}) == len(rows):
                    keys.append(s)
    return [[names[c] for c in s] for s in keys]


def found(df, **more):
    return [r.columns for r in minimal_keys(df, "t", **more).orderBy("rank").collect()]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("most", [2_000_000, 40])
def test_random_tables(spark, seed, most):
    rng = random.Random(seed)
    names = [f"c {k}" for k in range(rng.choice([3, 5, 6]))]
    kinds = [rng.choice([2, 3, 8, 200]) for _ in names]
    rows = [tuple(rng.choice([None, rng.randrange(k)]) if rng.random() < 0.1 else rng.randrange(k) for k in kinds)
            for _ in range(rng.choice([1, 2, 30, 120]))]
    if seed % 2 == 0:
        rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
    assert found(df, most=most) == every_key(rows, names)


def test_agreements_save_counts(spark):
    rows = [(k, k % 10, k // 10, k % 7, "x") for k in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string")
    counted = []
    assert found(df, counted=counted) == every_key(rows, list("abcde"))
    # The whole table once, and then only what turned out to be keys.
    assert sorted(map(len, counted)) == sorted([5, *map(len, every_key(rows, list("abcde")))])


def test_tables_without_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "a int, b string")
    assert found(df) == [] and found(df.limit(0)) == []
    assert found(df.dropDuplicates()) == [["a"], ["b"]]


def test_one_pool_of_many_columns(spark):
    df = spark.range(50).selectExpr("id", "id % 5 as five", "id div 5 as ten", "array(id) as list")
    assert found(df, pool=["five", "ten", "list"]) == [["list"], ["five", "ten"]]
    assert found(df, pool=["five"]) == []
