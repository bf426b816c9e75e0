import numpy as np
import pytest
from compare import difference, duck
from frames import SF
from pyspark.sql import functions as F

import tabulens.llm.negatives as negatives
from tabulens.llm.negatives import Tree, build, hard_negatives
from tabulens.llm.queries import ORACLE, op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def every_negative(rows, positives=5, most=10, low=30, high=90):
    """All pairs compared; rows are told apart by their place."""
    kept = [
        (key, np.floor(256 * np.array(x, float)).astype(int), label)
        for key, x, label in rows
        if key is not None and label is not None and x is not None
        and not any(c is None or not np.isfinite(c) for c in x)
    ]
    found = []

    def score(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    for n, (key, x, label) in enumerate(kept):
        if key % 100:
            continue
        told = [(-score(x, y), k, m) for m, (k, y, other) in enumerate(kept) if m != n and other == label]
        others = sorted((-score(x, y), k) for k, y, other in kept if other != label)
        for s, k, _ in sorted(told)[:positives]:
            fits = [(t, o) for t, o in others if -low * s <= -100 * t <= -high * s][:most]
            found += [(key, k, r + 1, o, -s, -t) for r, (t, o) in enumerate(fits)]
    return sorted(found)


def clusters(n, seed, spread=0.05, width=12, repeat=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, width)) / 3
    rows = []
    for k in range(n):
        x = (centers[rng.integers(9)] + spread * rng.normal(size=width)).astype(np.float32)
        rows += [(k, [float(c) for c in x], int(rng.integers(4)))] * (repeat if k % 10 == 0 else 1)
    return rows


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS id", "'x' AS leaf", "2 AS score", "3 AS v")
    found = hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    return sorted(tuple(r) for r in found)


def test_query_against_sql(spark):
    assert difference(op13_hard_negatives(spark, SF), duck(SF), ORACLE["op13_hard_negatives"]) is None


@pytest.mark.parametrize(("leaf", "block", "sample"), [(2048, 8192, 4096), (20, 7, 200), (5, 3, 60)])
def test_any_tree_finds_the_same(spark, monkeypatch, leaf, block, sample):
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    rows = clusters(800, leaf)
    assert mined(spark, rows) == every_negative(rows)


def test_ties_and_copies(spark):
    rows = [(k, [float(k % 3 - 1), 0.5, 0.25], k % 2) for k in range(300)]
    rows += [(100, [0.0, 0.5, 0.25], 0)] * 3 + [(7, [0.0, 0.5, 0.25], 0)] * 20
    assert mined(spark, rows) == every_negative(rows)


@pytest.mark.parametrize(("group", "segment", "scores"), [(64, 1 << 19, 1 << 20), (3, 100, 50), (2, 30, 1)])
def test_any_cells_find_the_same(spark, monkeypatch, group, segment, scores):
    """Groups of anchors and segments of rows of any size, rows of one file and of many."""
    for name, n in (("GROUP_ANCHORS", group), ("LEAST_ANCHORS", 1), ("SEGMENT_ROWS", segment), ("SCORES", scores)):
        monkeypatch.setattr(negatives, name, n)
    monkeypatch.setattr(negatives, "FILE_ROWS", segment // 2)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 20)
    rows = clusters(800, group)
    rows += [(k, [0.25] * 12, k % 3) for k in (*range(800, 1100), *[900] * 30)]
    assert mined(spark, rows) == every_negative(rows)


def test_no_pairs_are_shuffled(spark, monkeypatch):
    """Blocks and anchors gave ``positives`` or ``negatives`` rows for each block that was met, and each
    block was sent to Python with each group of anchors; now an anchor's best are kept while blocks are read."""
    found, whole = [], negatives.map_rows

    def watched(df, function, schema, *more):
        made = whole(df, function, schema, *more)
        found.extend([made] if schema.startswith("anchor long, request") else [])
        return made

    monkeypatch.setattr(negatives, "map_rows", watched)
    monkeypatch.setattr(negatives, "LEAF_ROWS", 20)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    rows = clusters(800, 4)
    assert mined(spark, rows) == every_negative(rows)
    positives, answers = (made.count() for made in found)
    assert positives <= 8 * 5 and answers <= 8 * 5 * 10


def test_large_components(spark):
    """Scores beyond what floats of 24 and of 53 bits hold, told apart by their last digit."""
    for size in (2.0**10, 2.0**19):
        rows = [(k, [size + k / 256, size, float(k % 5)], k % 2) for k in range(0, 300)]
        assert mined(spark, rows) == every_negative(rows)


def test_rows_that_take_no_part(spark):
    rows = clusters(300, 5)
    rows += [(400, None, 1), (500, rows[0][1], None), (600, [float("nan")] * 12, 1), (None, rows[0][1], 1)]
    rows += [(700, [None, *rows[0][1][1:]], 1), (800, [float("inf")] * 12, 0), (900, [0.5, 0.5], 2), (1000, [], 1)]
    assert mined(spark, rows) == every_negative(rows)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(400, None, 1)]) == []


def test_annuli_leave_out_siblings(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 20)
    x = np.array([np.floor(256 * np.array(r[1])) for r in clusters(2000, 3, spread=0.01)])
    tree: Tree = build(x, float((x * x).sum(axis=1).max()), len(x))
    leaves = tree.leaf_of(x)
    for leaf in range(len(tree.paths)):
        if (leaves == leaf).any():
            for node, i, j, low, high in tree.ranges(leaf, x[leaves == leaf]):
                tree.nodes[node].near[i, j] = min(tree.nodes[node].near[i, j], low)
                tree.nodes[node].far[i, j] = max(tree.nodes[node].far[i, j], high)
    told = x @ x[0]
    lo, hi = np.quantile(told, 0.95), told.max()
    reached = tree.reached(x[:1], np.array([lo]), np.array([hi]))
    assert set(leaves[told >= lo]) <= set(np.flatnonzero(reached))
    assert reached.sum() < len(tree.paths) / 3
