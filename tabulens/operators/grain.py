"""Row-key discovery: how many distinct tuples do sets of columns have?"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, islice
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.operators.columns import column_infos, union_all
from tabulens.session import small_frame

# How far the search goes and when a key counts as one.
MAX_PAIRS = 40
MAX_TRIPLES = 20
HIGH_RATIO, MEDIUM_RATIO = 0.999, 0.98
MAX_CANDIDATES = 15

Key = tuple[str, ...]


def distinct_tuples(df: DataFrame, keys: Sequence[Key]) -> dict[Key, int]:
    """Distinct tuples of each set of columns, nulls as values, all in one job.

    One narrow scan and group-by per set: it reads and ships only its own columns, in their own types.
    """
    if not keys:
        return {}
    infos = {c.name: c for c in column_infos(df)}
    counted = [
        df.selectExpr(*[f"{infos[n].groupable} as {infos[n].sql}" for n in key])
        .distinct()
        .agg(F.count("*").alias("distinct_count"))
        .select(F.lit(i).alias("key"), "distinct_count")
        for i, key in enumerate(keys)
    ]
    return {keys[r.key]: r.distinct_count for r in small_frame(union_all(counted)).collect()}


def _bounded_or_counted(
    df: DataFrame, keys: Sequence[Key], known: dict[Key, int], rows: int
) -> dict[Key, int]:
    """Counts of the keys that can matter. Two exact bounds save most scans:

    a set holding a unique subset is unique itself, and a set cannot have more tuples than the
    product of its parts, so a product below the medium threshold rules it out.
    """
    settled: dict[Key, int] = {}
    open_keys = []
    for key in keys:
        parts = [p for size in range(1, len(key)) for p in combinations(key, size) if p in known]
        if any(known[p] == rows for p in parts):
            settled[key] = rows
            continue
        ceilings = [
            known[p] * _product([known[(n,)] for n in key if n not in p])
            for p in parts
            if all((n,) in known for n in key if n not in p)
        ]
        if ceilings and min(ceilings) < MEDIUM_RATIO * rows:
            continue
        open_keys.append(key)
    return settled | distinct_tuples(df, open_keys)


def _product(numbers: Sequence[int]) -> int:
    result = 1
    for number in numbers:
        result *= number
    return result


def _confidence(ratio: Column) -> Column:
    return F.when(ratio >= HIGH_RATIO, "high").when(ratio >= MEDIUM_RATIO, "medium").otherwise("low")


def _ranked(
    df: DataFrame, dataset: str, counts: dict[Key, int], rows: int, keep: int | None
) -> DataFrame:
    """Candidates of at least medium confidence, best first; ties keep the order of the search."""
    table = df.sparkSession.createDataFrame(
        [(dataset, i, list(key), count) for i, (key, count) in enumerate(counts.items())],
        "dataset string, position int, columns array<string>, distinct_count bigint",
    )
    ratio = F.col("distinct_count") / F.lit(max(1, rows))
    order = W.partitionBy("dataset").orderBy(
        (F.col("confidence") == "high").desc(), F.desc("uniqueness_ratio"), F.size("columns"),
        "position",
    )
    return small_frame(
        table.withColumn("uniqueness_ratio", F.round(ratio, 6))
        .withColumn("confidence", _confidence(ratio))
        .where(F.col("confidence") != "low")
        .withColumn("rank", F.row_number().over(order))
        .where(F.lit(True) if keep is None else F.col("rank") <= keep)
        .select("dataset", "rank", "columns", "distinct_count", "uniqueness_ratio", "confidence")
    )


def grain_key_candidates(
    df: DataFrame,
    dataset: str,
    pool: Sequence[str],
    rows: int | None = None,
    singles: dict[str, int] | None = None,
    keep: int | None = MAX_CANDIDATES,
    max_pairs: int | None = MAX_PAIRS,
    max_triples: int | None = MAX_TRIPLES,
) -> DataFrame:
    """Keys among the pool's columns: singles, then pairs, then triples if none is sure.

    The first ``keep`` are shown; None shows all. ``max_pairs`` and ``max_triples`` bound the search
    (see ``search_is_cut``); None tries all. ``rows`` and ``singles`` (distinct counts of single columns) come from a profile when there is one.
    """
    rows = df.count() if rows is None else rows
    names = list(dict.fromkeys(pool))
    if not names or not rows:
        return _ranked(df, dataset, {}, rows, keep)
    counts: dict[Key, int] = {}
    if singles is not None and all(n in singles for n in names):
        counts.update({(n,): singles[n] for n in names})
    else:
        counts.update(distinct_tuples(df, [(n,) for n in names]))
    pairs = list(islice(combinations(names, 2), max_pairs))
    found = _bounded_or_counted(df, pairs, counts, rows)
    counts.update({p: found[p] for p in pairs if p in found})
    if max(counts.values()) < HIGH_RATIO * rows:
        triples = list(islice(combinations(names, 3), max_triples))
        found = _bounded_or_counted(df, triples, counts, rows)
        counts.update({t: found[t] for t in triples if t in found})
    return _ranked(df, dataset, counts, rows, keep)


def search_is_cut(
    pool: Sequence[str], max_pairs: int | None = MAX_PAIRS, max_triples: int | None = MAX_TRIPLES
) -> bool:
    """Whether a pool has more pairs or triples than the search may try."""
    n = len(dict.fromkeys(pool))
    return any(
        most is not None and comb(n, size) > most for size, most in ((2, max_pairs), (3, max_triples))
    )


def validate_grain(df: DataFrame, dataset: str, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Distinct share of given keys over the full table; unlikely keys are dropped, the rest ranked."""
    keys = [tuple(c) for c in candidates if c]
    rows = df.count()
    counted = distinct_tuples(df, keys) if rows else {}
    return _ranked(df, dataset, {k: counted[k] for k in keys if k in counted}, rows, len(keys))
