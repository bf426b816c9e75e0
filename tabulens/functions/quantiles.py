"""Exact linear percentiles per group, whatever the size of the largest group.

Groups up to a size bound are settled by counting values and walking them in order, one task per
group. A larger group must not end up in one task: a sketch (``percentile_approx``) brackets each
wanted rank, exact counts prove the bracket, and it is narrowed until few enough rows are left inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.session import small_frame

DIRECT_LIMIT = 2_000_000
# At most this many groups can exceed the limit, so their brackets always fit a broadcast.
MAX_LARGE_GROUPS = 50_000
GRID = 1_000
CELLS = [cell / GRID for cell in range(GRID + 1)]
SKETCH_ACCURACY = 20_000
SAFETY_CELLS = 2


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    direct_limit: int = DIRECT_LIMIT,
    rows_at_most: int | None = None,
) -> DataFrame:
    """One row per group of ``keys`` with a column ``names[i]`` for each ``probs[i]``.

    ``rows_at_most`` is a known bound on the row count; below the limit it saves the size check.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    if rows_at_most is not None and rows_at_most <= direct_limit:
        return _direct(rows, keys, probs, names)
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    top = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    limit = max(direct_limit, (top.total or 0) // MAX_LARGE_GROUPS)
    if (top.largest or 0) <= limit:
        return _direct(rows, keys, probs, names)

    large = small_frame(sizes.where(F.col("_n") > limit))
    found = _bracketed(rows.where(F.col("_v").isNotNull()), keys, large, probs, names, limit)
    if not keys:
        return found
    rest = rows.alias("l").join(F.broadcast(large.alias("r")), _same_keys(keys), "left_anti")
    return _direct(rest, keys, probs, names).unionByName(found)


def _same_keys(keys: Sequence[str]) -> Column:
    """Null-safe equality of the grouping keys of sides ``l`` and ``r``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return condition


def _direct(
    rows: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Count values, walk each group's values in order, and read off the ranks.

    The counting combines within tasks, so ties cost nothing; the walk is a sort that can spill.
    """
    counts = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
    walk = W.partitionBy(*keys).orderBy("_v")
    placed = (
        counts.withColumn("_until", F.sum("_c").over(walk.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_c").over(
            walk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    picks = []
    for p, name in zip(probs, names, strict=True):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        rank = F.floor(position)
        last = F.ceil(position)
        picks += [
            F.max(_held(rank)).alias(f"{name}_a"), F.max(_held(last)).alias(f"{name}_b"),
            F.max(position - rank).alias(f"{name}_t"),
        ]
    blended = [_blend(f"{n}_a", f"{n}_b", f"{n}_t").alias(n) for n in names]
    return placed.groupBy(*keys).agg(*picks).select(*keys, *blended)


def _held(rank: Column) -> Column:
    """The value of a row of the walk if it covers the rank."""
    until = F.col("_until")
    return F.when((until - F.col("_c") <= rank) & (rank < until), F.col("_v"))


def _blend(a: str, b: str, t: str) -> Column:
    mixed = (1 - F.col(t)) * F.col(a) + F.col(t) * F.col(b)
    return F.when(F.col(t) == 0, F.col(a)).otherwise(mixed)


# --- large groups -------------------------------------------------------------------------------
# State: one row per large group. For the i-th probability: _rank{i} and _last{i}, the two ranks to
# find; _blend{i} between them; [_lo{i}, _hi{i}], the bracket known to hold both.

FIELDS = ["_rank", "_last", "_blend", "_lo", "_hi"]


def _bracketed(
    rows: DataFrame, keys: Sequence[str], large: DataFrame, probs: Sequence[float],
    names: Sequence[str], limit: int,
) -> DataFrame:
    picks = range(len(probs))
    plan, margin = _first_grid(rows, large, keys, probs), SAFETY_CELLS
    state = small_frame(_proposal(plan, keys, picks, margin))
    while True:
        passed = _pass(rows, state, keys, picks)
        seen = small_frame(_checked(passed, keys, picks))
        check = seen.agg(
            *[F.min(_proven(i)).alias(f"p{i}") for i in picks],
            *[F.max(f"_open{i}").alias(f"o{i}") for i in picks],
        ).first()
        if not all(check[f"p{i}"] for i in picks):
            # The sketch was off by more than its promise: widen the last proposal.
            margin *= 4
            state = small_frame(_proposal(plan, keys, picks, margin))
        elif max(check[f"o{i}"] for i in picks) <= limit:
            return _pick(rows, seen, keys, names)
        else:
            plan, margin = passed, SAFETY_CELLS
            state = seen.select(
                *keys,
                *[f"{f}{i}" for i in picks for f in ("_rank", "_last", "_blend")],
                *[F.col(f"_next{f}{i}").alias(f"{f}{i}") for i in picks for f in ("_lo", "_hi")],
            )


def _first_grid(
    rows: DataFrame, large: DataFrame, keys: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """The ranks to find in each large group, and one grid of quantiles over all its rows."""
    v = F.col("_v")
    whole = _with_state(rows, large, keys).groupBy(*keys).agg(
        F.count(v).alias("_n"), F.percentile_approx(v, CELLS, SKETCH_ACCURACY).alias("_g"),
        F.min(v).alias("_a"), F.max(v).alias("_b"),
    )
    columns = [F.col(k) for k in keys]
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        columns += [
            F.floor(position).cast("bigint").alias(f"_rank{i}"),
            F.ceil(position).cast("bigint").alias(f"_last{i}"),
            (position - F.floor(position)).alias(f"_blend{i}"),
            F.lit(0).cast("bigint").alias(f"_below{i}"),
            F.col("_n").alias(f"_held{i}"),
            F.col("_g").alias(f"_grid{i}"),
            F.col("_a").alias(f"_min{i}"),
            F.col("_b").alias(f"_max{i}"),
        ]
    return whole.select(*columns)


def _inside(i: int) -> Column:
    return (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))


def _with_state(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the brackets of its group; rows of other groups drop out."""
    own = [c for c in state.columns if c not in keys]
    joined = rows.alias("l").join(F.broadcast(state.alias("r")), _same_keys(keys))
    return joined.select("l.*", *[f"r.{c}" for c in own])


def _pass(rows: DataFrame, state: DataFrame, keys: Sequence[str], picks: range) -> DataFrame:
    """One scan: exact counts around every bracket, and a grid of quantiles inside it."""
    v = F.col("_v")
    measures = []
    for i in picks:
        inside = F.when(_inside(i), v)
        # Ties at either end do not count as open: one hot value must not keep a bracket open.
        between = (v > F.col(f"_lo{i}")) & (v < F.col(f"_hi{i}"))
        measures += [F.first(f"{f}{i}").alias(f"{f}{i}") for f in FIELDS]
        measures += [
            F.count_if(v < F.col(f"_lo{i}")).alias(f"_below{i}"),
            F.count(inside).alias(f"_held{i}"),
            F.count_if(between).alias(f"_open{i}"),
            F.percentile_approx(inside, CELLS, SKETCH_ACCURACY).alias(f"_grid{i}"),
            F.min(inside).alias(f"_min{i}"),
            F.max(inside).alias(f"_max{i}"),
        ]
    return _with_state(rows, state, keys).groupBy(*keys).agg(*measures)


def _proven(i: int) -> Column:
    below, held = F.col(f"_below{i}"), F.col(f"_held{i}")
    return (below <= F.col(f"_rank{i}")) & (F.col(f"_last{i}") < below + held)


def _bracket(i: int, margin: int) -> tuple[Column, Column]:
    """The grid cells around a rank, with a margin on both sides."""
    scale = F.greatest(F.col(f"_held{i}") - 1, F.lit(1))
    low = F.floor((F.col(f"_rank{i}") - F.col(f"_below{i}")) / scale * GRID).cast("int") - margin
    high = F.ceil((F.col(f"_last{i}") - F.col(f"_below{i}")) / scale * GRID).cast("int") + margin
    grid, first, last = f"_grid{i}", F.col(f"_min{i}"), F.col(f"_max{i}")
    return (
        F.when(low <= 0, first).otherwise(F.get(grid, low)),
        F.when(high >= GRID, last).otherwise(F.get(grid, high)),
    )


def _proposal(plan: DataFrame, keys: Sequence[str], picks: range, margin: int) -> DataFrame:
    """Narrower brackets. Grids stay in the executors; only the two ends of each come back."""
    columns = []
    for i in picks:
        low, high = _bracket(i, margin)
        columns += [F.col(f"{f}{i}") for f in ("_rank", "_last", "_blend")]
        columns += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    return plan.select(*keys, *columns)


def _checked(passed: DataFrame, keys: Sequence[str], picks: range) -> DataFrame:
    """The counts that prove or refute each bracket, and the next bracket, without the grids."""
    columns = []
    for i in picks:
        low, high = _bracket(i, SAFETY_CELLS)
        columns += [F.col(f"{f}{i}") for f in (*FIELDS, "_below", "_held", "_open")]
        columns += [low.alias(f"_next_lo{i}"), high.alias(f"_next_hi{i}")]
    return passed.select(*keys, *columns)


def _pick(rows: DataFrame, seen: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Read the ranks off the few values left inside the brackets."""
    picks = range(len(names))
    wanted = [
        F.when(_inside(i), F.struct(
            F.lit(i).alias("q"),
            *[F.col(f"{f}{i}").alias(f.strip("_")) for f in ("_below", "_rank", "_last", "_blend")],
        ))
        for i in picks
    ]
    needed = seen.select(
        *keys, *[f"{f}{i}" for i in picks for f in ("_lo", "_hi", "_below", "_rank", "_last", "_blend")]
    )
    hits = (
        _with_state(rows, needed, keys)
        .select(*keys, "_v", F.explode(F.array(*wanted)).alias("_w"))
        .where(F.col("_w").isNotNull())
        .select(*keys, "_v", "_w.*")
    )
    group = [*keys, "q"]
    carried = ["below", "rank", "last", "blend"]
    counts = hits.groupBy(*group, "_v").agg(
        F.count("*").alias("_c"), *[F.first(c).alias(c) for c in carried]
    )
    walk = W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("_until", F.col("below") + F.sum("_c").over(walk))
    settled = (
        placed.groupBy(*group)
        .agg(
            F.max(_held(F.col("rank"))).alias("a"),
            F.max(_held(F.col("last"))).alias("b"),
            F.first("blend").alias("t"),
        )
        .withColumn("value", _blend("a", "b", "t"))
    )
    return settled.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    )
