"""The range join of two tables: points of one against intervals of the other."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.session import scratch_dir, small_frame

# Points lie in slices of about equal number, each cut into cells of about CELL_ROWS points.
SLICES, CELL_ROWS, MOST_CELLS = 256, 1000, 1 << 40
# An interval is kept at the first level of cells at which it spans no more than so many.
SPAN = 4
LEVELS = 42
# A cell of more points, and more than an HOT_PARTS-th of all, is split over copies of its intervals.
HOT_ROWS, HOT_PARTS = 16 * CELL_ROWS, 4096


def as_number(value: Column, kind: T.DataType) -> Column:
    """A number that orders like the value; dates and times become microseconds."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    raise TypeError(f"no range of {kind.simpleString()}")


def grid(points: DataFrame, number: str, rows: int) -> tuple[list[float], int]:
    """Bounds of the slices, from a bounded sketch of all points, and the cells in each slice."""
    marks = [i / SLICES for i in range(SLICES + 1)]
    found = points.agg(F.percentile_approx(number, marks, 20 * SLICES).alias("b")).first().b
    cells = max(1, min(MOST_CELLS, rows // (SLICES * CELL_ROWS)))
    return sorted({b for b in found or [] if math.isfinite(b)}), cells


def cell_of(number: Column, bounds: list[float], cells: int) -> Column:
    """The cell of a number. It never falls as the number rises, so an interval is a range of cells."""
    if len(bounds) < 2:
        return F.lit(0).cast("long")
    held = F.array(*map(F.lit, bounds))
    # A binary search for the slice: steps of halved width, taken where the bound there is not beyond.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        return at + F.when((at + width <= len(bounds) - 2) & (F.get(held, at + width) <= number), width).otherwise(0)

    def cell(at: Column) -> Column:
        low, high = F.get(held, at), F.get(held, at + 1)
        inside = F.floor((number - low) / (high - low) * cells)
        return 1 + at.cast("long") * cells + F.least(F.lit(cells - 1), F.greatest(F.lit(0), inside))

    beyond = 1 + (len(bounds) - 1) * cells
    return (
        F.when(number < bounds[0], F.lit(0).cast("long"))
        .when(number > bounds[-1], F.lit(beyond).cast("long"))
        .otherwise(F.aggregate(steps, F.lit(0), step, cell))
    )


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    low: str,
    high: str,
    on: Sequence[str] = (),
    include_high: bool = True,
    totals: Mapping[str, Column] | None = None,
    distinct: tuple[str, str] | None = None,
) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` that holds its ``point``, and equal ``on``.

    An interval goes from ``low`` to ``high``, both in it unless ``include_high`` is false. Numbers, dates and times of
    any type may meet. Nulls and NaN lie in no interval, and an interval that ends before it begins holds
    nothing. The result has the columns of ``points``, then those of ``intervals`` besides ``on``;
    other columns must have different names.

    Points fall into cells that follow their distribution. An interval is laid down at the level of
    cells, each twice as wide as the level before, at which it spans at most ``SPAN`` + 1 of them, so a long
    one makes no more rows than a short one and a pair can meet in one cell only. The join is then an equality
    join. A cell of very many points is split, with its intervals copied to each part.

    With ``totals`` or ``distinct`` the pairs are not made: see ``interval_totals``.
    """
    if totals is not None or distinct is not None:
        if on:
            raise ValueError("totals over equal columns are not made")
        return interval_totals(points, intervals, point, low, high, include_high, totals or {}, distinct)
    clash = (set(points.columns) & set(intervals.columns)) - set(on)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    kinds = points.schema[point].dataType, intervals.schema[low].dataType, intervals.schema[high].dataType
    x, a, b = (as_number(F.col(f"`{n}`"), k) for n, k in zip((point, low, high), kinds, strict=True))
    left = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"), x.alias("_x"))
    left = left.where("_x is not null and not isnan(_x)")
    right = intervals.select(
        F.struct(*[F.col(f"`{c}`") for c in intervals.columns]).alias("_i"), a.alias("_a"), b.alias("_b")
    ).where("_a <= _b and not isnan(_a) and not isnan(_b)")
    rows = points.count()
    bounds, cells = grid(left, "_x", rows)
    left = left.withColumn("_cell", cell_of(F.col("_x"), bounds, cells))
    right = right.withColumn("_from", cell_of(F.col("_a"), bounds, cells)).withColumn(
        "_to", cell_of(F.col("_b"), bounds, cells)
    )
    fits = [F.when(F.expr(f"shiftright(_to, {k}) - shiftright(_from, {k}) <= {SPAN}"), k) for k in range(LEVELS)]
    right = right.withColumn("_level", F.coalesce(*fits, F.lit(LEVELS)))
    # At most LEVELS + 1 rows.
    levels = sorted(r[0] for r in right.select("_level").distinct().collect())
    right = right.withColumn("_at", F.explode(F.expr("sequence(shiftright(_from, _level), shiftright(_to, _level))")))
    at_levels = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    left = left.withColumn("_level", F.explode(at_levels)).withColumn("_at", F.expr("shiftright(_cell, _level)"))
    # At most HOT_PARTS cells of each level are over the bound.
    most = max(HOT_ROWS, rows // HOT_PARTS)
    hot = left.groupBy("_level", "_at").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = small_frame(hot.select("_level", "_at", F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    cell = ["_level", "_at"]
    left = left.join(F.broadcast(hot), cell, "left").withColumn(
        "_part", F.pmod(F.xxhash64("_p"), parts).cast("int")
    )
    right = right.join(F.broadcast(hot), cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    equal = [F.col(f"_p.`{c}`") == F.col(f"_i.`{c}`") for c in on]
    value, begin, end = F.col(f"_p.`{point}`"), F.col(f"_i.`{low}`"), F.col(f"_i.`{high}`")
    # Exact types decide; numbers only bring the rows together.
    holds = (value >= begin) & ((value <= end) if include_high else (value < end))
    joined = left.drop("_parts").join(right.drop("_parts"), [*cell, "_part"])
    for condition in [holds, *equal]:
        joined = joined.where(condition)
    added = [c for c in intervals.columns if c not in on]
    return joined.select(
        *[F.col(f"_p.`{c}`").alias(c) for c in points.columns], *[F.col(f"_i.`{c}`").alias(c) for c in added]
    )


def exact(value: Column, kind: T.DataType) -> tuple[Column, str]:
    """The value as a long or a double, as it is; dates and times are microseconds."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")), "long"
    if isinstance(kind, T.IntegralType):
        return value.cast("long"), "long"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("double"), "double"
    raise TypeError(f"no exact range of {kind.simpleString()}")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def earlier(marks: DataFrame, slice_of: Column) -> DataFrame:
    """``marks(key, x)``, each once, with the greatest smaller ``x`` of its key as ``before``.

    Rows of a key are ordered within slices; of the slices before, only the greatest ``x`` is needed.
    """
    marks = marks.withColumn("slice", slice_of)
    tops = marks.groupBy("key", "slice").agg(F.max("x").alias("top"))
    tops = tops.select("key", "slice", F.lag("top").over(Window.partitionBy("key").orderBy("slice")).alias("top"))
    within = F.lag("x").over(Window.partitionBy("key", "slice").orderBy("x"))
    # Slices of a key without rows before have a null top.
    return marks.join(tops, ["key", "slice"]).select("x", F.coalesce(within, "top").alias("before"))


def counting(names: list[str], include_high: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the points in each interval, for sorted groups of rows of points, marks and intervals."""

    def smaller(befores: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many of ``befores[first:last]`` are below each bound, by blocks of doubling size, sorted."""
        held = np.sort(befores)
        rank, limit = np.searchsorted(held, befores), np.searchsorted(held, bounds)
        n, found = len(befores), np.zeros(len(bounds), np.int64)
        order, low, high, size = rank.astype(np.int64), first.copy(), last.copy(), 1
        place = np.arange(n)
        while (low < high).any():
            block = place // size
            order = np.sort(order + block * (n + 1)) - block * (n + 1) if size > 1 else order
            keys = order + block * (n + 1)
            for chosen, at in (((low & 1) == 1, low), ((high & 1) == 1, high - 1)):
                q = np.flatnonzero(chosen & (low < high))
                found[q] += np.searchsorted(keys, at[q] * (n + 1) + limit[q]) - np.minimum(at[q] * size, n)
            low, high, size = (low + 1) >> 1, high >> 1, size * 2
        return found

    def summed(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of ``values[first:last]``, by sums of blocks of doubling size: no sum holds a value outside."""
        low, high, found = first.copy(), last.copy(), np.zeros(len(first), values.dtype)
        while (low < high).any():
            for chosen, at in (((low & 1) == 1, low), ((high & 1) == 1, high - 1)):
                q = np.flatnonzero(chosen & (low < high))
                found[q] += values[at[q]]
            low, high = (low + 1) >> 1, high >> 1
            values = np.concatenate([values, values[:0] if len(values) % 2 == 0 else np.zeros(1, values.dtype)])
            values = values[::2] + values[1::2]
        return found

    def told(group: pa.Table) -> pa.RecordBatch:
        kind, x = group.column("kind").to_numpy(), group.column("x").to_numpy()
        asked, points, marks = (np.flatnonzero(kind == k) for k in (2, 0, 1))
        a, b = x[asked], group.column("y").take(pa.array(asked)).to_numpy()

        def span(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = np.searchsorted(values, a)
            return begin, np.maximum(begin, np.searchsorted(values, b, "right" if include_high else "left"))

        points = points[np.argsort(x[points], kind="stable")]
        begin, end = span(x[points])
        out = [pa.array(a), pa.array(b)]
        for name in names:
            values = group.column(name).take(pa.array(points)).to_numpy()
            out.append(pa.array(summed(values, begin, end)))
        firsts = np.zeros(len(asked), np.int64)
        if len(marks):
            marks = marks[np.argsort(x[marks], kind="stable")]
            befores = group.column("y").take(pa.array(marks))
            none = befores.is_null().to_numpy()
            first, last = span(x[marks])
            # A mark without one before is the first in any interval: it sorts below all bounds.
            values = befores.fill_null(0).to_numpy()
            values = np.where(none, -1, np.searchsorted(np.sort(a), values, "right"))
            firsts = smaller(values, first, last, np.searchsorted(np.sort(a), a, "right"))
        return pa.RecordBatch.from_arrays([*out, pa.array(firsts)], names=["a", "b", *names, "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            if (group.column("kind").to_numpy() == 2).any():
                yield told(group)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in ("level", "at", "part", "copy")], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                key = tuple(keys[begin].tolist())
                if held and key != last:
                    yield from done()
                    held = []
                last = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from done()

    return run


def interval_totals(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    low: str,
    high: str,
    include_high: bool,
    totals: Mapping[str, Column],
    distinct: tuple[str, str] | None,
) -> DataFrame:
    """Each row of ``intervals`` that holds a point, with sums over its points: no pair is made.

    ``totals`` names sums of whole numbers or doubles of ``points`` (null: 0); ``distinct`` is a name and the column of
    ``points`` whose different values, nulls aside, it counts. Points, low and high ends are all doubles
    or all whole numbers, dates or times.

    Points of one value are summed first. An interval is its two outer cells, where its points are looked up, and
    the whole cells between, taken in ever wider ones, where the sums of a cell are enough. A value is
    counted at its first point in an interval: the one whose next smaller point of that value is before the
    interval begins. All these are sums over cells, so a cell of very many points or intervals is split.
    """
    kinds = points.schema[point].dataType, intervals.schema[low].dataType, intervals.schema[high].dataType
    (x, kind), (a, *_), (b, *_) = told = [exact(F.col(f"`{n}`"), k) for n, k in zip((point, low, high), kinds, strict=True)]
    if {k for _, k in told} != {kind}:
        raise TypeError("points and ends of intervals of different kinds")
    counted = distinct[1] if distinct else point
    values = points.select(x.alias("x"), F.col(f"`{counted}`").alias("key"), *[v.alias(f"v{k}") for k, v in enumerate(totals.values())])
    names = ["n", *(f"v{k}" for k in range(len(totals)))]
    types = {}
    for name in names[1:]:
        types[name] = exact(F.col(name), values.schema[name].dataType)[1]
    sound = F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double"))
    sums = [F.sum(F.coalesce(F.col(v).cast(k), F.lit(0).cast(k))).alias(v) for v, k in types.items()]
    at_value = kept(values.where(sound).groupBy("x").agg(F.count("*").alias("n"), *sums), "range-points")
    asked = intervals.select(a.alias("a"), b.alias("b")).where("a <= b and not isnan(double(a)) and not isnan(double(b))")
    reach = at_value.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    # Intervals beside all points hold none.
    asked = asked.where((F.col("a") <= F.lit(reach.high)) & (F.col("b") >= F.lit(reach.low)))
    double = lambda name: F.col(name).cast("double")
    bounds, cells = grid(at_value.select(double("x").alias("x")), "x", reach.n)
    place = lambda name: cell_of(double(name), bounds, cells)
    asked = kept(asked.distinct().withColumn("first", place("a")).withColumn("last", place("b")), "range-asked")
    depth = (cells * max(1, len(bounds)) + 2).bit_length()
    pieces = [F.expr("array(struct(-1 AS level, first AS at), struct(-1 AS level, last AS at))")]
    for k in range(depth):
        # The whole cells first + 1 .. last - 1, as a segment tree takes them.
        begin, end = F.expr(f"shiftright(first + {1 << k}L, {k})"), F.expr(f"shiftright(last, {k})")
        chosen = lambda odd, at: F.when((begin < end) & (odd % 2 == 1), F.struct(F.lit(k).alias("level"), at.alias("at")))  # noqa: B023, E731
        pieces.append(F.array(chosen(begin, begin), chosen(end, end - 1)))
    pieces = F.filter(F.array_distinct(F.concat(*pieces)), lambda p: p.isNotNull())
    questions = asked.select("a", "b", F.explode(pieces).alias("p")).select("p.*", F.lit(2).alias("kind"), "a", "b")
    levels = [r[0] for r in questions.where("level >= 0").select("level").distinct().collect()]
    wide = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")
    up = F.expr("shiftright(cell, level)").alias("at")
    laid = at_value.withColumn("cell", place("x"))
    outer = laid.select(F.lit(-1).alias("level"), F.col("cell").alias("at"), F.lit(0).alias("kind"), "x", *names)
    whole = laid.groupBy("cell").agg(F.min("x").alias("x"), *[F.sum(v).alias(v) for v in names])
    whole = whole.select("cell", wide, "x", *names).select("level", up, "x", *names)
    whole = whole.groupBy("level", "at").agg(F.min("x").alias("x"), *[F.sum(v).alias(v) for v in names])
    nothing = F.lit(None).cast(kind)
    rows = outer.unionByName(whole.withColumn("kind", F.lit(0))).withColumn("y", nothing)
    if distinct:
        marks = values.where(sound & F.col("key").isNotNull()).select("key", "x").distinct()
        marks = kept(earlier(marks, F.floor((place("x") - 1) / F.lit(cells))).withColumn("cell", place("x")), "range-marks")
        spread = F.explode(F.array(F.lit(-1), *map(F.lit, levels)).cast("array<int>")).alias("level")
        at = F.when(F.col("level") < 0, F.col("cell")).otherwise(F.expr("shiftright(cell, greatest(level, 0))")).alias("at")
        marks = marks.select("cell", spread, "x", "before").select("level", at, F.lit(1).alias("kind"), "x", F.col("before").alias("y"))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    both = rows.select("level", "at", F.lit(1).alias("p"), F.lit(0).alias("q"))
    both = both.unionByName(questions.select("level", "at", F.lit(0).alias("p"), F.lit(1).alias("q")))
    sizes = both.groupBy("level", "at").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    all_points, all_questions = sizes.agg(F.sum("p"), F.sum("q")).first()
    most = [max(HOT_ROWS, (n or 0) // HOT_PARTS) for n in (all_points, all_questions)]
    over = sizes.where((F.col("p") > most[0]) | (F.col("q") > most[1])).where("p > 0 and q > 0")
    # At most HOT_PARTS cells of each level are over one of the bounds.
    over = small_frame(over.select("level", "at", F.ceil(F.col("p") / most[0]).cast("int").alias("parts"), F.ceil(F.col("q") / most[1]).cast("int").alias("copies")))

    def dealt(df: DataFrame, mine: str, others: str, by: list[str]) -> DataFrame:
        own, other = {"parts": "part", "copies": "copy"}[mine], {"parts": "part", "copies": "copy"}[others]
        df = df.join(F.broadcast(over), ["level", "at"], "left")
        df = df.withColumn(own, F.pmod(F.xxhash64(*by), F.coalesce(mine, F.lit(1))).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)))
        return df.drop("parts", "copies")

    questions = dealt(questions.withColumnsRenamed({"a": "x", "b": "y"}), "copies", "parts", ["x", "y"])
    everything = dealt(rows, "parts", "copies", ["x", "y"]).unionByName(questions, allowMissingColumns=True)
    group = ["level", "at", "part", "copy"]
    everything = everything.repartition(*group).sortWithinPartitions(*group)
    everything = everything.select(*group, "kind", "x", "y", *names)
    out = ", ".join([f"a {kind}, b {kind}, n long", *(f"{v} {k}" for v, k in types.items()), "firsts long"])
    found = everything.mapInArrow(counting(names, include_high), out)
    found = found.groupBy("a", "b").agg(*[F.sum(v).alias(v) for v in [*names, "firsts"]]).where("n > 0")
    named = found.select("a", "b", *[F.col(v).alias(f"_{v}") for v in [*names, "firsts"]])
    ends = intervals.select(F.struct(*[F.col(f"`{c}`") for c in intervals.columns]).alias("_i"), a.alias("a"), b.alias("b"))
    result = [F.col(f"_v{k}").alias(name) for k, name in enumerate(totals)]
    result += [F.col("_firsts").alias(distinct[0])] if distinct else []
    return ends.join(named, ["a", "b"]).select(*[F.col(f"_i.`{c}`").alias(c) for c in intervals.columns], *result)
