"""Periodic runs of words, found tile by tile for each octave of periods and stitched in Spark.

A run is a stretch of words with smallest period q and at least ``max(6, 4 * q)`` words that no
neighbour extends. Periods from ``span / 2`` up to ``span`` form an octave; its boundaries lie
``span`` words apart, so every run of the octave has a boundary with two whole periods behind it.
There the Z-functions of the words after the boundary and before it say how far each period reaches,
within a window of four spans: a fragment of the run. Windows of neighbouring boundaries share more
than a period, so fragments that overlap by a period are one stretch, whatever tile they came from.

Octaves of small periods share tiles, larger ones have tiles of their own. A text of a single tile is
solved where it lies; the tiles of longer texts are rows of their own and are dealt to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, map_stream, text_of, written

LEAST_WORDS, LEAST_TIMES = 6, 4
# Octaves up to this span share tiles of CORE words; a wider one has tiles of CORE_SPANS spans.
FINEST, CORE, CORE_SPANS = 2048, 1 << 14, 8
ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start:long,length:long,period:long>"
FRAGMENT = "period long, start long, end long"

Fragment = tuple[int, int, int]


def tiles(n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``low, high, at, stop, left, right``: spans, the boundaries' range and the words of each tile."""
    low, high = 2, FINEST
    while low // 2 <= n // LEAST_TIMES:
        core = CORE if low == 2 else CORE_SPANS * high
        for at in range(0, n, core):
            stop = min(n, at + core)
            yield low, high, at, stop, max(0, at - high), min(n, stop + 3 * high)
        low = high = 2 * high


def z_function(s: list[int]) -> list[int]:
    """How many words from each place on agree with the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def repeating(after: np.ndarray, span: int) -> np.ndarray:
    """Which lengths below ``span`` are a shorter root several times over, by the Z-function there."""
    marked = np.zeros(span, bool)
    roots = np.arange(1, min(span // 2 + 1, len(after)))
    for q in roots[after[roots] + roots >= span // 2].tolist():
        if not marked[q]:
            marked[2 * q : int(after[q]) + q + 1 : q] = True
    return marked


def at_boundary(words: np.ndarray, b: int, span: int, periods: np.ndarray) -> Iterator[Fragment]:
    """Stretches of each smallest period among ``periods`` around ``b``, as places in the tile."""
    begin, end = max(0, b - span), min(len(words), b + 3 * span)
    after = np.array(z_function(words[b:end].tolist()))
    # A root that repeats a shorter one belongs to the octave of that period.
    periods = periods[(after[periods] >= span // 2) & ~repeating(after, span)[periods]]
    if not len(periods):
        return
    until = min(b + span, end)
    back = words[begin:b][::-1].tolist()
    before = z_function([*back, -1, *words[begin:until][::-1].tolist()])
    for p in periods.tolist():
        start = b - min(len(back), before[len(back) + 1 + until - b - p])
        stop = b + p + int(after[p])
        if stop - start >= 2 * p:
            yield p, start, stop


def joined(found: list[Fragment]) -> Iterator[Fragment]:
    """Fragments of one period that overlap by a period are one."""
    held: Fragment | None = None
    for p, start, end in sorted(set(found)):
        if held and held[0] == p and start + p <= held[2]:
            held = (p, held[1], max(held[2], end))
        else:
            if held:
                yield held
            held = (p, start, end)
    if held:
        yield held


def fragments(words: np.ndarray, low: int, high: int, at: int, stop: int, left: int) -> list[Fragment]:
    """Fragments of the runs of a tile: ``words`` from place ``left`` of the text on."""
    found: list[Fragment] = []
    # Equal stretches of half a span have equal hashes, so only boundaries where one comes again
    # are looked at; the Z-functions decide.
    hashes, span = words.astype(np.uint64), 2
    while span <= high and len(hashes):
        half = span // 2
        if span >= low:
            first = -(-at // span) * span
            bounds = np.arange(first, stop, span) - left
            bounds = bounds[bounds + half < len(hashes)]
            again = bounds[:, None] + np.arange(half, span)
            known = again < len(hashes)
            hits = known & (hashes[np.where(known, again, 0)] == hashes[bounds][:, None])
            for k in np.flatnonzero(hits.any(axis=1)).tolist():
                periods = np.flatnonzero(hits[k]) + half
                found.extend(at_boundary(words, int(bounds[k]), span, periods))
        hashes = (hashes[:-half] * ODD + hashes[half:]) if len(hashes) > half else hashes[:0]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * ODD
        span *= 2
    return [(p, start + left, end + left) for p, start, end in joined(found)]


def long_enough(period: int, start: int, end: int) -> bool:
    return end - start >= max(LEAST_WORDS, LEAST_TIMES * period)


def collapse(words: list[str], runs: list[dict]) -> str:
    """The words joined by one space, without those that a run repeats after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        edge[run["start"] + run["period"]] += 1
        edge[run["start"] + run["length"]] -= 1
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def _cut(columns: list) -> Iterator[tuple]:
    for row, key, text in zip(*columns, strict=True):
        words = [w.decode("utf-8") for w in text.encode("utf-8").split()]
        seen: dict[str, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)
        planned = list(tiles(len(words)))
        found, sent = [], []
        if len(planned) == 1:
            low, high, at, stop, left, right = planned[0]
            found = [f for f in fragments(ids, low, high, at, stop, left) if long_enough(*f)]
        else:
            sent = [(*t[:5], ids[t[4] : t[5]].tobytes()) for t in planned]
        yield row, key, len(words), " ".join(words), bool(found or sent), found, sent


def _solve(columns: list) -> Iterator[tuple]:
    for row, low, high, at, stop, left, ids in zip(*columns, strict=True):
        for found in fragments(np.frombuffer(ids, np.int32), low, high, at, stop, left):
            yield row, *found


def stitched(found: DataFrame) -> DataFrame:
    """``text_row, runs`` from ``text_row, period, start, end`` of all tiles."""
    group = Window.partitionBy("text_row", "period").orderBy("start", "end")
    before = F.max("end").over(group.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") + F.col("period") > before), 1).otherwise(0)
    length = F.col("end") - F.col("start")
    whole = (
        found.withColumn("opens", opens)
        .withColumn("stretch", F.sum("opens").over(group))
        .groupBy("text_row", "period", "stretch")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .where(length >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "period", length.alias("length"))))
    return whole.groupBy("text_row").agg(
        F.transform(ordered, lambda r: F.struct(r.start, r.length, r.period)).cast(f"array<{RUN}>").alias("runs")
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text of each row of ``docs``.

    A null or empty text has no words, no run and collapses to nothing. Rows are told apart by their
    place, so repeated rows and null ids each give a row; other columns are not read; an empty table
    gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("text_row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")
    )
    tile = "struct<low:long,high:long,at:long,stop:long,left:long,ids:binary>"
    cut = map_stream(
        rows,
        lambda batches: (r for columns in batches for r in _cut(columns)),
        f"text_row long, id {kind}, n_words long, collapsed string, open boolean,"
        f" found array<struct<period:long,start:long,end:long>>, tiles array<{tile}>",
        slice_rows=64,
    )
    cut = written(cut, "periods")
    sent = cut.where("size(tiles) > 0").select("text_row", F.explode("tiles").alias("tile"))
    dealt = sent.select("text_row", "tile.*").repartition("text_row", "low", "at")
    found = cut.select("text_row", F.inline("found")).unionByName(
        map_rows(dealt, _solve, f"text_row long, {FRAGMENT}")
    )
    texts = cut.select("text_row", "id", "n_words", "collapsed", "open")
    closed = texts.where("not open").select(
        "id", "n_words", F.array().cast(f"array<{RUN}>").alias("runs"), "collapsed"
    )

    def shorten(columns: list) -> Iterator[tuple]:
        for key, n_words, words, runs in zip(*columns, strict=True):
            runs = runs or []
            out = collapse(words.split(" "), runs) if runs else words
            yield key, n_words, [(r["start"], r["length"], r["period"]) for r in runs], out

    opened = map_rows(
        texts.where("open").join(stitched(found), "text_row", "left").select("id", "n_words", "collapsed", "runs"),
        shorten,
        f"id {kind}, n_words long, runs array<{RUN}>, collapsed string",
    )
    return closed.unionByName(opened).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic end in one text of ten: the hash of the id says where and how long.

    With h the CRC of the id's decimals, n the words, a and p from h: every word i from a on becomes
    the word ``a + (i - a) % p``. Only where h divides by 10; null ids and texts without words stay.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text_of(text_col), F.lit(r"[^ \t-\r]+"), F.lit(0))
    some = F.when(h % 10 == 0, words)
    out = docs.withColumn("period_words", some).withColumn("period_n", F.size("period_words"))
    n = F.col("period_n")
    out = out.withColumn("period_a", F.when(n > 0, (g % n).cast("int")))
    a = F.col("period_a")
    out = out.withColumn("period_p", F.when(n > 0, (1 + F.floor((n - a) / (3 + g % 8))).cast("int")))
    p, held = F.col("period_p"), F.col("period_words")
    times = F.ceil((n - a) / p).cast("int")
    end = F.slice(F.flatten(F.array_repeat(F.slice(held, a + 1, p), times)), F.lit(1), n - a)
    new = F.array_join(F.concat(F.slice(held, F.lit(1), a), end), " ")
    return out.withColumn(text_col, F.when(n > 0, new).otherwise(F.col(f"`{text_col}`"))).select(*docs.columns)
