"""Exact hard negatives by a multiway hyperplane tree with distance ranges between siblings.

Scores are whole inner products. Rows are lifted onto a sphere (one more coordinate), so the rows whose
score with an anchor lies in a window lie in an annulus around it. The tree's split points come from a
bounded sample; every row falls to its nearest split point, level by level. For each split point
and each sibling the tree holds the least and the greatest distance to the rows below that sibling,
over all rows. An anchor's annulus, seen from a split point, is a range of distances too: siblings
whose ranges it misses are left out. What remains is compared exactly: rows are stored once, ordered by leaf,
label and id, in blocks. A task has a group of anchors and a segment of the stored files; it reads the
blocks one after the other and keeps each anchor's best rows so far, so no pair of rows and anchors is
ever shuffled, and what it needs does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulens.llm.common import map_rows, ship, written

# The tree is built of at most so many rows, whose scores also bound the first search.
SAMPLE = 4096
WAYS, LEAF_ROWS, MOST_LEVELS = 8, 2048, 4
BLOCK_ROWS, FILE_ROWS = 8192, 1 << 17
# Anchors in a group, groups and cells (a group and a segment) that are aimed at, rows of a segment at least.
GROUP_ANCHORS, LEAST_ANCHORS, GROUPS, CELLS, SEGMENT_ROWS = 4096, 64, 16, 256, 1 << 19
# So many scores are held at once.
SCORES = 1 << 20
ANY = 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1
ROW_BITS = 36


@dataclass
class Node:
    """Split points (lifted), what lies below each (a node, or ``-1 - leaf``), and distance ranges
    ``near[i, j], far[i, j]`` from point i to the rows below point j."""

    points: np.ndarray
    below: list[int]
    near: np.ndarray
    far: np.ndarray


@dataclass
class Tree:
    nodes: list[Node]
    paths: list[list[tuple[int, int]]]
    square: float
    width: int

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.square - np.einsum("ij,ij->i", vectors, vectors))
        return np.column_stack([vectors, np.sqrt(rest)])

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        points, leaves = self.lifted(vectors), np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            # All points lie on one sphere, so the nearest has the greatest inner product.
            nearest = (points[rows] @ self.nodes[node].points.T).argmax(axis=1)
            for j, below in enumerate(self.nodes[node].below):
                mine = rows[nearest == j]
                if below < 0:
                    leaves[mine] = -1 - below
                elif len(mine):
                    todo.append((below, mine))
        return leaves

    def ranges(self, leaf: int, vectors: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """``node, i, j, least, greatest`` distance of the rows of a leaf, on its way from the root."""
        points = self.lifted(vectors)
        for node, j in self.paths[leaf]:
            d = distances(points, self.nodes[node].points)
            for i, (low, high) in enumerate(zip(d.min(axis=0).tolist(), d.max(axis=0).tolist(), strict=True)):
                yield node, i, j, low, high

    def reached(self, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Leaves that may hold a row whose score with any of the anchors lies in its window."""
        return self.reaching(anchors, lo, hi).any(axis=0)

    def reaching(self, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """For each anchor, the leaves (among the wanted) that may hold a row with a score in its window."""
        found = np.zeros((len(anchors), len(self.paths)), bool)
        far = np.einsum("ij,ij->i", anchors, anchors) + self.square
        slack = 1e-6 * (1 + np.sqrt(far))
        inner = np.maximum(0.0, np.sqrt(np.maximum(0.0, far - 2 * hi)) - slack)
        outer = np.sqrt(np.maximum(0.0, far - 2 * lo)) + slack
        able = (lo <= hi) & (far - 2 * lo >= 0)
        if not self.nodes:
            found[:] = able[:, None]
            return found
        open_nodes = {node for leaf, path in enumerate(self.paths) if wanted is None or wanted[leaf] for node, _ in path}
        points = np.column_stack([anchors, np.zeros(len(anchors))])
        todo = [(0, np.flatnonzero(able))]
        while todo:
            at, rows = todo.pop()
            if at not in open_nodes:
                continue
            node = self.nodes[at]
            d = distances(points[rows], node.points)
            r1, r2 = inner[rows, None], outer[rows, None]
            least = np.where((d >= r1) & (d <= r2), 0.0, np.minimum(abs(d - r1), abs(d - r2))) - slack[rows, None]
            most = d + r2 + slack[rows, None]
            for j, below in enumerate(node.below):
                meets = ((least <= node.far[:, j]) & (most >= node.near[:, j])).all(axis=1)
                if not meets.any():
                    continue
                if below < 0:
                    found[rows[meets], -1 - below] = True
                else:
                    todo.append((below, rows[meets]))
        return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def build(sample: np.ndarray, square: float, rows: int) -> Tree:
    """A tree of the sample for so many rows; its ranges are still open."""
    tree = Tree([], [], square, sample.shape[1])
    points = tree.lifted(sample)
    levels = 0
    while levels < MOST_LEVELS and LEAF_ROWS * WAYS**levels < rows:
        levels += 1

    def grow(mine: np.ndarray, path: list[tuple[int, int]]) -> int:
        chosen = apart(points[mine]) if len(path) < levels and len(mine) > 2 * WAYS else []
        if len(chosen) < 2:
            tree.paths.append(path)
            return -len(tree.paths)
        at, split = len(tree.nodes), points[mine[chosen]]
        size = (len(chosen), len(chosen))
        tree.nodes.append(Node(split, [], np.full(size, np.inf), np.full(size, -np.inf)))
        nearest = (points[mine] @ split.T).argmax(axis=1)
        for j in range(len(chosen)):
            tree.nodes[at].below.append(grow(mine[nearest == j], [*path, (at, j)]))
        return at

    grow(np.arange(len(points)), [])
    return tree


def apart(points: np.ndarray) -> list[int]:
    """Places of up to ``WAYS`` different points, each the farthest from those before."""
    middle = points.mean(axis=0)
    chosen = [int(((points - middle) ** 2).sum(axis=1).argmax())]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < WAYS and gap.max() > 1e-6:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, scale: float) -> DataFrame:
    """``id, label, anchor, v`` (int32 bytes) of the rows that take part."""
    # Floats are made doubles in Arrow batches, which is cheaper than a cast of each element.
    vector = F.col(f"`{vector_col}`")
    kind = vectors.select(vector).schema[0].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.FloatType | T.DoubleType):
        vector = vector.cast("array<double>")
    picked = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("x"),
    ).where("id is not null and label is not null and x is not null")

    def whole(batch: pa.RecordBatch) -> Iterator[list]:
        vectors, flat = batch.column(3), batch.column(3).flatten()
        sizes = vectors.value_lengths().to_numpy()
        if flat.null_count or len(set(sizes.tolist())) > 1:
            # A null in a vector is as good as NaN. Vectors of one length are taken together.
            flat, begins = flat.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            parts = [(np.flatnonzero(sizes == n), n) for n in np.unique(sizes).tolist()]
            parts = [(at, flat[begins[at][:, None] + np.arange(n)]) for at, n in parts]
        else:
            parts = [(np.arange(len(sizes)), flat.to_numpy().reshape(len(sizes), -1))] if len(sizes) else []
        for at, x in parts:
            finite = np.isfinite(x).all(axis=1)
            at, x = at[finite], np.floor(scale * x[finite].astype(float))
            large = np.flatnonzero(abs(x).max(axis=1, initial=0) >= 2**31)
            if len(large):
                raise ValueError(f"a component of {batch.column(0)[at[large[0]]]} is too large for scores that fit a long")
            yield [*(batch.column(c).take(pa.array(at)) for c in range(3)), packed(x.astype("<i4"))]

    return map_arrays(picked, whole, "id long, label long, anchor boolean, v binary")


def map_arrays(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[list]], schema: str) -> DataFrame:
    """Like ``map_rows`` with whole columns: ``function`` yields Arrow columns."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(column: pa.Array, kind: str, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers from bytes; those shorter than ``width`` have zeros at the end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size, sizes = np.dtype(kind).itemsize, np.diff(ends)
    width = int(sizes.max(initial=0)) // size if width is None else width
    if (sizes == size * width).all() and width and len(sizes):
        return np.frombuffer(column.buffers()[2], kind, len(sizes) * width, int(ends[0])).reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    for k, v in enumerate(column.to_pylist()):
        out[k, : len(v) // size] = np.frombuffer(v, kind)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = a.shape[1] * abs(a).max(initial=0) * abs(b).max(initial=0)
    if most < 2**53:
        return a @ b.T
    if most >= 2**62:
        raise ValueError("scores may not fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass(frozen=True)
class Index:
    """All rows in blocks, ordered by leaf, label and id, in files; a sample with ids and labels.

    ``segments`` are files with their leaves; components are stored as ``kind``. ``begins[p]`` anchors lie
    before the part p of the rows, and of the ``groups`` each has ``group`` of them.
    """

    blocks: DataFrame
    tree: Tree
    segments: list[list[tuple[str, list[int]]]]
    kind: str
    begins: list[int]
    group: int
    groups: int
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray


BLOCK = (
    "leaf int, n long, row long, ids binary, labels binary, v binary, "
    "spans array<struct<node int, i int, j int, low double, high double>>, "
    "asked array<struct<anchor long, nth long, id long, label long, v binary>>"
)


def indexed(rows: DataFrame) -> Index | None:
    """The index of all rows of ``quantised``, None where there are none."""
    spark = rows.sparkSession
    rows = written(rows, "negative-rows")

    def measure(batch: pa.RecordBatch) -> Iterator[list]:
        if batch.num_rows:
            x = unpacked(batch.column(0), "<i4").astype(float)
            told = len(x), x.shape[1], float(np.einsum("ij,ij->i", x, x).max()), float(abs(x).max(initial=0))
            yield [pa.array([t]) for t in told]

    told = map_arrays(rows.select("v"), measure, "n long, width long, square double, most double").agg(
        F.sum("n"), F.max("width"), F.max("square"), F.max("most")
    ).first()
    if not told[0]:
        return None
    n, width, square, most = told
    width = max(1, width)
    kind = "<i2" if most < 2**15 else "<i4"
    held = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("id", "label", "v").toArrow()
    sample = unpacked(held.column("v").combine_chunks(), "<i4", width).astype(float)
    ids, labels = (held.column(c).to_numpy() for c in ("id", "label"))
    tree = build(sample, square, n)

    def place(batch: pa.RecordBatch) -> Iterator[list]:
        x = unpacked(batch.column(3), "<i4", width)
        leaves = pa.array(tree.leaf_of(x.astype(float)).astype(np.int32))
        yield [leaves, *(batch.column(c) for c in (1, 0, 4, 2)), packed(x.astype(kind))]

    placed = map_arrays(
        rows.withColumn("at", F.monotonically_increasing_id()), place, "leaf int, label long, id long, at long, anchor boolean, v binary"
    )
    # Rows that are the same in all else differ by their place in the input, so they are dealt too.
    order, many = ["leaf", "label", "id", "at"], n // FILE_ROWS + 1
    if many > int(spark.conf.get("spark.sql.shuffle.partitions")):
        placed = placed.repartitionByRange(many, *order)
    else:
        placed = placed.repartitionByRange(*order)
    block_rows, arrow = BLOCK_ROWS, to_arrow_schema(T.StructType.fromDDL(BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << ROW_BITS
        at = nth = 0

        def block(found: list[tuple]) -> pa.RecordBatch:
            nonlocal at, nth
            leaf = int(found[0][0][0])
            label, key, anchor, x = (np.concatenate([f[c] for f in found]) for c in (1, 2, 3, 4))
            chosen = np.flatnonzero(anchor).tolist()
            asked = [(first + at + n, nth + k, int(key[n]), int(label[n]), x[n].tobytes()) for k, n in enumerate(chosen)]
            spans = list(tree.ranges(leaf, x.astype(float)))
            made = leaf, len(x), first + at, key.tobytes(), label.tobytes(), x.tobytes(), spans, asked
            at, nth = at + len(x), nth + len(chosen)
            return pa.RecordBatch.from_arrays([pa.array([m], f.type) for m, f in zip(made, arrow, strict=True)], schema=arrow)

        found: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4)]
            columns.append(unpacked(batch.column(5), kind, width))
            begin, held = 0, sum(len(f[0]) for f in found)
            while begin < batch.num_rows:
                leaf = columns[0][begin]
                if found and (held == block_rows or found[0][0][0] != leaf):
                    yield block(found)
                    found, held = [], 0
                end = min(begin + block_rows - held, int(np.searchsorted(columns[0], leaf, "right")))
                found.append(tuple(c[begin:end] for c in columns))
                begin, held = end, held + end - begin
        if found:
            yield block(found)

    blocks = written(placed.sortWithinPartitions(*order).mapInArrow(pack, BLOCK), "negative-blocks")
    # A row for each two siblings of the tree.
    spanned = blocks.select(F.inline("spans")).groupBy("node", "i", "j").agg(F.min("low"), F.max("high"))
    for node, i, j, low, high in spanned.collect():
        tree.nodes[node].near[i, j], tree.nodes[node].far[i, j] = low, high
    files = blocks.groupBy(F.input_file_name().alias("file")).agg(
        F.min("row").alias("row"), F.sum("n"), F.sum(F.size("asked")), F.collect_set("leaf")
    ).orderBy("row").collect()
    anchors = sum(f[3] for f in files)
    group = min(GROUP_ANCHORS, max(LEAST_ANCHORS, -(-anchors // GROUPS)))
    parts = min(-(-n // SEGMENT_ROWS), max(4, -(-CELLS * group // max(1, anchors))))
    segments: list[list] = [[] for _ in range(parts)]
    begins, before, passed = [0] * ((files[-1][1] >> ROW_BITS) + 1), 0, 0
    for file, row, count, with_anchors, leaves in files:
        begins[row >> ROW_BITS] = passed
        segments[before * parts // n].append((file, leaves))
        before, passed = before + count, passed + with_anchors
    return Index(blocks, tree, [s for s in segments if s], kind, begins, group, max(1, -(-anchors // group)), ids, labels, sample)


def stored(files: list[tuple[str, list[int]]], useful: np.ndarray, kind: str, width: int) -> Iterator[tuple]:
    """``leaves, ids, labels, rows, vectors`` of the useful leaves' blocks, some blocks at once where they are small."""
    held: list[tuple] = []

    def together() -> tuple:
        leaves = np.unique([h[0] for h in held])
        return leaves, *(np.concatenate([h[c] for h in held]) for c in range(1, 5))

    for file, leaves in files:
        if not useful[leaves].any():
            continue
        store, path = fs.FileSystem.from_uri(file) if ":/" in file else (fs.LocalFileSystem(), file)
        with store.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(batch_size=8, columns=["leaf", "row", "ids", "labels", "v"]):
                for leaf, row, *packed in zip(*(batch.column(c) for c in range(5)), strict=True):
                    if useful[leaf.as_py()]:
                        ids, labels, v = (
                            np.frombuffer(b.as_buffer(), k) for b, k in zip(packed, ("<i8", "<i8", kind), strict=True)
                        )
                        if held and sum(len(h[1]) for h in held) + len(ids) > BLOCK_ROWS:
                            yield together()
                            held = []
                        held.append((leaf.as_py(), ids, labels, row.as_py() + np.arange(len(ids)), v.reshape(-1, width)))
    if held:
        yield together()


def places(hits: np.ndarray) -> np.ndarray:
    """Where few of many are true, eight looked at together."""
    hits = hits.reshape(-1)
    whole = len(hits) // 8 * 8
    words = np.flatnonzero(hits[:whole].view(np.uint64))
    inner = np.flatnonzero(hits[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[inner // 8] * 8 + inner % 8, whole + np.flatnonzero(hits[whole:])])


class Best:
    """The first ``k`` rows so far for each anchor and window: greater scores, then smaller ids, first.

    ``lo`` rises to the score of the k-th row.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int) -> None:
        self.lo, self.hi, self.k = lo.copy(), hi, k
        self.score, self.id, self.row = (np.full((lo.size, k), x, np.int64) for x in (LEAST, MOST, MOST))

    def floors(self, at: np.ndarray, key: int, row: int) -> np.ndarray:
        """The least score that can still count for each anchor, for rows that come not before this one."""
        last = [x[:, -1].reshape(self.lo.shape)[at] for x in (self.score, self.id, self.row)]
        # Where k rows are found, a later row of the k-th row's score comes after it.
        after = (last[0] > LEAST) & ((last[1] < key) | ((last[1] == key) & (last[2] < row)))
        floor = self.lo[at] + after
        return np.where(floor <= self.hi[at], floor, MOST).min(axis=1)

    def take(self, at: np.ndarray, told: np.ndarray, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray, able: Callable) -> None:
        """Scores of the anchors ``at`` with rows; ``able(anchor, row)`` tells the pairs that count."""
        bound = 2**24 if told.dtype == np.float32 else 2**53
        if told.dtype != np.int64:
            floor = np.where(floor > bound, np.inf, np.maximum(floor, -bound)).astype(told.dtype)
        hits = told >= floor[:, None]
        if np.count_nonzero(hits) > hits.size >> 5:
            most = self.hi[at].max(axis=1)
            hits &= told <= (most if told.dtype == np.int64 else np.clip(most, -bound, bound).astype(told.dtype))[:, None]
        found = places(hits)
        if not len(found):
            return
        n, c = np.divmod(found, told.shape[1])
        score, n = told.ravel()[found].astype(np.int64), at[n]
        some = able(n, c)
        n, c, score = n[some], c[some], score[some]
        inside, window = np.nonzero((score[:, None] >= self.lo[n]) & (score[:, None] <= self.hi[n]))
        if len(inside):
            self._merge(n[inside] * self.lo.shape[1] + window, score[inside], ids[c[inside]], rows[c[inside]])

    def _merge(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keys, key = np.unique(key, return_inverse=True)
        had = self.score[keys] > LEAST
        key = np.concatenate([key, np.nonzero(had)[0]])
        score, ids, rows = (
            np.concatenate([new, old[keys][had]]) for new, old in ((score, self.score), (ids, self.id), (rows, self.row))
        )
        order = np.lexsort((rows, ids, -score, key))
        key, score, ids, rows = (x[order] for x in (key, score, ids, rows))
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(begins, np.diff(begins, append=len(key)))
        first = rank < self.k
        key, rank = keys[key[first]], rank[first]
        for held, new in ((self.score, score), (self.id, ids), (self.row, rows)):
            held[key, rank] = new[first]
        kth = self.score[keys, -1]
        lo = self.lo.reshape(-1)
        lo[keys] = np.maximum(lo[keys], kth)


def search(index: Index, requests: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, request, rank, id, score``: the first ``k`` rows for each window of each anchor.

    ``requests`` has ``anchor`` (its row), ``id, label, group, v`` and ``windows`` (scores from ``lo`` to
    ``hi``). Rows of the anchor's label are found where ``same``, else those of other labels.
    Greater scores come first, ties by smaller id.
    """
    tree, width, kind, segments = index.tree, index.tree.width, index.kind, index.segments
    sample, known, kinds = index.sample, index.ids, index.labels
    # Sums of products, whole and in part, stay below the greatest square: floats of that many bits are exact.
    number = np.float32 if tree.square < 2**24 else np.float64
    most_scores = SCORES
    cells = index.groups * len(segments)
    # A cell is little data and much work, so cells are dealt over tasks of their own.
    dealt = requests.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(len(segments) - 1))))
    grouped = dealt.repartition(cells, "group", "segment").groupBy("group", "segment").agg(
        F.collect_list(F.struct("anchor", "id", "label", "v", "windows")).alias("anchors")
    )

    def compare(columns: list) -> Iterator[tuple]:
        for segment, anchors in zip(*columns, strict=True):
            vectors = np.frombuffer(b"".join(a["v"] for a in anchors), kind).reshape(-1, width).astype(float)
            mine, own_ids, own = (np.array([a[c] for a in anchors], np.int64) for c in ("anchor", "id", "label"))
            lo = np.ones((len(anchors), max(len(a["windows"]) for a in anchors)), np.int64)
            hi = np.zeros_like(lo)
            for n, a in enumerate(anchors):
                for w, window in enumerate(a["windows"]):
                    lo[n, w], hi[n, w] = window["lo"], window["hi"]
            by_label = {x: np.flatnonzero(own == x) for x in np.unique(own).tolist()}
            quick = vectors.astype(number)

            def meet(best: Best, at: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, able: Callable) -> None:
                """Compare anchors with rows, few at a time."""
                step = max(1, most_scores // len(x))
                first = int(ids.argmin())
                floor = best.floors(at, int(ids[first]), int(rows[first]))
                at, floor = at[floor < MOST], floor[floor < MOST]
                for begin in range(0, len(at), step):
                    some = at[begin : begin + step]
                    told = product(quick[some], vectors[some], x)
                    best.take(some, told, floor[begin : begin + step], ids, rows, able)

            def product(a: np.ndarray, exact: np.ndarray, x: np.ndarray) -> np.ndarray:
                if tree.square < 2**53:
                    return a @ x.astype(number, copy=False).T
                told = scores(exact, x.astype(float))
                return told if told.dtype == np.int64 else told.astype(np.int64)

            # The sample's own k-th best bounds each window from below. Its rows come again in their blocks.
            bound, everyone = Best(lo, hi, k), np.arange(len(anchors))
            for begin, end in ((0, 256), (256, len(sample))):
                x, ids, labels = (held[begin:end] for held in (sample, known, kinds))
                if len(x):
                    meet(
                        bound, everyone, x, np.full(len(x), LEAST), np.arange(begin, begin + len(x)),
                        lambda n, c, ids=ids, labels=labels: ((labels[c] == own[n]) == same) & (ids[c] != own_ids[n]),
                    )
            best = Best(bound.lo, hi, k)
            wanted = np.zeros(len(tree.paths), bool)
            wanted[[leaf for _, leaves in segments[segment] for leaf in leaves]] = True
            open_windows = best.lo <= hi
            reach = tree.reaching(
                vectors,
                np.where(open_windows, best.lo, ANY).min(axis=1).astype(float),
                np.where(open_windows, hi, -ANY).max(axis=1).astype(float),
                wanted,
            )
            for leaves, ids, labels, rows, v in stored(segments[segment], reach.any(axis=0), kind, width):
                x, met = v.astype(number), reach[:, leaves].any(axis=1)
                if same:
                    order = np.argsort(labels, kind="stable")
                    edges = [0, *(np.flatnonzero(np.diff(labels[order])) + 1).tolist(), len(labels)]
                    for begin, end in zip(edges, edges[1:], strict=False):
                        some = order[begin:end]
                        at = by_label.get(int(labels[some[0]]), everyone[:0])
                        at = at[met[at]]
                        if len(at):
                            part = rows[some]
                            meet(best, at, x[some], ids[some], part, lambda n, c, part=part: part[c] != mine[n])
                    continue
                others = met & (own != labels[0]) if (labels == labels[0]).all() else met
                meet(best, np.flatnonzero(others), x, ids, rows, lambda n, c, labels=labels: labels[c] != own[n])
            n, rank = np.nonzero(best.score > LEAST)
            anchor, window = mine[n // lo.shape[1]], n % lo.shape[1]
            yield from zip(
                anchor.tolist(), window.tolist(), best.row[n, rank].tolist(), best.id[n, rank].tolist(), best.score[n, rank].tolist(), strict=True
            )

    found = map_rows(
        grouped.select("segment", "anchors"), compare, "anchor long, request int, other long, id long, score long"
    )
    order = Window.partitionBy("anchor", "request").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "anchor", "request", "rank", "id", "score"
    )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, exact.

    An anchor's positives are the first ``positives`` other rows of its label; a positive's negatives the
    first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` hundredths of
    the positive's. Greater scores come first, ties by smaller id. Rows without id, label or vector,
    or with a component that is null or not finite, take no part. A shorter vector has zeros at its end.
    Repeated rows are rows of their own: a copy of an anchor is another row, and an anchor too. Labels are
    whole numbers. Other columns are not read; an empty table gives an empty result.
    """
    rows = quantised(vectors, id_col, vector_col, label_col, anchor, scale)
    index = indexed(rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], RESULT)

    # Anchors in the order of the rows, so those of a group lie near each other.
    begin = F.element_at(F.array(*map(F.lit, index.begins)), F.shiftright("anchor", ROW_BITS).cast("int") + 1)
    asked = index.blocks.select(F.inline("asked")).withColumn("group", F.floor((begin + F.col("nth")) / index.group).cast("int"))
    anchors = written(asked.drop("nth"), "negative-anchors")
    whole = F.array(F.struct(F.lit(-ANY).alias("lo"), F.lit(ANY).alias("hi")))
    found = written(search(index, anchors.withColumn("windows", whole), True, positives), "negative-positives")
    # 100 * score lies between low and high times the positive's: whole bounds, rounded inwards.
    window = F.struct(
        (-F.floor(-F.col("score") * low / F.lit(100).cast("decimal(3,0)"))).cast("long").alias("lo"),
        F.floor(F.col("score") * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("hi"),
    )
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", window.alias("w")))).alias("windows"))
    windows = windows.select("anchor", F.transform("windows", lambda w: w["w"]).alias("windows"))
    answers = search(index, anchors.join(windows, "anchor"), False, negatives)
    return (
        answers.select(
            "anchor", (F.col("request") + 1).alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        )
        .join(found.select("anchor", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "of"])
        .join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
