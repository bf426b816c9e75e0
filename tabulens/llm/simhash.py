"""SimHash fingerprints of texts and their links by the generalised pigeonhole principle.

Two fingerprints that differ in at most r bits differ, in one of the parts that the bits are dealt
to, in at most that part's threshold, whenever the thresholds plus one add up to r + 1. The parts
group correlated bits, and the thresholds are chosen by dynamic programming over the candidates that
a sample lets expect. The sample only sets the cost of the search; its result is exact for any plan.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, ship, text_of, written
from tabulens.llm.components import components

BITS = 64
SAMPLE = 4096
# One key row through a shuffle costs about as much as comparing so many pairs in a task.
PAIRS_PER_ROW = 1000
# Fingerprints compared in one task; larger buckets are cut into blocks, one group for each two.
BLOCK = 8192


def fingerprint(text: str, words: int) -> int:
    """The bits that more than half of the shingle hashes have; 0 for a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(parts))
    first, last = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(first), 1 << 15):
        hashes = np.fromiter(
            (digest(joined[i:j], 42) for i, j in zip(first[k : k + (1 << 15)], last[k : k + (1 << 15)], strict=True)),
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    over = np.flatnonzero(2 * set_bits > len(first))
    return sum(1 << int(k) for k in over)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3
) -> DataFrame:
    """The id and ``fingerprint`` (a long, its bits as they are) of each text.

    Words are runs without ASCII white space, A-Z in lower case; shingles of ``words`` words count as
    often as they occur; a text with fewer words is one shingle, one without words has 0.
    """

    def rows(columns: list) -> Iterator[tuple]:
        for key, text in zip(*columns, strict=True):
            value = fingerprint(text, words)
            yield key, value - (1 << BITS) if value >> (BITS - 1) else value

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text"))
    return map_rows(picked, rows, f"`{id_col}` {kind}, fingerprint long")


@dataclass(frozen=True)
class Part:
    """Some of the bits, and in how many of them a linked pair may differ there."""

    bits: tuple[int, ...]
    threshold: int

    def masks(self) -> list[int]:
        """What a fingerprint shows of these bits with every choice of ``threshold`` bits left open."""
        whole = sum(1 << b for b in self.bits)
        return [
            whole & ~sum(1 << b for b in open_bits)
            for open_bits in itertools.combinations(self.bits, min(self.threshold, len(self.bits)))
        ]


def grouped_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The bits in ``parts`` groups of like size, each grown from one bit by its most correlated."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    return correlated(bits, parts)


def correlated(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The columns of ``bits`` in ``parts`` groups, as ``grouped_bits`` says."""
    bits = bits - bits.mean(axis=0)
    scale = np.sqrt((bits**2).sum(axis=0))
    scale[scale == 0] = 1
    likeness = np.abs((bits.T @ bits) / np.outer(scale, scale))
    left, groups = list(range(bits.shape[1])), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [max(left, key=lambda b: (likeness[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (likeness[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(tuple(sorted(group)))
    return groups


def plan_parts(sample: np.ndarray, rows: int, radius: int) -> list[Part]:
    """The cheapest grouping and thresholds for ``rows`` fingerprints, judged by a sample of them."""
    best: tuple[float, list[Part]] | None = None
    for parts in range(2, radius + 2):
        groups = grouped_bits(sample, parts)
        costs = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            apart = _distances(sample & mask, radius)
            reached = np.cumsum(apart) / max(1, len(sample) * (len(sample) - 1) // 2)
            cost = {-1: 0.0}
            for t in range(radius + 1):
                keys = math.comb(len(bits), t)
                # Bits left open at random hold a pair of distance d <= t in comb(size - d, t - d) buckets.
                pairs = sum(
                    (reached[d] - (reached[d - 1] if d else 0)) * math.comb(len(bits) - d, t - d)
                    for d in range(t + 1)
                )
                cost[t] = PAIRS_PER_ROW * keys * rows + pairs * rows * rows / 2
            costs.append(cost)
        # table[s]: the least cost with thresholds plus one adding up to s.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            table = {
                s: min(
                    (table[s - t - 1][0] + cost[t], [*table[s - t - 1][1], t])
                    for t in cost
                    if s - t - 1 in table
                )
                for s in range(radius + 2)
                if any(s - t - 1 in table for t in cost)
            }
        total, chosen = table[radius + 1]
        if best is None or total < best[0]:
            best = (total, [Part(b, t) for b, t in zip(groups, chosen, strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _distances(values: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of the sample at each distance up to ``radius``."""
    found = np.zeros(radius + 1, np.int64)
    for k in range(0, len(values), 512):
        apart = np.bitwise_count(values[k : k + 512, None] ^ values[None, k:])
        counts = np.bincount(apart.ravel(), minlength=radius + 1)[: radius + 1]
        square = np.bitwise_count(values[k : k + 512, None] ^ values[None, k : k + 512])
        twice = np.bincount(square.ravel(), minlength=radius + 1)[: radius + 1]
        found += counts - twice + (twice - np.eye(1, radius + 1, dtype=np.int64)[0] * len(square)) // 2
    return found


def linked(
    keys: np.ndarray, sides: np.ndarray, values: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``keys`` that join all their values at most ``radius`` bits apart.

    Only so many links as join them are returned. Side 2 stands for a bucket in one piece; sides 0
    and 1 are two blocks of a bucket, of which only pairs across are compared.
    """
    first: list[np.ndarray] = []
    second: list[np.ndarray] = []
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= 32, sizes) & (sides == 2)
    for shift in range(1, 32):
        at = np.flatnonzero(small[:-shift] & (keys[:-shift] == keys[shift:]))
        if not at.size:
            break
        at = at[np.bitwise_count(values[at] ^ values[at + shift]) <= radius]
        first.append(at)
        second.append(at + shift)
    for begin, size in zip(edges[:-1].tolist(), sizes.tolist(), strict=True):
        if size > 32 or (size > 1 and sides[begin] != 2):
            one, two = _forest(values[begin : begin + size], sides[begin : begin + size], radius)
            first.append(one + begin)
            second.append(two + begin)
    none = np.zeros(0, np.int64)
    return np.concatenate([*first, none]), np.concatenate([*second, none])


def _forest(values: np.ndarray, sides: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the values within ``radius`` bits of each other."""
    here = np.flatnonzero(sides != 1)
    there = here if (sides == 2).all() else np.flatnonzero(sides == 1)
    label = np.arange(len(values))
    first, second = [], []
    for k in range(0, len(here), 256):
        near = np.bitwise_count(values[here[k : k + 256], None] ^ values[there][None, :]) <= radius
        for i, row in zip(here[k : k + 256].tolist(), near, strict=True):
            others = there[row]
            roots, at = np.unique(label[others], return_index=True)
            for root, j in zip(roots.tolist(), others[at].tolist(), strict=True):
                if root != label[i]:
                    first.append(i)
                    second.append(j)
                    label[label == max(root, label[i])] = min(root, label[i])
    return np.array(first, np.int64), np.array(second, np.int64)


def fingerprint_links(marks: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` joining all rows of ``marks(node, fingerprint)`` within ``radius`` bits.

    Each fingerprint should stand once. A link is a pair whose distance was verified; of the pairs of
    a bucket only so many are returned as join the same nodes. A bucket over ``block`` rows is cut
    into blocks, and each two blocks are compared in a group of their own.
    """
    ship(marks.sparkSession)
    rows = marks.count()
    step = max(1, rows // SAMPLE)
    sample = (
        marks.where(F.pmod(F.xxhash64("fingerprint"), F.lit(step)) == 0)
        .select("fingerprint")
        .limit(4 * SAMPLE)
        .toArrow()
        .column(0)
        .to_numpy()
        .astype(np.int64)
        .view(np.uint64)
    )
    parts = plan_parts(sample, rows, radius)
    masks = [
        F.struct(F.lit(k).alias("part"), F.lit(m - (1 << BITS) if m >> 63 else m).alias("mask"))
        for k, m in enumerate(m for part in parts for m in part.masks())
    ]
    probes = marks.select("node", "fingerprint", F.explode(F.array(*masks)).alias("m")).select(
        "node",
        "fingerprint",
        F.xxhash64("m.part", F.col("fingerprint").bitwiseAND(F.col("m.mask"))).alias("key"),
    )
    grouped = in_groups(probes, ["node", "fingerprint"], block)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in whole_groups(batches):
            node = now.column("node").to_numpy()
            values = now.column("fingerprint").to_numpy().view(np.uint64)
            one, two = linked(now.column("group").to_numpy(), now.column("side").to_numpy(), values, radius)
            for k in range(0, len(one), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[one[k : k + (1 << 16)]]), pa.array(node[two[k : k + (1 << 16)]])],
                    names=["a", "b"],
                )

    return grouped.mapInArrow(verify, "a long, b long")


def in_groups(probes: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Rows of ``probes`` (with a ``key``) by ``group`` and ``side``, each group whole in one partition.

    A key of up to ``block`` rows is one group with side 2. A larger one is cut into blocks, with a
    group for each block (side 2) and for each two (sides 0 and 1), so every two rows of a key meet.
    Keys are hashes: a clash only adds comparisons, as every link is verified.
    """
    large = probes.groupBy("key").count().where(F.col("count") > block)
    large = large.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit(7), *columns), F.col("blocks")).cast("int")
    lone = F.array(F.struct(F.col("key").alias("group"), F.lit(2).alias("side")))
    dealt = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)).alias("group"),
            F.when(other == mine, 2).when(mine < other, 0).otherwise(1).alias("side"),
        ),
    )
    places = F.explode(F.when(F.col("blocks").isNull(), lone).otherwise(dealt)).alias("g")
    return (
        probes.join(large, "key", "left")
        .select(*columns, places)
        .select(*columns, "g.group", "g.side")
        .repartition("group")
        .sortWithinPartitions("group", "side", *columns)
    )


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no ``group`` is parted."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        groups = held.column("group").to_numpy()
        ready = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
        if ready:
            yield held.slice(0, ready)
            held = held.slice(ready)
    if held is not None and held.num_rows:
        yield held


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 3,
) -> DataFrame:
    """Each document's ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; the component is the
    smallest integer id reachable. Texts that are null, empty or blank have fingerprint zero and are
    linked like any other. Rows with one id count as one document where components are concerned;
    rows with a null id keep their fingerprint and get the component of its other documents, or null.
    Other columns are not read; an empty table gives an empty result.
    """
    marks = written(
        fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "node"), "fingerprints"
    )
    distinct = written(
        marks.groupBy("fingerprint").agg(F.min("node").alias("node")).where("node IS NOT NULL"), "distinct"
    )
    found = components(fingerprint_links(distinct, radius))
    named = distinct.join(found, "node", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id")
    )
    return marks.join(named, "fingerprint", "left").select(
        F.col("node").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
