"""One document of each group of copies and near copies, by wide SimHash fingerprints.

Near copies share a Jaccard likeness of five-word shingles of 0.8 or more. At that likeness about 15
of 100 fingerprint bits differ, far more than the few bits of ``simhash``, so the fingerprints are
wider (256 bits) and no plan that must find every pair is affordable. Correlated bits are grouped into
parts as there; so many parts are probed that a pair at the bound is found with a chance of ``FOUND``.
In each bucket the fingerprints within reach are joined by a minimum spanning forest, and each edge of
it is verified on the shingles of the two texts. A failed edge does not part what it joins: texts joined
by edges, failed or not, are a pool, and in a pool that verified links leave in pieces every two texts of
different pieces are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, ship, text_of, written
from tabulens.llm.components import components
from tabulens.llm.simhash import correlated, in_groups, whole_groups

WORDS, LIKENESS = 5, 0.8
LANES = 4
BITS = 64 * LANES
FOUND = 0.97
# Rows that a bucket of chance neighbours holds, in the mean, as a power of two.
BUCKET_POWER = 5
SAMPLE = 4096
SMALL, BLOCK = 96, 4096
# Texts and shingles of a pool that are compared in one group; of larger pools, blocks two by two.
POOL_ROWS, POOL_SHINGLES = 1024, 1 << 20
# 16 bytes a row.
BROADCAST_ROWS = 1_000_000
NAMES = [f"f{k}" for k in range(LANES)]


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the shingles; none for a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    width = min(WORDS, len(parts))
    first, last = (ends - sizes)[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(first, last, strict=True)), np.uint64))


def wide_fingerprint(marks: np.ndarray) -> np.ndarray:
    """For each of 256 bits drawn from a shingle's hash, whether over half of the shingles have it."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(marks), 1 << 13):
        drawn = np.empty((len(marks[k : k + (1 << 13)]), LANES), np.uint64)
        for lane in range(LANES):
            x = marks[k : k + (1 << 13)] + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            drawn[:, lane] = x ^ (x >> np.uint64(31))
        bits = np.unpackbits(drawn.view(np.uint8).reshape(len(drawn), -1), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(marks), bitorder="little").view(np.int64)


def apart(likeness: float) -> float:
    """The share of bits in which two texts of equal size and this Jaccard likeness differ."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def reach() -> int:
    """Differing bits within which all but a few in a thousand pairs at the bound lie."""
    p = apart(LIKENESS)
    return round(BITS * p + 3 * math.sqrt(BITS * p * (1 - p)))


def planned(sample: np.ndarray, rows: int) -> list[tuple[int, ...]]:
    """The parts to probe: their size follows the number of rows, their number the chance wanted."""
    size = min(24, max(8, round(math.log2(max(rows, 2))) - BUCKET_POWER))
    chance = (1 - apart(LIKENESS)) ** size
    need = math.ceil(math.log(1 - FOUND) / math.log(1 - chance))
    bits = np.unpackbits(sample.view(np.uint8).reshape(len(sample), -1), axis=1, bitorder="little").astype(float)
    parts = correlated(bits, BITS // size)[:need]
    draw = np.random.default_rng(1)
    while len(parts) < need:
        order = draw.permutation(BITS)
        parts += [tuple(sorted(order[k : k + size].tolist())) for k in range(0, BITS - size + 1, size)]
    return parts[:need]


def _masked(part: tuple[int, ...]) -> list[Column]:
    out = []
    for k, name in enumerate(NAMES):
        mask = sum(1 << (b - 64 * k) for b in part if b // 64 == k)
        if mask:
            out.append(F.col(name).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return out


def forest(groups: np.ndarray, sides: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows joined in minimum spanning forests of their groups, over pairs within reach."""
    most = reach()
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL, sizes) & (sides == 2)
    near: list[np.ndarray] = []
    for shift in range(1, SMALL):
        at = np.flatnonzero(small[:-shift] & (groups[:-shift] == groups[shift:]))
        if not at.size:
            break
        d = np.bitwise_count(values[at] ^ values[at + shift]).sum(axis=1)
        at, d = at[d <= most], d[d <= most]
        near.append(np.stack([d, at, at + shift]))
    first, second = [], []
    found = np.concatenate(near, axis=1) if near else np.zeros((3, 0), np.int64)
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := parent.get(k, k)) != k:
            parent[k] = parent.get(up, up)
            k = parent[k]
        return k

    for _, i, j in found.T[np.argsort(found[0], kind="stable")].tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            first.append(i)
            second.append(j)
    for begin, size in zip(edges[:-1].tolist(), sizes.tolist(), strict=True):
        if size > SMALL or (size > 1 and sides[begin] != 2):
            one, two = _grown(values[begin : begin + size], sides[begin : begin + size], most)
            first += [begin + k for k in one]
            second += [begin + k for k in two]
    return np.array(first, np.int64), np.array(second, np.int64)


def _grown(values: np.ndarray, sides: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A minimum spanning forest grown from one row after the other."""
    n = len(values)
    across = not (sides == 2).all()
    best = np.full(n, most + 1, np.int64)
    link = np.full(n, -1, np.int64)
    out = np.zeros(n, bool)
    first, second = [], []
    for _ in range(n):
        k = int(np.where(out, BITS + 2, best).argmin())
        if best[k] <= most:
            first.append(int(link[k]))
            second.append(k)
        out[k] = True
        d = np.bitwise_count(values ^ values[k]).sum(axis=1).astype(np.int64)
        closer = (d < best) & ~out
        if across:
            closer &= sides != sides[k]
        best[closer], link[closer] = d[closer], k
    return first, second


def near_links(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs ``(a, b)`` of ``marks(node, f0..f3)`` to verify: forests of each bucket, each pair once."""
    ship(marks.sparkSession)
    rows = marks.count()
    if rows < 2:
        return marks.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    step = max(1, rows // SAMPLE)
    sample = marks.where(F.pmod(F.xxhash64(*NAMES), F.lit(step)) == 0).select(*NAMES).limit(4 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = marks.select(*NAMES).limit(SAMPLE).toArrow()
    values = np.stack([sample.column(n).to_numpy() for n in NAMES], axis=1)
    parts = planned(np.ascontiguousarray(values), rows)
    keys = F.array(*[F.xxhash64(F.lit(k), *_masked(part)) for k, part in enumerate(parts)])
    grouped = in_groups(marks.select("node", *NAMES, F.explode(keys).alias("key")), ["node", *NAMES], block)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in whole_groups(batches):
            node = now.column("node").to_numpy()
            prints = np.stack([now.column(n).to_numpy().view(np.uint64) for n in NAMES], axis=1)
            one, two = forest(now.column("group").to_numpy(), now.column("side").to_numpy(), prints)
            a, b = node[one], node[two]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )

    return grouped.mapInArrow(verify, "a long, b long").distinct()


def parted_links(marks: list[np.ndarray], pieces: np.ndarray, sides: np.ndarray) -> tuple[list[int], list[int]]:
    """Links by likeness that join different ``pieces``, only so many as join them.

    Side 2 stands for rows compared with all others; of sides 0 and 1, in this order, only pairs across.
    """
    sizes = np.array([len(m) for m in marks], np.int64)
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(marks), return_inverse=True)[1]
    seen = np.zeros(len(codes), bool)
    label = pieces.copy()
    first, second = [], []
    for i in np.flatnonzero(sides != 1).tolist():
        # The smaller of two like texts has at least that share of the larger one's shingles.
        fits = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= LIKENESS * np.maximum(sizes, sizes[i])) & (sizes > 0)
        fits[: i + 1] = False
        if sides[i] == 0:
            fits &= sides == 1
        at = np.flatnonzero(fits)
        if not at.size:
            continue
        mine = codes[ends[i] - sizes[i] : ends[i]]
        seen[mine] = True
        common = np.r_[0, np.cumsum(seen[codes])]
        seen[mine] = False
        both = common[ends[at]] - common[ends[at] - sizes[at]]
        for j in at[both >= LIKENESS * (sizes[at] + sizes[i] - both)].tolist():
            if label[j] != label[i]:
                first.append(i)
                second.append(j)
                label[label == label[j]] = label[i]
    return first, second


def hidden_links(
    pairs: DataFrame, links: DataFrame, texts: DataFrame, sizes: DataFrame, rows: int = POOL_ROWS, most: int = POOL_SHINGLES
) -> DataFrame:
    """Links ``(a, b)`` between the pieces that verified ``links`` leave of what ``pairs`` join.

    ``texts(node, text)`` are those of all ends; ``sizes(node, n)`` counts their shingles. Pairs within
    the largest piece of a pool are never compared, so its blocks meet only those of the other pieces.
    """
    pools = components(pairs).withColumnRenamed("component", "pool")
    pieces = components(links).withColumnRenamed("component", "piece")
    named = pools.join(pieces, "node", "left").join(sizes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    named = written(named.select("node", "pool", F.coalesce("piece", "node").alias("piece"), "n"), "pools")
    blocks = lambda docs, n: F.ceil(F.greatest(docs / rows, n / most)).cast("int")
    parts = named.groupBy("pool", "piece").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    largest = F.max(F.struct("docs", "n", "piece")).alias("l")
    parted = parts.groupBy("pool").agg(F.count("*").alias("pieces"), F.sum("docs").alias("docs"), F.sum("n").alias("n"), largest)
    whole = (F.col("docs") <= rows) & (F.col("n") <= most)
    parted = parted.where("pieces > 1").select(
        "pool",
        F.when(~whole, F.col("l.piece")).alias("largest"),
        F.when(whole, 1).otherwise(blocks(F.col("docs") - F.col("l.docs"), F.col("n") - F.col("l.n"))).alias("few"),
        F.when(whole, 0).otherwise(blocks(F.col("l.docs"), F.col("l.n"))).alias("many"),
    )
    inside = F.coalesce(F.col("piece") == F.col("largest"), F.lit(False))
    dealt = lambda n: F.pmod(F.xxhash64(F.lit(11), "node"), n).cast("int")
    mine = F.when(inside, F.col("few") + dealt(F.col("many"))).otherwise(dealt(F.col("few")))
    others = F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    places = F.transform(
        others,
        lambda other: F.struct(
            F.xxhash64("pool", F.least("mine", other), F.greatest("mine", other)).alias("group"),
            F.when(other == F.col("mine"), 2).when(F.col("mine") < other, 0).otherwise(1).alias("side"),
        ),
    )
    placed = named.join(parted, "pool").withColumn("mine", mine)
    placed = written(placed.select("node", "piece", F.explode(places).alias("g")).select("node", "piece", "g.*"), "parted")
    if placed.isEmpty():
        return links.limit(0)
    grouped = texts.join(placed, "node").repartition("group").sortWithinPartitions("group", "side", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in whole_groups(batches):
            node, piece, side = (now.column(n).to_numpy() for n in ("node", "piece", "side"))
            groups, text = now.column("group").to_numpy(), now.column("text")
            edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]).tolist()
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                marks = [shingles(t.as_py()) for t in text.slice(begin, end - begin)]
                one, two = parted_links(marks, piece[begin:end], side[begin:end])
                a, b = node[begin:end][one], node[begin:end][two]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
                )

    return grouped.select("node", "piece", "group", "side", "text").mapInArrow(compare, "a long, b long")


def small_side(written_rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of two longs to join whole texts with: broadcast up to ``most`` rows, so that the texts
    stay where they are; with more, both sides are shuffled."""
    return F.broadcast(written_rows) if written_rows.count() <= most else written_rows


def component_pairs(told: DataFrame, equal: DataFrame, found: DataFrame) -> DataFrame:
    """``(a, b)``: each text of a component of ``found(node, component)`` with the component's least node."""
    marks = told.join(found, "node").select("text_mark", "component").distinct()
    members = marks.join(equal.select("text_mark", "node"), "text_mark").select("component", "node")
    least = members.groupBy("component").agg(F.min("node").alias("a"))
    return members.join(least, "component").where("a < node").select("a", F.col("node").alias("b"))


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None
) -> DataFrame:
    """``(id, text_mark, stays)`` of the rows that have copies or near copies; one id of a group stays.

    ``text_mark`` tells texts apart; rows of one id are one document if their texts are equal.
    ``found(id, component_id)`` are components to verify besides the ones that the fingerprints here lead to.
    """
    mark = F.xxhash64(F.sha2(text_of(text_col), 256))
    rows = docs.select(F.col(f"`{id_col}`").alias("node"), mark.alias("text_mark"), text_of(text_col).alias("text"))
    rows = rows.where("node IS NOT NULL")

    def prints(columns: list) -> Iterator[tuple]:
        for node, text_mark, text in zip(*columns, strict=True):
            marks = shingles(text)
            yield node, text_mark, len(marks), *wide_fingerprint(marks).tolist()

    lanes = ", ".join(f"{n} long" for n in NAMES)
    told = written(map_rows(rows, prints, f"node long, text_mark long, n long, {lanes}"), "prints")
    equal = written(
        told.groupBy("text_mark", "n", *NAMES).agg(F.min("node").alias("node"), F.count_distinct("node").alias("copies")),
        "equal",
    )
    # A text without words has copies only.
    pairs = near_links(equal.where("n > 0").select("node", *NAMES))
    if found is not None:
        named = found.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col("component_id").alias("component"))
        named = named.where("node IS NOT NULL").distinct()
        pairs = pairs.union(component_pairs(told.select("node", "text_mark").distinct(), equal.where("n > 0"), named)).distinct()
    pairs = written(pairs, "near")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = written(ends.join(equal.select("node", "text_mark"), "node"), "ends")
    texts = written(rows.join(small_side(ends), ["node", "text_mark"]).select("node", "text").distinct(), "texts")

    def alike(columns: list) -> Iterator[tuple]:
        for a, b, one, two in zip(*columns, strict=True):
            x, y = shingles(one), shingles(two)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= LIKENESS * (len(x) + len(y) - both):
                yield a, b

    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    sides = sides.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
    links = written(map_rows(sides.select("a", "b", "one", "two"), alike, "a long, b long"), "alike")
    found = components(links.union(hidden_links(pairs, links, texts, equal.select("node", "n"))))
    named = equal.join(found, "node", "left").select(
        "text_mark", F.coalesce("component", "node").alias("stays"), "copies", F.col("component").isNotNull().alias("near")
    )
    grouped = named.where("near OR copies > 1").select("text_mark", "stays")
    return told.select("node", "text_mark").join(grouped, "text_mark").distinct()


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None
) -> DataFrame:
    """``docs`` without the rows that are copies or near copies of one with a smaller id.

    Of each group linked by a likeness of 0.8 or more, the smallest id stays, with all its columns.
    Equal texts are copies whatever they hold; texts without words have no near copies. Rows equal in
    id and text stay or go together; rows with a null id stay. Every two texts of a component of
    ``found(id, component_id)`` are compared too, but for those that verified links join already.
    """
    gone = copies(docs, id_col, text_col, found).where("node <> stays").select("node", "text_mark")
    gone = written(gone.withColumnsRenamed({"node": "gone_node", "text_mark": "gone_mark"}), "gone")
    mark = F.xxhash64(F.sha2(text_of(text_col), 256))
    same = (docs[id_col].cast("long") == gone["gone_node"]) & (mark == gone["gone_mark"])
    return docs.join(small_side(gone), same, "left_anti")
