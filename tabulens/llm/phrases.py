"""Lempel-Ziv phrase fingerprints: texts are alike as far as they build the same phrase dictionary."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, map_stream, text_of

LANES = 128
# A dictionary of so many phrases is closed and a new one begun, which bounds memory for any text.
MOST_PHRASES = 1 << 18
ODD = 0x9E3779B97F4A7C15
LOW = (1 << 56) - 1
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
EMPTY = "0" * (4 * LANES)


@dataclass
class Parse:
    """The dictionary of a text read so far: each phrase is a known one and one byte more.

    A phrase is known by a hash of its bytes, made from that of the phrase it extends, so equal
    phrases of different texts are equal. ``lanes`` holds the least hashes of closed dictionaries.
    """

    known: dict[int, int] = field(default_factory=dict)
    at: int = 0
    lanes: np.ndarray | None = None

    def read(self, data: bytes) -> None:
        known, at = self.known, self.at
        get = known.get
        for byte in data:
            key = at | byte
            at = get(key)
            if at is None:
                if len(known) >= MOST_PHRASES:
                    self.lanes = self._least()
                    known = self.known = {}
                    get = known.get
                known[key] = ((key * ODD) >> 20 & LOW) << 8
                at = 0
        self.at = at

    def copy(self) -> Parse:
        return Parse(dict(self.known), self.at, self.lanes)

    def _least(self) -> np.ndarray:
        """The least hash in each of ``LANES`` equal ranges, all bits set where there is none."""
        x = np.fromiter(self.known.values(), np.uint64, len(self.known))
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
        x = np.append(np.sort(x), FULL)
        width = np.uint64((1 << 64) // LANES)
        floor = np.arange(LANES, dtype=np.uint64) * width
        first = x[np.searchsorted(x, floor)]
        first = np.where(first - floor < width, first, FULL)
        return first if self.lanes is None else np.minimum(first, self.lanes)

    def fingerprint(self) -> str:
        """Four hex digits for each lane; an empty lane takes those of another, chosen by its number."""
        least = self._least()
        full = least != FULL
        if not full.any():
            return EMPTY
        for lane in np.flatnonzero(~full).tolist():
            draws = ((lane * ODD + turn * 0xD1B54A32D192ED03 >> 20) % LANES for turn in itertools.count(1))
            least[lane] = least[next(probe for probe in draws if full[probe])]
        return (least & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    parse = Parse()
    parse.read(text.encode("utf-8", "surrogatepass"))
    return parse.fingerprint()


def likeness(one: str, other: str) -> float:
    """The share of equal lanes, an estimate of the Jaccard likeness of two phrase sets.

    Two texts without phrases are alike, one without is like no other.
    """
    if EMPTY in (one, other):
        return float(one == other)
    same = np.frombuffer(bytes.fromhex(one), ">u2") == np.frombuffer(bytes.fromhex(other), ">u2")
    return float(same.mean())


def phrase_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_chars`` and ``fingerprint`` of each text; a null text is empty. One row per row."""

    def rows(columns: list) -> Iterator[tuple]:
        for key, text in zip(*columns, strict=True):
            yield key, len(text), fingerprint(text)

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text"))
    return map_rows(picked, rows, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to ranges of falling ids, sorted, each range closed by the first row of the next.

    Columns ``id, text, range, closing``: a closing row only tells what follows the last row of its
    range; after the last range comes the first. Null ids come last; rows of one id go by a hash of
    their text. Texts are shuffled once; only the bounds of the ranges pass through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / count for k in range(1, count)]
    bounds = rows.agg(F.percentile_approx("id", shares, 20 * count)).first()[0] or []
    bounds = sorted(set(bounds))
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("id"))) if bounds else F.lit(0)
    last = len(bounds)
    ranged = rows.withColumn("range", F.when(F.col("id").isNull(), last).otherwise(above).cast("int"))
    first: Column = F.struct("id", F.bitwise_not(F.xxhash64("text")).alias("mark"))
    tops = dict(ranged.groupBy("range").agg(F.max(first)).collect())
    order = sorted(tops)
    before = {here: order[k - 1] for k, here in enumerate(order)}
    own = F.struct(F.col("range"), F.lit(0).alias("closing"))
    if order:
        pick = lambda values, kind: F.element_at(
            F.array(*[F.lit(values.get(k)).cast(kind) for k in range(last + 1)]), F.col("range") + 1
        )
        kind = dict(rows.dtypes)["id"]
        is_top = F.col("id").eqNullSafe(pick({k: v[0] for k, v in tops.items()}, kind)) & (
            F.bitwise_not(F.xxhash64("text")) == pick({k: v[1] for k, v in tops.items()}, "long")
        )
        closes = F.struct(pick(before, "int").alias("range"), F.lit(1).alias("closing"))
        places = F.when(is_top, F.array(own, closes)).otherwise(F.array(own))
    else:
        places = F.array(own)
    return (
        ranged.select("id", "text", F.explode(places).alias("place"))
        .select("id", "text", "place.range", "place.closing")
        .repartition("range")
        .sortWithinPartitions("range", "closing", F.desc_nulls_last("id"), F.xxhash64("text"))
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of an edited form of it, and how near both and the next text are.

    The edited text has the last third of the code points (rounded down) replaced by the first as
    many, or all, of the document that follows by falling id; the first follows the last, a single
    document follows itself. Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``. Null texts are empty; null ids follow
    all others; repeated rows each have their result; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[list]) -> Iterator[tuple]:
        held = None
        for columns in batches:
            for key, text, _, closing in zip(*columns, strict=True):
                cut = len(text) - len(text) // 3
                begun = Parse()
                begun.read(text[:cut].encode("utf-8", "surrogatepass"))
                whole = begun.copy()
                whole.read(text[cut:].encode("utf-8", "surrogatepass"))
                mark = whole.fingerprint()
                if held is not None:
                    one, old, at, parse, own = held
                    tail = text[: len(old) - at]
                    parse.read(tail.encode("utf-8", "surrogatepass"))
                    edited = parse.fingerprint()
                    digest = hashlib.sha256((old[:at] + tail).encode("utf-8", "surrogatepass")).hexdigest()
                    yield one, len(old), digest, own, edited, likeness(own, edited), likeness(own, mark)
                held = None if closing else (key, text, cut, begun, mark)

    schema = (
        f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return map_stream(with_next(docs, id_col, text_col), rows, schema)
