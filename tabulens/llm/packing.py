"""Packing tokenized documents into sequences of a fixed length by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
sequences that hold every length as often as it occurs. It is solved by multiplicative weights: a
length's price starts at its share of a sequence and falls exponentially with the part of its pieces
already covered; the configuration of highest price (an unbounded knapsack, by dynamic programming)
is taken for as many sequences as cover a fixed share of one of its lengths. The result is rounded to
whole sequences within the pieces there are, and what is left is placed where it fits best, lengths in
falling order. All this works on the histogram of lengths, at most one row per length up to the
capacity; the pieces themselves stay in Spark and look up their place by their rank in their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, ship, text_of, written

CAPACITY = 2048
# Share of a length's pieces that one configuration covers at most, the fall of its price once all are
# covered (as an exponent), and the most steps; the rest is left to the best-fit rule.
STEP, FALL, STEPS = 0.5, 0.5, 400
# Prices rise a little faster than lengths, so that long pieces are taken while there are short ones
# to go with them.
BEND = 1.2
# Configurations taken from one knapsack table, and how near to the best price they are.
AT_ONCE, NEAR = 32, 0.01
# Rows of one length that are ranked in one group at least; more if the partitions are larger.
RANKED = 250

# Characters whose classes are the same in every version of the Unicode tables in use.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ]*")
# The pattern that byte-level tokenizers of this kind split words by, as their library defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 1_000_000


class Encoder:
    """Ids of texts by a tokenizer file, by a faster engine where both are known to agree."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        plain = (
            told["model"].get("type") in (None, "BPE")
            and told.get("normalizer") is None
            and told["pre_tokenizer"]
            == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not told["model"].get("ignore_merges")
            and not told["model"].get("dropout")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
        )
        if plain:
            import tiktoken

            special = {t["content"]: t["id"] for t in told["added_tokens"]}
            letters = _byte_letters()
            ranks = {
                bytes(letters[c] for c in token): k
                for token, k in told["model"]["vocab"].items()
                if token not in special
            }
            self.fast = tiktoken.Encoding(
                "file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special
            )

    def ids(self, text: str) -> np.ndarray:
        if self.fast and len(text) <= LONG_TEXT and PLAIN.fullmatch(text):
            return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Documents as ids closed by ``end_id``, those longer than ``capacity`` cut into full pieces.

    ``piece`` counts from 0, ``start`` is the ids before it; only the first piece of a cut document
    may be shorter. ``ids_crc32`` is of the little-endian 32-bit ids; ``ids`` (these bytes) is there
    if ``keep_ids``. A null text is empty and so one piece of one id.
    """

    def cut(columns: list) -> Iterator[tuple]:
        encode = encoder(tokenizer)
        for key, text in zip(*columns, strict=True):
            ids = np.append(encode.ids(text), np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            starts = [0, *range(first, len(ids), capacity)]
            for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                packed = ids[start:end].tobytes()
                row = (key, k, start, end - start, zlib.crc32(packed))
                yield (*row, packed) if keep_ids else row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    picked = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text"))
    return map_rows(picked, cut, schema + ", ids binary" * keep_ids)


Pattern = tuple[int, ...]


def best_configurations(prices: np.ndarray, capacity: int) -> Iterator[Pattern]:
    """Multisets of lengths within ``capacity`` of nearly the highest total price, the best first.

    One knapsack table gives the best configuration with each length in it; those within ``NEAR`` of
    the best of all are returned, at most ``AT_ONCE``. Prices go by length from 1.
    """
    lengths = np.flatnonzero(prices > 0)
    worth = prices[lengths]
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = upto[c]
        best[c] = best[c - 1]
        if n:
            value = best[c - lengths[:n]] + worth[:n]
            at = int(value.argmax())
            if value[at] > best[c]:
                best[c], took[c] = value[at], lengths[at]
    value = worth + best[capacity - lengths]
    order = np.argsort(-value, kind="stable")
    for at in order[value[order] >= (1 - NEAR) * best[capacity]][:AT_ONCE].tolist():
        out, c = [int(lengths[at])], capacity - int(lengths[at])
        while c > 0:
            if took[c]:
                out.append(int(took[c]))
                c -= int(took[c])
            else:
                c -= 1
        yield tuple(sorted(out, reverse=True))


def solve_program(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> dict[Pattern, float]:
    """A fractional solution: how many sequences to fill by each configuration.

    ``counts[l]`` pieces have length l. A few lengths may stay uncovered when ``steps`` run out.
    """
    size = np.arange(len(counts))
    need = np.maximum(counts, 1).astype(float)
    covered = np.where(counts > 0, 0.0, 1.0)
    solution: dict[Pattern, float] = {}
    for _ in range(steps):
        prices = np.where(covered < 1 - 1e-9, (size / capacity) ** BEND * np.exp(-FALL * covered), 0.0)
        if not prices.any():
            break
        for chosen in best_configurations(prices, capacity):
            lengths, times = np.unique(chosen, return_counts=True)
            left = (1 - covered[lengths]) * need[lengths] / times
            amount = float(min(left.min(), max((STEP * need[lengths] / times).min(), 1.0)))
            if amount > 1e-9:
                covered[lengths] += amount * times / need[lengths]
                solution[chosen] = solution.get(chosen, 0.0) + amount
    return solution


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Whole sequences by their lengths, each with how many there are, that hold every piece once."""
    left = counts.astype(np.int64).copy()
    bins: list[tuple[Pattern, int]] = []
    if left[capacity]:
        bins.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    solution = solve_program(left, capacity)
    for up in (False, True):
        for chosen, amount in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
            lengths, times = np.unique(chosen, return_counts=True)
            whole = 1 if up and amount % 1 else 0 if up else int(amount + 1e-6)
            whole = min(whole, int((left[lengths] // times).min()))
            if whole:
                left[lengths] -= whole * times
                bins.append((chosen, whole))
    return best_fit(bins, left, capacity)


def best_fit(
    bins: list[tuple[Pattern, int]], left: np.ndarray, capacity: int
) -> list[tuple[Pattern, int]]:
    """Place the ``left`` pieces, longest first, each where it leaves the least room."""
    room: dict[int, list[tuple[Pattern, int]]] = {}
    for chosen, n in bins:
        room.setdefault(capacity - sum(chosen), []).append((chosen, n))
    gaps = sorted(room)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                chosen, have = room[gap].pop()
                if not room[gap]:
                    del room[gap], gaps[at]
                each = min(gap // length, n)
                used = min(have, n // each)
                if have > used:
                    _add(room, gaps, gap, chosen, have - used)
            else:
                gap, chosen, each = capacity, (), min(capacity // length, n)
                used = n // each
            _add(room, gaps, gap - each * length, (*chosen, *[length] * each), used)
            n -= each * used
    return [pair for pairs in room.values() for pair in pairs]


def _add(room: dict, gaps: list[int], gap: int, chosen: Pattern, n: int) -> None:
    if gap not in room:
        room[gap] = []
        bisect.insort(gaps, gap)
    room[gap].append((chosen, n))


def places(bins: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of slots, its first sequence, and its offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for chosen, n in bins:
        offset = 0
        for length in chosen:
            rank = taken.get(length, 0)
            runs.setdefault(length, []).append((rank, base, offset))
            taken[length] = rank + n
            offset += length
        base += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}  # type: ignore[misc]


def ranked(rows: DataFrame, by: str, order: list[str], most: int, total: int) -> DataFrame:
    """``rows`` with their ``pack_rank`` (from 0) among rows of equal ``by``; a value of many rows is cut.

    ``most`` is the count of the commonest value, ``total`` that of all. Rows of a value are dealt to so many shares that
    one holds half a partition's worth at most; a share is ranked by itself and starts after the
    shares before it.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-most // max(RANKED, total // (2 * partitions)))
    dealt = rows.withColumn("pack_share", F.pmod(F.xxhash64(*order), F.lit(max(1, shares))))
    sizes = dealt.groupBy(by, "pack_share").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("pack_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "pack_share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pack_before"))
    within = F.row_number().over(Window.partitionBy(by, "pack_share").orderBy(*order)) - 1
    return (
        dealt.withColumn("pack_within", within)
        .join(starts, [by, "pack_share"])
        .withColumn("pack_rank", F.col("pack_within") + F.col("pack_before"))
        .drop("pack_share", "pack_within", "pack_before")
    )


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``rows`` (with a ``length`` from 1 to ``capacity``) with their ``sequence_id`` and ``offset``.

    Every row has its place and places do not overlap; rows equal in ``order`` may swap theirs. Read
    several times, so hand in written rows. A length outside the range is an error; no rows, no places.
    """
    ship(rows.sparkSession)
    histogram = rows.groupBy("length").count().limit(capacity + 2).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece has length {length}")
        counts[length] = n
    slots = places(pack_histogram(counts, capacity)) if histogram else {}
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("pack_rank").to_numpy()
            sequence, offset = np.zeros((2, len(length)), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                first, base, begin = slots[one]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[run] + rank[at] - first[run]
                offset[at] = begin[run]
            kept: list[Any] = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    placed = ranked(rows, "length", list(order), int(counts.max()), int(counts.sum()))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return placed.select(*names, "pack_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Cut, count and pack all documents: one row per piece with its sequence and offset there.

    Sequences have no gaps between pieces, and documents no longer than ``capacity`` are never cut.
    Nulls and empty texts are one piece of one id; repeated rows are packed as often as they occur;
    other columns are not read; an empty table gives an empty result.
    """
    rows = written(pieces(docs, tokenizer, capacity, 0, id_col, text_col, keep_ids), "pieces")
    return pack(rows, capacity, (id_col, "piece"))
