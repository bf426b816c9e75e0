"""All minimal keys of a table: sets of columns that tell every row apart and of which no part does.

The search goes level by level. Rows that agree on some columns prove that these columns, and every
part of them, are no key; such agreements are looked for first, among rows that share their values of a
candidate, for all candidates of a level in one scan. Only candidates that no agreement refutes are
counted. Whatever is found or missed there, a key is a key by its exact count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.operators.columns import ColumnInfo, column_infos
from tabulens.operators.grain import distinct_tuples

# About so many rows of a level's candidates are compared for agreements, from a share of their values.
EVIDENCE_ROWS = 2_000_000
# Different agreements taken from one level, the widest first; more could only save counts.
MOST_AGREEMENTS = 20_000
SETS_PER_JOB = 12

Columns = frozenset[int]


def agreements(df: DataFrame, infos: Sequence[ColumnInfo], sets: Sequence[Columns], rows: int, most: int) -> set[Columns]:
    """Sets of columns on which some rows agree, each holding one of ``sets``.

    Rows meet by the hash of a set's values, and only those whose hash falls into a share of all hashes,
    so a group is met whole or not at all. A column agrees in a group if its least and greatest value
    are the same or it is null throughout: a clash of hashes can only make an agreement smaller.
    """
    share = max(1, rows * len(sets) // most)
    names = [f"k{i}" for i in range(len(infos))]
    values = df.selectExpr(*[f"{c.groupable} as {n}" for c, n in zip(infos, names, strict=True)])

    def met(k: int) -> F.Column:
        hashed = F.xxhash64(F.lit(k), *[F.col(names[i]) for i in sorted(sets[k])])
        return F.when(F.pmod(hashed, F.lit(share)) == 0, F.struct(F.lit(k).alias("at"), hashed.alias("group")))

    found = F.filter(F.array(*map(met, range(len(sets)))), lambda m: m.isNotNull())
    same = [
        F.expr(f"if(count({n}) = 0 or (count({n}) = count(*) and min({n}) = max({n})), '1', '0')") for n in names
    ]
    grouped = (
        values.select(F.inline(found), *names)
        .groupBy("at", "group")
        .agg(F.count("*").alias("n"), F.concat(*same).alias("agreed"))
        .where("n > 1 and contains(agreed, '1')")
        .groupBy("agreed")
        .count()
    )
    wide = F.length(F.regexp_replace("agreed", "0", ""))
    table = grouped.orderBy(wide.desc(), "agreed").limit(MOST_AGREEMENTS).collect()
    return {frozenset(i for i, bit in enumerate(r.agreed) if bit == "1") for r in table}


def widest(sets: set[Columns]) -> list[Columns]:
    """The sets that lie in no other."""
    kept: list[Columns] = []
    for s in sorted(sets, key=len, reverse=True):
        if not any(s <= k for k in kept):
            kept.append(s)
    return kept


def wider(level: Sequence[Columns]) -> Iterator[Columns]:
    """Sets of one more column of which all parts of the level's width are in the level."""
    known = set(level)
    for s in level:
        for other in {c for k in level for c in k if c > max(s)}:
            grown = s | {other}
            if all(grown - {c} in known for c in grown):
                yield grown


def minimal_keys(
    df: DataFrame,
    dataset: str,
    pool: Sequence[str] | None = None,
    rows: int | None = None,
    most: int = EVIDENCE_ROWS,
    counted: list[Columns] | None = None,
) -> DataFrame:
    """``dataset, rank, columns, width`` of all minimal keys among the columns of ``pool`` (all if None).

    Nulls are values: two rows that are null in a column agree on it. No key is left out, however many
    columns it takes. A table with repeated rows has none, and neither has an empty one. Narrow
    keys come first, then those of earlier columns of the table. ``counted``, if given, is filled
    with the sets that had to be counted.
    """
    rows = df.count() if rows is None else rows
    infos = [c for c in column_infos(df) if pool is None or c.name in pool]
    counted = [] if counted is None else counted
    found: list[Columns] = []
    everything = frozenset(range(len(infos)))
    names = {c: info.name for c, info in enumerate(infos)}

    def counts(sets: Sequence[Columns]) -> dict[Columns, int]:
        out: dict[Columns, int] = {}
        for k in range(0, len(sets), SETS_PER_JOB):
            part = sets[k : k + SETS_PER_JOB]
            counted.extend(part)
            named = {s: tuple(names[c] for c in sorted(s)) for s in part}
            told = distinct_tuples(df, list(named.values()))
            out.update({s: told[named[s]] for s in part})
        return out

    if rows and infos and counts([everything])[everything] == rows:
        refuted: list[Columns] = []
        level = [frozenset([c]) for c in range(len(infos))]
        while level:
            open_sets = [s for s in level if not any(s <= r for r in refuted)]
            if open_sets and rows > 1:
                refuted = widest({*refuted, *agreements(df, infos, open_sets, rows, most)})
                open_sets = [s for s in open_sets if not any(s <= r for r in refuted)]
            told = counts([s for s in open_sets if s != everything]) if open_sets else {}
            keys = [s for s in open_sets if told.get(s, rows) == rows]
            found += keys
            refuted = widest({*refuted, *(s for s in open_sets if s not in keys)})
            level = list(wider([s for s in level if s not in keys]))
    ranked = sorted(found, key=lambda s: (len(s), sorted(s)))
    return df.sparkSession.createDataFrame(
        [(dataset, k + 1, [names[c] for c in sorted(s)], len(s)) for k, s in enumerate(ranked)],
        "dataset string, rank int, columns array<string>, width int",
    )
