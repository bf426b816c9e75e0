"""Time slices of about equal row counts, to spread one hot key over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At least so many slices, and more where one would hold over ROWS_PER_SLICE rows.
SLICES, ROWS_PER_SLICE = 64, 4_000_000


def slice_bounds(df: DataFrame, time: str, slices: int = SLICES) -> list[int]:
    """Inner boundaries, in microseconds, that cut the rows into slices of about equal size.

    From a bounded sketch of the whole column, so slices follow the data and not the calendar.
    """
    marks = [i / slices for i in range(1, slices)]
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    found = df.agg(F.percentile_approx(micros, marks, 10 * slices).alias("b")).first().b
    return sorted(set(found or []))


def slice_of(time: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or before a time, as a balanced tree of comparisons."""
    micros = F.unix_micros(time.cast("timestamp"))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(micros < F.lit(bounds[middle]), tree(low, middle)).otherwise(
            tree(middle + 1, high)
        )

    return tree(0, len(bounds))
