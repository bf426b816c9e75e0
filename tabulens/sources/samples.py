"""Pages, samples and lookups of one view."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.names import col

# Page and sample sizes.
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 500
SAMPLE_ROWS = 50
COLUMN_SAMPLE_ROWS = 100


def sample_page(
    df: DataFrame, order_by: Sequence[str], page: int = 1, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """One page in the total order of ``order_by`` (a key, so pages neither overlap nor drift).

    Spark runs it as a top-k of ``page * page_size`` rows per task, not as a full sort.
    """
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be 1 to {MAX_PAGE_SIZE}")
    keys = [col(name).asc_nulls_last() for name in order_by]
    return df.orderBy(*keys).offset((page - 1) * page_size).limit(page_size)


def page_after(
    df: DataFrame, key: str, last_seen: Any, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The page after a key value: a pushed filter in place of an ever larger offset."""
    later = df if last_seen is None else df.where(col(key) > F.lit(last_seen))
    return sample_page(later, [key], 1, page_size)


def select_sample(
    df: DataFrame, limit: int = SAMPLE_ROWS, order_by: Sequence[str] | None = None
) -> DataFrame:
    """The first rows, of the given order if any."""
    return _ordered(df, order_by).limit(limit)


def select_column(
    df: DataFrame, column: str, limit: int = COLUMN_SAMPLE_ROWS, order_by: Sequence[str] | None = None
) -> DataFrame:
    return _ordered(df, order_by).limit(limit).select(col(column))


def lookup_by_value(
    df: DataFrame,
    column: str,
    value: Any,
    limit: int = SAMPLE_ROWS,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Rows where a column equals a value; the filter reaches the scan."""
    match = col(column).isNull() if value is None else col(column) == F.lit(value)
    return _ordered(df.where(match), order_by).limit(limit)


def _ordered(df: DataFrame, order_by: Sequence[str] | None) -> DataFrame:
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]) if order_by else df
