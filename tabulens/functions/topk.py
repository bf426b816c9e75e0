"""The first rows of an order, without sending every task's candidates to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.names import col

# A bound is sought that keeps this many times the wanted rows, so that one too low is rare.
SLACK = 4
# Types whose quantiles Spark can sketch.
SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``orderBy(order).limit(n)``, ascending with nulls last, for an ``n`` of thousands.

    A plain top-k merges ``n`` rows of every task in one task. Here a sketch of the leading column
    gives a bound below which about ``SLACK * n`` rows lie; where a count proves that these are
    enough, the bound is a filter that reaches the scan, and only what passes it is ordered.
    """
    plain = df.orderBy(*[col(c).asc_nulls_last() for c in order]).limit(n)
    lead = order[0]
    if not isinstance(df.schema[lead].dataType, SKETCHED):
        return plain
    filled = df.where(col(lead).isNotNull())
    total = filled.count()
    if total < n:
        return plain
    share = min(1.0, SLACK * n / total)
    bound = filled.agg(F.percentile_approx(col(lead), F.lit(share), F.lit(int(100 / share) + 1))).first()[0]
    kept = df.where(col(lead) <= F.lit(bound))
    if kept.count() < n:
        return plain
    return kept.orderBy(*[col(c).asc_nulls_last() for c in order]).limit(n)
