"""Column metrics: nulls, distinct values, ranges, moments, quartiles and top values.

Every operator covers all columns of a table in one job and returns one row per column (or per column
and value). Three passes give the full set: one aggregate without a shuffle of rows, one long
group-by of (column, value), and the quartiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.names import BOOLEAN_TOKENS, quoted, text_literal
from tabulens.functions.quantiles import DIRECT_LIMIT, exact_percentiles
from tabulens.session import small_frame, together

# One aggregate holds at most this many columns, to stay inside one generated method.
COLUMNS_PER_AGGREGATE = 150
# How many top values a column shows.
TOP_VALUES = 8
# Longer texts travel as this many first characters and a digest of the whole text.
LONG_TEXT = 128
TEXT_KEY_LENGTH = LONG_TEXT + 1 + 32
DIGITS_ONLY, DIGIT_MARK = "^[0-9]+$", "#"

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TEMPORALS = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class ColumnInfo:
    """Position, name and type class of a column."""

    ordinal: int
    name: str
    dtype: T.DataType

    @property
    def kind(self) -> str:
        if isinstance(self.dtype, INTEGERS):
            return "integer"
        if isinstance(self.dtype, FLOATS):
            return "float"
        if isinstance(self.dtype, T.DecimalType):
            return "decimal"
        if isinstance(self.dtype, T.BooleanType):
            return "boolean"
        if isinstance(self.dtype, TEMPORALS):
            return "temporal"
        if isinstance(self.dtype, T.StringType):
            return "string"
        return "other"

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "float", "decimal")

    @property
    def sql(self) -> str:
        """The column as SQL text. Wide tables need hundreds of expressions; text builds them fast."""
        return quoted(self.name)

    @property
    def double(self) -> str:
        return f"cast({self.sql} as double)"

    @property
    def carrier(self) -> str:
        """The type its values travel in during the long group-by."""
        return {
            "integer": "bigint",
            "float": "double",
            "boolean": "boolean",
            "string": "string",
            "temporal": self.dtype.simpleString(),
        }.get(self.kind, "string")

    @property
    def carried(self) -> str:
        if self.kind != "other":
            return f"cast({self.sql} as {self.carrier})"
        if isinstance(self.dtype, T.BinaryType):
            return f"hex({self.sql})"
        return f"to_json({self.groupable})" if _jsonable(self.dtype) else f"string({self.sql})"

    @property
    def text_key(self) -> str:
        return text_key(self.carried) if self.carrier == "string" else self.carried

    @property
    def groupable(self) -> str:
        """A form that can be grouped and hashed: maps as sorted entries, zeros of one sign."""
        return canonical(self.sql, self.dtype)


def canonical(sql: str, dtype: T.DataType, depth: int = 0) -> str:
    """An expression that groups and hashes as equal values should, at any depth of nesting."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"({sql} + cast(0 as {dtype.simpleString()}))"
    if not _holds_map(dtype):
        return sql
    if isinstance(dtype, T.MapType):
        entry = T.StructType().add("key", dtype.keyType).add("value", dtype.valueType)
        inner = canonical(f"e{depth}", entry, depth + 1)
        return f"array_sort(transform(map_entries({sql}), e{depth} -> {inner}))"
    if isinstance(dtype, T.ArrayType):
        return f"transform({sql}, e{depth} -> {canonical(f'e{depth}', dtype.elementType, depth + 1)})"
    parts = ", ".join(
        f"'f{i}', {canonical(f'{sql}.{quoted(f.name)}', f.dataType, depth)}"
        for i, f in enumerate(dtype.fields)
    )
    return f"if({sql} is null, null, named_struct({parts}))"


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def text_key(text: str) -> str:
    """A text itself, or for a long one its first characters and the digest of all of it.

    Short enough to shuffle, equal only for equal texts, and in text order up to its first part. The
    sign between the two says whether the whole text is digits.
    """
    return (
        f"if(length({text}) <= {LONG_TEXT}, {text}, "
        f"concat(left({text}, {LONG_TEXT}), if(trim({text}) rlike '{DIGITS_ONLY}', '{DIGIT_MARK}', '~'), "
        f"md5({text})))"
    )


def _jsonable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def column_infos(df: DataFrame, columns: Sequence[str] | None = None) -> list[ColumnInfo]:
    """The columns of a frame with their 0-based ordinals; a subset keeps the table's ordinals."""
    infos = [ColumnInfo(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    return [c for c in infos if columns is None or c.name in columns]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_column_aggregate(
    df: DataFrame,
    infos: Sequence[ColumnInfo],
    fields: Callable[[ColumnInfo], dict[str, str]],
    types: dict[str, str],
) -> DataFrame:
    """Aggregate all columns in one scan, then turn the single wide row into one row per column.

    ``fields`` gives the aggregates of a column as SQL; ``types`` names every field of the result. A
    column without an aggregate for a field has null there.
    """
    parts = []
    for start in range(0, len(infos), COLUMNS_PER_AGGREGATE):
        chunk = infos[start : start + COLUMNS_PER_AGGREGATE]
        exprs = {c.ordinal: fields(c) for c in chunk}
        wide = df.agg(
            F.count("*").alias("row_count"),
            *[F.expr(e).alias(f"{o}_{n}") for o, named in exprs.items() for n, e in named.items()],
        )

        def row(c: ColumnInfo, exprs: dict = exprs) -> str:
            own = exprs[c.ordinal]
            values = [
                f"'{n}', cast({f'`{c.ordinal}_{n}`' if n in own else 'null'} as {t})"
                for n, t in types.items()
            ]
            fixed = (
                f"'ordinal', {c.ordinal}, 'column_name', {text_literal(c.name)}, "
                f"'physical_type', {text_literal(c.dtype.simpleString())}, 'kind', '{c.kind}'"
            )
            return f"named_struct({', '.join([fixed, *values])})"

        rows = f"inline(array({', '.join(row(c) for c in chunk)}))"
        parts.append(wide.selectExpr("row_count", rows))
    return union_all(parts)


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded percentage; null over an empty whole."""
    return F.round(part / F.nullif(whole, F.lit(0).cast("bigint")) * 100, digits)


def finite_sql(number: str) -> str:
    """The number, or null for NaN and the infinities."""
    return f"if(abs({number}) < double('Infinity'), {number}, null)"


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls and null share of each column, in one aggregate over one scan."""
    infos = column_infos(df, columns)
    counted = per_column_aggregate(
        df, infos, lambda c: {"non_null_count": f"count({c.sql})"}, {"non_null_count": "bigint"}
    )
    nulls = F.col("row_count") - F.col("non_null_count")
    return counted.select(
        "ordinal",
        "column_name",
        "row_count",
        nulls.alias("null_count"),
        "non_null_count",
        F.coalesce(pct(nulls, F.col("row_count")), F.lit(0.0)).alias("null_pct"),
    )


def missing_cell_pct(df: DataFrame) -> DataFrame:
    """Share of null cells in the whole table."""
    cells = F.count("*") * len(df.columns)
    filled = F.expr(" + ".join(["0L", *[f"count({c.sql})" for c in column_infos(df)]]))
    return df.agg(
        (cells - filled).alias("null_cells"),
        cells.alias("total_cells"),
        pct(cells - filled, cells).alias("missing_cell_pct"),
    )


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts, range, mean and sample deviation of each column, one scan, no shuffle of rows.

    Ranges come typed (``min_num``, ``min_time``) and as text (``min_value``). A mean or deviation
    that is not finite is null; so is the deviation of a single row.
    """

    def fields(c: ColumnInfo) -> dict[str, str]:
        return {"non_null_count": f"count({c.sql})", **_moments(c), **_range(c)}

    types = {"non_null_count": "bigint", "mean": "double", "std": "double", **RANGE_TYPES}
    stats = per_column_aggregate(df, column_infos(df, columns), fields, types)
    nulls = F.col("row_count") - F.col("non_null_count")
    return stats.withColumn("null_count", nulls).withColumn(
        "null_pct", F.coalesce(pct(nulls, F.col("row_count")), F.lit(0.0))
    )


RANGE_TYPES = {
    "min_num": "double", "max_num": "double", "min_time": "timestamp_ntz",
    "max_time": "timestamp_ntz", "min_value": "string", "max_value": "string",
}


def _moments(c: ColumnInfo) -> dict[str, str]:
    if not c.numeric:
        return {}
    return {
        "mean": finite_sql(f"avg({c.double})"),
        "std": finite_sql(f"stddev_samp({c.double})"),
    }


def _range(c: ColumnInfo) -> dict[str, str]:
    """Lowest and highest value of a numeric or temporal column, typed and as text."""
    kind = "num" if c.numeric else "time"
    if not c.numeric and c.kind != "temporal":
        return {}
    low, high = f"min({c.sql})", f"max({c.sql})"
    return {f"min_{kind}": low, f"max_{kind}": high, "min_value": low, "max_value": high}


def min_max(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lowest and highest value of each numeric and temporal column.

    An aggregate of minima and maxima alone, so that the v2 Parquet reader with aggregate pushdown
    can answer it from the file statistics.
    """
    infos = [c for c in column_infos(df, columns) if c.numeric or c.kind == "temporal"]

    ranges = per_column_aggregate(df, infos, _range, RANGE_TYPES)
    return ranges.drop("row_count", "kind", "physical_type")


def long_form(df: DataFrame, infos: Sequence[ColumnInfo], values: Sequence[str]) -> DataFrame:
    """Rows of (ordinal as short text, value) for columns of one type, by Spark's unpivot."""
    names = [str(c.ordinal) for c in infos]
    picked = df.selectExpr(*[f"{v} as `{n}`" for v, n in zip(values, names, strict=True)])
    return picked.unpivot([], names, "o", "v")


def value_counts(
    df: DataFrame, columns: Sequence[str] | None = None, whole_texts: bool = False
) -> DataFrame:
    """(ordinal, value as text, n) for every distinct value of every column; null is a value.

    Columns of one type share one group-by, which reads only those columns and ships their native
    values; long texts are shipped as ``text_key`` unless ``whole_texts``. Counts are added up before
    the shuffle, so a hot value is one row per task. Text is made from distinct values only.
    """
    infos = column_infos(df, columns)
    families: dict[str, list[ColumnInfo]] = {}
    for c in infos:
        families.setdefault(c.carrier, []).append(c)
    parts = []
    for members in families.values():
        values = [c.carried if whole_texts else c.text_key for c in members]
        counted = long_form(df, members, values).groupBy("o", "v").count()
        parts.append(
            counted.select(
                F.col("o").cast("int").alias("ordinal"),
                F.col("v").cast("string").alias("value"),
                F.col("count").alias("n"),
            )
        )
    return union_all(parts)


def _value_summary(counts: DataFrame) -> DataFrame:
    value = F.col("value")
    token = F.lower(F.trim(value))
    known = token.isin(BOOLEAN_TOKENS)
    long = F.length(value) == TEXT_KEY_LENGTH
    marked = F.substr(value, F.lit(LONG_TEXT + 1), F.lit(1)) == DIGIT_MARK
    digits = F.when(long, marked).otherwise(F.trim(value).rlike(DIGITS_ONLY))
    return counts.groupBy("ordinal").agg(
        F.count("*").alias("unique_count"),
        F.sum("n").alias("counted_rows"),
        # For text columns: all values boolean words, how many such words, rows of digits only.
        F.coalesce(F.bool_and(known | value.isNull()), F.lit(True)).alias("boolean_words_only"),
        F.size(F.collect_set(F.when(known, token))).alias("boolean_words"),
        F.sum(F.when(digits, F.col("n")).otherwise(0)).alias("digit_rows"),
    )


def _ranked_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column. Spark cuts each task to k rows before the shuffle."""
    order = W.partitionBy("ordinal").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole_texts(df: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Ranked values with long texts in full. ``ranked`` holds ``k + 1`` per column, so that a tie of
    two long texts with one beginning shows at the cut.

    Most tables need no more than a look at the few rows. Otherwise the chosen texts are looked up by
    their key, and a column with such a tie is ranked again on whole texts.
    """
    chosen: dict[int, list] = {}
    for r in ranked.orderBy("ordinal", "rank").collect():
        chosen.setdefault(r.ordinal, []).append(r)
    infos = {c.ordinal: c for c in column_infos(df) if c.carrier == "string"}

    def is_key(r) -> bool:
        return r.value is not None and len(r.value) == TEXT_KEY_LENGTH

    long = [o for o, rows in chosen.items() if o in infos and any(is_key(r) for r in rows)]
    if not long:
        return ranked.where(F.col("rank") <= k)
    tied = []
    for o in long:
        last, after = (chosen[o][k - 1 : k + 1] + [None, None])[:2]
        if after is not None and is_key(last) and is_key(after):
            if (last.n, last.value[:LONG_TEXT]) == (after.n, after.value[:LONG_TEXT]):
                tied.append(o)
    result = ranked.where(~F.col("ordinal").isin(tied)) if tied else ranked
    lookup = [infos[o] for o in long if o not in tied]
    if lookup:
        keys = F.broadcast(result.select("ordinal", F.col("value").alias("key")).where(
            F.length("key") == TEXT_KEY_LENGTH))
        texts = (
            long_form(df, lookup, [c.carried for c in lookup])
            .where(F.length("v") > LONG_TEXT)
            .select(F.col("o").cast("int").alias("ordinal"), "v", F.expr(text_key("v")).alias("key"))
            .join(keys, ["ordinal", "key"])
            .groupBy("ordinal", "key")
            .agg(F.first("v").alias("text"))
        )
        result = result.join(
            texts.withColumnRenamed("key", "value"), ["ordinal", "value"], "left"
        ).select("ordinal", F.coalesce("text", "value").alias("value"), "n")
    result = result.select("ordinal", "value", "n")
    if tied:
        names = [infos[o].name for o in tied]
        again = _ranked_values(value_counts(df, names, whole_texts=True), k)
        result = result.unionByName(again.select("ordinal", "value", "n"))
    return _ranked_values(small_frame(result), k)


def value_profile(
    df: DataFrame, k: int = TOP_VALUES, columns: Sequence[str] | None = None
) -> DataFrame:
    """Distinct counts and top values of each column from one long group-by, as a small frame.

    Both branches share the same shuffle of (column, value) counts, which Spark runs once.
    """
    counts = value_counts(df, columns)
    ranked = _ranked_values(counts, k + 1).groupBy("ordinal").agg(
        F.collect_list(F.struct("rank", "value", "n")).alias("_top")
    )
    found = small_frame(_value_summary(counts).join(ranked, "ordinal"))
    top = _whole_texts(df, found.select("ordinal", F.inline("_top")), k)
    listed = top.groupBy("ordinal").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values")
    )
    return found.drop("_top").join(listed, "ordinal")


def _named(df: DataFrame, per_ordinal: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    pairs = ", ".join(f"{c.ordinal}, {text_literal(c.name)}" for c in column_infos(df, columns))
    rest = [n for n in per_ordinal.columns if n != "ordinal"]
    return per_ordinal.selectExpr(
        "ordinal", f"element_at(map({pairs}), ordinal) as column_name", *rest
    )


def unique_count(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Distinct values of each column, with null as one more value, and their share of the rows.

    ``approximate`` swaps the shuffle of all values for one sketch per column.
    """
    if approximate:
        sketched = per_column_aggregate(
            df,
            column_infos(df, columns),
            lambda c: {
                "unique_count": f"approx_count_distinct({c.carried}, 0.01)"
                f" + max(int({c.sql} is null))"
            },
            {"unique_count": "bigint"},
        )
        return sketched.select(
            "ordinal", "column_name", "unique_count",
            pct(F.col("unique_count"), F.col("row_count")).alias("unique_pct"),
        )
    counts = value_counts(df, columns)
    summary = counts.groupBy("ordinal").agg(
        F.count("*").alias("unique_count"), F.sum("n").alias("rows")
    )
    return _named(df, summary, columns).select(
        "ordinal", "column_name", "unique_count",
        pct(F.col("unique_count"), F.col("rows")).alias("unique_pct"),
    )


def top_values(
    df: DataFrame, k: int = TOP_VALUES, columns: Sequence[str] | None = None
) -> DataFrame:
    """The k most frequent values of each column: count first, then text, null last."""
    ranked = small_frame(_ranked_values(value_counts(df, columns), k + 1))
    return _named(df, _whole_texts(df, ranked, k), columns).select(
        "ordinal", "column_name", "rank", "value", F.col("n").alias("value_count")
    )


def top_value(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most frequent value of each non-numeric column and its share of the rows."""
    wanted = [c.name for c in column_infos(df, columns) if not c.numeric]
    counts = value_counts(df, wanted)
    rows = counts.groupBy("ordinal").agg(F.sum("n").alias("rows"))
    ranked = small_frame(_ranked_values(counts, 2).join(rows, "ordinal"))
    first = _whole_texts(df, ranked.drop("rows"), 1).join(
        ranked.select("ordinal", "rows").distinct(), "ordinal"
    )
    return _named(df, first, wanted).select(
        "ordinal",
        "column_name",
        F.coalesce("value", F.lit("(null)")).alias("top_value"),
        F.col("n").alias("top_count"),
        pct(F.col("n"), F.col("rows")).alias("top_pct"),
    )


def quartiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    direct_limit: int = DIRECT_LIMIT,
    rows_at_most: int | None = None,
) -> DataFrame:
    """Linear p25, median and p75 of each numeric column, exact at any size."""
    infos = [c for c in column_infos(df, columns) if c.numeric]
    if rows_at_most is None:
        rows_at_most = df.count()  # no column has more values; Parquet answers from its footers
    long = long_form(df, infos, [c.double for c in infos])
    found = exact_percentiles(
        long, ["o"], "v", [0.25, 0.5, 0.75], ["p25", "median", "p75"], direct_limit, rows_at_most
    )
    return found.select(
        F.col("o").cast("int").alias("ordinal"),
        *[F.expr(finite_sql(n)).alias(n) for n in ("p25", "median", "p75")],
    )


def numeric_describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    direct_limit: int = DIRECT_LIMIT,
    rows_at_most: int | None = None,
) -> DataFrame:
    """Mean, sample deviation and quartiles of each numeric column."""
    infos = [c for c in column_infos(df, columns) if c.numeric]
    names = [c.name for c in infos]
    moments = per_column_aggregate(df, infos, _moments, {"mean": "double", "std": "double"})
    moments = moments.select("ordinal", "column_name", "mean", "std")
    return moments.join(quartiles(df, names, direct_limit, rows_at_most), "ordinal")


def datetime_median(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    direct_limit: int = DIRECT_LIMIT,
    rows_at_most: int | None = None,
) -> DataFrame:
    """Median instant of each temporal column, midway between the two middle rows if need be."""
    infos = [c for c in column_infos(df, columns) if c.kind == "temporal"]
    if rows_at_most is None:
        rows_at_most = df.count()
    # Zone-free times pass through the session zone both ways; the session is pinned to UTC.
    micros = [f"double(unix_micros(cast({c.sql} as timestamp)))" for c in infos]
    found = exact_percentiles(
        long_form(df, infos, micros), ["o"], "v", [0.5], ["m"], direct_limit, rows_at_most
    )
    moment = F.timestamp_micros(F.floor("m").cast("bigint")).cast("timestamp_ntz")
    return _named(
        df, found.select(F.col("o").cast("int").alias("ordinal"), moment.alias("median_time")), columns
    )


def column_facts(df: DataFrame, dataset: str, top_k: int = TOP_VALUES) -> DataFrame:
    """Metrics the structure and quality rules need: counts, ranges, moments, distinct and top values.

    Two jobs whatever the number of columns, held as a small frame of one row per column.
    """
    stats, values = together(
        df.sparkSession,
        lambda: small_frame(column_stats(df)),
        lambda: value_profile(df, top_k),
    )
    first = F.get("top_values", F.lit(0))
    numeric = F.col("kind").isin("integer", "float", "decimal")
    return small_frame(
        stats.join(values, "ordinal", "left")
        .withColumn("dataset", F.lit(dataset))
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))
        .withColumn("unique_pct", pct(F.col("unique_count"), F.col("row_count")))
        .withColumn(
            "top_value",
            F.when(first.isNotNull() & ~numeric, F.coalesce(first["value"], F.lit("(null)"))),
        )
        .withColumn("top_count", F.when(F.col("top_value").isNotNull(), first["n"]))
        .withColumn("top_pct", pct(F.col("top_count"), F.col("row_count")))
        .withColumn("metric_scope", F.lit("full"))
    )


def column_metrics(
    df: DataFrame,
    dataset: str,
    top_k: int = TOP_VALUES,
    direct_limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """All metrics of all columns, one row per column, held as a small frame.

    The passes do not depend on each other, so they are submitted together.
    """
    rows = df.count()
    infos = column_infos(df)
    none = F.lit(None).cast("double")
    numeric = [c.name for c in infos if c.numeric]
    temporal = [c.name for c in infos if c.kind == "temporal"]
    jobs = [lambda: column_facts(df, dataset, top_k)]
    if numeric:
        jobs.append(lambda: small_frame(quartiles(df, numeric, direct_limit, rows)))
    if temporal:
        jobs.append(lambda: small_frame(datetime_median(df, temporal, direct_limit, rows)))
    frame, *extras = together(df.sparkSession, *jobs)
    for extra in extras:
        frame = frame.join(extra.drop("column_name"), "ordinal", "left")
    if not numeric:
        frame = frame.withColumns({"p25": none, "median": none, "p75": none})
    if not temporal:
        frame = frame.withColumn("median_time", F.lit(None).cast("timestamp_ntz"))
    return small_frame(frame)
