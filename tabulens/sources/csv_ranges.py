"""CSV files with quoted line breaks, read by many tasks a file.

A byte range cannot tell by itself whether it begins inside a quoted value. So each range is read once for
its map: for each of the four states it may begin in, the state it ends in and where its first record then
ends. A prefix scan over the ranges of a file composes the maps, which gives every range its true first
state and so a safe cut; the spans between cuts are read by as many tasks, and Spark's own parser turns
each record into columns.

States: at the start of a value, inside a plain value, inside quotes, at a quote that may close them.
A quote opens only at the start of a value; doubled quotes stand for one; line breaks are LF or CR LF.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# Bytes of a range. A task holds one range and the rest of its last record.
RANGE_BYTES = 32 << 20
# Ranges whose maps are composed together; a file has a row for each so many.
BLOCK = 1024
START, PLAIN, QUOTED, CLOSING = range(4)

# The functions of this module travel with the job; workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str):
    """A file of Spark's listing, opened for reading at any place."""
    from urllib.parse import unquote, urlsplit

    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def outside(data: bytes, state: int, sep: str):
    """Ends of the records in ``data`` (places after a line break outside quotes), and the last state."""
    import re

    import numpy as np

    mark = re.escape(sep.encode())
    closes = rb'[^"]*+(?:""[^"]*+)*+'
    value = re.compile(rb'(?<=[\n' + mark + rb'])"' + closes + rb'("?)')
    spans, at, last = [], 0, state
    if state == CLOSING and data[:1] == b'"':
        state, at = QUOTED, 1
    elif state == START and data[:1] == b'"':
        state, at = QUOTED, 1
    if state == QUOTED:
        first = re.compile(closes + rb'("?)').match(data, at)
        spans.append((0, first.end(), bool(first.group(1))))
        at = first.end()
    spans += [(m.start(), m.end(), bool(m.group(1))) for m in value.finditer(data, at)]
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    if spans:
        begins = np.array([s[0] for s in spans])
        ends = np.array([s[1] for s in spans])
        span = np.searchsorted(begins, breaks, "right") - 1
        breaks = breaks[(span < 0) | (breaks >= ends[span])]
    if spans and spans[-1][1] == len(data):
        last = CLOSING if spans[-1][2] else QUOTED
    elif data:
        last = START if data[-1:] in (b"\n", sep.encode()) else PLAIN
    return breaks + 1, last


def csv_records(
    spark: SparkSession, path: str | list[str], sep: str = ",", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """One row per record under the header: ``value``, the record as it is written. Empty lines are none."""
    if len(sep.encode()) != 1 or sep in '"\r\n':
        raise ValueError("the separator must be one byte, no quote and no line break")

    def maps(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    file.seek(row["start"])
                    data = file.read(row["stop"] - row["start"])
                found = [outside(data, state, sep) for state in range(4)]
                yield pa.RecordBatch.from_pylist([{
                    **row,
                    "ends": [int(last) for _, last in found],
                    "cuts": [row["start"] + int(e[0]) if len(e) else None for e, _ in found],
                }], schema=map_schema)

    def records(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    file.seek(row["cut"])
                    data = file.read(row["next_cut"] - row["cut"])
                ends, _ = outside(data, START, sep)
                begin = 0
                ends = ends.tolist() + ([len(data)] if not len(ends) or ends[-1] < len(data) else [])
                values = []
                for place, end in enumerate(ends):
                    value = data[begin:end].removesuffix(b"\n").removesuffix(b"\r")
                    begin = end
                    if value and not (row["cut"] == 0 and place == 0):
                        values.append(value.decode("utf-8", "replace"))
                    if len(values) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
                        values = []
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    map_schema = pa.schema([
        ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("length", pa.int64()),
        ("ends", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int64())),
    ])
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", "length", starts.alias("start")).select(
        "path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"), "length"
    )
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mapped = ranges.repartition(tasks, "path", "start").mapInArrow(
        maps, "path string, start bigint, stop bigint, length bigint, ends array<int>, cuts array<bigint>"
    )
    # Maps are composed over blocks of ranges first, then over the blocks of a file, then inside each block.
    blocks = mapped.groupBy("path", "length", F.floor(F.col("start") / (range_bytes * BLOCK)).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("start", "ends", "cuts"))).alias("ranges")
    )
    whole = F.aggregate(
        "ranges",
        F.array(*[F.lit(s) for s in range(4)]),
        lambda m, r: F.transform(m, lambda s: F.element_at(r["ends"], s + 1)),
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.aggregate(
        F.collect_list("whole").over(before), F.lit(START), lambda s, ends: F.element_at(ends, s + 1)
    )
    states = F.aggregate(
        "ranges",
        F.array("first"),
        lambda known, r: F.concat(known, F.array(F.element_at(r["ends"], F.element_at(known, -1) + 1))),
    )
    stated = (
        blocks.withColumn("whole", whole)
        .withColumn("first", first)
        .withColumn("states", states)
        .select("path", "length", F.explode(F.arrays_zip("ranges", "states")).alias("r"))
        .where("r.ranges is not null")
    )
    cut = F.when(F.col("r.ranges.start") == 0, F.lit(0).cast("bigint")).otherwise(
        F.element_at("r.ranges.cuts", F.col("r.states") + 1)
    )
    cuts = stated.select("path", "length", cut.alias("cut")).where("cut < length")
    after = F.lead("cut").over(Window.partitionBy("path").orderBy("cut"))
    spans = cuts.withColumn("next_cut", F.coalesce(after, "length")).select("path", "cut", "next_cut")
    return spans.repartition(tasks, "path", "cut").mapInArrow(records, "value string")


def scan_csv_ranges(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    sep: str = ",",
    sampling_ratio: float = 1.0,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """As ``readers.scan_csv``, with each file cut into ranges that end between records.

    Files are UTF-8, not compressed, with a header line each. A range that no record ends in goes with the
    one before it. Without a schema the types come from one more pass over all records.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    records = csv_records(spark, path, sep, range_bytes)
    if schema is None:
        names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns
        lines = records.rdd.map(lambda row: row.value)
        typed = spark.read.options(
            inferSchema=True, preferDate=True, samplingRatio=sampling_ratio, **options
        ).csv(lines).schema
        kinds = [f.dataType.simpleString() for f in typed] + ["string"] * (len(names) - len(typed))
        fields = list(zip(names, kinds))
    else:
        wanted = spark.createDataFrame([], schema).schema
        fields = [(f.name, f.dataType.simpleString()) for f in wanted]
    ddl = ", ".join("`" + n.replace("`", "``") + "` " + kind for n, kind in fields)
    return records.select(F.from_csv("value", ddl, options).alias("row")).select("row.*")
