"""Reading tables, handing texts to Arrow tasks, and cutting lineage in the shared folder."""

from __future__ import annotations

import io
import itertools
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.session import scratch_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as any Spark job's own modules."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="tabulens-")) / "tabulens.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def map_rows(
    df: DataFrame, function: Callable[[list], Iterator[tuple]], schema: str | T.StructType, take_rows: int | None = None
) -> DataFrame:
    """Apply ``function`` to the columns of each Arrow batch, as Python lists; it yields result rows.

    Rows stay in the task that reads them: no shuffle. Results leave in slices of bounded length;
    rows come in slices of at most ``take_rows``.
    """

    def each(batches: Iterator[list]) -> Iterator[tuple]:
        for columns in batches:
            yield from function(columns)

    return map_stream(df, each, schema, take_rows=take_rows)


def map_stream(
    df: DataFrame,
    function: Callable[[Iterator[list]], Iterator[tuple]],
    schema: str | T.StructType,
    slice_rows: int = 1024,
    take_rows: int | None = None,
) -> DataFrame:
    """Like ``map_rows``, but ``function`` sees all batches of a partition one after the other."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        rows = function([column.to_pylist() for column in part.columns] for part in _parts(batches, take_rows))
        while held := list(itertools.islice(rows, slice_rows)):
            yield _batch(held, arrow)

    return df.mapInArrow(run, kind)


def _parts(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has over ``rows``."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows) if rows else [0]:
            yield batch.slice(begin, rows) if rows else batch


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )


def one_text_each(rows: DataFrame) -> DataFrame:
    """``id, label, text`` with one text for each id and label, that of least hash, however often it comes."""
    return rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, any executor may be lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
