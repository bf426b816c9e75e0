"""Registered datasets: view naming, folders, counts and the dataset list."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from itertools import chain, count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.sources.readers import FORMATS, file_stats, scan

MAX_VIEW_NAME = 120

DATASET_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("view_name", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("row_count", T.LongType(), True),
        T.StructField("column_count", T.IntegerType(), True),
        T.StructField("file_size", T.LongType(), True),
    ]
)


@lru_cache(maxsize=8)
def _keywords(spark: SparkSession) -> frozenset[str]:
    return frozenset(r[0].lower() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect())


def view_slug(stem: str, dataset: str, reserved: frozenset[str] = frozenset()) -> str:
    """A file stem as a view name: word characters only, bounded, never a ``reserved`` word."""
    slug = re.sub(r"[\W_]+", "_", stem, flags=re.ASCII).strip("_")[:MAX_VIEW_NAME].rstrip("_")
    if not slug:
        return f"dataset_{dataset}"
    return f"{slug}_view" if slug.lower() in reserved else slug


def view_names(wanted: Iterable[tuple[str, str]], taken: Iterable[str]) -> list[str]:
    """A view name for each (slug, dataset) of a listing, all different and none of those taken.

    Each slug has its claims in order: the slug, the slug with the dataset's id, then that with 2, 3
    and so on. The listing is served as a whole: every claim goes to the first dataset that makes it.
    """
    held, out = set(taken), []
    for slug, dataset in wanted:
        claims = chain([slug, f"{slug}_{dataset}"], (f"{slug}_{dataset}_{n}" for n in count(2)))
        out.append(next(name for name in claims if name not in held))
        held.add(out[-1])
    return out


@dataclass(frozen=True)
class Dataset:
    dataset: str
    view_name: str
    path: str
    file_name: str
    format: str
    file_size: int | None
    row_count: int | None = None
    column_count: int | None = None


@dataclass
class Catalog:
    """The registered views of one session."""

    spark: SparkSession
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def view_names(self) -> set[str]:
        return {d.view_name for d in self.datasets.values()}

    def register_frame(self, df: DataFrame, name: str, file_format: str = "parquet") -> Dataset:
        """Register any DataFrame under a view named after ``name``."""
        return self._add(df, name, name, file_format, None)

    def register_view(
        self, path: str, file_size: int | None = None, compute_counts: bool = True
    ) -> Dataset:
        """Register one file or folder; the extension decides the reader."""
        file_name = path.rstrip("/").rsplit("/", 1)[-1]
        stem, dot, extension = file_name.rpartition(".")
        extension = f"{dot}{extension}".lower()
        if extension not in FORMATS:
            raise ValueError(f"unsupported file type: {extension or file_name}")
        df = scan(self.spark, path, extension)
        entry = self._add(df, stem, path, FORMATS[extension], file_size)
        return self.refresh_counts(entry.dataset) if compute_counts else entry

    def register_folder(self, folder: str, recursive: bool = False) -> list[Dataset]:
        """Every supported file in path order; other files are skipped. Counts are left for later.

        A folder named like a file (``orders.parquet/`` with its parts) is one dataset. The listing
        is a table of paths and sizes, added up per dataset before anything reaches the driver.
        """
        root = folder.rstrip("/")
        suffixes = "|".join(e.lstrip(".") for e in FORMATS)
        inner = F.substring_index("file_path", f"{root}/", -1)
        unit = F.regexp_extract(inner, rf"(?i)^((?:[^/]+/)*?[^/]+\.(?:{suffixes}))(?:/|$)", 1)
        found = file_stats(self.spark, root, recursive=True).withColumn("unit", unit)
        found = found.where(F.col("unit") != "")
        if not recursive:
            found = found.where(~F.contains("unit", F.lit("/")))
        sizes = found.groupBy("unit").agg(F.sum("file_size").alias("size")).orderBy("unit")
        return [
            self.register_view(f"{root}/{row.unit}", row.size, compute_counts=False)
            for row in sizes.toLocalIterator()
        ]

    def refresh_counts(self, dataset: str) -> Dataset:
        entry = self.datasets[dataset]
        df = self.spark.table(entry.view_name)
        rows, columns = df.count(), len(df.columns)
        counted = Dataset(**{**entry.__dict__, "row_count": rows, "column_count": columns})
        self.datasets[dataset] = counted
        return counted

    def refresh_all_counts(self) -> None:
        """Row and column counts of every dataset, the rows in one job."""
        tables = {d: self.spark.table(entry.view_name) for d, entry in self.datasets.items()}
        if not tables:
            return
        counted = [df.agg(F.count("*").alias("n")).select(F.lit(d).alias("d"), "n") for d, df in tables.items()]
        for dataset, rows in reduce(DataFrame.unionAll, counted).toLocalIterator():
            self.datasets[dataset] = replace(
                self.datasets[dataset], row_count=rows, column_count=len(tables[dataset].columns)
            )

    def frame(self) -> DataFrame:
        """The catalog as a table, one row per dataset."""
        rows = [
            (d.dataset, d.view_name, d.file_name, d.format, d.row_count, d.column_count, d.file_size)
            for d in self.datasets.values()
        ]
        return self.spark.createDataFrame(rows, DATASET_SCHEMA)

    def _add(
        self, df: DataFrame, stem: str, path: str, file_format: str, file_size: int | None
    ) -> Dataset:
        dataset = f"ds_{len(self.datasets) + 1:03d}"
        slug = view_slug(stem, dataset, _keywords(self.spark))
        view = view_names([(slug, dataset)], self.view_names())[0]
        df.createOrReplaceTempView(view)
        file_name = path.rstrip("/").rsplit("/", 1)[-1]
        entry = Dataset(dataset, view, path, file_name, file_format, file_size)
        self.datasets[dataset] = entry
        return entry


def list_datasets(catalog: DataFrame, latest_profiles: DataFrame) -> DataFrame:
    """Catalog rows with the latest quality score, cut to a whole number; null when never profiled."""
    scores = latest_profiles.select(
        "dataset", F.col("quality_score").cast("int").alias("quality_score")
    )
    return catalog.join(scores, "dataset", "left")


def row_column_count(df: DataFrame) -> DataFrame:
    """Rows and columns of a frame. Over Parquet the plan reads no column data."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )


def metadata_row_count(df: DataFrame) -> DataFrame:
    """Rows from the Parquet footers: a count over an empty read schema. Zero reads as unknown."""
    return df.agg(F.nullif(F.count("*"), F.lit(0).cast("bigint")).alias("row_count"))
