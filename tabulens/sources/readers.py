"""Scans of the supported formats. Every scan is lazy and splittable where the format allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# File extension to (format, reader options).
FORMATS = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".tsv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
}


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    sep: str = ",",
    sampling_ratio: float = 1.0,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV file or folder with a header line.

    A quoted value may hold line breaks, so a file is one task. Files known to have none are cut into
    many tasks with ``multi_line`` false; there such a value would fall apart. Without a schema the types come from a pass over the file, by default the whole of it, so a value
    late in the file cannot contradict the type. Give the schema to skip that pass.
    """
    reader = spark.read.options(
        header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE"
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.options(
        inferSchema=True, preferDate=True, samplingRatio=sampling_ratio
    ).csv(path)


def scan_tsv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    sampling_ratio: float = 1.0,
    multi_line: bool = True,
) -> DataFrame:
    return scan_csv(spark, path, schema, "\t", sampling_ratio, multi_line)


def scan_json(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None
) -> DataFrame:
    """A file holding one JSON array or object. The format itself cannot be split, so one file is one
    task; write such data as JSON Lines when files are large."""
    reader = spark.read.options(multiLine=True, inferTimestamp=True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def scan_jsonl(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None
) -> DataFrame:
    """One JSON object per line. Without a schema, types come from a pass over all lines."""
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.option("inferTimestamp", True).json(path)


def scan(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Scan by file extension."""
    if extension == ".parquet":
        return scan_parquet(spark, path)
    if extension == ".csv":
        return scan_csv(spark, path)
    if extension == ".tsv":
        return scan_tsv(spark, path)
    if extension == ".json":
        return scan_json(spark, path)
    if extension in (".jsonl", ".ndjson"):
        return scan_jsonl(spark, path)
    raise ValueError(f"unsupported file type: {extension}")


def file_stats(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Name, size and time of every file with content under ``path``, from the listing alone."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select(
            F.col("path").alias("file_path"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modified_at"),
        )
    )


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of no bytes, which no scan ever opens: listed by name but absent from the sizes."""
    named = spark.read.text(path).inputFiles()
    listed = spark.createDataFrame([(name,) for name in named], "file_path string")
    plain = F.regexp_replace("file_path", "^file:/+", "/")
    sized = file_stats(spark, path).select(plain.alias("p"))
    return (
        listed.withColumn("p", plain)
        .join(sized, "p", "left_anti")
        .select(
            "file_path",
            F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
            F.lit(0).cast("bigint").alias("file_size"),
        )
    )
