"""Whole-table checks of text files before they are read as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulens.sources.readers import empty_files, file_stats


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file_path")
    )


def _line_problems(value: Column, json_lines: bool) -> dict[str, Column]:
    """Name of each problem with the condition that a line has it."""
    blank = F.trim(value) == ""
    problems = {
        "nul_byte": value.contains("\x00"),
        "invalid_utf8": ~F.is_valid_utf8(value),
    }
    if json_lines:
        # Only lines that are clean text are parsed, and blank lines are allowed.
        text = F.when(F.is_valid_utf8(value) & ~blank, value)
        parsed = F.try_parse_json(text)
        problems["invalid_json"] = text.isNotNull() & parsed.isNull()
        problems["not_an_object"] = parsed.isNotNull() & ~F.schema_of_variant(parsed).startswith(
            "OBJECT"
        )
    return problems


def malformed_record_scan(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Per file: lines, lines with content, and the number of lines with each problem.

    Reads every line. The counts are added up per file before the shuffle, so one huge file is no
    hot spot. Empty files come from the listing, with zeros.
    """
    lines = _text_lines(spark, path)
    value = F.col("value")
    problems = _line_problems(value, json_lines)
    counted = lines.groupBy("file_path").agg(
        F.count("*").alias("lines"),
        F.count_if(F.trim(value) != "").alias("content_lines"),
        *[F.count_if(cond).alias(name) for name, cond in problems.items()],
    )
    names = ["lines", "content_lines", *problems]
    own = ["file_path", "file_name", "file_size"]
    files = file_stats(spark, path).select(*own).unionByName(empty_files(spark, path).select(*own))
    bad = sum((F.col(name) for name in problems), F.lit(0))
    return (
        files.join(counted, "file_path", "left")
        .select(
            "file_name",
            "file_size",
            *[F.coalesce(F.col(n), F.lit(0).cast("bigint")).alias(n) for n in names],
        )
        .withColumn("is_empty", F.col("content_lines") == 0)
        .withColumn("usable", ~F.col("is_empty") & (bad == 0))
    )


def unreadable_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Files that give no row as Parquet: broken markers or footer, or no rows at all."""
    rows = (
        spark.read.option("ignoreCorruptFiles", "true")
        .schema(StructType([]))
        .parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file_path"))
        .agg(F.count("*").alias("row_count"))
    )
    files = file_stats(spark, path).where(F.lower("file_name").endswith(".parquet"))
    return files.join(rows, "file_path", "left_anti").select("file_name", "file_size")


def malformed_lines(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Every line with a problem, its file, and the names of its problems."""
    problems = _line_problems(F.col("value"), json_lines)
    found = F.array(*[F.when(cond, F.lit(name)) for name, cond in problems.items()])
    return (
        _text_lines(spark, path)
        .withColumn("problems", F.filter(found, lambda name: name.isNotNull()))
        .where(F.size("problems") > 0)
    )
