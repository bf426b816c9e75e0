"""Result exports as CSV, TSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.names import col

NESTED = (T.ArrayType, T.MapType, T.StructType)


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, all others unchanged."""
    return df.select(
        *[
            (F.to_json(col(f.name)) if isinstance(f.dataType, NESTED) else col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One part file per task: header, null and empty text as nothing, quotes doubled when quoted."""
    flat_columns(df).write.mode("errorifexists").options(
        header=True, sep=sep, quote='"', escape='"', nullValue="", emptyValue="",
        timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def export_tsv(df: DataFrame, path: str) -> None:
    export_csv(df, path, sep="\t")


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines part files; null fields are written as null."""
    df.write.mode("errorifexists").options(
        ignoreNullFields=False, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).json(path)
