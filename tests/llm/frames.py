"""Small frames with the cases every operator must take: nulls, empties, repeats, clashing columns."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again until night falls"),
    (1, "the quick brown fox jumps over the lazy dog again and again until night falls"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "Ünïcödé ﬁ 日本語 🎉 text"),
    (None, "a row without an id"),
    (6, "word " * 3000),
    (7, "x" * 30000),
]
# Names that operators use for their own columns.
CLASHES = "n_words long, score double, text_mark long, node long, key long, length long, rank long, mix_source string, id long, label int, blocks long, block long, turn string, mix_name string, mix_row string"


def odd_docs(spark):
    schema = f"doc_id long, text string, source string, lang string, n_chars long, {CLASHES}"
    rows = [(i, t, "a" if (i or 0) % 2 else None, "en", len(t or ""), *[None] * 10, 7, 8, "t", "m", "r") for i, t in ODD]
    return spark.createDataFrame(rows, schema)


def no_docs(spark):
    return odd_docs(spark).limit(0)


def texts(name: str = "documents", columns: str = "doc_id, text") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


def table(spark, name: str):
    return spark.read.parquet(f"{SF}/{name}.parquet")
