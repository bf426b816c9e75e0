"""Token counts of whole texts through a compiled finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, text_of
from tabulens.llm.transducer import CHUNK_CHARS, from_sentencepiece, written_form


def token_counts(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Tokens of each text as the sentencepiece model at ``model`` cuts it, without added tokens.

    Returns the id, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``chunk_ends`` (tokens up to the end
    of each chunk of ``chunk_chars`` characters). A null or empty text has no bytes, tokens or chunks.
    A very long text is read chunk by chunk. One result row per row, repeated rows and ids included;
    null ids stay null; other columns are not read. ``model`` must be readable on every executor.
    """

    def count(columns: list) -> Iterator[tuple]:
        machine = from_sentencepiece(model)
        for key, n_bytes, text in zip(*columns, strict=True):
            ends = machine.offsets(written_form(text), chunk_chars)
            n = ends[-1] if ends else 0
            yield key, n_bytes, n, n > limit, ends

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{id_col}`"),
        F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
        text_of(text_col).alias("text"),
    )
    return map_rows(
        rows,
        count,
        f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, chunk_ends array<long>",
    )
