"""Token counts of whole texts, exactly as the vocabulary's library gives them.

Texts up to `chunk_chars` characters are encoded whole, many in a call. Longer ones are encoded in
overlapping chunks with offsets, which are spliced at boundaries that both chunks have and that no
token can cross; overlaps widen where there is none (see wordbpe.WordBpe.spliced), for texts with
special strings too. The scan's rows are counted where they are read: no shuffle.

Defined cases: a null text has no bytes and no tokens; a null id and repeated rows are kept as they
are; a text without white space is one chunk; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .wordbpe import WordBpe

#: Characters that one call of the library gets.
CALL_CHARS = 1 << 18


def count_column(column: pa.Array, bpe: WordBpe, chunk_chars: int, overlap_chars: int) -> np.ndarray:
    """Tokens of each text of the column."""
    counts = np.zeros(len(column), np.int64)
    rows: list[int] = []
    texts: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if rows:
            counts[rows] = bpe.counts(texts)
        rows.clear()
        texts.clear()
        size = 0

    for k, value in enumerate(column):
        text = value.as_py() or ""
        if len(text) > chunk_chars:
            counts[k] = sum(len(ids) for ids in bpe.spliced(text, chunk_chars, overlap_chars))
        elif text:
            rows.append(k)
            texts.append(text)
            size += len(text)
            if size > CALL_CHARS:
                flush()
    flush()
    return counts


def token_counts(docs: DataFrame, vocab: str, limit: int = 2048, chunk_chars: int = 64 << 10, overlap_chars: int = 1 << 10) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(vocab)
        for batch in batches:
            counts = count_column(batch.column("text"), bpe, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), n_bytes.alias("n_bytes"), F.col("text").cast("string"))
    counted = arrow_map(rows, count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
