"""Encoding of a corpus, and sizes of its texts in tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import encoder, vocabulary_path
from graphloom.storage import spread

#: Texts encoded together end at this many rows or characters, so that a batch of very long texts is not held encoded at once.
ROWS, CHARACTERS = 256, 2_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with the texts of a column: never more than ROWS rows as Python strings at a time, and fewer if they are long."""
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        texts = part.column(column).to_pylist()
        for a, b in groups(texts):
            yield part.slice(a, b - a), texts[a:b]


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= ROWS or size > CHARACTERS):
            yield start, i
            start, size = i, 0
        size += len(t) if t else 0
    if start < len(texts):
        yield start, len(texts)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str | None = None) -> DataFrame:
    """`doc_id`, `ids`: a row a row of the input, ids being the tokens of byte_bpe_50k without special tokens.

    An empty or null text has an empty list; strings of special tokens in a text are ordinary text. Other columns are not read.
    """
    path = vocabulary_path(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = work.encode(texts)
                ends = np.zeros(len(texts) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return spread(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str | None = None) -> DataFrame:
    """`doc_id`, `n_tokens`: a row a row of the input; 0 for an empty or null text."""
    path = vocabulary_path(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = [work.split(t) if t else [] for t in texts]
                known = work.learn(words)
                n = [sum(len(known[w]) for w in x) for x in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, "doc_id bigint, n_tokens bigint")
