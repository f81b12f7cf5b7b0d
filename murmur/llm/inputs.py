"""What the corpus operators share: their view of a documents table and scans that are cut finely enough."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any documents table; null texts become empty.

    Other columns, also those that clash with names used by an operator, are left out.
    Rows with a null or repeated id stay.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def map_batches(df: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, max_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` whose batches are cut to about ``max_bytes`` before ``work`` sees them.

    Bounds the arrays a task holds whatever the length of the texts; a single longer
    row is a batch of its own.
    """

    def run(batches):
        for batch in batches:
            for piece in cut(batch, max_bytes):
                yield from work(piece)

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose first variable-length column holds about ``max_bytes``."""
    import numpy as np

    column = next((c for c in batch.columns if pa.types.is_large_string(c.type) or pa.types.is_string(c.type)), None)
    if column is None or batch.num_rows < 2:
        yield batch
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        end = min(batch.num_rows, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def releasing(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``, after which the worker gives freed memory back; workers are reused by later stages."""

    def run(batches):
        import ctypes

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def flat_bytes(column: pa.Array):
    """(bytes as uint8, offsets as int64 starting at 0) of a string column without nulls; no copy of the text."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    jvm = table.sparkSession._jvm
    files = table.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def sha256_text(col: Column | str) -> Column:
    return F.sha2(F.encode(F.col(col) if isinstance(col, str) else col, "UTF-8"), 256)


def tokenizer_path(name: str, path: str | None = None) -> str:
    """``path`` if given, else the place of a public vocabulary file."""
    if path:
        return path
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
