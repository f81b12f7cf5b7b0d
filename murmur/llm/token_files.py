"""Token ids of documents in files of wavelet matrices, in ascending doc_id order, and reading them back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm import encoding
from murmur.llm.inputs import texts, tokenizer_path
from murmur.llm.wavelet import WaveletMatrix

SHARD_TOKENS = 1 << 20
FILE_SCHEMA = "file int, shard int, n_docs long, n_tokens long, doc_ids binary, null_ids binary, lengths binary, tokens binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, bits: int = 16,
    shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode whole texts, end each with ``end_id`` and write shards of about ``shard_tokens`` ids to ``path``.

    Documents are range-partitioned and sorted by id (nulls first, repeated ids by text),
    so file after file and shard after shard the ids ascend. A shard is one row of a
    compressed Parquet file: doc_ids, lengths and the wavelet matrix of its ids; a
    document is never divided, so one longer than a shard fills a shard of its own. A
    lost task writes its file anew; Spark's commit shows only whole files.
    """
    vocabulary = tokenizer_path("word_bpe_49k.json", tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def pack(file: int, shard: int, ids: list, coded: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(c) // 4 for c in coded], "<u4")
        matrix = WaveletMatrix.build(np.frombuffer(b"".join(coded), "<u4"), bits)
        known = np.array([0 if i is None else i for i in ids], "<i8")
        nulls = np.packbits(np.array([i is None for i in ids], bool))
        row = (file, shard, len(ids), int(lengths.sum()), known.tobytes(), nulls.tobytes(), lengths.tobytes(), matrix.to_bytes())
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    def encode(batches):
        from pyspark import TaskContext

        from murmur.llm.inputs import cut

        file, shard, ids, coded, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for piece in cut(batch.select([1, 0]), 4 << 20):
                for doc_id, code in zip(piece.column(1).to_pylist(), encoding.word_ids(vocabulary, piece.column(0).to_pylist())):
                    code += end
                    if ids and size + len(code) > 4 * shard_tokens:
                        yield pack(file, shard, ids, coded)
                        shard, ids, coded, size = shard + 1, [], [], 0
                    ids.append(doc_id)
                    coded.append(code)
                    size += len(code)
        if ids:
            yield pack(file, shard, ids, coded)

    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, shard: one row per document, decoded from the files.

    ``start`` adds the lengths of earlier files, of earlier shards of the file and of
    earlier documents of the shard; the only window without a key has one row per file.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                ids = memoryview(WaveletMatrix.from_bytes(row["tokens"]).decode()).cast("B")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(lengths)
                nulls = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=n).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["file"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls), pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64()),
                    ],
                    ["file", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    decoded = files.select("file", "shard", "doc_ids", "null_ids", "lengths", "tokens").mapInArrow(
        decode, "file int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    sizes = files.select("file", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_file = sizes.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"))
    file_starts = per_file.select("file", before(Window.orderBy("file")).alias("file_start"))
    shard_starts = sizes.select("file", "shard", before(Window.partitionBy("file").orderBy("shard")).alias("shard_start"))
    starts = shard_starts.join(file_starts, "file").select("file", "shard", (F.col("file_start") + F.col("shard_start")).alias("base"))
    return decoded.join(starts, ["file", "shard"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "file", "shard"
    )
