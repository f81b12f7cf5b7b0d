"""Token counts through a cache keyed by content and tokenizer version."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import encoding
from murmur.llm.inputs import map_batches, texts, tokenizer_path
from murmur.session import materialize, scratch_path

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; empty where nothing has been stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, n_bytes, n_tokens: one row per document row.

    The content digest is SHA-256 over the text's UTF-8 bytes, null as empty. That is the
    only normalisation that changes no count: this tokenizer's own normalizer is empty.
    Digests that ``cache`` lacks under this tokenizer file's digest are encoded once each
    and appended to it; a cache folder that does not exist yet is an empty cache. An
    appended batch that two runs write at once is harmless: equal keys hold equal counts.
    Repeated rows, null ids and empty tables are counted like any others.

    Only one row of every missing digest is encoded, whose text is found by (digest, id):
    a text that fills a third of the table is spread over its ids. Of texts, only the
    scan and that one shuffle move.
    """
    spark = docs.sparkSession
    path = tokenizer_path("byte_bpe_50k.json", tokenizer)
    version = encoding.digest_of(path)
    cache = cache or scratch_path(spark, "token-counts")
    content = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    rows = texts(docs, id_col, text_col).withColumn("content", content)
    keys = materialize(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "content-keys")
    firsts = keys.groupBy("content").agg(F.min("doc_id").alias("first_id"))
    misses = firsts.join(read_cache(spark, cache, version), "content", "left_anti").withColumnRenamed("content", "missing")
    found = rows.join(
        misses.hint("shuffle_hash"), (F.col("content") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi"
    ).select("text", "content")

    def count(batch: pa.RecordBatch):
        counts = encoding.byte_counts(path, batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    counted = map_batches(found, count, "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    return keys.join(read_cache(spark, cache, version), "content")
