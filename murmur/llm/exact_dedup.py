"""Exact deduplication as a stream: keyed state on disk, and a check of full bytes on every hit.

The stream reads documents, reduces every text to a digest and keeps, per digest and for
ever, how many rows had it, the largest doc_id and where that row's content lies. Spark's
streaming aggregation holds this state in RocksDB; rows are combined per task before
they are shuffled, so one text that fills a third of the table costs a row per task.
Every micro-batch appends the changed keys to a log. Digests with more than one row are
hits; their texts are compared in full by grouping on the bytes themselves, so texts that
share a digest without being equal are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import materialize, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves disk it does not fill
}
LOG_SCHEMA = "digest binary, keep_id long, locator string, group_size long, batch long"


def normalized(text: Column) -> Column:
    """The compared text: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest, *more: Column) -> DataFrame:
    content = normalized(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), content.alias("content"), digest(content).alias("digest"), *more)


def run_stream(
    spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text", digest=content_digest, files_per_trigger: int | None = None
) -> DataFrame:
    """Bring the keyed state in ``state_dir`` up to date with all files in ``path``; returns (digest, keep_id, locator, group_size).

    Files that an earlier run has read are not read again. The log has a folder per
    micro-batch that a repeated micro-batch replaces, so a restart neither loses nor doubles it.
    """
    path = path.rstrip("/")
    previous = {name: spark.conf.get(name, None) for name in STATE_STORE}
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a path may also name a single file
    rows = _keyed(stream, id_col, text_col, digest, F.col("_metadata.file_path").alias("file")).drop("content")
    state = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file")).alias("keep"), F.count("*").alias("group_size")
    )
    updates = state.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("locator"), "group_size")

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state_dir}/log/{number:09d}")

    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        query = (
            updates.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(append)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in previous.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return latest_state(spark, state_dir)


def latest_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The last logged row of every digest."""
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{state_dir}/log/*")
    last = F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("s")
    return log.groupBy("digest").agg(last).select("digest", "s.keep_id", "s.locator", "s.group_size")


def check_hits(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """(digest, content, keep_id, group_size) of texts that share a digest without being equal; empty as a rule.

    Only rows whose digest was seen before are compared, by grouping on all their bytes.
    Copies collapse in the task that reads them.
    """
    hits = state.filter("group_size > 1").select("digest")
    compared = keyed.join(hits.hint("shuffle_hash"), "digest", "left_semi")
    variants = compared.groupBy("digest", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    clashing = variants.groupBy("digest").agg(F.count("*").alias("variants")).filter("variants > 1").select("digest")
    clashing = materialize(clashing, "digest-clashes")
    if clashing.isEmpty():
        return clashing.select("digest", F.lit("").alias("content"), F.lit(0).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
    return variants.join(clashing, "digest", "left_semi")


def dedup_stream(
    spark: SparkSession, path: str, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest=content_digest, files_per_trigger: int | None = None
) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: one row per document row in ``path``.

    Of texts equal after lower-casing A-Z the largest doc_id stays. Null texts are empty
    texts; rows that repeat both text and doc_id of the row that stays are all marked kept,
    and a null doc_id stays only where a group has no other. An empty folder of files
    gives an empty result. ``state_dir`` keeps the state between runs (default: a new
    folder in the shared one); files added since are read by the next run.
    """
    state = run_stream(spark, path, state_dir or scratch_path(spark, "dedup-state"), id_col, text_col, digest, files_per_trigger)
    keyed = _keyed(spark.read.parquet(path), id_col, text_col, digest)
    clashes = check_hits(keyed, state)
    judged = keyed.drop("content").join(state.drop("locator"), "digest")
    if not clashes.isEmpty():
        told_apart = keyed.join(clashes, ["digest", "content"]).drop("content")
        judged = judged.join(clashes.select("digest").distinct(), "digest", "left_anti").unionByName(told_apart)
    return judged.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
