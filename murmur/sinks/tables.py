"""Parquet tables: snapshots, merged tables in cells, retention.

Posts, buckets and payloads are kept in cells of (day, hash bucket), see
``murmur.sinks.cells``: a merge reads and writes only the cells it touches and is visible
whole or not at all, and one that is run again converges. Each table has a single writer.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.exprs import to_utc, ts_lit
from murmur.operators.merge import live_buckets, upsert_buckets, upsert_meta, upsert_posts
from murmur.sinks.cells import BUCKETS, bucket_of, current, filter_days, merge_cells, read_cells


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the whole table."""
    df.write.mode("overwrite").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """A merged table with its partition column ``day``."""
    return read_cells(spark, path).drop("bucket")


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days that a merged table holds rows of."""
    manifest = current(spark, path)
    return manifest.days if manifest else []


def merge_posts(path: str, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """Upsert posts by id; ``incoming`` must be unique by id. A known post keeps its time and with it its cell."""
    merge_cells(path, incoming, "id", lambda: F.to_date("ts"), ["ts", "id"], upsert_posts, keeps_day=True, buckets=buckets)


def merge_buckets(path: str, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """Upsert non-empty buckets by (ticker, bucket_start, bucket_minutes)."""
    day = lambda: F.to_date("bucket_start")
    merge_cells(path, live_buckets(incoming), "ticker", day, ["ticker", "bucket_start"], upsert_buckets, buckets=buckets)


def merge_meta(path: str, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """Upsert key/value payloads, which belong to no day."""
    merge_cells(path, incoming, "key", lambda: F.lit(None).cast("date"), ["key"], upsert_meta, buckets=buckets)


def read_meta(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of one key; only its bucket is scanned, and finding it takes no job."""
    manifest = current(spark, path)
    rows = read_cells(spark, path)
    return rows.filter((F.col("bucket") == bucket_of(F.lit(key), manifest.buckets)) & (F.col("key") == key)).drop("day", "bucket")


def prune_days(spark: SparkSession, path: str, ts_col: str, now: datetime, days: int = 30) -> list[date]:
    """Drop what is past the retention; the day of the cut-off keeps its younger rows."""
    cutoff = to_utc(now) - timedelta(days=days)
    return filter_days(spark, path, cutoff.date(), F.col(ts_col) >= ts_lit(cutoff), [ts_col])
