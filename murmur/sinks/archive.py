"""Compressed JSON-lines archive of completed days; an archived day is final."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.exprs import round_to, to_utc
from murmur.operators.trends import mentions
from murmur.sinks.storage import delete, move, partition_days, touch
from murmur.sources.scans import completed_buckets, completed_tagged_posts


def author_hash(platform: Column, author: Column) -> Column:
    """Stable pseudonym, scoped to the platform."""
    return F.substring(F.sha2(F.concat(platform, F.lit(":"), author), 256), 1, 16)


def author_daily(posts: DataFrame, now: datetime) -> DataFrame:
    """Stance per (day, author, platform, ticker) over completed days."""
    rows = mentions(completed_tagged_posts(posts, now), "platform", "author", "sentiment", "sentiment_score", "ts")
    keyed = rows.withColumn("day", F.to_date("ts")).withColumn("author", author_hash(F.col("platform"), F.col("author")))
    return keyed.groupBy("day", "author", "platform", "ticker").agg(
        F.count("*").alias("posts"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("bull", "bear", "neutral")],
        round_to(F.try_divide(round_to(F.sum("sentiment_score"), 6), F.count("sentiment_score")), 6).alias("sentiment_avg"),
    )


def unarchived(df: DataFrame, archived: DataFrame) -> DataFrame:
    """Rows whose ``day`` has no archive yet."""
    return df.join(archived.select("day").distinct(), "day", "left_anti")


def day_report(df: DataFrame) -> DataFrame:
    """Rows per day."""
    return df.groupBy("day").agg(F.count("*").alias("rows"))


def archived_days(spark: SparkSession, path: str) -> list[date]:
    """Days whose archive is complete: those that have a marker."""
    return partition_days(spark, f"{path}/_done")


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of complete days, with ``day``; a day that is being written is not seen."""
    days = archived_days(spark, path)
    typed = f"{schema}, day date"
    if not days:
        return spark.createDataFrame([], typed)
    return spark.read.schema(typed).option("basePath", path).json([f"{path}/day={d.isoformat()}" for d in days])


def unfinished(df: DataFrame, day: Column, done: list[date]) -> DataFrame:
    """Rows of days without a marker, before anything is computed from them."""
    return df.filter(~day.isin(done)) if done else df


def _archive_days(df: DataFrame, path: str, order: list[str]) -> dict[str, int]:
    """Write the days of ``df``, which must not be archived yet; returns rows per written day.

    All days are written to a staging folder first. Then each is moved into its place and
    marked. A day counts as archived only by its marker, so one that a failed run left half
    written is replaced by the next run.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    df.hint("rebalance", "day").sortWithinPartitions("day", *order).write.partitionBy("day").json(staged, compression="gzip")
    days = partition_days(spark, staged)
    for day in days:
        publish_day(spark, staged, path, day)
    delete(spark, f"{path}/_staged")
    if not days:
        return {}
    lines = spark.read.schema("ticker string, day date").option("basePath", path).json([f"{path}/day={d.isoformat()}" for d in days])
    return {r["day"].isoformat(): r["rows"] for r in day_report(lines).collect()}


def publish_day(spark: SparkSession, staged: str, path: str, day: date) -> None:
    """Move one staged day into the archive; the marker is the commit."""
    name = f"day={day.isoformat()}"
    move(spark, f"{staged}/{name}", f"{path}/{name}")
    touch(spark, f"{path}/_done/{name}")


def archive_buckets(buckets: DataFrame, now: datetime, path: str) -> dict[str, int]:
    done = completed_buckets(buckets, now).withColumn("day", F.to_date("bucket_start"))
    return _archive_days(unfinished(done, F.col("day"), archived_days(buckets.sparkSession, path)), path, ["ticker", "bucket_start"])


def archive_author_daily(posts: DataFrame, now: datetime, path: str) -> dict[str, int]:
    """Archive author days; posts of archived days are not read where ``day`` partitions them."""
    day = F.col("day") if "day" in posts.columns else F.to_date("ts")
    rest = unfinished(posts, day, archived_days(posts.sparkSession, path))
    return _archive_days(author_daily(rest, now), path, ["author", "ticker"])


def archive_trends(trends: DataFrame, now: datetime, path: str) -> int:
    """One snapshot per day; the first run of a day wins."""
    today = to_utc(now).date()
    if today in archived_days(trends.sparkSession, path):
        return 0
    return _archive_days(trends.withColumn("day", F.lit(today)), path, ["ticker"]).get(today.isoformat(), 0)
