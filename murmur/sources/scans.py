"""Unions, trailing-window scans, source statistics and payload lookup."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import to_utc, ts_lit


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources as one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def source_stats(posts: DataFrame) -> DataFrame:
    """Posts and posts with at least one ticker, per platform."""
    return posts.groupBy("platform").agg(
        F.count("*").alias("posts"),
        F.count_if(F.size("tickers") > 0).alias("with_tickers"),
    )


def load_recent_posts(posts: DataFrame, now: datetime, hours: int = 168) -> DataFrame:
    """Posts of the trailing window with their null defaults filled.

    The time predicate is a plain comparison on ``ts``, so it reaches the Parquet
    scan; on a date-partitioned table ``day`` prunes whole directories as well.
    """
    since = to_utc(now) - timedelta(hours=hours)
    scan = posts.filter(F.col("ts") >= ts_lit(since))
    if "day" in posts.columns:
        scan = scan.filter(F.col("day") >= F.lit(since.date()))
    empty = F.array().cast("array<string>")
    return scan.select(
        "id",
        "platform",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("author", F.lit("")).alias("author"),
        "text",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("lang", F.lit("en")).alias("lang"),
        F.coalesce("engagement", F.lit(0)).cast("bigint").alias("engagement"),
        "sentiment",
        "sentiment_score",
        F.coalesce("tickers", empty).alias("tickers"),
        "topic_id",
        "ts",
    )


def _day_start(now: datetime) -> datetime:
    return to_utc(now).replace(hour=0, minute=0, second=0, microsecond=0)


def completed_buckets(buckets: DataFrame, now: datetime) -> DataFrame:
    """Buckets that start before the current UTC day."""
    return buckets.filter(F.col("bucket_start") < ts_lit(_day_start(now)))


def completed_tagged_posts(posts: DataFrame, now: datetime) -> DataFrame:
    """The six archive columns of tagged posts before the current UTC day."""
    return posts.filter((F.col("ts") < ts_lit(_day_start(now))) & (F.size("tickers") > 0)).select(
        "platform", "author", "tickers", "sentiment", "sentiment_score", "ts"
    )


def valid_symbol(symbol: Column) -> Column:
    return symbol.rlike(r"^[A-Z.]{1,6}$")


def payload(meta: DataFrame, key: str) -> DataFrame:
    """The stored value of one key; no row when the key is unknown."""
    return meta.filter(F.col("key") == key).select("value")


def ticker_payload(meta: DataFrame, symbol: str) -> DataFrame:
    """The ticker bundle of ``symbol``; no row when the symbol is malformed or unknown."""
    return payload(meta, f"ticker:{symbol}").filter(valid_symbol(F.lit(symbol)))
