"""Idempotent merges and retention, as pure frame-to-frame operators.

The matching writers live in ``murmur.sinks.tables``.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import to_utc, ts_lit

REPLACED = ("sentiment", "sentiment_score", "tickers", "topic_id")


def upsert_posts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by id. A known post keeps its text, author and time, takes the larger
    engagement and the incoming tags and scores. ``incoming`` must be unique by id.
    """
    cols = existing.columns
    old = existing.select(F.struct(*cols).alias("o"), F.col("id"))
    new = incoming.select(F.struct(*[c for c in cols if c in incoming.columns]).alias("n"), F.col("id"))
    known = F.col("o").isNotNull()
    arrived = F.col("n").isNotNull()

    def merged(c: str):
        if c == "id":
            return F.col("id")
        if c not in incoming.columns:
            return F.col(f"o.{c}")
        if c == "engagement":
            return F.greatest("o.engagement", "n.engagement")
        if c in REPLACED:
            return F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return old.join(new, "id", "full").select(*[merged(c).alias(c) for c in cols])


def upsert_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing rows with the same key."""
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def live_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets with any mention or engagement; absence means zero."""
    return buckets.filter((F.coalesce("mentions", F.lit(0)) != 0) | (F.coalesce("engagement", F.lit(0)) != 0))


def upsert_buckets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_by_key(existing, live_buckets(incoming), ["ticker", "bucket_start", "bucket_minutes"])


def upsert_meta(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_by_key(existing, incoming, ["key"])


def retained(df: DataFrame, ts_col: str, now: datetime, days: int = 30) -> DataFrame:
    """Rows younger than the retention period."""
    return df.filter(F.col(ts_col) >= ts_lit(to_utc(now) - timedelta(days=days)))


def prune_report(tables: dict[str, tuple[DataFrame, str]], now: datetime, days: int = 30) -> DataFrame:
    """Rows to be pruned per table; ``tables`` maps a name to (frame, time column)."""
    cutoff = ts_lit(to_utc(now) - timedelta(days=days))
    parts = [
        df.agg(F.count_if(F.col(col) < cutoff).alias("pruned")).select(F.lit(name).alias("table_name"), "pruned")
        for name, (df, col) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def sink_columns(trends: DataFrame) -> DataFrame:
    """The trend columns that are persisted."""
    return trends.drop("sector", "origin_platform")


def union_tickers(top: DataFrame, flagged: DataFrame) -> DataFrame:
    """Distinct tickers: the ranked ones first, then flagged ones by name."""
    ranked = top.select("ticker", F.col("rank").cast("long").alias("rank"))
    extra = flagged.select("ticker", F.lit(2**62).alias("rank"))
    return ranked.unionByName(extra).groupBy("ticker").agg(F.min("rank").alias("rank")).orderBy("rank", "ticker").select("ticker")
