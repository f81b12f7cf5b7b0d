"""Dense time-bucket series per ticker."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import floor_div, micros, round_to, to_utc, ts_lit
from murmur.operators.trends import mentions

MEASURES = ("mentions", "engagement", "bull", "bear", "neutral")


def aligned_now(now: datetime) -> datetime:
    """The next full hour, so that bucket keys are the same in every run of an hour."""
    return to_utc(now).replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)


def bucket_cells(posts: DataFrame, now: datetime, bucket_minutes: int, history_hours: int) -> DataFrame:
    """Non-empty buckets per (ticker, idx), platform histogram included.

    The first aggregation is keyed by platform too, so the histogram costs no second
    pass over the posts.
    """
    start = to_utc(now) - timedelta(hours=history_hours)
    n_buckets = history_hours * 60 // bucket_minutes
    width = bucket_minutes * 60 * 1_000_000
    idx = F.least(F.lit(n_buckets - 1), floor_div(F.unix_micros("ts") - F.lit(micros(start)), width)).cast("int")
    rows = mentions(
        posts.filter(F.col("ts") >= ts_lit(start)), "ts", "platform", "engagement", "sentiment", "sentiment_score"
    )
    by_platform = rows.groupBy("ticker", idx.alias("idx"), "platform").agg(
        F.count("*").alias("mentions"),
        F.sum("engagement").alias("engagement"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("bull", "bear", "neutral")],
        F.sum("sentiment_score").alias("score_sum"),
        F.count("sentiment_score").alias("scored"),
    )
    return by_platform.groupBy("ticker", "idx").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        F.sum("score_sum").alias("score_sum"),
        F.sum("scored").alias("scored"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", F.col("mentions").alias("n"))))).alias("platforms"),
    )


def bucket_series(
    posts: DataFrame,
    now: datetime,
    bucket_minutes: int = 60,
    history_hours: int = 168,
    tickers: DataFrame | None = None,
) -> DataFrame:
    """Every bucket of the trailing history per ticker, empty ones as zeros.

    ``tickers`` restricts the series (and adds all-empty series for silent tickers).
    A ticker holds at most ``history_hours * 60 / bucket_minutes`` cells, so the spine is
    filled from a per-ticker map instead of a join.
    """
    start = to_utc(now) - timedelta(hours=history_hours)
    n_buckets = history_hours * 60 // bucket_minutes
    cells = bucket_cells(posts, now, bucket_minutes, history_hours)
    if tickers is not None:
        cells = cells.join(tickers.select("ticker"), "ticker", "left_semi")
    score = round_to(F.try_divide(round_to(F.col("score_sum"), 6), F.col("scored")), 4).alias("sentiment_avg")
    packed = cells.groupBy("ticker").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*MEASURES, score, "platforms")))).alias("m")
    )
    if tickers is not None:
        packed = tickers.select("ticker").join(packed, "ticker", "left")
    filled = packed.select(
        "ticker", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("idx"), "m"
    ).select("ticker", "idx", F.try_element_at("m", F.col("idx")).alias("b"))
    width_us = bucket_minutes * 60 * 1_000_000
    return filled.select(
        "ticker",
        F.timestamp_micros(F.lit(micros(start)) + F.col("idx").cast("long") * width_us).alias("bucket_start"),
        F.lit(bucket_minutes).alias("bucket_minutes"),
        *[F.coalesce(F.col(f"b.{m}"), F.lit(0)).alias(m) for m in MEASURES],
        F.col("b.sentiment_avg").alias("sentiment_avg"),
        F.coalesce(F.col("b.platforms"), F.create_map().cast("map<string,bigint>")).alias("platforms"),
    )


def aligned_bucket_series(posts: DataFrame, now: datetime, bucket_minutes: int = 60, history_hours: int = 168, tickers: DataFrame | None = None) -> DataFrame:
    """The series with clock-aligned keys, as it is persisted."""
    return bucket_series(posts, aligned_now(now), bucket_minutes, history_hours, tickers)
