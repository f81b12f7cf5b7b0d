"""Streaming ingest: late data, idempotence, converging tables, alerts and cool-down."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import HOUR_US, round_to
from murmur.operators.dedup import dedupe_posts
from murmur.sinks.cells import BUCKETS
from murmur.sinks.tables import merge_buckets, merge_posts, prune_days

LATENESS = "6 hours"


def unique_posts(posts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop re-fetched ids that arrive within the lateness bound."""
    return posts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])


def tumbling_buckets(posts: DataFrame, bucket: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Clock-aligned buckets per ticker, emitted once the watermark passes them.

    The first aggregation is keyed by platform, which spreads a hot ticker's state
    and feeds the histogram; the second folds platforms.
    """
    rows = posts.withWatermark("ts", lateness).select(
        "ts", "platform", "engagement", "sentiment", "sentiment_score", F.explode(F.array_distinct("tickers")).alias("ticker")
    )
    by_platform = rows.groupBy(F.window("ts", bucket).alias("w"), "ticker", "platform").agg(
        F.count("*").alias("mentions"),
        F.sum("engagement").alias("engagement"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("bull", "bear", "neutral")],
        F.sum("sentiment_score").alias("score_sum"),
        F.count("sentiment_score").alias("scored"),
    )
    folded = by_platform.groupBy("w", "ticker").agg(
        *[F.sum(c).alias(c) for c in ("mentions", "engagement", "bull", "bear", "neutral", "score_sum", "scored")],
        F.map_from_entries(F.collect_list(F.struct("platform", F.col("mentions").alias("n")))).alias("platforms"),
    )
    minutes = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 60_000_000
    return folded.select(
        "ticker",
        F.col("w.start").alias("bucket_start"),
        minutes.cast("int").alias("bucket_minutes"),
        "mentions", "engagement", "bull", "bear", "neutral",
        round_to(F.try_divide(round_to(F.col("score_sum"), 6), F.col("scored")), 4).alias("sentiment_avg"),
        "platforms",
    )


def posts_into(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: upsert each batch of posts, which is evaluated once; replays converge."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_posts(path, dedupe_posts(batch), buckets)

    return write


def buckets_into(path: str, retention_days: int | None = None, clock: Callable | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: upsert buckets, then prune when a clock is given."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(path, batch, buckets)
        if retention_days is not None and clock is not None:
            prune_days(batch.sparkSession, path, "bucket_start", clock(), retention_days)

    return write


def alerts_once(alerts: DataFrame, hours: float, lateness: str = LATENESS) -> DataFrame:
    """Alerts whose (ticker, kind) was not raised in the ``hours`` before, the time between two runs.

    A stream of the schema of ``alerts``, which has ticker, kind and ``created_at``. State is one
    time per key, kept with the stream's checkpoint until the interval has passed in event
    time, so a restarted stream neither repeats nor loses an alert. An alert that goes on is not
    fresh again; one that was away for a run is. A run raises a key once, so the rows of a key
    in one batch are few.
    """
    import pandas as pd

    schema = alerts.schema

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("created_at", kind="stable")
        fresh = []
        for at in rows["created_at"]:
            us = at.value // 1000
            fresh.append(last is None or us - last > hours * HOUR_US)
            last = us if last is None else max(last, us)
        state.update((last,))
        deadline = last // 1000 + int(hours * 3_600_000) + 1
        if deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
        else:
            state.remove()
        if any(fresh):
            yield rows[fresh][schema.names]

    return alerts.withWatermark("created_at", lateness).groupBy("ticker", "kind").applyInPandasWithState(step, schema, "last bigint", "append", "EventTimeTimeout")


def cooldown(flags: DataFrame, hours: int = 24, lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of the flare-up suppression; keeps one timestamp per ticker.

    A ticker's flags arrive at most once per replay step, so the rows of one key in
    one batch are few. State leaves when the cool-down has passed in event time.
    """
    import pandas as pd

    schema = "ticker string, flagged_at timestamp, breakout_score double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("flagged_at")
        kept = []
        for at, score in zip(rows["flagged_at"], rows["breakout_score"]):
            us = at.value // 1000
            if last is None or us - last >= hours * HOUR_US:
                last = us
                kept.append((key[0], at, score))
        state.update((last,))
        deadline = last // 1000 + hours * 3_600_000
        if deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
        else:
            state.remove()
        if kept:
            yield pd.DataFrame(kept, columns=["ticker", "flagged_at", "breakout_score"])

    return (
        flags.withWatermark("flagged_at", lateness)
        .groupBy("ticker")
        .applyInPandasWithState(step, schema, "last bigint", "append", "EventTimeTimeout")
    )
