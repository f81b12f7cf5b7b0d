"""Unusual activity: spikes, sentiment turns and new entrants."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import fixed_text, ts_lit


def _alert(condition: Column, kind: str, score: Column, message: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(kind).alias("kind"), score.cast("double").alias("score"), message.alias("message")),
    )


def alert_candidates(trends: DataFrame, now: datetime) -> DataFrame:
    """Every alert each trend row raises; the four rules share one pass."""
    z, avg, ratio = F.col("breakout_score"), F.col("sentiment_avg"), F.col("bull_bear_ratio")
    cur, prev = F.col("mentions"), F.col("mentions_prev")
    steady = (prev >= 5) & (cur >= 5)
    bearish = steady & (avg <= -0.25) & (ratio < 0.6)
    bullish = steady & ~bearish & (avg >= 0.35) & (ratio > 3.0) & (z > 1.0)
    spike_text = F.format_string(
        "$%s mention volume is %sσ above its trailing baseline (%d mentions/%dh, phase: %s).",
        F.col("ticker"), fixed_text(z, 1), cur, F.col("window_hours"), F.col("phase"),
    )
    bear_text = F.format_string(
        "$%s sentiment has turned decisively bearish (bull:bear %s, avg %s).",
        F.col("ticker"), fixed_text(ratio, 2), fixed_text(avg, 2, signed=True),
    )
    bull_text = F.format_string(
        "$%s is seeing a bullish surge (bull:bear %s on %d mentions).", F.col("ticker"), fixed_text(ratio, 2), cur
    )
    new_text = F.format_string(
        "$%s entered the conversation from zero — %d mentions in the last window.", F.col("ticker"), cur
    )
    raised = F.array(
        _alert((z >= 2.0) & (cur >= 10), "mention_spike", z, spike_text),
        _alert(bearish, "bearish_turn", F.abs(avg), bear_text),
        _alert(bullish, "bullish_surge", avg, bull_text),
        _alert((prev == 0) & (cur >= 8), "new_entrant", cur, new_text),
    )
    return trends.select("ticker", F.explode(F.filter(raised, lambda a: a.isNotNull())).alias("a")).select(
        "ticker", "a.kind", "a.score", "a.message", ts_lit(now).alias("created_at")
    )


def detect_alerts(trends: DataFrame, now: datetime, limit: int = 20) -> DataFrame:
    """The strongest alerts."""
    return alert_candidates(trends, now).orderBy(F.col("score").desc(), "ticker", "kind").limit(limit)


def fresh_alerts(alerts: DataFrame, previous: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts whose (ticker, kind) the previous run did not raise, strongest first.

    With a ``limit`` the weaker ones are not delivered by later runs either, since they count as raised.
    """
    fresh = alerts.join(previous.select("ticker", "kind").distinct(), ["ticker", "kind"], "left_anti")
    ranked = fresh.orderBy(F.col("score").desc(), "ticker", "kind")
    return ranked if limit is None else ranked.limit(limit)
