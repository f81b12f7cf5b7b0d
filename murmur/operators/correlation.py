"""Mention volume against price moves: alignment, lag profile and readout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.exprs import fixed_text, round_to, top_per_group
from murmur.functions.stats import pearson_agg

MAX_LAG = 12
MIN_ROWS = 24
SERIES_ROWS = 168
LAG_MARGIN = 0.02


def hourly_mentions(buckets: DataFrame) -> DataFrame:
    """One bucket per (ticker, clock hour): the last one to start in that hour."""
    latest = F.max_by(F.struct("mentions", "sentiment_avg"), "bucket_start")
    return (
        buckets.groupBy("ticker", F.date_trunc("hour", "bucket_start").alias("hour"))
        .agg(latest.alias("b"))
        .select("ticker", "hour", "b.mentions", "b.sentiment_avg")
    )


def align_series(buckets: DataFrame, prices: DataFrame) -> DataFrame:
    """Candles inside the bucket coverage with their mentions and hourly return.

    Coverage limits a ticker to the candles of its bucket history, which bounds the
    per-ticker window of the return.
    """
    hourly = hourly_mentions(buckets)
    span = buckets.groupBy("ticker").agg(
        F.date_trunc("hour", F.min("bucket_start")).alias("lo"),
        F.date_trunc("hour", F.max("bucket_start")).alias("hi"),
    )
    hour = F.date_trunc("hour", "ts")
    covered = (
        prices.withColumn("hour", hour)
        .join(span, "ticker")
        .filter(F.col("hour").between(F.col("lo"), F.col("hi")))
        .drop("lo", "hi")
    )
    w = Window.partitionBy("ticker").orderBy("ts")
    prev = F.coalesce(F.lag("close").over(w), F.col("open"))
    ret = F.coalesce(F.try_divide(F.col("close") - prev, prev), F.lit(0.0))
    return (
        covered.join(hourly, ["ticker", "hour"], "left")
        .withColumn("raw_return", ret)
        .select(
            "ticker",
            "ts",
            "close",
            "volume",
            round_to(F.col("raw_return"), 6).alias("return"),
            round_to(F.abs("raw_return"), 6).alias("abs_return"),
            F.coalesce("mentions", F.lit(0)).alias("mentions"),
            "sentiment_avg",
        )
    )


def lag_profile(aligned: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Pearson r of mentions against moves shifted by ``lag`` rows, per (ticker, lag).

    Lags count rows, so closed-market gaps collapse. Tickers with few rows or no
    mentions are left out. One sort per ticker serves all lags, and the aggregation
    reuses its partitioning.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    whole = Window.partitionBy("ticker")
    shifted = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), (F.lead("abs_return", k) if k >= 0 else F.lag("abs_return", -k)).over(w).alias("move"))
            for k in range(-max_lag, max_lag + 1)
        ]
    )
    rows = (
        aligned.withColumn("pairs", shifted)
        .withColumn("n_rows", F.count("*").over(whole))
        .withColumn("total", F.sum("mentions").over(whole))
        .filter((F.col("n_rows") >= MIN_ROWS) & (F.col("total") > 0))
        .select("ticker", "mentions", F.explode("pairs").alias("p"))
        .select("ticker", "mentions", "p.lag", "p.move")
    )
    return rows.groupBy("ticker", "lag").agg(round_to(pearson_agg(F.col("mentions"), F.col("move")), 4).alias("r"))


def best_lag(profile: DataFrame) -> DataFrame:
    """Concurrent r and best lag per ticker; near ties go to the smaller |lag|."""
    entry = F.struct(F.abs("lag").alias("dist"), "lag", "r")
    packed = profile.groupBy("ticker").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    fold = F.aggregate(
        "p", F.element_at("p", 1), lambda acc, x: F.when(x["r"] > acc["r"] + LAG_MARGIN, x).otherwise(acc)
    )
    return packed.withColumn("best", fold).select(
        "ticker",
        F.filter("p", lambda x: x["lag"] == 0)[0]["r"].alias("pearson_r"),
        F.col("best.lag").alias("best_lag_hours"),
        F.col("best.r").alias("best_lag_r"),
        F.map_from_entries(F.transform("p", lambda x: F.struct(x["lag"], x["r"]))).alias("by_lag"),
    )


def readout(ticker: Column, r: Column, lag: Column, lag_r: Column) -> Column:
    """One sentence about the relationship."""
    size = F.abs(lag_r)
    strength = F.when(size >= 0.5, "strong").when(size >= 0.3, "moderate").otherwise("weak")
    two = fixed_text(lag_r, 2)
    none = F.format_string("No meaningful buzz-move relationship for %s in this window.", ticker)
    lead = F.format_string(
        "Chatter tends to LEAD price moves by ~%dh (%s, r=%s) — social buzz has been an early signal for %s.",
        lag, strength, two, ticker,
    )
    follow = F.format_string(
        "Chatter tends to FOLLOW price moves by ~%dh (%s, r=%s) — the crowd is reacting to %s's tape, not predicting it.",
        -lag, strength, two, ticker,
    )
    same = F.format_string("Buzz and price moves are concurrent for %s (%s, r=%s).", ticker, strength, fixed_text(r, 2))
    return F.when(size < 0.15, none).when(lag > 0, lead).when(lag < 0, follow).otherwise(same)


def _with_defaults(tickers: DataFrame, best: DataFrame) -> DataFrame:
    return tickers.join(best, "ticker", "left").select(
        "ticker",
        F.coalesce("pearson_r", F.lit(0.0)).alias("pearson_r"),
        F.coalesce("best_lag_hours", F.lit(0)).alias("best_lag_hours"),
        F.coalesce("best_lag_r", F.lit(0.0)).alias("best_lag_r"),
        F.coalesce("by_lag", F.create_map().cast("map<int,double>")).alias("by_lag"),
    )


def lead_lag(aligned: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Best lag per ticker; tickers without enough data get zeros and an empty profile."""
    return _with_defaults(aligned.select("ticker").distinct(), best_lag(lag_profile(aligned, max_lag)))


def recent_series(aligned: DataFrame, rows: int = SERIES_ROWS) -> DataFrame:
    """The last rows of each aligned series."""
    return top_per_group(aligned, ["ticker"], [F.col("ts").desc()], rows)


def correlation(buckets: DataFrame, prices: DataFrame) -> DataFrame:
    """Lead-lag result, readout and the recent series per ticker with bucket history."""
    aligned = align_series(buckets, prices)
    fields = ["ts", "close", "volume", "return", "abs_return", "mentions", "sentiment_avg"]
    series = recent_series(aligned).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("series"))
    result = _with_defaults(buckets.select("ticker").distinct(), best_lag(lag_profile(aligned)))
    text = readout(F.col("ticker"), F.col("pearson_r"), F.col("best_lag_hours"), F.col("best_lag_r"))
    return result.withColumn("readout", text).join(series, "ticker", "left")
