"""Read-side queries over the precomputed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.exprs import round_to, top_per_group

SORT_KEYS = ("mentions", "velocity", "breakout_score", "bull_bear_ratio", "share_of_voice", "engagement_weighted_score")


def leaderboard(
    trends: DataFrame,
    query: str = "",
    phase: str | None = None,
    sector: str | None = None,
    platform: str | None = None,
    sort_key: str = "mentions",
    descending: bool = True,
) -> DataFrame:
    """Filter by text, phase, sector and platform, then sort by one metric."""
    if sort_key not in trends.columns:
        raise ValueError(f"unknown sort key {sort_key!r}")
    out = trends
    if query:
        needle = F.lit(query.lower())
        out = out.filter(
            F.contains(F.lower("ticker"), needle) | F.contains(F.lower(F.coalesce("name", F.lit(""))), needle)
        )
    if phase:
        out = out.filter(F.col("phase") == phase)
    if sector:
        out = out.filter(F.col("sector") == sector)
    if platform:
        out = out.filter(F.try_element_at("platforms", F.lit(platform)) > 0)
    key = F.col(sort_key)
    return out.orderBy(key.desc() if descending else key.asc(), "ticker")


def sector_facets(trends: DataFrame) -> DataFrame:
    return trends.filter(F.coalesce("sector", F.lit("")) != "").select("sector").distinct().orderBy("sector")


def platform_facets(trends: DataFrame) -> DataFrame:
    return trends.select(F.explode(F.map_keys("platforms")).alias("platform")).distinct().orderBy("platform")


def sentiment_mix(df: DataFrame) -> DataFrame:
    """Add shares of bull, bear and neutral."""
    total = F.greatest(F.lit(1), F.col("bull") + F.col("bear") + F.col("neutral"))
    for name in ("bull", "bear", "neutral"):
        df = df.withColumn(f"{name}_share", F.col(name) / total)
    return df


def delta_badge(current: Column, previous: Column) -> Column:
    """``new``, ``·`` below one percent, or an arrow with the rounded percentage."""
    pct = (current - previous) / F.when(previous != 0, previous) * 100
    size = F.format_string("%.0f%%", round_to(F.abs(pct), 0))
    return (
        F.when(F.coalesce(previous, F.lit(0)) == 0, "new")
        .when(F.abs(pct) < 1, "·")
        .when(pct > 0, F.concat(F.lit("▲ "), size))
        .otherwise(F.concat(F.lit("▼ "), size))
    )


def _by_count(platforms: Column) -> Column:
    """(count, platform) entries, largest first, then by name."""
    keyed = F.transform(F.map_entries(platforms), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("platform")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["platform"].alias("platform"), (-e["neg"]).alias("n")))


def platform_chips(platforms: Column, k: int = 3) -> Column:
    """The ``k`` largest platforms as ``name count`` texts."""
    return F.transform(F.slice(_by_count(platforms), 1, k), lambda e: F.concat_ws(" ", e["platform"], e["n"].cast("string")))


def platform_shares(trends: DataFrame) -> DataFrame:
    """One row per (ticker, platform) with count and share."""
    total = F.aggregate(F.map_values("platforms"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return trends.select("ticker", total.alias("total"), F.explode(_by_count(F.col("platforms"))).alias("e")).select(
        "ticker", "e.platform", "e.n", (F.col("e.n") / F.col("total")).alias("share")
    )


def matchup(trends: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(ticker, side) of a pair; by default the two most mentioned tickers. Two rows."""
    if a and b:
        return trends.filter(F.col("ticker").isin(a, b)).select(
            "ticker", F.when(F.col("ticker") == a, "a").otherwise("b").alias("side")
        )
    order = [F.col("mentions").desc(), F.col("ticker")]
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return trends.orderBy(*order).limit(2).select("ticker", F.when(rank == 1, "a").otherwise("b").alias("side"))


def head_to_head(trends: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Six metrics of a pair side by side: ``metric, a, b``."""
    pair = trends.join(matchup(trends, a, b), "ticker")
    slim = pair.select("side", *[F.col(k).cast("double").alias(k) for k in SORT_KEYS])
    long = slim.unpivot("side", list(SORT_KEYS), "metric", "value")
    return long.groupBy("metric").pivot("side", ["a", "b"]).agg(F.max("value"))


def pair_series(series: DataFrame, pair: DataFrame, field: str) -> DataFrame:
    """The series of a pair aligned on the union of their times: ``ts, a, b``."""
    rows = series.join(pair, "ticker")
    return rows.groupBy("ts").agg(*[F.max(F.when(F.col("side") == x, F.col(field))).alias(x) for x in ("a", "b")])


def join_series(series_a: DataFrame, series_b: DataFrame, field: str) -> DataFrame:
    """Two series aligned on their union of times: ``ts, a, b``."""
    left = series_a.select("ts", F.col(field).alias("a"))
    right = series_b.select("ts", F.col(field).alias("b"))
    return left.join(right, "ts", "full").orderBy("ts")


def rebase(rows: DataFrame) -> DataFrame:
    """Both columns as percent change from their first non-null value.

    The bases are two scalar aggregates, so the series is never sorted in one task.
    """
    bases = rows.agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in ("a", "b")]
    ).select(F.struct("a", "b").alias("base"))
    out = rows.withColumn("__base", bases.scalar())
    for c in ("a", "b"):
        base = F.nullif(F.col(f"__base.{c}").cast("double"), F.lit(0.0))
        out = out.withColumn(c, (F.try_divide(F.col(c).cast("double"), base) - 1) * 100)
    return out.drop("__base")


def points_of_topic(points: DataFrame, topic_id: int | None) -> DataFrame:
    return points if topic_id is None else points.filter(F.col("topic_id") == topic_id)


def ticker_bundle(trends: DataFrame, buckets: DataFrame, prices: DataFrame, correlations: DataFrame, rows: int = 168) -> DataFrame:
    """(key, value) payload rows, one JSON text per ticker of ``trends``.

    Buckets are cut to the last ``rows`` before they are packed; candles are the
    series of the price history kept per ticker.
    """
    wanted = trends.select("ticker")
    b = top_per_group(buckets.join(wanted, "ticker", "left_semi"), ["ticker"], [F.col("bucket_start").desc()], rows)
    bucket_fields = [c for c in buckets.columns if c != "ticker"]
    candles = prices.join(wanted, "ticker", "left_semi")
    packed_b = b.groupBy("ticker").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bucket_start", F.struct(*bucket_fields).alias("v"))), lambda x, y: F.when(x["bucket_start"] < y["bucket_start"], -1).otherwise(1)),
            lambda e: e["v"],
        ).alias("buckets")
    )
    packed_p = candles.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume"))).alias("prices")
    )
    return (
        trends.select("ticker", F.struct(*trends.columns).alias("trend"))
        .join(packed_b, "ticker", "left")
        .join(packed_p, "ticker", "left")
        .join(correlations.select("ticker", F.struct(*correlations.columns).alias("correlation")), "ticker", "left")
        .select(
            F.concat(F.lit("ticker:"), F.col("ticker")).alias("key"),
            F.to_json(F.struct("trend", "buckets", "prices", "correlation")).alias("value"),
        )
    )
