"""Trend metrics per ticker.

All windows are whole hours back from the clock, so every metric is a function of
counts per (ticker, hours-ago). Posts are reduced to those cells in one shuffle with
map-side combining; whatever follows works on at most a few hundred cells per
ticker, however many posts a hot ticker has.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import fixed_values as fv
from murmur.functions.exprs import HOUR_US, floor_div, micros, round_to, to_utc, top_per_group, ts_lit
from murmur.functions.stats import EPS, breakout_score, bull_bear_ratio, classify_phase, mood_label, velocity
from murmur.operators.sentiment import post_weight, weighted_sentiment_agg
from murmur.session import materialize
from murmur.sources.dictionary import enrich_entities

SPIKE_HOURS = 6


def mentions(posts: DataFrame, *columns: str) -> DataFrame:
    """One row per (post, distinct ticker), with the chosen post columns."""
    return posts.select(*columns, F.explode(F.array_distinct("tickers")).alias("ticker"))


def hours_ago(now: datetime) -> Column:
    """Hours back from ``now``, rounded up: cell ``c`` covers [now-c, now-c+1)."""
    age = F.lit(micros(now)) - F.unix_micros("ts")
    return -floor_div(-age, HOUR_US)


def full_hours_ago(now: datetime) -> Column:
    """Hours back from ``now``, rounded down; tells whether a post exactly on a step is visible."""
    return floor_div(F.lit(micros(now)) - F.unix_micros("ts"), HOUR_US)


def cell_sums(authority) -> list[Column]:
    """The additive measures of a cell."""
    weight, score = post_weight(authority), F.col("sentiment_score")
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("sentiment") == "bull").alias("bull"),
        F.count_if(F.col("sentiment") == "bear").alias("bear"),
        F.count_if(F.col("sentiment") == "neutral").alias("neutral"),
        F.sum(F.when(score.isNotNull(), weight * score)).alias("ws"),
        F.sum(F.when(score.isNotNull(), weight)).alias("w"),
        F.sum("engagement").alias("eng"),
        F.sum(F.log1p(F.col("engagement").cast("double"))).alias("log_eng"),
    ]


def matched_baseline_hours(window_hours: int, history_hours: int) -> int:
    """Number of baseline cells that share the clock hour of one of the recent hours."""
    return sum(1 for a in range(window_hours + 1, history_hours + 1) if (a - 1) % 24 < SPIKE_HOURS)


def window_stats(cells: DataFrame, keys: list[str], window_hours: int, history_hours: int) -> DataFrame:
    """Windowed sums per key from cells with age ``a`` (1 = the latest hour)."""
    w, h = window_hours, history_hours
    a = F.col("a")
    current, previous = a <= w, (a > w) & (a <= 2 * w)
    baseline = (a > w) & (a <= h)
    matched = baseline & (F.pmod(a - 1, F.lit(24)) < SPIKE_HOURS)

    def total(condition: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    return (
        cells.groupBy(*keys, "a")
        .agg(*[F.sum(c).alias(c) for c in ("n", "bull", "bear", "neutral", "ws", "w", "eng", "log_eng")])
        .withColumn("nn", F.col("n") * F.col("n"))
        .groupBy(*keys)
        .agg(
            total(current, "n").alias("mentions"),
            total(previous, "n").alias("mentions_prev"),
            total(a <= min(SPIKE_HOURS, w), "n").alias("spike"),
            total(current, "bull").alias("bull"),
            total(current, "bear").alias("bear"),
            total(current, "neutral").alias("neutral"),
            F.sum(F.when(current, F.col("ws"))).alias("ws"),
            F.sum(F.when(current, F.col("w"))).alias("w"),
            total(current, "eng").alias("engagement"),
            total(current, "log_eng").alias("log_eng"),
            total(baseline, "n").alias("base"),
            total(baseline, "nn").alias("base_sq"),
            total(matched, "n").alias("match"),
            total(matched, "nn").alias("match_sq"),
            F.sort_array(F.collect_list(F.when(current, F.struct("a", "n")))).alias("recent"),
        )
    )


def derive_metrics(stats: DataFrame, window_hours: int, history_hours: int) -> DataFrame:
    """Velocity, breakout, phase, sentiment and ratios from window sums."""
    w = window_hours
    n_base = max(0, history_hours - w)
    n_match = matched_baseline_hours(w, history_hours)
    rate = F.col("spike") / F.lit(float(SPIKE_HOURS))
    if n_match:
        z = breakout_score(rate, n_match, F.col("match"), F.col("match_sq"))
    else:
        z = breakout_score(rate, n_base, F.col("base"), F.col("base_sq"))
    base_mean = F.col("base") / F.lit(float(n_base)) if n_base else F.lit(0.0)
    return (
        stats.withColumn("z", z)
        .withColumn("vel", velocity(F.col("mentions"), F.col("mentions_prev"), w))
        .withColumn("phase", classify_phase(F.col("z"), F.col("vel"), F.col("mentions_prev") / F.lit(float(w)), base_mean))
        .withColumn("velocity", round_to(F.col("vel"), 4))
        .withColumn("breakout_score", round_to(F.col("z"), 3))
        .withColumn("sentiment_avg", round_to(F.coalesce(F.try_divide("ws", "w"), F.lit(0.0)), 4))
        .withColumn("bull_bear_ratio", round_to(bull_bear_ratio(F.col("bull"), F.col("bear")), 3))
        .withColumn("engagement_weighted_score", round_to(F.col("log_eng"), 2))
        .withColumn("sparkline", sparkline(w))
    )


def sparkline(window_hours: int) -> Column:
    """Dense hourly counts of the window, oldest first, from the ``recent`` cell list."""
    by_age = F.map_from_entries("recent")
    return F.transform(
        F.sequence(F.lit(window_hours), F.lit(1), F.lit(-1)),
        lambda a: F.coalesce(F.try_element_at(by_age, a.cast("long")), F.lit(0)),
    )


def ticker_cells(posts: DataFrame, now: datetime, window_hours: int = 24, history_hours: int = 168, authority=fv.PLATFORM_AUTHORITY) -> DataFrame:
    """Additive measures and the earliest time per (ticker, hours ago, platform): the one pass over the posts that trends need."""
    reach = max(history_hours, 2 * window_hours)
    recent = posts.filter(F.col("ts") >= ts_lit(to_utc(now) - timedelta(hours=reach)))
    return (
        mentions(recent, "ts", "platform", "engagement", "sentiment", "sentiment_score")
        .withColumn("a", F.greatest(hours_ago(now), F.lit(1)))
        .groupBy("ticker", "a", "platform")
        .agg(*cell_sums(authority), F.min("ts").alias("first_ts"))
    )


def core_of_cells(cells: DataFrame, window_hours: int = 24, history_hours: int = 168, min_mentions: int = 3) -> DataFrame:
    """The counted part of the trends from ``ticker_cells``; the share of voice counts tickers below the floor too."""
    spoken = cells.filter(F.col("a") <= window_hours).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    stats = window_stats(cells, ["ticker"], window_hours, history_hours)
    return (
        derive_metrics(stats, window_hours, history_hours)
        .filter(F.col("mentions") >= min_mentions)
        .withColumn("window_hours", F.lit(window_hours))
        .withColumn("share_of_voice", round_to(F.col("mentions") / (spoken + EPS), 5))
        .select(
            "ticker", "window_hours", "mentions", "mentions_prev", "velocity", "breakout_score", "phase",
            "share_of_voice", "sentiment_avg", "bull", "bear", "neutral", "bull_bear_ratio", "engagement",
            "engagement_weighted_score", "sparkline",
        )
    )


def platforms_of_cells(cells: DataFrame, window_hours: int = 24) -> DataFrame:
    """Per ticker: platform histogram map and the platform that spoke first, from ``ticker_cells``."""
    per = cells.filter(F.col("a") <= window_hours).groupBy("ticker", "platform").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"))
    return _platform_maps(per)


def core_trends(
    posts: DataFrame,
    now: datetime,
    window_hours: int = 24,
    history_hours: int = 168,
    min_mentions: int = 3,
    authority=fv.PLATFORM_AUTHORITY,
) -> DataFrame:
    """One row per ticker above the mention floor, without the per-platform and top-post parts.

    The posts are read once: their cells are written out and everything is folded from those.
    """
    cells = materialize(ticker_cells(posts, now, window_hours, history_hours, authority), "ticker-cells")
    return core_of_cells(cells, window_hours, history_hours, min_mentions)


def in_window(posts: DataFrame, now: datetime, window_hours: int) -> DataFrame:
    """Posts of the current window; the lower edge counts, there is no upper edge."""
    return posts.filter(F.col("ts") >= ts_lit(to_utc(now) - timedelta(hours=window_hours)))


def platform_counts(posts: DataFrame, now: datetime, window_hours: int = 24) -> DataFrame:
    """Mentions and earliest time per (ticker, platform) in the window."""
    return mentions(in_window(posts, now, window_hours), "platform", "ts").groupBy("ticker", "platform").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts")
    )


def platform_summary(posts: DataFrame, now: datetime, window_hours: int = 24) -> DataFrame:
    """Per ticker: platform histogram map and the platform that spoke first."""
    return _platform_maps(platform_counts(posts, now, window_hours))


def _platform_maps(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ticker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "n")))).alias("platforms"),
        F.min(F.struct("first_ts", "platform"))["platform"].alias("origin_platform"),
    )


def ranked_posts(posts: DataFrame, now: datetime, window_hours: int = 24, k: int = 5) -> DataFrame:
    """The ``k`` most engaging window posts per ticker with their rank."""
    rows = mentions(
        in_window(posts, now, window_hours),
        "id", "text", "author", "platform", "source", "engagement", "url", "sentiment", "ts",
    )
    order = [F.col("engagement").desc(), F.col("ts").asc(), F.col("id").asc()]
    return top_per_group(rows, ["ticker"], order, k, rank="rank")


def top_posts(posts: DataFrame, now: datetime, window_hours: int = 24, k: int = 5) -> DataFrame:
    """Per ticker: its top posts as one ordered array."""
    fields = ["id", "text", "author", "platform", "source", "engagement", "url", "sentiment", "ts"]
    ranked = ranked_posts(posts, now, window_hours, k)
    packed = ranked.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("p"))
    return packed.select(
        "ticker",
        F.transform("p", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("top_posts"),
    )


def ticker_trends(
    posts: DataFrame,
    entities: DataFrame,
    now: datetime,
    window_hours: int = 24,
    history_hours: int = 168,
    min_mentions: int = 3,
    authority=fv.PLATFORM_AUTHORITY,
) -> DataFrame:
    """The complete trend row per ticker: one pass over the posts for the cells, one for the top posts."""
    cells = materialize(ticker_cells(posts, now, window_hours, history_hours, authority), "ticker-cells")
    return (
        enrich_entities(core_of_cells(cells, window_hours, history_hours, min_mentions), entities)
        .join(platforms_of_cells(cells, window_hours), "ticker", "left")
        .join(top_posts(posts, now, window_hours), "ticker", "left")
    )


def hourly_counts(posts: DataFrame, now: datetime, hours: int) -> DataFrame:
    """Dense mention counts per (ticker, idx), oldest hour first, anchored at ``now - hours``."""
    recent = posts.filter(F.col("ts") >= ts_lit(to_utc(now) - timedelta(hours=hours)))
    idx = F.least(F.lit(hours - 1), F.lit(hours) - hours_ago(now)).cast("int")
    counts = mentions(recent, "ts").groupBy("ticker", idx.alias("idx")).agg(F.count("*").alias("n"))
    packed = counts.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("idx", "n"))).alias("m"))
    return packed.select("ticker", "m", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("idx")).select(
        "ticker", "idx", F.coalesce(F.try_element_at("m", F.col("idx")), F.lit(0)).alias("n")
    )


def top_tickers(trends: DataFrame, n: int = 40) -> DataFrame:
    """The most mentioned tickers."""
    return trends.orderBy(F.col("mentions").desc(), "ticker").limit(n)


def market_mood(posts: DataFrame, now: datetime, window_hours: int = 24, authority=fv.PLATFORM_AUTHORITY) -> DataFrame:
    """Influence-weighted 0..100 index over the scored posts of the window; one row."""
    scored = in_window(posts, now, window_hours).filter(F.col("sentiment_score").isNotNull())
    mean = weighted_sentiment_agg(post_weight(authority), F.col("sentiment_score"))
    row = scored.agg(
        F.coalesce(round_to((mean + 1) / 2 * 100, 1), F.lit(50.0)).alias("index"),
        F.count_if(F.col("sentiment") == "bull").alias("bull"),
        F.count_if(F.col("sentiment") == "bear").alias("bear"),
        F.count_if(F.col("sentiment") == "neutral").alias("neutral"),
        F.count("*").alias("posts"),
    )
    return row.withColumn("label", mood_label(F.col("index"))).select("index", "label", "bull", "bear", "neutral", "posts")


def run_summary(posts: DataFrame, now: datetime, window_hours: int, mode: str, sentiment_backend: str, embed_backend: str, authority=fv.PLATFORM_AUTHORITY) -> DataFrame:
    """One row describing a run."""
    mood = market_mood(posts, now, window_hours, authority).select(F.struct("*").alias("mood"))
    facts = posts.groupBy("platform").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("posts_processed"),
        F.sort_array(F.collect_list("platform")).alias("sources"),
    )
    return facts.select(
        F.lit(mode).alias("mode"),
        ts_lit(now).alias("updated_at"),
        "posts_processed",
        "sources",
        F.lit(sentiment_backend).alias("sentiment_backend"),
        F.lit(embed_backend).alias("embed_backend"),
        F.lit(window_hours).alias("window_hours"),
        F.lit(15 if mode == "live" else None).cast("int").alias("refresh_minutes"),
        mood.scalar().alias("mood"),
    )
