"""Trend metrics, buckets, mood and the co-mention graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import (
    AUTHORITY, ENTITIES_SQL, NOW, NOW_SQL, POSTS_SQL, all_posts, entities, posts, ts_text, with_ctes,
)
from murmur.functions.exprs import map_text
from murmur.operators import buckets, graph, sentiment, trends

ONE_STEP = f"steps as (select 0 k, {NOW_SQL} as_of)"
REPLAY_STEPS = f"steps as (select k::int k, {NOW_SQL} - k * interval 6 hour as_of from range(25) r(k))"

# Trend rows as of every step, computed from dense hourly counts.
TREND_SQL = """
vis as (select s.k, s.as_of, m.*, m.ts >= s.as_of - interval 24 hour inwin from mentions m join steps s on m.ts <= s.as_of),
cnt as (select k, ticker, least(167, (epoch_us(ts) - epoch_us(as_of - interval 168 hour)) // 3600000000) idx, count(*) n
        from vis where ts >= as_of - interval 168 hour group by all),
dense as (select t.k, t.as_of, t.ticker, i.idx, coalesce(c.n, 0) n
          from (select distinct k, as_of, ticker from vis) t cross join (select range idx from range(168)) i
          left join cnt c on c.k = t.k and c.ticker = t.ticker and c.idx = i.idx),
base as (select k, ticker, avg(n) filter (where idx < 144) bm,
           avg(n) filter (where idx < 144 and matched) mm, stddev_pop(n) filter (where idx < 144 and matched) ms,
           string_agg(n::varchar, ',' order by idx) filter (where idx >= 144) sparkline
         from (select *, (hour(as_of) - hour(as_of - interval 168 hour + idx * interval 1 hour) + 24) % 24 between 1 and 6 matched from dense)
         group by k, ticker),
win as (select k, as_of, ticker,
          count(*) filter (where inwin) mentions,
          count(*) filter (where ts >= as_of - interval 48 hour and not inwin) mentions_prev,
          count(*) filter (where ts >= as_of - interval 6 hour) spike,
          count(*) filter (where inwin and sentiment = 'bull') bull,
          count(*) filter (where inwin and sentiment = 'bear') bear,
          count(*) filter (where inwin and sentiment = 'neutral') neutral,
          sum(weight * sentiment_score) filter (where inwin) / sum(weight) filter (where inwin and sentiment_score is not null) savg,
          coalesce(cast(sum(engagement) filter (where inwin) as bigint), 0) engagement,
          sum(ln(1 + engagement)) filter (where inwin) log_eng
        from vis group by all),
scored as (select w.*, b.sparkline, b.bm,
          greatest(-10.0, least(10.0, (spike / 6.0 - mm) / (ms + greatest(0.2, mm * 0.15) + 1e-9))) z,
          (mentions - mentions_prev) / 24.0 vel,
          sum(mentions) over (partition by k) total
        from win w join base b using (k, ticker)),
trends as (select k, as_of, ticker, 24 window_hours, mentions, mentions_prev, round(vel, 4) velocity, round(z, 3) breakout_score,
          case when z >= 1.5 and vel > 0 then 'emerging' when z >= 1.5 then 'peaking'
               when mentions_prev / 24.0 > bm * 1.5 + 1e-9 and vel < 0 then 'fading' else 'steady' end phase,
          round(mentions / (total + 1e-9), 5) share_of_voice,
          round(coalesce(savg, 0.0), 4) sentiment_avg, bull, bear, neutral,
          round((bull + 1) / (bear + 1), 3) bull_bear_ratio, engagement, round(log_eng, 2) engagement_weighted_score, sparkline
        from scored where mentions >= 3)
"""

HISTOGRAM_SQL = f"""
hist as (select ticker, platform, count(*) n, min(ts) first_ts from mentions where ts >= {NOW_SQL} - interval 24 hour group by all),
platforms as (select ticker, string_agg(platform || '=' || n, ',' order by platform) platforms, arg_min(platform, (first_ts, platform)) origin_platform
              from hist group by ticker)
"""

TOP_POSTS_SQL = f"""
top as (select ticker, id, engagement, ts, row_number() over (partition by ticker order by engagement desc, ts, id) rank
        from mentions where ts >= {NOW_SQL} - interval 24 hour qualify rank <= 5)
"""

TRENDS_NOW_SQL = with_ctes(POSTS_SQL, ONE_STEP, TREND_SQL)

CORE_COLUMNS = (
    "ticker, window_hours, mentions, mentions_prev, velocity, breakout_score, phase, share_of_voice, sentiment_avg, bull, bear, "
    "neutral, bull_bear_ratio, engagement, engagement_weighted_score, sparkline"
)


def core(spark, d):
    return trends.core_trends(posts(spark, d), NOW, authority=AUTHORITY)


def full(spark, d):
    return trends.ticker_trends(posts(spark, d), entities(spark), NOW, authority=AUTHORITY)


def _flat(df):
    return df.withColumn("sparkline", F.array_join(F.transform("sparkline", lambda x: x.cast("string")), ","))


def top_tickers(spark, d):
    return trends.top_tickers(core(spark, d), 40).select(
        "ticker", "mentions", "mentions_prev", "velocity", "breakout_score", "phase", "bull_bear_ratio", "engagement"
    )


def ticker_trends(spark, d):
    rows = _flat(full(spark, d)).withColumn("platforms", map_text(F.col("platforms")))
    ids = F.array_join(F.transform("top_posts", lambda p: p["id"]), ",")
    return rows.withColumn("top_posts", ids)


def hourly_counts(spark, d):
    return trends.hourly_counts(posts(spark, d), NOW, 168)


def mention_windows(spark, d):
    return core(spark, d).select("ticker", "mentions", "mentions_prev", "velocity", "bull", "bear", "neutral", "bull_bear_ratio")


def breakout_phase(spark, d):
    return core(spark, d).select("ticker", "breakout_score", "phase")


def share_of_voice(spark, d):
    return core(spark, d).select("ticker", "share_of_voice", "engagement", "engagement_weighted_score")


def sparkline(spark, d):
    return _flat(core(spark, d)).select("ticker", "sparkline")


def platform_histogram(spark, d):
    return trends.platform_summary(posts(spark, d), NOW).withColumn("platforms", map_text(F.col("platforms")))


def top_posts(spark, d):
    return trends.ranked_posts(posts(spark, d), NOW).select("ticker", "rank", "id", "engagement")


def market_mood(spark, d):
    return trends.market_mood(posts(spark, d), NOW, authority=AUTHORITY)


def run_metadata(spark, d):
    row = trends.run_summary(posts(spark, d), NOW, 24, "live", "lexicon", "tfidf", AUTHORITY)
    return row.select(
        "mode", ts_text("updated_at").alias("updated_at"), "posts_processed",
        F.array_join("sources", ",").alias("sources"), "sentiment_backend", "embed_backend", "window_hours",
        "refresh_minutes", F.col("mood.index").alias("mood_index"), F.col("mood.label").alias("mood_label"),
    )


MOOD_SQL = f"""
mood as (select coalesce(round((sum(weight * sentiment_score) / sum(weight) + 1) / 2 * 100, 1), 50.0) as index,
           count(*) filter (where sentiment = 'bull') bull, count(*) filter (where sentiment = 'bear') bear,
           count(*) filter (where sentiment = 'neutral') neutral, count(*) posts
         from posts where sentiment_score is not null and ts >= {NOW_SQL} - interval 24 hour),
labelled_mood as (select *, case when index >= 75 then 'extreme greed' when index >= 60 then 'greed' when index > 40 then 'neutral'
           when index > 25 then 'fear' else 'extreme fear' end as label from mood)
"""

BUCKET_SQL = """
bk as (select ticker, least({n} - 1, (epoch_us(ts) - epoch_us({start})) // ({m}::bigint * 60000000)) idx,
         count(*) mentions, cast(sum(engagement) as bigint) engagement,
         count(*) filter (where sentiment = 'bull') bull, count(*) filter (where sentiment = 'bear') bear,
         count(*) filter (where sentiment = 'neutral') neutral,
         round(round(sum(sentiment_score), 6) / nullif(count(sentiment_score), 0), 4) sentiment_avg
       from mentions where ts >= {start} group by 1, 2),
bp as (select ticker, idx, string_agg(platform || '=' || n, ',' order by platform) platforms
       from (select ticker, platform, least({n} - 1, (epoch_us(ts) - epoch_us({start})) // ({m}::bigint * 60000000)) idx, count(*) n
             from mentions where ts >= {start} group by all) group by 1, 2),
buckets as (select t.ticker, {start} + i.idx * interval {m} minute bucket_start, {m} bucket_minutes,
         coalesce(b.mentions, 0) mentions, coalesce(b.engagement, 0) engagement, coalesce(b.bull, 0) bull,
         coalesce(b.bear, 0) bear, coalesce(b.neutral, 0) neutral, b.sentiment_avg, coalesce(p.platforms, '') platforms
       from (select distinct ticker from bk) t cross join (select range idx from range({n})) i
       left join bk b on b.ticker = t.ticker and b.idx = i.idx left join bp p on p.ticker = t.ticker and p.idx = i.idx)
"""


def bucket_sql(minutes: int, start: str) -> str:
    return BUCKET_SQL.format(n=168 * 60 // minutes, m=minutes, start=start)


ROLLING_START = f"({NOW_SQL} - interval 168 hour)"
ALIGNED_START = f"({NOW_SQL} - interval 167 hour)"


def _flat_buckets(df):
    return df.withColumn("bucket_start", ts_text("bucket_start")).withColumn("platforms", map_text(F.col("platforms")))


def bucket_series(spark, d):
    return _flat_buckets(buckets.bucket_series(posts(spark, d), NOW))


def bucket_series_15min(spark, d):
    return _flat_buckets(buckets.bucket_series(posts(spark, d), NOW, bucket_minutes=15)).drop("platforms")


def aligned_buckets(spark, d):
    return _flat_buckets(buckets.aligned_bucket_series(posts(spark, d), NOW))


def influence_weights(spark, d):
    weighted = all_posts(spark, d).select("id", F.round(sentiment.post_weight(AUTHORITY), 6).alias("weight"))
    return weighted


def weighted_sentiment(spark, d):
    return sentiment.weighted_sentiment(all_posts(spark, d), ["author"], AUTHORITY).withColumn(
        "sentiment_avg", F.round("sentiment_avg", 6)
    )


GRAPH_SQL = """
counts as (select ticker, count(*) mentions from am group by ticker having count(*) >= 5),
weights as (select a.ticker source, b.ticker target, count(*) weight from am a join am b on a.id = b.id and a.ticker < b.ticker
            where a.ticker in (select ticker from counts) and b.ticker in (select ticker from counts) group by 1, 2),
linked as (select source ticker from weights where weight >= 2 union select target from weights where weight >= 2),
nodes as (select ticker id, coalesce(e.name, ticker) as name, coalesce(e.sector, 'Other') sector, mentions
          from counts left join entities e using (ticker)
          where ticker in (select ticker from linked) or mentions >= 20),
edges as (select * from weights where weight >= 2 and source in (select id from nodes) and target in (select id from nodes))
"""
AM_SQL = "am as (select id, t1 ticker from allposts union all select id, t2 from allposts where t2 is not null and t2 <> t1)"


def graph_nodes(spark, d):
    return graph.compute_graph(all_posts(spark, d), entities(spark))[0]


def graph_edges(spark, d):
    return graph.compute_graph(all_posts(spark, d), entities(spark))[1]


def strongest_edges(spark, d):
    return graph.strongest_edges(graph_edges(spark, d))


def co_mentions(spark, d):
    p = all_posts(spark, d)
    return graph.co_mentions(p, graph.mention_counts(p))


QUERIES = {
    "top_tickers": (
        top_tickers,
        TRENDS_NOW_SQL
        + "select ticker, mentions, mentions_prev, velocity, breakout_score, phase, bull_bear_ratio, engagement from trends order by mentions desc, ticker limit 40",
    ),
    "ticker_trends": (
        ticker_trends,
        with_ctes(POSTS_SQL, ONE_STEP, TREND_SQL, HISTOGRAM_SQL, TOP_POSTS_SQL, ENTITIES_SQL)
        + f"select {CORE_COLUMNS}, platforms, origin_platform, coalesce(e.name, t.ticker) as name, coalesce(e.sector, 'Other') sector, "
        "(select string_agg(id, ',' order by rank) from top where top.ticker = t.ticker) top_posts "
        "from trends t left join platforms using (ticker) left join entities e using (ticker)",
    ),
    "hourly_counts": (
        hourly_counts,
        with_ctes(POSTS_SQL, ONE_STEP, TREND_SQL)
        + "select ticker, idx::int idx, n from dense where ticker in (select ticker from cnt)",
    ),
    "mention_windows": (
        mention_windows,
        TRENDS_NOW_SQL + "select ticker, mentions, mentions_prev, velocity, bull, bear, neutral, bull_bear_ratio from trends",
    ),
    "breakout_phase": (breakout_phase, TRENDS_NOW_SQL + "select ticker, breakout_score, phase from trends"),
    "share_of_voice": (
        share_of_voice,
        TRENDS_NOW_SQL + "select ticker, share_of_voice, engagement, engagement_weighted_score from trends",
    ),
    "sparkline": (sparkline, TRENDS_NOW_SQL + "select ticker, sparkline from trends"),
    "platform_histogram": (platform_histogram, with_ctes(POSTS_SQL, HISTOGRAM_SQL) + "select * from platforms"),
    "top_posts": (top_posts, with_ctes(POSTS_SQL, TOP_POSTS_SQL) + "select ticker, rank, id, engagement from top"),
    "market_mood": (market_mood, with_ctes(POSTS_SQL, MOOD_SQL) + "select index, label, bull, bear, neutral, posts from labelled_mood"),
    "run_metadata": (
        run_metadata,
        with_ctes(POSTS_SQL, MOOD_SQL)
        + "select 'live' as mode, '2024-01-30 18:00:00' updated_at, (select count(*) from posts) posts_processed, "
        "(select string_agg(distinct platform, ',' order by platform) from posts) sources, 'lexicon' sentiment_backend, "
        "'tfidf' embed_backend, 24 window_hours, 15 refresh_minutes, index mood_index, label mood_label from labelled_mood",
    ),
    "bucket_series": (bucket_series, with_ctes(POSTS_SQL, bucket_sql(60, ROLLING_START)) + "select * replace (strftime(bucket_start, '%Y-%m-%d %H:%M:%S') as bucket_start) from buckets"),
    "bucket_series_15min": (
        bucket_series_15min,
        with_ctes(POSTS_SQL, bucket_sql(15, ROLLING_START))
        + "select * exclude (platforms) replace (strftime(bucket_start, '%Y-%m-%d %H:%M:%S') as bucket_start) from buckets",
    ),
    "aligned_buckets": (aligned_buckets, with_ctes(POSTS_SQL, bucket_sql(60, ALIGNED_START)) + "select * replace (strftime(bucket_start, '%Y-%m-%d %H:%M:%S') as bucket_start) from buckets"),
    "influence_weights": (influence_weights, with_ctes(POSTS_SQL) + "select id, round(weight, 6) weight from allposts"),
    "weighted_sentiment": (
        weighted_sentiment,
        with_ctes(POSTS_SQL)
        + "select author, round(sum(weight * sentiment_score) / sum(weight) filter (where sentiment_score is not null), 6) sentiment_avg from allposts group by author",
    ),
    "co_mentions": (co_mentions, with_ctes(POSTS_SQL, AM_SQL, ENTITIES_SQL, GRAPH_SQL) + "select * from weights"),
    "graph_nodes": (graph_nodes, with_ctes(POSTS_SQL, AM_SQL, ENTITIES_SQL, GRAPH_SQL) + "select * from nodes"),
    "graph_edges": (graph_edges, with_ctes(POSTS_SQL, AM_SQL, ENTITIES_SQL, GRAPH_SQL) + "select * from edges"),
    "strongest_edges": (strongest_edges, with_ctes(POSTS_SQL, AM_SQL, ENTITIES_SQL, GRAPH_SQL) + "select * from edges order by weight desc, source, target limit 120"),
}
