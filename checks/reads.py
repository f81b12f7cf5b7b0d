"""Alerts, brief and the read-side queries over the trend table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import AUTHORITY, ENTITIES_SQL, NOW, POSTS_SQL, PRICES_SQL, posts, prices, ts_text, with_ctes
from checks.market import ALIGN_SQL, LAG_SQL, REPLAY_SQL
from checks.trends import (
    HISTOGRAM_SQL, MOOD_SQL, ONE_STEP, ROLLING_START, TOP_POSTS_SQL, TREND_SQL, bucket_sql, core, full,
)
from murmur.operators import alerts, backtest, brief, buckets, correlation, dashboard, merge, trends
from murmur.session import materialize


def _many_trends(spark, d):
    """Trend rows as of every replay step, one pseudo ticker per (ticker, step)."""
    rows = backtest.replay_trends(posts(spark, d), NOW, authority=AUTHORITY)
    return rows.withColumn("ticker", F.concat_ws("@", "ticker", F.col("k").cast("string"))).withColumn("window_hours", F.lit(24))


def alert_rules(spark, d):
    return alerts.alert_candidates(_many_trends(spark, d), NOW).withColumn("created_at", ts_text("created_at"))


def detect_alerts(spark, d):
    return alerts.detect_alerts(_many_trends(spark, d), NOW).select("ticker", "kind", "score")


def fresh_alerts(spark, d):
    found = alerts.alert_candidates(_many_trends(spark, d), NOW)
    previous = found.filter(F.col("kind") == "mention_spike")
    return alerts.fresh_alerts(found, previous).select("ticker", "kind", "score")


def change_arrows(spark, d):
    rows = _many_trends(spark, d)
    cur, prev = F.col("mentions"), F.col("mentions_prev")
    return rows.select("ticker", brief.arrow(cur, prev).alias("arrow"), dashboard.delta_badge(cur, prev).alias("badge"))


def sentiment_mix(spark, d):
    rows = dashboard.sentiment_mix(_many_trends(spark, d))
    return rows.select("ticker", *[F.round(f"{n}_share", 6).alias(f"{n}_share") for n in ("bull", "bear", "neutral")])


def leaderboard(spark, d):
    t = full(spark, d)
    return dashboard.leaderboard(t, query="company", sector="Energy", platform="click", sort_key="engagement_weighted_score").select(
        "ticker", "name", "sector", "phase", "mentions", "engagement_weighted_score"
    )


def sector_facets(spark, d):
    return dashboard.sector_facets(full(spark, d))


def platform_facets(spark, d):
    return dashboard.platform_facets(full(spark, d))


def platform_chips(spark, d):
    rows = trends.platform_summary(posts(spark, d), NOW)
    return rows.select("ticker", F.array_join(dashboard.platform_chips(F.col("platforms")), "|").alias("chips"))


def platform_shares(spark, d):
    rows = dashboard.platform_shares(trends.platform_summary(posts(spark, d), NOW))
    return rows.withColumn("share", F.round("share", 6))


def head_to_head(spark, d):
    return dashboard.head_to_head(core(spark, d))


def union_tickers(spark, d):
    top = core(spark, d).select("ticker", (-F.col("mentions")).alias("rank"))
    flags = backtest.replay_flags(posts(spark, d), NOW, authority=AUTHORITY)
    return merge.union_tickers(top, flags)


def sink_columns(spark, d):
    return merge.sink_columns(full(spark, d)).select("ticker", "name", "mentions", "phase")


def ticker_bundle(spark, d):
    """The JSON bundle per ticker, read back through its own fields."""
    p, px = posts(spark, d), prices(spark, d)
    series = materialize(buckets.bucket_series(p, NOW), "series")
    rows = dashboard.ticker_bundle(core(spark, d), series, px, correlation.correlation(series, px))
    j = lambda path: F.get_json_object("value", path)
    return rows.select(
        "key",
        j("$.trend.mentions").cast("int").alias("mentions"),
        j("$.trend.phase").alias("phase"),
        F.json_array_length(j("$.buckets")).alias("buckets"),
        F.json_array_length(j("$.prices")).alias("prices"),
        j("$.prices[0].open").cast("double").alias("first_open"),
        j("$.correlation.best_lag_hours").cast("int").alias("best_lag_hours"),
    )


def brief_lines(spark, d):
    trend = materialize(full(spark, d), "trends")
    p = posts(spark, d)
    mood = trends.market_mood(p, NOW, authority=AUTHORITY)
    return brief.brief_lines(trend, mood, None, alerts.detect_alerts(trend, NOW), NOW, "demo")


def brief_digest(spark, d):
    text = brief.brief_text(brief_lines(spark, d))
    return text.select(F.length("markdown").alias("chars"), F.size(F.split("markdown", "\n")).alias("lines"))


ALERT_SQL = """
rows_in as (select *, ticker || '@' || k as name from replay),
alerts as (
  select name ticker, 'mention_spike' kind, breakout_score score, '$' || name || ' mention volume is ' || printf('%.1f', round(breakout_score, 1)) || 'σ above its trailing baseline (' || mentions || ' mentions/24h, phase: ' || phase || ').' message
    from rows_in where breakout_score >= 2.0 and mentions >= 10
  union all
  select name, 'bearish_turn', abs(sentiment_avg), '$' || name || ' sentiment has turned decisively bearish (bull:bear ' || printf('%.2f', round(bull_bear_ratio, 2)) || ', avg ' || case when sentiment_avg < 0 then '-' else '+' end || printf('%.2f', abs(round(sentiment_avg, 2))) || ').'
    from rows_in where mentions_prev >= 5 and mentions >= 5 and sentiment_avg <= -0.25 and bull_bear_ratio < 0.6
  union all
  select name, 'bullish_surge', sentiment_avg, '$' || name || ' is seeing a bullish surge (bull:bear ' || printf('%.2f', round(bull_bear_ratio, 2)) || ' on ' || mentions || ' mentions).'
    from rows_in where mentions_prev >= 5 and mentions >= 5 and not (sentiment_avg <= -0.25 and bull_bear_ratio < 0.6)
      and sentiment_avg >= 0.35 and bull_bear_ratio > 3.0 and breakout_score > 1.0
  union all
  select name, 'new_entrant', mentions::double, '$' || name || ' entered the conversation from zero — ' || mentions || ' mentions in the last window.'
    from rows_in where mentions_prev = 0 and mentions >= 8)
"""

ARROW = (
    "case when mentions_prev = 0 then case when mentions <> 0 then 'new' else '—' end "
    "else case when mentions >= mentions_prev then '▲ ' else '▼ ' end || printf('%.0f', round_even(abs((mentions - mentions_prev) / mentions_prev * 100), 0)) || '%' end"
)
BADGE = (
    "case when mentions_prev = 0 then 'new' when abs((mentions - mentions_prev) / mentions_prev * 100) < 1 then '·' "
    "else case when mentions > mentions_prev then '▲ ' else '▼ ' end || printf('%.0f', round(abs((mentions - mentions_prev) / mentions_prev * 100), 0)) || '%' end"
)

MANY = REPLAY_SQL.rstrip() + ",\n" + ALERT_SQL.strip() + "\n"
NOW_CTES = with_ctes(POSTS_SQL, ONE_STEP, TREND_SQL, HISTOGRAM_SQL, TOP_POSTS_SQL, ENTITIES_SQL, MOOD_SQL)
FULL_SQL = (
    NOW_CTES.rstrip()
    + ",\nfull_rows as (select t.*, coalesce(e.name, t.ticker) as name, coalesce(e.sector, 'Other') sector from trends t left join entities e using (ticker))\n"
)

BRIEF_SQL = f"""
em as (select *, row_number() over (order by breakout_score desc, ticker) rank from full_rows where phase = 'emerging' qualify rank <= 5),
fa as (select *, row_number() over (order by breakout_score desc, ticker) rank from full_rows where phase = 'fading' qualify rank <= 3),
vol as (select *, row_number() over (order by mentions desc, ticker) rank from full_rows qualify rank <= 10),
al as (select *, row_number() over (order by score desc, ticker, kind) rank from alerts qualify rank <= 6),
qs as (select ticker, rank from em union all select ticker, rank from vol where rank <= 3 and not exists (select 1 from em)),
lines as (
  select 1 section, -3 pos, '# Market Chatter Brief' line
  union all select 1, -2, '*Generated 2024-01-30 18:00 UTC · window: last 24h · mode: demo*'
  union all select 1, -1, ''
  union all select 2, 0, '## Market mood: ' || (case label when 'extreme greed' then 'Extreme Greed' when 'extreme fear' then 'Extreme Fear' when 'greed' then 'Greed' when 'fear' then 'Fear' else 'Neutral' end) || ' (' || index || '/100)' from labelled_mood
  union all select 2, 1, bull || ' bullish / ' || bear || ' bearish / ' || neutral || ' neutral posts across ' || posts || ' scored posts.' from labelled_mood
  union all select 2, 2, ''
  union all select 2, 3, '## Emerging tickers'
  union all select 3, rank, '- **$' || ticker || '** (' || name || ') — ' || mentions || ' mentions (' || {ARROW} || ' vs prior window), breakout ' || printf('%.1f', round(breakout_score, 1)) || 'σ, bull:bear ' || printf('%.1f', round(bull_bear_ratio, 1)) || '.' from em
  union all select 3, 0, '- Nothing breaking out this window.' where not exists (select 1 from em)
  union all select 4, -2, '' where exists (select 1 from fa)
  union all select 4, -1, '## Fading stories' where exists (select 1 from fa)
  union all select 4, rank, '- **$' || ticker || '** — chatter cooling (' || mentions || ' vs ' || mentions_prev || ' mentions), sentiment ' || case when sentiment_avg < 0 then '-' else '+' end || printf('%.2f', abs(round(sentiment_avg, 2))) || '.' from fa
  union all select 5, -5, '' union all select 5, -4, '## Most discussed' union all select 5, -3, ''
  union all select 5, -2, '| Ticker | Mentions | Δ | Bull:Bear | Sentiment | Phase |'
  union all select 5, -1, '|---|---|---|---|---|---|'
  union all select 5, rank, '| $' || ticker || ' | ' || mentions || ' | ' || {ARROW} || ' | ' || printf('%.1f', round(bull_bear_ratio, 1)) || ' | ' || case when sentiment_avg < 0 then '-' else '+' end || printf('%.2f', abs(round(sentiment_avg, 2))) || ' | ' || phase || ' |' from vol
  union all select 7, -2, '' where exists (select 1 from al)
  union all select 7, -1, '## Unusual activity' where exists (select 1 from al)
  union all select 7, rank, '- ' || message from al
  union all select 8, -2, '' where exists (select 1 from qs)
  union all select 8, -1, '## Voices from the crowd' where exists (select 1 from qs)
  union all select 8, qs.rank, '> "' || p.text || '" — *' || p.author || ' on ' || p.platform || ', $' || qs.ticker || ', ' || p.engagement || ' engagement*' || chr(10)
    from qs join top on top.ticker = qs.ticker and top.rank = 1 join posts p on p.id = top.id
  union all select 9, -3, '' union all select 9, -2, '---'
  union all select 9, -1, '*This brief aggregates public social chatter. Nothing here is financial advice.*')
"""
BRIEF_ALL = (
    FULL_SQL.rstrip() + ",\n" + ALERT_SQL.replace("rows_in as (select *, ticker || '@' || k as name from replay)", "rows_in as (select * exclude (name), ticker as name from full_rows)").strip() + ",\n" + BRIEF_SQL.strip() + "\n"
)

BUNDLE_CTES = with_ctes(POSTS_SQL, PRICES_SQL, ONE_STEP, TREND_SQL, bucket_sql(60, ROLLING_START), ALIGN_SQL, LAG_SQL)

QUERIES = {
    "alert_rules": (alert_rules, MANY + "select *, '2024-01-30 18:00:00' created_at from alerts"),
    "detect_alerts": (detect_alerts, MANY + "select ticker, kind, score from alerts order by score desc, ticker, kind limit 20"),
    "fresh_alerts": (
        fresh_alerts,
        MANY + "select ticker, kind, score from alerts where kind <> 'mention_spike'",
    ),
    "change_arrows": (change_arrows, MANY + f"select name ticker, {ARROW} arrow, {BADGE} badge from rows_in"),
    "sentiment_mix": (
        sentiment_mix,
        MANY
        + "select name ticker, round(bull / greatest(1, bull + bear + neutral), 6) bull_share, round(bear / greatest(1, bull + bear + neutral), 6) bear_share, "
        "round(neutral / greatest(1, bull + bear + neutral), 6) neutral_share from rows_in",
    ),
    "leaderboard": (
        leaderboard,
        FULL_SQL
        + "select ticker, name, sector, phase, mentions, engagement_weighted_score from full_rows f where (contains(lower(ticker), 'company') or contains(lower(name), 'company')) and sector = 'Energy' "
        "and exists (select 1 from hist where hist.ticker = f.ticker and hist.platform = 'click')",
    ),
    "sector_facets": (sector_facets, FULL_SQL + "select distinct sector from full_rows"),
    "platform_facets": (platform_facets, FULL_SQL + "select distinct platform from hist"),
    "platform_chips": (
        platform_chips,
        with_ctes(POSTS_SQL, HISTOGRAM_SQL)
        + "select ticker, string_agg(platform || ' ' || n, '|' order by n desc, platform) chips from (select *, row_number() over (partition by ticker order by n desc, platform) r from hist) where r <= 3 group by 1",
    ),
    "platform_shares": (
        platform_shares,
        with_ctes(POSTS_SQL, HISTOGRAM_SQL) + "select ticker, platform, n, round(n / sum(n) over (partition by ticker), 6) share from hist",
    ),
    "head_to_head": (
        head_to_head,
        NOW_CTES.rstrip()
        + ",\npair as (select *, row_number() over (order by mentions desc, ticker) r from trends qualify r <= 2),\n"
        + "long as ("
        + " union all ".join(
            f"select r, '{m}' metric, {m}::double v from pair"
            for m in ("mentions", "velocity", "breakout_score", "bull_bear_ratio", "share_of_voice", "engagement_weighted_score")
        )
        + ") select metric, max(v) filter (where r = 1) a, max(v) filter (where r = 2) b from long group by metric",
    ),
    "union_tickers": (
        union_tickers,
        MANY
        + "select distinct ticker from (select ticker from replay where k = 0 union all select ticker from replay where phase = 'emerging' and breakout_score >= 1.5)",
    ),
    "sink_columns": (sink_columns, FULL_SQL + "select ticker, name, mentions, phase from full_rows"),
    "ticker_bundle": (
        ticker_bundle,
        BUNDLE_CTES
        + "select 'ticker:' || t.ticker as key, t.mentions, t.phase, 168 buckets, (select count(*) from prices p where p.ticker = t.ticker)::int prices, "
        "(select arg_min(p.open, p.ts) from prices p where p.ticker = t.ticker) first_open, best_lag_hours from trends t join leads using (ticker)",
    ),
    "brief_lines": (brief_lines, BRIEF_ALL + "select section, pos, line from lines"),
    "brief_digest": (
        brief_digest,
        BRIEF_ALL + "select length(t) chars, len(string_split(t, chr(10))) as lines from (select string_agg(line, chr(10) order by section, pos) t from lines)",
    ),
}
