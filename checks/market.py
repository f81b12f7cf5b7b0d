"""Prices: alignment, lag profile, as-of join, replay and back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import AUTHORITY, ENTITIES_SQL, NOW, NOW_SQL, POSTS_SQL, PRICES_SQL, entities, posts, prices, ts_text, with_ctes
from checks.trends import REPLAY_STEPS, ROLLING_START, TREND_SQL, bucket_sql
from murmur.operators import asof, backtest, buckets, correlation, dashboard, trends
from murmur.session import materialize


def _buckets(spark, d):
    """The bucket table; small next to the posts and read several times, so it is written out."""
    return materialize(buckets.bucket_series(posts(spark, d), NOW), "series")


def _aligned(spark, d):
    return correlation.align_series(_buckets(spark, d), prices(spark, d))


def aligned_series(spark, d):
    return _aligned(spark, d).withColumn("ts", ts_text("ts"))


def lag_profile(spark, d):
    return correlation.lag_profile(_aligned(spark, d))


def lead_lag(spark, d):
    return correlation.correlation(_buckets(spark, d), prices(spark, d)).select(
        "ticker", "pearson_r", "best_lag_hours", "best_lag_r", "readout", F.size("series").alias("series_rows")
    )


ALIGN_SQL = """
span as (select ticker, min(bucket_start) lo, max(bucket_start) hi from buckets group by ticker),
covered as (select p.ticker, p.ts, p.open, p.close, p.volume from prices p join span s on s.ticker = p.ticker and p.ts between s.lo and s.hi),
lagged as (select *, coalesce(lag(close) over (partition by ticker order by ts), open) prev from covered),
aligned as (select l.ticker, l.ts, l.close, l.volume,
      round(case when prev = 0 then 0.0 else (l.close - prev) / prev end, 6) as "return",
      round(abs(case when prev = 0 then 0.0 else (l.close - prev) / prev end), 6) abs_return,
      coalesce(b.mentions, 0) mentions, b.sentiment_avg
    from lagged l left join buckets b on b.ticker = l.ticker and b.bucket_start = l.ts)
"""

LAG_SQL = """
numbered as (select ticker, row_number() over (partition by ticker order by ts) rn, mentions, abs_return from aligned
   where ticker in (select ticker from aligned group by ticker having count(*) >= 24 and sum(mentions) > 0)),
lags as (select range::int - 12 lag from range(25)),
pairs as (select a.ticker, l.lag, a.mentions::double x, b.abs_return y from numbered a cross join lags l
    join numbered b on b.ticker = a.ticker and b.rn = a.rn + l.lag),
profile as (select ticker, lag, round(case when count(*) >= 8 and var_pop(x) > 0 and var_pop(y) > 0
      then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) else 0.0 end, 4) r from pairs group by 1, 2),
folded as (select ticker, list_reduce(list({'lag': lag, 'r': r} order by abs(lag), lag), lambda acc, x: case when x.r > acc.r + 0.02 then x else acc end) best,
      max(r) filter (where lag = 0) pearson_r from profile group by ticker),
leads as (select a.ticker, coalesce(pearson_r, 0.0) pearson_r, coalesce(best.lag, 0) best_lag_hours, coalesce(best.r, 0.0) best_lag_r
      from (select distinct ticker from aligned) a left join folded using (ticker))
"""

READOUT_SQL = """
case when abs(best_lag_r) < 0.15 then 'No meaningful buzz-move relationship for ' || ticker || ' in this window.'
 when best_lag_hours > 0 then 'Chatter tends to LEAD price moves by ~' || best_lag_hours || 'h (' || strength || ', r=' || case when best_lag_r < 0 then '-' else '' end || printf('%.2f', abs(round(best_lag_r, 2))) || ') — social buzz has been an early signal for ' || ticker || '.'
 when best_lag_hours < 0 then 'Chatter tends to FOLLOW price moves by ~' || (-best_lag_hours) || 'h (' || strength || ', r=' || case when best_lag_r < 0 then '-' else '' end || printf('%.2f', abs(round(best_lag_r, 2))) || ') — the crowd is reacting to ' || ticker || '''s tape, not predicting it.'
 else 'Buzz and price moves are concurrent for ' || ticker || ' (' || strength || ', r=' || case when pearson_r < 0 then '-' else '' end || printf('%.2f', abs(round(pearson_r, 2))) || ').' end
"""

MARKET_SQL = with_ctes(POSTS_SQL, PRICES_SQL, bucket_sql(60, ROLLING_START), ALIGN_SQL, LAG_SQL)


def asof_prices(spark, d):
    """The last close within 30 hours for every mention."""
    m = trends.mentions(posts(spark, d), "id", "ts")
    p = prices(spark, d).withColumn("price_ts", F.col("ts"))
    joined = asof.asof_join(m, p, "ticker", "ts", "ts", ["close", "price_ts"], 30.0)
    return joined.select("id", "ticker", "close", ts_text("price_ts").alias("price_ts"))


def asof_prices_tight(spark, d):
    """Same with a tolerance of two hours, where many mentions find nothing."""
    m = trends.mentions(posts(spark, d), "id", "ts")
    joined = asof.asof_join(m, prices(spark, d), "ticker", "ts", "ts", ["close"], 2.0, cell_hours=1)
    return joined.groupBy("ticker").agg(
        F.count("*").alias("mentions"), F.count("close").alias("priced"), F.round(F.sum("close"), 4).alias("close_sum")
    )


def _asof_sql(hours: int) -> str:
    return (
        f"hits as (select m.id, m.ticker, case when m.ts - p.ts <= interval {hours} hour then p.close end as close, "
        f"case when m.ts - p.ts <= interval {hours} hour then p.ts end price_ts "
        "from (select * from mentions) m asof left join prices p on m.ticker = p.ticker and m.ts >= p.ts)"
    )


def replay_trends(spark, d):
    return backtest.replay_trends(posts(spark, d), NOW, authority=AUTHORITY).select(
        ts_text("as_of").alias("as_of"), "ticker", "mentions", "mentions_prev", "breakout_score", "phase", "sentiment_avg", "bull_bear_ratio"
    )


def _flags(spark, d, floor=backtest.BREAKOUT_FLOOR):
    return backtest.replay_flags(posts(spark, d), NOW, authority=AUTHORITY)


def replay_flags(spark, d):
    return _flags(spark, d).withColumn("flagged_at", ts_text("flagged_at"))


def flareup_suppression(spark, d):
    """The cool-down over every replay row that was breaking out at all (a denser input)."""
    rows = backtest.replay_trends(posts(spark, d), NOW, authority=AUTHORITY).filter("breakout_score > 0")
    kept = backtest.suppress_flareups(rows.select("ticker", F.col("as_of").alias("flagged_at"), "breakout_score"))
    return kept.withColumn("flagged_at", ts_text("flagged_at"))


def _returns(spark, d):
    """Forward returns of every replay row that was breaking out, so that all horizons fill."""
    rows = backtest.replay_trends(posts(spark, d), NOW, authority=AUTHORITY).filter("breakout_score > 0")
    events = rows.select("ticker", F.col("as_of").alias("flagged_at"), "breakout_score", "mentions", "sentiment_avg", "bull_bear_ratio")
    return backtest.forward_returns(events, prices(spark, d))


def forward_returns(spark, d):
    return _returns(spark, d).select("ticker", ts_text("flagged_at").alias("flagged_at"), "horizon", "ret")


def backtest_summary(spark, d):
    return backtest.summarize(_returns(spark, d))


def flag_summary(spark, d):
    return backtest.summarize(backtest.forward_returns(_flags(spark, d), prices(spark, d)))


def event_log(spark, d):
    return backtest.event_log(_returns(spark, d), entities=entities(spark)).withColumn("flagged_at", ts_text("flagged_at"))


def newest_events(spark, d):
    return backtest.newest_events(backtest.event_log(_returns(spark, d))).select("ticker", ts_text("flagged_at").alias("flagged_at"))


REPLAY_SQL = with_ctes(
    POSTS_SQL, REPLAY_STEPS, TREND_SQL, PRICES_SQL,
    """
enough as (select s.k from steps s join posts p on p.ts <= s.as_of group by s.k having count(*) >= 50),
replay as (select * from trends where k in (select k from enough)),
last_candle as (select ticker, max(ts) last_ts from prices group by ticker)
""",
)

COOLDOWN_SQL = """
kept_{name} as (select ticker, unnest(list_reduce(list_transform(list(as_of order by as_of), lambda x: [x]),
      lambda acc, x: case when x[1] - acc[len(acc)] >= interval 24 hour then list_concat(acc, x) else acc end)) flagged_at
      from {source} group by ticker)
"""

RETURNS_SQL = """
pts as (select e.ticker, e.flagged_at, h.horizon, e.flagged_at + h.horizon * interval 1 hour as at
        from events_in e cross join (select unnest([0, 4, 24, 48]) horizon) h),
px as (select pts.*, case when pts.at - p.ts <= interval 30 hour then p.close end px
       from pts asof left join prices p on pts.ticker = p.ticker and pts.at >= p.ts),
rets as (select f.ticker, f.flagged_at, f.horizon,
        case when last_ts >= f.at - interval 15 hour and b.px <> 0 then round((f.px / b.px - 1) * 100, 3) end ret
      from px f join px b on b.ticker = f.ticker and b.flagged_at = f.flagged_at and b.horizon = 0
      left join last_candle l on l.ticker = f.ticker where f.horizon > 0),
summary as (select h.horizon, count(ret) n, count(ret) filter (where abs(ret) <= 1e-9) flat,
        round(count(ret) filter (where ret > 1e-9) / nullif(count(ret) filter (where abs(ret) > 1e-9), 0), 3) win_rate,
        round(round(sum(ret), 6) / nullif(count(ret), 0), 3) as avg, round(median(ret), 3) median
      from (select unnest([4, 24, 48]) horizon) h left join rets using (horizon) group by h.horizon)
"""

FLAGS_SQL = "flags as (select * from replay where phase = 'emerging' and breakout_score >= 1.5)"
HOT_SQL = "hot as (select * from replay where breakout_score > 0)"


def _replay(*parts: str) -> str:
    return REPLAY_SQL.rstrip() + ",\n" + ",\n".join(p.strip() for p in parts) + "\n"


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') {0}"


def rebased_pair(spark, d):
    """Closes of the two most mentioned tickers on their common clock, rebased to percent."""
    pair = dashboard.matchup(trends.core_trends(posts(spark, d), NOW))
    rows = dashboard.rebase(dashboard.pair_series(prices(spark, d), pair, "close"))
    return rows.select(ts_text("ts").alias("ts"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def joined_series(spark, d):
    """The closes of two tickers through the two-frame form of the alignment."""
    p, pair = prices(spark, d), dashboard.matchup(trends.core_trends(posts(spark, d), NOW))
    a, b = (p.join(pair.filter(F.col("side") == x), "ticker", "left_semi") for x in ("a", "b"))
    return dashboard.join_series(a, b, "close").withColumn("ts", ts_text("ts"))


PAIR_SQL = with_ctes(POSTS_SQL, PRICES_SQL, f"""
busy as (select ticker, row_number() over (order by count(*) desc, ticker) r from mentions where ts >= {NOW_SQL} - interval 24 hour group by ticker),
pair as (select coalesce(a.ts, b.ts) ts, a.close a, b.close b from (select * from prices where ticker = (select ticker from busy where r = 1)) a
  full join (select * from prices where ticker = (select ticker from busy where r = 2)) b on a.ts = b.ts),
bases as (select arg_min(a, ts) filter (where a is not null) ba, arg_min(b, ts) filter (where b is not null) bb from pair)
""")

QUERIES = {
    "aligned_series": (aligned_series, MARKET_SQL + "select * replace (strftime(ts, '%Y-%m-%d %H:%M:%S') as ts) from aligned"),
    "lag_profile": (lag_profile, MARKET_SQL + "select * from profile"),
    "lead_lag": (
        lead_lag,
        MARKET_SQL
        + f"select ticker, pearson_r, best_lag_hours, best_lag_r, {READOUT_SQL} readout, (select least(168, count(*)) from aligned a where a.ticker = s.ticker) series_rows "
        "from (select *, case when abs(best_lag_r) >= 0.5 then 'strong' when abs(best_lag_r) >= 0.3 then 'moderate' else 'weak' end strength from leads) s",
    ),
    "asof_prices": (
        asof_prices,
        with_ctes(POSTS_SQL, PRICES_SQL, _asof_sql(30)) + "select id, ticker, close, strftime(price_ts, '%Y-%m-%d %H:%M:%S') price_ts from hits",
    ),
    "asof_prices_tight": (
        asof_prices_tight,
        with_ctes(POSTS_SQL, PRICES_SQL, _asof_sql(2)) + "select ticker, count(*) mentions, count(close) priced, round(sum(close), 4) close_sum from hits group by ticker",
    ),
    "replay_trends": (
        replay_trends,
        _replay(FLAGS_SQL)
        + "select strftime(as_of, '%Y-%m-%d %H:%M:%S') as_of, ticker, mentions, mentions_prev, breakout_score, phase, sentiment_avg, bull_bear_ratio from replay",
    ),
    "replay_flags": (
        replay_flags,
        _replay(FLAGS_SQL, COOLDOWN_SQL.format(name="flags", source="flags"))
        + f"select k.ticker, {STAMP.format('flagged_at')}, breakout_score, mentions, sentiment_avg, bull_bear_ratio from kept_flags k join flags f on f.ticker = k.ticker and f.as_of = k.flagged_at",
    ),
    "flareup_suppression": (
        flareup_suppression,
        _replay(HOT_SQL, COOLDOWN_SQL.format(name="hot", source="hot"))
        + f"select k.ticker, {STAMP.format('flagged_at')}, breakout_score from kept_hot k join hot f on f.ticker = k.ticker and f.as_of = k.flagged_at",
    ),
    "forward_returns": (
        forward_returns,
        _replay(HOT_SQL, "events_in as (select *, as_of flagged_at from hot)", RETURNS_SQL)
        + f"select ticker, {STAMP.format('flagged_at')}, horizon, ret from rets",
    ),
    "backtest_summary": (
        backtest_summary,
        _replay(HOT_SQL, "events_in as (select *, as_of flagged_at from hot)", RETURNS_SQL) + "select * from summary",
    ),
    "flag_summary": (
        flag_summary,
        _replay(FLAGS_SQL, COOLDOWN_SQL.format(name="flags", source="flags"), "events_in as (select * from kept_flags)", RETURNS_SQL)
        + "select * from summary",
    ),
    "event_log": (
        event_log,
        _replay(HOT_SQL, ENTITIES_SQL, "events_in as (select *, as_of flagged_at from hot)", RETURNS_SQL)
        + f"select e.ticker, strftime(e.flagged_at, '%Y-%m-%d %H:%M:%S') flagged_at, breakout_score, mentions, sentiment_avg, bull_bear_ratio, "
        "max(ret) filter (where horizon = 4) ret_4h, max(ret) filter (where horizon = 24) ret_24h, max(ret) filter (where horizon = 48) ret_48h, coalesce(n.name, e.ticker) as name "
        "from events_in e join rets r on r.ticker = e.ticker and r.flagged_at = e.flagged_at left join entities n on n.ticker = e.ticker group by all",
    ),
    "newest_events": (
        newest_events,
        _replay(HOT_SQL) + f"select ticker, strftime(as_of, '%Y-%m-%d %H:%M:%S') flagged_at from hot order by as_of desc, ticker limit 60",
    ),
    "rebased_pair": (
        rebased_pair,
        PAIR_SQL
        + "select strftime(ts, '%Y-%m-%d %H:%M:%S') ts, round((a / nullif(ba, 0) - 1) * 100, 6) a, round((b / nullif(bb, 0) - 1) * 100, 6) b from pair, bases",
    ),
    "joined_series": (joined_series, PAIR_SQL + "select strftime(ts, '%Y-%m-%d %H:%M:%S') ts, a, b from pair"),
}
