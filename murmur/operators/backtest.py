"""Replay of past flags and their forward returns."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import fixed_values as fv
from murmur.functions.exprs import HOUR_US, floor_div, micros, round_to, to_utc, ts_lit
from murmur.operators.asof import asof_join
from murmur.operators.trends import cell_sums, derive_metrics, full_hours_ago, hours_ago, mentions, window_stats
from murmur.sources.dictionary import enrich_entities

HORIZONS = (4, 24, 48)
BREAKOUT_FLOOR = 1.5
MAX_CANDLE_GAP_H = 30.0
MIN_VISIBLE = 50
COOLDOWN_H = 24


def n_steps(window_hours: int, step_hours: int, history_hours: int) -> int:
    return max(0, (history_hours - window_hours) // step_hours)


def visible_counts(posts: DataFrame, now: datetime, steps: int, step_hours: int) -> DataFrame:
    """Posts visible at each step ``k`` (as of ``now - k*step``)."""
    age = floor_div(F.lit(micros(now)) - F.unix_micros("ts"), step_hours * HOUR_US)
    by_step = (
        posts.filter(F.col("ts") <= ts_lit(now))
        .groupBy(F.least(age, F.lit(steps)).cast("int").alias("latest"))
        .agg(F.count("*").alias("n"))
    )
    return by_step.select(F.explode(F.sequence(F.lit(0), "latest")).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("visible"))


def replay_trends(
    posts: DataFrame,
    now: datetime,
    window_hours: int = 24,
    step_hours: int = 6,
    history_hours: int = 168,
    min_mentions: int = 3,
    authority=fv.PLATFORM_AUTHORITY,
) -> DataFrame:
    """The trend row of every ticker as of every step, in one job.

    Posts shrink to cells (ticker, hours ago, last step that sees them) first; only
    the cells are repeated for the steps that see them. A post exactly on a step's
    clock is visible to it, which is why the cell also carries that step.
    """
    steps = n_steps(window_hours, step_hours, history_hours)
    reach = steps * step_hours + max(history_hours, 2 * window_hours)
    span = posts.filter((F.col("ts") <= ts_lit(now)) & (F.col("ts") >= ts_lit(to_utc(now) - timedelta(hours=reach))))
    cells = (
        mentions(span, "ts", "platform", "engagement", "sentiment", "sentiment_score")
        .withColumn("c", hours_ago(now))
        .withColumn("k_max", F.least(floor_div(full_hours_ago(now), step_hours), F.lit(steps)).cast("int"))
        .groupBy("ticker", "c", "k_max")
        .agg(*cell_sums(authority))
    )
    seen = (
        cells.withColumn("k", F.explode(F.sequence(F.lit(0), "k_max")))
        .withColumn("a", F.greatest(F.col("c") - F.col("k") * step_hours, F.lit(1)))
        .filter(F.col("a") <= max(history_hours, 2 * window_hours))
    )
    stats = window_stats(seen, ["k", "ticker"], window_hours, history_hours)
    as_of = F.timestamp_micros(F.lit(micros(now)) - F.col("k").cast("long") * (step_hours * HOUR_US))
    enough = visible_counts(posts, now, steps, step_hours).filter(F.col("visible") >= MIN_VISIBLE).select("k")
    return (
        derive_metrics(stats, window_hours, history_hours)
        .filter(F.col("mentions") >= min_mentions)
        .join(enough, "k", "left_semi")
        .withColumn("as_of", as_of)
    )


def candidate_flags(trends: DataFrame, floor: float = BREAKOUT_FLOOR) -> DataFrame:
    """Emerging rows whose rounded breakout reaches the floor."""
    return trends.filter((F.col("phase") == "emerging") & (F.col("breakout_score") >= floor)).select(
        "ticker", F.col("as_of").alias("flagged_at"), "breakout_score", "mentions", "sentiment_avg", "bull_bear_ratio"
    )


def suppress_flareups(flags: DataFrame, cooldown_hours: int = COOLDOWN_H) -> DataFrame:
    """Keep a flag only when the ticker's last kept flag is at least the cooldown away.

    Greedy in time order. A ticker has at most one candidate per replay step, so the
    folded list is short.
    """
    fields = [c for c in flags.columns if c != "ticker"]
    ordered = ["flagged_at"] + [c for c in fields if c != "flagged_at"]
    packed = flags.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias("f"))
    gap_us = cooldown_hours * HOUR_US

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)["flagged_at"]
        fresh = (F.size(kept) == 0) | (F.unix_micros(x["flagged_at"]) - F.unix_micros(last) >= gap_us)
        return F.when(fresh, F.concat(kept, F.array(x))).otherwise(kept)

    first = F.slice("f", 1, 1)
    kept = F.aggregate(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), first, step)
    return packed.select("ticker", F.explode(kept).alias("e")).select("ticker", *[f"e.{c}" for c in fields])


def replay_flags(posts: DataFrame, now: datetime, **kwargs) -> DataFrame:
    """Flag events of the replay."""
    return suppress_flareups(candidate_flags(replay_trends(posts, now, **kwargs)))


def forward_returns(
    events: DataFrame,
    prices: DataFrame,
    horizons: tuple[int, ...] = HORIZONS,
    max_gap_hours: float = MAX_CANDLE_GAP_H,
) -> DataFrame:
    """One row per (event, horizon) with the return in percent.

    The base price and every horizon price come from a single as-of join. A return is
    null without a base price, or when the candles end more than half the gap before
    the target.
    """
    keys = ["ticker", "flagged_at"]
    offsets = F.array(F.lit(0), *[F.lit(h) for h in horizons])
    points = events.select(*keys, F.explode(offsets).alias("h")).withColumn(
        "at", F.timestamp_micros(F.unix_micros("flagged_at") + F.col("h").cast("long") * HOUR_US)
    )
    priced = asof_join(points, prices.select("ticker", "ts", "close"), "ticker", "at", "ts", ["close"], max_gap_hours)
    last = prices.groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    per_event = priced.groupBy(*keys).agg(
        F.max(F.when(F.col("h") == 0, F.col("close"))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("h") > 0, F.struct("h", "at", "close")))).alias("points"),
    )
    slack = int(max_gap_hours / 2 * HOUR_US)
    # A zero base price counts as missing.
    ret = round_to((F.try_divide(F.col("p.close"), F.nullif("base", F.lit(0.0))) - 1) * 100, 3)
    elapsed = F.unix_micros("last_ts") >= F.unix_micros("p.at") - slack
    scored = (
        per_event.join(last, "ticker", "left")
        .select(*keys, "base", "last_ts", F.explode("points").alias("p"))
        .select(*keys, F.col("p.h").alias("horizon"), F.when(elapsed, ret).alias("ret"))
    )
    return events.join(scored, keys)


def summarize(returns: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Outcome per horizon; horizons without any return stay with nulls.

    Equal returns are counted first, so the exact median works on distinct values.
    """
    spark = returns.sparkSession
    frame = spark.createDataFrame([(h,) for h in horizons], "horizon int")
    counted = returns.filter(F.col("ret").isNotNull()).groupBy("horizon", "ret").agg(F.count("*").alias("c"))
    moved, up = F.abs("ret") > 1e-9, F.col("ret") > 1e-9
    total = F.sum("c")
    moved_n = F.coalesce(F.sum(F.when(moved, F.col("c"))), F.lit(0))
    up_n = F.coalesce(F.sum(F.when(up, F.col("c"))), F.lit(0))
    stats = counted.groupBy("horizon").agg(
        total.alias("n"),
        (total - moved_n).alias("flat"),
        round_to(F.try_divide(up_n, moved_n), 3).alias("win_rate"),
        round_to(round_to(F.sum(F.col("ret") * F.col("c")), 6) / total, 3).alias("avg"),
        round_to(F.percentile("ret", 0.5, F.col("c")), 3).alias("median"),
    )
    return frame.join(stats, "horizon", "left").select(
        "horizon",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("flat", F.lit(0)).alias("flat"),
        "win_rate",
        "avg",
        "median",
    )


def event_log(returns: DataFrame, horizons: tuple[int, ...] = HORIZONS, entities: DataFrame | None = None) -> DataFrame:
    """All events, one column per horizon; with ``entities`` also the ticker's ``name``."""
    keys = ["ticker", "flagged_at", "breakout_score", "mentions", "sentiment_avg", "bull_bear_ratio"]
    wide = returns.groupBy(*keys).pivot("horizon", list(horizons)).agg(F.max("ret"))
    for h in horizons:
        wide = wide.withColumnRenamed(str(h), f"ret_{h}h")
    return wide if entities is None else enrich_entities(wide, entities).drop("sector")


def newest_events(log: DataFrame, n: int = 60) -> DataFrame:
    """The newest events first, as they are shown; a read step over the stored log."""
    return log.orderBy(F.col("flagged_at").desc(), "ticker").limit(n)
