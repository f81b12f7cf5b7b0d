"""The whole batch run: tag, score, store, measure, publish."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.exprs import ts_lit
from murmur.operators import alerts as alerting
from murmur.operators import backtest, brief, buckets, correlation, dashboard, graph, topics, trends
from murmur.operators.dedup import collapse_near_duplicates, dedupe_posts
from murmur.operators.entities import tag_posts
from murmur.operators.merge import sink_columns
from murmur.operators.sentiment import score_posts_lexicon
from murmur.session import materialize
from murmur.sinks import archive, artifacts, tables
from murmur.sinks.storage import exists
from murmur.sources.dictionary import Dictionary
from murmur.sources.scans import load_recent_posts


@dataclass(frozen=True)
class BatchConfig:
    window_hours: int = 24
    history_hours: int = 168
    bucket_minutes: int = 60
    top_n: int | None = None  # tickers whose series are kept; all above the floor by default
    retention_days: int = 30
    topic_clusters: int = 12
    with_topics: bool = True
    mode: str = "live"


def ingest(raw_posts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Unique, tagged and scored posts."""
    return score_posts_lexicon(tag_posts(dedupe_posts(raw_posts), dictionary))


def run(spark: SparkSession, raw_posts: DataFrame, prices: DataFrame, dictionary: Dictionary, now: datetime, root: str, cfg: BatchConfig = BatchConfig()) -> dict[str, str]:
    """Run everything and write the tables below ``root``; returns their paths.

    Tagging and scoring happen once per post, before the store. The collapsed window
    feeds every metric and is therefore written out once, not cached.
    """
    path = {n: f"{root}/{n}" for n in (
        "posts", "ticker_buckets", "ticker_trends", "correlations", "alerts", "fresh_alerts", "graph_nodes", "graph_edges",
        "topics", "topic_points", "backtest", "meta", "archive",
    )}
    entities = dictionary.entities(spark)
    tables.merge_posts(path["posts"], materialize(ingest(raw_posts, dictionary), "incoming"))

    recent = load_recent_posts(tables.read_days(spark, path["posts"]), now, cfg.history_hours)
    posts = materialize(collapse_near_duplicates(recent), "window")

    trend = materialize(trends.ticker_trends(posts, entities, now, cfg.window_hours, cfg.history_hours), "trends")
    tables.write_snapshot(sink_columns(trend), path["ticker_trends"])
    top = trend if cfg.top_n is None else trends.top_tickers(trend, cfg.top_n)

    raised = materialize(alerting.alert_candidates(trend, now), "raised")
    before = spark.read.parquet(path["alerts"]) if exists(spark, path["alerts"]) else raised.limit(0)
    tables.write_snapshot(alerting.fresh_alerts(raised, before), path["fresh_alerts"])
    tables.write_snapshot(raised, path["alerts"])
    nodes, edges = graph.compute_graph(posts, entities)
    tables.write_snapshot(nodes, path["graph_nodes"])
    tables.write_snapshot(edges, path["graph_edges"])

    flags = backtest.replay_flags(posts, now, window_hours=cfg.window_hours, history_hours=cfg.history_hours)
    returns = materialize(backtest.forward_returns(flags, prices), "returns")
    log = materialize(backtest.event_log(returns, entities=entities), "event-log")
    tables.write_snapshot(log, path["backtest"])

    series = materialize(buckets.bucket_series(posts, now, cfg.bucket_minutes, cfg.history_hours, top), "series")
    corr = materialize(correlation.correlation(series, prices), "correlations")
    tables.write_snapshot(corr, path["correlations"])
    tables.merge_buckets(path["ticker_buckets"], buckets.aligned_bucket_series(posts, now, cfg.bucket_minutes, cfg.history_hours, top))

    topic_rows = None
    if cfg.with_topics:
        result = topics.compute_topics(posts, now, cfg.topic_clusters)
        if result:
            topic_rows = materialize(result[0], "topics")
            tables.write_snapshot(topic_rows, path["topics"])
            tables.write_snapshot(result[1], path["topic_points"])

    stored_buckets = tables.read_days(spark, path["ticker_buckets"]).drop("day")
    archive.archive_buckets(stored_buckets, now, f"{path['archive']}/ticker_buckets")
    archive.archive_trends(sink_columns(trend), now, f"{path['archive']}/ticker_trends")
    archive.archive_author_daily(tables.read_days(spark, path["posts"]), now, f"{path['archive']}/author_daily")
    tables.prune_days(spark, path["posts"], "ts", now, cfg.retention_days)
    tables.prune_days(spark, path["ticker_buckets"], "bucket_start", now, cfg.retention_days)

    mood = trends.market_mood(posts, now, cfg.window_hours)
    text = brief.brief_text(brief.brief_lines(trend, mood, topic_rows, raised, now, cfg.mode, cfg.window_hours))
    summary = trends.run_summary(posts, now, cfg.window_hours, cfg.mode, "lexicon", "tfidf" if topic_rows else "skipped")
    payloads = (
        artifacts.payload_rows(summary, F.lit("meta"))
        .unionByName(artifacts.list_payload(alerting.detect_alerts(trend, now), "alerts", "alerts", ["ticker", "kind"]))
        .unionByName(artifacts.list_payload(backtest.summarize(returns), "backtest", "horizons", ["horizon"]))
        .unionByName(artifacts.list_payload(backtest.newest_events(log), "backtest_events", "events", ["flagged_at", "ticker"]))
        .unionByName(artifacts.payload_rows(text, F.lit("brief")))
        .unionByName(dashboard.ticker_bundle(top, series, prices, corr))
    )
    tables.merge_meta(path["meta"], payloads.withColumn("updated_at", ts_lit(now)))
    return path
