"""Merges, retention, archive and the streaming twins, through real tables."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import functions as F

from checks.binding import AUTHORITY, EVENTS, NOW, NOW_SQL, POSTS_SQL, all_posts, posts, posts_from, table, ts_text, with_ctes
from checks.market import COOLDOWN_SQL, HOT_SQL, _replay
from checks.reads import ALERT_SQL
from checks.trends import ALIGNED_START, ROLLING_START, bucket_sql
from murmur.functions.exprs import map_text
from murmur.operators import alerts, backtest, buckets, merge
from murmur.session import materialize, scratch_path
from murmur.sinks import archive, artifacts, tables
from murmur.streaming import ingest

DAY = 86_400
BUCKETS = 2  # a day of the test posts is small


def _stored_and_fetched(spark, d):
    """Posts already stored, and a later fetch that overlaps them with other values."""
    p = all_posts(spark, d).drop("k")
    cut = F.lit(NOW) - F.expr("interval 24 hours")
    stored = p.filter(F.col("ts") < cut)
    fetched = p.filter(F.col("ts") >= F.lit(NOW) - F.expr("interval 72 hours")).select(
        *[
            {"engagement": (F.lit(40) - F.col("engagement")).alias("engagement"), "sentiment": F.lit("neutral").alias("sentiment"),
             "author": F.lit("renamed").alias("author"), "sentiment_score": F.lit(0.0).alias("sentiment_score")}.get(c, F.col(c))
            for c in p.columns
        ]
    )
    return stored, fetched


def _post_out(df):
    return df.select("id", "author", "engagement", "sentiment", "sentiment_score", ts_text("ts").alias("ts"))


def upsert_posts(spark, d):
    return _post_out(merge.upsert_posts(*_stored_and_fetched(spark, d)))


def stored_posts(spark, d):
    """The same merge through the day-partitioned table, run twice."""
    path = scratch_path(spark, "posts")
    stored, fetched = _stored_and_fetched(spark, d)
    tables.merge_posts(path, stored, BUCKETS)
    tables.merge_posts(path, fetched, BUCKETS)
    tables.merge_posts(path, fetched, BUCKETS)
    return _post_out(tables.read_days(spark, path))


def stored_buckets(spark, d):
    """Hour-aligned buckets of two runs a day apart."""
    path = scratch_path(spark, "buckets")
    p = posts(spark, d)
    yesterday = NOW.replace(day=29)
    tables.merge_buckets(path, buckets.aligned_bucket_series(p.filter(F.col("ts") <= F.lit(yesterday)), yesterday), BUCKETS)
    tables.merge_buckets(path, buckets.aligned_bucket_series(p, NOW), BUCKETS)
    rows = tables.read_days(spark, path).filter(F.col("bucket_start") >= F.lit(NOW) - F.expr("interval 167 hours"))
    return rows.select("ticker", ts_text("bucket_start").alias("bucket_start"), "mentions", "engagement", "sentiment_avg", map_text(F.col("platforms")).alias("platforms"))


def stored_payloads(spark, d):
    path = scratch_path(spark, "meta")
    p = all_posts(spark, d)
    first = p.groupBy(F.col("author").alias("key")).agg(F.count("*").cast("string").alias("value")).withColumn("updated_at", F.lit(NOW))
    second = p.filter(F.col("platform") == "click").groupBy(F.col("author").alias("key")).agg(F.sum("engagement").cast("string").alias("value")).withColumn("updated_at", F.lit(NOW))
    tables.merge_meta(path, first, BUCKETS)
    tables.merge_meta(path, second, BUCKETS)
    return tables.read_days(spark, path).select("key", "value")


def snapshot_replace(spark, d):
    path = scratch_path(spark, "snapshot")
    p = all_posts(spark, d)
    tables.write_snapshot(p.select("id"), path)
    tables.write_snapshot(p.groupBy("platform").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


def prune_report(spark, d):
    p = all_posts(spark, d)
    return merge.prune_report({"posts": (p, "ts"), "events": (table(spark, d, "events"), "ts")}, NOW, days=7)


def pruned_posts(spark, d):
    path = scratch_path(spark, "posts")
    tables.merge_posts(path, all_posts(spark, d).drop("k"), BUCKETS)
    tables.prune_days(spark, path, "ts", NOW, days=7)
    return tables.read_days(spark, path).groupBy("platform").agg(F.count("*").alias("n"), F.min(ts_text("ts")).alias("oldest"))


def author_daily(spark, d):
    return archive.author_daily(all_posts(spark, d), NOW).withColumn("day", F.col("day").cast("string"))


def archived_buckets(spark, d):
    """Archive twice; the second run must not change archived days."""
    path = scratch_path(spark, "archive")
    series = buckets.bucket_series(posts(spark, d), NOW)
    archive.archive_buckets(series, NOW, path)
    archive.archive_buckets(series.withColumn("mentions", F.lit(999).cast("bigint")), NOW, path)
    rows = archive.read_archive(spark, path, "ticker string, bucket_start string, mentions bigint")
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"), F.sum("mentions").alias("mentions"))


def archived_authors(spark, d):
    path = scratch_path(spark, "archive")
    archive.archive_author_daily(all_posts(spark, d), NOW, path)
    rows = archive.read_archive(spark, path, "author string, platform string, ticker string, posts bigint, sentiment_avg double")
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"), F.sum("posts").alias("posts"))


def archived_trends(spark, d):
    path = scratch_path(spark, "archive")
    counts = all_posts(spark, d).select(F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.count("*").alias("mentions"))
    archive.archive_trends(counts, NOW, path)
    archive.archive_trends(counts.withColumn("mentions", F.lit(0).cast("bigint")), NOW, path)
    rows = archive.read_archive(spark, path, "ticker string, mentions bigint")
    return rows.withColumn("day", F.col("day").cast("string"))


def unarchived_days(spark, d):
    p = all_posts(spark, d).select(F.to_date("ts").alias("day"), "engagement")
    have = p.filter(F.col("day") < F.lit("2024-01-20").cast("date")).select("day")
    rows = archive.day_report(archive.unarchived(p, have))
    return rows.withColumn("day", F.col("day").cast("string"))


def json_artifacts(spark, d):
    path = scratch_path(spark, "artifacts")
    p = all_posts(spark, d).groupBy("platform").agg(F.count("*").alias("posts"), F.sum("engagement").alias("engagement"))
    artifacts.write_artifacts(artifacts.payload_rows(p, F.col("platform")), path)
    return spark.read.text(path).select("key", "value")


# --- streaming --------------------------------------------------------------


def _stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return posts_from(events).drop("k")


def _run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_unique_posts(spark, d):
    """Posts whose ids collide per (platform, author, hour), first arrival kept."""
    out, state = scratch_path(spark, "unique"), scratch_path(spark, "state")
    p = _stream(spark, d).withColumn("id", F.concat_ws(":", "platform", "author", F.date_format("ts", "yyyyMMddHH")))
    _run(ingest.unique_posts(p).select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema("id string").parquet(out)


def stream_buckets(spark, d):
    """Closed hours of the stream must equal the batch counts."""
    out, state = scratch_path(spark, "stream-buckets"), scratch_path(spark, "state")
    rows = ingest.tumbling_buckets(_stream(spark, d)).withColumn("platforms", map_text(F.col("platforms")))
    _run(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(out).withColumn("bucket_start", ts_text("bucket_start"))


def stream_upsert(spark, d):
    """Micro-batches merged into the posts table."""
    out, state = scratch_path(spark, "stream-posts"), scratch_path(spark, "state")
    _run(_stream(spark, d).writeStream.foreachBatch(ingest.posts_into(out, BUCKETS)).option("checkpointLocation", state).trigger(availableNow=True).start())
    return _post_out(tables.read_days(spark, out))


def stream_bucket_upsert(spark, d):
    """Converging buckets with retention in the same writer."""
    out, state = scratch_path(spark, "stream-converge"), scratch_path(spark, "state")
    rows = ingest.tumbling_buckets(_stream(spark, d))
    writer = ingest.buckets_into(out, retention_days=7, clock=lambda: NOW, buckets=BUCKETS)
    _run(rows.writeStream.foreachBatch(writer).option("checkpointLocation", state).trigger(availableNow=True).start())
    return tables.read_days(spark, out).groupBy("ticker").agg(F.count("*").alias("buckets"), F.sum("mentions").alias("mentions"))


def stream_cooldown(spark, d):
    """The flare-up suppression as a keyed stream over the replay's breaking-out rows."""
    src, out, state = (scratch_path(spark, n) for n in ("flags", "kept", "state"))
    rows = backtest.replay_trends(posts(spark, d), NOW, authority=AUTHORITY).filter("breakout_score > 0")
    rows.select("ticker", F.col("as_of").alias("flagged_at"), "breakout_score").write.parquet(src)
    flags = spark.readStream.schema("ticker string, flagged_at timestamp, breakout_score double").parquet(src)
    _run(ingest.cooldown(flags).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema("ticker string, flagged_at timestamp, breakout_score double").parquet(out).withColumn("flagged_at", ts_text("flagged_at"))


def alerts_delivered(spark, d):
    """A stream of three runs of replayed alerts; each delivers what the one before did not raise."""
    src, out, state = (scratch_path(spark, n) for n in ("raised", "delivered", "state"))
    rows = materialize(backtest.replay_trends(posts(spark, d), NOW, authority=AUTHORITY), "replay").withColumn("window_hours", F.lit(24))
    for k in (2, 1, 0):
        found = alerts.alert_candidates(rows.filter(F.col("k") == k), NOW - timedelta(hours=6 * k))
        found.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the stream takes files in the order of their times
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    _run(ingest.alerts_once(stream, 6).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    delivered = spark.read.schema(schema).parquet(out)
    batch = 2 - F.round((F.lit(NOW.timestamp()) - F.unix_seconds("created_at")) / 21600).cast("int")
    return delivered.select("ticker", "kind", "score", batch.alias("batch"))


MERGED_SQL = f"""
stored as (select * from allposts where ts < {NOW_SQL} - interval 24 hour),
fetched as (select id, 'renamed' author, 40 - engagement engagement, 'neutral' sentiment, 0.0::double sentiment_score, ts from allposts where ts >= {NOW_SQL} - interval 72 hour),
merged as (select coalesce(s.id, f.id) id, coalesce(s.author, f.author) author, greatest(s.engagement, f.engagement) engagement,
   case when f.id is not null then f.sentiment else s.sentiment end sentiment,
   case when f.id is not null then f.sentiment_score else s.sentiment_score end sentiment_score,
   strftime(coalesce(s.ts, f.ts), '%Y-%m-%d %H:%M:%S') ts from stored s full join fetched f on s.id = f.id)
"""
AUTHOR_SQL = """
am as (select platform, author, sentiment, sentiment_score, ts, t1 ticker from allposts union all select platform, author, sentiment, sentiment_score, ts, t2 from allposts where t2 is not null and t2 <> t1),
daily as (select strftime(ts, '%Y-%m-%d') as day, substr(sha256(platform || ':' || author), 1, 16) author, platform, ticker, count(*) posts,
   count(*) filter (where sentiment = 'bull') bull, count(*) filter (where sentiment = 'bear') bear, count(*) filter (where sentiment = 'neutral') neutral,
   round(round(sum(sentiment_score), 6) / nullif(count(sentiment_score), 0), 6) sentiment_avg
   from am where ts < date '2024-01-30' group by 1, 2, 3, 4)
"""
CLOSED_SQL = """
am as (select platform, engagement, sentiment, sentiment_score, date_trunc('hour', ts) h, t1 ticker from allposts
       union all select platform, engagement, sentiment, sentiment_score, date_trunc('hour', ts), t2 from allposts where t2 is not null and t2 <> t1),
closed as (select * from am where h + interval 1 hour <= (select max(ts) - interval 6 hour from allposts)),
plat as (select ticker, h, string_agg(platform || '=' || n, ',' order by platform) platforms from (select ticker, h, platform, count(*) n from closed group by all) group by 1, 2),
bks as (select ticker, h, 60 bucket_minutes, count(*) mentions, cast(sum(engagement) as bigint) engagement, count(*) filter (where sentiment = 'bull') bull,
   count(*) filter (where sentiment = 'bear') bear, count(*) filter (where sentiment = 'neutral') neutral,
   round(round(sum(sentiment_score), 6) / nullif(count(sentiment_score), 0), 4) sentiment_avg from closed group by 1, 2)
"""

QUERIES = {
    "upsert_posts": (upsert_posts, with_ctes(POSTS_SQL, MERGED_SQL) + "select * from merged"),
    "stored_posts": (stored_posts, with_ctes(POSTS_SQL, MERGED_SQL) + "select * from merged"),
    "stored_buckets": (
        stored_buckets,
        with_ctes(POSTS_SQL, bucket_sql(60, ALIGNED_START))
        + "select ticker, strftime(bucket_start, '%Y-%m-%d %H:%M:%S') bucket_start, mentions, engagement, sentiment_avg, platforms from buckets where mentions > 0 or engagement > 0",
    ),
    "stored_payloads": (
        stored_payloads,
        with_ctes(POSTS_SQL)
        + "select author as key, coalesce(cast(sum(engagement) filter (where platform = 'click') as bigint), count(*))::varchar as value from allposts group by 1",
    ),
    "snapshot_replace": (snapshot_replace, with_ctes(POSTS_SQL) + "select platform, count(*) n from allposts group by 1"),
    "prune_report": (
        prune_report,
        with_ctes(POSTS_SQL) + f"select t table_name, count(*) filter (where ts < {NOW_SQL} - interval 7 day) pruned from allposts, (values ('posts'), ('events')) v(t) group by 1",
    ),
    "pruned_posts": (
        pruned_posts,
        with_ctes(POSTS_SQL) + f"select platform, count(*) n, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) oldest from allposts where ts >= {NOW_SQL} - interval 7 day group by 1",
    ),
    "author_daily": (author_daily, with_ctes(POSTS_SQL, AUTHOR_SQL) + "select * from daily"),
    "archived_buckets": (
        archived_buckets,
        with_ctes(POSTS_SQL, bucket_sql(60, ROLLING_START))
        + "select strftime(bucket_start, '%Y-%m-%d') as day, count(*) as rows, cast(sum(mentions) as bigint) mentions from buckets where bucket_start < date '2024-01-30' group by 1",
    ),
    "archived_authors": (
        archived_authors,
        with_ctes(POSTS_SQL, AUTHOR_SQL) + "select day, count(*) as rows, cast(sum(posts) as bigint) posts from daily group by 1",
    ),
    "archived_trends": (
        archived_trends,
        with_ctes(POSTS_SQL)
        + "select ticker, count(*) mentions, '2024-01-30' as day from (select t1 ticker from allposts union all select t2 from allposts where t2 is not null and t2 <> t1) group by 1",
    ),
    "unarchived_days": (
        unarchived_days,
        with_ctes(POSTS_SQL) + "select strftime(ts, '%Y-%m-%d') as day, count(*) as rows from allposts where ts >= date '2024-01-20' group by 1",
    ),
    "json_artifacts": (
        json_artifacts,
        with_ctes(POSTS_SQL)
        + "select platform as key, '{\"platform\":\"' || platform || '\",\"posts\":' || count(*) || ',\"engagement\":' || cast(sum(engagement) as bigint) || '}' as value from allposts group by platform",
    ),
    "stream_unique_posts": (
        stream_unique_posts,
        with_ctes(POSTS_SQL) + "select distinct platform || ':' || author || ':' || strftime(ts, '%Y%m%d%H') id from allposts",
    ),
    "stream_buckets": (
        stream_buckets,
        with_ctes(POSTS_SQL, CLOSED_SQL) + "select * exclude (h), strftime(h, '%Y-%m-%d %H:%M:%S') bucket_start from bks join plat using (ticker, h)",
    ),
    "stream_upsert": (
        stream_upsert,
        with_ctes(POSTS_SQL) + "select id, author, engagement, sentiment, sentiment_score, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from allposts",
    ),
    "stream_bucket_upsert": (
        stream_bucket_upsert,
        with_ctes(POSTS_SQL, CLOSED_SQL)
        + f"select ticker, count(*) buckets, cast(sum(mentions) as bigint) mentions from bks where h >= {NOW_SQL} - interval 7 day group by 1",
    ),
    "alerts_delivered": (
        alerts_delivered,
        _replay(ALERT_SQL.replace("ticker || '@' || k as name", "ticker as name").replace("select name ticker", "select k, name ticker").replace("select name,", "select k, name,"))
        + "select ticker, kind, score, 2 - k as batch from alerts a where k <= 2 "
        "and not exists (select 1 from alerts p where a.k < 2 and p.k = a.k + 1 and p.ticker = a.ticker and p.kind = a.kind)",
    ),
    "stream_cooldown": (
        stream_cooldown,
        _replay(HOT_SQL, COOLDOWN_SQL.format(name="hot", source="hot"))
        + "select k.ticker, strftime(flagged_at, '%Y-%m-%d %H:%M:%S') flagged_at, breakout_score from kept_hot k join hot f on f.ticker = k.ticker and f.as_of = k.flagged_at",
    ),
}
