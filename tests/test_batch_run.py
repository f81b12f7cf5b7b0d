from murmur.plans import daily
from murmur.sinks import tables

from checks.binding import NOW, fixture_dictionary, posts, prices


def test_a_full_run_twice(spark, sf_dir, tmp_path):
    p, px = posts(spark, sf_dir), prices(spark, sf_dir)
    cfg = daily.BatchConfig(topic_clusters=3)
    for _ in range(2):
        path = daily.run(spark, p, px, fixture_dictionary(), NOW, str(tmp_path / "lake"), cfg)
    read = lambda name: spark.read.parquet(path[name])
    stored = tables.read_days(spark, path["posts"])
    assert stored.count() == stored.select("id").distinct().count() > 0
    buckets = tables.read_days(spark, path["ticker_buckets"])
    assert buckets.count() == buckets.select("ticker", "bucket_start", "bucket_minutes").distinct().count() > 0
    trends = read("ticker_trends")
    assert trends.count() > 5 and "sector" not in trends.columns and "origin_platform" not in trends.columns
    assert read("alerts").columns == ["ticker", "kind", "score", "message", "created_at"]
    assert read("fresh_alerts").count() == 0  # the second run raises nothing new
    assert read("correlations").count() == trends.count()
    keys = {r["key"] for r in tables.read_days(spark, path["meta"]).select("key").collect()}
    assert {"meta", "brief", "alerts", "backtest", "backtest_events"} <= keys and sum(k.startswith("ticker:") for k in keys) == trends.count()
    brief = tables.read_meta(spark, path["meta"], "brief").first()["value"]
    assert "Market Chatter Brief" in brief
    assert read("topic_points").count() > 0 and read("topics").count() >= 0
