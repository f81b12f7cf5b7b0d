from datetime import timedelta, timezone

from pyspark.sql import functions as F

from helpers import NOW, dicts, frame, post
from murmur import schemas
from murmur.operators import buckets
from murmur.sinks import tables
from murmur.streaming import ingest


def feed(spark, tmp_path, *batches):
    """One file per micro-batch, read in order."""
    import time

    path = tmp_path / "in"
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    return spark.readStream.schema(schemas.POSTS).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(writer, tmp_path):
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_refetched_ids_are_dropped(spark, tmp_path):
    stream = feed(spark, tmp_path, [post("a", 2), post("b", 2)], [post("a", 2), post("c", 1)])
    out = str(tmp_path / "out")
    drain(ingest.unique_posts(stream).select("id").writeStream.format("parquet").option("path", out), tmp_path)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_upserts_converge(spark, tmp_path):
    stream = feed(spark, tmp_path, [post("a", 2, engagement=1), post("b", 30)], [post("a", 2, engagement=7, sentiment="bull")])
    out = str(tmp_path / "posts")
    drain(stream.writeStream.foreachBatch(ingest.posts_into(out)), tmp_path)
    rows = {r["id"]: (r["engagement"], r["sentiment"]) for r in dicts(tables.read_days(spark, out))}
    assert rows == {"a": (7, "bull"), "b": (0, None)}


def test_closed_hours_equal_the_batch_series(spark, tmp_path):
    early = [post(i, 40 - i * 0.2, ["AA", "BB"][: 1 + i % 2], platform=f"p{i % 2}", engagement=i, sentiment="bull", sentiment_score=0.25) for i in range(100)]
    late = [post(f"l{i}", 24 - i * 0.2, ["AA"]) for i in range(120)]
    stream = feed(spark, tmp_path, early, late)
    out = str(tmp_path / "out")
    drain(ingest.tumbling_buckets(stream).writeStream.format("parquet").option("path", out), tmp_path)
    got = {(r["ticker"], r["bucket_start"]): (r["mentions"], r["engagement"], r["sentiment_avg"], r["platforms"]) for r in dicts(spark.read.schema(schemas.BUCKETS).parquet(out))}
    latest = max(r[-1] for r in early + late)
    batch = buckets.bucket_series(frame(spark, early + late), NOW, history_hours=48).filter("mentions > 0")
    closed = batch.filter(F.col("bucket_start") + F.expr("interval 1 hour") <= F.lit(latest - timedelta(hours=6)))
    want = {(r["ticker"], r["bucket_start"]): (r["mentions"], r["engagement"], r["sentiment_avg"], r["platforms"]) for r in dicts(closed)}
    assert got == want and len(want) > 20


def test_alerts_are_delivered_once(spark, tmp_path):
    """Runs an hour apart; the stream is stopped and started again after the second."""
    import time

    path, out = str(tmp_path / "raised"), str(tmp_path / "out")

    def land(run, *names):
        rows = [(n, "mention_spike", 2.0, "m", NOW + timedelta(hours=run)) for n in names]
        spark.createDataFrame(rows, schemas.ALERTS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)

    def deliver():
        stream = spark.readStream.schema(schemas.ALERTS).option("maxFilesPerTrigger", 1).parquet(path)
        drain(ingest.alerts_once(stream, 1).writeStream.format("parquet").option("path", out), tmp_path)
        found = {}
        for r in spark.read.schema(schemas.ALERTS).parquet(out).collect():
            found.setdefault(round((r["created_at"].astimezone(timezone.utc) - NOW).total_seconds() / 3600), []).append(r["ticker"])
        return {run: sorted(names) for run, names in found.items()}

    land(0, "A", "B")
    land(1, "A", "B", "C")
    assert deliver() == {0: ["A", "B"], 1: ["C"]}
    land(2, "C")
    land(3, "A", "C")
    assert deliver() == {0: ["A", "B"], 1: ["C"], 3: ["A"]}


def test_cooldown_across_batches(spark, tmp_path):
    path = str(tmp_path / "flags")
    import time

    for hours in ([0, 6], [12, 24], [47, 48, 71, 72]):
        rows = [(t, NOW + timedelta(hours=h), float(h)) for h in hours for t in ("AA", "BB")]
        spark.createDataFrame(rows, "ticker string, flagged_at timestamp, breakout_score double").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    flags = spark.readStream.schema("ticker string, flagged_at timestamp, breakout_score double").option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "kept")
    drain(ingest.cooldown(flags).writeStream.format("parquet").option("path", out), tmp_path)
    rows = spark.read.schema("ticker string, flagged_at timestamp, breakout_score double").parquet(out).orderBy("ticker", "flagged_at").collect()
    assert [(r["ticker"], r["breakout_score"]) for r in rows] == [(t, h) for t in ("AA", "BB") for h in (0.0, 24.0, 48.0, 72.0)]
