import gzip
import json
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import NOW, dicts, frame, post
from murmur import schemas
from murmur.operators import merge
from murmur.sinks import archive, artifacts, cells, tables
from murmur.sources import scans


def lines(root, day):
    out = []
    for f in sorted(Path(root, f"day={day}").glob("*.json.gz")):
        out += [json.loads(x) for x in gzip.open(f, "rt").read().splitlines()]
    return out


def bucket_rows(spark, rows):
    data = [(t, start, 60, m, 0, 0, 0, 0, 0.4, {"reddit": m}) for t, start, m in rows]
    return spark.createDataFrame(data, schemas.BUCKETS)


def test_archive_writes_completed_days_once(spark, tmp_path):
    root = str(tmp_path / "buckets")
    rows = bucket_rows(spark, [("B", NOW - timedelta(days=2), 5), ("A", NOW - timedelta(days=2), 6), ("A", NOW - timedelta(days=1), 7), ("A", NOW, 8)])
    assert archive.archive_buckets(rows, NOW, root) == {"2026-06-09": 2, "2026-06-10": 1}
    assert [x["ticker"] for x in lines(root, "2026-06-09")] == ["A", "B"]
    again = archive.archive_buckets(rows.withColumn("mentions", F.lit(999).cast("bigint")), NOW, root)
    assert again == {} and lines(root, "2026-06-09")[0]["mentions"] == 6
    later = archive.archive_buckets(rows, NOW + timedelta(days=1), root)
    assert later == {"2026-06-11": 1}


def test_author_rows_are_pseudonymous(spark, tmp_path):
    rows = [
        post(1, 30, ["XYZ", "ABC"], platform="reddit", author="deepvalue", sentiment="bull", sentiment_score=0.8),
        post(2, 26, ["XYZ"], platform="reddit", author="deepvalue", sentiment="bear", sentiment_score=-0.4),
        post(3, 0, ["XYZ"], platform="reddit", author="deepvalue", sentiment="bull", sentiment_score=0.9),
    ]
    root = str(tmp_path / "authors")
    assert archive.archive_author_daily(frame(spark, rows), NOW, root) == {"2026-06-10": 2}
    xyz = [x for x in lines(root, "2026-06-10") if x["ticker"] == "XYZ"][0]
    assert (xyz["posts"], xyz["bull"], xyz["bear"], xyz["sentiment_avg"]) == (2, 1, 1, 0.2)
    assert "deepvalue" not in str(xyz) and len(xyz["author"]) == 16


def test_first_trend_snapshot_of_a_day_wins(spark, tmp_path):
    root = str(tmp_path / "trends")
    one = spark.createDataFrame([("AAPL", 10)], "ticker string, mentions bigint")
    two = spark.createDataFrame([("AAPL", 22), ("NVDA", 8)], "ticker string, mentions bigint")
    assert archive.archive_trends(one, NOW, root) == 1
    assert archive.archive_trends(two, NOW, root) == 0
    assert [x["mentions"] for x in lines(root, "2026-06-11")] == [10]


def files(path, **parts):
    """Data files of a table, of one day or bucket, with what they hold."""
    wanted = [f"{k}={v}" for k, v in parts.items()]
    found = Path(path).glob("version=*/day=*/bucket=*/*.parquet")
    return {str(f): f.read_bytes() for f in found if all(w in f.parts for w in wanted)}


def test_post_merge_touches_only_its_cells(spark, tmp_path):
    path = str(tmp_path / "posts")
    tables.merge_posts(path, frame(spark, [post("a", 1, text="old", engagement=5), post("b", 60, engagement=1), *[post(f"x{i}", 1) for i in range(40)]]), buckets=8)
    before = files(path)
    held = tables.read_cells(spark, path).filter("id = 'a'").first()
    update = frame(spark, [post("a", 200, text="new", engagement=3, sentiment="bull", tickers=["AA"])])
    tables.merge_posts(path, update)
    tables.merge_posts(path, update)
    rows = {r["id"]: r for r in dicts(tables.read_days(spark, path))}
    assert len(rows) == 42
    assert rows["a"]["text"] == "old" and rows["a"]["engagement"] == 5
    assert rows["a"]["sentiment"] == "bull" and rows["a"]["tickers"] == ["AA"]
    assert rows["a"]["day"] == date(2026, 6, 11)
    after = files(path)
    replaced = {f for f in before if f not in after}
    assert replaced and all(f"day=2026-06-11/bucket={held['bucket']}/" in f for f in replaced)
    assert all(after[f] == data for f, data in before.items() if f not in replaced)


def test_a_merge_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "posts")
    tables.merge_posts(path, frame(spark, [post(f"x{i}", i) for i in range(60)]), buckets=4)
    before = sorted(map(str, dicts(tables.read_days(spark, path))))
    update = frame(spark, [post(f"x{i}", i, engagement=9) for i in range(0, 80, 7)])

    def die(*args):
        raise OSError("lost")

    monkeypatch.setattr(cells, "commit", die)
    with pytest.raises(OSError):
        tables.merge_posts(path, update)
    assert sorted(map(str, dicts(tables.read_days(spark, path)))) == before
    monkeypatch.undo()
    tables.merge_posts(path, update)
    rows = {r["id"]: r["engagement"] for r in dicts(tables.read_days(spark, path))}
    assert len(rows) == 63 and {r for r, e in rows.items() if e == 9} == {f"x{i}" for i in range(0, 80, 7)}
    versions = {p.name for p in Path(path).glob("version=*")}
    named = {f"version={v}" for n in cells._numbers(spark, path) for v in cells._manifest(spark, path, n).cells.values()}
    assert versions == named  # what the dead merge wrote is gone


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "posts")
    tables.merge_posts(path, frame(spark, [post("a", 1)]))
    state = cells.current(spark, path)
    with pytest.raises(RuntimeError):
        cells.commit(spark, path, state)


def test_a_merge_evaluates_its_input_once(spark, tmp_path):
    path, seen = str(tmp_path / "posts"), spark.sparkContext.accumulator(0)
    tables.merge_posts(path, frame(spark, [post(f"x{i}", i) for i in range(50)]))

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    fetched = frame(spark, [post(f"x{i}", i, author="b") for i in range(30, 70)])
    tables.merge_posts(path, fetched.withColumn("author", counted("author")))
    assert seen.value == 40 and tables.read_days(spark, path).count() == 70


def test_posts_without_a_time_have_a_cell(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = frame(spark, [post("a", 1), post("b", 1)]).withColumn("ts", F.when(F.col("id") == "a", F.col("ts")))
    for _ in range(2):
        tables.merge_posts(path, rows)
    assert sorted((r["id"], r["day"]) for r in tables.read_days(spark, path).collect()) == [("a", date(2026, 6, 11)), ("b", None)]
    assert tables.stored_days(spark, path) == [date(2026, 6, 11)]


def test_merging_nothing(spark, tmp_path):
    path = str(tmp_path / "posts")
    tables.merge_posts(path, frame(spark, []))
    assert tables.read_days(spark, path).count() == 0
    tables.merge_posts(path, frame(spark, [post("a", 1)]))
    tables.merge_posts(path, frame(spark, []))
    assert tables.read_days(spark, path).count() == 1


def test_a_half_written_day_is_written_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "buckets")
    rows = bucket_rows(spark, [(t, NOW - timedelta(days=d), 5) for t in "ABC" for d in (1, 2, 3)])
    torn = Path(root, "day=2026-06-09")
    torn.mkdir(parents=True)
    (torn / "part-0.json").write_text('{"ticker": "A"}\n')
    publish = archive.publish_day

    def die_at_the_last(spark, staged, path, day):
        if day == date(2026, 6, 10):
            monkeypatch.setattr(archive, "touch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        publish(spark, staged, path, day)

    assert archive.archived_days(spark, root) == [] and archive.read_archive(spark, root, "ticker string").count() == 0
    monkeypatch.setattr(archive, "publish_day", die_at_the_last)
    with pytest.raises(OSError):
        archive.archive_buckets(rows, NOW, root)
    monkeypatch.undo()
    assert archive.archived_days(spark, root) == [date(2026, 6, 8), date(2026, 6, 9)]
    assert len(lines(root, "2026-06-09")) == 3 and not list(torn.glob("part-0.json"))
    again = rows.withColumn("mentions", F.lit(7).cast("bigint"))
    assert archive.archive_buckets(again, NOW, root) == {"2026-06-10": 3}
    found = archive.read_archive(spark, root, "ticker string, mentions bigint")
    assert {(r["day"].day, r["mentions"]): r["count"] for r in found.groupBy("day", "mentions").count().collect()} == {(8, 5): 3, (9, 5): 3, (10, 7): 3}


def test_author_days_read_only_days_that_are_not_archived(spark, tmp_path):
    path, root = str(tmp_path / "posts"), str(tmp_path / "authors")
    tables.merge_posts(path, frame(spark, [post(f"p{h}", h, ["XYZ"], author=f"a{h % 3}") for h in range(0, 96, 3)]))
    assert len(archive.archive_author_daily(tables.read_days(spark, path), NOW, root)) == 4
    rest = archive.unfinished(tables.read_days(spark, path), F.col("day"), archive.archived_days(spark, root))
    assert {r["day"] for r in rest.select("day").distinct().collect()} == {date(2026, 6, 11)}
    assert "PartitionFilters: [NOT day" in rest._jdf.queryExecution().executedPlan().toString()
    assert archive.archive_author_daily(tables.read_days(spark, path), NOW, root) == {}


def test_bucket_merge_skips_empty_rows_and_converges(spark, tmp_path):
    path = str(tmp_path / "buckets")
    hour = NOW - timedelta(hours=1)
    tables.merge_buckets(path, bucket_rows(spark, [("A", hour, 1), ("B", hour, 0)]))
    tables.merge_buckets(path, bucket_rows(spark, [("A", hour, 4), ("C", hour, 2)]))
    got = {r["ticker"]: r["mentions"] for r in dicts(tables.read_days(spark, path))}
    assert got == {"A": 4, "C": 2}


def test_payload_merge_and_lookup(spark, tmp_path):
    path = str(tmp_path / "meta")
    def rows(values):
        return spark.createDataFrame([(k, v, NOW) for k, v in values.items()], schemas.META)
    tables.merge_meta(path, rows({"ticker:AA": "1", "brief": "x"}))
    tables.merge_meta(path, rows({"ticker:AA": "2"}))
    assert [r["value"] for r in tables.read_meta(spark, path, "ticker:AA").collect()] == ["2"]
    assert [r["value"] for r in tables.read_meta(spark, path, "brief").collect()] == ["x"]
    meta = tables.read_days(spark, path)
    assert scans.ticker_payload(meta, "AA").count() == 1
    assert scans.ticker_payload(meta, "aa").count() == 0 and scans.ticker_payload(meta, "TOOLONGX").count() == 0


def test_prune_drops_old_days_and_trims_the_edge(spark, tmp_path):
    path = str(tmp_path / "posts")
    ages = {"young": 1, "edge_in": 24 * 30 - 1, "edge_out": 24 * 30 + 1, "old": 24 * 40}
    df = frame(spark, [post(k, v) for k, v in ages.items()])
    assert dicts(merge.prune_report({"posts": (df, "ts")}, NOW)) == [{"table_name": "posts", "pruned": 2}]
    tables.merge_posts(path, df)
    tables.prune_days(spark, path, "ts", NOW)
    assert {r["id"] for r in tables.read_days(spark, path).collect()} == {"young", "edge_in"}
    assert date(2026, 5, 2) not in tables.stored_days(spark, path)


def test_recent_scan_prunes_partitions_and_fills_defaults(spark, tmp_path):
    path = str(tmp_path / "posts")
    tables.merge_posts(path, frame(spark, [post("a", 1, source=None, lang=None), post("b", 400)]))
    scan = scans.load_recent_posts(tables.read_days(spark, path), NOW)
    row = dicts(scan)
    assert [r["id"] for r in row] == ["a"] and row[0]["source"] == "" and row[0]["lang"] == "en"
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_artifacts_hold_one_document_per_key(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("AA", 1), ("BB", 2)], "ticker string, n int")
    artifacts.write_artifacts(artifacts.payload_rows(rows, F.concat(F.lit("tickers/"), F.col("ticker"))), path)
    got = {r["key"]: json.loads(r["value"]) for r in spark.read.text(path).collect()}
    assert got == {"tickers/AA": {"ticker": "AA", "n": 1}, "tickers/BB": {"ticker": "BB", "n": 2}}


def test_union_tickers_keeps_the_ranking_first(spark):
    top = spark.createDataFrame([("ZZ", 1), ("MM", 2)], "ticker string, rank int")
    flags = spark.createDataFrame([("MM",), ("BB",), ("AA",)], "ticker string")
    assert [r["ticker"] for r in merge.union_tickers(top, flags).collect()] == ["ZZ", "MM", "AA", "BB"]
