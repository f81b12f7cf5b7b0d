"""Bad landed values lose themselves, never the job or other rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from murmur.functions.timeparse import parse_mixed_timestamp
from murmur.operators.dedup import collapse_near_duplicates
from murmur.sinks.storage import partition_days
from murmur.sources.payloads import normalize_reddit
from murmur.sources.prices import normalize_prices


def test_a_time_out_of_range_is_null(spark):
    rows = spark.createDataFrame([("9" * 20,), ("1785500000",), ("soon",)], "t string")
    found = [r[0] for r in rows.select(parse_mixed_timestamp(F.col("t")).cast("string")).collect()]
    assert found == [None, "2026-07-31 12:13:20", None]


def test_prices_without_a_number_are_null(spark):
    raw = spark.createDataFrame([("A", "1785500000", "n/a", "NaN", "1.5", "2", "NaN")], "ticker string, ts string, open string, high string, low string, close string, volume string")
    row = normalize_prices(raw).first()
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (None, None, 1.5, 2.0, None)


def test_posts_without_a_text_stay(spark):
    rows = [("a", None, 1, datetime(2026, 1, 1)), ("b", "short", 2, datetime(2026, 1, 1))]
    posts = spark.createDataFrame(rows, "id string, text string, engagement long, ts timestamp")
    assert {r["id"] for r in collapse_near_duplicates(posts).collect()} == {"a", "b"}


def test_days_of_a_table_with_rows_without_a_day(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, date(2026, 1, 2)), (2, None)], "x int, day date").write.partitionBy("day").parquet(path)
    assert partition_days(spark, path) == [date(2026, 1, 2)]


def test_payloads_that_cannot_be_read_make_no_posts(spark):
    good = '{"id": "x1", "title": "words here", "created_utc": 1785500000}'
    raw = spark.createDataFrame([(good, "l", 0), ("{broken", "l", 1), ('{"id": "x2", "title": "t"}', "l", 2)], "payload string, listing string, position long")
    found = normalize_reddit(raw)
    assert [r["ts"] is not None and r["id"] is not None for r in found.collect()] == [True]
