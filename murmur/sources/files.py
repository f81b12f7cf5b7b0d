"""Offline files: JSON and CSV exports mapped onto the posts schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.fixed_values import FIELD_ALIASES
from murmur.functions.timeparse import parse_mixed_timestamp

_NAMES = sorted({name for names in FIELD_ALIASES.values() for name in names})
_ROW = ", ".join(f"`{n}` string" for n in _NAMES)


def read_json_rows(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Rows of JSON lines; with ``whole`` of files that are one list or one object with a ``posts`` list. Every field is text.

    Lines are read in as many tasks as their size asks for; a whole file is one task.
    """
    nested = ", ".join(f"`{n}`: string" for n in _NAMES)
    raw = spark.read.schema(f"{_ROW}, posts array<struct<{nested}>>").json(path, multiLine=whole)
    own = F.array(F.struct(*[F.col(n) for n in _NAMES]))
    return raw.select(F.explode(F.coalesce("posts", own)).alias("r")).select("r.*")


def read_csv_rows(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Rows of a CSV file with a header; every field as text. ``whole`` allows line breaks inside quotes and reads each file in one task."""
    return spark.read.csv(path, header=True, multiLine=whole, escape='"')


def pick(df: DataFrame, field: str) -> Column:
    """The first non-empty value among the accepted names of ``field``."""
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in FIELD_ALIASES[field] if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _ticker_list(raw: Column) -> Column:
    listed = F.from_json(raw, "array<string>")
    names = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    typed = F.transform(names, lambda t: F.regexp_replace(F.upper(t), r"^\$+", ""))
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), listed).otherwise(typed)


def rows_to_posts(rows: DataFrame, default_platform: str = "sample") -> DataFrame:
    """Map loosely named rows to posts; rows without text or a readable time are dropped."""
    picked = rows.select(*[pick(rows, f).alias(f) for f in FIELD_ALIASES])
    number = F.col("engagement").try_cast("double")
    native = F.coalesce(
        "id", F.substring(F.sha1(F.concat(F.col("text"), F.col("timestamp"))), 1, 16)
    )
    platform = F.coalesce("platform", F.lit(default_platform))
    return picked.filter(F.col("text").isNotNull() & F.col("timestamp").isNotNull()).select(
        F.concat_ws(":", platform, native).alias("id"),
        platform.alias("platform"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("author", F.lit("unknown")).alias("author"),
        F.col("text"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("lang", F.lit("en")).alias("lang"),
        F.when(F.isnan(number), F.lit(0)).otherwise(F.coalesce(number.try_cast("bigint"), F.lit(0))).cast("bigint").alias("engagement"),
        F.lit(None).cast("string").alias("sentiment"),
        F.lit(None).cast("double").alias("sentiment_score"),
        _ticker_list(F.col("tickers")).alias("tickers"),
        F.lit(None).cast("int").alias("topic_id"),
        parse_mixed_timestamp(F.col("timestamp")).alias("ts"),
    ).filter(F.col("ts").isNotNull())


def load_posts(spark: SparkSession, path: str, default_platform: str = "sample", whole: bool = False) -> DataFrame:
    """Posts of ``.csv`` or JSON files, one record per line unless ``whole`` is asked for."""
    rows = read_csv_rows(spark, path, whole) if path.lower().endswith(".csv") else read_json_rows(spark, path, whole)
    return rows_to_posts(rows, default_platform)
