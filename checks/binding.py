"""The logical tables, derived from the test tables the same way in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import spread
from murmur.sources.dictionary import Dictionary

NOW = datetime(2024, 1, 30, 18, 0, 0, tzinfo=timezone.utc)
NOW_SQL = "timestamp '2024-01-30 18:00:00'"

AUTHORITY = {"purchase": 3.0, "signup": 2.5, "click": 1.0, "view": 0.9, "error": 0.8}

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

SECTORS = ("Technology", "Energy", "Crypto", "Consumer")
# Two-word alias phrases that occur in the test documents.
ALIAS_WORDS = ("of the", "by the", "and the", "in the", "the of", "is the", "with the", "on the", "was the", "for the")


def fixture_dictionary() -> Dictionary:
    """Twenty symbols TKA..TKT; the last one is left out of the names to exercise defaults."""
    symbols = {}
    for i in range(19):
        symbols[f"TK{chr(65 + i)}"] = {
            "name": f"Company {chr(65 + i)}",
            "sector": SECTORS[i % 4],
            "aliases": [ALIAS_WORDS[i]] if i < len(ALIAS_WORDS) else [],
        }
    return Dictionary.build(symbols, blocklist=["TKQ", "THE", "AND"], ambiguous=["TKB"])


ENTITIES_SQL = (
    "entities as (select 'TK' || chr(65 + i::int) ticker, 'Company ' || chr(65 + i::int) as name, "
    "case i % 4 when 0 then 'Technology' when 1 then 'Energy' when 2 then 'Crypto' else 'Consumer' end sector "
    "from range(19) r(i))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.read.schema(EVENTS) if name == "events" else spark.read
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def posts_from(events: DataFrame) -> DataFrame:
    """Posts of the events table (batch or streaming)."""
    k = F.get_json_object("props", "$.k").cast("int")
    burst = (F.pmod(F.day("ts"), F.lit(3)) == 0) & F.hour("ts").between(12, 17)
    letter = F.when(burst & (F.col("event_id") % 4 != 0), F.day("ts") % 20).otherwise(k % 20)
    symbol = lambda c: F.concat(F.lit("TK"), F.char(F.lit(65) + c.cast("int")))
    t1 = symbol(letter)
    t2 = F.when(F.col("event_id") % 3 == 0, symbol((k * 7 + 3) % 20))
    score = F.when(
        F.col("event_id") % 11 != 0, F.round(((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0), 2)
    )
    phrases = ["breakout on $", "not selling $", "crash coming for $", "absolutely ripping $", "what is the target on $"]
    opening = F.lit("never a scam $")
    for i, p in reversed(list(enumerate(phrases))):
        opening = F.when(F.col("event_id") % 6 == i, F.lit(p)).otherwise(opening)
    text = F.concat(opening, t1, F.coalesce(F.concat(F.lit(" also watching "), t2), F.lit("")))
    ident = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return events.select(
        ident.alias("id"),
        F.col("event_type").alias("platform"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        text.alias("text"),
        F.concat(F.lit("https://example.com/"), ident).alias("url"),
        F.lit("en").alias("lang"),
        F.floor("value").cast("bigint").alias("engagement"),
        F.when(score.isNull(), F.lit(None).cast("string")).when(score > 0.12, "bull").when(score < -0.12, "bear").otherwise("neutral").alias("sentiment"),
        score.alias("sentiment_score"),
        F.array_distinct(F.array_compact(F.array(t1, t2))).alias("tickers"),
        F.lit(None).cast("int").alias("topic_id"),
        "ts",
        k.alias("k"),
    )


def all_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from(table(spark, sf_dir, "events"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts up to the clock."""
    return all_posts(spark, sf_dir).drop("k").filter(F.col("ts") <= F.lit(NOW))


def prices_from(events: DataFrame) -> DataFrame:
    """Hourly candles: the values of an hour's events, per ticker letter."""
    letter = F.get_json_object("props", "$.k").cast("int") % 20
    ticker = F.concat(F.lit("TK"), F.char(F.lit(65) + letter))
    order = F.struct("ts", "event_id")
    return events.groupBy(ticker.alias("ticker"), F.date_trunc("hour", "ts").alias("ts_hour")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
    ).withColumnRenamed("ts_hour", "ts")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_from(table(spark, sf_dir, "events").filter(F.col("ts") <= F.lit(NOW)))


def entities(spark: SparkSession) -> DataFrame:
    return fixture_dictionary().entities(spark)


def ts_text(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


POSTS_SQL = """
b as (select event_id, ts, user_id, event_type, value, cast(json_extract_string(props,'$.k') as int) k,
             (day(ts) % 3 = 0 and hour(ts) between 12 and 17) burst from events),
p0 as (select *, 'TK' || chr(cast(65 + case when burst and event_id % 4 <> 0 then day(ts) % 20 else k % 20 end as int)) t1,
        case when event_id % 3 = 0 then 'TK' || chr(cast(65 + (k*7+3) % 20 as int)) end t2 from b),
p1 as (select event_type || ':' || event_id id, event_type platform, 'u' || user_id author, ts, k,
       cast(floor(value) as bigint) engagement, t1, t2,
       case when event_id % 11 = 0 then null else round(((event_id*37) % 201 - 100) / 100.0::double, 2) end sentiment_score,
       (case cast(event_id % 6 as int) when 0 then 'breakout on $' when 1 then 'not selling $'
              when 2 then 'crash coming for $' when 3 then 'absolutely ripping $'
              when 4 then 'what is the target on $' else 'never a scam $' end) || t1 || coalesce(' also watching ' || t2, '') as text
from p0),
allposts as (select *, case when sentiment_score > 0.12 then 'bull' when sentiment_score < -0.12 then 'bear'
       when sentiment_score is not null then 'neutral' end sentiment,
       case platform when 'purchase' then 3.0 when 'signup' then 2.5 when 'click' then 1.0 when 'view' then 0.9 when 'error' then 0.8 else 1.0 end::double
         * (1 + ln(1 + greatest(0, engagement))) weight,
       list_distinct(list_filter([t1, t2], lambda x: x is not null)) tickers
       from p1),
posts as (select * from allposts where ts <= timestamp '2024-01-30 18:00:00'),
mentions as (select *, t1 ticker from posts union all select *, t2 ticker from posts where t2 is not null and t2 <> t1)
"""

PRICES_SQL = """
prices as (select 'TK' || chr(cast(65 + cast(json_extract_string(props,'$.k') as int) % 20 as int)) ticker,
   date_trunc('hour', ts) ts, arg_min(value, (ts, event_id)) as open, max(value) high, min(value) low,
   arg_max(value, (ts, event_id)) as close, count(*) volume
   from events where ts <= timestamp '2024-01-30 18:00:00' group by 1, 2)
"""


def with_ctes(*parts: str) -> str:
    return "with recursive " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"
