"""The same operators on a larger fact: every order line is a post about the brand of its part."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.binding import table, ts_text, with_ctes
from checks.trends import BUCKET_SQL
from murmur.functions.exprs import map_text
from murmur.operators import buckets, dedup, graph, trends

CLOCK = datetime(2001, 11, 5, tzinfo=timezone.utc)
CLOCK_SQL = "timestamp '2001-11-05 00:00:00'"
DAYS = 2520


def line_posts(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    score = F.round(F.lit(0.05) - F.col("l_discount"), 2)
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("o_orderpriority").alias("platform"),
        F.lit("lines").alias("source"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("author"),
        F.col("p_brand").alias("text"),
        F.lit("").alias("url"),
        F.lit("en").alias("lang"),
        F.col("l_quantity").cast("bigint").alias("engagement"),
        F.when(score > 0.01, "bull").when(score < -0.01, "bear").otherwise("neutral").alias("sentiment"),
        score.alias("sentiment_score"),
        F.array("p_brand").alias("tickers"),
        F.lit(None).cast("int").alias("topic_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def brand_buckets(spark, d):
    series = buckets.bucket_series(line_posts(spark, d), CLOCK, bucket_minutes=1440, history_hours=24 * DAYS)
    return series.withColumn("bucket_start", ts_text("bucket_start")).withColumn("platforms", map_text(F.col("platforms")))


def brand_top_lines(spark, d):
    lines = dedup.dedupe_posts(line_posts(spark, d))
    return trends.ranked_posts(lines, CLOCK, 24 * DAYS).select("ticker", "rank", "id", "engagement", ts_text("ts").alias("ts"))


def unique_lines(spark, d):
    rows = dedup.dedupe_posts(line_posts(spark, d))
    return rows.select("id", "engagement", ts_text("ts").alias("ts"))


def _order_posts(spark, d):
    """One post per order, mentioning all its brands."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("tickers"))


def brand_graph(spark, d):
    p = _order_posts(spark, d)
    return graph.graph_edges(graph.co_mentions(p, graph.mention_counts(p), "l_orderkey"))


LINES_SQL = """
lines as (select l_orderkey || '-' || l_linenumber id, o_orderpriority platform, cast(l_quantity as bigint) engagement,
   round(0.05::double - l_discount, 2) sentiment_score,
   case when round(0.05::double - l_discount, 2) > 0.01 then 'bull' when round(0.05::double - l_discount, 2) < -0.01 then 'bear' else 'neutral' end sentiment,
   p_brand ticker, l_shipdate ts from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey),
mentions as (select * from lines),
uniq as (select * from lines qualify row_number() over (partition by id order by engagement desc, ts, platform, ticker) = 1)
"""

QUERIES = {
    "brand_buckets": (
        brand_buckets,
        with_ctes(LINES_SQL, BUCKET_SQL.format(n=DAYS, m=1440, start=f"({CLOCK_SQL} - interval {24 * DAYS} hour)"))
        + "select * replace (strftime(bucket_start, '%Y-%m-%d %H:%M:%S') as bucket_start) from buckets",
    ),
    "brand_top_lines": (
        brand_top_lines,
        with_ctes(LINES_SQL)
        + "select ticker, row_number() over (partition by ticker order by engagement desc, ts, id) rank, id, engagement, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from uniq qualify rank <= 5",
    ),
    "unique_lines": (unique_lines, with_ctes(LINES_SQL) + "select id, engagement, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from uniq"),
    "brand_graph": (
        brand_graph,
        "with ob as (select distinct l_orderkey o, p_brand b from lineitem join part on p_partkey = l_partkey) "
        "select * from (select x.b source, y.b target, count(*) weight from ob x join ob y on x.o = y.o and x.b < y.b group by 1, 2) where weight >= 2",
    ),
}
