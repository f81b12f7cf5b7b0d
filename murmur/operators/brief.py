"""The written digest, assembled from ranked rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.exprs import fixed_text, to_utc

TITLE = "Market Chatter Brief"
CLOSING = "*This brief aggregates public social chatter. Nothing here is financial advice.*"


def arrow(current: Column, previous: Column) -> Column:
    """Percent change as text; halves round to even."""
    pct = (current - previous) / F.when(previous != 0, previous) * 100
    size = F.format_string("%.0f%%", F.bround(F.abs(pct), 0))
    return (
        F.when(previous == 0, F.when(current != 0, "new").otherwise("—"))
        .when(pct >= 0, F.concat(F.lit("▲ "), size))
        .otherwise(F.concat(F.lit("▼ "), size))
    )


def _ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their rank; the window sees ``n`` rows at most."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _lines(df: DataFrame, section: int, header: list[str], line: Column) -> DataFrame:
    """Rows as lines of a section; the header goes in front of the first one."""
    head = F.array(*[F.struct(F.lit(i - len(header)).alias("pos"), F.lit(t).alias("line")) for i, t in enumerate(header)])
    body = F.array(F.struct(F.col("rank").alias("pos"), line.alias("line")))
    empty = F.array().cast("array<struct<pos:int,line:string>>")
    all_lines = F.concat(F.when(F.col("rank") == 1, head).otherwise(empty), body) if header else body
    return df.select(F.lit(section).alias("section"), F.explode(all_lines).alias("l")).select("section", "l.pos", "l.line")


def _static(spark, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(lines, start=-len(lines))], "section int, pos int, line string")


def emerging_tickers(trends: DataFrame, n: int = 5) -> DataFrame:
    return _ranked(trends.filter(F.col("phase") == "emerging"), [F.col("breakout_score").desc(), F.col("ticker")], n)


def fading_tickers(trends: DataFrame, n: int = 3) -> DataFrame:
    return _ranked(trends.filter(F.col("phase") == "fading"), [F.col("breakout_score").desc(), F.col("ticker")], n)


def most_discussed(trends: DataFrame, n: int = 10) -> DataFrame:
    return _ranked(trends, [F.col("mentions").desc(), F.col("ticker")], n)


def quotes(trends: DataFrame, n: int = 5) -> DataFrame:
    """The top post of each emerging ticker, or of the three most discussed ones."""
    first = emerging_tickers(trends).withColumn("pri", F.lit(0))
    second = most_discussed(trends, 3).withColumn("pri", F.lit(1))
    both = first.unionByName(second).withColumn("best", F.min("pri").over(Window.partitionBy(F.lit(1))))
    return (
        both.filter((F.col("pri") == F.col("best")) & (F.size("top_posts") > 0) & (F.col("rank") <= n))
        .select("rank", "ticker", F.col("top_posts")[0].alias("p"))
    )


def brief_lines(
    trends: DataFrame, mood: DataFrame, topics: DataFrame | None, alerts: DataFrame, now: datetime, mode: str, window_hours: int = 24
) -> DataFrame:
    """(section, pos, line) rows of the digest. ``trends`` carries ``name`` and ``top_posts``."""
    spark = trends.sparkSession
    stamp = to_utc(now).strftime("%Y-%m-%d %H:%M UTC")
    parts = [
        _static(spark, 1, [f"# {TITLE}", f"*Generated {stamp} · window: last {window_hours}h · mode: {mode}*", ""]),
        mood.select(
            F.lit(2).alias("section"),
            F.posexplode(
                F.array(
                    F.concat(F.lit("## Market mood: "), F.initcap("label"), F.lit(" ("), F.col("index").cast("string"), F.lit("/100)")),
                    F.format_string("%d bullish / %d bearish / %d neutral posts across %d scored posts.", "bull", "bear", "neutral", "posts"),
                    F.lit(""),
                    F.lit("## Emerging tickers"),
                )
            ).alias("pos", "line"),
        ),
        _lines(
            emerging_tickers(trends),
            3,
            [],
            F.format_string(
                "- **$%s** (%s) — %d mentions (%s vs prior window), breakout %sσ, bull:bear %s.",
                "ticker", "name", "mentions", arrow(F.col("mentions"), F.col("mentions_prev")),
                fixed_text(F.col("breakout_score"), 1), fixed_text(F.col("bull_bear_ratio"), 1),
            ),
        ),
        emerging_tickers(trends)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == 0)
        .select(F.lit(3).alias("section"), F.lit(0).alias("pos"), F.lit("- Nothing breaking out this window.").alias("line")),
        _lines(
            fading_tickers(trends),
            4,
            ["", "## Fading stories"],
            F.format_string(
                "- **$%s** — chatter cooling (%d vs %d mentions), sentiment %s.",
                "ticker", "mentions", "mentions_prev", fixed_text(F.col("sentiment_avg"), 2, signed=True),
            ),
        ),
        _static(
            spark,
            5,
            ["", "## Most discussed", "", "| Ticker | Mentions | Δ | Bull:Bear | Sentiment | Phase |", "|---|---|---|---|---|---|"],
        ),
        _lines(
            most_discussed(trends),
            5,
            [],
            F.format_string(
                "| $%s | %d | %s | %s | %s | %s |",
                "ticker", "mentions", arrow(F.col("mentions"), F.col("mentions_prev")),
                fixed_text(F.col("bull_bear_ratio"), 1), fixed_text(F.col("sentiment_avg"), 2, signed=True), "phase",
            ),
        ),
        _lines(
            _ranked(alerts, [F.col("score").desc(), F.col("ticker"), F.col("kind")], 6),
            7,
            ["", "## Unusual activity"],
            F.concat(F.lit("- "), F.col("message")),
        ),
        _lines(
            quotes(trends),
            8,
            ["", "## Voices from the crowd"],
            F.format_string(
                '> "%s" — *%s on %s, $%s, %d engagement*\n', "p.text", "p.author", "p.platform", "ticker", "p.engagement"
            ),
        ),
        _static(spark, 9, ["", "---", CLOSING]),
    ]
    if topics is not None:
        names = F.array_join(F.transform(F.slice("tickers", 1, 3), lambda t: F.concat(F.lit("$"), t["ticker"])), ", ")
        parts.append(
            _lines(
                _ranked(topics, [F.col("size").desc(), F.col("id")], 6),
                6,
                ["", "## Themes in the conversation"],
                F.concat(
                    F.format_string("- **%s** — %d posts", "label", "size"),
                    F.when(F.size("tickers") > 0, F.concat(F.lit(" (mostly "), names, F.lit(")"))).otherwise(F.lit("")),
                    F.format_string(", sentiment %s.", fixed_text(F.col("sentiment_avg"), 2, signed=True)),
                ),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_text(lines: DataFrame) -> DataFrame:
    """The lines in order as one Markdown text."""
    packed = lines.agg(F.array_sort(F.collect_list(F.struct("section", "pos", "line"))).alias("l"))
    return packed.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))
