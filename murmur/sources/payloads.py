"""Normalisers: landed raw payloads of each source become rows of the posts schema.

A landed table has ``listing`` (query, tag, feed, form or category), ``position``
(arrival order) and ``payload`` (the JSON text of one item). Each normaliser is a
projection and filter; only first-seen and per-feed budgets need a shuffle. All of
them work on streaming input too when the shuffling step is switched off. What makes no
post is not lost: ``rejects_of`` a source's feed gives those items with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import lookup, top_per_group, ts_lit
from murmur.functions.fixed_values import FILING_BLURBS
from murmur.functions.text import strip_html
from murmur.functions.timeparse import parse_mixed_timestamp

RAW_DDL = "listing string, position bigint, payload string"
REJECTED = ["platform", "listing", "position", "reason", "payload"]


@dataclass(frozen=True)
class Feed:
    """How one source's items become posts.

    ``before`` and ``after`` are (reason, condition) of items that make no post, tested before
    and after the first arrival per ``first_key`` is kept; ``columns`` project the posts schema.
    """

    platform: str
    rows: DataFrame
    columns: dict[str, Column]
    before: tuple[tuple[str, Column], ...] = ()
    after: tuple[tuple[str, Column], ...] = ()
    first_key: str | None = None


def _parse(raw: DataFrame, ddl: str) -> DataFrame:
    return raw.select("listing", "position", "payload", F.from_json("payload", ddl).alias("r")).select("listing", "position", "payload", "r", "r.*")


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _count(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0)).cast("bigint")


NAMES = [
    "id", "platform", "source", "author", "text", "url", "lang", "engagement",
    "sentiment", "sentiment_score", "tickers", "topic_id", "ts",
]
TYPES = {"engagement": "bigint", "sentiment_score": "double", "tickers": "array<string>", "topic_id": "int", "ts": "timestamp"}


def _project(feed: Feed, rows: DataFrame, *more: str) -> DataFrame:
    """The posts schema; anything a feed does not give takes its default."""
    defaults = {
        "source": F.lit(""), "author": F.lit("unknown"), "url": F.lit(""), "lang": F.lit("en"), "engagement": F.lit(0),
        "sentiment": F.lit(None), "sentiment_score": F.lit(None), "tickers": F.array(), "topic_id": F.lit(None),
    }
    merged = {**defaults, "platform": F.lit(feed.platform), **feed.columns}
    return rows.select(*more, *[merged[n].cast(TYPES.get(n, "string")).alias(n) for n in NAMES])


def _reason(rules: tuple[tuple[str, Column], ...]) -> Column:
    """The first reason whose condition holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules], F.lit(None).cast("string"))


def _judged(feed: Feed) -> tuple[DataFrame, DataFrame]:
    """(rows with a reason from ``before``, the first arrivals of the others with a reason from ``after``, or null)."""
    rows = feed.rows.withColumn("reason", _reason(feed.before))
    passed = rows.filter(F.col("reason").isNull())
    if feed.first_key:
        passed = first_seen(passed, feed.first_key)
    columns = {"id": feed.columns["id"], "ts": feed.columns["ts"]}
    last = (*feed.after, ("no id", columns["id"].isNull()), ("no time", columns["ts"].isNull()))
    return rows.filter(F.col("reason").isNotNull()), passed.withColumn("reason", _reason(last))


def posts_of(feed: Feed) -> DataFrame:
    """The items that make a post."""
    return _project(feed, _judged(feed)[1].filter(F.col("reason").isNull()))


def rejects_of(feed: Feed) -> DataFrame:
    """The items that make none, as landed, with the reason; those of which nothing could be read are ``unreadable``.

    A repeated arrival of an item that made a post is no reject.
    """
    nothing = F.coalesce(F.to_json("r"), F.lit("{}")) == "{}"
    reason = F.when(nothing, "unreadable").otherwise(F.col("reason"))
    parts = [df.filter(F.col("reason").isNotNull()) for df in _judged(feed)]
    both = [df.withColumns({"platform": F.lit(feed.platform), "reason": reason}).select(*REJECTED) for df in parts]
    return both[0].unionByName(both[1])


def rejected_counts(rejects: DataFrame) -> DataFrame:
    """Rejected items per source and reason."""
    return rejects.groupBy("platform", "reason").agg(F.count("*").alias("items"))


def first_seen(df: DataFrame, key: str) -> DataFrame:
    """The first arrival per key."""
    return top_per_group(df, [key], [F.col("position"), F.col("listing")], 1)


def reddit_feed(raw: DataFrame) -> Feed:
    rows = _parse(
        raw,
        "id string, title string, selftext string, author string, created_utc double, "
        "score bigint, num_comments bigint, permalink string",
    )
    body = _text("selftext")
    title = _text("title")
    keep_body = (body != "") & ~body.isin("[removed]", "[deleted]")
    return Feed(
        "reddit",
        rows,
        dict(
            id=F.concat(F.lit("reddit:"), F.col("id")),
            source=F.col("listing"),
            author=F.coalesce("author", F.lit("unknown")),
            text=F.when(keep_body, F.concat(title, F.lit(". "), body)).otherwise(title),
            ts=F.timestamp_micros((F.col("created_utc") * 1_000_000).cast("long")),
            engagement=_count("score") + _count("num_comments"),
            url=F.concat(F.lit("https://reddit.com"), _text("permalink")),
        ),
    )


def normalize_reddit(raw: DataFrame) -> DataFrame:
    return posts_of(reddit_feed(raw))


def stocktwits_feed(raw: DataFrame) -> Feed:
    rows = _parse(
        raw,
        "id string, body string, created_at string, user struct<username:string>, "
        "likes struct<total:bigint>, symbols array<struct<symbol:string>>, "
        "entities struct<sentiment:struct<basic:string>>",
    )
    mood = F.col("entities.sentiment.basic")
    return Feed(
        "stocktwits",
        rows,
        dict(
            id=F.concat(F.lit("stocktwits:"), F.col("id")),
            source=F.col("listing"),
            author=F.coalesce("user.username", F.lit("unknown")),
            text=_text("body"),
            ts=F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")),
            engagement=F.coalesce("likes.total", F.lit(0)),
            tickers=F.coalesce(F.transform("symbols", lambda s: s["symbol"]), F.array().cast("array<string>")),
            url=F.concat(F.lit("https://stocktwits.com/"), _text("user.username"), F.lit("/message/"), F.col("id")),
            sentiment=F.when(mood == "Bullish", "bull").when(mood == "Bearish", "bear"),
        ),
    )


def normalize_stocktwits(raw: DataFrame) -> DataFrame:
    return posts_of(stocktwits_feed(raw))


def bluesky_feed(raw: DataFrame, dedupe: bool = True) -> Feed:
    rows = _parse(
        raw,
        "uri string, record struct<text:string,createdAt:string,langs:array<string>>, "
        "author struct<handle:string>, indexedAt string, likeCount bigint, repostCount bigint",
    )
    key = F.substring_index("uri", "/", -1)
    handle = F.coalesce("author.handle", F.lit("unknown"))
    return Feed(
        "bluesky",
        rows,
        dict(
            id=F.concat(F.lit("bluesky:"), key, F.lit(":"), F.substring(F.sha1("uri"), 1, 8)),
            source=F.lit("bluesky"),
            author=handle,
            text=_text("record.text"),
            ts=parse_mixed_timestamp(F.coalesce("record.createdAt", "indexedAt")),
            engagement=_count("likeCount") + _count("repostCount") * 2,
            url=F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), key),
            lang=F.coalesce(F.try_element_at("record.langs", F.lit(1)), F.lit("en")),
        ),
        before=(("no id", F.col("uri").isNull()),),
        first_key="uri" if dedupe else None,
    )


def normalize_bluesky(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    return posts_of(bluesky_feed(raw, dedupe))


def mastodon_feed(raw: DataFrame, dedupe: bool = True) -> Feed:
    rows = _parse(
        raw,
        "id string, content string, created_at string, language string, account struct<acct:string>, "
        "url string, favourites_count bigint, reblogs_count bigint",
    )
    tongue = F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))
    rows = rows.withColumns({"body": strip_html(_text("content")), "tongue": tongue})
    return Feed(
        "mastodon",
        rows,
        dict(
            id=F.concat(F.lit("mastodon:"), F.col("id")),
            source=F.concat(F.lit("#"), F.col("listing")),
            author=F.coalesce("account.acct", F.lit("unknown")),
            text=F.col("body"),
            ts=parse_mixed_timestamp(F.col("created_at")),
            engagement=_count("favourites_count") + _count("reblogs_count") * 2,
            url=_text("url"),
            lang=F.col("tongue"),
        ),
        before=(("no id", _text("id") == ""),),
        after=(("short text", F.length("body") < 10), ("language", F.col("tongue") != "en")),
        first_key="id" if dedupe else None,
    )


def normalize_mastodon(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    return posts_of(mastodon_feed(raw, dedupe))


def hackernews_feed(raw: DataFrame, dedupe: bool = True) -> Feed:
    rows = _parse(
        raw,
        "objectID string, title string, author string, created_at_i bigint, points bigint, "
        "num_comments bigint, url string",
    )
    return Feed(
        "hackernews",
        rows,
        dict(
            id=F.concat(F.lit("hackernews:"), F.col("objectID")),
            source=F.lit("hackernews"),
            author=F.coalesce("author", F.lit("unknown")),
            text=F.col("title"),
            ts=F.timestamp_seconds("created_at_i"),
            engagement=_count("points") + _count("num_comments"),
            url=F.coalesce(
                F.nullif("url", F.lit("")),
                F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")),
            ),
        ),
        before=(("no title", _text("title") == ""), ("no id", F.col("objectID").isNull())),
        first_key="objectID" if dedupe else None,
    )


def normalize_hackernews(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    return posts_of(hackernews_feed(raw, dedupe))


def _feed_budget(rows: DataFrame, budget: int | None) -> DataFrame:
    """The first ``budget`` items per listing of one fetch; all of them by default."""
    if budget is None:
        return rows
    return top_per_group(rows, ["listing"], [F.col("position")], budget)


def rss_feed(raw: DataFrame, now: datetime, per_feed: int | None = None) -> Feed:
    rows = _parse(_feed_budget(raw, per_feed), "id string, link string, title string, summary string, published string")
    summary = _text("summary")
    native = F.coalesce(F.nullif("id", F.lit("")), F.nullif("link", F.lit("")), F.col("title"))
    return Feed(
        "rss",
        rows,
        dict(
            id=F.concat(F.lit("rss:"), F.substring(F.sha1(native), 1, 16)),
            source=F.col("listing"),
            author=F.col("listing"),
            text=F.when(summary != "", F.concat(F.col("title"), F.lit(". "), summary)).otherwise(F.col("title")),
            ts=F.coalesce(parse_mixed_timestamp(F.col("published")), ts_lit(now)),
            url=_text("link"),
        ),
        before=(("no title", _text("title") == ""),),
    )


def normalize_rss(raw: DataFrame, now: datetime, per_feed: int | None = None) -> DataFrame:
    return posts_of(rss_feed(raw, now, per_feed))


def company_name(title: Column) -> Column:
    """``8-K - ACME CORP (0001045810) (Filer)`` -> ``ACME CORP``; other titles unchanged."""
    found = F.regexp_extract(title, r"(?U)^[\w/-]+\s+-\s+(.+?)\s*\(\d{8,}\)", 1)
    return F.when(found != "", F.trim(found)).otherwise(title)


def edgar_feed(raw: DataFrame, now: datetime) -> Feed:
    rows = _parse(raw, "id string, link string, title string, updated string")
    native = F.coalesce(F.nullif("id", F.lit("")), F.col("title"))
    blurb = lookup(F.col("listing"), FILING_BLURBS, "")
    return Feed(
        "sec",
        rows,
        dict(
            id=F.concat(F.lit("sec:"), F.substring(F.sha1(native), 1, 16)),
            source=F.concat(F.lit("edgar-"), F.lower("listing")),
            author=F.lit("SEC EDGAR"),
            text=F.concat(company_name(F.col("title")), F.lit(" "), blurb, F.lit(".")),
            ts=F.coalesce(parse_mixed_timestamp(F.col("updated")), ts_lit(now)),
            url=_text("link"),
        ),
        before=(("no title", _text("title") == ""), ("form", ~F.coalesce(F.col("listing").isin(*FILING_BLURBS), F.lit(False)))),
    )


def normalize_edgar(raw: DataFrame, now: datetime) -> DataFrame:
    return posts_of(edgar_feed(raw, now))


def gdelt_feed(raw: DataFrame, now: datetime, dedupe: bool = True) -> Feed:
    rows = _parse(raw, "url string, title string, seendate string, domain string")
    rows = rows.withColumn("url", _text("url"))
    return Feed(
        "gdelt",
        rows,
        dict(
            id=F.concat(F.lit("gdelt:"), F.substring(F.sha1("url"), 1, 16)),
            source=F.coalesce("domain", F.lit("gdelt")),
            author=F.coalesce("domain", F.lit("unknown")),
            text=F.col("title"),
            ts=F.coalesce(F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")), ts_lit(now)),
            url=F.col("url"),
        ),
        before=(("no title", _text("title") == ""),),
        first_key="url" if dedupe else None,
    )


def normalize_gdelt(raw: DataFrame, now: datetime, dedupe: bool = True) -> DataFrame:
    return posts_of(gdelt_feed(raw, now, dedupe))


def finnhub_feed(raw: DataFrame, per_category: int | None = None) -> Feed:
    rows = _parse(
        _feed_budget(raw, per_category),
        "id string, headline string, summary string, source string, url string, datetime bigint",
    )
    summary = _text("summary")
    return Feed(
        "finnhub",
        rows,
        dict(
            id=F.concat(F.lit("finnhub:"), F.coalesce("id", F.lit("None"))),
            source=F.coalesce("source", "listing"),
            author=F.coalesce("source", F.lit("finnhub")),
            text=F.when(summary != "", F.concat(F.col("headline"), F.lit(". "), summary)).otherwise(F.col("headline")),
            ts=F.timestamp_seconds(F.coalesce("datetime", F.lit(0))),
            url=_text("url"),
        ),
        before=(("no title", _text("headline") == ""),),
    )


def normalize_finnhub(raw: DataFrame, per_category: int | None = None) -> DataFrame:
    return posts_of(finnhub_feed(raw, per_category))