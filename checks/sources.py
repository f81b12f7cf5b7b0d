"""Normalisers over raw payloads derived from the test tables, scans and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import NOW, NOW_SQL, POSTS_SQL, all_posts, posts, table, ts_text, with_ctes
from murmur.functions.text import strip_html
from murmur.operators import trends
from murmur.session import scratch_path
from murmur.sources import coverage, files, payloads, prices, scans
from murmur.sources.dictionary import Dictionary

# Posts of an author that one object of an export lists; more are dealt to further objects.
POSTS_PER_OBJECT = 2000
OUT = ["id", "platform", "source", "author", "text", "url", "lang", "engagement"]


def _flat(df):
    return df.select(*OUT, ts_text("ts").alias("ts"))


def _raw(df, listing, position, **fields):
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select(listing.cast("string").alias("listing"), position.cast("bigint").alias("position"), payload.alias("payload"))


def _events(spark, d):
    return table(spark, d, "events")


def _iso(col="ts"):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def reddit(spark, d):
    event = F.col("event_id")
    ident = event.cast("string")
    body = F.when(event % 7 == 0, "[removed]").when(event % 5 == 0, F.lit("")).otherwise(F.repeat(F.concat(F.lit("body "), ident, F.lit(" ")), 120))
    raw = _raw(
        _events(spark, d), F.col("event_type"), event, id=ident, title=F.concat(F.lit("title "), ident), selftext=body,
        author=F.when(event % 4 != 0, F.concat(F.lit("u"), F.col("user_id"))), created_utc=F.unix_seconds("ts").cast("double"),
        score=F.floor("value"), num_comments=F.when(event % 3 == 0, F.col("user_id") % 9), permalink=F.concat(F.lit("/r/x/"), ident),
    )
    return _flat(payloads.normalize_reddit(raw))


def stocktwits(spark, d):
    event = F.col("event_id")
    ident = event.cast("string")
    raw = _raw(
        _events(spark, d), F.col("event_type"), event, id=ident, body=F.concat(F.lit("watching $A "), ident), created_at=_iso(),
        user=F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("username")), likes=F.struct(F.floor("value").alias("total")),
        symbols=F.array(F.struct(F.concat(F.lit("TK"), F.col("event_type")).alias("symbol")), F.struct(F.lit("ZZ").alias("symbol"))),
        entities=F.when(event % 2 == 0, F.struct(F.struct(F.when(event % 3 == 0, "Bullish").otherwise("Bearish").alias("basic")).alias("sentiment"))),
    )
    df = payloads.normalize_stocktwits(raw)
    return df.select(*OUT, ts_text("ts").alias("ts"), F.array_join("tickers", ",").alias("tickers"), "sentiment")


def bluesky(spark, d):
    event = F.col("event_id")
    ident = event.cast("string")
    uri = F.concat(F.lit("at://did:x/app.bsky.feed.post/"), F.floor(event / 2).cast("string"))
    raw = _raw(
        _events(spark, d), F.col("event_type"), event, uri=uri,
        record=F.struct(F.concat(F.lit("skeet "), ident).alias("text"), F.when(event % 5 != 0, _iso()).alias("createdAt"), F.when(event % 3 == 0, F.array(F.lit("fr"), F.lit("en"))).alias("langs")),
        author=F.struct(F.concat(F.lit("h"), F.col("user_id")).alias("handle")), indexedAt=_iso(), likeCount=F.floor("value"), repostCount=F.when(event % 2 == 0, F.col("user_id") % 4),
    )
    return _flat(payloads.normalize_bluesky(raw))


def mastodon(spark, d):
    page = F.col("page_id")
    raw = _raw(
        table(spark, d, "pages"), F.lit("stocks"), page, id=page.cast("string"), content=F.col("html"),
        created_at=F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + page), "yyyy-MM-dd'T'HH:mm:ss'.000Z'"),
        language=F.when(page % 5 == 0, "de").when(page % 5 != 1, "en"), account=F.struct(F.concat(F.lit("a"), page % 7).alias("acct")),
        url=F.col("url"), favourites_count=page % 11, reblogs_count=page % 3,
    )
    return _flat(payloads.normalize_mastodon(raw))


def html_text(spark, d):
    clean = strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(clean).alias("chars"), F.sha1(clean).alias("digest"))


def hackernews(spark, d):
    event = F.col("event_id")
    ident = event.cast("string")
    raw = _raw(
        _events(spark, d), F.col("event_type"), event, objectID=F.floor(event / 3).cast("string"),
        title=F.when(event % 9 != 0, F.concat(F.lit("story "), ident)), author=F.concat(F.lit("u"), F.col("user_id")),
        created_at_i=F.unix_seconds("ts"), points=F.when(event % 4 != 0, F.floor("value")), num_comments=F.col("user_id") % 6,
        url=F.when(event % 2 == 0, F.concat(F.lit("https://n.example/"), ident)).otherwise(F.lit("")),
    )
    return _flat(payloads.normalize_hackernews(raw))


def rss(spark, d):
    doc = F.col("doc_id")
    docs = table(spark, d, "documents")
    raw = _raw(
        docs, F.col("source"), doc, id=F.when(doc % 3 == 0, F.concat(F.lit("guid-"), doc)), link=F.when(doc % 3 != 2, F.concat(F.lit("https://f.example/"), doc)).otherwise(F.lit("")),
        title=F.when(doc % 10 != 9, F.concat(F.lit("headline "), doc)), summary=F.when(doc % 4 != 0, F.col("text")),
        published=F.when(doc % 6 != 0, F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + doc), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")),
    )
    return _flat(payloads.normalize_rss(raw, NOW))


def edgar(spark, d):
    event = F.col("event_id")
    ident = event.cast("string")
    form = F.when(F.col("event_type") == "view", "4").otherwise("8-K")
    title = F.when(event % 4 == 0, F.concat(F.lit("odd title "), ident)).otherwise(
        F.concat(form, F.lit(" - ACME "), F.upper("event_type"), F.lit(" CORP (00010"), F.lpad(ident, 6, "0"), F.lit(") (Filer)"))
    )
    raw = _raw(_events(spark, d), form, event, id=F.concat(F.lit("urn:"), ident), link=F.concat(F.lit("https://s.example/"), ident), title=title, updated=F.when(event % 3 != 0, _iso()))
    return _flat(payloads.normalize_edgar(raw, NOW))


def gdelt(spark, d):
    event = F.col("event_id")
    ident = event.cast("string")
    seen = F.when(event % 5 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    raw = _raw(
        _events(spark, d), F.col("event_type"), event, url=F.concat(F.lit("https://g.example/"), F.floor(event / 2).cast("string")),
        title=F.when(event % 8 != 0, F.concat(F.lit("article "), ident)).otherwise(F.lit("")), seendate=seen, domain=F.when(event % 3 == 0, F.lit("g.example")),
    )
    return _flat(payloads.normalize_gdelt(raw, NOW))


def finnhub(spark, d):
    doc = F.col("doc_id")
    docs = table(spark, d, "documents")
    raw = _raw(
        docs, F.col("lang"), doc, id=doc.cast("string"), headline=F.when(doc % 10 != 3, F.concat(F.lit("news "), doc)).otherwise(F.lit("")),
        summary=F.when(doc % 4 != 0, F.col("text")), source=F.when(doc % 2 == 0, F.lit("wire")), url=F.concat(F.lit("https://w.example/"), doc), datetime=F.lit(1_700_000_000) + doc,
    )
    return _flat(payloads.normalize_finnhub(raw))


def _bad_feeds(spark, d):
    """Landed items of three sources; by the last digit of the event some cannot be read or lack what a post needs."""
    event, events = F.col("event_id"), _events(spark, d)
    digit, ident = event % 10, event.cast("string")
    unless = lambda n, value: F.when(digit != n, value)
    broken = lambda raw: raw.withColumn("payload", F.when(F.col("position") % 10 == 0, "{broken").otherwise(F.col("payload")))
    reddit_raw = _raw(events, F.col("event_type"), event, id=unless(1, ident), title=ident, created_utc=unless(2, F.unix_seconds("ts").cast("double")))
    mastodon_raw = _raw(
        events, F.col("event_type"), event, id=ident, content=F.when(digit == 3, "<p>short</p>").otherwise("<p>long enough to stay</p>"),
        language=F.when(digit == 4, "de"), created_at=F.when(digit == 5, "soon").otherwise(_iso()),
    )
    hackernews_raw = _raw(events, F.col("event_type"), event, objectID=unless(7, ident), title=unless(6, ident), created_at_i=F.unix_seconds("ts"))
    return [payloads.reddit_feed(broken(reddit_raw)), payloads.mastodon_feed(broken(mastodon_raw)), payloads.hackernews_feed(broken(hackernews_raw))]


def _rejects(spark, d):
    one, two, three = (payloads.rejects_of(feed) for feed in _bad_feeds(spark, d))
    return one.unionByName(two).unionByName(three)


def rejected_rows(spark, d):
    return _rejects(spark, d).select("platform", "listing", "position", "reason")


def rejected_counts(spark, d):
    return payloads.rejected_counts(_rejects(spark, d))


def accepted_rows(spark, d):
    """What the same feeds turn into posts: with the rejected rows they are all that landed."""
    return scans.union_sources([payloads.posts_of(f) for f in _bad_feeds(spark, d)]).groupBy("platform").agg(F.count("*").alias("posts"))


def source_stats(spark, d):
    p = all_posts(spark, d).drop("k")
    feeds = [p.filter(F.col("platform") == e) for e in ("click", "view")] + [p.filter(~F.col("platform").isin("click", "view"))]
    return scans.source_stats(scans.union_sources(feeds))


def recent_posts(spark, d):
    return scans.load_recent_posts(posts(spark, d), NOW).select("id", "engagement", "source")


def completed_days(spark, d):
    rows = scans.completed_tagged_posts(all_posts(spark, d), NOW)
    return rows.groupBy("platform").agg(F.count("*").alias("n"), F.max(ts_text("ts")).alias("latest"))


def _pages(spark, d):
    p = posts(spark, d)
    page = F.floor((F.lit(1706637600) - F.unix_seconds("ts")) / 3000) + 1
    return p.select(F.col("platform").alias("label"), page.cast("int").alias("page_no"), "id", "ts")


def coverage_audit(spark, d):
    return coverage.coverage_audit(_pages(spark, d), NOW).withColumn("oldest", ts_text("oldest"))


def covered_items(spark, d):
    return coverage.covered_items(_pages(spark, d), NOW).select("label", "page_no", "id")


def _loose_rows(spark, d):
    """Events as an export with other field names and mixed values, all text."""
    event = F.col("event_id")
    ident = event.cast("string")
    return _events(spark, d).select(
        F.when(event % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("export \"row\", "), ident)).alias("body"),
        F.when(event % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("username"),
        F.when(event % 2 == 0, F.unix_seconds("ts").cast("string")).otherwise(_iso()).alias("created_utc"),
        F.when(event % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("ups"),
        F.when(event % 3 == 0, F.lit("")).otherwise(F.col("event_type")).alias("site"),
        F.when(event % 6 == 0, F.lit("")).otherwise(ident).alias("uid"),
        F.when(event % 2 == 0, F.lit("$tka, tkb ,")).otherwise(F.lit("")).alias("cashtags"),
    )


def _loaded(df):
    return df.select("id", "platform", "author", "text", "engagement", "lang", ts_text("ts").alias("ts"), F.array_join("tickers", ",").alias("tickers"))


def loose_rows(spark, d):
    return _loaded(files.rows_to_posts(_loose_rows(spark, d)))


def csv_export(spark, d):
    path = scratch_path(spark, "export") + ".csv"
    _loose_rows(spark, d).write.csv(path, header=True, quoteAll=True, escape='"')
    return _loaded(files.load_posts(spark, path))


def json_export(spark, d):
    path = scratch_path(spark, "export")
    _loose_rows(spark, d).write.json(path)
    return _loaded(files.load_posts(spark, path))


def json_posts_object(spark, d):
    """The same export as whole files, one object with a ``posts`` list per author; long lists are dealt to several objects."""
    path = scratch_path(spark, "export")
    _write_post_objects(_loose_rows(spark, d), path)
    return _loaded(files.load_posts(spark, path, whole=True))


def _write_post_objects(rows, path, posts_per_object=POSTS_PER_OBJECT):
    """One file per object; a file is read whole, so no object holds many more than ``posts_per_object`` posts.

    As many tasks write as hold the posts, each all of its files.
    """
    sizes = rows.groupBy(F.col("username").alias("name")).agg(F.ceil(F.count("*") / posts_per_object).alias("objects"))
    dealt = rows.withColumn("at", F.monotonically_increasing_id())
    dealt = dealt.join(sizes.filter("objects > 1"), F.col("username").eqNullSafe(F.col("name")), "left")
    packed = dealt.groupBy("username", F.col("at") % F.coalesce("objects", F.lit(1))).agg(F.collect_list(F.struct(*rows.columns)).alias("posts"))
    packed.select("posts").write.option("maxRecordsPerFile", 1).json(path)


def normalize_prices(spark, d):
    raw = _events(spark, d).select(
        F.col("event_type").alias("ticker"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        *[(F.col("value") * f).cast("string").alias(n) for n, f in (("open", 1.0), ("high", 1.23456), ("low", 0.5), ("close", 1.1))],
        (F.col("value") * 100 + 0.5).cast("string").alias("volume"),
    )
    return prices.normalize_prices(raw).withColumn("ts", ts_text("ts"))


SYMBOLS = Dictionary.build(
    {"BTC": {"name": "Bitcoin", "sector": "Crypto"}, "COIN": {"name": "Coinbase", "sector": "Crypto"}, "BRK.B": {"name": "Berkshire", "sector": "Financials"}, "LINK": {"name": "Link", "sector": "Other"}}
)


def quote_symbols(spark, d):
    names = F.element_at(F.array(*[F.lit(s) for s in ("BTC", "COIN", "BRK.B", "LINK", "NVDA")]), (F.col("user_id") % 5 + 1).cast("int"))
    rows = _events(spark, d).select(names.alias("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))
    return prices.with_quote_symbol(rows, SYMBOLS.entities(spark)).select("ticker", "quote_symbol", "n")


def payload_lookup(spark, d):
    """Every ticker of the run stored as a payload, then one looked up by symbol."""
    rows = trends.core_trends(posts(spark, d), NOW)
    meta = rows.select(F.concat(F.lit("ticker:"), F.col("ticker")).alias("key"), F.col("mentions").cast("string").alias("value"))
    return scans.ticker_payload(meta, "TKK").unionByName(scans.ticker_payload(meta, "tkk")).unionByName(scans.payload(meta, "nothing"))


REJECTED_SQL = """
with rejected as (select platform, event_type listing, event_id as position, reason from events, (values
  ('reddit', 0, 'unreadable'), ('reddit', 1, 'no id'), ('reddit', 2, 'no time'),
  ('mastodon', 0, 'unreadable'), ('mastodon', 3, 'short text'), ('mastodon', 4, 'language'), ('mastodon', 5, 'no time'),
  ('hackernews', 0, 'unreadable'), ('hackernews', 6, 'no title'), ('hackernews', 7, 'no id')) r(platform, digit, reason) where event_id % 10 = digit)
"""
NO_BODY = "event_id % 7 = 0 or event_id % 5 = 0"
ISO_OUT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') ts"
SPACES = r"[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
CLEAN = rf"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g'))"
LOOSE_SQL = (
    "select coalesce(nullif(case when event_id % 3 <> 0 then event_type end, ''), 'sample') || ':' || "
    "case when event_id % 6 <> 0 then event_id::varchar else substr(sha1('export \"row\", ' || event_id || case when event_id % 2 = 0 then cast(epoch_us(ts) // 1000000 as varchar) else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end), 1, 16) end id, "
    "case when event_id % 3 = 0 then 'sample' else event_type end platform, case when event_id % 4 = 0 then 'unknown' else 'u' || user_id end author, "
    "'export \"row\", ' || event_id as text, case when event_id % 5 = 0 then 0 else cast(trunc(value) as bigint) end engagement, 'en' lang, "
    f"{TS}, case when event_id % 2 = 0 then 'TKA,TKB' else '' end tickers from events where event_id % 10 <> 0"
)
def _page_sql(budget: str) -> str:
    return f"""
items as (select platform as label, cast(floor((1706637600 - epoch_us(ts) // 1000000) / 3000) as int) + 1 page_no, id, ts from posts),
pg as (select label, page_no, count(*) items, min(ts) oldest, min(ts) <= {NOW_SQL} - interval 6 hour done from items {budget} group by 1, 2),
kept as (select * from pg p where not exists (select 1 from pg q where q.label = p.label and q.page_no < p.page_no and q.done))
"""

QUERIES = {
    "normalize_reddit": (
        reddit,
        "select 'reddit:' || event_id id, 'reddit' platform, event_type source, case when event_id % 4 <> 0 then 'u' || user_id else 'unknown' end author, "
        f"'title ' || event_id || case when {NO_BODY} then '' else '. ' || repeat('body ' || event_id || ' ', 120) end as text, "
        "'https://reddit.com/r/x/' || event_id url, 'en' lang, cast(floor(value) as bigint) + case when event_id % 3 = 0 then user_id % 9 else 0 end engagement, "
        f"{TS} from events",
    ),
    "normalize_stocktwits": (
        stocktwits,
        "select 'stocktwits:' || event_id id, 'stocktwits' platform, event_type source, 'u' || user_id author, 'watching $A ' || event_id as text, "
        "'https://stocktwits.com/u' || user_id || '/message/' || event_id url, 'en' lang, cast(floor(value) as bigint) engagement, "
        f"{TS}, 'TK' || event_type || ',ZZ' tickers, case when event_id % 2 = 0 then case when event_id % 3 = 0 then 'bull' else 'bear' end end sentiment from events",
    ),
    "normalize_bluesky": (
        bluesky,
        "select 'bluesky:' || (event_id // 2) || ':' || left(sha1('at://did:x/app.bsky.feed.post/' || (event_id // 2)), 8) id, 'bluesky' platform, 'bluesky' source, 'h' || user_id author, "
        "'skeet ' || event_id as text, 'https://bsky.app/profile/h' || user_id || '/post/' || (event_id // 2) url, case when event_id % 3 = 0 then 'fr' else 'en' end lang, "
        f"cast(floor(value) as bigint) + 2 * (case when event_id % 2 = 0 then user_id % 4 else 0 end) engagement, {TS} from events "
        "qualify row_number() over (partition by event_id // 2 order by event_id) = 1",
    ),
    "normalize_mastodon": (
        mastodon,
        f"select 'mastodon:' || page_id id, 'mastodon' platform, '#stocks' source, 'a' || (page_id % 7) author, {CLEAN} as text, url, 'en' lang, "
        "page_id % 11 + 2 * (page_id % 3) engagement, strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%d %H:%M:%S') ts "
        f"from pages where page_id % 5 <> 0 and length({CLEAN}) >= 10",
    ),
    "html_text": (html_text, f"select page_id, length({CLEAN}) chars, sha1({CLEAN}) digest from pages"),
    "normalize_hackernews": (
        hackernews,
        "select 'hackernews:' || (event_id // 3) id, 'hackernews' platform, 'hackernews' source, 'u' || user_id author, 'story ' || event_id as text, "
        "case when event_id % 2 = 0 then 'https://n.example/' || event_id else 'https://news.ycombinator.com/item?id=' || (event_id // 3) end url, 'en' lang, "
        f"case when event_id % 4 <> 0 then cast(floor(value) as bigint) else 0 end + user_id % 6 engagement, {TS} from events where event_id % 9 <> 0 "
        "qualify row_number() over (partition by event_id // 3 order by event_id) = 1",
    ),
    "normalize_rss": (
        rss,
        "select 'rss:' || left(sha1(case when doc_id % 3 = 0 then 'guid-' || doc_id when doc_id % 3 = 1 then 'https://f.example/' || doc_id else 'headline ' || doc_id end), 16) id, "
        "'rss' platform, source, source author, 'headline ' || doc_id || case when doc_id % 4 <> 0 and text <> '' then '. ' || text else '' end as text, "
        "case when doc_id % 3 <> 2 then 'https://f.example/' || doc_id else '' end url, 'en' lang, 0 engagement, "
        f"strftime(case when doc_id % 6 <> 0 then make_timestamp((1700000000 + doc_id) * 1000000) else {NOW_SQL} end, '%Y-%m-%d %H:%M:%S') ts "
        "from documents where doc_id % 10 <> 9",
    ),
    "normalize_edgar": (
        edgar,
        "select 'sec:' || left(sha1('urn:' || event_id), 16) id, 'sec' platform, case when event_type = 'view' then 'edgar-4' else 'edgar-8-k' end source, 'SEC EDGAR' author, "
        "case when event_id % 4 = 0 then 'odd title ' || event_id else 'ACME ' || upper(event_type) || ' CORP' end || ' ' || "
        "case when event_type = 'view' then 'reported an insider transaction (Form 4)' else 'filed an 8-K (material corporate event)' end || '.' as text, "
        f"'https://s.example/' || event_id url, 'en' lang, 0 engagement, strftime(case when event_id % 3 <> 0 then ts else {NOW_SQL} end, '%Y-%m-%d %H:%M:%S') ts from events",
    ),
    "normalize_gdelt": (
        gdelt,
        "select 'gdelt:' || left(sha1('https://g.example/' || (event_id // 2)), 16) id, 'gdelt' platform, case when event_id % 3 = 0 then 'g.example' else 'gdelt' end source, "
        "case when event_id % 3 = 0 then 'g.example' else 'unknown' end author, 'article ' || event_id as text, 'https://g.example/' || (event_id // 2) url, 'en' lang, 0 engagement, "
        f"strftime(case when event_id % 5 <> 0 then ts else {NOW_SQL} end, '%Y-%m-%d %H:%M:%S') ts from events where event_id % 8 <> 0 "
        "qualify row_number() over (partition by event_id // 2 order by event_id) = 1",
    ),
    "normalize_finnhub": (
        finnhub,
        "select 'finnhub:' || doc_id id, 'finnhub' platform, case when doc_id % 2 = 0 then 'wire' else lang end source, case when doc_id % 2 = 0 then 'wire' else 'finnhub' end author, "
        "'news ' || doc_id || case when doc_id % 4 <> 0 and text <> '' then '. ' || text else '' end as text, 'https://w.example/' || doc_id url, 'en' lang, 0 engagement, "
        "strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S') ts "
        "from documents where doc_id % 10 <> 3",
    ),
    "source_stats": (source_stats, with_ctes(POSTS_SQL) + "select platform, count(*) posts, count(*) filter (where len(tickers) > 0) with_tickers from allposts group by 1"),
    "recent_posts": (
        recent_posts,
        with_ctes(POSTS_SQL) + f"select id, engagement, platform source from posts where ts >= {NOW_SQL} - interval 168 hour",
    ),
    "completed_days": (
        completed_days,
        with_ctes(POSTS_SQL) + "select platform, count(*) n, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) latest from allposts where ts < date '2024-01-30' group by 1",
    ),
    "coverage_audit": (
        coverage_audit,
        with_ctes(POSTS_SQL, _page_sql("where page_no <= 8"))
        + "select label, count(*) pages, cast(sum(items) as bigint) items, strftime(min(oldest), '%Y-%m-%d %H:%M:%S') oldest, max(page_no) = 8 and not bool_or(done) saturated from kept group by 1",
    ),
    "covered_items": (
        covered_items,
        with_ctes(POSTS_SQL, _page_sql("")) + "select label, page_no, id from items where (label, page_no) in (select (label, page_no) from kept)",
    ),
    "loose_rows": (loose_rows, LOOSE_SQL),
    "csv_export": (csv_export, LOOSE_SQL),
    "json_export": (json_export, LOOSE_SQL),
    "json_posts_object": (json_posts_object, LOOSE_SQL),
    "rejected_rows": (rejected_rows, REJECTED_SQL + "select * from rejected"),
    "rejected_counts": (rejected_counts, REJECTED_SQL + "select platform, reason, count(*) items from rejected group by 1, 2"),
    "accepted_rows": (accepted_rows, REJECTED_SQL + "select platform, (select count(*) from events) - count(*) posts from rejected group by 1"),
    "normalize_prices": (
        normalize_prices,
        f"select event_type ticker, {TS}, round(value, 4) as open, round(value * 1.23456::double, 4) high, round(value * 0.5::double, 4) low, round(value * 1.1::double, 4) as close, "
        "cast(trunc(value * 100 + 0.5::double) as bigint) volume from events",
    ),
    "quote_symbols": (
        quote_symbols,
        "select ticker, case ticker when 'BTC' then 'BTC-USD' when 'BRK.B' then 'BRK-B' else ticker end quote_symbol, count(*) n "
        "from (select ['BTC', 'COIN', 'BRK.B', 'LINK', 'NVDA'][user_id % 5 + 1] ticker from events) group by 1",
    ),
    "payload_lookup": (
        payload_lookup,
        with_ctes(POSTS_SQL) + f"select count(*)::varchar as value from mentions where ticker = 'TKK' and ts >= {NOW_SQL} - interval 24 hour having count(*) >= 3",
    ),
}
