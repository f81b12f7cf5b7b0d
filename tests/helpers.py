from datetime import datetime, timedelta, timezone

from murmur import schemas

NOW = datetime(2026, 6, 11, 12, 0, tzinfo=timezone.utc)

FIELDS = [p.split()[0] for p in schemas.POSTS.split(", ")]


def post(pid, hours_ago=0.0, tickers=(), now=NOW, **kw):
    row = {
        "id": str(pid), "platform": "sample", "source": "", "author": "a", "text": "text", "url": "", "lang": "en",
        "engagement": 0, "sentiment": None, "sentiment_score": None, "tickers": list(tickers), "topic_id": None,
        "ts": now - timedelta(hours=hours_ago),
    }
    row.update(kw)
    return tuple(row[f] for f in FIELDS)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.POSTS)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
