"""Explicit schemas of the logical tables as DDL; nothing on a hot path is inferred."""

from __future__ import annotations

POSTS = (
    "id string, platform string, source string, author string, text string, url string, "
    "lang string, engagement bigint, sentiment string, sentiment_score double, "
    "tickers array<string>, topic_id int, ts timestamp"
)

BUCKETS = (
    "ticker string, bucket_start timestamp, bucket_minutes int, mentions bigint, "
    "engagement bigint, bull bigint, bear bigint, neutral bigint, sentiment_avg double, "
    "platforms map<string,bigint>"
)

PRICES = (
    "ticker string, ts timestamp, open double, high double, low double, close double, volume bigint"
)

ALERTS = (
    "ticker string, kind string, score double, message string, created_at timestamp"
)

META = "key string, value string, updated_at timestamp"

ENTITIES = "ticker string, name string, sector string"
