"""Duplicate handling: by id, by key, and copy-paste campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import top_per_group
from murmur.functions.text import COPYPASTE_MIN_CHARS, copypaste_fingerprint, normalized_tokens


def dedupe_posts(posts: DataFrame) -> DataFrame:
    """One row per id: highest engagement, then earliest."""
    order = [F.col("engagement").desc(), F.col("ts").asc(), F.col("platform").asc(), F.col("text").asc()]
    return top_per_group(posts, ["id"], order, 1)


def collapse_near_duplicates(posts: DataFrame) -> DataFrame:
    """Fold copies of one long text into the earliest post, adding up engagement.

    Short posts and posts without a text have no fingerprint and never shuffle. Long posts are aggregated, not
    windowed: copies combine inside each task first, so a campaign that holds a third
    of all rows reaches its reducer as one row per task.
    """
    norm = normalized_tokens(F.col("text"))
    is_long = F.coalesce(F.length(norm) >= COPYPASTE_MIN_CHARS, F.lit(False))
    rest = [c for c in posts.columns if c not in ("ts", "id", "engagement")]
    origin = F.min_by(F.struct("ts", "id", *rest), F.struct("ts", "id"))
    folded = (
        posts.withColumn("__fp", copypaste_fingerprint(F.col("text")))
        .filter(F.col("__fp").isNotNull())
        .groupBy("__fp")
        .agg(origin.alias("o"), F.sum("engagement").alias("engagement"))
        .select(*[F.col("engagement") if c == "engagement" else F.col(f"o.{c}") for c in posts.columns])
    )
    return posts.filter(~is_long).unionByName(folded)
