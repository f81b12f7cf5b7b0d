"""Coverage audit of paged listings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import to_utc, ts_lit


def audited_pages(items: DataFrame, now: datetime, lookback_hours: int = 6, max_pages: int | None = None) -> DataFrame:
    """Pages that count per listing, newest first.

    ``items`` has ``label, page_no, id, ts``; a page without items is landed as one row
    with a null ``id``. Pages count up to the first one that reaches the look-back
    horizon or is empty, and not beyond a page budget where there is one. That first page is an
    aggregate, so a listing of any length needs no window.
    """
    horizon = ts_lit(to_utc(now) - timedelta(hours=lookback_hours))
    landed = items if max_pages is None else items.filter(F.col("page_no") <= max_pages)
    pages = (
        landed.groupBy("label", "page_no")
        .agg(F.count("id").alias("items"), F.min("ts").alias("oldest"))
        .withColumn("done", (F.col("items") == 0) | (F.col("oldest") <= horizon))
    )
    last = pages.groupBy("label").agg(F.min(F.when(F.col("done"), F.col("page_no"))).alias("last"))
    return pages.join(last, "label").filter(F.col("last").isNull() | (F.col("page_no") <= F.col("last"))).drop("last")


def coverage_audit(items: DataFrame, now: datetime, lookback_hours: int = 6, max_pages: int = 8) -> DataFrame:
    """Per listing: pages and items kept, oldest item, and whether the page budget ran out first."""
    pages = audited_pages(items, now, lookback_hours, max_pages)
    return pages.groupBy("label").agg(
        F.count("*").alias("pages"),
        F.sum("items").alias("items"),
        F.min("oldest").alias("oldest"),
        ((F.max("page_no") == max_pages) & ~F.bool_or("done")).alias("saturated"),
    )


def covered_items(items: DataFrame, now: datetime, lookback_hours: int = 6, max_pages: int | None = None) -> DataFrame:
    """The items on pages that count; all landed pages can, unless a page budget is given."""
    pages = audited_pages(items, now, lookback_hours, max_pages).select("label", "page_no")
    return items.filter(F.col("id").isNotNull()).join(pages, ["label", "page_no"], "left_semi")
