"""JSON artifacts: one compact document per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_rows(df: DataFrame, key: Column) -> DataFrame:
    """(key, value) rows with each input row as one JSON document."""
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def list_payload(df: DataFrame, key: str, field: str, order: list[str]) -> DataFrame:
    """One (key, value) row holding all rows of a short result as a JSON list.

    For results with a fixed row limit only; longer ones are read as tables.
    """
    rest = [c for c in df.columns if c not in order]
    packed = F.sort_array(F.collect_list(F.struct(*order, *rest)))
    return df.agg(F.to_json(F.struct(packed.alias(field))).alias("value")).select(F.lit(key).alias("key"), "value")


def write_artifacts(payloads: DataFrame, path: str) -> None:
    """One directory per key holding its document."""
    payloads.select("key", "value").repartition("key").write.mode("overwrite").partitionBy("key").text(path)
