"""Merged tables in cells of (day, hash bucket of a key), committed by one small manifest.

A merge writes the cells it changes into a folder of their own and then renames a manifest
into place that says in which folder each cell's rows are. Readers follow the newest
manifest, so they see a merge whole or not at all. What a failed job leaves behind is named
by no manifest and goes with the next clean-up. Each table has a single writer; a second one
that commits meanwhile is told so.

    path/_manifests/0000000007.json       schema, number of buckets, folder of every cell
    path/version=<id>/day=<d>/bucket=<b>  Parquet files of the cells written by one merge
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.session import materialize
from murmur.sinks.storage import NO_DAY, file_system

BUCKETS = 16  # of a new table; choose it so that a day's bucket is about one file
KEPT_MANIFESTS = 2  # readers of the manifest before the newest are not cut off

Cell = tuple[date | None, int]


@dataclass(frozen=True)
class Manifest:
    """The state of a table. ``cells`` maps (day, bucket) to the version folder that holds it."""

    number: int
    schema: T.StructType
    buckets: int
    cells: dict[Cell, str]

    def to_json(self) -> str:
        cells = sorted([d.isoformat() if d else None, b, v] for (d, b), v in self.cells.items() if d) + sorted([None, b, v] for (d, b), v in self.cells.items() if not d)
        return json.dumps({"schema": self.schema.jsonValue(), "buckets": self.buckets, "cells": cells})

    @classmethod
    def from_json(cls, number: int, text: str) -> Manifest:
        data = json.loads(text)
        cells = {(date.fromisoformat(d) if d else None, b): v for d, b, v in data["cells"]}
        return cls(number, T.StructType.fromJson(data["schema"]), data["buckets"], cells)

    @property
    def days(self) -> list[date]:
        return sorted({d for d, _ in self.cells if d})


def _folder(cell: Cell, version: str) -> str:
    day, bucket = cell
    return f"version={version}/{f'day={day.isoformat()}' if day else NO_DAY}/bucket={bucket}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, root = file_system(spark, f"{path}/_manifests")
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[:10]) for n in names if re.fullmatch(r"\d{10}\.json", n))


def _manifest(spark: SparkSession, path: str, number: int) -> Manifest:
    fs, file = file_system(spark, f"{path}/_manifests/{number:010d}.json")
    stream = fs.open(file)
    try:
        return Manifest.from_json(number, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest, or None where there is no table."""
    numbers = _numbers(spark, path)
    return _manifest(spark, path, numbers[-1]) if numbers else None


def commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make ``manifest`` the newest one; the rename is the commit."""
    fs, folder = file_system(spark, f"{path}/_manifests")
    fs.mkdirs(folder)
    new = lambda name: spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    draft, final = new(f"_{uuid.uuid4().hex}"), new(f"{manifest.number:010d}.json")
    out = fs.create(draft)
    out.write(bytearray(manifest.to_json().encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"{path} was changed by another writer; run the merge again")


def _read(spark: SparkSession, path: str, manifest: Manifest, cells: Iterable[Cell]) -> DataFrame:
    """Rows of some cells with ``day`` and ``bucket``."""
    placed = T.StructType([*manifest.schema.fields, T.StructField("version", T.StringType()), T.StructField("day", T.DateType()), T.StructField("bucket", T.IntegerType())])
    folders = [f"{path}/{_folder(c, manifest.cells[c])}" for c in cells if c in manifest.cells]
    if not folders:
        return spark.createDataFrame([], placed).drop("version")
    return spark.read.schema(placed).option("basePath", path).parquet(*folders).drop("version")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The whole table as of its newest manifest, with its partition columns ``day`` and ``bucket``."""
    manifest = current(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no table at {path}")
    return _read(spark, path, manifest, sorted(manifest.cells, key=str))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, order: list[str]) -> str:
    """Write rows that carry ``day`` and ``bucket`` as a new version; a large cell is split by its measured size."""
    version = uuid.uuid4().hex
    placed = rows.hint("rebalance", "day", "bucket").sortWithinPartitions("day", "bucket", *order)
    placed.write.partitionBy("day", "bucket").parquet(f"{path}/version={version}")
    return version


def merge_cells(
    path: str, incoming: DataFrame, key: str, day_of: Callable[[], Column], order: list[str],
    combine: Callable[[DataFrame, DataFrame], DataFrame], keeps_day: bool = False, buckets: int = BUCKETS,
) -> None:
    """Merge ``incoming`` by ``combine(stored rows of the touched cells, incoming)``.

    ``incoming`` is evaluated once. A row's cell follows from its own day and key; with
    ``keeps_day`` a key that is stored already stays in the cell it has, which is found by
    reading nothing but the keys of the buckets that ``incoming`` falls into. Only touched
    cells are read and written; their number is bounded by days times buckets.
    """
    spark = incoming.sparkSession
    known = current(spark, path)
    manifest = known or Manifest(0, incoming.schema, buckets, {})
    placed = incoming.withColumns({"day": day_of(), "bucket": bucket_of(F.col(key), manifest.buckets)})
    batch = materialize(placed, "incoming")
    places = batch.select("day", "bucket")
    if keeps_day and manifest.cells:
        own = {r["bucket"] for r in batch.select("bucket").distinct().collect()}
        stored = _read(spark, path, manifest, [c for c in manifest.cells if c[1] in own])
        held = stored.select(key, F.col("day").alias("held_day"), F.lit(True).alias("held"))
        kept = F.when(F.col("held"), F.col("held_day")).otherwise(F.col("day"))
        places = batch.select(key, "day", "bucket").join(held, key, "left").select(kept.alias("day"), "bucket")
    touched = [(r["day"], r["bucket"]) for r in places.distinct().collect()]
    if not touched and known:
        return
    rows = combine(_read(spark, path, manifest, touched).drop("day", "bucket"), batch.drop("day", "bucket"))
    version = _write(rows.withColumns({"day": day_of(), "bucket": bucket_of(F.col(key), manifest.buckets)}), path, order)
    commit(spark, path, replace(manifest, number=manifest.number + 1, cells=manifest.cells | dict.fromkeys(touched, version)))
    vacuum(spark, path)


def filter_days(spark: SparkSession, path: str, first: date, young: Column, order: list[str]) -> list[date]:
    """Drop the days before ``first`` and the rows of that day that are not ``young``; returns the days that are gone."""
    manifest = current(spark, path)
    if manifest is None:
        return []
    cells = {c: v for c, v in manifest.cells.items() if c[0] is None or c[0] >= first}
    edge = [c for c in cells if c[0] == first]
    if edge:
        rows = _read(spark, path, manifest, edge).filter(young)
        left = [(first, r["bucket"]) for r in rows.select("bucket").distinct().collect()]
        cells = {c: v for c, v in cells.items() if c[0] != first}
        if left:
            cells |= dict.fromkeys(left, _write(rows, path, order))
    if cells != manifest.cells:
        commit(spark, path, replace(manifest, number=manifest.number + 1, cells=cells))
        vacuum(spark, path)
    return sorted(set(manifest.days) - {d for d, _ in cells})


def vacuum(spark: SparkSession, path: str, keep: int = KEPT_MANIFESTS) -> None:
    """Delete manifests but the newest ``keep`` and all cells that none of those names."""
    numbers = _numbers(spark, path)
    named = {_folder(c, v) for n in numbers[-keep:] for c, v in _manifest(spark, path, n).cells.items()}
    fs, root = file_system(spark, path)
    for n in numbers[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{n:010d}.json"), False)
    versions = {f.split("/")[0] for f in named}
    for status in fs.listStatus(root):
        version = status.getPath().getName()
        if not version.startswith("version="):
            continue
        if version not in versions:
            fs.delete(status.getPath(), True)
            continue
        for day in fs.listStatus(status.getPath()):
            for bucket in fs.listStatus(day.getPath()) if day.isDirectory() else ():
                if bucket.isDirectory() and f"{version}/{day.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                    fs.delete(bucket.getPath(), True)
