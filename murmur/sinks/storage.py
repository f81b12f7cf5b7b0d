"""Listing and moving folders through the Hadoop file system of a path."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

NO_DAY = "day=__HIVE_DEFAULT_PARTITION__"


def file_system(spark: SparkSession, path: str):
    """(file system, path) on the JVM's side."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def exists(spark: SparkSession, path: str) -> bool:
    fs, root = file_system(spark, path)
    return fs.exists(root)


def partition_days(spark: SparkSession, path: str) -> list[date]:
    """The ``day=`` entries below ``path``; empty when it is absent. Rows without a day are in none of them."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n != NO_DAY)


def delete(spark: SparkSession, path: str) -> None:
    fs, root = file_system(spark, path)
    fs.delete(root, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder into the place of another, which may exist."""
    fs, root = file_system(spark, target)
    if fs.exists(root):
        fs.delete(root, True)
    fs.mkdirs(root.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), root):
        raise RuntimeError(f"{source} could not be moved to {target}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, root = file_system(spark, path)
    fs.mkdirs(root.getParent())
    fs.create(root, True).close()
