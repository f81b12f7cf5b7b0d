"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def to_utc(now: datetime) -> datetime:
    """Naive datetimes are taken as UTC."""
    return now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)


def micros(now: datetime) -> int:
    """Epoch microseconds, exactly."""
    delta = to_utc(now) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def ts_lit(now: datetime) -> Column:
    """A timestamp literal that Parquet filters can be pushed down with."""
    return F.lit(to_utc(now))


def floor_div(col: Column, divisor: int) -> Column:
    """Integer division rounding towards minus infinity."""
    d = F.lit(divisor).cast("long")
    return F.call_function("div", col - F.pmod(col, d), d)


def lookup(col: Column, values: Mapping[str, object], default) -> Column:
    """Constant lookup by key as one CASE expression."""
    expr = None
    for key, value in values.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(col == key, F.lit(value))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def round_to(col: Column, digits: int) -> Column:
    """Round the binary value, halves away from zero.

    ``F.round`` rounds the shortest decimal text of a double instead, which turns
    values just below a half into halves.
    """
    scale = float(10**digits)
    return F.round(col * scale, 0) / scale


def fixed_text(col: Column, digits: int, signed: bool = False) -> Column:
    """The value with a fixed number of decimals; ``signed`` always shows the sign, also of ``-0.00``."""
    size = F.format_string(f"%.{digits}f", F.abs(round_to(col, digits)))
    positive = F.lit("+" if signed else "")
    return F.concat(F.when(col < 0, F.lit("-")).otherwise(positive), size)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda an outer expression is evaluated again for every element; a
    lambda variable is not.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def string_array(values) -> Column:
    """Constant array<string>, typed even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key group.

    Filtering ``row_number`` lets Spark cut each task to ``k`` rows per key before
    the shuffle, so a hot key sends at most ``k`` rows per task to its reducer.
    """
    column = rank or "__rank"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(column) <= k)
    return kept if rank else kept.drop(column)


def map_text(col: Column) -> Column:
    """``k=v`` pairs of a map, ordered by key, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ",",
    )
