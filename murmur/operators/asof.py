"""Backward as-of join with a tolerance, as an equi-join on time cells.

Each right row is valid from its own time until the next right row of its key, but
no longer than the tolerance. The intervals of a key are disjoint. Cut into cells of
fixed width they become equi-join keys, so neither side is ever sorted per key in
one task: a hot key spreads over its cells, and adaptive skew splitting can divide
the left side of a hot cell further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.exprs import HOUR_US, floor_div


def _cell(us: Column, width_us: int) -> Column:
    return floor_div(us, width_us)


def validity_intervals(right: DataFrame, key: str, ts: str, tolerance_us: int) -> DataFrame:
    """Right rows with ``valid_from`` and ``valid_to`` in epoch microseconds; ``next_from`` bounds it exclusively.

    The successor of a row only matters within the tolerance, so it is looked up
    among rows of the same and the next stretch of that length; every window
    partition is one stretch of one key.
    """
    rows = right.withColumn("valid_from", F.unix_micros(ts))
    own = _cell(F.col("valid_from"), tolerance_us)
    copies = rows.withColumn("__own", own).withColumn("__stretch", F.explode(F.array(own, own - 1)))
    w = Window.partitionBy(key, "__stretch").orderBy("valid_from")
    return (
        copies.withColumn("next_from", F.lead("valid_from").over(w))
        .filter(F.col("__stretch") == F.col("__own"))
        .withColumn("valid_to", F.col("valid_from") + tolerance_us)
        .drop("__own", "__stretch")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    columns: list[str],
    tolerance_hours: float = 30.0,
    cell_hours: int = 6,
) -> DataFrame:
    """``left`` with ``columns`` of the last right row at or before ``left_ts``.

    All left rows stay; columns are null where no right row lies within the
    tolerance. ``right`` must be unique by (key, right_ts).
    """
    tolerance_us, width = int(tolerance_hours * HOUR_US), cell_hours * HOUR_US
    intervals = validity_intervals(right.select(key, right_ts, *columns), key, right_ts, tolerance_us)
    last = F.least("valid_to", F.coalesce(F.col("next_from") - 1, F.col("valid_to")))
    cells = intervals.withColumn(
        "__cell", F.explode(F.sequence(_cell(F.col("valid_from"), width), _cell(last, width)))
    ).select(
        F.col(key).alias("__key"), "__cell", "valid_from", last.alias("__last"), *[F.col(c).alias(f"__{c}") for c in columns]
    )
    marked = left.withColumn("__us", F.unix_micros(left_ts)).withColumn("__lcell", _cell(F.col("__us"), width))
    matched = marked.join(
        cells,
        (marked[key] == cells["__key"])
        & (F.col("__lcell") == F.col("__cell"))
        & (F.col("__us") >= F.col("valid_from"))
        & (F.col("__us") <= F.col("__last")),
        "left",
    )
    return matched.select(*left.columns, *[F.col(f"__{c}").alias(c) for c in columns])
