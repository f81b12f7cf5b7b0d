"""Mixed timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mixed_timestamp(value: Column) -> Column:
    """Epoch seconds (``1785500000``, ``1785500000.5``) or ISO-8601 text; null when neither or out of range.

    Offsets and ``Z`` are honoured; text without an offset is read in the session
    zone, which the package pins to UTC.
    """
    text = value.cast("string")
    numeric = text.rlike(r"^(\d+\.?\d*|\.\d+)$")
    return F.when(numeric, F.timestamp_micros((text.try_cast("double") * 1_000_000).try_cast("long"))).otherwise(
        text.try_cast("timestamp")
    )
