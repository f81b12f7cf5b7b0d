"""Constant lookup tables of any size inside expressions.

The keys are dealt to slots by checksum, a few per slot, so a lookup looks at a handful of
keys whatever the size of the table. The table is one folded literal of the plan.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS_PER_SLOT = 2
LISTED = 256  # so many keys at most are listed in the plan themselves


def slotted(values: Mapping[str, object], ddl: str) -> Callable[[Column], Column]:
    """A function from a string column to the value of type ``ddl`` stored for it, or null."""
    slots: list[dict] = [{} for _ in range(max(1, len(values) // KEYS_PER_SLOT))]
    for key, value in values.items():
        slots[zlib.crc32(key.encode()) % len(slots)][key] = value
    table = F.from_json(F.lit(json.dumps(slots)), f"array<map<string,{ddl}>>")
    n = F.lit(len(slots))
    return lambda key: F.try_element_at(F.get(table, F.pmod(F.crc32(key.cast("binary")), n).cast("int")), key)


def member(keys: Iterable[str]) -> Callable[[Column], Column]:
    """A function that tells whether a string column is one of ``keys``; null is not."""
    known = sorted(set(keys))
    if len(known) <= LISTED:
        return lambda key: F.coalesce(key.isin(known), F.lit(False))
    found = slotted(dict.fromkeys(known, True), "boolean")
    return lambda key: F.coalesce(found(key), F.lit(False))
