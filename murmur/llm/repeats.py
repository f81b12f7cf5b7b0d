"""Removal of repeated byte strings by refining q-gram buckets with the bucket numbers of later offsets.

A bucket number stands for all strings of one length that are equal: ``id_1`` is the
byte, and ``id_2q(i)`` comes from ``id_q(i)`` and ``id_q(i + q)``. Two numbers of 256-byte
strings, one at its start and one that ends where it ends, name a longer string.

Not every offset is refined. Each window of ``LENGTH`` bytes is represented by its anchor, the offset
in it whose q-gram has the least number; equal windows have their anchors at the same
place. Round by round only what still shares a bucket goes on:

1. anchors, bucketed by their q-gram: an anchor alone in its bucket is dropped;
2. the windows of an anchor in cells of ``CELL`` neighbouring starts. All windows of a cell
   contain its core and lie in its span. Cells alone with their core are dropped; of cells that share
   their whole span every window is repeated;
3. cells that share only the core: their windows one by one.

The starts of repeated windows give the bytes to remove.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.inputs import cut, discard, flat_bytes, texts
from murmur.session import materialize

LENGTH = 400
GRAM = 32  # bytes of the initial buckets
CELL = 41
SEGMENT = 1 << 19  # window starts handled at a time
BATCH_BYTES = 1 << 20

_BYTE = np.random.RandomState(5).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64)


def refine(ids: np.ndarray, step: int) -> np.ndarray:
    """Bucket numbers of strings twice as long, from those here and ``step`` later; shorter by ``step``."""
    joined = ids[:-step] * np.uint64(0x9E3779B97F4A7C15) + (ids[step:] ^ (ids[step:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return joined ^ (joined >> np.uint64(32))


def bucket_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the strings of ``length`` (a power of two) bytes at every offset."""
    ids, step = _BYTE[data], 1
    while step < length:
        if len(ids) <= step:
            return ids[:0]
        ids = refine(ids, step)
        step *= 2
    return ids


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(q-gram number, text, place in it, first and last window start) of the anchors of all windows.

    ``offsets`` bound the texts in ``data``; windows do not cross them. Segments overlap by a window.
    """
    found = []
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        if len(part) < length:
            break
        grams = bucket_ids(part, GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_least((grams & ~np.uint64((1 << 20) - 1)) | place, length - GRAM + 1)
        starts = np.arange(at, at + len(least))
        text = np.searchsorted(offsets, starts, "right") - 1
        fits = starts + length <= offsets[text + 1]
        starts, text = starts[fits], text[fits]
        anchor = (least[fits] & np.uint64((1 << 20) - 1)).astype(np.int64) + at
        if len(starts):
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
            last = np.append(new[1:], len(starts)) - 1
            base = offsets[text[new]]
            found.append((grams[anchor[new] - at], text[new], anchor[new] - base, starts[new] - base, starts[last] - base))
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    gram, text, place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))  # one anchor seen from two segments
    return gram[new], text[new], place[new], first[new], last[np.append(new[1:], len(last)) - 1]


def cells(place: np.ndarray, first: np.ndarray, last: np.ndarray):
    """(row, cell number, first start, last start) of the cells that hold the windows [first, last] of anchors."""
    low, high = (place - last) // CELL, (place - first) // CELL
    number = high - low + 1
    row = np.repeat(np.arange(len(place)), number)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + low[row]
    return row, cell, np.maximum(first[row], place[row] - cell * CELL - CELL + 1), np.minimum(last[row], place[row] - cell * CELL)


def _batches(batches):
    for batch in batches:
        yield from cut(batch, BATCH_BYTES)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _lists(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(the fields of a column of arrays of structs, laid end to end; the row of each element)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return [x.to_numpy(zero_copy_only=False) for x in flat.flatten()], row


def _emit_anchors(batches):
    for batch in _batches(batches):
        gram, text, place, first, last = anchors(*flat_bytes(batch.column(0)))
        k1, k2 = (batch.column(i).to_numpy()[text] for i in (1, 2))
        yield pa.RecordBatch.from_arrays([_long(x) for x in (gram, k1, k2, place, first, last)], ["gram", "k1", "k2", "place", "first", "last"])


def _emit_cells(batches):
    for batch in _batches(batches):
        data, offsets = flat_bytes(batch.column(0))
        (place, first, last), text = _lists(batch.column(3))
        row, cell, first, last = cells(place, first, last)
        text = text[row]
        begin, end = offsets[text], offsets[text + 1]
        core = place[row] + begin - cell * CELL
        span, stop = np.maximum(core - CELL + 1, begin), np.minimum(core + LENGTH, end)
        ids = bucket_ids(data, 256)
        edge = ((core - span) * 1024 + (stop - core)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # spans cut off by a text's ends differ from whole ones
        found = (ids[core], ids[core + LENGTH - CELL + 1 - 256], ids[span] ^ edge, ids[stop - 256])
        k1, k2, copies = (batch.column(i).to_numpy()[text] for i in (1, 2, 4))
        yield pa.RecordBatch.from_arrays([_long(x) for x in (*found, k1, k2, first, last, copies)], [c.split()[0] for c in CELL_SCHEMA.split(", ")])


def _emit_windows(batches):
    for batch in _batches(batches):
        data, offsets = flat_bytes(batch.column(0))
        (first, last, n), text = _lists(batch.column(3))
        ids = bucket_ids(data, 256)
        size = last - first + 1
        row = np.repeat(np.arange(len(first)), size)
        start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]
        at = start + offsets[text[row]]
        k1, k2 = (batch.column(i).to_numpy()[text[row]] for i in (1, 2))
        for i in range(0, max(1, len(row)), 1 << 18):
            part = slice(i, i + (1 << 18))
            columns = (ids[at[part]], ids[at[part] + LENGTH - 256], k1[part], k2[part], start[part], n[row[part]])
            yield pa.RecordBatch.from_arrays([_long(x) for x in columns], ["w1", "w2", "k1", "k2", "start", "n"])


def merged(first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes that windows starting in any [first, last] cover."""
    order = np.argsort(first, kind="stable")
    runs: list[tuple[int, int]] = []
    for a, b in zip(first[order].tolist(), (last[order] + length).tolist()):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b))
        else:
            runs.append((a, b))
    return runs


def _cut_out(batches):
    for batch in _batches(batches):
        (first, last), text = _lists(batch.column(3))
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        spans, kept = [], []
        for i, content in enumerate(batch.column(0).to_pylist()):
            content = content.encode()
            own = slice(bounds[i], bounds[i + 1])
            runs = merged(first[own], last[own])
            spans.append([{"start": a, "end": b} for a, b in runs])
            edges = [0, *(x for run in runs for x in run), len(content)]
            kept.append(b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(spans, kind), pa.array(kept, pa.binary())], ["k1", "k2", "spans", "kept"])


CELL_SCHEMA = "core1 long, core2 long, span1 long, span2 long, k1 long, k2 long, first long, last long, n long"
CELL_KEY = ["core1", "core2", "span1", "span2"]


class Repeats(NamedTuple):
    """``documents``: doc_id, k1, k2, n_bytes, sha256 of the whole text, one row per document row.
    ``cut``: k1, k2, spans (removed runs as start and end bytes), kept (what is left, as bytes), one row per different text that loses bytes."""

    documents: DataFrame
    cut: DataFrame


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere, in the same text or another.

    Strings never cross documents; overlapping occurrences count. Equal texts share the key
    (k1, k2) and are worked on once, with their number as weight; so null and empty texts, which are
    equal, and all texts shorter than ``LENGTH`` lose nothing. Repeated rows are copies. An
    empty table gives empty results. Kept bytes need not be whole UTF-8 characters.
    """
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(17), "text").alias("k2")]
    keyed = texts(docs, id_col, text_col).select("doc_id", "text", *key)
    narrow = keyed.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    narrow = materialize(narrow, "repeat-documents")
    copies = narrow.groupBy("k1", "k2").agg(F.min("doc_id").alias("speaker"), F.count("*").alias("copies"))

    long_texts = keyed.filter(F.octet_length("text") >= LENGTH)
    found = materialize(long_texts.select("text", "k1", "k2").mapInArrow(_emit_anchors, "gram long, k1 long, k2 long, place long, first long, last long"), "anchors")
    # Written first, so that adaptive execution can split a hot gram's anchors in the join.
    shared = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared-grams")
    lists = found.join(shared, "gram", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "first", "last")).alias("anchors"))
    wanted = lists.join(copies, ["k1", "k2"]).withColumnsRenamed({"k1": "j1", "k2": "j2"})
    same = (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & F.col("doc_id").eqNullSafe(F.col("speaker"))
    speaking = long_texts.join(wanted.hint("shuffle_hash"), same).select("text", "k1", "k2", "anchors", "copies").dropDuplicates(["k1", "k2"])
    speaking = materialize(speaking, "repeat-texts")
    for done in (found, shared):
        discard(done)

    cells_found = materialize(speaking.mapInArrow(_emit_cells, CELL_SCHEMA), "cells")
    kinds = cells_found.groupBy(*CELL_KEY).agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("one"))
    kinds = materialize(kinds, "cell-kinds")
    mixed = kinds.groupBy("core1", "core2").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core1", "core2")
    whole = cells_found.join(kinds.filter("n > 1").select(*CELL_KEY), CELL_KEY, "left_semi").select("k1", "k2", "first", "last")

    edges = kinds.join(mixed, ["core1", "core2"], "left_semi").groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"))
    edges = edges.agg(F.collect_list(F.struct("one.first", "one.last", "n")).alias("edges"))
    windows = speaking.select("text", "k1", "k2").join(edges, ["k1", "k2"]).select("text", "k1", "k2", "edges")
    windows = windows.mapInArrow(_emit_windows, "w1 long, w2 long, k1 long, k2 long, start long, n long")
    windows = materialize(windows, "edge-windows")
    repeated = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).filter("total > 1").select("w1", "w2")
    single = windows.filter("n = 1").join(repeated, ["w1", "w2"], "left_semi").select("k1", "k2", F.col("start").alias("first"), F.col("start").alias("last"))

    starts = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("starts"))
    removed = speaking.select("text", "k1", "k2").join(starts, ["k1", "k2"]).select("text", "k1", "k2", "starts")
    schema = "k1 long, k2 long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return Repeats(narrow, removed.mapInArrow(_cut_out, schema))
