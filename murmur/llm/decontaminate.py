"""Benchmark items inside documents: MinHash containment search by size classes, verified exactly.

Items are classed by their number of shingles. For a class of up to ``m`` shingles every
text is covered by windows of ``1.5 m`` shingles that start every ``m / 2``, so that any
passage of an item's length lies inside a window little longer than itself; what would
be a hopeless Jaccard similarity against a long document is at least 0.3 against that
window. A window and an item are compared where one of ``HASHES`` MinHash values agrees;
the documents under the window are then checked by their exact shingle sets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmur.llm.inputs import cut, texts
from murmur.llm.words import BATCH_BYTES, SHINGLE_WORDS, shingles

HASHES = 32
BASE = 4  # shingles per smallest block of window minima; fewer for the smallest classes
BLOCK_BYTES = 4 << 20  # item texts searched in one scan of the documents
_FACTORS = np.random.RandomState(20).randint(1, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def size_class(n: int) -> int:
    """The smallest of 2, 4, 8, 16, 24, 32, 48, 64, 96, 128, ... that is not below ``n``."""
    m = 2
    while m < n:
        m = m * 2 if m < 16 else m * 3 // 2 if m & (m - 1) == 0 else m // 3 * 4
    return m


class ItemIndex:
    """A block of items: their shingle sets and, per size class and hash, their MinHash values."""

    def __init__(self, ids: list, column: pa.Array, size: int):
        flat, offsets = shingles(column, size)
        self.ids, self.sets = [], []
        members = defaultdict(list)
        for i, item in enumerate(ids):
            part = flat[offsets[i] : offsets[i + 1]]
            if len(part):
                members[size_class(len(part))].append(len(self.ids))
                self.ids.append(item)
                self.sets.append(np.unique(part))
        self.classes = {}
        for m, items in sorted(members.items()):
            rows = []
            for factor in _FACTORS:
                low = np.array([(self.sets[i] * factor).min() for i in items], np.uint64)
                order = np.argsort(low, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[(low & np.uint64(0xFFFF)).astype(np.int64)] = True
                rows.append((low[order], np.array(items)[order], seen))
            self.classes[m] = rows

    def candidates(self, flat: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) wherever a window over the text shares a MinHash value with the item.

        Windows run over the batch as a whole; one that covers several texts names them all.
        """
        pad = -len(flat) % BASE
        padded = np.concatenate([flat, flat[-1:].repeat(pad)]) if pad else flat
        found: set[tuple[int, int]] = set()
        for row, factor in enumerate(_FACTORS):
            lows = {1: padded * factor}
            lows[2] = np.minimum(lows[1][0::2], lows[1][1::2])
            lows[4] = np.minimum(lows[2][0::2], lows[2][1::2])
            for m, rows in self.classes.items():
                values, items, seen = rows[row]
                base = min(BASE, m // 2)
                low = lows[base]
                hop = m // 2 // base
                steps = -(-len(low) // hop)
                hops = np.concatenate([low, low[-1:].repeat(steps * hop - len(low))]).reshape(steps, hop)
                least = hops[:, 0].copy()
                for i in range(1, hop):
                    np.minimum(least, hops[:, i], out=least)
                window = least.copy()
                for i in (1, 2):
                    if steps > i:
                        np.minimum(window[:-i], least[i:], out=window[:-i])
                hits = np.flatnonzero(seen[(window & np.uint64(0xFFFF)).astype(np.int64)])
                begin, end = np.searchsorted(values, window[hits], "left"), np.searchsorted(values, window[hits], "right")
                for w, a, b in zip(hits[begin < end], begin[begin < end], end[begin < end]):
                    start = w * hop * base
                    first = int(np.searchsorted(offsets, start, "right")) - 1
                    last = int(np.searchsorted(offsets, min(start + 3 * hop * base, len(flat)), "left"))
                    for d in range(first, last):
                        if offsets[d] < offsets[d + 1]:
                            found.update((d, int(i)) for i in items[a:b])
        return found

    def search(self, column: pa.Array, size: int, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of every text that holds at least ``threshold`` of an item's shingles."""
        flat, offsets = shingles(column, size)
        if not len(flat) or not self.ids:
            return
        by_text = defaultdict(list)
        for d, i in self.candidates(flat, offsets):
            by_text[d].append(i)
        for d in sorted(by_text):
            held = np.unique(flat[offsets[d] : offsets[d + 1]])
            for i in sorted(by_text[d]):
                own = self.sets[i]
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                shared = int((held[at] == own).sum())
                if shared >= threshold * len(own):
                    yield d, i, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """The items in blocks of bounded size, read from Spark one partition at a time."""
    ids, kept, held = [], [], 0
    for row in texts(items, id_col, text_col).toLocalIterator():
        ids.append(row["doc_id"])
        kept.append(row["text"])
        held += len(row["text"])
        if held >= block_bytes:
            yield ItemIndex(ids, pa.array(kept, pa.large_string()), size)
            ids, kept, held = [], [], 0
    if ids:
        yield ItemIndex(ids, pa.array(kept, pa.large_string()), size)


def find_contained(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = SHINGLE_WORDS, id_col: str = "doc_id",
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every document row that holds ``threshold`` of an item's shingles.

    Containment is the share of the item's distinct shingles that the document has. Items
    and documents shorter than a shingle are one shingle; null, empty and wordless ones
    match nothing. Repeated rows and null ids are searched like others. The items are the
    query set: they are broadcast in blocks of ``block_bytes``, each searched in one scan
    of the documents, which are not shuffled.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    result = spark.createDataFrame([], schema)
    rows = texts(docs, id_col, text_col).select("text", "doc_id")
    for index in item_blocks(items, item_id_col, item_text_col, size, block_bytes):
        shared_index = spark.sparkContext.broadcast(index)

        def search(batches, shared_index=shared_index):
            index = shared_index.value
            for batch in batches:
                for piece in cut(batch, BATCH_BYTES):
                    found = list(index.search(piece.column(0), size, threshold))
                    if found:
                        ids = piece.column(1).to_pylist()
                        out = [(ids[d], index.ids[i], n, len(index.sets[i]), n / len(index.sets[i])) for d, i, n in found]
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        result = result.unionByName(rows.mapInArrow(search, schema))
    return result


def drop_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = SHINGLE_WORDS,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; decided where the rows are read."""
    spark, names, place = docs.sparkSession, docs.columns, docs.columns.index(text_col)
    kept = docs
    for index in item_blocks(items, item_id_col, item_text_col, size, block_bytes):
        shared_index = spark.sparkContext.broadcast(index)

        def keep(batches, shared_index=shared_index):
            index = shared_index.value
            for batch in batches:
                for piece in cut(batch.select([place, *(i for i in range(len(names)) if i != place)]), BATCH_BYTES):
                    filled = pa.array([t or "" for t in piece.column(0).to_pylist()], pa.large_string()) if piece.column(0).null_count else piece.column(0)
                    bad = {d for d, _, _ in index.search(filled, size, threshold)}
                    clean = piece.filter(pa.array([d not in bad for d in range(piece.num_rows)]))
                    yield clean.select(batch.schema.names)

        kept = kept.mapInArrow(keep, kept.schema)
    return kept
