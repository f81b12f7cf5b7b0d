"""Hard negatives: for every anchor and positive the best different-label rows inside a score window.

Anchors, the stated query set, come in blocks of bounded size; each block is joined by a
minimum spanning tree over the anchors' distances. Rows come in blocks too, and every
anchor block meets every row block in some task. Down the tree, a row's score at a child
lies within its score (or its bounds) at the parent plus or minus edge length times the
row's norm. Only rows whose bounds overlap a window of the child are scored there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.exprs import top_per_group
from murmur.session import materialize

ROW_BLOCK = 2048
ANCHOR_BLOCK = 256
BLOCK_BYTES = 1 << 20  # a block is closed earlier where its vectors are long
SCALE = 256

_EXACT = 2.0**53  # sums of products below this are exact in doubles
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

BLOCK_FIELDS = "width int, vec_ids binary, no_ids binary, labels binary, vectors binary"
TREE_FIELDS = BLOCK_FIELDS + ", parents binary, edges binary"
WINDOWS = "array<struct<anchor_at:int,positive_at:int,score:long>>"


def usable_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector array<double>): rows that take part, components as floor(256 x).

    Rows with a null label or vector or with a null or non-finite component are left out.
    Where the id is divisible by 7 the label moves on by one, modulo 10.
    """
    vec_id, label, vector = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long"), F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < F.lit(float("inf")))
    rows = embeddings.select(vec_id.alias("vec_id"), label.alias("label"), vector.alias("vector"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(F.forall("vector", finite))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # floor() gives a long; doubles from 2^52 on are whole already
    floor = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    return rows.select("vec_id", moved.alias("label"), F.transform("vector", lambda x: floor(x * SCALE)).alias("vector"))


class Block:
    """Some rows as arrays. Vectors of unequal length are filled up with zeros."""

    def __init__(self, width: int, vec_ids, no_ids, labels, vectors):
        self.vec_ids = np.frombuffer(vec_ids, "<i8")
        self.no_ids = np.frombuffer(no_ids, bool)  # a null id comes behind all others
        self.labels = np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(len(self.vec_ids), width)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1)) if width else np.zeros(len(self.vec_ids))

    @staticmethod
    def pack(ids: list, labels: list, vectors: list) -> tuple:
        width = max(map(len, vectors))
        dense = np.zeros((len(ids), width), "<f8")
        for i, v in enumerate(vectors):
            dense[i, : len(v)] = v
        known = np.array([0 if i is None else i for i in ids], "<i8")
        return (width, known.tobytes(), np.array([i is None for i in ids], bool).tobytes(), np.array(labels, "<i8").tobytes(), dense.tobytes())


def _blocks(rows: DataFrame, block_rows: int, fields: str, extra=None) -> DataFrame:
    """Rows packed within their partitions, at most ``block_rows`` and about ``BLOCK_BYTES`` a block."""
    schema = T._parse_datatype_string(fields)
    types = [pa.int32() if f.dataType.simpleString() == "int" else pa.binary() for f in schema.fields]

    def run(batches):
        ids, labels, vectors, size = [], [], [], 0

        def emit():
            packed = Block.pack(ids, labels, vectors)
            packed += extra(Block(*packed)) if extra else ()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packed, types)], schema.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                values = np.asarray(piece.column(2).flatten())
                lengths = np.asarray(pc.list_value_length(piece.column(2)))
                for vec_id, label, vector in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), np.split(values, np.cumsum(lengths)[:-1])):
                    if ids and (len(ids) >= block_rows or size + 8 * len(vector) > BLOCK_BYTES):
                        yield emit()
                        ids, labels, vectors, size = [], [], [], 0
                    ids.append(vec_id)
                    labels.append(label)
                    vectors.append(vector)
                    size += 8 * len(vector)
        if ids:
            yield emit()

    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent of every row, length of the edge to it) of a minimum spanning tree; row 0 is the root, its parent -1."""
    n = len(vectors)
    parent, edge = np.zeros(n, "<i4"), np.full(n, np.inf)
    parent[0], edge[0] = -1, 0.0
    outside = np.ones(n, bool)
    joined = 0
    for _ in range(n - 1):
        outside[joined] = False
        far = np.sqrt(((vectors - vectors[joined]) ** 2).sum(axis=1))
        nearer = outside & (far < edge)
        edge[nearer], parent[nearer] = far[nearer], joined
        joined = int(np.where(outside, edge, np.inf).argmin())
    return parent, edge


def _tree_bytes(block: Block) -> tuple:
    parent, edge = spanning_tree(block.vectors)
    return parent.tobytes(), edge.astype("<f8").tobytes()


def _top_down(parent: np.ndarray) -> list[int]:
    """Rows of a tree, every parent before its children."""
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent.tolist()):
        children.setdefault(p, []).append(i)
    order = list(children[-1])
    for i in order:  # grows while it is read
        order += children.get(i, [])
    return order


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products as 64-bit integers, exact; those beyond that range become its ends."""
    width = min(rows.shape[1], len(anchor))
    rows, anchor = rows[:, :width], anchor[:width]
    if not width or not len(rows):
        return np.zeros(len(rows), np.int64)
    if np.abs(rows).max() * np.abs(anchor).max() * width < _EXACT:
        return (rows @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    exact = (sum(int(x) * y for x, y in zip(row, whole)) for row in rows)
    return np.array([min(max(x, _LEAST), _MOST) for x in exact], np.int64)


def _first(values: np.ndarray, ids: np.ndarray, no_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``: higher scores first, then smaller ids, rows without an id last."""
    places = np.arange(len(values))
    if len(values) > 4 * k:  # the k-th best score with all its ties is enough
        places = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    order = np.lexsort((ids[places], no_ids[places], ~values[places]))
    return places[order[:k]]


def _id(block: Block, at: int) -> int | None:
    return None if block.no_ids[at] else int(block.vec_ids[at])


def best_positives(anchors: Block, rows: Block, k: int):
    """(anchor, id, score) of the first ``k`` other rows of each anchor's label in one block of rows."""
    for label in np.unique(anchors.labels):
        same = np.flatnonzero(rows.labels == label)
        held = rows.vectors[same]
        for a in np.flatnonzero(anchors.labels == label).tolist() if len(same) else ():
            value = scores(held, anchors.vectors[a])
            other = np.flatnonzero(rows.no_ids[same] | (rows.vec_ids[same] != anchors.vec_ids[a]))
            found = same[other]
            for i in _first(value[other], rows.vec_ids[found], rows.no_ids[found], k).tolist():
                yield a, _id(rows, found[i]), int(value[other[i]])


def window_scores(anchors: Block, parent: np.ndarray, edge: np.ndarray, rows: Block, windows: dict[int, list[tuple[int, int]]]):
    """(anchor, rows, their scores) for every anchor that has windows and rows that may lie in one.

    ``windows`` holds the (least, greatest) scores an anchor looks for. A row is scored at an
    anchor if its bounds there overlap one of the windows and its label is another; elsewhere
    the bounds go on down the tree, wider by edge length times the row's norm.
    """
    low, high = {}, {}
    waiting = np.bincount(parent[parent >= 0], minlength=len(parent))
    for a in _top_down(parent):
        p = int(parent[a])
        if p < 0:  # the root is scored throughout: the bounds below start from it
            value = scores(rows.vectors, anchors.vectors[a])
            at_least, at_most = value.astype(float), value.astype(float)
        else:
            reach = rows.norms * edge[a]
            reach = reach + 1.0 + 1e-9 * (reach + np.abs(low[p]) + np.abs(high[p]))  # more than norms and sums may round
            at_least, at_most = low[p] - reach, high[p] + reach
        wanted = np.zeros(len(rows.norms), bool)
        for least, greatest in windows.get(a, ()):
            wanted |= (at_most >= float(least)) & (at_least <= float(greatest))
        chosen = np.flatnonzero(wanted & (rows.labels != anchors.labels[a]))
        if p >= 0:
            exact = scores(rows.vectors[chosen], anchors.vectors[a])
            at_least[chosen] = at_most[chosen] = exact
            waiting[p] -= 1
            if not waiting[p]:
                del low[p], high[p]
        else:
            exact = value[chosen]
        if waiting[a]:
            low[a], high[a] = at_least, at_most
        if len(chosen):
            yield a, chosen, exact


def _tasks(spark, row_blocks: DataFrame) -> int:
    """In how many tasks anchors meet rows: at most one for every block of rows and twice the shuffle partitions."""
    return max(1, min(row_blocks.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _meetings(anchors: DataFrame, row_blocks: DataFrame, tasks: int) -> DataFrame:
    """Every block of anchors beside every block of rows.

    Rows are dealt to buckets once; the anchors, a hundredth of them or less, go to every bucket. The planner
    takes them for as small as one copy is and would gather all copies on the driver; so both sides are shuffled.
    """
    dealt = row_blocks.select(*[F.col(c).alias(f"row_{c}") for c in row_blocks.columns], F.pmod(F.xxhash64("row_block"), F.lit(tasks)).alias("bucket"))
    sent = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    return dealt.join(sent.hint("merge"), "bucket")


def _pairs(batches, names: list[str]):
    """(row as a dictionary, anchors, rows) for every pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
            fields = ("width", "vec_ids", "no_ids", "labels", "vectors")
            yield row, Block(*(row[f] for f in fields)), Block(*(row[f"row_{f}"] for f in fields))


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = {"int": pa.int32(), "bigint": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[f.dataType.simpleString()]) for c, f in zip(columns, schema.fields)], schema.names)


def hard_negatives(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, greatest: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its
    first ``positives`` rows of the same label with another id. For each, the first
    ``negatives`` rows of other labels with ``least`` * positive_score <= 100 *
    negative_score <= ``greatest`` * positive_score are returned. Higher scores come first,
    ties by smaller id, rows without an id last.

    A row without an id is no anchor but may be found. Repeated rows each count; rows that
    share an id are not each other's positives, and each of them that is an anchor has rows of
    its own. Vectors of unequal length count as filled up with zeros, an empty one scores 0. Scores
    beyond 64 bits count as the nearest long. Other columns are left out; an empty table, or
    one without anchors, gives no rows.

    Both passes move one copy of the rows and, for each bucket of row blocks, one of the
    anchors; a task holds one block of each. What leaves it is at most ``positives`` or
    ``negatives`` rows an anchor and positive, cut again before they are shuffled.
    """
    spark = embeddings.sparkSession
    usable = usable_rows(embeddings, id_col, vector_col, label_col)
    row_blocks = _blocks(usable, ROW_BLOCK, BLOCK_FIELDS).withColumn("row_block", F.monotonically_increasing_id())
    row_blocks = materialize(row_blocks, "negatives-rows")
    asked = materialize(usable.filter(F.col("vec_id") % every == 0), "negatives-asked")
    dealt = asked.repartition(max(1, -(-asked.count() // ANCHOR_BLOCK)))
    anchors = _blocks(dealt, ANCHOR_BLOCK, TREE_FIELDS, _tree_bytes).withColumn("anchor_block", F.monotonically_increasing_id())
    anchors = materialize(anchors, "negatives-anchors")
    tasks = _tasks(spark, row_blocks)

    found_schema = T._parse_datatype_string("anchor_block long, anchor_at int, anchor_id long, positive_id long, score long")
    first = _meetings(anchors.drop("parents", "edges"), row_blocks, tasks)
    first_names = first.columns

    def find_positives(batches):
        for row, held, rows in _pairs(batches, first_names):
            yield _batch([(row["anchor_block"], a, _id(held, a), i, score) for a, i, score in best_positives(held, rows, positives)], found_schema)

    order = [F.col("score").desc(), F.col("found_id").asc_nulls_last()]
    best = first.mapInArrow(find_positives, found_schema).withColumnRenamed("positive_id", "found_id")
    best = materialize(top_per_group(best, ["anchor_block", "anchor_at"], order, positives, "positive_at"), "negatives-positives")

    windows = best.groupBy("anchor_block").agg(F.collect_list(F.struct("anchor_at", "positive_at", "score")).cast(WINDOWS).alias("windows"))
    second = _meetings(anchors.join(windows, "anchor_block"), row_blocks, tasks)
    second_names = second.columns
    negative_schema = T._parse_datatype_string("anchor_block long, anchor_at int, positive_at int, found_id long, score long")

    def find_negatives(batches):
        for row, held, rows in _pairs(batches, second_names):
            spans: dict[int, dict[int, tuple[int, int]]] = {}
            for w in row["windows"]:
                span = (-(-least * w["score"] // 100), greatest * w["score"] // 100)
                if span[0] <= span[1]:
                    spans.setdefault(w["anchor_at"], {})[w["positive_at"]] = span
            parent, edge = np.frombuffer(row["parents"], "<i4"), np.frombuffer(row["edges"], "<f8")
            kept = []
            for a, chosen, value in window_scores(held, parent, edge, rows, {a: list(s.values()) for a, s in spans.items()}):
                for at, (low, high) in spans[a].items():
                    inside = np.flatnonzero((value >= low) & (value <= high))
                    where = chosen[inside]
                    for i in _first(value[inside], rows.vec_ids[where], rows.no_ids[where], negatives).tolist():
                        kept.append((row["anchor_block"], a, at, _id(rows, where[i]), int(value[inside[i]])))
            yield _batch(kept, negative_schema)

    keys = ["anchor_block", "anchor_at", "positive_at"]
    mined = top_per_group(second.mapInArrow(find_negatives, negative_schema), keys, order, negatives, "rank")
    mined = mined.select(*keys, "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    held = best.select(*keys, "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(held, keys).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
