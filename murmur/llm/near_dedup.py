"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles, exactly. Those in at least 1 of ``CLIP`` documents are few and sent to
   every task: a shingle that frequent is so in some block of documents, which names it; all documents
   then count the named ones. All others are shuffled once, packed, to parts that count them and tell
   the texts which of theirs several documents have. What is left is in one document.
2. Every text is drawn ``BANDS * ROWS`` consistent weighted samples: a sample agrees
   between two texts with the probability of their weighted Jaccard similarity. ``ROWS``
   samples form the key of a band.
3. Texts with the same words fall together by a digest first. Of every bucket (band, key),
   each text is compared with the bucket's least one; links are pairs whose weighted
   Jaccard similarity, computed in full, is at least ``threshold``.
4. Buckets whose members then belong to several components are compared across these, but
   for pairs that cannot be similar: what no other such text has counts for neither, which
   bounds the similarity of a pair from above. That rules out texts that only share a passage.
   So every pair that shares a bucket has been compared, is bound below the threshold or is
   linked by others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.components import components
from murmur.llm.inputs import cut, flat_bytes, releasing, texts
from murmur.llm.words import BATCH_BYTES, SHINGLE_WORDS, mix64, shingles, word_hashes
from murmur.session import materialize

BANDS, ROWS = 20, 4
CLIP = 100  # shingles in at least 1 of CLIP documents are sent to every task, the others counted by a shuffle
POOL = 1 << 14  # random triples per hash function, picked by the shingle's hash
BLOCK_SHINGLES = 1 << 21  # of a block of documents that names its frequent shingles
DEALT_BYTES = 4 << 20  # of texts whose shingles are dealt together
PART_SHINGLES = 1 << 21  # of a part that is counted by sorting it, about
WORD_BYTES = 6  # of a word and the space behind it, about: tells how many parts there are
SLOTS = 64  # partial sums of a text's weight, for a bound of what two texts share
LOCAL_NAMES = 1 << 21  # named shingles up to this many are sent to every task; beyond it they are joined


def idf(documents: int, frequency):
    """ln(1 + N / df)."""
    return np.log1p(documents / frequency)


class Frequencies:
    """The weights of the frequent shingles; every other one has ``rare``, unless ``shared`` tells in how many documents it is.

    At most ``CLIP`` times the mean number of shingles per document can be frequent,
    however many documents there are.
    """

    def __init__(self, documents: int, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.documents = max(documents, 1)
        self.keys = keys[order]
        self.weights = idf(self.documents, counts[order].astype(float))
        self.rare = float(np.log1p(self.documents))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, flat: np.ndarray, shared: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        found = np.full(len(flat), self.rare)
        maybe = np.flatnonzero(self.seen[(flat & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == flat[maybe]
            found[maybe[hit]] = self.weights[at[hit]]
        if shared is not None and len(shared[0]):
            keys, documents = shared
            at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            hit = keys[at] == flat
            found[hit] = idf(self.documents, documents[at[hit]].astype(float))
        return found


def listed(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, documents) without repeats, sorted, from pairs of list columns."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    keys, first = np.unique(np.concatenate(flat[::2]).astype(np.int64).view(np.uint64), return_index=True)
    return keys, np.concatenate(flat[1::2])[first]


def counted(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of every text, how often each, offsets): sorted within a text."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    order = np.argsort((text << np.uint64(44)) | (flat >> np.uint64(20)), kind="stable")
    flat, text = flat[order], text[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(flat)))
    return flat[at], times, np.searchsorted(text[at], np.arange(len(offsets), dtype=np.uint64)).astype(np.int64)


def _in_documents(flat: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, in how many texts each is) of pairs that may repeat."""
    order = np.lexsort((text, flat))
    flat, text = flat[order], text[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    return np.unique(flat[new], return_counts=True)


def _named(batches):
    """(shingle) for every shingle that at least 1 of CLIP documents of a block has."""
    held, docs, size = [], 0, 0

    def block():
        flat, text = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        least = -(-docs // CLIP)
        bins = (flat & np.uint64(BLOCK_SHINGLES - 1)).astype(np.int64)
        often = (np.bincount(bins, minlength=BLOCK_SHINGLES) >= least)[bins]
        names, times = _in_documents(flat[often], text[often])
        return pa.RecordBatch.from_arrays([pa.array(names[times >= least].view(np.int64))], ["shingle"])

    for batch in batches:
        for piece in cut(batch, BATCH_BYTES):
            flat, offsets = shingles(piece.column(0))
            if len(flat):
                held.append((flat, np.repeat(np.arange(docs, docs + piece.num_rows, dtype=np.uint32), np.diff(offsets))))
            docs, size = docs + piece.num_rows, size + len(flat)
            if size >= BLOCK_SHINGLES:
                yield block()
                held, docs, size = [], 0, 0
    if held:
        yield block()


def _counts(batches, names=None):
    """(shingle, documents): in how many documents of a batch each (named) shingle is."""
    for batch in batches:
        for piece in cut(batch, BATCH_BYTES):
            flat, offsets = shingles(piece.column(0))
            text = np.repeat(np.arange(piece.num_rows, dtype=np.uint32), np.diff(offsets))
            if names is not None:
                keys, seen = names
                maybe = np.flatnonzero(seen[(flat & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, flat[maybe]), len(keys) - 1)
                maybe = maybe[keys[at] == flat[maybe]]
                flat, text = flat[maybe], text[maybe]
            if len(flat):
                found, times = _in_documents(flat, text)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "documents"])


def document_frequencies(rows: DataFrame) -> Frequencies:
    """Exact document frequencies of all shingles in at least 1 of CLIP documents."""
    spark = rows.sparkSession
    documents = rows.count()
    column = rows.select("text")
    names = materialize(column.mapInArrow(releasing(_named), "shingle long").distinct(), "frequent-names")
    if names.isEmpty():
        return Frequencies(documents, np.zeros(0, np.uint64), np.zeros(0))
    if names.count() <= LOCAL_NAMES:
        keys = np.sort(np.array(names.toArrow().column(0).to_numpy()).view(np.uint64))
        seen = np.zeros(1 << 16, bool)
        seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        sent = spark.sparkContext.broadcast((keys, seen))
        counts = column.mapInArrow(releasing(lambda batches: _counts(batches, sent.value)), "shingle long, documents long")
    else:
        counts = column.mapInArrow(releasing(_counts), "shingle long, documents long").join(names, "shingle", "left_semi")
    sums = counts.groupBy("shingle").agg(F.sum("documents").alias("documents"))
    frequent = sums.filter(F.col("documents") * CLIP >= documents).toArrow()
    return Frequencies(documents, frequent.column(0).to_numpy().view(np.uint64), frequent.column(1).to_numpy())


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers that end at ``ends``, as binary values."""
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _dealt(batches, frequencies: Frequencies, parts: int):
    """(part, keys, owners, sizes): shingles of a batch that are not frequent, dealt to parts by their upper bits.

    ``keys`` holds the shingles of a part, text after text, ``owners`` the texts' keys and
    ``sizes`` how many of them each has: one row for many shingles.
    """
    for batch in batches:
        for piece in cut(batch, DEALT_BYTES):
            flat, _, offsets = counted(*shingles(piece.column(0)))
            text = np.repeat(np.arange(piece.num_rows, dtype=np.uint32), np.diff(offsets))
            other = frequencies.of(flat) == frequencies.rare
            flat, text = flat[other], text[other]
            if not len(flat):
                continue
            part = (((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint32 if parts > 1 << 16 else np.uint16)
            order = np.argsort(part, kind="stable")
            part, flat, text = part[order], flat[order], text[order]
            last = part[1:] != part[:-1]
            ends = np.append(np.flatnonzero(last) + 1, len(flat))
            runs = np.append(np.flatnonzero(last | (text[1:] != text[:-1])) + 1, len(flat))
            owners = piece.column(1).to_numpy()[text[runs - 1]]
            sizes = np.diff(np.append(0, runs)).astype(np.uint32)
            run_ends = np.searchsorted(runs, ends, side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[ends - 1].astype(np.int32)), _blobs(flat, ends), _blobs(owners, run_ends), _blobs(sizes, run_ends)],
                ["part", "keys", "owners", "sizes"],
            )


def _several(batches):
    """(text_key, shingle, documents): the shingles of a part that are in several documents, once for each text."""
    held: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for i, kind in enumerate(("<u8", "<i8", "<u4")):
            held[i].append(np.frombuffer(flat_bytes(batch.column(i))[0].tobytes(), kind))
    if not held[0]:
        return
    flat = np.concatenate(held[0])
    owners = np.repeat(np.concatenate(held[1]), np.concatenate(held[2]))
    held.clear()
    order = np.argsort(flat)
    flat = flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    documents = np.diff(np.append(first, len(flat)))
    documents = np.repeat(documents, documents)
    more = documents > 1
    flat, owners, documents = flat[more], owners[order[more]], documents[more]
    if not len(flat):
        return
    order = np.lexsort((flat, owners))
    flat, owners, documents = flat[order], owners[order], documents[order]
    new = np.append(True, (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1]))  # copies of a text have one key
    yield pa.RecordBatch.from_arrays([pa.array(owners[new]), pa.array(flat[new].view(np.int64)), pa.array(documents[new])], ["text_key", "shingle", "documents"])


def shared_shingles(rows: DataFrame, frequencies: Frequencies) -> DataFrame:
    """(text_key, shingles, documents): the shingles of a text that several documents have but fewer than 1 of CLIP.

    ``rows`` is (doc_id, text, text_key). Shingles are dealt once, by ranges of their hash, to parts whose number
    follows the bytes of all texts; a part is counted by sorting it. No shingle here is in more than 1 of CLIP
    documents, so no part is hot, whatever repeats.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(frequencies)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (PART_SHINGLES * WORD_BYTES)))
    dealt = rows.select("text", "text_key").mapInArrow(
        releasing(lambda batches: _dealt(batches, sent.value, parts)), "part int, keys binary, owners binary, sizes binary"
    )
    found = dealt.repartitionById(parts, F.col("part")).select("keys", "owners", "sizes")
    found = found.mapInArrow(releasing(_several), "text_key long, shingle long, documents long")
    lists = found.groupBy("text_key").agg(F.collect_list(F.struct("shingle", "documents")).alias("held"))
    lists = lists.select("text_key", F.col("held.shingle").alias("shingles"), F.col("held.documents").alias("documents"))
    return materialize(lists, "shared-shingles")


def with_shared(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with the lists of their texts; empty ones where there are none."""
    none = F.array().cast("array<bigint>")
    return rows.join(lists, "text_key", "left").withColumns({c: F.coalesce(c, none) for c in ("shingles", "documents")})


class Sampler:
    """Consistent weighted samples of weighted shingle sets.

    For sample ``k`` the hash of a shingle picks one of ``POOL`` triples r, c ~ Gamma(2, 1), b ~ U(0, 1).
    With weight w: t = floor(ln w / r + b), ln y = r (t - b), and the sample is the (shingle, t) with the
    least ln c - ln y - r. A key holds this number in its upper 32 bits, ordered, and the identity of
    (shingle, t) in its lower ones, which also settle ties. Shingles that occur once and have the
    weight of rare ones, nearly all, take their key from a table.
    """

    def __init__(self, rare: float, samples: int = BANDS * ROWS, seed: int = 11):
        random = np.random.RandomState(seed)
        self.factors = random.randint(1, 1 << 62, samples, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = random.gamma(2.0, 1.0, (samples, POOL)).astype(np.float32)
        self.log_c = np.log(random.gamma(2.0, 1.0, (samples, POOL))).astype(np.float32)
        self.b = random.random_sample((samples, POOL)).astype(np.float32)
        self.rare = rare
        every = np.arange(POOL)
        self.table = np.stack([self._keys(k, every, np.float32(np.log(rare))) for k in range(samples)])

    def _keys(self, k: int, at: np.ndarray, log_weight) -> np.ndarray:
        r, b = self.r[k][at], self.b[k][at]
        t = np.floor(log_weight / r + b)
        value = (self.log_c[k][at] - r * (t - b) - r).astype(np.float32)
        bits = value.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        turn = mix64(t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
        return (ordered << np.uint64(32)) ^ turn

    def bands(self, flat: np.ndarray, times: np.ndarray, weights: np.ndarray, offsets: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """Band keys, one row per text that has shingles (``offsets`` must leave out the others)."""
        special = np.flatnonzero((times > 1) | (weights != self.rare))
        logs = np.log(times[special] * weights[special]).astype(np.float32)
        keys = []
        for k, factor in enumerate(self.factors):
            hashed = flat * factor
            at = (hashed >> np.uint64(50)).astype(np.int64)
            value = self.table[k][at]
            if len(special):
                value[special] = self._keys(k, at[special], logs)
            value ^= hashed & np.uint64(0xFFFFFFFF)
            least = np.minimum.reduceat(value, offsets[:-1])
            place = mix64(least & np.uint64(0xFFFFFFFF) | np.uint64(k // rows + 1) << np.uint64(32))
            if k % rows == 0:
                keys.append(place)
            else:
                keys[-1] = mix64(keys[-1] + place)
        return np.stack(keys, axis=1)


SIGNATURE_SCHEMA = "doc_id long, words binary, bands array<bigint>"


def signatures(rows: DataFrame, frequencies: Frequencies) -> DataFrame:
    """doc_id, words (128-bit digest of the word sequence), bands; rows without words are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(frequencies)

    def sign(batches):
        weights = sent.value
        sampler = Sampler(weights.rare)
        for batch in batches:
            for piece in cut(batch, BATCH_BYTES):
                flat, offsets = shingles(piece.column(0))
                has = np.flatnonzero(np.diff(offsets))
                if not len(has):
                    continue
                digests = word_digests(piece.column(0))
                flat, times, offsets = counted(flat, offsets)
                held = listed(piece.column(2), piece.column(3))
                bands = sampler.bands(flat, times, weights.of(flat, held), np.append(offsets[has], len(flat)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1).take(pa.array(has)), pa.array([digests[i] for i in has], pa.binary()), lists], ["doc_id", "words", "bands"]
                )

    return rows.select("text", "doc_id", "shingles", "documents").mapInArrow(releasing(sign), SIGNATURE_SCHEMA)


def word_digests(column: pa.Array) -> list[bytes]:
    import xxhash

    words, offsets = word_hashes(column)
    data = memoryview(words).cast("B")
    return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def weighted_jaccard(left, right, frequencies: Frequencies, shared=None) -> float:
    """Of two (shingles, times) sets, by the weights times * idf."""
    keys, at = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[at[: len(left[0])]] = left[1]
    b[at[len(left[0]) :]] = right[1]
    weights = frequencies.of(keys, shared)
    return float((np.minimum(a, b) * weights).sum() / (np.maximum(a, b) * weights).sum())


def verified(pairs: DataFrame, rows: DataFrame, frequencies: Frequencies, threshold: float) -> DataFrame:
    """The pairs (a, b) of representatives whose weighted Jaccard similarity is at least ``threshold``.

    ``rows`` is (doc_id, text, shingles, documents), ids without repeats. Texts of documents in pairs are found first; a
    document in many pairs is joined to each of them by a join that adaptive execution can split.
    """
    sent = rows.sparkSession.sparkContext.broadcast(frequencies)
    columns = ("text", "shingles", "documents")
    left = pairs.join(rows.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns]), "a")
    both = left.join(rows.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns]), "b")
    both = both.select("text_a", "text_b", "a", "b", "shingles_a", "documents_a", "shingles_b", "documents_b")

    def compare(batches):
        weights = sent.value
        for batch in batches:
            for piece in cut(batch, BATCH_BYTES):
                sets = []
                for i in (0, 1):
                    flat, times, offsets = counted(*shingles(piece.column(i)))
                    sets.append([(flat[a:b], times[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
                held = listed(*(piece.column(i) for i in range(4, 8)))
                good = [weighted_jaccard(x, y, weights, held) >= threshold for x, y in zip(*sets)]
                yield piece.select([2, 3]).filter(pa.array(good))

    return both.mapInArrow(releasing(compare), "a long, b long")


def shared_weights(rows: DataFrame, frequencies: Frequencies) -> DataFrame:
    """(doc_id, total, common, slots): a text's weight, and that of its shingles that some other text of ``rows`` has, too.

    ``slots`` spreads the common weight over ``SLOTS`` places by shingle: what two texts share is at
    most the sum of their lesser slots.
    """
    sent = rows.sparkSession.sparkContext.broadcast(frequencies)

    def weigh(batches):
        weights = sent.value
        for batch in batches:
            for piece in cut(batch, BATCH_BYTES):
                flat, times, offsets = counted(*shingles(piece.column(0)))
                ids = np.repeat(piece.column(1).to_numpy(), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(ids), pa.array(times * weights.of(flat, listed(piece.column(2), piece.column(3))))], ["shingle", "doc_id", "weight"])

    cells = rows.select("text", "doc_id", "shingles", "documents").mapInArrow(releasing(weigh), "shingle long, doc_id long, weight double")
    slot = F.col("shingle").bitwiseAND(F.lit(SLOTS - 1))
    by_slot = lambda name: F.array(*[F.coalesce(F.sum(F.when(slot == i, F.col("weight"))), F.lit(0.0)) for i in range(SLOTS)]).alias(name)
    owners = cells.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.max("weight").alias("weight"))
    alone = owners.filter("doc_id = last").groupBy("doc_id").agg(by_slot("alone"))
    totals = cells.groupBy("doc_id").agg(F.sum("weight").alias("total"), by_slot("slots"))
    left = F.when(F.col("alone").isNull(), F.col("slots")).otherwise(F.zip_with("slots", "alone", lambda x, y: x - y)).cast("array<float>")
    found = totals.join(alone, "doc_id", "left").select("doc_id", "total", left.alias("slots"))
    return found.withColumn("common", F.aggregate("slots", F.lit(0.0), lambda s, x: s + x))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept: one row per document row.

    A class is a connected component of the links; class_id is its least doc_id, and that document is
    kept. Texts equal in all words belong together whatever their case and punctuation.
    Null, empty and wordless texts are similar to nothing and stay; so do rows with a null
    doc_id (class_id null). Of rows with the same doc_id one text, the least, speaks for the id.
    """
    rows = texts(docs, id_col, text_col)
    frequencies = document_frequencies(rows)
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    lists = shared_shingles(rows, frequencies)
    signed = materialize(signatures(with_shared(rows.filter("doc_id is not null"), lists), frequencies), "signatures")
    copies = signed.groupBy("words").agg(F.min("doc_id").alias("rep"))
    copies = materialize(copies, "copies")
    membership = signed.select("doc_id", "words").join(copies, "words").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    membership = materialize(membership.filter("a <> b").distinct(), "membership")

    reps = signed.join(copies.select(F.col("words").alias("rep_words"), "rep"), (F.col("words") == F.col("rep_words")) & (F.col("doc_id") == F.col("rep")))
    places = reps.select("rep", F.posexplode("bands").alias("band", "key")).distinct()
    buckets = places.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").drop("last")
    shared = materialize(places.join(buckets, ["band", "key"]), "buckets")
    pairs = materialize(shared.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    involved = shared.select(F.col("rep").alias("doc_id")).distinct()
    speaking = rows.join(involved.hint("shuffle_hash"), "doc_id", "left_semi")
    speaking = speaking.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("text_key", F.xxhash64("text"))
    speaking = materialize(with_shared(speaking, lists).drop("text_key"), "involved")
    links = materialize(verified(pairs, speaking, frequencies, threshold), "verified")

    found = components(links)
    placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    mixed = placed.groupBy("band", "key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low < high").select("band", "key")
    rest = materialize(placed.join(mixed, ["band", "key"], "left_semi").select("band", "key", "rep", "class_id"), "mixed-buckets")
    if not rest.isEmpty():
        members = rest.select(F.col("rep").alias("doc_id")).distinct()
        weights = shared_weights(speaking.join(members, "doc_id", "left_semi"), frequencies)
        least = threshold * (1 - 1e-5)  # slots are kept in single precision
        weights = materialize(weights.filter(F.col("common") >= F.col("total") * least), "shared-weights")
        rest = rest.join(weights.withColumnRenamed("doc_id", "rep"), "rep")
        rest = materialize(rest.select("band", "key", "rep", "class_id", "total", "common", "slots"), "open-buckets")
        parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rest = rest.repartition(parts, "band", "key")  # few bytes, much work: not to be coalesced by size
        other = rest.select("band", "key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "class_id", "total", "common", "slots")])
        at_most = F.least("common", "common_b")
        lesser = [F.least(F.get("slots", F.lit(i)), F.get("slots_b", F.lit(i))) for i in range(SLOTS)]
        shared_most = reduce(lambda x, y: x + y, lesser)  # no lambda in the plan: this runs for every pair of a bucket
        enough = lambda shared: shared >= (F.col("total") + F.col("total_b") - shared) * least
        met = rest.join(other, ["band", "key"]).filter((F.col("class_id") < F.col("class_id_b")) & enough(at_most) & enough(shared_most))
        across = met.select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct()
        across = across.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        across = materialize(across.join(pairs, ["a", "b"], "left_anti"), "pairs-across")
        links = links.union(materialize(verified(across, speaking, frequencies, threshold), "verified"))
    classes = components(links.union(membership))
    return (
        rows.select("doc_id")
        .join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )
