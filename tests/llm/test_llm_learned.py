"""Conversation repair, BPE and hard negatives against brute force on awkward rows."""

import hashlib
import math
import random
from array import array
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import SCHEMA, corpus
from murmur.llm import bpe, conversations, hard_negatives, inputs, queries

ROWS = corpus()
TURNS = "conv_id long, turn int, role string, text string, at long, cost string, edits string, `a.b` string, start string"


def turns():
    """Conversations of every awkward kind; the last one is far longer than the segments of these tests."""
    rng = random.Random(11)
    rows = []

    def add(conv_id, turn, role, text):
        rows.append((conv_id, turn, role, text, 1, "c", "e", "d", "s"))

    def said():
        return rng.choice(["Yes.", "No!", "Why?", "well", "", " \t\n", "same.", "same.", "end. \n", "a. b", "é.", " ", f"n {rng.randrange(50)}."])

    for conv_id in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "u", "Assistant"]) if conv_id % 3 else ["user", "assistant"][turn % 2]
            add(conv_id, turn * (1 + conv_id % 2), role, said())
    for conv_id in (200, None):
        for turn in (None, 1, 1, 5, None, 5):
            add(conv_id, turn, rng.choice(["user", "assistant"]), said())
    add(201, None, None, None)
    add(202, 3, "system", "x" * 30_000 + ".")
    for _ in range(3):
        add(203, 1, "user", "again and again.")
    for turn in range(400):
        add(300, turn, rng.choice(["user", "assistant", "assistant", "system"]), said())
    return rows


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame(turns(), TURNS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def in_sql(path, table, sql):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{path}/{table}.parquet/*.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], Counter(found.fetchall())


def test_conversation_repair(spark, talk):
    names, want = in_sql(talk, "conversations", queries.OP11_SQL)
    found = queries.op11_conversation_repair(spark, talk)
    assert set(found.columns) == set(names)
    assert Counter(tuple(r) for r in found.select(*names).collect()) == want
    assert len(want) == 126


def test_segments_do_not_change_a_repair(spark, talk, monkeypatch):
    names, want = in_sql(talk, "conversations", queries.OP11_SQL)
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 2)
    found = queries.op11_conversation_repair(spark, talk).select(*names)
    assert Counter(tuple(r) for r in found.collect()) == want


def cheapest(codes):
    """(cost, letters) by trying every sequence of edits with at most four inserts."""
    best = None

    def go(at, state, cost, letters, inserts):
        nonlocal best
        if at == len(codes) and state in "-a" and (best is None or (cost, letters) < best):
            best = (cost, letters)
        following = "a" if state == "u" else "u"
        if inserts < 4:
            go(at, following, cost + 5, letters + "I", inserts + 1)
        if at == len(codes):
            return
        go(at + 1, state, cost + 2, letters + "D", inserts)
        code = codes[at]
        if code != "-":
            extra = 5 if code.isupper() else 0
            if code.lower() == following or (code.lower() == "s" and state == "-"):
                go(at + 1, code.lower(), cost + extra, letters + "K", inserts)
            go(at + 1, following, cost + extra + 1, letters + "R", inserts)

    go(0, "-", 0, "", 0)
    return best


def test_auctions_find_the_least_letters_of_the_cheapest_repairs():
    rng = random.Random(3)
    samples = ["".join(c) for n in (1, 2) for c in product("suaxSUA-", repeat=n)]
    samples += ["".join(rng.choice("suaxUA-") for _ in range(rng.randint(3, 5))) for _ in range(150)]
    for codes in samples:
        letters, state = conversations.trace(codes, conversations.LAST, conversations.EMPTY)
        cost = conversations.row_prices(codes, conversations.LAST)[conversations.EMPTY]
        assert (cost, letters + conversations.CLOSING[state]) == cheapest(codes), codes


def test_repaired_turns_alternate(spark, talk):
    repaired = conversations.repair(queries.table(spark, talk, "conversations"))
    by_talk = {}
    for r in conversations.repaired_turns(repaired).orderBy("at", "sub").collect():
        by_talk.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for rows in by_talk.values():
        initials = "".join(role[:1] for role, _ in rows).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)
    kept = repaired.edits.filter("edit in ('K', 'R', 'D')").count()
    assert kept == len(turns())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    rng = random.Random(12)
    pieces = ["a", "th", "ing", "'s", "'LL", " ", "\n", "\x85", "\xa0", "é", "é", "İ", "ß", "ΑΣ", "²", "½", "12", "<|endoftext|>", "<|startoftext|>", "--", "“", "中", "日本", "😀", "̇", "\x1c", "lolol", "​", "\x00", "</w>"]
    odd = [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(500)]
    extra = [(i, t, "en", "s", 0, *"kjs", None, *"al0p") for i, t in odd]
    spark.createDataFrame([*ROWS, *extra], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_bpe(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(inputs.tokenizer_path("word_bpe_49k.json"))
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))] += 1
    found = queries.op12_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r) for r in found.collect()) == want


def test_decoding_leaves_out_unknown_ids(spark):
    rows = [(1, array("I", [320, 10**6, 321]).tobytes()), (2, None), (3, b""), (4, array("I", [10**6]).tobytes()), (5, array("I", [49407]).tobytes())]
    found = bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()
    text = {r["doc_id"]: r["text"] for r in found}
    table = bpe.decoder(inputs.tokenizer_path("word_bpe_49k.json"))
    one = lambda i: table.data[table.starts[i] : table.starts[i + 1] - 1].tobytes().decode()
    assert text == {1: f"{one(320)} {one(321)}", 2: "", 3: "", 4: "", 5: "<|endoftext|>"}


def test_every_word_of_a_small_alphabet_is_exact():
    from tokenizers import Tokenizer

    path = inputs.tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.encoder(path)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    words += ["a" * n for n in range(1, 200)] + ["ab" * n for n in range(1, 100)]
    low = [*range(0x250), *range(0x2010, 0x2060)]  # the characters that the module cuts by itself, and their neighbours
    words += ["".join(chr(rng.choice(low)) for _ in range(12)) for _ in range(3000)] + [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in low]
    for word, coded in zip(words, library.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(own.encode(word), "<u4").tolist() == coded.ids, word


VECTORS = "vec_id long, embedding array<float>, label int, rank int, score long, bucket string, width int, `a.b` int"


def vectors():
    rng = random.Random(13)
    rows = []

    def add(vec_id, vector, label):
        rows.append((vec_id, vector, label, 1, 2, "b", 3, 4))

    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    for i in range(700):
        base = rng.choice(centre)
        add(i, [float(np.float32(x + rng.gauss(0, 0.7))) for x in base], rng.randrange(10))
    for i in range(700, 760):  # many equal vectors
        add(i, [0.5] * 8, i % 3)
    add(800, None, 1)
    add(801, [1.0] * 8, None)
    add(802, [1.0, None] + [1.0] * 6, 1)
    add(900, [float("nan")] * 8, 1)
    add(901, [float("inf")] * 8, 1)
    add(1000, [], 1)
    add(1001, [2.0, 2.0], 3)
    add(1100, [0.0] * 8, 2)
    add(None, [0.9] * 8, 2)
    add(None, [0.9] * 8, 3)
    for _ in range(3):
        add(1200, [0.75] * 8, 2)
    add(1300, [-0.75] * 8, 12)
    add(1400, [1e30] * 8, 5)
    add(1401, [1e29] * 8, 5)
    add(1402, [5e-8] * 8, 6)
    return rows


def mined(rows):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    want = Counter()
    for anchor, vector, label in kept:
        if anchor is None or anchor % 100:
            continue
        held = [(dot(vector, v), i, other) for i, v, other in kept]
        for score, positive, _ in first([h for h in held if h[2] == label and h[1] != anchor])[:5]:
            window = [h for h in held if h[2] != label and 30 * score <= 100 * h[0] <= 90 * score]
            for rank, (found, negative, _) in enumerate(first(window)[:10], 1):
                want[(anchor, positive, rank, negative, score, found)] += 1
    return want


OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("block", [2048, 16])
def test_hard_negatives(spark, tmp_path, monkeypatch, block):
    spark.createDataFrame(vectors(), VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", max(2, block // 8))
    want = mined(vectors())
    found = queries.op13_hard_negatives(spark, str(tmp_path)).select(*OUT)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert len(want) > 100


def test_bounds_keep_every_row_of_a_window_and_skip_others():
    """Clustered rows: the tree's bounds must rule most of them out and lose none."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 600, (6, 16))
    rows = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 4, (1200, 16)))
    anchors = np.floor(np.repeat(centres, 4, axis=0) + rng.normal(0, 4, (24, 16)))
    block = lambda x, labels: hard_negatives.Block(*hard_negatives.Block.pack(list(range(len(x))), labels, list(x)))
    held, others = block(anchors, [0] * 24), block(rows, [1] * 1200)
    parent, edge = hard_negatives.spanning_tree(held.vectors)
    exact = anchors @ rows.T
    windows = {a: [(int(np.quantile(exact[a], 0.97)), int(exact[a].max()))] for a in range(24)}
    scored = {a: dict(zip(at.tolist(), value.tolist())) for a, at, value in hard_negatives.window_scores(held, parent, edge, others, windows)}
    for a, [(low, high)] in windows.items():
        inside = np.flatnonzero((exact[a] >= low) & (exact[a] <= high))
        assert all(scored[a][i] == exact[a][i] for i in inside.tolist())
    assert sum(map(len, scored.values())) < 0.6 * exact.size


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op11_conversation_repair", "op12_bpe", "op13_hard_negatives"):
        assert queries.queries()[name](spark, str(tmp_path)).collect() == []
    no_anchor = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(no_anchor).collect() == []


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(40, 3))
    parent, edge = hard_negatives.spanning_tree(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0
    while len(joined) < 40:
        weight, new = min((far[a, b], b) for a in joined for b in range(40) if b not in joined)
        total += weight
        joined.add(new)
    assert edge.sum() == pytest.approx(total)
    assert sorted(hard_negatives._top_down(parent)) == list(range(40))


def test_text_columns_of_other_names(spark):
    docs = spark.createDataFrame([("7", "Hello there")], "`my.id` string, `my.text` string")
    coded = bpe.encode_documents(docs, id_col="my.id", text_col="my.text")
    assert [r["doc_id"] for r in bpe.decode_documents(coded).filter(F.col("text").startswith("hello")).collect()] == [7]


def test_copies_of_the_anchors_are_never_gathered_on_the_driver(spark):
    """A few anchors times many buckets: the planner counts one copy, which it would broadcast."""
    blocks = spark.range(40).select(F.col("id").alias("row_block"), F.lit("v").alias("vectors"))
    anchors = spark.range(2).select(F.col("id").alias("anchor_block"), F.lit("a").alias("vectors"))
    met = hard_negatives._meetings(anchors, blocks, 8)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert Counter((r["row_row_block"], r["anchor_block"]) for r in met.collect()) == Counter(product(range(40), range(2)))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
