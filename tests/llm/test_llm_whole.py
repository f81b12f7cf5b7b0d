"""Operators against counterparts that take no limit or weight from the modules."""

import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import Classes, corpus, shingle_counts
from murmur.llm import line_dedup, near_dedup


def spoiled(rng, line, edits):
    """A line with ``edits`` changes, as far apart as they can be."""
    chars = list(line)
    for i in reversed(range(edits)):
        at = min(len(chars) - 1, i * len(line) // edits + rng.randrange(len(line) // edits))
        chars[at : at + 1] = rng.choice(["", "#", chars[at] + "#"])
    return "".join(chars)


def test_lines_may_differ_by_a_tenth_whatever_their_length(spark):
    rng = random.Random(6)
    lines = {line for r in corpus() if r[0] != 95 for line in (r[1] or "").split("\n") if line}
    for n in (12, 25, 48, 64, 66, 70, 95, 160, 161, 400, 1500):
        line = "".join(rng.choice("abcdefg ") for _ in range(n))
        lines |= {line, *(spoiled(rng, line, max(1, k)) for k in (n // 10 - 1, n // 10, n // 10, n // 10 + 1) for _ in range(3))}
    lines |= {"a" * n for n in (199, 200, 219, 220, 221)} | {"total 123 of " + "the same words and " * 8, "total 987 of " + "the same words and " * 8}
    frame = spark.createDataFrame(list(enumerate(sorted(lines))), "id long, line string").cache()
    other = frame.select(F.col("id").alias("other"), F.col("line").alias("line_b"))
    least = F.least(F.length("line"), F.length("line_b"))
    close = F.abs(F.length("line") - F.length("line_b")) * 10 <= least
    pairs = frame.join(other, (F.col("id") < F.col("other")) & close).repartition(8)
    want = {tuple(r) for r in pairs.filter(F.levenshtein("line", "line_b") * 10 <= least).select("id", "other").collect()}
    found = [tuple(r) for r in line_dedup.line_links(frame).collect()]
    assert len(found) == len(set(found))
    assert set(found) == want
    assert len(want) > 50


def test_rounds_shuffle_a_share_of_the_grams_and_find_the_same_links(spark):
    rng = random.Random(8)
    lines = set()
    for n in (11, 19, 20, 34, 63, 64, 65, 66, 90, 130, 300):
        line = "".join(rng.choice("abcdefg ") for _ in range(n))
        lines |= {line, *(spoiled(rng, line, max(1, k)) for k in (n // 10 - 1, n // 10))}
    lines |= {"a" * n for n in (60, 63, 64, 70, 20_000, 22_000, 22_001)}
    frame = spark.createDataFrame(list(enumerate(sorted(lines))), "id long, line string")
    whole, rounds = (sorted(tuple(r) for r in line_dedup.line_links(frame, rounds=n).collect()) for n in (1, 5))
    assert rounds == whole and len(whole) > 11
    found = [pair for low in range(0, 1 << 32, 1 << 29) for pair in line_dedup.gram_rows(sorted(lines), line_dedup.Places(), low, low + (1 << 29))]
    rows = [sum(len(pair[probing]) for pair in found) for probing in (0, 1)]
    chars = sum(len(x) for x in lines)
    assert rows[0] <= chars / 9 and rows[1] <= chars * 1.1  # about a row a character, in all rounds


def similarity(x, y, n, frequency):
    weigh = lambda kept: sum(times * math.log1p(n / frequency[s]) for s, times in kept.items())
    return weigh(x & y) / weigh(x | y)


def test_shingles_below_a_hundredth_weigh_by_their_frequency(spark):
    """Pairs whose own shingles are in one document and whose shared ones in two to five, of 600 documents."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for group in range(60):
        base = [word() for _ in range(100)]
        for _ in range(rng.randint(2, 5)):
            own = list(base)
            own[-rng.randint(8, 14) :] = [word() for _ in range(rng.randint(5, 14))]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, " ".join(word() for _ in range(20))) for i in range(600 - len(rows))]
    held = {i: shingle_counts(text) for i, text in rows}
    frequency = Counter(s for counts in held.values() for s in counts)
    classes, flat = Classes(), Classes()
    clipped = Counter({s: max(f, 6) for s, f in frequency.items()})
    for a, b in combinations(held, 2):
        if held[a].keys() & held[b].keys():
            if similarity(held[a], held[b], 600, frequency) >= 0.8:
                classes.link(a, b)
            if similarity(held[a], held[b], 600, clipped) >= 0.8:
                flat.link(a, b)
    want = {i: classes.find(i) for i in held}
    assert want != {i: flat.find(i) for i in held}
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == want


def test_a_table_without_languages_keeps_what_has_letters(spark):
    rows = [(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "слово", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
