"""Parts of the corpus operators that need no Spark, against plain counterparts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import corpus, shingle_counts, words
from murmur.llm import encoding, inputs, language, line_dedup, near_dedup, repeats
from murmur.llm import words as hashed
from murmur.llm.decontaminate import ItemIndex, size_class
from murmur.llm.wavelet import WaveletMatrix


@pytest.mark.parametrize("n", [0, 1, 63, 511, 512, 513, 4000])
def test_wavelet_matrix_answers_like_the_sequence(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 200, n).astype(np.uint32)
    ids[::5] = 49_407
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16).to_bytes())
    assert matrix.decode().tolist() == ids.tolist()
    at = rng.integers(0, n, 30) if n else np.zeros(0, int)
    assert matrix.access(at).tolist() == ids[at].tolist()
    for symbol in {0, 49_407, 65_535, *ids[:5].tolist()}:
        assert matrix.count(symbol) == (ids == symbol).sum()
        assert matrix.count(symbol, n // 2) == (ids[: n // 2] == symbol).sum()
        assert matrix.occurrences(symbol).tolist() == np.flatnonzero(ids == symbol).tolist()


def test_wavelet_matrix_of_wide_ids():
    ids = np.array([70_000, 1, 131_071, 70_000], np.uint32)
    assert WaveletMatrix.build(ids, 17).decode().tolist() == ids.tolist()


TRICKY = [
    "", " ", "\n", "a\n b", "a \n b", "  a  b  ", "x<|endoftext|> y", "<|startoftext|>Foo", "a\x1cb c", "a\x85 b", "İstanbul Ångström é ́x",
    "a b c", "tab\tb  \t c", "᠎ x ᠎y", "it's we'll 12 345", "a　b 　 c", "end ", " start", "日本 語​ x", "﻿bom a",
    "Ələsgər ƏLİ", "ĭƔ ƐƆa ȺB", "Retierha, retierha. 'Twas'nt I'LL", "ÉCOLE école, ßẞ", "a\x00b\x7f ½²ª",
]


def test_remembered_pieces_give_the_library_ids():
    from tokenizers import Tokenizer

    texts = TRICKY + [r[1] or "" for r in corpus()][:40]
    byte, word = inputs.tokenizer_path("byte_bpe_50k.json"), inputs.tokenizer_path("word_bpe_49k.json")
    counts, ids = encoding.byte_counts(byte, texts), encoding.word_ids(word, texts)
    by_library = [Tokenizer.from_file(p) for p in (byte, word)]
    for text, n, coded in zip(texts, counts, ids):
        assert n == len(by_library[0].encode(text, add_special_tokens=False).ids), text[:60]
        assert np.frombuffer(coded, "<u4").tolist() == by_library[1].encode(text, add_special_tokens=False).ids, text[:60]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sé1!  \x1f<|>")), max_size=40))
def test_any_white_space_gives_the_library_ids(text):
    byte, word = inputs.tokenizer_path("byte_bpe_50k.json"), inputs.tokenizer_path("word_bpe_49k.json")
    assert encoding.byte_counts(byte, [text]) == [len(encoding.tokenizer(byte)[0].encode(text, add_special_tokens=False).ids)]
    assert np.frombuffer(encoding.word_ids(word, [text])[0], "<u4").tolist() == encoding.tokenizer(word)[0].encode(text, add_special_tokens=False).ids


def test_shingle_hashes_tell_shingles_apart_as_words_do():
    texts = [r[1] or "" for r in corpus()]
    flat, offsets = hashed.shingles(pa.array(texts, pa.large_string()))
    names = {}
    for text, a, b in zip(texts, offsets, offsets[1:]):
        w = words(text)
        plain = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert len(plain) == b - a
        for shingle, value in zip(plain, flat[a:b].tolist()):
            assert names.setdefault(shingle, value) == value
    assert len(set(names.values())) == len(names)


def test_hashes_do_not_depend_on_the_batch():
    texts = [r[1] or "" for r in corpus()]
    flat, offsets = hashed.shingles(pa.array(texts, pa.large_string()))
    for i in range(0, len(texts), 7):
        assert hashed.shingles(pa.array(texts[i : i + 1], pa.large_string()))[0].tolist() == flat[offsets[i] : offsets[i + 1]].tolist()
    rows = language.features(pa.array(texts[:50], pa.large_string()))
    assert np.allclose(language.features(pa.array(texts[9:10], pa.large_string()))[0], rows[9])


def test_batches_are_cut_by_bytes_and_lose_nothing():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 300, 1, 1, 50)]), pa.array(range(6))], ["text", "id"]).slice(1)
    pieces = list(inputs.cut(batch, 60))
    assert [i for p in pieces for i in p.column(1).to_pylist()] == [1, 2, 3, 4, 5]
    assert max(p.num_rows for p in pieces) < 5


def test_size_classes_follow_each_other():
    assert [size_class(n) for n in (1, 2, 3, 5, 8, 9, 17, 25, 33, 49, 65, 97)] == [2, 2, 4, 8, 8, 16, 24, 32, 48, 64, 96, 128]


def test_items_are_found_in_long_texts():
    rng = random.Random(2)
    make = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    items = [make(n) for n in (5, 9, 20, 40, 80, 200)]
    texts = [f"{make(rng.randrange(900))} {item} {make(rng.randrange(900))}" for item in items for _ in range(8)] + [make(500) for _ in range(10)]
    index = ItemIndex(list(range(len(items))), pa.array(items, pa.large_string()), 5)
    found = {(d, i) for d, i, _ in index.search(pa.array(texts, pa.large_string()), 5, 0.8)}
    assert found == {(8 * i + j, i) for i in range(len(items)) for j in range(8)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
    return row[-1]


def edited(rng, text, edits, letters="abé "):
    chars = list(text)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(chars) + 1)
        if kind == 0 or at == len(chars):
            chars.insert(at, rng.choice(letters))
        elif kind == 1:
            chars.pop(at)
        else:
            chars[at] = rng.choice(letters)
    return "".join(chars)


def test_banded_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 4))
        for k in (0, 1, 2, 3):
            assert line_dedup.within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


def test_lines_within_their_edits_share_a_key():
    rng = random.Random(3)
    places = line_dedup.Places(2)
    for _ in range(600):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(5, 60)))
        short, long = sorted((a, edited(rng, a, rng.randint(1, 2))), key=len)
        if short == long or edit_distance(short, long) > line_dedup.allowed(len(short)):
            continue
        _, index, parity = line_dedup.line_keys([short], places, False)
        _, probe, other = line_dedup.line_keys([long], places, True)
        assert set(index.tolist()) & set(probe.tolist()), (short, long)
        assert (int(parity[0]) ^ int(other[0])).bit_count() <= 4


def test_anchors_stand_for_every_window():
    rng = np.random.default_rng(7)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 399, 400, 401, 5000, 1200)] + [np.full(900, 97, np.uint8)]
    offsets = np.cumsum([0, *map(len, texts)])
    _, text, place, first, last = repeats.anchors(np.concatenate(texts), offsets)
    for i, content in enumerate(texts):
        own = text == i
        windows = sum((last - first + 1)[own].tolist())
        assert windows == max(0, len(content) - 399)
        assert ((place >= last) & (place + repeats.GRAM <= first + 400))[own].all()


def test_weighted_samples_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(5)
    sampler = near_dedup.Sampler(float(np.log1p(near_dedup.CLIP)), samples=400)
    shared, left, right = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 60, 40))
    weight = {int(x): float(rng.choice([0.7, sampler.rare])) for x in np.concatenate([shared, left, right])}
    sets = []
    for own in (left, right):
        flat, times, offsets = near_dedup.counted(np.concatenate([shared, own, own[:10]]), np.array([0, 310 + len(own)]))
        weights = np.array([weight[int(x)] for x in flat])
        sets.append(({int(x): t * w for x, t, w in zip(flat, times, weights)}, sampler.bands(flat, times, weights, offsets, rows=1)[0]))
    (a, x), (b, y) = sets
    truth = sum(min(a.get(s, 0), b.get(s, 0)) for s in a | b) / sum(max(a.get(s, 0), b.get(s, 0)) for s in a | b)
    assert abs((x == y).mean() - truth) < 0.08


def test_shingles_are_counted_per_text():
    texts = ["a b c d e a b c d e a b c d e", "", "a b", "a b c d e"]
    flat, times, offsets = near_dedup.counted(*hashed.shingles(pa.array(texts, pa.large_string())))
    for i, text in enumerate(texts):
        assert sorted(times[offsets[i] : offsets[i + 1]].tolist()) == sorted(shingle_counts(text).values())


def test_plain_texts_are_cut_into_words_together_and_the_library_gets_different_new_words_only(monkeypatch):
    import re

    from murmur.llm.bpe import _WORDS

    path = inputs.tokenizer_path("word_bpe_49k.json")
    rng = random.Random(11)
    alphabet = list("  \n\t\r\x0b\x0c'''''stremvldLD01aXéÉßİ½²’–“”!.,<|\x00\x7f")
    plain = ["", " ", "'", "a'", "'s", "'ll'll're", "''s", "!'s't", "1's", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(200))]
    found, edges = encoding.words_of(plain)
    assert [found[a:b].to_pylist() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())] == [_WORDS.findall(t.lower()) for t in plain]

    model, memo = encoding.tokenizer(path)
    expected = [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in plain]
    memo.clear()
    assert encoding.word_ids(path, plain) == expected
    assert len(memo) == len(set(found.to_pylist()))
    assert encoding.word_ids(path, ["'s a 's"] * 3)[0] * 3 == b"".join(encoding.word_ids(path, ["'S A 'S"] * 3))

    memo.clear()
    monkeypatch.setattr(encoding, "GROUP_CHARS", 16)  # long texts are cut at white space
    monkeypatch.setattr(encoding, "MEMO_PIECES", 30)
    assert encoding.word_ids(path, plain + ["x" * 40 + " \n" + "y " * 30]) == expected + [np.array(model.encode("x" * 40 + " \n" + "y " * 30, add_special_tokens=False).ids, "<u4").tobytes()]
    assert not re.search(r"\s", "".join(memo)) and len(memo) < 200
