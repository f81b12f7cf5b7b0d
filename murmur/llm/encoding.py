"""Encoding whole texts with a public tokenizer, remembering the pieces that recur.

Both tokenizers cut a text at white space before they merge anything, so a text's ids
are those of its pieces one after another. A worker process keeps the ids of pieces
it has seen and sends only new ones to the tokenizers library. Texts whose white space a
cut could misread go to the library as a whole.

Under the tokenizer with word ends, texts of plain characters are cut into its words already, in
lower case, so "Word." and "word," share what is kept. The cuts of a whole group of texts come from a
table of character classes, its different words are found in one go, and only those are looked up. New words
go to the library's model many at a time, joined by spaces; the ids that end a word part them again.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

from murmur.llm.bpe import _OTHER_TEXT, END_OF_WORD, _cuts_as_known

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_PIECES = 400_000  # about 80 MB; a full memory is started anew

# Characters that Python's split() takes for white space and a tokenizer's pattern may not, or the other way round.
DOUBTFUL = re.compile("[\x1c-\x1f\x85᠎​-‏⁠﻿]")
# A space beside other white space: the tokenizer's rule for runs of white space applies there.
RUNS = re.compile(r" \s|\s ")
WHITE = re.compile(r"[\x20\x09-\x0D]")
JOINED = 256  # new words in one call's text
GROUP_CHARS = 1 << 22  # characters of plain texts that are cut into words at a time
SPACE, LETTER, NUMBER, OTHER = range(4)


def _class_table() -> np.ndarray:
    """Class of every character that a plain text may hold in lower case."""
    letter = {"L": LETTER, "N": NUMBER}
    table = np.array([letter.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x2060)], np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    return table


_CLASS = _class_table()

_loaded: dict = {}
_endings: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process, without truncation and padding."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _loaded[path] = (loaded, {})
    return _loaded[path]


def digest_of(path: str) -> str:
    """SHA-256 of the tokenizer file: its version."""
    import hashlib

    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def _remember(memo: dict, pieces: list[list[str]], encode) -> None:
    new = list(set().union(*pieces).difference(memo))
    if new:
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = list(set().union(*pieces))
        memo.update(zip(new, encode(new)))


def _groups(texts: list[str], chars: int = 1 << 20):
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def byte_counts(path: str, texts: list[str]) -> list[int]:
    """Number of ids of every text under a byte-level tokenizer without normalizer.

    Cut at single spaces between other characters; a piece is encoded with its space in front.
    """
    model, memo = tokenizer(path)
    plain = lambda batch: [len(e) for e in model.encode_batch_fast(batch, add_special_tokens=False)]
    counts: list[int] = []
    for group in _groups(texts):
        odd = {i for i, t in enumerate(group) if RUNS.search(t) or DOUBTFUL.search(t)}
        whole = iter(plain([group[i] for i in sorted(odd)]))
        pieces = [[] if i in odd else t.split(" ") for i, t in enumerate(group)]
        firsts = plain([p[0] if p else "" for p in pieces])
        _remember(memo, [p[1:] for p in pieces], lambda new: plain([" " + x for x in new]))
        counts += [next(whole) if i in odd else first + sum(map(memo.__getitem__, p[1:])) for i, (p, first) in enumerate(zip(pieces, firsts))]
    return counts


def _word_ends(path: str):
    """(which ids end a word, strings that become special ids, the library's model behind a cut at blanks alone), or None where the file cuts words in another way than this module."""
    if path not in _endings:
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        model = declared["model"]
        if model.get("end_of_word_suffix") == END_OF_WORD and _cuts_as_known(declared):
            from tokenizers import Tokenizer, pre_tokenizers

            added = declared.get("added_tokens") or []
            ends = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1, bool)
            ends[[i for t, i in model["vocab"].items() if t.endswith(END_OF_WORD)]] = True
            by_word = Tokenizer(tokenizer(path)[0].model)
            by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            _endings[path] = (ends, [t["content"] for t in added], by_word)
        else:
            _endings[path] = None
    return _endings[path]


def _parts(text: str, chars: int) -> list[str]:
    """A text cut at white space into parts of about ``chars`` characters."""
    parts, at = [], 0
    while len(text) - at > chars and (space := WHITE.search(text, at + chars)):
        parts.append(text[at : space.end()])
        at = space.end()
    return [*parts, text[at:]]


def words_of(plain: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(the words of texts of plain characters, in lower case, end to end; the number of words before each text and after the last)."""
    lower = [t.lower() for t in plain]
    whole = "\n".join([*lower, ""])
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    kind = _CLASS[points]
    start = np.empty(len(points), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == NUMBER  # numbers are words of one character
    start &= kind != SPACE
    marks = np.flatnonzero(points == ord("'"))  # the last character is white space, so two more follow each
    if len(marks):
        marks = marks[(marks == 0) | (kind[marks - 1] != OTHER)]
        one, two = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[marks[short | long] + 1] = False
        for ends, size in ((marks[short], 2), (marks[long], 3)):
            start[ends + size] = kind[ends + size] != SPACE
    width = (kind != SPACE).view(np.uint8)
    if not whole.isascii():
        width += (points >= 0x80).view(np.uint8)
        width += (points >= 0x800).view(np.uint8)
    at = np.flatnonzero(start)
    bytes_before = np.cumsum(width, dtype=np.int64)
    offsets = np.append(bytes_before[at] - width[at], bytes_before[-1])
    data = whole.encode().translate(None, b"\t\n\x0b\x0c\r ")
    edges = np.cumsum([0, *(len(t) + 1 for t in lower)])
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(at, edges)


def _ids_of_words(model, known, memo: dict, words: list[str]) -> list[bytes]:
    """Ids of different words, those remembered and new ones."""
    coded = list(map(memo.get, words))
    new = [w for w, ids in zip(words, coded) if ids is None]
    if not new:
        return coded
    pack = lambda by, batch: [array("I", e.ids).tobytes() for e in by.encode_batch_fast(batch, add_special_tokens=False)]
    parts = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
    found: list[bytes] = []
    for part, ids in zip(parts, pack(known[2], [" ".join(p) for p in parts])):
        ends = (4 * np.flatnonzero(known[0][np.frombuffer(ids, "<u4")]) + 4).tolist()
        whole = len(ends) == len(part) and ends[-1] == len(ids)
        found += [ids[a:b] for a, b in zip([0, *ends], ends)] if whole else pack(model, part)
    if len(memo) + len(new) > MEMO_PIECES:  # those just met again stay
        kept = {w: ids for w, ids in zip(words, coded) if ids is not None}
        memo.clear()
        memo.update(kept)
    memo.update(zip(new, found))
    later = iter(found)
    return [next(later) if ids is None else ids for ids in coded]


def _plain_ids(model, known, memo: dict, plain: list[str]) -> list[bytes]:
    """Ids of every text of plain characters."""
    words, edges = words_of(plain)
    coded = words.dictionary_encode()
    ids = _ids_of_words(model, known, memo, coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(size) - size
    word = coded.indices.to_numpy()
    size, begin = size[word], begin[word]
    before = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
    bounds = np.append(before, len(flat))[edges]
    return [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def word_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids (little-endian 32-bit) of every text under a tokenizer that drops white space.

    Cut into words where they are known, else at any white space.
    """
    model, memo = tokenizer(path)
    known = _word_ends(path)
    pack = lambda batch: [array("I", e.ids).tobytes() for e in model.encode_batch_fast(batch, add_special_tokens=False)]

    found: list[bytes] = []
    for group in _groups(texts, GROUP_CHARS):
        whole: dict[int, bytes] = {}
        plain = [i for i, t in enumerate(group) if known and not _OTHER_TEXT.search(t) and not any(s in t for s in known[1])]
        parts = [_parts(group[i], GROUP_CHARS) for i in plain]
        coded = chain.from_iterable(_plain_ids(model, known, memo, p) for p in _groups(list(chain.from_iterable(parts)), GROUP_CHARS))
        for i, own in zip(plain, parts):
            whole[i] = b"".join([next(coded) for _ in own])
        others = [i for i in range(len(group)) if i not in whole]
        odd = [i for i in others if DOUBTFUL.search(group[i])]
        whole.update(zip(odd, pack([group[i] for i in odd])))
        pieces = {i: group[i].split() for i in others if i not in whole}
        _remember(memo, list(pieces.values()), pack)
        whole |= {i: b"".join(map(memo.__getitem__, p)) for i, p in pieces.items()}
        found += [whole[i] for i in range(len(group))]
    return found
