"""Exact BPE by backtracking over longest token matches, and decoding through an offset table.

Encoding replays no merges. A word's tokens are the one sequence of which every adjacent
pair is compatible: encoding the two tokens' text alone gives those two tokens again. The
encoder walks a word from left to right, takes the longest token that the Aho-Corasick
automaton found there, tries that token's own shorter prefixes while the pair with the
token before is incompatible, and steps back where none is left. Positions that were left
that way are marked and not entered again, so a word takes linear time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmur.llm.inputs import cut, map_batches, texts, tokenizer_path

MEMO_WORDS = 200_000  # about 40 MB a worker; a full memory is started anew
MEMO_PAIRS = 200_000
DECODE_IDS = 1 << 17  # ids that are decoded at a time; a longer document is a group of its own

# The word pattern this encoder cuts by itself, and the end mark of words in the vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"

_END = "\n"  # stands for the end mark inside the automaton; byte-level words hold no control characters


def _plain_range() -> tuple[str, str, str]:
    """(letters, numbers, all) below U+0250 and among dashes and quotation marks, as the inside of character classes.

    In this range no text changes under NFC, and white space is that of ASCII. Capitals whose small letters
    lie outside of it are left out.
    """
    points = [c for c in range(0x250) if c not in (0x85, 0xA0) and not 0x1C <= c <= 0x1F] + [*range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    closed = {*map(chr, points), "\u0307"}
    points = [c for c in points if closed.issuperset(chr(c).lower())]
    escaped = lambda kinds: "".join(re.escape(chr(c)) for c in points if unicodedata.category(chr(c))[0] in kinds)
    return escaped("L"), escaped("N"), escaped("LNMPSZC")


_LETTERS, _NUMBERS, _PLAIN = _plain_range()
_OTHER_TEXT = re.compile(f"[^{_PLAIN}]")
# Lower-casing may leave the range above only by a combining dot, which is neither letter, number nor white space.
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\x20\x09-\x0D{_LETTERS}{_NUMBERS}]+")


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on in byte order."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Encoder:
    """The tables of one tokenizer file and the words met so far."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        model = declared["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END_OF_WORD or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only a byte-level BPE with word ends can be encoded")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.own_cut = _cuts_as_known(declared)
        self._special(declared.get("added_tokens") or [])
        self._tables(model["merges"])
        spelled = {i: t[: -len(END_OF_WORD)] + _END if t.endswith(END_OF_WORD) else t for t, i in self.vocabulary.items()}
        self.length = {i: len(t) for i, t in spelled.items()}
        self.automaton = ahocorasick.Automaton()
        usable = {spelled[i]: i for i in spelled if self.usable[i]}
        for text, i in usable.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), None) for t, i in usable.items()}
        self.alphabet = _byte_alphabet()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _special(self, added: list[dict]) -> None:
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must be matched as they stand")
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if added else None

    def _tables(self, merges: list) -> None:
        """The id a pair merges to, the parts of every id, and which ids a text can ever get.

        Ids ascend with the rank of their merge, so an id is its own rank.
        """
        size = max(self.vocabulary.values()) + 1
        self.merged: dict[int, int] = {}
        self.left, self.right = list(range(size)), list(range(size))
        self.usable = [False] * size
        for i in self.vocabulary.values():
            self.usable[i] = True
        last = -1
        for merge in merges:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a_id, b_id, whole = self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]
            if whole <= max(last, a_id, b_id):
                raise ValueError("ids must ascend with the ranks of their merges")
            last = whole
            self.merged[a_id << 32 | b_id] = whole
            self.left[whole], self.right[whole] = a_id, b_id
            self.usable[whole] = self.usable[a_id] and self.usable[b_id] and self._stay(a_id, b_id, whole)

    def _stay(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes earlier than ``before`` and than the merges that made them.

        Takes the latest merge of either side back, one after another, and looks at what then
        meets at the border. Of equal merges the left one comes first.
        """
        while True:
            if self.merged.get(a << 32 | b, before) < before:
                return False
            if a > b and self.right[a] != a:
                before, a = a, self.right[a]
            elif self.left[b] != b:
                before, b = b + 1, self.left[b]
            elif self.right[a] != a:
                before, a = a, self.right[a]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text that ends in token ``a`` and goes on with ``b`` keeps both; kept in the table once found."""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._stay(a, b, 1 << 62)
        return self.pairs[key]

    def word(self, spelled: str) -> list[int]:
        """Ids of one word, given in byte-level characters."""
        text = spelled + _END
        end = len(text)
        longest: list[int | None] = [None] * end
        for last, token in self.automaton.iter(text):
            longest[last + 1 - self.length[token]] = token  # a later end is a longer token
        token = longest[0]
        if token is not None and self.length[token] == end:
            return [token]
        length, shorter, pairs = self.length, self.shorter, self.pairs
        closed: set[int] = set()
        tokens: list[int] = []
        at = 0
        while at < end:
            while token is not None:
                stop = at + length[token]
                if stop not in closed:
                    if not tokens:
                        break
                    fits = pairs.get(tokens[-1] << 32 | token)
                    if fits if fits is not None else self.compatible(tokens[-1], token):
                        break
                token = shorter[token]
            if token is None:
                closed.add(at)
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte")
                last = tokens.pop()
                at -= length[last]
                token = shorter[last]
                continue
            tokens.append(token)
            at = stop
            token = longest[at] if at < end else None
        return tokens

    def _ids_of(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.alphabet[b] for b in word.encode("utf-8")])
        return array("I", self.word(word)).tobytes()

    def _segment(self, text: str) -> list[bytes]:
        known = self.words
        if self.own_cut and not _OTHER_TEXT.search(text):
            cut_words = _WORDS.findall(text.lower())
            spell = self._ids_of
        else:  # characters whose classes and forms depend on a Unicode version: cut as the library does
            cut_words = [_END + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
            spell = lambda w: array("I", self.word(w[1:])).tobytes()
        new = set(cut_words).difference(known)
        if len(known) + len(new) > MEMO_WORDS:
            known.clear()
            new = set(cut_words)
        for word in new:
            known[word] = spell(word)
        return [known[w] for w in cut_words]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_pattern is None or not (parts := self.special_pattern.split(text))[1:]:
            return b"".join(self._segment(text))
        return b"".join(x for k, part in enumerate(parts) for x in ([self.special[part]] if k % 2 else self._segment(part)))


def _cuts_as_known(declared: dict) -> bool:
    """Whether the file's normalizer and word pattern are those that this module cuts by itself."""
    normalizer, cutter = declared.get("normalizer") or {}, declared.get("pre_tokenizer") or {}
    steps, cuts = normalizer.get("normalizers", []), cutter.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": WORD_PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    )


class Decoder:
    """All tokens' bytes one after another, a space behind each, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        if declared.get("decoder"):
            raise ValueError("only files without a decoder of their own can be decoded")
        spelled = {i: t for t, i in declared["model"]["vocab"].items()} | {t["id"]: t["content"] for t in declared.get("added_tokens") or []}
        parts = [(spelled[i] + " ").encode() if i in spelled else b"" for i in range(max(spelled) + 1)]
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all documents, offsets of the documents); ``lengths`` counts each document's ids.

        Tokens are joined by single spaces. Ids that the vocabulary lacks are left out.
        """
        known = ids < len(self.starts) - 1
        safe = np.where(known, ids, 0).astype(np.int64)
        begin = self.starts[safe]
        size = np.where(known, self.starts[safe + 1] - begin, 0)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.data[np.arange(total) + np.repeat(begin - (ends - size), size)] if total else np.zeros(0, np.uint8)
        borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        full = np.flatnonzero(borders[1:] > borders[:-1])
        keep = np.ones(total, bool)
        keep[borders[1:][full] - 1] = False  # the space behind a document's last token
        offsets = borders.copy()
        dropped = np.zeros(len(borders), np.int64)
        dropped[full + 1] = 1
        return data[keep], offsets - np.cumsum(dropped)


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers): one row per row of ``docs``.

    Whole texts, without begin, end or added special tokens; special strings inside a text
    become their ids, as is the library's default. A null or empty text has no ids. Null and
    repeated ids stay as they are; other columns are left out; an empty table gives none.
    No row moves: a task encodes what it reads, a few megabytes of text at a time, and
    remembers a bounded number of words.
    """
    path = tokenizer_path("word_bpe_49k.json", tokenizer)

    def encode(batch: pa.RecordBatch):
        coder = encoder(path)
        ids = [coder.encode(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(texts(docs, id_col, text_col).select("text", "doc_id"), encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, text: every row of ``encoded`` with the text its ids stand for, special tokens included.

    The file names no decoder, so the text is the tokens as the vocabulary spells them, one
    space between two. No ids or null ids give the empty text.
    """
    path = tokenizer_path("word_bpe_49k.json", tokenizer)

    def decode(batches):
        table = decoder(path)
        for batch in batches:
            ids = batch.column(1).fill_null(b"")
            bounds = np.frombuffer(ids.buffers()[1], np.int64 if pa.types.is_large_binary(ids.type) else np.int32)
            bounds = bounds[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            start = 0
            while start < len(ids):
                end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + 4 * DECODE_IDS, side="right")) - 1)
                end = min(end, len(ids))
                body = ids.buffers()[2]
                flat = np.frombuffer(body, "<u4", (bounds[end] - bounds[start]) // 4, bounds[start]) if body is not None and bounds[end] > bounds[start] else np.zeros(0, "<u4")
                data, offsets = table.decode(flat, np.diff(bounds[start : end + 1]) // 4)
                text = pa.Array.from_buffers(pa.large_string(), end - start, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids.slice(start, end - start).cast(pa.binary()), text.cast(pa.string())], ["doc_id", "ids", "text"])
                start = end

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, text string")
