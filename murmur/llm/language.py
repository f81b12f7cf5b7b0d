"""Language identification in two steps: the family, then one-versus-one separators within it.

Features are counts of byte trigrams of the lower-cased text, everything but letters taken for
spaces, hashed to ``WIDTH`` places, by their square roots and scaled to length 1. All
separators are linear support vector machines (squared hinge loss, dual coordinate
descent), each trained in a task of its own from a sample of ``PER_LANGUAGE`` documents a language.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from murmur.llm.inputs import cut, flat_bytes

WIDTH = 2048
PER_LANGUAGE = 500  # labelled documents a language that the separators are fitted on: the stated bound of the sample
PIECES = 3  # short passages of each of them, so that short texts are learned too
BATCH_BYTES = 1 << 20
UNKNOWN = "und"

# Language families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "gu", "pa", "si"),
    "semitic": ("ar", "he", "am", "mt"),
}

_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, f"={language}")


def features(column: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` features per text; texts without letters have zeros."""
    data, offsets = flat_bytes(pc.utf8_lower(column))
    n = len(offsets) - 1
    letters = _LETTER[data].astype(np.uint32)
    before, behind = np.full(len(letters), 32, np.uint32), np.full(len(letters), 32, np.uint32)
    before[1:], behind[:-1] = letters[:-1], letters[1:]
    some = offsets[:-1] < offsets[1:]
    before[offsets[:-1][some]] = behind[offsets[1:][some] - 1] = 32  # a text's ends look at spaces
    code = before * np.uint32(0x9E3779B1) + letters * np.uint32(0x85EBCA77) + behind * np.uint32(0xC2B2AE3D)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 11)).astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    used = letters != 32
    counts = np.bincount(text[used] * WIDTH + code[used], minlength=n * WIDTH).reshape(n, WIDTH)
    rows = np.sqrt(counts, dtype=np.float32)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, 1e-9)


def train_separator(rows: np.ndarray, signs: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent."""
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    weights, alpha = np.zeros(rows.shape[1]), np.zeros(len(rows))
    share = np.where(signs > 0, len(signs) / max(1, 2 * (signs > 0).sum()), len(signs) / max(1, 2 * (signs < 0).sum()))
    ridge = 1 / (2 * cost * share)
    norms = (rows * rows).sum(axis=1) + ridge
    order = np.random.RandomState(3)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (rows[i] @ weights) - 1 + ridge[i] * alpha[i]
            step = max(0.0, alpha[i] - gradient / norms[i]) - alpha[i]
            if step:
                alpha[i] += step
                weights += step * signs[i] * rows[i]
    return weights


class LanguageModel:
    """Separators by name: ``family:X`` for a family against the others, ``pair:A:B`` for A against B."""

    def __init__(self, languages: list[str], separators: dict[str, np.ndarray]):
        self.languages = sorted(languages)
        self.families = sorted({family_of(x) for x in languages})
        self.names = sorted(separators)
        self.matrix = np.stack([separators[n] for n in self.names], axis=1) if separators else np.zeros((WIDTH + 1, 0))

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of texts that have letters."""
        if not self.languages:
            return np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        margins = features(column) @ self.matrix[:-1] + self.matrix[-1]
        place = {n: i for i, n in enumerate(self.names)}
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        by_family = np.stack([margins[:, place[f"family:{f}"]] if f"family:{f}" in place else np.zeros(len(column)) for f in self.families], axis=1)
        family = by_family.argmax(axis=1)
        score = sure(by_family.max(axis=1)) if len(self.families) > 1 else np.ones(len(column))
        found = np.empty(len(column), object)
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            own = [x for x in self.languages if family_of(x) == name]
            votes = np.zeros((len(rows), len(own)))
            strength = np.zeros((len(rows), len(own)))
            for a, b in combinations(range(len(own)), 2):
                m = margins[rows, place[f"pair:{own[a]}:{own[b]}"]]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                strength[:, a] += m
                strength[:, b] -= m
            best = (votes + np.tanh(strength / 100) / 2).argmax(axis=1) if len(rows) else np.zeros(0, int)
            found[rows] = np.array(own, object)[best]
            if len(own) > 1 and len(rows):
                score[rows] *= sure(strength[np.arange(len(rows)), best] / (len(own) - 1))
        return found, score


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Separators learned from rows with a language and a letter that are not held out.

    Of every language the ``per_language`` rows whose ids hash lowest are the sample; ids are
    ranked first (a limit per task before the shuffle), and only the sample's texts move.
    """
    usable = docs.filter(F.col(f"`{lang_col}`").isNotNull() & ~held_out(id_col) & F.col(f"`{id_col}`").isNotNull() & has_letter(text_col))
    named = usable.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = named.select("id", "lang", rank.alias("rank")).filter(F.col("rank") <= per_language).select("id").distinct()
    sample = usable.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).join(chosen, "id")

    def describe(batches):
        for batch in batches:
            for piece in cut(batch.select(["text", "lang"]), BATCH_BYTES):
                texts, langs = [], []
                for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    words = text.split()
                    random = np.random.RandomState(len(text))
                    texts.append(text)
                    for _ in range(PIECES):
                        at = random.randint(0, len(words))
                        texts.append(" ".join(words[at : at + random.randint(1, 30)]))
                    langs += [lang] * (1 + PIECES)
                rows = features(pa.array(texts, pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs), pa.array([r.tobytes() for r in rows.astype(np.float16)], pa.binary())], ["lang", "row"]
                )

    described = sample.mapInArrow(describe, "lang string, row binary")
    languages = sorted(r["lang"] for r in usable.select(F.col(f"`{lang_col}`").alias("lang")).distinct().collect())
    problems = []
    families = sorted({family_of(x) for x in languages})
    for family in families if len(families) > 1 else []:
        problems += [(f"family:{family}", x, 1 if family_of(x) == family else -1) for x in languages]
    for a, b in combinations(languages, 2):
        if family_of(a) == family_of(b):
            problems += [(f"pair:{a}:{b}", a, 1), (f"pair:{a}:{b}", b, -1)]
    if not problems:
        return LanguageModel(languages, {})
    spark = docs.sparkSession
    assigned = described.join(F.broadcast(spark.createDataFrame(problems, "name string, lang string, sign int")), "lang")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "row"])
        rows = np.stack([np.frombuffer(r, np.float16) for r in group["row"]]).astype(np.float32)
        weights = train_separator(rows, group["sign"].to_numpy())
        return pd.DataFrame({"name": [group["name"].iloc[0]], "weights": [weights.tobytes()]})

    fitted = assigned.groupBy("name").applyInPandas(fit, "name string, weights binary").collect()
    return LanguageModel(languages, {r["name"]: np.frombuffer(bytes(r["weights"])) for r in fitted})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Every column of ``docs`` with ``lang_pred`` and ``score`` behind ``prefix``, predicted from the text alone.

    A null text and one without a letter have ``und`` and score 0. Repeated rows are predicted
    alike; an empty table stays empty. Rows stay where they are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = f"{prefix}__letter"
    marked = docs.withColumn(letter, has_letter(text_col))
    names_in, place, width = docs.columns, docs.columns.index(text_col), len(docs.columns)
    fields = [*docs.schema.fields, StructField(f"{prefix}lang_pred", StringType()), StructField(f"{prefix}score", DoubleType())]

    def predict(batches):
        model = sent.value
        for batch in batches:
            for piece in cut(batch.select([place, *(i for i in range(width + 1) if i != place)]), BATCH_BYTES):
                for at in range(0, piece.num_rows, 512):
                    rows = piece.slice(at, 512)
                    column = rows.column(0)
                    column = pa.array([t or "" for t in column.to_pylist()], pa.large_string()) if column.null_count else column
                    names, scores = model.predict(column)
                    blank = ~np.array(rows.column(letter).to_pylist(), bool)
                    names[blank], scores[blank] = UNKNOWN, 0.0
                    back = rows.select(names_in)
                    yield pa.RecordBatch.from_arrays([*back.columns, pa.array(names, pa.string()), pa.array(scores)], [f.name for f in fields])

    return marked.mapInArrow(predict, StructType(fields))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document row, from a model trained on the rows not held out."""
    model = train(docs, id_col, text_col, lang_col, per_language)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return identify(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
