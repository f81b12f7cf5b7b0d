"""Text helpers: fingerprints, HTML stripping, vocabulary cleaning, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.exprs import bind, string_array
from murmur.functions.fixed_values import STOPWORDS

# Normalised texts below this length are never fingerprinted.
COPYPASTE_MIN_CHARS = 80


def normalized_tokens(text: Column) -> Column:
    """Lower-cased word and cashtag tokens without URLs, joined by single blanks."""
    bare = F.regexp_replace(F.lower(text), r"(?U)https?://\S+", " ")
    # Extracting the kept characters is several times faster than replacing the others.
    return F.array_join(F.regexp_extract_all(bare, F.lit("[a-z0-9$]+"), F.lit(0)), " ")


def copypaste_fingerprint(text: Column, min_chars: int = COPYPASTE_MIN_CHARS) -> Column:
    """16 hex digits over the normalised text, or null for short texts."""
    return bind(
        normalized_tokens(text),
        lambda norm: F.when(F.length(norm) >= min_chars, F.substring(F.sha1(norm), 1, 16)),
    )


def strip_html(html: Column) -> Column:
    """Tags become blanks, runs of white space collapse, ends are trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " ")
    return F.trim(spaced)


def vocab_tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Lower-case vocabulary words: no cashtags, URLs, digits, stopwords or short words."""
    clean = F.regexp_replace(text, r"\$[A-Za-z.]{1,6}", " ")
    clean = F.regexp_replace(clean, r"(?U)https?://\S+", " ")
    words = F.transform(F.regexp_extract_all(clean, F.lit("[a-zA-Z-]+"), F.lit(0)), lambda w: F.lower(w))
    stop = list(stopwords)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def unigrams_and_bigrams(tokens: Column) -> Column:
    """All words plus all pairs of neighbouring words."""

    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(t, F.when(F.size(t) > 1, pairs).otherwise(string_array([])))

    return bind(tokens, both)
