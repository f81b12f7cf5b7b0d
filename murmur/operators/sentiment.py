"""Sentiment: phrase lexicon, labels, model hook and influence weighting."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import fixed_values as fv
from murmur.functions.exprs import bind, lookup, round_to
from murmur.functions.stats import influence_weight, sentiment_label


def _phrase_table(bull: Mapping[str, float], bear: Mapping[str, float]) -> Column:
    rows = [(p, w) for p, w in bull.items()] + [(p, -w) for p, w in bear.items()]
    return F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(float(w)).alias("weight")) for p, w in rows])


def _hit_factor(prefix: Column) -> Column:
    """Negation and intensifier factor for one hit, from the text right before it."""
    factor = F.when(prefix.rlike(fv.NEGATED), F.lit(fv.NEGATION_FACTOR)).otherwise(F.lit(1.0))
    tail = F.regexp_replace(prefix, r"(?U)\s+$", "")
    for word, mult in fv.INTENSIFIERS.items():
        factor = factor * F.when(tail.endswith(word), F.lit(mult)).otherwise(F.lit(1.0))
    return factor


def lexicon_raw(text: Column, bull=fv.BULL_PHRASES, bear=fv.BEAR_PHRASES) -> Column:
    """Signed phrase sum before squashing.

    Splitting the text at a phrase gives every non-overlapping hit; the text before
    hit ``i`` is rebuilt from at most ``span`` parts, enough for the 30 characters
    that matter, so long texts with many hits stay linear.
    """
    shortest = min(len(p) for p in [*bull, *bear])
    span = fv.PREFIX_CHARS // shortest + 2

    def hit(parts: Column, e: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), i - (span - 1))
        before = F.call_function("array_join", F.slice(parts, first, i - first + 1), e["phrase"])
        return bind(F.substring(before, -fv.PREFIX_CHARS, fv.PREFIX_CHARS), _hit_factor)

    def phrase_score(padded: Column, e: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), e["phrase"], F.lit("\\E"))
        return bind(
            F.split(padded, quoted),
            lambda parts: F.aggregate(
                F.sequence(F.lit(1), F.size(parts) - 1), F.lit(0.0), lambda acc, i: acc + e["weight"] * hit(parts, e, i)
            ),
        )

    def total(padded: Column) -> Column:
        present = F.filter(_phrase_table(bull, bear), lambda e: F.contains(padded, e["phrase"]))
        return F.aggregate(present, F.lit(0.0), lambda acc, e: acc + phrase_score(padded, e))

    return bind(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), total)


def lexicon_score(text: Column, **lexicon) -> Column:
    """Unrounded score in -1..1."""
    return F.tanh(lexicon_raw(text, **lexicon) / fv.SQUASH)


def score_posts_lexicon(posts: DataFrame, **lexicon) -> DataFrame:
    """Set score (4 decimals) and label; the label looks at the unrounded score."""
    scored = posts.withColumn("__s", lexicon_score(F.col("text"), **lexicon))
    return (
        scored.withColumn("sentiment_score", round_to(F.col("__s"), 4))
        .withColumn("sentiment", sentiment_label(F.col("__s"), fv.LABEL_THRESHOLD))
        .drop("__s")
    )


def score_posts_model(posts: DataFrame, make_predict_fn: Callable, batch_size: int = 32, max_chars: int | None = None) -> DataFrame:
    """Set score and label from a classifier.

    ``make_predict_fn`` loads the model once per Python worker and returns a function
    from an array of texts to ``{"bull": [...], "bear": [...], "neutral": [...]}``
    probabilities. Texts are passed whole; ``max_chars`` cuts them for models with a
    fixed input length (512 for the usual finance classifier).
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType, StructField, StructType

    result = StructType([StructField(n, DoubleType()) for n in ("bull", "bear", "neutral")])
    predict = predict_batch_udf(make_predict_fn, return_type=result, batch_size=batch_size)
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    p = posts.withColumn("__p", predict(text))
    bull, bear, neutral = F.col("__p.bull"), F.col("__p.bear"), F.col("__p.neutral")
    label = (
        F.when((bull >= bear) & (bull >= neutral), "bull")
        .when(bear >= neutral, "bear")
        .otherwise("neutral")
    )
    return (
        p.withColumn("sentiment_score", round_to(bull - bear, 4)).withColumn("sentiment", label).drop("__p")
    )


def post_weight(authority: Mapping[str, float] = fv.PLATFORM_AUTHORITY) -> Column:
    """Influence weight of a post row."""
    return influence_weight(lookup(F.col("platform"), {k: float(v) for k, v in authority.items()}, 1.0), F.col("engagement"))


def weighted_sentiment_agg(weight: Column, score: Column) -> Column:
    """Aggregate: influence-weighted mean over scored posts, null without any."""
    return F.try_divide(F.sum(weight * score), F.sum(F.when(score.isNotNull(), weight)))


def weighted_sentiment(posts: DataFrame, keys: list[str], authority=fv.PLATFORM_AUTHORITY) -> DataFrame:
    return posts.groupBy(*keys).agg(
        weighted_sentiment_agg(post_weight(authority), F.col("sentiment_score")).alias("sentiment_avg")
    )
