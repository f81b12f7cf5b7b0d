"""Topics: vocabulary, TF-IDF, reduction, clustering, labels, rollups and activity.

The layout and the clustering are linear and centroid based (principal components and
k-means from MLlib); everything after the cluster ids is relational and exact.
"""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import fixed_values as fv
from murmur.functions.exprs import floor_div, micros, round_to, to_utc, top_per_group, ts_lit
from murmur.functions.text import unigrams_and_bigrams, vocab_tokens
from murmur.operators.trends import mentions
from murmur.session import materialize

# Columns that the terms of a text are hashed to before the reduction, which needs a matrix of that width squared.
HASHED_TERMS = 1024
# Parts that the texts of one scan task are dealt to before they are cut into terms.
PARTS_PER_SCAN = 16


# --- vocabulary and vectors -------------------------------------------------


def vector_terms(text: Column) -> Column:
    """Words of two or more characters and their bigrams; texts without any give ``empty``."""
    joined = F.coalesce(F.nullif(F.array_join(vocab_tokens(text), " "), F.lit("")), F.lit("empty"))
    return unigrams_and_bigrams(F.regexp_extract_all(joined, F.lit(r"\w\w+"), F.lit(0)))


def _parts(docs: DataFrame) -> int:
    """Parts to deal texts to before they are cut into terms, so that a part's different terms fit in a task's memory."""
    return PARTS_PER_SCAN * max(1, docs.rdd.getNumPartitions())


def term_table(docs: DataFrame, key: str = "doc_id", terms: Column | str = "terms") -> DataFrame:
    """(block, key, term, count); every frequency and weight is computed from it.

    ``terms`` of ``docs`` are cut and counted where the rows of a key are: ``docs`` are dealt to
    blocks by their key, which shuffles no more than they hold. Best if they hold a text that ``terms`` cuts.
    """
    blocks = _parts(docs)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = docs.withColumn("block", block.alias("block", metadata={"blocks": blocks})).repartition(blocks, "block").select("block", key, F.explode(terms).alias("term"))
    return rows.groupBy("block", key, "term").agg(F.count("*").alias("count"))


def _documents(terms: DataFrame) -> Column:
    return terms.agg(F.count_distinct("doc_id")).scalar()


def _idf(n_docs: Column | int, df: str) -> Column:
    return F.log((n_docs + F.lit(1)) / (F.col(df) + 1)) + 1


def vocabulary(terms: DataFrame, min_df: int = 2, n_docs: Column | int | None = None) -> DataFrame:
    """All terms of a ``term_table`` in at least ``min_df`` documents: corpus and document frequency and smooth idf.

    ``n_docs`` is the number of documents with terms, counted in ``terms`` if it is not given.
    """
    n_docs = _documents(terms) if n_docs is None else n_docs
    stats = terms.groupBy("term").agg(F.sum("count").alias("cf"), F.count("*").alias("df")).filter(F.col("df") >= min_df)
    return stats.withColumn("idf", _idf(n_docs, "df"))


def _weigh(held: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a block whose term is known: count times idf, unit length per document."""
    if not known.num_rows:  # no term of the block is in enough documents
        return held.select(["doc_id", "term"]).slice(0, 0).append_column("weight", pa.array([], pa.float64()))
    at = pc.index_in(held["term"], value_set=known["known"].combine_chunks())
    held = held.filter(pc.is_valid(at))
    raw = held["count"].to_numpy() * known["idf"].to_numpy()[at.drop_null().to_numpy()]
    doc = held["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    norm = np.sqrt(np.bincount(doc, raw * raw))
    return pa.table([held["doc_id"], held["term"], pa.array(raw / norm[doc])], ["doc_id", "term", "weight"])


def tfidf_weights(terms: DataFrame, min_df: int = 2, n_docs: Column | int | None = None) -> DataFrame:
    """Long form (doc_id, term, weight) of a ``term_table``, unit length per document; no term is cut off.

    Each block sends its different terms and gets their idf back beside the rows of its documents.
    These stay in their block, where a task looks the terms up in a hash table instead of sorting all rows
    by term and again by document; a term that all documents hold is one row per block.
    """
    n_docs = _documents(terms) if n_docs is None else n_docs
    asked = terms.groupBy("block", "term").agg(F.count("*").alias("df"))
    answers = asked.withColumn("df", F.sum("df").over(Window.partitionBy("term"))).filter(F.col("df") >= min_df)
    # new columns: Spark loses those of the right side that the left one has, too
    idf = answers.select(F.col("block").alias("asked_by"), F.col("term").alias("known"), _idf(n_docs, "df").alias("idf"))
    idf = idf.repartition(terms.schema["block"].metadata["blocks"], "asked_by")
    schema = T.StructType([terms.schema["doc_id"], terms.schema["term"], T.StructField("weight", T.DoubleType())])
    return terms.groupBy("block").cogroup(idf.groupBy("asked_by")).applyInArrow(_weigh, schema)


def tfidf_vectors(docs: DataFrame, width: int = HASHED_TERMS, min_df: int = 2) -> DataFrame:
    """Replace ``terms`` by ``features``: unit TF-IDF vectors of all terms, hashed to ``width`` columns.

    No vocabulary is gathered anywhere; the driver sees ``width`` document frequencies. The hashed
    counts are needed twice and written once, so texts are cut into terms once.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    counts = HashingTF(numFeatures=width, inputCol="terms", outputCol="__tf").transform(docs).drop("terms")
    counts = materialize(counts, "hashed-terms")
    weighted = IDF(minDocFreq=min_df, inputCol="__tf", outputCol="__w").fit(counts).transform(counts)
    return Normalizer(p=2.0, inputCol="__w", outputCol="features").transform(weighted).drop("__tf", "__w")


def reduce_vectors(vectors: DataFrame, k: int = 50) -> DataFrame:
    """Replace ``features`` by their first ``k`` principal components, computed and applied in the JVM.

    Tasks add up one (width x width) matrix each, which is what reaches the driver.
    """
    from pyspark.ml.feature import PCA

    vectors = materialize(vectors, "vectors")
    width = vectors.select(F.col("features")).first()["features"].size
    model = PCA(k=max(1, min(k, width)), inputCol="features", outputCol="__reduced").fit(vectors)
    reduced = model.transform(vectors).drop("features").withColumnRenamed("__reduced", "features")
    return materialize(reduced, "reduced")


def _dense(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


def embedding_vectors(df: DataFrame, column: str) -> DataFrame:
    """Use a precomputed ``array<float>`` column as ``features``."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def embed_texts(posts: DataFrame, make_predict_fn, batch_size: int = 64) -> DataFrame:
    """Add ``features`` from an encoder; ``make_predict_fn`` loads it once per worker."""
    from pyspark.ml.functions import array_to_vector, predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return posts.withColumn("features", array_to_vector(encode(F.col("text")).cast("array<double>")))


def layout(reduced: DataFrame) -> DataFrame:
    """Add raw ``x``/``y``: the first two components of ``features``."""
    dense = _dense("features")
    return reduced.withColumn("x", dense[0]).withColumn("y", dense[1])


def nearest_centres(reduced: DataFrame, k: int = 12, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """(``reduced`` with ``centre``, the centres) by k-means."""
    from pyspark.ml.clustering import KMeans

    n = reduced.count()
    model = KMeans(k=max(2, min(k, n)), seed=seed, featuresCol="features", predictionCol="centre").fit(reduced)
    return model.transform(reduced), [c.tolist() for c in model.clusterCenters()]


def smallest_topic(n: int) -> int:
    """Members below which a cluster of ``n`` points is noise."""
    return max(fv.TOPIC_MIN_MEMBERS, n // fv.TOPIC_MEMBER_SHARE)


def topics_of_centres(placed: DataFrame) -> DataFrame:
    """Turn ``centre`` into ``topic_id``; clusters below the smallest size become -1."""
    sizes = placed.groupBy("centre").agg(F.count("*").alias("__size"))
    floor = smallest_topic(placed.count())
    kept = placed.join(sizes, "centre", "left")
    return kept.withColumn("topic_id", F.when(F.col("__size") >= floor, F.col("centre")).otherwise(F.lit(-1))).drop("__size")


def cluster(reduced: DataFrame, k: int = 12, seed: int = 42) -> DataFrame:
    """Add ``topic_id`` by k-means; clusters below max(28, n/55) members become -1."""
    return topics_of_centres(nearest_centres(reduced, k, seed)[0]).drop("centre")


def squared_distances(centres: list[list[float]]) -> Column:
    """Squared distance of ``features`` to every centre."""
    dense = _dense("features")
    between = lambda c: F.aggregate(F.zip_with(dense, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return F.array(*[between(c) for c in centres])


# --- labels -----------------------------------------------------------------


def cluster_term_scores(docs: DataFrame, min_count: int = 2) -> DataFrame:
    """Class-based TF-IDF: (topic_id, term, cnt, score) for words and bigrams of each topic.

    ``docs`` has ``topic_id`` and ``text``; topic -1 is left out. Document frequency
    counts topics and is taken before the count floor. The counts feed three
    aggregates, so they are written once and the texts are cut into terms once, dealt
    to parts whose counts fit in memory.
    """
    texts = docs.filter(F.col("topic_id") != -1).select("topic_id", "text")
    rows = texts.repartition(_parts(texts)).select("topic_id", F.explode(unigrams_and_bigrams(vocab_tokens(F.col("text")))).alias("term"))
    counts = materialize(rows.groupBy("topic_id", "term").agg(F.count("*").alias("cnt")), "term-counts")
    totals = counts.groupBy("topic_id").agg(F.sum("cnt").alias("total"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df"))
    n_topics = docs.filter(F.col("topic_id") != -1).agg(F.count_distinct("topic_id")).scalar()
    boost = F.when(F.contains("term", F.lit(" ")), fv.BIGRAM_BOOST).otherwise(1.0)
    score = F.col("cnt") / F.col("total") * F.log(1 + n_topics / F.col("df")) * boost
    return (
        counts.filter(F.col("cnt") >= min_count)
        .join(spread, "term")
        .join(totals, "topic_id")
        .select("topic_id", "term", "cnt", score.alias("score"))
    )


LABEL_POOL = 64


def _conflict(picked: Column, term: Column) -> Column:
    return F.exists(picked, lambda p: F.contains(p, term) | F.contains(term, p))


def _pooled_labels(ranked: DataFrame, top_n: int, pool: int) -> DataFrame:
    """(topic_id, terms, settled): greedy picks among the ``pool`` best terms of each topic.

    Settled topics have all their picks, or no term beyond the pool.
    """
    best = top_per_group(ranked, ["topic_id"], [F.col("score").desc(), F.col("term")], pool, rank="rank")
    packed = best.groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("pool")
    )
    none = F.array().cast("array<string>")
    fold = F.aggregate(
        "pool",
        none,
        lambda acc, t: F.when((F.size(acc) >= top_n) | _conflict(acc, t), acc).otherwise(F.concat(acc, F.array(t))),
    )
    sizes = ranked.groupBy("topic_id").agg(F.count("*").alias("n"))
    return (
        packed.withColumn("terms", fold)
        .join(sizes, "topic_id")
        .select("topic_id", "terms", ((F.size("terms") >= top_n) | (F.col("n") <= pool)).alias("settled"))
    )


def _labels_by_rounds(ranked: DataFrame, top_n: int) -> DataFrame:
    """Greedy picks over all terms: each round takes the best remaining term of each topic."""
    picks = ranked.select("topic_id").distinct().withColumn("terms", F.array().cast("array<string>"))
    for _ in range(top_n):
        free = F.when(~_conflict(F.col("terms"), F.col("term")), F.struct((-F.col("score")).alias("s"), "term"))
        picks = (
            ranked.join(picks, "topic_id")
            .groupBy("topic_id")
            .agg(F.min(free)["term"].alias("term"), F.first("terms").alias("terms"))
            .select("topic_id", F.array_compact(F.concat("terms", F.array("term"))).alias("terms"))
        )
    return picks


def pick_labels(scores: DataFrame, top_n: int = 6, pool: int = LABEL_POOL) -> DataFrame:
    """Greedy terms per topic: best score first, skipping terms that contain or are contained in a pick.

    Nearly every topic settles within its ``pool`` best terms, which one pass finds. The
    rest run over all their terms in ``top_n`` rounds of plain aggregation, so no topic's
    vocabulary is ever gathered in one task and no candidate is cut off.
    """
    ranked = materialize(scores.select("topic_id", "term", round_to(F.col("score"), 12).alias("score")), "label-scores")
    pooled = materialize(_pooled_labels(ranked, top_n, pool), "label-pool")
    settled = pooled.filter("settled").select("topic_id", "terms")
    rest = pooled.filter("not settled").select("topic_id")
    if rest.isEmpty():
        return settled
    return settled.unionByName(_labels_by_rounds(ranked.join(rest, "topic_id", "left_semi"), top_n))


# --- rollups ----------------------------------------------------------------


def topic_sizes(posts: DataFrame) -> DataFrame:
    """Members and plain mean sentiment per topic."""
    return (
        posts.filter(F.col("topic_id") != -1)
        .groupBy("topic_id")
        .agg(
            F.count("*").alias("size"),
            round_to(
                F.coalesce(F.try_divide(round_to(F.sum("sentiment_score"), 6), F.count("sentiment_score")), F.lit(0.0)), 4
            ).alias("sentiment_avg"),
        )
    )


def topic_tickers(posts: DataFrame, k: int = 6) -> DataFrame:
    """The most mentioned tickers per topic with their rank."""
    counts = mentions(posts.filter(F.col("topic_id") != -1), "topic_id").groupBy("topic_id", "ticker").agg(F.count("*").alias("count"))
    return top_per_group(counts, ["topic_id"], [F.col("count").desc(), F.col("ticker")], k, rank="rank")


def topic_activity(posts: DataFrame, now: datetime) -> DataFrame:
    """Three-hourly counts of the last 72 hours, oldest first, and their trend."""
    n = fv.TOPIC_SERIES_HOURS // fv.TOPIC_BUCKET_HOURS
    start = to_utc(now) - timedelta(hours=fv.TOPIC_SERIES_HOURS)
    width = fv.TOPIC_BUCKET_HOURS * 3_600_000_000
    idx = F.least(F.lit(n - 1), floor_div(F.unix_micros("ts") - F.lit(micros(start)), width)).cast("int")
    counts = (
        posts.filter(F.col("topic_id") != -1)
        .select("topic_id", F.when(F.col("ts") >= ts_lit(start), idx).alias("idx"))
        .groupBy("topic_id", "idx")
        .agg(F.count("*").alias("n"))
    )
    entries = F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "n")))
    packed = counts.groupBy("topic_id").agg(F.map_from_entries(entries).alias("m"))
    series = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    add = lambda acc, x: acc + x
    early = F.aggregate(F.slice("series", 1, n // 2), F.lit(0).cast("long"), add)
    late = F.aggregate(F.slice("series", n // 2 + 1, n - n // 2), F.lit(0).cast("long"), add)
    return (
        packed.select("topic_id", series.alias("series"))
        .withColumn("early", early)
        .withColumn("late", late)
        .withColumn(
            "trend",
            F.when(F.col("late") > F.col("early") * fv.TREND_RATIO, "rising")
            .when(F.col("late") * fv.TREND_RATIO < F.col("early"), "cooling")
            .otherwise("flat"),
        )
        .select("topic_id", "series", "trend")
    )


def topic_rollup(posts: DataFrame, labels: DataFrame, now: datetime) -> DataFrame:
    """One row per topic."""
    tickers = topic_tickers(posts).groupBy("topic_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "ticker", "count"))).alias("t")
    )
    label = F.when(F.size("terms") > 0, F.array_join(F.slice("terms", 1, 3), " / ")).otherwise(
        F.concat(F.lit("topic "), F.col("topic_id").cast("string"))
    )
    none = F.array().cast("array<string>")
    return (
        topic_sizes(posts)
        .join(labels, "topic_id", "left")
        .withColumn("terms", F.coalesce("terms", none))
        .join(tickers, "topic_id", "left")
        .join(topic_activity(posts, now), "topic_id", "left")
        .select(
            F.col("topic_id").alias("id"),
            label.alias("label"),
            "terms",
            "size",
            "sentiment_avg",
            F.transform(
                F.coalesce("t", F.array().cast("array<struct<rank:int,ticker:string,count:bigint>>")),
                lambda e: F.struct(e["ticker"].alias("ticker"), e["count"].alias("count")),
            ).alias("tickers"),
            "series",
            "trend",
        )
    )


def normalized_points(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Scale both coordinates to 0..1 with four decimals; a constant axis becomes 0."""
    span = points.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    bounds = span.select(F.struct("*").alias("b")).scalar()
    out = points.withColumn("__b", bounds)
    for c in (x, y):
        lo, hi = F.col(f"__b.lo_{c}"), F.col(f"__b.hi_{c}")
        width = F.when(hi - lo > 0, hi - lo).otherwise(F.lit(1.0))
        out = out.withColumn(c, round_to((F.col(c) - lo) / width, 4))
    return out.drop("__b")


def export_points(points: DataFrame, text_chars: int | None = None, max_tickers: int | None = None) -> DataFrame:
    """The point rows with whole texts and all tickers; both can be shortened for a preview."""
    text = F.col("text") if text_chars is None else F.substring("text", 1, text_chars)
    tickers = F.col("tickers") if max_tickers is None else F.slice("tickers", 1, max_tickers)
    return points.select(
        F.col("id").alias("post_id"), "topic_id", "x", "y", text.alias("text"), "platform", "sentiment", "engagement", tickers.alias("tickers")
    )


def assign_topics(posts: DataFrame, points: DataFrame) -> DataFrame:
    """Posts with the topic of their point; noise becomes null."""
    ids = points.select("id", F.nullif("topic_id", F.lit(-1)).alias("__topic"))
    return posts.join(ids, "id", "left").withColumn("topic_id", F.col("__topic")).drop("__topic")


def recency_sample(posts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recent posts, for callers that want the bounded variant."""
    return posts.orderBy(F.col("ts").desc(), "id").limit(n)


def compute_topics(posts: DataFrame, now: datetime, k: int = 12) -> tuple[DataFrame, DataFrame] | None:
    """(topics, points) over all given posts, or None below the minimum of posts."""
    if posts.limit(fv.TOPIC_MIN_POSTS).count() < fv.TOPIC_MIN_POSTS:
        return None
    docs = posts.drop("topic_id").withColumn("terms", vector_terms(F.col("text")))
    reduced = reduce_vectors(tfidf_vectors(docs).drop("terms"))
    points = materialize(normalized_points(layout(cluster(reduced, k))).drop("features"), "topic-points")
    labels = pick_labels(cluster_term_scores(points))
    return topic_rollup(points, labels, now), export_points(points)
