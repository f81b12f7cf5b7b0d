"""Topics: vocabulary, vectors, clusters, labels, rollups, points."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import NOW, NOW_SQL, POSTS_SQL, all_posts, posts, table, with_ctes
from murmur.functions.fixed_values import STOPWORDS
from murmur.functions.text import vocab_tokens
from murmur.operators import dashboard, topics
from murmur.session import materialize


def _docs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", F.substring("source", 4, 10).cast("int").alias("topic_id"))


def _terms(spark, d):
    return _docs(spark, d).select("doc_id", topics.vector_terms(F.col("text")).alias("terms"))


def vocabulary_words(spark, d):
    words = vocab_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(words).alias("n"), F.sha1(F.array_join(words, " ")).alias("digest"))


def _term_table(spark, d):
    """The term table and the number of documents; each has a term, be it ``empty``."""
    docs = _docs(spark, d)
    table = topics.term_table(docs.select("doc_id", "text"), terms=topics.vector_terms(F.col("text")))
    return table, docs.agg(F.count_distinct("doc_id")).scalar()


def tfidf_vocabulary(spark, d):
    terms, n_docs = _term_table(spark, d)
    return topics.vocabulary(terms, n_docs=n_docs).withColumn("idf", F.round("idf", 6))


def tfidf_weights(spark, d):
    terms, n_docs = _term_table(spark, d)
    return topics.tfidf_weights(terms, n_docs=n_docs).withColumn("weight", F.round("weight", 6))


def _document_vectors(spark, d):
    return topics.reduce_vectors(topics.tfidf_vectors(_terms(spark, d)).drop("terms"))


def _embedding_vectors(spark, d):
    vectors = topics.embedding_vectors(table(spark, d, "embeddings"), "embedding").drop("embedding")
    return topics.reduce_vectors(vectors, 16)


def document_topics(spark, d):
    """Vectors, reduction, clustering and layout of all documents."""
    points = topics.normalized_points(topics.layout(topics.cluster(_document_vectors(spark, d))))
    return points.select("doc_id", "topic_id", "x", "y")


def embedding_topics(spark, d):
    """Clusters and layout of precomputed embeddings."""
    points = topics.normalized_points(topics.layout(topics.cluster(_embedding_vectors(spark, d), 10)))
    return points.select("vec_id", "label", "topic_id", "x", "y")


def _hold(reduced, key, k):
    """One row of what must hold of any clustering and layout of ``reduced``."""
    placed, centres = topics.nearest_centres(reduced, k)
    labelled = materialize(topics.topics_of_centres(placed), "labelled")
    far = F.col("distances")
    astray = far[F.col("centre")] > F.array_min(far) * (1 + 1e-6) + 1e-9
    floor = topics.smallest_topic(labelled.count())
    small = labelled.filter("topic_id <> -1").groupBy("topic_id").count().filter(F.col("count") < floor).agg(F.count("*")).scalar()
    kept_noise = labelled.filter("topic_id = -1").groupBy("centre").count().filter(F.col("count") >= floor).agg(F.count("*")).scalar()
    points = topics.normalized_points(topics.layout(labelled.withColumn("distances", topics.squared_distances(centres))))
    return points.agg(
        F.count("*").alias("points"), F.count_distinct(key).alias("keys"),
        (F.count_if(F.col("topic_id") != -1) + F.count_if(F.col("topic_id") == -1)).alias("members_and_noise"), F.count_if(astray).alias("astray"),
        *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max))],
    ).withColumns({"too_small": small, "wrongly_noise": kept_noise})


def document_topics_hold(spark, d):
    return _hold(_document_vectors(spark, d), "doc_id", 12)


def embedding_topics_hold(spark, d):
    return _hold(_embedding_vectors(spark, d), "vec_id", 10)


def ctfidf_scores(spark, d):
    return topics.cluster_term_scores(_docs(spark, d)).withColumn("score", F.round("score", 9))


def topic_labels(spark, d):
    labels = topics.pick_labels(topics.cluster_term_scores(_docs(spark, d)))
    return labels.withColumn("terms", F.array_join("terms", ","))


def _topic_posts(df):
    return df.withColumn("topic_id", F.floor(F.col("k") / 20).cast("int") - 1)


def _clustered(spark, d):
    return _topic_posts(all_posts(spark, d).filter(F.col("ts") <= F.lit(NOW)))


def topic_sizes(spark, d):
    return topics.topic_sizes(_clustered(spark, d))


def topic_tickers(spark, d):
    return topics.topic_tickers(_clustered(spark, d))


def topic_activity(spark, d):
    rows = topics.topic_activity(_clustered(spark, d), NOW)
    return rows.withColumn("series", F.array_join(F.transform("series", lambda x: x.cast("string")), ","))


def topic_rollup(spark, d):
    p = _clustered(spark, d)
    labels = p.filter("topic_id >= 0").select("topic_id").distinct().withColumn(
        "terms", F.when(F.col("topic_id") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("rate cut"), F.lit("oil")))
    )
    rows = topics.topic_rollup(p, labels, NOW)
    return rows.select(
        "id", "label", "size", "sentiment_avg", "trend",
        F.array_join(F.transform("tickers", lambda t: F.concat_ws("=", t["ticker"], t["count"].cast("string"))), ",").alias("tickers"),
    )


def normalized_points(spark, d):
    raw = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return topics.normalized_points(raw)


def export_points(spark, d):
    p = _topic_posts(all_posts(spark, d)).withColumn("x", F.col("engagement") / 10.0).withColumn("y", F.col("k") / 100.0)
    rows = topics.export_points(p)
    return rows.withColumn("tickers", F.array_join("tickers", ",")).withColumn("x", F.round("x", 4)).withColumn("y", F.round("y", 4))


def assign_topics(spark, d):
    p = all_posts(spark, d)
    points = _topic_posts(p).select("id", "topic_id")
    done = topics.assign_topics(p, points)
    return done.groupBy("topic_id").agg(F.count("*").alias("posts"), F.sum("engagement").alias("engagement")).withColumn(
        "topic_id", F.coalesce(F.col("topic_id").cast("string"), F.lit("none"))
    )


def points_of_topic(spark, d):
    points = topics.export_points(_topic_posts(all_posts(spark, d)).withColumn("x", F.lit(0.5)).withColumn("y", F.lit(0.5)))
    return dashboard.points_of_topic(points, 2).select("post_id", "topic_id")


def recency_sample(spark, d):
    return topics.recency_sample(posts(spark, d), 3000).select("id", "engagement")


STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
WORDS = rf"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(text, '\$[A-Za-z.]{{1,6}}', ' ', 'g'),
 'https?://\S+', ' ', 'g'), '[^a-zA-Z\s-]', ' ', 'g')), '\s+'), lambda w: length(w) > 2 and w not in ({STOP}))"""

VOCAB_SQL = rf"""
words as (select doc_id, array_to_string({WORDS}, ' ') j from documents),
toks as (select doc_id, regexp_extract_all(case when j = '' then 'empty' else j end, '\w\w+') t from words),
terms as (select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) term from toks),
vocab as (select term, count(*) cf, count(distinct doc_id) df from terms group by term having count(distinct doc_id) >= 2),
scored as (select *, ln(((select count(*) from documents) + 1) / (df + 1)) + 1 idf from vocab)
"""

CTFIDF_SQL = rf"""
words as (select cast(substr(source, 4) as int) topic_id, {WORDS} t from documents),
terms as (select topic_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) term from words),
counts as (select topic_id, term, count(*) cnt from terms group by 1, 2),
cs as (select topic_id, term, cnt, sum(cnt) over (partition by topic_id) total, count(*) over (partition by term) df from counts),
scores as (select topic_id, term, cnt, cnt / total * ln(1 + (select count(distinct topic_id) from words) / df)
             * case when contains(term, ' ') then 1.6::double else 1.0::double end score from cs where cnt >= 2)
"""

TOPIC_SQL = f"""
tp as (select *, cast(floor(k / 20) as int) - 1 topic_id from posts),
members as (select * from tp where topic_id <> -1),
sizes as (select topic_id, count(*) size, round(coalesce(round(sum(sentiment_score), 6) / nullif(count(sentiment_score), 0), 0.0), 4) sentiment_avg
          from members group by 1),
tt as (select topic_id, ticker, count(*) as count, row_number() over (partition by topic_id order by count(*) desc, ticker) rank
       from (select topic_id, t1 ticker from members union all select topic_id, t2 from members where t2 is not null and t2 <> t1) group by 1, 2 qualify rank <= 6),
acts as (select topic_id, least(23, (epoch_us(ts) - epoch_us({NOW_SQL} - interval 72 hour)) // 10800000000) idx, count(*) n
         from members where ts >= {NOW_SQL} - interval 72 hour group by 1, 2),
series as (select s.topic_id, i.idx, coalesce(n, 0) n from sizes s cross join (select range idx from range(24)) i left join acts a on a.topic_id = s.topic_id and a.idx = i.idx),
activity as (select topic_id, string_agg(n::varchar, ',' order by idx) series,
      case when sum(n) filter (where idx >= 12) > sum(n) filter (where idx < 12) * 1.3 then 'rising'
           when sum(n) filter (where idx >= 12) * 1.3 < sum(n) filter (where idx < 12) then 'cooling' else 'flat' end trend from series group by 1)
"""

HOLD_SQL = """
select count(*) points, count(distinct {key}) as keys, count(*) members_and_noise, 0::bigint astray, 0.0::double least_x, 1.0::double most_x,
  0.0::double least_y, 1.0::double most_y, 0::bigint too_small, 0::bigint wrongly_noise from {table}
"""

QUERIES = {
    "vocabulary_words": (vocabulary_words, f"select doc_id, len({WORDS}) n, sha1(array_to_string({WORDS}, ' ')) digest from documents"),
    "tfidf_vocabulary": (tfidf_vocabulary, with_ctes(VOCAB_SQL) + "select term, cf, df, round(idf, 6) idf from scored"),
    "tfidf_weights": (
        tfidf_weights,
        with_ctes(VOCAB_SQL, "raw as (select doc_id, term, count(*) * max(idf) raw from terms join scored using (term) group by 1, 2)")
        + "select doc_id, term, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) weight from raw",
    ),
    "document_topics": (document_topics, None),
    "embedding_topics": (embedding_topics, None),
    "document_topics_hold": (document_topics_hold, HOLD_SQL.format(key="doc_id", table="documents")),
    "embedding_topics_hold": (embedding_topics_hold, HOLD_SQL.format(key="vec_id", table="embeddings")),
    "ctfidf_scores": (ctfidf_scores, with_ctes(CTFIDF_SQL) + "select topic_id, term, cnt, round(score, 9) score from scores"),
    "topic_labels": (
        topic_labels,
        with_ctes(CTFIDF_SQL)
        + "select topic_id, array_to_string(list_reduce(list_transform(list(term order by round(score, 12) desc, term), lambda x: [x]), "
        "lambda acc, x: case when len(acc) >= 6 or len(list_filter(acc, lambda p: contains(p, x[1]) or contains(x[1], p))) > 0 then acc else list_concat(acc, x) end), ',') terms "
        "from scores group by topic_id",
    ),
    "topic_sizes": (topic_sizes, with_ctes(POSTS_SQL, TOPIC_SQL) + "select * from sizes"),
    "topic_tickers": (topic_tickers, with_ctes(POSTS_SQL, TOPIC_SQL) + "select * from tt"),
    "topic_activity": (topic_activity, with_ctes(POSTS_SQL, TOPIC_SQL) + "select * from activity"),
    "topic_rollup": (
        topic_rollup,
        with_ctes(POSTS_SQL, TOPIC_SQL)
        + "select topic_id id, case when topic_id = 0 then 'topic 0' else 'rate cut / oil' end as label, size, sentiment_avg, trend, "
        "(select string_agg(ticker || '=' || count, ',' order by rank) from tt where tt.topic_id = s.topic_id) tickers from sizes s join activity using (topic_id)",
    ),
    "normalized_points": (
        normalized_points,
        "select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 4) x, "
        "round((user_id::double - min(user_id) over ()) / (max(user_id) over () - min(user_id) over ()), 4) y from events",
    ),
    "export_points": (
        export_points,
        with_ctes(POSTS_SQL)
        + "select id post_id, cast(floor(k / 20) as int) - 1 topic_id, round(engagement / 10.0::double, 4) x, round(k / 100.0::double, 4) y, text, platform, sentiment, engagement, "
        "t1 || case when t2 is not null and t2 <> t1 then ',' || t2 else '' end tickers from allposts",
    ),
    "assign_topics": (
        assign_topics,
        with_ctes(POSTS_SQL)
        + "select case when k < 20 then 'none' else (k // 20 - 1)::varchar end topic_id, count(*) posts, cast(sum(engagement) as bigint) engagement from allposts group by 1",
    ),
    "points_of_topic": (points_of_topic, with_ctes(POSTS_SQL) + "select id post_id, 2 topic_id from allposts where k // 20 = 3"),
    "recency_sample": (recency_sample, with_ctes(POSTS_SQL) + "select id, engagement from posts order by ts desc, id limit 3000"),
}
