import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from helpers import NOW, dicts, frame, post
from murmur.operators import alerts, brief, dashboard, graph, topics
from murmur.sources.dictionary import Dictionary

DICT = Dictionary.build({"AA": {"name": "Alpha", "sector": "S1"}, "BB": {"name": "Beta", "sector": "S2"}})

TREND = (
    "ticker string, name string, sector string, phase string, window_hours int, mentions bigint, mentions_prev bigint, breakout_score double, "
    "sentiment_avg double, bull_bear_ratio double, velocity double, share_of_voice double, engagement_weighted_score double, "
    "platforms map<string,bigint>, top_posts array<struct<text:string,author:string,platform:string,engagement:bigint>>"
)


def trend(spark, *rows):
    data = []
    for r in rows:
        base = dict(ticker="AA", name="Alpha", sector="S1", phase="steady", window_hours=24, mentions=10, mentions_prev=5, breakout_score=0.0,
                    sentiment_avg=0.0, bull_bear_ratio=1.0, velocity=0.1, share_of_voice=0.1, engagement_weighted_score=1.0, platforms={"x": 1}, top_posts=[])
        base.update(r)
        data.append(tuple(base[f.split()[0]] for f in TREND.replace("array<struct<text:string,author:string,platform:string,engagement:bigint>>", "t").replace("map<string,bigint>", "m").split(", ")))
    return spark.createDataFrame(data, TREND)


@pytest.mark.parametrize(
    "row,kinds",
    [
        (dict(breakout_score=2.0, mentions=10), ["mention_spike"]),
        (dict(breakout_score=1.99, mentions=10), []),
        (dict(sentiment_avg=-0.25, bull_bear_ratio=0.59), ["bearish_turn"]),
        (dict(sentiment_avg=-0.25, bull_bear_ratio=0.6), []),
        (dict(sentiment_avg=0.35, bull_bear_ratio=3.1, breakout_score=1.1), ["bullish_surge"]),
        (dict(sentiment_avg=0.35, bull_bear_ratio=3.1, breakout_score=1.0), []),
        (dict(mentions=8, mentions_prev=0), ["new_entrant"]),
        (dict(mentions=4, mentions_prev=9, sentiment_avg=-0.9, bull_bear_ratio=0.1), []),
        (dict(mentions=12, mentions_prev=0, breakout_score=3.0), ["mention_spike", "new_entrant"]),
    ],
)
def test_alert_rules(spark, row, kinds):
    assert sorted(a["kind"] for a in dicts(alerts.alert_candidates(trend(spark, row), NOW))) == kinds


def test_alert_message_and_freshness(spark):
    found = alerts.detect_alerts(trend(spark, dict(breakout_score=2.345, mentions=12, phase="emerging"), dict(ticker="BB", mentions=9, mentions_prev=0)), NOW)
    rows = dicts(found)
    assert [r["kind"] for r in rows] == ["new_entrant", "mention_spike"]
    assert rows[1]["message"] == "$AA mention volume is 2.3σ above its trailing baseline (12 mentions/24h, phase: emerging)."
    previous = found.filter("ticker = 'AA'")
    assert [r["ticker"] for r in dicts(alerts.fresh_alerts(found, previous))] == ["BB"]


def test_arrows_and_badges(spark):
    cases = [(0, 0, "—", "new"), (5, 0, "new", "new"), (15, 10, "▲ 50%", "▲ 50%"), (5, 10, "▼ 50%", "▼ 50%"), (201, 200, "▲ 0%", "·"), (10, 10, "▲ 0%", "·"), (1005, 1000, "▲ 0%", "·"), (1025, 1000, "▲ 2%", "▲ 3%")]
    df = spark.createDataFrame([(c, p) for c, p, _, _ in cases], "c bigint, p bigint")
    rows = df.select(brief.arrow(F.col("c"), F.col("p")).alias("a"), dashboard.delta_badge(F.col("c"), F.col("p")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(a, b) for _, _, a, b in cases]


def test_brief_sections(spark):
    voice = [("buy now", "bob", "x", 9)]
    mood = spark.createDataFrame([(60.3, "greed", 3, 2, 1, 6)], "index double, label string, bull bigint, bear bigint, neutral bigint, posts bigint")
    rows = trend(spark, dict(phase="emerging", breakout_score=2.0, top_posts=voice), dict(ticker="BB", name="Beta", phase="fading", mentions=4))
    topic = spark.createDataFrame([(1, "rate cut", 7, 0.5, [("AA", 3)]), (2, "oil", 9, -0.25, [])], "id int, label string, size bigint, sentiment_avg double, tickers array<struct<ticker:string,count:bigint>>")
    text = brief.brief_text(brief.brief_lines(rows, mood, topic, alerts.detect_alerts(rows, NOW), NOW, "demo")).first()["markdown"]
    lines = text.split("\n")
    assert lines[0] == "# Market Chatter Brief" and lines[3] == "## Market mood: Greed (60.3/100)"
    assert "- **$AA** (Alpha) — 10 mentions (▲ 100% vs prior window), breakout 2.0σ, bull:bear 1.0." in lines
    assert "- **$BB** — chatter cooling (4 vs 5 mentions), sentiment +0.00." in lines
    assert "| $BB | 4 | ▼ 20% | 1.0 | +0.00 | fading |" in lines
    assert lines.index("- **oil** — 9 posts, sentiment -0.25.") < lines.index("- **rate cut** — 7 posts (mostly $AA), sentiment +0.50.")
    assert '> "buy now" — *bob on x, $AA, 9 engagement*' in lines
    order = [lines.index(h) for h in ("## Emerging tickers", "## Fading stories", "## Most discussed", "## Themes in the conversation", "## Unusual activity", "## Voices from the crowd", "---")]
    assert order == sorted(order)


def test_brief_without_anything_emerging(spark):
    mood = spark.createDataFrame([(50.0, "neutral", 0, 0, 0, 0)], "index double, label string, bull bigint, bear bigint, neutral bigint, posts bigint")
    rows = trend(spark, dict(top_posts=[("hello", "bob", "x", 1)]))
    text = brief.brief_text(brief.brief_lines(rows, mood, None, alerts.detect_alerts(rows, NOW), NOW, "demo")).first()["markdown"]
    assert "- Nothing breaking out this window." in text and "Fading" not in text and "Unusual" not in text and "> \"hello\"" in text


def test_leaderboard_filters_and_sorts(spark):
    t = trend(spark, dict(mentions=3, platforms={"x": 2}), dict(ticker="BB", name="Beta", sector="S2", mentions=9, platforms={"y": 1}), dict(ticker="CC", name=None, sector="S2", mentions=5))
    def names(**kw):
        return [r["ticker"] for r in dashboard.leaderboard(t, **kw).collect()]
    assert names() == ["BB", "CC", "AA"] and names(descending=False) == ["AA", "CC", "BB"]
    assert names(query="ALPH") == ["AA"] and names(query="b") == ["BB"] and names(sector="S2") == ["BB", "CC"] and names(platform="y") == ["BB"]
    with pytest.raises(ValueError):
        dashboard.leaderboard(t, sort_key="nope")
    assert [r["sector"] for r in dashboard.sector_facets(t).collect()] == ["S1", "S2"]
    pair = {r["metric"]: (r["a"], r["b"]) for r in dashboard.head_to_head(t).collect()}
    assert pair["mentions"] == (9.0, 5.0)
    assert {r["metric"]: r["a"] for r in dashboard.head_to_head(t, "AA", "BB").collect()}["mentions"] == 3.0


def test_graph_equals_brute_force(spark):
    rng = random.Random(3)
    names = [f"T{chr(65 + i)}" for i in range(12)] + ["AA"]
    lists = [rng.sample(names, rng.choice([0, 1, 1, 2, 3, 5])) for _ in range(90)]
    nodes, edges = graph.compute_graph(frame(spark, [post(i, 1, t) for i, t in enumerate(lists)]), DICT.entities(spark))
    counts = Counter(t for x in lists for t in x)
    keep = {t for t, n in counts.items() if n >= 5}
    want = Counter(p for x in lists for p in combinations(sorted(set(x) & keep), 2))
    assert {(e["source"], e["target"]): e["weight"] for e in dicts(edges)} == {k: w for k, w in want.items() if w >= 2}
    first = sorted((e for e in want.items() if e[1] >= 2), key=lambda e: (-e[1], e[0]))[:7]
    assert [((e["source"], e["target"]), e["weight"]) for e in graph.strongest_edges(edges, 7).collect()] == first
    linked = {t for p, w in want.items() if w >= 2 for t in p}
    assert {n["id"]: n["mentions"] for n in dicts(nodes)} == {t: counts[t] for t in keep if t in linked or counts[t] >= 20}
    by_id = {n["id"]: n for n in dicts(nodes)}
    if "AA" in by_id:
        assert by_id["AA"]["name"] == "Alpha"


def test_labels_skip_contained_terms(spark):
    rows = [(0, t, s) for t, s in [("rate cut", 9.0), ("rate", 8.0), ("cut", 7.0), ("fed rate cut", 6.5), ("oil", 6.0), ("gold", 6.0), ("x1", 5.0)]] + [(1, "solo", 1.0)]
    scores = spark.createDataFrame(rows, "topic_id int, term string, score double")
    for pool in (64, 3, 1):  # small pools send topic 0 through the rounds
        picks = {r["topic_id"]: r["terms"] for r in topics.pick_labels(scores, 4, pool).collect()}
        assert picks == {0: ["rate cut", "gold", "oil", "x1"], 1: ["solo"]}


def test_labels_by_pool_and_by_rounds_equal_a_plain_loop(spark):
    rng = random.Random(11)
    words = ["oil", "oil price", "price", "gas", "gas oil", "rate", "rates", "cut", "rate cut", "chip", "chips", "ai", "main", "rain"]
    rows = [(t, w, round(rng.uniform(0, 3), 1)) for t in range(12) for w in rng.sample(words, rng.randrange(1, len(words)))]
    want = {}
    for t, w, _ in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        got = want.setdefault(t, [])
        if len(got) < 5 and not any(w in p or p in w for p in got):
            got.append(w)
    scores = spark.createDataFrame(rows, "topic_id int, term string, score double")
    for pool in (64, 4):
        assert {r["topic_id"]: r["terms"] for r in topics.pick_labels(scores, 5, pool).collect()} == want


def test_reduction_finds_the_principal_directions(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) * [10, 5, 2] @ np.linalg.qr(rng.normal(size=(20, 3)))[0].T + 3
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>")
    got = topics.reduce_vectors(topics.embedding_vectors(df, "v"), 3).orderBy("i").collect()
    got = np.stack([r["features"].toArray() for r in got])
    _, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(got), np.abs(x @ vectors[:, ::-1][:, :3]), atol=1e-6)


def test_weights_come_from_one_table_without_a_cut(spark):
    from math import log, sqrt

    rng = random.Random(4)
    texts = {i: [rng.choice("abcdefghij") + str(rng.randrange(600)) for _ in range(200)] for i in range(60)}
    table = topics.term_table(spark.createDataFrame(list(texts.items()), "doc_id int, terms array<string>"))
    df = Counter(t for words in texts.values() for t in set(words))
    vocab = {r["term"]: (r["cf"], r["df"]) for r in topics.vocabulary(table).collect()}
    assert vocab == {t: (sum(w.count(t) for w in texts.values()), n) for t, n in df.items() if n >= 2} and len(vocab) > 1000
    want = {}
    for i, words in texts.items():
        raw = {t: n * (log(61 / (df[t] + 1)) + 1) for t, n in Counter(words).items() if df[t] >= 2}
        norm = sqrt(sum(v * v for v in raw.values()))
        want |= {(i, t): v / norm for t, v in raw.items()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in topics.tfidf_weights(table).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_topics_end_to_end(spark):
    rng = random.Random(1)
    themes = ["oil barrel supply tanker crude", "chip foundry wafer node yield", "rate cut federal reserve inflation"]
    rows = []
    for i in range(180):
        words = themes[i % 3].split()
        rows.append(post(f"p{i}", rng.uniform(0, 100), ["AA" if i % 3 else "BB"], text=" ".join(rng.choices(words, k=6)), sentiment_score=0.5))
    posts = frame(spark, rows)
    found, points = topics.compute_topics(posts, NOW, k=3)
    found, points = dicts(found), dicts(points)
    assert len(points) == 180 and all(0 <= p["x"] <= 1 and 0 <= p["y"] <= 1 for p in points)
    assert sum(t["size"] for t in found) == sum(p["topic_id"] != -1 for p in points) == 180
    assert all(t["sentiment_avg"] == 0.5 and t["label"] and len(t["series"]) == 24 for t in found)
    assert topics.compute_topics(posts.limit(10), NOW) is None


def test_small_clusters_become_noise(spark):
    df = topics.embedding_vectors(spark.createDataFrame([(i, [float(i >= 90) * 100, 0.0]) for i in range(100)], "i int, v array<double>"), "v")
    sizes = {r["topic_id"]: r["count"] for r in topics.cluster(df, 2).groupBy("topic_id").count().collect()}
    assert sizes[-1] == 10 and sum(sizes.values()) == 100


def test_topic_activity_trend(spark):
    rows = [post(i, 1 + i * 0.1, topic_id=1) for i in range(10)] + [post(f"c{i}", 60 + i * 0.1, topic_id=2) for i in range(10)] + [post("old", 500, topic_id=3)]
    got = {r["topic_id"]: r for r in dicts(topics.topic_activity(frame(spark, rows), NOW))}
    assert got[1]["trend"] == "rising" and got[2]["trend"] == "cooling" and got[3]["trend"] == "flat"
    assert sum(got[1]["series"]) == 10 and got[3]["series"] == [0] * 24


def test_encoder_hook_feeds_the_clustering(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[float(len(t)), float("oil" in t)] for t in texts], dtype="float32")

    df = frame(spark, [post(i, 1, text="oil " * (i % 2) + "x" * (i % 5)) for i in range(60)])
    points = topics.layout(topics.reduce_vectors(topics.embed_texts(df, make), 2))
    assert points.count() == 60 and points.filter("x is null").count() == 0


def exchanges(df):
    """What the shuffles of a plan are dealt by, final or not."""
    import re

    return re.findall(r"Exchange (?:hashpartitioning\(([^)]*)\)|Round)", df._jdf.queryExecution().executedPlan().toString())


def test_rows_of_documents_stay_in_their_block(spark):
    """Only texts, a block's different terms and their idf are shuffled; rows of a repeated or null id are one document."""
    rows = [(1, "oil gas oil"), (2, "oil rate"), (2, "gas oil"), (None, "rate cut"), (None, "cut gas"), (3, "chip")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    table = topics.term_table(docs, terms=F.split("text", " "))
    assert all(e.startswith("block") for e in exchanges(table))
    counts = {(r["doc_id"], r["term"]): r["count"] for r in table.collect()}
    assert counts == Counter((i, w) for i, t in rows for w in t.split())
    weights = topics.tfidf_weights(table)
    assert not any("doc_id" in e for e in exchanges(topics.tfidf_weights(table, n_docs=3)))
    from math import log, sqrt

    df = Counter(t for _, t in counts)
    want = {}
    for i in {i for i, _ in counts}:
        raw = {t: n * (log(4 / (df[t] + 1)) + 1) for (j, t), n in counts.items() if j == i and df[t] >= 2}
        want |= {(i, t): v / sqrt(sum(x * x for x in raw.values())) for t, v in raw.items()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in weights.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_texts_are_cut_into_terms_once_for_their_vectors(spark):
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cuts.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, f"oil gas w{i % 3}") for i in range(50)], "doc_id int, text string")
    vectors = topics.tfidf_vectors(docs.select("doc_id", words.asNondeterministic()("text").alias("terms")))
    assert vectors.columns == ["doc_id", "features"] and len(vectors.collect()) == 50
    assert cuts.value == 50


def test_texts_are_dealt_to_parts_before_their_terms_are_counted(spark, monkeypatch):
    written = []
    keep = topics.materialize
    monkeypatch.setattr(topics, "materialize", lambda df, name: written.append((name, exchanges(df))) or keep(df, name))
    docs = spark.createDataFrame([(i % 2, f"oil gas oil gas w{i % 3}") for i in range(20)], "topic_id int, text string")
    got = {(r["topic_id"], r["term"]): r["cnt"] for r in topics.cluster_term_scores(docs).collect()}
    assert got[0, "oil"] == got[1, "oil gas"] == 20
    assert [name for name, _ in written] == ["term-counts"] and "" in written[0][1]


def test_weights_sort_only_the_different_terms_of_blocks(spark):
    """The rows of documents are looked up where they are; blocks without a shared term and rows without an id count, too."""
    rows = [(1, "oil gas"), (None, "oil oil gas rate"), *((i, f"only{i}") for i in range(10, 30))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    weights = topics.tfidf_weights(topics.term_table(docs, terms=F.split("text", " ")), n_docs=len(rows))
    assert weights._jdf.queryExecution().executedPlan().toString().count("Window [") == 1
    assert weights.dtypes == [("doc_id", "int"), ("term", "string"), ("weight", "double")]
    got = {(r["doc_id"], r["term"]): r["weight"] for r in weights.collect()}
    assert got.keys() == {(1, "oil"), (1, "gas"), (None, "oil"), (None, "gas")}
    assert abs(got[1, "oil"] - 0.5**0.5) < 1e-9 and abs(got[None, "oil"] - 0.8**0.5) < 1e-9 and abs(got[None, "gas"] - 0.2**0.5) < 1e-9
