"""Co-mention graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.trends import mentions
from murmur.session import materialize
from murmur.sources.dictionary import enrich_entities

SHOWN_EDGES = 120


def mention_counts(posts: DataFrame, min_mentions: int = 5) -> DataFrame:
    return mentions(posts).groupBy("ticker").agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= min_mentions)


def co_mentions(posts: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    """Weights of unordered pairs of kept tickers that share a post; posts are unique by ``key``.

    Tickers below the floor leave before any pair is formed, so a post that lists many rare
    symbols makes no pairs of them. Pairs are counted in the task that forms them.
    """
    several = posts.filter(F.size(F.array_distinct("tickers")) > 1)
    rows = mentions(several, key).join(kept.select("ticker"), "ticker", "left_semi")
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_set("ticker")).alias("t")).filter(F.size("t") > 1)
    pairs = listed.select("t", F.posexplode("t").alias("i", "source")).select(
        "source", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("target")
    )
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def graph_nodes(kept: DataFrame, weights: DataFrame, entities: DataFrame, min_mentions: int = 5, min_edge: int = 2) -> DataFrame:
    """Kept tickers that have a strong edge or many mentions."""
    strong = weights.filter(F.col("weight") >= min_edge)
    connected = strong.select(F.explode(F.array("source", "target")).alias("ticker")).distinct()
    chosen = kept.join(connected.withColumn("linked", F.lit(True)), "ticker", "left").filter(
        F.col("linked").isNotNull() | (F.col("mentions") >= min_mentions * 4)
    )
    return enrich_entities(chosen.drop("linked"), entities).select(F.col("ticker").alias("id"), "name", "sector", "mentions")


def graph_edges(weights: DataFrame, min_edge: int = 2) -> DataFrame:
    """All edges of at least ``min_edge``.

    Both ends of such an edge are kept tickers with a strong edge, so they are nodes by
    definition and need no join.
    """
    return weights.filter(F.col("weight") >= min_edge)


def strongest_edges(edges: DataFrame, n: int = SHOWN_EDGES) -> DataFrame:
    """The heaviest edges, as they are shown; a read step over the stored edges."""
    return edges.orderBy(F.col("weight").desc(), "source", "target").limit(n)


def compute_graph(posts: DataFrame, entities: DataFrame, min_mentions: int = 5, min_edge: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph; the pair weights, which both need, are computed once."""
    kept = mention_counts(posts, min_mentions)
    weights = materialize(co_mentions(posts, kept), "pair-weights")
    return graph_nodes(kept, weights, entities, min_mentions, min_edge), graph_edges(weights, min_edge)
