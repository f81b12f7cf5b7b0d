"""URL rules by host suffix and path prefix, found by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_CHARS = 8  # hex characters of the joined prefix: 32 bits


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_lengths(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Distinct lengths of rule hosts and paths: bounded by the longest rule, not by the number of rules."""
    row = rules.agg(
        F.collect_set(F.length("rule_host")).alias("hosts"), F.collect_set(F.length("rule_path")).alias("paths")
    ).first()
    return sorted(row["hosts"]), sorted(row["paths"])


def expressions(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) of a URL whose lengths occur among the rules.

    Suffixes start at the host's start or behind a dot.
    """
    size = F.length(host)
    suffixes = F.filter(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in host_lengths]).cast("array<int>"), lambda n: (n <= size) & (n > 0)),
            lambda n: F.when((n == size) | (host.substr(size - n, F.lit(1)) == "."), host.substr(size - n + 1, n)),
        ),
        lambda s: s.isNotNull(),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"), lambda n: n <= F.length(path)),
        lambda n: path.substr(F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The longest fitting rule of every page.

    ``rules`` has (host, path, verdict); a rule fits its host and all subdomains if the
    URL's path starts with the rule's path. The rule with most characters wins, then the
    one with the longer host, then ``block``. Pages no rule fits get ``default``.

    Result, one row per page row: page_id, host, path, rule (host + path, or null),
    verdict. Null URLs and URLs without ``://`` have empty host and path, which no rule
    fits (rules with an empty or null host are ignored). Null and repeated ids stay as
    they are. Rules are matched once per distinct (host, path), so that a page address
    that fills a third of the table is expanded once; its rows are then joined to the
    verdict, a join that adaptive execution can split.
    """
    rules = (
        rules.select(
            F.col("host").alias("rule_host"), F.coalesce(F.col("path"), F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
        )
        .filter(F.length("rule_host") > 0)
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block after allow
    )
    host_lengths, path_lengths = _rule_lengths(rules)
    digest = lambda h, p: F.sha2(F.concat_ws("/", F.length(h), F.concat(h, p)).cast("binary"), 256)
    keyed = rules.select(
        digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"), "rule_host", "rule_path", "rule_verdict"
    ).withColumn("prefix", F.substring("rule_digest", 1, HASH_CHARS))

    judged = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path")
    )
    addresses = judged.filter(F.length("host") > 0).select("host", "path").distinct()
    expanded = addresses.select(
        "host", "path", F.explode(expressions(F.col("host"), F.col("path"), host_lengths, path_lengths)).alias("e")
    ).select("host", "path", digest(F.col("e.host"), F.col("e.path")).alias("digest"))
    hits = expanded.withColumn("prefix", F.substring("digest", 1, HASH_CHARS)).join(keyed, "prefix")
    confirmed = hits.filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_verdict")
    best = confirmed.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("b")
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict")
    )
