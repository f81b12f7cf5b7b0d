"""Entity extraction: cashtags, bare symbols and alias phrases.

Everything happens inside the row, so tagging adds no shuffle to the scan. Dictionaries that
are too large for a plan are joined as tables.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import bind, string_array
from murmur.functions.fixed_values import BARE_SYMBOL, CASHTAG, PLAUSIBLE_SYMBOL
from murmur.functions.lookup import member, slotted
from murmur.sources.dictionary import Dictionary

# Above this a dictionary is joined as a table; below it is a literal of the plan.
PLAN_TERMS = 200_000
# A table of up to so many terms is sent to every task of the join, so that no candidate is shuffled.
SENT_TERMS = 1_000_000


def cashtags(text: Column, d: Dictionary) -> Column:
    """Known symbols, or two to five letters that are not blocked."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), F.upper)
    known, blocked = member(d.symbols), member(d.blocklist)
    return F.array_distinct(F.filter(found, lambda s: known(s) | (s.rlike(PLAUSIBLE_SYMBOL) & ~blocked(s))))


def bare_symbols(text: Column, d: Dictionary) -> Column:
    """Upper-case known symbols that are neither ambiguous nor blocked."""
    found = F.regexp_extract_all(text, F.lit(BARE_SYMBOL), F.lit(1))
    allowed = member(set(d.symbols) - d.ambiguous - d.blocklist)
    return F.array_distinct(F.filter(found, allowed))


def of_words(phrase: str) -> bool:
    """Whether a phrase begins and ends with a word and splits into words alike in Python and the JVM."""
    kinds = [unicodedata.category(c) for c in phrase if c != "_"]
    same = all(kind[0] != "M" and kind not in ("Pc", "So", "Cf") for kind in kinds) and all(c.isnumeric() == c.isdecimal() for c in phrase)
    return same and re.fullmatch(r"\w(.*\w)?", phrase, re.DOTALL) is not None


def alias_symbols(text: Column, d: Dictionary) -> Column:
    """Symbols whose alias phrase occurs between word boundaries, longest phrase first.

    The text is cut once into its words, and the runs of neighbouring words that begin as
    some phrase of as many words does are looked up: the cost does not depend on the number
    of aliases. Phrases that do not begin and end with a word are searched for one by one.
    """
    if not d.aliases:
        return string_array([])
    entries: dict[str, list] = {}
    odd = []
    for rank, (phrase, symbol) in enumerate(d.aliases):
        if of_words(phrase):
            entries.setdefault(phrase, []).append({"rank": rank, "symbol": symbol})
        else:
            odd.append((rank, phrase, symbol))
    heads: dict[int, set[str]] = {}
    for phrase in entries:
        words = re.findall(r"\w+", phrase)
        heads.setdefault(len(words), set()).add(words[0])
    hit = "array<struct<rank:int,symbol:string>>"
    find = slotted(entries, hit)

    def hits(low: Column) -> Column:
        looked_up = F.flatten(F.filter(F.transform(_phrases_from(low, heads), find), lambda x: x.isNotNull()))
        searched = [
            F.when(F.contains(low, F.lit(p)) & low.rlike(rf"(?U)\b\Q{p}\E\b"), F.struct(F.lit(rank).alias("rank"), F.lit(s).alias("symbol")))
            for rank, p, s in odd
        ]
        both = F.concat(looked_up, F.array_compact(F.array(*searched)).cast(hit)) if searched else looked_up
        return F.array_distinct(F.transform(F.array_sort(both), lambda x: x["symbol"]))

    return F.coalesce(bind(F.lower(text), hits), string_array([]))


def extract_tickers(text: Column, d: Dictionary) -> Column:
    """All symbols of a text, most confident kind first."""
    return F.array_distinct(F.concat(cashtags(text, d), bare_symbols(text, d), alias_symbols(text, d)))


def tag_posts(posts: DataFrame, d: Dictionary, plan_terms: int = PLAN_TERMS) -> DataFrame:
    """Merge extracted symbols behind the ones a post already carries.

    A dictionary of up to ``plan_terms`` terms travels with the plan and adds no shuffle; a
    larger one is joined as a table, which needs posts that are unique by id.
    """
    if d.size() > plan_terms:
        return tag_posts_by_join(posts, d.terms(posts.sparkSession), d.max_words())
    own = F.coalesce("tickers", F.array().cast("array<string>"))
    return posts.withColumn("tickers", F.array_distinct(F.concat(own, extract_tickers(F.col("text"), d))))


# --- dictionaries kept as tables ---------------------------------------------

KINDS = ("cashtag", "bare", "alias")


def _numbered(terms: Column, kind: str) -> Column:
    return F.transform(terms, lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("term"), i.alias("pos")))


def _cut(low: Column) -> Column:
    """The words of a lower-case text, and each with what follows it up to the next one."""
    return F.struct(
        F.regexp_extract_all(low, F.lit(r"(?U)\w+\W*"), F.lit(0)).alias("pieces"),
        F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)).alias("words"),
    )


def _phrases(low: Column, max_words: int) -> Column:
    """All runs of up to ``max_words`` neighbouring words of a lower-case text with their own separators."""

    def runs(parts: Column) -> Column:
        pieces, words = parts["pieces"], parts["words"]
        found = [words]
        joined = lambda a, b: F.concat(a, b)
        before = pieces  # runs of one word less and what follows them
        for k in range(2, max_words + 1):
            n = F.greatest(F.size(words) - (k - 1), F.lit(0))
            found.append(F.zip_with(F.slice(before, F.lit(1), n), F.slice(words, F.lit(k), n), joined))
            before = F.zip_with(F.slice(before, F.lit(1), n), F.slice(pieces, F.lit(k), n), joined)
        return F.array_distinct(F.concat(*found))

    return bind(_cut(low), runs) if max_words else string_array([])


def _phrases_from(low: Column, heads: dict[int, set[str]]) -> Column:
    """The runs of ``k`` neighbouring words, with their own separators, whose first word is in ``heads[k]``."""
    if not heads:
        return string_array([])
    any_head = member(set().union(*heads.values()))

    def runs(parts: Column) -> Column:
        pieces, words = parts["pieces"], parts["words"]
        starts = F.array_compact(F.transform(words, lambda w, i: F.when(any_head(w), i + 1)))
        of = lambda at, k, head: F.filter(at, lambda i: (i <= F.size(words) - (k - 1)) & head(F.element_at(words, i)))
        return bind(starts, lambda at: F.array_distinct(F.concat(*[_runs_of(of(at, k, member(h)), pieces, words, k) for k, h in heads.items()])))

    return bind(_cut(low), runs)


def _runs_of(starts: Column, pieces: Column, words: Column, k: int) -> Column:
    return F.transform(
        starts,
        lambda i: F.concat(F.array_join(F.slice(pieces, i, F.lit(k - 1)), ""), F.element_at(words, i + (k - 1))),
    )


def tag_posts_by_join(posts: DataFrame, terms: DataFrame, max_words: int) -> DataFrame:
    """``tag_posts`` for dictionaries too large to be constants of a plan.

    ``terms`` has ``kind`` (cashtag, bare, alias or blocked), ``term``, ``ticker`` and
    ``rank``, as ``Dictionary.terms`` gives. Up to ``SENT_TERMS`` of them are sent to the
    posts and only what is found is shuffled. Beyond, candidates are: those of a post are
    distinct before the join, so a word that occurs in every post costs one row per post; the
    join side of such a word can be split because the dictionary holds it once. ``posts`` must
    be unique by id.
    """
    text = F.col("text")
    sent = F.broadcast if terms.count() <= SENT_TERMS else lambda table: table
    cash = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), lambda s: F.upper(s)))
    bare = F.array_distinct(F.regexp_extract_all(text, F.lit(BARE_SYMBOL), F.lit(1)))
    candidates = posts.select(
        "id",
        F.explode(
            F.concat(_numbered(cash, "cashtag"), _numbered(bare, "bare"), _numbered(_phrases(F.lower(text), max_words), "alias"))
        ).alias("c"),
    ).select("id", "c.kind", "c.term", "c.pos")
    listed = sent(terms.filter(F.col("kind").isin(*KINDS)))
    known = candidates.join(listed, ["kind", "term"]).select(
        "id", "kind", F.when(F.col("kind") == "alias", F.col("rank")).otherwise(F.col("pos")).alias("place"), "ticker"
    )
    taken = terms.filter(F.col("kind").isin("cashtag", "blocked")).select("term").distinct()
    unknown = (
        posts.select("id", F.explode(_numbered(cash, "cashtag")).alias("c"))
        .select("id", "c.kind", "c.term", "c.pos")
        .filter(F.col("term").rlike(PLAUSIBLE_SYMBOL))
        .join(sent(taken), "term", "left_anti")
        .select("id", "kind", F.col("pos").alias("place"), F.col("term").alias("ticker"))
    )
    order = F.when(F.col("kind") == "cashtag", 0).when(F.col("kind") == "bare", 1).otherwise(2)
    found = known.unionByName(unknown).groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct(order.alias("o"), "place", "ticker"))).alias("f")
    )
    own = F.coalesce("tickers", F.array().cast("array<string>"))
    extra = F.coalesce(F.transform("f", lambda x: x["ticker"]), F.array().cast("array<string>"))
    return posts.join(found, "id", "left").withColumn("tickers", F.array_distinct(F.concat(own, extra))).drop("f")
