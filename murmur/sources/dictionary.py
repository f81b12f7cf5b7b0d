"""Entity dictionary: symbols, names, sectors, alias phrases and blocked symbols."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import schemas
from murmur.functions.fixed_values import AMBIGUOUS_SYMBOLS

TERMS = "kind string, term string, ticker string, rank int"
ENTRY = "name string, sector string, aliases array<string>"


@dataclass(frozen=True)
class Dictionary:
    """``symbols``: symbol -> (name, sector); ``aliases``: (phrase, symbol), longest phrase first."""

    symbols: dict[str, tuple[str, str]]
    aliases: tuple[tuple[str, str], ...]
    blocklist: frozenset[str]
    ambiguous: frozenset[str] = field(default=frozenset(AMBIGUOUS_SYMBOLS))

    @classmethod
    def build(cls, symbols: dict[str, dict], blocklist=(), ambiguous=AMBIGUOUS_SYMBOLS) -> Dictionary:
        """From ``{symbol: {"name", "sector", "aliases"}}``."""
        pairs = [(a.lower(), s) for s, info in symbols.items() for a in info.get("aliases", [])]
        pairs.sort(key=lambda p: -len(p[0]))
        return cls(
            {s: (info["name"], info["sector"]) for s, info in symbols.items()},
            tuple(pairs),
            frozenset(blocklist),
            frozenset(ambiguous),
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """Read ``{"tickers": {symbol: {...}}, "blocklist": [...]}`` from any Spark-readable path."""
        row = spark.read.text(path, wholetext=True).first()
        data = json.loads(row[0])
        return cls.build(data["tickers"], data.get("blocklist", []))

    def size(self) -> int:
        return len(self.symbols) + len(self.aliases) + len(self.blocklist)

    def entities(self, spark: SparkSession) -> DataFrame:
        rows = [(s, name, sector) for s, (name, sector) in self.symbols.items()]
        return spark.createDataFrame(rows, schemas.ENTITIES)

    def terms(self, spark: SparkSession) -> DataFrame:
        """The dictionary as the lookup table of ``entities.tag_posts_by_join``."""
        bare = set(self.symbols) - self.ambiguous - self.blocklist
        rows = [("cashtag", s, s, 0) for s in self.symbols] + [("bare", s, s, 0) for s in sorted(bare)]
        rows += [("alias", phrase, s, rank) for rank, (phrase, s) in enumerate(self.aliases)]
        rows += [("blocked", s, None, 0) for s in sorted(self.blocklist)]
        return spark.createDataFrame(rows, TERMS)

    def max_words(self) -> int:
        """Words of the longest alias phrase."""
        return max((len(re.findall(r"\w+", phrase)) for phrase, _ in self.aliases), default=0)

    def alias_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, phrase, symbol) for i, (phrase, symbol) in enumerate(self.aliases)]
        return spark.createDataFrame(rows, "rank int, alias string, ticker string")


def read_entries(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """ticker, name, sector, aliases, blocked: the entries of a dictionary kept as files.

    Lines hold one entry each, ``{"ticker", "name", "sector", "aliases"}`` or ``{"blocked":
    symbol}``, and are read in many tasks; with ``whole`` each file is one object of the form
    that ``Dictionary.load`` reads. Names default to the symbol, sectors to Other; entries
    without a symbol are left out.
    """
    nested = "struct<name:string,sector:string,aliases:array<string>>"
    rows = spark.read.schema(f"ticker string, {ENTRY}, blocked string, tickers map<string,{nested}>, blocklist array<string>").json(path, multiLine=whole)
    line = F.struct("ticker", "name", "sector", "aliases", "blocked")
    of_map = F.transform(
        F.map_entries("tickers"),
        lambda e: F.struct(e["key"], e["value"]["name"], e["value"]["sector"], e["value"]["aliases"], F.lit(None).cast("string")),
    )
    text = F.lit(None).cast("string")
    of_list = F.transform("blocklist", lambda b: F.struct(text, text, text, F.lit(None).cast("array<string>"), b))
    kind = "array<struct<ticker:string,name:string,sector:string,aliases:array<string>,blocked:string>>"
    none = F.array().cast(kind)
    entries = F.concat(F.array(line), F.coalesce(of_map.cast(kind), none), F.coalesce(of_list.cast(kind), none))
    listed = rows.select(F.inline(entries)).filter(F.col("ticker").isNotNull() | F.col("blocked").isNotNull())
    return listed.select("ticker", F.coalesce("name", "ticker").alias("name"), F.coalesce("sector", F.lit("Other")).alias("sector"), "aliases", "blocked")


def entries_to_terms(entries: DataFrame, ambiguous=AMBIGUOUS_SYMBOLS) -> DataFrame:
    """The lookup table of ``entities.tag_posts_by_join`` from ``read_entries``; longer aliases rank first."""
    symbols = entries.filter(F.col("ticker").isNotNull()).select("ticker").distinct()
    blocked = entries.filter(F.col("blocked").isNotNull()).select(F.col("blocked").alias("term")).distinct()
    bare = symbols.filter(~F.col("ticker").isin(list(ambiguous))).join(blocked, F.col("ticker") == F.col("term"), "left_anti")
    as_terms = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("ticker").alias("term"), "ticker", F.lit(0).alias("rank"))
    aliases = entries.select("ticker", F.explode("aliases").alias("term")).select(
        F.lit("alias").alias("kind"), F.lower("term").alias("term"), "ticker", (-F.length("term")).alias("rank")
    )
    held_back = blocked.select(F.lit("blocked").alias("kind"), "term", F.lit(None).cast("string").alias("ticker"), F.lit(0).alias("rank"))
    return as_terms(symbols, "cashtag").unionByName(as_terms(bare, "bare")).unionByName(aliases.distinct()).unionByName(held_back)


def enrich_entities(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``name`` (default: the symbol) and ``sector`` (default: Other).

    No broadcast hint: the planner broadcasts the dimension by its measured size.
    """
    dim = entities.select(
        F.col("ticker"), F.col("name").alias("__name"), F.col("sector").alias("__sector")
    )
    return (
        df.join(dim, "ticker", "left")
        .withColumn("name", F.coalesce("__name", "ticker"))
        .withColumn("sector", F.coalesce("__sector", F.lit("Other")))
        .drop("__name", "__sector")
    )
