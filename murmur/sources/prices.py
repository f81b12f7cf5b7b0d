"""Price candles: symbol mapping and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.exprs import round_to
from murmur.functions.fixed_values import COINS
from murmur.functions.timeparse import parse_mixed_timestamp
from murmur.sources.dictionary import enrich_entities


def quote_symbol(ticker: Column, sector: Column, coins=COINS) -> Column:
    """Coins quote as ``X-USD``; share classes swap the dot for a dash."""
    is_coin = ticker.isin(*coins) & (sector == "Crypto") & ~ticker.endswith("-USD")
    return F.when(is_coin, F.concat(ticker, F.lit("-USD"))).otherwise(F.replace(ticker, F.lit("."), F.lit("-")))


def with_quote_symbol(tickers: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``quote_symbol`` to a frame with ``ticker``."""
    return enrich_entities(tickers, entities).withColumn("quote_symbol", quote_symbol(F.col("ticker"), F.col("sector")))


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Candles with UTC time, four decimals and whole volumes; what is no number becomes null."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return raw.select(
        "ticker",
        parse_mixed_timestamp(F.col("ts")).alias("ts"),
        *[round_to(number(c), 4).alias(c) for c in ("open", "high", "low", "close")],
        number("volume").try_cast("bigint").alias("volume"),
    )
