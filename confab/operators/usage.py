"""Cost of token usage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions.text import to_fixed

#: Prices per million tokens (model, input, output). Fixed values.
PRICES = [
    ("claude-haiku-4-5-20251001", 1.0, 5.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-opus-4-8", 5.0, 25.0),
]
#: Share of the input price at which tokens read from the cache are billed. Fixed value.
CACHED_SHARE = 0.1


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    return spark.createDataFrame(prices, "model string, rate_in double, rate_out double")


def cost_of(total: Column, out: Column, cached: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cached tokens are part of the total; a cached count above it makes a negative term, which stands."""
    total, out, cached = (F.coalesce(x, F.lit(0)) for x in (total, out, cached))
    fresh = total - cached
    return (fresh * rate_in + cached * rate_in * F.lit(CACHED_SHARE)) / F.lit(1_000_000) + (out * rate_out) / F.lit(1_000_000)


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with its cost; rows of unknown models go (see unpriced()). The price list is a fixed few rows."""
    rows = usage.join(F.broadcast(prices), "model")
    cost = cost_of(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("rate_in"), F.col("rate_out"))
    return rows.withColumn("cost", cost).drop("rate_in", "rate_out")


def unpriced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, n): models without a price and their rows."""
    return usage.join(F.broadcast(prices), "model", "left_anti").groupBy("model").agg(F.count("*").alias("n"))


def log_lines(priced: DataFrame) -> DataFrame:
    """The line that reports each cost, with six exact decimals."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    line = F.concat(F.lit("["), "model", F.lit("] in="), n("input_tokens"), F.lit(" (cached "), n("cached_tokens"), F.lit(") out="), n("output_tokens"), F.lit(" → $"), to_fixed(6)(F.col("cost")))
    return priced.withColumn("line", line)


def cache_writes(usage: DataFrame, column: str = "cache_write_tokens") -> DataFrame:
    """usage with the line that reports tokens written to the cache. They are reported, not part of the cost."""
    return usage.withColumn("cache_line", F.concat(F.lit("cache write: "), F.coalesce(F.col(column).cast("string"), F.lit("0"))))


def suspicious(usage: DataFrame) -> DataFrame:
    """Rows with more cached than total tokens."""
    return usage.where(F.coalesce("cached_tokens", F.lit(0)) > F.coalesce("input_tokens", F.lit(0)))
