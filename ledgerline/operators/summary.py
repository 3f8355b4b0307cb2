"""Mergeable summaries: exact count, sum, minimum and maximum, and a log-linear histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.summaries import bucket_high, bucket_index, bucket_low, window_start


def histogram(samples: DataFrame, *key: str) -> DataFrame:
    """One row per key and bucket: n, sum, low, high. Summaries of parts merge by adding rows up again."""
    return samples.groupBy(*key, bucket_index(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def merge(histograms: DataFrame, *key: str) -> DataFrame:
    return histograms.groupBy(*key, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def summarize(histograms: DataFrame, *key: str) -> DataFrame:
    """One row per key: count, sum, minimum, maximum."""
    return histograms.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantile(histograms: DataFrame, ppm: int, *key: str) -> DataFrame:
    """Nearest rank: the first and last ranks are exact, others the middle of the rank's bucket, held within the range."""
    whole = summarize(histograms, *key)
    up = F.sum("n").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = histograms.select(*key, "bucket", up.alias("upto")).join(whole, list(key))
    rank = F.greatest(F.lit(1), F.ceil(F.lit(ppm) * F.col("n") / 1_000_000))
    at = ranked.withColumn("rank", rank).where("upto >= rank").groupBy(*key, "n", "low", "high", "rank").agg(F.min("bucket").alias("bucket"))
    low, high = bucket_low(F.col("bucket")), bucket_high(F.col("bucket"))
    middle = low + F.floor((high - low) / 2)
    value = F.when(F.col("rank") >= F.col("n"), F.col("high")).when(F.col("rank") == 1, F.col("low")).otherwise(F.least(F.greatest(middle, F.col("low")), F.col("high")))
    return at.select(*key, value.alias("value"))


def offer(summaries: DataFrame, *key: str) -> DataFrame:
    """The newest revision of each summary; equal revisions go by content."""
    rest = [c for c in summaries.columns if c not in key]
    order = F.struct("revision", *(c for c in rest if c != "revision"))
    return summaries.groupBy(*key).agg(F.max(order).alias("r")).select(*key, "r.*")


def windowed(samples: DataFrame, length: str) -> DataFrame:
    return samples.withColumn("window_start", window_start(F.col("at_ms"), length))


def counter_total(samples: DataFrame) -> DataFrame:
    """Monotone counters: the largest of each origin, added up."""
    return samples.groupBy("metric", "origin").agg(F.max("value").alias("value")).groupBy("metric").agg(F.sum("value").alias("total"))


def gauge_latest(samples: DataFrame) -> DataFrame:
    """The latest (at, value) of each origin."""
    return samples.groupBy("origin").agg(F.max(F.struct("at_ms", "value")).alias("g")).select("origin", "g.at_ms", "g.value")
