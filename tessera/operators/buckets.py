"""Bucket references: counts, nearest-rank quantiles, bands, distances, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def nearest_rank(values: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """One row a key: q10..q90 by rank round((n - 1) * p), halves to even.

    Values are counted first, so a key's window holds its distinct values only.
    """
    counts = values.groupBy(*keys, column).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(column))
    n = F.sum("c").over(Window.partitionBy(*keys))
    ranked = counts.withColumn("upto", upto).withColumn("n", n)
    wanted = lambda p: F.min(F.when(F.col("upto") > F.rint((F.col("n") - 1) * F.lit(p)), F.col(column)))
    return ranked.groupBy(*keys).agg(*[wanted(p).alias(f"q{round(p * 100)}") for p in QUANTILES])


def references(long: DataFrame, least: int) -> DataFrame:
    """Statistics of (bucket_id, feature, value) for buckets of ``least`` rows."""
    keys = ["bucket_id", "feature"]
    stats = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std")
    )
    return stats.where(F.col("n") >= least).join(nearest_rank(long, keys), keys)


def with_bands(long: DataFrame, refs: DataFrame) -> DataFrame:
    return long.join(refs.select("bucket_id", "feature", "q10", "q90", "std"), ["bucket_id", "feature"])


def support_distance(long: DataFrame, refs: DataFrame, digits: int = 6) -> DataFrame:
    """Mean over features of how far a value is outside its band, in band widths."""
    scale = F.greatest(F.col("q90") - F.col("q10"), F.col("std"), F.lit(1e-6))
    gap = F.greatest(F.col("q10") - F.col("value"), F.col("value") - F.col("q90"), F.lit(0.0)) / scale
    return with_bands(long, refs).groupBy("id", "bucket_id").agg(F.round(F.avg(gap), digits).alias("distance"))


def coverage(long: DataFrame, refs: DataFrame) -> DataFrame:
    """Share of rows with every feature inside its band, and of single features."""
    inside = F.col("value").between(F.col("q10"), F.col("q90"))
    rows = with_bands(long, refs).groupBy("id", "bucket_id").agg(F.bool_and(inside).alias("all_in"), F.avg(inside.cast("int")).alias("rate"))
    return rows.groupBy("bucket_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("all_in").cast("int")), 6).alias("hcr"), F.round(F.avg("rate"), 6).alias("feature_rate"))


def wasserstein(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """1-D distance of two samples (side 0 and 1) of ``value``, by key.

    Areas between the two empirical distribution functions over distinct values.
    """
    counts = pairs.groupBy(*keys, "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    order, whole = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys)
    share = lambda c: F.try_divide(F.sum(c).over(order), F.sum(c).over(whole))
    step = counts.withColumn("fa", share("a")).withColumn("fb", share("b"))
    step = step.withColumn("width", F.lead("value").over(order) - F.col("value"))
    return step.groupBy(*keys).agg(F.coalesce(F.sum(F.abs(F.col("fa") - F.col("fb")) * F.col("width")), F.lit(0.0)).alias("w1"))


def inverse_frequency(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, weight): N / (K * n), eight decimals."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(whole)).select(key, "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 8).alias("weight"))


def normalized_inverse_frequency(rows: DataFrame, key: str) -> DataFrame:
    """(key, gap): max(0, N / (K n) - 1) over its greatest value; zeros if that is 0."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.min("n").alias("least"))
    raw = lambda n: F.greatest(F.lit(0.0), F.col("total") / (F.col("k") * n) - 1)
    top = raw(F.col("least"))
    return counts.crossJoin(F.broadcast(whole)).select(key, F.when(top > 0, raw(F.col("n")) / top).otherwise(F.lit(0.0)).alias("gap"))


def pair_weight(gap: Column, margin: Column, language: Column, pair: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.5, eta: float = 0.5, low: float = 0.5, high: float = 3.0) -> Column:
    raw = 1.0 + alpha * gap + beta * F.greatest(F.lit(0.0), margin) + gamma * language + eta * pair
    return F.round(F.least(F.greatest(raw, F.lit(low)), F.lit(high)), 8)
