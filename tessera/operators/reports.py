"""Evaluation of generated texts against human ones, bucket by bucket, and its report.

Features come long: (id, bucket_id, feature, value).  Bucket tables have one row a
bucket; overall figures are means over buckets (macro) or over rows (weighted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import buckets as B
from tessera.operators import distinct
from tessera.operators import metrics as M

# Columns of feature tables that are no features.
NO_FEATURES = frozenset("id dataset split field_name model_alias model_name bucket_id track family style_bucket length_bin".split())


def shared_features(*tables: list[str]) -> list[str]:
    """Names that all tables have, without those of records, sorted."""
    return sorted(set.intersection(*[set(t) for t in tables]) - NO_FEATURES)


def prototypes(long: DataFrame, least: int) -> DataFrame:
    """Mean, median and both support bands of every bucket and feature; buckets under ``least`` rows are flagged skipped."""
    keys = ["bucket_id", "feature"]
    stats = long.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("prototype_mean"))
    q = B.nearest_rank(long, keys)
    return stats.join(q, keys).select(*keys, "n", (F.col("n") < least).alias("skipped"), "prototype_mean", F.col("q50").alias("prototype_median"), "q10", "q90", "q25", "q75")


def gaps(generated: DataFrame, human: DataFrame, least: int) -> DataFrame:
    """(bucket_id, feature, n, gap): Wasserstein distance in human deviations, for buckets of ``least`` generated rows."""
    keys = ["bucket_id", "feature"]
    spread = human.groupBy(*keys).agg(F.stddev_pop("value").alias("s")).select(*keys, F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0).alias("s"))
    sizes = generated.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = generated.withColumn("side", F.lit(0)).unionByName(human.withColumn("side", F.lit(1)))
    return B.wasserstein(both, keys).join(spread, keys).join(sizes, keys).select(*keys, "n", (F.col("w1") / F.col("s")).alias("gap"))


def gap_summary(found: DataFrame) -> DataFrame:
    """(bucket_id, n_examples, n_features, bng)."""
    return found.groupBy("bucket_id").agg(F.max("n").alias("n_examples"), F.count("*").alias("n_features"), F.avg("gap").alias("bng"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def coverage_summary(generated: DataFrame, bands: DataFrame, least: int, low: str = "q10", high: str = "q90") -> DataFrame:
    """(bucket_id, n_examples, n_features, hcr, mean_feature_inside_rate): rows with every feature inside the human band."""
    keys = ["bucket_id", "feature"]
    met = generated.join(bands.select(*keys, F.col(low).alias("low"), F.col(high).alias("high")), keys)
    inside = F.col("value").between(F.col("low"), F.col("high"))
    rows = met.groupBy("id", "bucket_id").agg(F.bool_and(inside).cast("int").alias("inside"), F.avg(inside.cast("int")).alias("rate"), F.count("*").alias("k"))
    found = rows.groupBy("bucket_id").agg(F.count("*").alias("n_examples"), F.max("k").alias("n_features"), F.avg("inside").alias("hcr"), F.avg("rate").alias("mean_feature_inside_rate"))
    return found.where(F.col("n_examples") >= least)


def overall(table: DataFrame, value: str) -> DataFrame:
    """One row: the mean of buckets and the mean weighted by their rows."""
    return table.agg(F.avg(value).alias("overall_macro"), weighted_mean(value, "n_examples").alias("overall_weighted"))


def utility_rows(pairs: DataFrame) -> DataFrame:
    """Adds raw_em, qa_em and qa_f1 to rows of prediction, reference and their words p and r; row by row."""
    n, m = F.size("p"), F.size("r")
    return pairs.withColumns({"raw_em": (F.col("prediction") == F.col("reference")).cast("int"), "qa_em": (F.col("p") == F.col("r")).cast("int"), "qa_f1": M.f1_of_counts(T.common_words(F.col("p"), F.col("r")), n, m)})


def diversity(texts: DataFrame, most: int = 3) -> DataFrame:
    """(side, bucket_id, n, total, unique_grams, distinct_n) of the word arrays of each side and bucket, and of the side as a whole.

    Grams are 64-bit hashes; what is distinct is counted in sorted blocks (``distinct.py``).
    """
    found = distinct.counts(texts.select("side", "bucket_id", T.word_hashes(F.col("words")).alias("h")), most)
    named = found.where("side is not null and (whole or bucket_id is not null)")
    share = F.round(T.safe_div(F.col("unique_grams"), F.col("total")), 6).alias("distinct_n")
    return named.select("side", F.when(F.col("whole"), "all").otherwise(F.col("bucket_id")).alias("bucket_id"), "n", "total", "unique_grams", share)


def merge_buckets(utility: DataFrame, *tables: DataFrame) -> DataFrame:
    """Bucket tables joined to the utility one; what a bucket lacks is null."""
    merged = utility
    for t in tables:
        merged = merged.join(t, "bucket_id", "left")
    return merged


def clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def on_fixed_scale(name: str) -> Column:
    """A metric on [0, 1]: gaps as 1 / (1 + gap), others clipped."""
    score = 1.0 / (1.0 + F.greatest(F.col(name), F.lit(0.0))) if name == "bng" else clipped(F.col(name))
    return F.when(F.col(name).isNotNull(), score)


def frontier_summary(table: DataFrame, utility: str, metrics: list[str]) -> DataFrame:
    """(n_points, auc, hypervolume) of buckets by utility and the geometric mean of the metrics; a bucket that lacks one is out."""
    scores = [on_fixed_scale(m) for m in metrics]
    whole = F.when(sum((s.isNull().cast("int") for s in scores), F.lit(0)) == 0, M.bounded_geometric_mean(F.array(*scores)))
    points = table.select("bucket_id", clipped(F.col(utility)).alias("u"), whole.alias("n"))
    return M.frontier_scores(M.frontier(points))


def aggregate_score(components: dict[str, Column]) -> Column:
    """Geometric mean of the components there are, on [0, 1]; null for fewer than two."""
    values = F.filter(F.array(*[c.cast("double") for c in components.values()]), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(values) >= 2, M.bounded_geometric_mean(values))


def weight_summary(rows: DataFrame, weight: str, skipped: Column) -> DataFrame:
    return rows.agg(F.count_if(~skipped).alias("n"), F.count_if(skipped).alias("n_skipped"), *[F.round(f(F.when(~skipped, F.col(weight))), 8).alias(f"{weight}_{name}") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def mean_losses(steps: DataFrame, key: str, losses: list[str]) -> DataFrame:
    """Mean of each loss over the steps of an epoch, and their number."""
    return steps.groupBy(key).agg(*[F.round(F.avg(c), 8).alias(c) for c in losses], F.count("*").alias("steps"))


def robust_range(values: DataFrame, column: str, low: float = 0.005, high: float = 0.992) -> tuple[float, float]:
    """Interpolated percentiles, the lower one at least 0; one apart if they meet."""
    lo, hi = values.agg(F.percentile(column, F.lit(low)), F.percentile(column, F.lit(high))).first()
    if lo is None:
        return 0.0, 1.0
    lo = max(0.0, lo)
    return (lo, hi) if hi > lo else (lo, lo + 1.0)


def smoothed_density(values: DataFrame, group: str, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, density): a histogram over [low, high], what is outside put to its ends, smoothed by a
    Gaussian of 19 points over 2.5 deviations.  A few hundred counts a group are joined with themselves."""
    width = (high - low) / bins
    at = F.least(F.floor((F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high)) - low) / width), F.lit(bins - 1)).cast("int")
    counts = values.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(group, at.alias("b")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(group))
    heights = counts.withColumn("h", F.col("c") / (total * width))
    kernel = F.transform(F.sequence(F.lit(-9), F.lit(9)), lambda k: F.struct(k.alias("k"), F.exp(-0.5 * (k * (2.5 / 9)) * (k * (2.5 / 9))).alias("w")))
    spread = heights.select(group, "b", "h", F.explode(kernel).alias("k")).select(group, (F.col("b") + F.col("k.k")).alias("bin"), (F.col("h") * F.col("k.w")).alias("part")).where(F.col("bin").between(0, bins - 1))
    weight = F.aggregate(kernel, F.lit(0.0), lambda a, k: a + k["w"])
    return spread.groupBy(group, "bin").agg(F.round(F.sum("part") / F.first(weight), 6).alias("density"))


def principal_plane(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, x, y): centred vectors on their two main axes, each turned so that its largest loading is positive.

    Sums of products are taken beside the rows; the driver holds one matrix of the
    vectors' width squared.
    """
    import numpy as np
    import pandas as pd

    from collections.abc import Iterator

    width = rows.select(F.size(vector)).first()[0]

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((width + 1, width)), 0
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()).astype(float)
            total[:width] += x.T @ x
            total[width] += x.sum(0)
            count += len(x)
        yield pd.DataFrame({"n": [count], "s": [total.ravel().tolist()]})

    parts = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(products, "n long, s array<double>")
    sums = parts.select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    total = np.zeros((width + 1) * width)
    for r in sums:
        total[r["i"]] = r["x"]
    n, total = sums[0]["n"], total.reshape(width + 1, width)
    mean = total[width] / n
    _, axes = np.linalg.eigh(total[:width] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(0), range(2)])
    dot = lambda k: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda x, a: x * a), F.lit(-float(mean @ axes[:, k])), lambda s, v: s + v)
    return rows.select(ident, dot(0).alias("x"), dot(1).alias("y"))
