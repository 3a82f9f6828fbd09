"""Metrics: frontier, detector, judge and sampling operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.operators.indexing import running_sums

# Judge dimensions, composites with their weights, score range.
DIMENSIONS = (
    "task_success", "factual_grounding", "instruction_following", "reference_alignment",
    "conditional_appropriateness", "response_shape_and_length", "discourse_naturalness", "safety",
)
COMPOSITES = {
    "overall": {
        "task_success": 0.20, "factual_grounding": 0.15, "instruction_following": 0.15, "reference_alignment": 0.10,
        "conditional_appropriateness": 0.17, "response_shape_and_length": 0.08, "discourse_naturalness": 0.10, "safety": 0.05,
    },
    "utility": {"task_success": 0.35, "factual_grounding": 0.25, "instruction_following": 0.20, "reference_alignment": 0.15, "safety": 0.05},
    "conditional_naturalness": {
        "conditional_appropriateness": 0.35, "response_shape_and_length": 0.20, "discourse_naturalness": 0.25, "reference_alignment": 0.15, "safety": 0.05,
    },
    "distribution_faithfulness": {
        "conditional_appropriateness": 0.30, "response_shape_and_length": 0.20, "discourse_naturalness": 0.20, "reference_alignment": 0.20, "factual_grounding": 0.10,
    },
}
STAGES = ("human", "baselm", "sft", "dpo", "dist_sft", "hdpo")
SCORES = (1, 5)


def frontier(points: DataFrame, x: str = "u", y: str = "n") -> DataFrame:
    """Points not dominated: x descending, y strictly rising.  Few rows: one a bucket."""
    before = Window.orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(y).over(before)
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_best", best).where(F.col("_best").isNull() | (F.col(y) > F.col("_best"))).drop("_best")


def frontier_scores(front: DataFrame, reference: float = 0.0) -> DataFrame:
    """(n_points, auc, hypervolume) of a frontier of columns u and n."""
    order = Window.orderBy("u")
    rows = front.withColumn("pu", F.lag("u").over(order)).withColumn("pn", F.lag("n").over(order))
    auc = F.sum((F.col("u") - F.col("pu")) * (F.col("n") + F.col("pn")) / 2)
    volume = F.sum((F.col("u") - F.coalesce("pu", F.lit(reference))) * (F.col("n") - reference))
    return rows.agg(F.count("*").alias("n_points"), F.round(auc, 6).alias("auc"), F.round(volume, 6).alias("hypervolume"))


def bounded_geometric_mean(values: Column) -> Column:
    """exp(mean(ln)) of an array clipped to [0, 1]; any 0 gives 0, nulls are left out."""
    clipped = F.transform(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    logs = F.aggregate(clipped, F.lit(0.0), lambda s, v: s + F.ln(v))
    return F.when(F.size(clipped) == 0, F.lit(None)).when(F.exists(clipped, lambda v: v == 0), 0.0).otherwise(F.exp(logs / F.size(clipped)))


def roc_points(scored: DataFrame) -> DataFrame:
    """(score, tp, fp): running counts from the highest score down, by distinct score."""
    counts = scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("f"))
    return running_sums(counts, "score", {"tp": "p", "fp": "f"}, descending=True).select("score", "p", "f", "tp", "fp")


def tpr_at(scored: DataFrame, limits: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """One row: the greatest true-positive rate among thresholds whose false-positive rate is within each limit."""
    points = roc_points(scored)
    whole = points.agg(F.max("tp").alias("np"), F.max("fp").alias("nf"))
    rated = points.crossJoin(F.broadcast(whole))  # one row
    best = lambda x: F.round(F.coalesce(F.max(F.when(F.col("fp") <= x * F.col("nf"), F.col("tp") / F.col("np"))), F.lit(0.0)), 6)
    return rated.agg(*[best(x).alias(f"tpr_at_fpr_{x:.2f}".replace(".", "_")) for x in limits])


def roc_auc(scored: DataFrame) -> DataFrame:
    """Tie-aware area: positives above, ties half."""
    points = roc_points(scored)
    whole = points.agg(F.sum("p").alias("np"), F.sum("f").alias("nf"), F.sum(F.col("f") * (F.col("tp") - F.col("p") / 2)).alias("area"))
    return whole.select(F.col("np").alias("positives"), F.col("nf").alias("negatives"), F.round(F.col("area") / (F.col("np") * F.col("nf")), 6).alias("auc"))


def judge_scores(raw: Column) -> Column:
    """Scores by dimension out of a judge's reply: a fenced or the outermost object."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    return F.from_json(body, "map<string,string>")


def judge_parsed(replies: DataFrame) -> DataFrame:
    """Adds a column for each dimension, ``valid`` and the composites (0 to 100)."""
    low, high = SCORES
    rows = replies.withColumn("_m", judge_scores(F.col("reply")))
    for d in DIMENSIONS:
        rows = rows.withColumn(d, F.try_element_at("_m", F.lit(d)).try_cast("int"))
    valid = F.lit(True)
    for d in DIMENSIONS:
        valid = valid & F.coalesce(F.col(d).between(low, high), F.lit(False))
    rows = rows.withColumn("valid", valid).drop("_m")
    for name, weights in COMPOSITES.items():
        value = sum((w * (F.col(d) - low) / (high - low) * 100 for d, w in weights.items()), F.lit(0.0))
        rows = rows.withColumn(name, F.when(F.col("valid"), F.round(value / sum(weights.values()), 4)))
    return rows


def water_fill(capacities: dict[str, int], total: int) -> dict[str, int]:
    """Equal shares up to each capacity; what remains is shared anew, and the last
    few go to the first names in order."""
    given = dict.fromkeys(capacities, 0)
    left = min(total, sum(capacities.values()))
    while left:
        open_ = sorted(k for k in capacities if given[k] < capacities[k])
        each = left // len(open_)
        if not each:
            for k in open_[:left]:
                given[k] += 1
            break
        for k in open_:
            more = min(each, capacities[k] - given[k])
            given[k] += more
            left -= more
    return given


def balanced_sample(rows: DataFrame, key: str, ident: str, total: int, order: Column) -> DataFrame:
    """``total`` rows shared evenly over the keys, first by ``order`` within a key.

    Keys are buckets: a product of a few small domains, so their counts are few.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    given = water_fill(counts, total)
    quota = rows.sparkSession.createDataFrame(sorted(given.items()) or [("", 0)], f"{key} string, quota long")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, ident))
    # with a bound in sight the rank filter prunes before the shuffle
    ranked = rows.withColumn("_r", rank).where(F.col("_r") <= max(given.values(), default=0))
    return ranked.join(F.broadcast(quota), key).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def f1_of_counts(common: Column, n: Column, m: Column) -> Column:
    """F1 of a common count and two sizes; both empty 1, one empty 0."""
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * common / (n + m))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole table row in one integer."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        hit = free & at.get(w, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


@F.pandas_udf(LongType())
def lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def bleu4_each(texts: list[list[str]], others: int) -> list[float]:
    """Sentence BLEU-4 of each text against the ``others`` texts after it, in a ring.

    Zero counts become 0.1.  Postings of n-grams spare a pass over every reference.
    """
    from collections import Counter, defaultdict

    size = len(texts)
    span = min(others, size - 1)
    hits = [[0] * 4 for _ in texts]
    for n in range(1, 5):
        counts = [Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in texts]
        postings = defaultdict(list)
        for j, c in enumerate(counts):
            for gram, k in c.items():
                postings[gram].append((j, k))
        for i, c in enumerate(counts):
            hits[i][n - 1] = sum(min(k, max((x for j, x in postings[gram] if 0 < (j - i) % size <= span), default=0)) for gram, k in c.items())
    scores = []
    for i, t in enumerate(texts):
        if not t:
            scores.append(0.0)
            continue
        logs = sum(math.log((hits[i][n - 1] or 0.1) / max(1, len(t) - n + 1)) / 4 for n in range(1, 5))
        near = min((abs(m - len(t)), m) for m in (len(texts[(i + s) % size]) for s in range(1, span + 1)))[1]
        scores.append((1.0 if len(t) > near else math.exp(1 - near / len(t))) * math.exp(logs))
    return scores


def self_bleu(rows: DataFrame, sample: int = 500, others: int = 100) -> DataFrame:
    """(bucket_id, n, self_bleu): of at most ``sample`` hash-first texts a bucket, each
    against up to ``others`` of the rest; null for a bucket of one text."""
    rank = F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.md5(F.col("id").cast("string")), "id"))
    chosen = rows.withColumn("_r", rank).where(F.col("_r") <= sample)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [list(w) for w in frame.sort_values("_r")["words"]]
        scores = bleu4_each(texts, others) if len(texts) > 1 else []
        return pd.DataFrame({"bucket_id": [frame["bucket_id"].iloc[0]], "n": [len(texts)], "self_bleu": [sum(scores) / len(scores) if scores else None]})

    return chosen.groupBy("bucket_id").applyInPandas(run, "bucket_id string, n long, self_bleu double")


def in_batches(client, schema: str):
    """``mapInPandas`` function of a provider: client(frame) -> frame, batch by batch.

    A batch that fails is halved until single rows fail; those get their error.
    """

    def attempt(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return client(frame)
        except Exception as e:
            if len(frame) == 1:
                return frame.assign(output=None, error=f"{type(e).__name__}: {e}")
            half = len(frame) // 2
            return pd.concat([attempt(frame.iloc[:half]), attempt(frame.iloc[half:])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            done = attempt(frame)
            if "error" not in done:
                done = done.assign(error=None)
            yield done[names]

    return run
