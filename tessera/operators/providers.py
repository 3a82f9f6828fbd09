"""Models behind one interface: texts go out in batches, results come back as rows.

A provider is a picklable function that builds, on a worker, a client; a client maps a
pandas frame to one with ``output`` (and whatever more it returns).  Failing batches
are halved until single rows fail, which get their error (``metrics.in_batches``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import generation as G
from tessera.operators import metrics as M

Client = Callable[[pd.DataFrame], pd.DataFrame]


def call(rows: DataFrame, build: Callable[[], Client], schema: str) -> DataFrame:
    """``rows`` through a client; ``schema`` names the columns that come back, output and error among them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from M.in_batches(build(), schema)(frames)

    return rows.mapInPandas(run, schema)


def score_texts(rows: DataFrame, build: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], prefix: str, text: str) -> DataFrame:
    """Log-probabilities of each text alone and after its prefix, summarised, and what the prefix gains.

    The scorer maps (prefixes, texts) to a list of log-probabilities a text.
    """
    kept = rows.columns
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("alone", ArrayType(DoubleType())), StructField("given", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = build()
        for frame in frames:
            texts, prefixes = frame[text].fillna("").tolist(), frame[prefix].fillna("").tolist()
            given = scorer(prefixes, texts)
            yield frame.assign(alone=scorer([""] * len(texts), texts), given=[g if p else None for g, p in zip(given, prefixes, strict=True)])

    scored = rows.mapInPandas(run, schema)
    summary = lambda c: G.lm_summary(F.col(c), F.size(c))
    scored = scored.withColumns({"alone": summary("alone"), "given": F.when(F.col("given").isNotNull(), summary("given"))})
    gain = F.col("given.logprob_sum") - F.col("alone.logprob_sum")
    ratio = F.try_divide(F.col("alone.perplexity"), F.col("given.perplexity"))
    return scored.select(*kept, "alone", "given", F.round(F.coalesce(gain, F.lit(0.0)), 6).alias("logprob_gain"), F.round(F.coalesce(ratio, F.lit(0.0)), 6).alias("perplexity_ratio"))


def infer(rows: DataFrame, prompt: Column, build: Callable[[], Client], dialect: str, key: str = "source_index") -> DataFrame:
    """Prompts rendered, a model called, its replies cleaned: (key, prompt, raw_prediction, prediction, finish_reason, error)."""
    asked = rows.select(key, prompt.alias("prompt"))
    kind = dict(asked.dtypes)[key]
    found = call(asked, build, f"{key} {kind}, prompt string, output string, finish_reason string, error string")
    raw = F.coalesce("output", F.lit(""))
    return found.select(key, "prompt", raw.alias("raw_prediction"), G.clean_reply(raw, dialect).alias("prediction"), "finish_reason", "error")


#: Detectors by what their raw score says: whether a low one means machine, and the threshold.
LOW_IS_MACHINE = {"perplexity_ratio": True, "classifier": False, "curvature": False, "perturbation": False}


def detect(rows: DataFrame, build: Callable[[], Client], detector: str, threshold: float) -> DataFrame:
    """(key columns, raw_score, score_ai, predicted_ai, error): scores turned so that a high one means machine.

    No score, or one that is no number, predicts nothing.
    """
    schema = ", ".join(f"{f} {t}" for f, t in rows.dtypes) + ", output double, error string"
    found = call(rows, build, schema)
    raw = F.when(~F.isnan("output"), F.col("output"))
    ai = -raw if LOW_IS_MACHINE[detector] else raw
    flag = (raw < threshold) if LOW_IS_MACHINE[detector] else (raw >= threshold)
    kept = [c for c in rows.columns if c != "text"]
    return found.select(*kept, F.lit(detector).alias("detector"), raw.alias("raw_score"), ai.alias("score_ai"), flag.alias("predicted_ai"), "error", F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha1"))


def embed(rows: DataFrame, build: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", cache: DataFrame | None = None) -> DataFrame:
    """(text_sha1, embedding) of the distinct texts, unit length; those that ``cache`` holds are not asked for again."""
    asked = rows.select(F.sha1(F.coalesce(text, F.lit(""))).alias("text_sha1"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["text_sha1"])
    if cache is not None:
        asked = asked.join(cache.select("text_sha1"), "text_sha1", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for frame in frames:
            yield pd.DataFrame({"text_sha1": frame["text_sha1"], "embedding": [list(map(float, v)) for v in model(frame["text"].tolist())]})

    raw = asked.mapInPandas(run, "text_sha1 string, embedding array<double>")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    made = raw.withColumn("n", norm).select("text_sha1", F.when(F.col("n") > 0, F.transform("embedding", lambda x: x / F.col("n"))).otherwise(F.col("embedding")).alias("embedding"))
    return made if cache is None else made.unionByName(cache.select("text_sha1", "embedding"))


def mauve(texts: DataFrame, build: Callable[[], Callable[[list[str], list[str]], float]] | None, most: int = 1_000, least: int = 20) -> DataFrame:
    """(bucket_id, n, c_mauve) of (bucket_id, id, human, generated): a model's likeness of two samples of at most
    ``most`` texts; null for small buckets, and everywhere without a model."""
    sizes = texts.groupBy("bucket_id").agg(F.count("*").alias("n"))
    if build is None:
        return sizes.withColumn("c_mauve", F.lit(None).cast("double"))
    from tessera.operators.indexing import choice

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        value = build()(frame["human"].tolist(), frame["generated"].tolist()) if len(frame) >= least else None
        return pd.DataFrame({"bucket_id": [frame["bucket_id"].iloc[0]], "c_mauve": [value]})

    return sizes.join(choice(texts, "bucket_id", "id", most).groupBy("bucket_id").applyInPandas(run, "bucket_id string, c_mauve double"), "bucket_id", "left")


def score_pairs(pairs: DataFrame, build: Callable[[], Callable[[pd.DataFrame, str], list[float]]]) -> DataFrame:
    """``pairs`` with a critic's scores of the chosen and the rejected text, eight decimals."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*pairs.schema.fields, StructField("chosen_dist_score", DoubleType()), StructField("rejected_dist_score", DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        critic = build()
        for frame in frames:
            yield frame.assign(**{f"{side}_dist_score": [round(float(x), 8) for x in critic(frame, side)] for side in ("chosen", "rejected")})

    return pairs.mapInPandas(run, schema)


def fit_critic(features: DataFrame, names: list[str], target: str = "target_score", bucket: str = "bucket_id"):
    """A linear critic of features and bucket, fitted by the cluster: a pipeline model that adds ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [
        StringIndexer(inputCol=bucket, outputCol="_bucket", handleInvalid="keep"), OneHotEncoder(inputCols=["_bucket"], outputCols=["_which"]),
        VectorAssembler(inputCols=["_which", *names], outputCol="_features", handleInvalid="keep"), LinearRegression(featuresCol="_features", labelCol=target, regParam=1e-4),
    ]
    return Pipeline(stages=stages).fit(features)
