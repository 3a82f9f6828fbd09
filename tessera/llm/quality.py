"""Quality rules: base text rules plus a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are counted: one of trusted
target documents (labelled good and not toxic) and one of the whole raw corpus.
A document's score is the mean over its n-grams of log p_target - log p_raw, so
it does not depend on length.  The target is smoothed by a fixed share of the raw
shape, so its pull does not fade or grow with the size of the sample, and the
threshold comes from the scores of the trusted documents themselves, each held out
of the target: a low quantile less a part of its distance from the median.

The target side is fitted on at most ``max_trusted`` labelled documents, those
with the smallest hash of their id; the raw side counts every document.  Only
``2 ** bits`` sums and a quantile reach the driver, whatever the input.

Defined cases: a null text is empty; a text of fewer than ``min_words`` words or
with over half its words inside repeated 3-word windows fails the base rules; no
trusted document at all gives score 0 for every text, and with fewer than
``least_trusted`` that pass the base rules there is no threshold, so only the base
rules decide; rows that repeat a doc_id are judged each for itself; a null doc_id is
kept as null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordhash import mix, word_codes

_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class QualityParams:
    bits: int = 16
    #: Bound of the labelled sample behind the target multinomial.
    max_trusted: int = 20_000
    #: Prior of the target, shaped like the raw corpus: a multiple of the target's own counts.
    prior: float = 0.25
    #: The threshold: this quantile of held-out trusted scores, less ``margin`` times its distance from the median.
    quantile: float = 0.01
    margin: float = 0.25
    #: Trusted documents, at least, for a threshold.
    least_trusted: int = 20
    min_words: int = 50
    #: Percent of words in repeated 3-word windows above which it goes.
    max_repeat_pct: int = 50


def ngram_buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a word-code sequence."""
    shift = np.uint64(64 - bits)
    pairs = mix(codes[:-1] * _MULT + codes[1:])
    return np.concatenate([codes >> shift, pairs >> shift]).view(np.int64)


def repeated_words(codes: np.ndarray, width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key + codes[k : k + n]) * _MULT
        key ^= key >> np.uint64(29)
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    twice = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    covered = np.zeros(len(codes), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def _histograms(params: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << params.bits
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        n_held = 0

        def flush() -> None:
            for trusted, parts in held.items():
                if parts:
                    counts = np.bincount(np.concatenate(parts), minlength=size)
                    np.add(raw, counts, out=raw)
                    if trusted:
                        np.add(target, counts, out=target)
                parts.clear()

        for batch in batches:
            for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = word_codes(text)
                if len(codes):
                    held[trusted].append(ngram_buckets(codes, params.bits))
                    n_held += len(codes)
                    if n_held > 500_000:
                        flush()
                        n_held = 0
        flush()
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "n_raw", "n_target"])

    return run


def trusted_ids(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` ids of documents labelled good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _log_ratio(raw: np.ndarray, target: np.ndarray, total: float, prior: float, all_raw: float) -> np.ndarray:
    """log p_target - log p_raw of buckets, by their counts."""
    p_raw = np.maximum(raw, 0.5) / all_raw
    return np.log((target / total / p_raw + prior) / (1 + prior))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Model:
    """Weights of every bucket and the threshold; zeros and none without a trusted text."""
    trusted = F.broadcast(trusted_ids(labels, params.max_trusted)).withColumn("trusted", F.lit(True))
    rows = common.only(docs, "doc_id", "text").join(trusted, "doc_id", "left").select(common.utf8(), F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = rows.mapInArrow(_histograms(params), "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
    size = 1 << params.bits
    raw, target = np.zeros(size), np.zeros(size)
    for bucket, n_raw, n_target in sums.collect():
        raw[bucket], target[bucket] = n_raw, n_target
    if not target.sum():
        return Model(np.zeros(size), -np.inf)
    shared = docs.sparkSession.sparkContext.broadcast((raw, target))
    held_out = rows.where("trusted").mapInArrow(_held_out(shared, params), "score double")
    found = held_out.agg(F.count("score").alias("n"), F.percentile("score", F.lit(params.quantile)).alias("low"), F.percentile("score", F.lit(0.5)).alias("mid")).first()
    threshold = found.low - params.margin * (found.mid - found.low) if found.n >= params.least_trusted else -np.inf
    return Model(_log_ratio(raw, target, target.sum(), params.prior, raw.sum()), float(threshold))


def _held_out(shared, params: QualityParams):
    """Scores of trusted documents that pass the base rules, by the target without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = shared.value
        all_raw, total = raw.sum(), target.sum()
        for batch in batches:
            scores = []
            for text in batch.column(0).to_pylist():
                codes = word_codes(text)
                if _fails(len(codes), repeated_words(codes), params):
                    continue
                at, n = np.unique(ngram_buckets(codes, params.bits), return_counts=True)
                if total > n.sum():
                    scores.append(float((_log_ratio(raw[at], target[at] - n, total - n.sum(), params.prior, all_raw) * n).sum() / n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64())], names=["score"])

    return run


def _fails(n_words: int, repeat: int, params: QualityParams) -> bool:
    return n_words < params.min_words or 100 * repeat > params.max_repeat_pct * n_words


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def judge_text(text: bytes, n_chars: int, model: Model, params: QualityParams) -> tuple:
    codes = word_codes(text)
    n = len(codes)
    spaces = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeat = repeated_words(codes)
    llr = float(model.weights[ngram_buckets(codes, params.bits)].mean()) if n else 0.0
    failed = _fails(n, repeat, params)
    return n, n_chars - spaces, symbols, len(lines) - len(set(lines)), repeat, llr, failed, not failed and llr >= model.threshold


def _judge(shared, params: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        types = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
        names = [part.split()[0] for part in SCORED.split(", ")]
        for batch in batches:
            rows = [judge_text(t, n, model, params) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    return run


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One verdict row (``SCORED``) for each row of ``docs``."""
    shared = spark.sparkContext.broadcast(fit(docs, labels, params))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8(), F.length(common.text_or_empty()).cast("long").alias("n"))
    return rows.mapInArrow(_judge(shared, params), SCORED)


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns unchanged.

    The verdict is taken beside each row, so texts are never shuffled or joined.
    """
    shared = spark.sparkContext.broadcast(fit(docs, labels, params))
    at, names, schema = docs.columns.index("text"), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = [judge_text((t or "").encode(), 0, model, params)[-1] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(run, schema)
