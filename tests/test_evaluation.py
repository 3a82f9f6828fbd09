"""Evaluation operators against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import distinct, reports
from tessera.operators import evaluation as E


def test_tiers(spark):
    left = spark.createDataFrame([(0, "a", "p"), (1, "b", "p"), (2, "b", "p"), (3, "z", "p"), (4, "y", "q"), (5, "a", "p")], "index long, exact string, prompt string")
    right = spark.createDataFrame([(0, "a", "p"), (1, "x", "p"), (2, "c", "p"), (6, "b", "p"), (7, "b", "p")], "index long, exact string, prompt string")
    got = {r.l: (r.r, r.tier) for r in E.tiered_match(left, right).collect()}
    assert got == {0: (0, "position_exact"), 1: (6, "signature_exact"), 2: (7, "signature_exact"), 3: (1, "prompt_fallback"), 5: (2, "prompt_fallback"), 4: (None, "missing")}
    assert E.tiered_match(left.limit(0), right).count() == 0


def _w1(a, b):
    """Mean gap of equally long sorted samples."""
    return float(np.abs(np.sort(a) - np.sort(b)).mean())


def test_turn_dynamics(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("red green blue cat dog bird sun moon tree lake".split()) for _ in range(rng.randint(1, 9)))
    rows = [(i, "b", text(), text(), text()) for i in range(40)] + [(99, "small", "cat", "dog", "sun")]
    got = {r.bucket_id: r for r in E.turn_dynamics(spark.createDataFrame(rows, "id long, bucket_id string, question string, human string, generated string"), rank=4).collect()}
    assert set(got) == {"b"}
    texts = [[re.findall(r"\w+", t) for t in r[2:]] for r in rows]
    df = Counter(w for r in texts for t in r for w in set(t))
    vocabulary, n = sorted(df), 3 * len(rows)
    x = np.array([[[t.count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in vocabulary] for t in r] for r in texts])
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    basis = np.linalg.svd(x[:, 0], full_matrices=False)[2][:4].T
    keep = slice(0, 40)
    q, h, g = (x[keep, k] for k in range(3))
    ql, hl, gl = q @ basis, h @ basis, g @ basis
    cos = lambda a, b: (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    size = np.array([[len(t) for t in r] for r in texts])[keep].astype(float)
    like = lambda gen, hum: 1 / (1 + _w1(gen, hum) / hum.std())
    want = [like(size[:, 2] / size[:, 0], size[:, 1] / size[:, 0]), like((q * g).sum(1), (q * h).sum(1)), like(cos(ql, gl), cos(ql, hl))]
    cross = lambda a, b: (a - a.mean(0)).T @ (b - b.mean(0)) / len(a)
    want.append(1 / (1 + np.linalg.norm(cross(ql, gl) - cross(ql, hl)) / np.linalg.norm(cross(ql, hl))))
    r = got["b"]
    assert r.n_examples == 40
    assert [r.length_similarity, r.lexical_similarity, r.latent_similarity, r.transition_similarity] == pytest.approx(want, abs=1e-6)
    assert r.tdm == pytest.approx(sum(want) / 4, abs=1e-6)


def test_turn_dynamics_of_few(spark):
    schema = "id long, bucket_id string, question string, human string, generated string"
    two = [(1, "b", "red cat", "red dog", "red dog"), (2, "b", "sun sky", "moon", "moon")]
    row = E.turn_dynamics(spark.createDataFrame(two, schema), least=1).first()
    assert row.tdm == pytest.approx(1.0)
    same = [(i, "b", "a b", "b", None) for i in range(5)]
    assert 0 < E.turn_dynamics(spark.createDataFrame(same, schema), least=1).first().tdm < 1
    assert E.turn_dynamics(spark.createDataFrame([], schema)).count() == 0
    assert E.turn_dynamics(spark.createDataFrame([(1, "b", None, None, None)], schema), least=1).first().n_examples == 1


def test_naturalness_index(spark):
    rows = [("a", 0.1, 3.0, 0.2, None), ("b", 0.5, 1.0, 0.6, None), ("c", 0.9, 0.5, 0.9, None), ("d", None, 0.1, 0.9, None)]
    table = spark.createDataFrame(rows, "bucket_id string, u double, bng double, hcr double, other double")
    got = {r.bucket_id: r.naturalness_index for r in E.naturalness_index(table, "u", ["bng", "hcr", "other"]).collect()}
    assert got["a"] == 0.0 and got["c"] == 1.0 and 0 < got["b"] < 1 and got["d"] is None
    one = {r.bucket_id: r.naturalness_index for r in E.naturalness_index(table, "u", ["hcr"]).collect()}
    assert one["b"] == pytest.approx((0.6 - 0.2) / 0.7)
    assert E.naturalness_index(table.limit(0), "u", ["bng"]).count() == 0


def test_summaries(spark):
    scored = spark.createDataFrame([("s", 0.5, True), ("s", None, True), ("s", float("nan"), False), ("s", 0.25, False), ("t", None, None)], "source_id string, score_ai double, predicted_ai boolean")
    got = {r.source_id: r[1:] for r in E.detector_summary(scored).collect()}
    assert got == {"s": (2, 2, 1, 1, 0.5, 0.375), "t": (0, 1, 0, 0, None, None)}
    assert E.row_counts_agree(scored).first()[:] == (2, 1, 4, False)
    trend = spark.createDataFrame([("m", "sft", 2.0), ("m", "baselm", 1.0), ("m", "dpo", 1.5), ("k", "hdpo", 1.0), ("k", "other", 9.0)], "model_key string, stage string, v double")
    assert {r.model_key: r[1:] for r in E.stage_trend(trend, "v").collect()} == {"m": ("baselm,sft,dpo", "1.0,2.0,1.5", False), "k": ("hdpo", "1.0", True)}


def test_score_diagnostics(spark):
    schema = "chosen string, rejected string, chosen_score double, rejected_score double"
    row = E.score_diagnostics(spark.createDataFrame([("a", "b", 1.0, 0.0), ("a", "a", 1.0, 1.0), ("c", "d", 0.5, 0.5)], schema)).first()
    assert row[:] == (0.0, 1.0, 1.0, round(float(np.std([1, 0, 1, 1, 0.5, 0.5])), 6), 2, 2, 1, False, False)
    assert E.score_diagnostics(spark.createDataFrame([("a", str(i), 1.0, 1.0) for i in range(4)], schema)).first()[-2:] == (True, True)
    assert E.score_diagnostics(spark.createDataFrame([], schema)).first()[-2:] == (False, False)


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_diversity_in_blocks(spark, chunk):
    """Counts against brute force for any chunk; no gram is a row, so that what is shuffled is a few blocks."""
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "ä", "", "x y"]
    rows = [(rng.choice(["g", "h", None]), rng.choice(["p", "q", "all", None]), None if rng.random() < 0.1 else [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40]))]) for _ in range(60)]
    want = {}
    for side, bucket, words in rows:
        for n in (1, 2, 3):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
            for key in ((side, bucket, False, n), (side, None, True, n)) if grams else ():
                want.setdefault(key, []).extend(grams)
    texts = spark.createDataFrame(rows, "side string, bucket_id string, words array<string>").repartition(3)
    hashed = texts.select("side", "bucket_id", T.word_hashes(F.col("words")).alias("h"))
    got = {(r.side, r.bucket_id, r.whole, r.n): (r.total, r.unique_grams) for r in distinct.counts(hashed, 3, chunk).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    named = reports.diversity(texts)
    assert "Generate" not in named._jdf.queryExecution().executedPlan().toString()
    assert named.count() == sum(k[0] is not None and (k[2] or k[1] is not None) for k in want)
    assert reports.diversity(texts.limit(0)).count() == 0
