"""Every catalogue query against its SQL, and operators against plain Python."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import buckets as B
from tessera.operators import metrics as M
from tessera.operators import records as R
from tessera.plans import catalogue

TABLES = "documents labels conversations benchmark embeddings pages events orders lineitem".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(None if pd.isna(x) else float(x) if isinstance(x, float) else x for x in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert catalogue.entry(spark, sf).count() > 0


def test_normalisers_and_tokens(spark):
    def one(c, x):
        return spark.createDataFrame([(x,)], "x string").select(c.alias("y")).first().y

    x = F.col("x")
    assert one(T.normalize_text(x), " a 　b \r\n\r\r\n\n c\t") == "a b\n\nc"
    assert one(T.normalize_lines(x), "a\n\n\n\nb") == "a\n\n\n\nb"
    assert one(T.normalize_for_compare(x), " a\r\n b ") == "a b" and one(T.normalize_text(x), None) == ""
    assert one(T.tokens(x), "don't été 12中文!") == ["don't", "t", "12", "中", "文", "!"]
    assert one(T.answer_words(x), "The cat, an a; CAT!") == ["cat", "cat"]
    assert [one(T.length_bin(F.lit(n)), "") for n in (40, 41, 120, 121, 240, 241)] == ["short", "medium", "medium", "long", "long", "xlong"]


def test_rouge_and_overlap(spark):
    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    import random
    from collections import Counter

    rng = random.Random(1)
    made = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    frame = spark.createDataFrame([(list(a), list(b)) for a, b in made], "a array<string>, b array<string>")
    for r in frame.select("a", "b", T.lcs_length(F.col("a"), F.col("b")).alias("l"), T.overlap(F.col("a"), F.col("b")).alias("o")).collect():
        assert r.l == lcs(r.a, r.b) == M.lcs(r.a, r.b) and r.o == sum((Counter(r.a) & Counter(r.b)).values())


def test_self_bleu(spark):
    import math
    import random
    from collections import Counter

    def bleu(text, references):
        if not text:
            return 0.0
        total = 0.0
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: B023, E731
            best = Counter()
            for r in references:
                best |= grams(r)
            mine = grams(text)
            total += math.log((sum(min(k, best[g]) for g, k in mine.items()) or 0.1) / max(1, sum(mine.values()))) / 4
        near = min((abs(len(r) - len(text)), len(r)) for r in references)[1]
        return math.exp(total) * (1 if len(text) > near else math.exp(1 - near / len(text)))

    rng = random.Random(5)
    texts = [[rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(15)]
    for others in (3, 99):
        want = [bleu(t, [texts[(i + s) % 15] for s in range(1, min(others, 14) + 1)]) for i, t in enumerate(texts)]
        assert M.bleu4_each(texts, others) == pytest.approx(want)
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)] + [(99, "one", ["a"])], "id long, bucket_id string, words array<string>")
    got = {r.bucket_id: r for r in M.self_bleu(rows).collect()}
    assert got["b"].n == 15 and got["b"].self_bleu == pytest.approx(sum(M.bleu4_each(texts, 99)) / 15) and got["one"].self_bleu is None


def test_word_overlap(spark):
    from collections import Counter

    made = [(1, ["a", "b", "a"], ["a", "a", "a"]), (2, [], []), (3, ["x"], []), (4, ["q", "r"], ["r", "q"])]
    got = {r.id: r.common for r in spark.createDataFrame(made, "id long, p array<string>, r array<string>").select("id", T.common_words(F.col("p"), F.col("r")).alias("common")).collect()}
    assert got == {i: sum((Counter(p) & Counter(r)).values()) for i, p, r in made}


def test_principal_plane(spark, sf):
    import numpy as np

    from tessera.operators import reports as E

    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    _, _, vh = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = {r.vec_id: (r.x, r.y) for r in E.principal_plane(frame, "vec_id", "embedding").collect()}
    plane = (x - x.mean(0)) @ vh[:2].T
    mine = np.array([got[r.vec_id] for r in rows])
    for k in range(2):
        assert np.allclose(mine[:, k], plane[:, k], atol=1e-4) or np.allclose(mine[:, k], -plane[:, k], atol=1e-4)


def test_running_sums(spark):
    from tessera.operators import indexing as I

    rows = spark.createDataFrame([(k, k * k) for k in (5, 3, 9, 1, 7, 2)], "k long, v long").repartition(3)
    assert [(r.k, r.s) for r in I.running_sums(rows, "k", {"s": "v"}).orderBy("k").collect()] == [(1, 1), (2, 5), (3, 14), (5, 39), (7, 88), (9, 169)]
    assert [(r.k, r.s) for r in I.running_sums(rows, "k", {"s": "v"}, descending=True).orderBy("k").collect()] == [(1, 169), (2, 168), (3, 164), (5, 155), (7, 130), (9, 81)]
    assert M.roc_points(spark.createDataFrame([], "score double, positive boolean")).count() == 0


def test_history_pairs(spark):
    turns = [("assistant", "lost"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("system", "s"), ("user", ""), ("user", "q")]
    frame = spark.createDataFrame([(turns, "q"), (turns, "other"), ([], "q")], "h array<struct<role:string,text:string>>, q string")
    got = [r.p for r in frame.select(R.history_pairs(F.col("h"), F.col("q")).alias("p")).collect()]
    assert got == [[["b", "c"]], [["b", "c"]], []]


def test_nearest_rank(spark):
    for n in (1, 6, 16, 21):
        frame = spark.createDataFrame([("k", float(i * i)) for i in range(n)], "k string, value double")
        r = B.nearest_rank(frame, ["k"]).first()
        for p in B.QUANTILES:
            assert r[f"q{round(p * 100)}"] == float(round((n - 1) * p) ** 2)


def test_water_fill():
    assert M.water_fill({"a": 5, "b": 1, "c": 9}, 10) == {"a": 5, "b": 1, "c": 4}
    assert M.water_fill({"a": 2, "b": 2}, 99) == {"a": 2, "b": 2} and M.water_fill({}, 3) == {}


def test_judge_replies(spark):
    scores = dict.fromkeys(M.DIMENSIONS, 3) | {"task_success": 5, "factual_grounding": "4", "safety": 1}
    good = json.dumps(scores)
    replies = [good, f"x ```json\n{good}\n``` y", "none", good.replace("5", "6"), '{"safety": 3}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = {r.i: r for r in M.judge_parsed(frame).collect()}
    assert [got[i].valid for i in range(5)] == [True, True, False, False, False]
    assert got[0].utility == round(0.35 * 100 + 0.25 * 75 + 0.35 * 50, 4) and got[2].utility is None


def test_provider_isolates_a_bad_row(spark):
    def client(frame):
        if (frame["x"] == 3).any():
            raise ValueError("bad")
        return frame.assign(output=frame["x"].astype(str))

    got = spark.range(6).select(F.col("id").alias("x")).mapInPandas(M.in_batches(client, "x long, output string, error string"), "x long, output string, error string").collect()
    assert {r.x: r.output for r in got} == {i: None if i == 3 else str(i) for i in range(6)}
    assert [r.error for r in got if r.x == 3] == ["ValueError: bad"]
