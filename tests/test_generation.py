"""Cleaning, prompts and score summaries against plain Python."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions import generation as G

PIECES = ["Answer:", "Assistant: ", "\nUser: x", "\nQuestion: y", "```", "```py\n", "\n", "\n\n\n", " ", "> ", "\n> ", "yes.", "yes. ", "no", "# t", "\n#", "Output", "<|im_end|>", "助手：", "\nTask:", "`", '"q"', "The answer should", "Explanation: e", "\r\n", "推理：", "Final answer: 7", "\nfinal ANSWER ： ok"]


def made(n=400):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)] + ["", "Answer: a\nAssistant: b"]


def expected(text, kind):
    """The documented steps, one at a time, for one text."""
    d = G.DIALECTS[kind]
    t = text.strip().replace("\r\n", "\n").replace("\r", "\n")
    fence = lambda x: m.group(1).strip() if (m := re.search(r"```[a-zA-Z0-9_+-]*\n(.*?)```", x, re.S)) else x
    if d.unquote:
        t = t.replace("\n> ", "\n").replace("> ", "")
    t = fence(t) if d.fence == "early" else t
    for mark in d.after:
        t = t.split(mark, 1)[1].strip() if mark in t else t
    t = t[: min((i for c in d.cuts if (i := t.find(c)) >= 0), default=len(t))]
    for label in d.labels:
        t = t[len(label) :].strip() if t.startswith(label) else t
    t = fence(t) if d.fence == "late" else t
    rows = [x.strip() for x in t.splitlines()]
    if d.paragraphs:
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in rows if x not in d.bad_lines).strip())
    rows = [x for x in rows if x]
    good = [x for x in rows if not (d.bad_starts and x.startswith(d.bad_starts)) and x not in d.bad_lines]
    if d.first_line:
        return re.sub(r"^([\"'])(.*)\1$", r"\2", (good or rows or [""])[0].strip("`").strip()).strip()
    t = "\n".join(good).strip()
    if d.drop_repeats:
        kept = []
        for piece in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", t))):
            if not kept or kept[-1] != piece:
                kept.append(piece)
        t = " ".join(kept)
    return t


@pytest.mark.parametrize("kind", sorted(G.DIALECTS))
def test_clean(spark, kind):
    texts = made()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r.i: r.y for r in frame.select("i", G.clean_reply(F.col("x"), kind).alias("y")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, expected(t, kind)) for t in texts]
    assert spark.range(1).select(G.clean_reply(F.lit(None).cast("string"), kind)).first()[0] == ""


def test_final_answer(spark):
    cases = {"": "", "a\n b \n": "b", "x\nAnswer: 5 ": "5", "Answer: 1\nFinal answer：2\nz": "2\nz", "so\n答案: 好": "好", "no label answer: 3": "no label answer: 3"}
    frame = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    for r in frame.select("x", "want", G.final_answer(F.col("x")).alias("y")).collect():
        assert (r.x, r.y) == (r.x, r.want)


def test_prompts(spark):
    one = spark.createDataFrame([([["a", " "], ["b", "c"]], " k ", "q", [("user", "hi"), ("assistant", " yo "), ("user", "q")])], "p array<array<string>>, c string, q string, h array<struct<role:string,text:string>>")
    p, c, q, h = (F.col(x) for x in "pcqh")
    assert one.select(G.plain_prompt(p, c, q)).first()[0] == "Conversation History:\nUser: a\nUser: b\nAssistant: c\n\nContext:\nk\n\nQuestion:\nq\n\nAnswer:"
    none, empty = F.lit(None).cast("array<array<string>>"), F.lit("")
    assert one.select(G.plain_prompt(none, empty, F.lit(None).cast("string"))).first()[0] == "Answer:"
    assert one.select(G.condition_prefix(c, h, q)).first()[0] == "Context:\nk\n\nDialogue History:\nUser: hi\nAssistant: yo\n\nCurrent User Message:\nq\n\nAssistant Response:\n"
    assert one.select(G.condition_prefix(empty, F.slice(h, 1, 0), empty)).first()[0] == ""
    assert one.select(G.system_prompt(F.lit("qa"), empty, F.lit(None).cast("string"), F.lit("short"))).first()[0] == G.PROFILE_SYSTEM + "family=qa; length=short."
    assert one.select(G.system_prompt(empty, empty, empty, empty)).first()[0] == G.DEFAULT_SYSTEM
    assert one.select(G.slug(F.lit(" Ab-C//d: ")), G.pair_type(F.lit("Quality")), G.pair_type(F.lit("dist")), G.pair_type(F.lit("?"))).first()[:] == ("ab_c_d", "global", "distribution", "global")
    assert one.select(G.token_estimate(F.lit("中文 ab, c"), F.lit(1)), G.token_estimate(F.lit(None).cast("string"), F.lit(3))).first()[:] == (2 + 3 + 8, 0)
    assert one.select(G.is_token_limit_error(F.lit("Prompt Is Too Long")), G.is_token_limit_error(F.lit("timeout"))).first()[:] == (True, False)


def test_truncation(spark):
    one = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, a array<int>")
    cut = lambda n: one.select(G.truncate_left(F.col("p"), F.col("a"), n).alias("t")).first().t[:]
    assert cut(9) == ([1, 2, 3], [4, 5], 0, 0) and cut(3) == ([3], [4, 5], 2, 0) and cut(1) == ([], [5], 3, 1)


def test_scores(spark):
    values = [[-1.0, -2.5, -0.25], [-3.0], []]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    for r in frame.select("i", G.lm_summary(F.col("v"), F.lit(4)).alias("s")).collect():
        v = values[r.i]
        mean = -sum(v) / len(v) if v else 0.0
        want = (len(v), sum(v), -mean, -sum(v), mean, math.exp(mean) if v else 0.0, mean / math.log(2), statistics.pstdev(v) if len(v) > 1 else 0.0, -max(v, default=0), -min(v, default=0), len(v) / 4)
        assert list(r.s) == pytest.approx(list(want), abs=1e-6)
    z = frame.where("i = 0").select(G.perturbation_z(F.lit(1.0), F.col("v"))).first()[0]
    assert z == pytest.approx((1 + 1.25) / statistics.stdev(values[0]))
    assert frame.where("i = 1").select(G.perturbation_z(F.lit(1.0), F.col("v"))).first()[0] == 4.0
    normal = statistics.NormalDist
    for x in (-2.0, 0.5, 4.0):
        a, b = normal(0.1603, 1.0791).pdf(x), normal(2.4686, 2.1582).pdf(x)
        assert spark.range(1).select(G.machine_probability(F.lit(x))).first()[0] == pytest.approx(b / (a + b))
