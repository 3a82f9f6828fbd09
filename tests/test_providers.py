"""The feature set, prompts and model interfaces, with fakes in place of models."""

import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions import featureset as S
from tessera.functions import prompts as P
from tessera.operators import providers as V

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not know this file


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(c.alias("y")).first().y


def test_feature_rows(spark):
    texts = [("1", "d", "train", "One two two. Three?\n\nIt's 1999 -- WOW!"), ("2", "d", "train", None)]
    rows = {r.id: r for r in S.feature_rows(spark.createDataFrame(texts, "id string, dataset string, split string, human_answer string"), with_text=True).collect()}
    f = rows["1"].features
    assert len(f) == len(rows["2"].features) == 134 and rows["1"].field_name == "human_answer" and rows["2"].text == ""
    assert (f["paragraph_count"], f["unique_word_count"], f["max_token_frequency"], f["sentence_count"], f["all_caps_token_count"]) == (2, 6, 2, 3, 1)
    assert f["hapax_ratio"] == round(5 / 7, 6) and f["pos_x_ratio"] == 1.0 and f["pos_x_count"] == f["token_count"] and f["stopword_count"] == f["vader_compound"] == 0
    assert f["shannon_entropy"] == round(-(5 / 7 * math.log2(1 / 7) + 2 / 7 * math.log2(2 / 7)), 6)
    assert all(v == 0 for v in rows["2"].features.values())


def test_masks(spark):
    text = " ".join(f"w{i}" for i in range(40))
    made = one(spark, P.masked(F.col("t"), F.col("k")), t=text, k=3)
    n = made.count("<extra_id_")
    assert n == 6 and len(made.split()) == 40 - n and one(spark, P.masked(F.col("t"), F.col("k")), t="only six words here, no more", k=3) == "only six words here, no more"
    gone = [w for w in text.split() if w not in made.split()]
    decoded = " ".join(f"<extra_id_{i}> {gone[2 * i]} {gone[2 * i + 1]}" for i in range(n)) + f" <extra_id_{n}>"
    assert one(spark, P.filled(F.lit(made), P.fills(F.col("d"), n)), d=decoded) == text
    assert one(spark, P.fills(F.col("d"), 2), d="<extra_id_0> x") is None


def test_prompts(spark):
    none = F.array().cast("array<struct<role:string,text:string>>")
    zh = one(spark, P.task_prompt(P.prompt_language(F.lit(""), F.lit("zh-cn|a")), F.lit("?"), F.lit("short"), F.lit("问"), F.lit(""), none, "extra"))
    assert zh.startswith("任务要求：\n\n- ") and "extra\n\n问题：\n问" in zh and P.LOCALES["zh"]["any_style"] in zh
    assert one(spark, P.task_prompt(F.lit("en"), F.lit(""), F.lit(""), F.lit(" "), F.lit(""), none)) is None
    assert [one(spark, P.most_tokens(F.lit(b), 600)) for b in ("short", "XLong ", "odd")] == [256, 600, 600] and one(spark, P.most_tokens(F.lit("short"), 600, False)) == 600
    with pytest.raises(ValueError):
        P.most_tokens(F.lit("short"), 0)
    rubric = P.Rubric.load('{"score_min": 1, "score_max": 5, "dimensions": [{"id": "a", "definition": "A."}, {"id": "b"}], "composites": {"c": {"a": 0.75, "b": 0.25}}}')
    assert one(spark, rubric.composite(F.create_map(F.lit("a"), F.lit(5)), "c")) == 100.0 and one(spark, rubric.composite(F.create_map(F.lit("z"), F.lit(5)), "c")) == 0.0
    assert rubric.json_schema()["properties"]["scores"]["required"] == ["a", "b"]
    asked = one(spark, P.judge_prompt(rubric, ["m"], none, F.lit(""), F.lit("do"), F.lit("ref"), F.lit("can")), m="x")
    assert "- a: A." in asked and "<candidate>\ncan\n</candidate>" in asked and "<history>\n[none]" in asked and '{"m":"x"}' in asked
    assert one(spark, P.file_slug(F.lit(" A/b: c--d_ "))) == "a_b_c_d" and one(spark, P.web_slug(F.lit("/A b!.c_"))) == "a-b-.c_"


def _client():
    def run(frame):
        if frame["prompt"].str.contains("boom").any():
            raise RuntimeError("boom")
        return frame.assign(output="Answer: " + frame["prompt"] + "\nUser: x", finish_reason="stop")

    return run


def _scorer():
    return lambda prefixes, texts: [[-1.0 if p else -2.0] * len(t.split()) for p, t in zip(prefixes, texts, strict=True)]


def _detector():
    return lambda frame: frame.assign(output=[float("nan") if t == "n" else float(len(t)) for t in frame["text"]])


def _vectors():
    return lambda texts: [[float(len(t)), 0.0] for t in texts]


def _likeness():
    return lambda a, b: float(len(set(a) & set(b))) / len(a)


def _critic():
    return lambda frame, side: frame[side].str.len() / 7


def test_model_interfaces(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["p", "boom", "q"])], "source_index long, t string").coalesce(1)
    got = {r.source_index: r for r in V.infer(rows, F.col("t"), _client, "dist_sft").collect()}
    assert got[0].prediction == "p" and got[2].finish_reason == "stop" and got[1].prediction == "" and "boom" in got[1].error
    scored = V.score_texts(spark.createDataFrame([(1, "ctx", "a b"), (2, "", "a b c")], "id long, p string, t string"), _scorer, "p", "t").orderBy("id").collect()
    assert (scored[0].logprob_gain, scored[0].perplexity_ratio, scored[1].logprob_gain, scored[1].given) == (2.0, round(math.e, 6), 0.0, None)
    found = {r.source_index: r for r in V.detect(rows.withColumnRenamed("t", "text"), _detector, "perplexity_ratio", 2.0).collect()}
    assert (found[0].score_ai, found[0].predicted_ai, found[1].predicted_ai) == (-1.0, True, False)
    vectors = V.embed(spark.createDataFrame([("abc",), ("abc",), ("",)], "text string"), _vectors)
    assert sorted(map(tuple, (r.embedding for r in vectors.collect()))) == [(0.0, 0.0), (1.0, 0.0)] and V.embed(spark.createDataFrame([("abc",)], "text string"), _vectors, cache=vectors).count() == 2
    texts = spark.createDataFrame([("b", i, f"t{i}", f"t{i % 10}") for i in range(20)] + [("s", 1, "x", "x")], "bucket_id string, id long, human string, generated string")
    likeness = {r.bucket_id: r.c_mauve for r in V.mauve(texts, _likeness).collect()}
    assert likeness == {"b": 0.5, "s": None} and V.mauve(texts, None).where("c_mauve is null").count() == 2
    pair = V.score_pairs(spark.createDataFrame([("abc", "a")], "chosen string, rejected string"), _critic).first()
    assert (pair.chosen_dist_score, pair.rejected_dist_score) == (round(3 / 7, 8), round(1 / 7, 8))
    data = spark.createDataFrame([(f"b{i % 2}", float(i), i * 2.0 + i % 2) for i in range(30)], "bucket_id string, x double, target_score double")
    fitted = V.fit_critic(data, ["x"]).transform(data)
    assert fitted.where(F.abs(F.col("prediction") - F.col("target_score")) > 0.1).count() == 0
