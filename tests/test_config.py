"""Whole records of raw datasets, settings and registries, and the command line over a corpus tree."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.operators import corpus as K
from tessera.sources import config, formatters, readers, sinks


def test_dataset_records(spark):
    raw = spark.createDataFrame([(f"do {i}", "", f"said {i}", "c") for i in range(200)], "instruction string, context string, response string, category string")
    rows = formatters.dataset_records("dolly", raw)
    assert ", ".join(f"{n} {t}" for n, t in rows.dtypes) == K.RECORD
    split = {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert set(split) == {"train", "dev", "test"} and split["train"] > 150
    one = rows.first()
    assert (one.track, one.style_bucket, one.bucket_id, json.loads(one.meta)["length_tokens"]) == ("single", "assistant_like", "en|single|assistant|short", 2)
    spans = spark.createDataFrame([("a", "c", "q", ([" ", "x"],)), ("b", "c", "q", ([],))], "id string, context string, question string, answers struct<text:array<string>>")
    got = formatters.dataset_records("cmrc2018", spans, "validation").collect()
    assert [(r.id, r.human_answer, r.split, r.language) for r in got] == [("a", "x", "dev", "zh")]
    story = spark.createDataFrame([("Once.", ["q1", "q2"], (["a1", "a2"],))], "story string, questions array<string>, answers struct<input_text:array<string>>")
    turns = formatters.dataset_records("coqa", story, "validation").orderBy("id").collect()
    assert [len(r.dialogue_history) for r in turns] == [0, 2] and turns[0].split == "test" and len({json.loads(r.meta)["conversation_id"] for r in turns}) == 1
    assert formatters.ENGLISH == ["dolly", "ms_marco", "coqa", "eli5_category", "squad_v2", "natural_questions", "dailydialog", "multiwoz"]
    with pytest.raises(KeyError, match="unknown dataset"):
        formatters.dataset_records("none", raw)


def test_registries(spark, tmp_path, monkeypatch):
    (tmp_path / "data" / "x").mkdir(parents=True)
    (tmp_path / "data" / "f.csv").write_text("id,Unnamed: 1,n\na,0,2.5\n")
    assert config.companion(str(tmp_path / "data" / "x" / "p.json"), "none.jsonl", "f.jsonl") == str(tmp_path / "data" / "f.csv")
    assert config.companion(str(tmp_path / "other" / "p.json"), "f.jsonl") is None
    assert [tuple(r) for r in config.feature_csv(spark, str(tmp_path / "data" / "f.csv")).collect()] == [("a", 2.5)]
    known = [{"lang": "en", "source_id": "a", "path": "p"}, {"lang": "en", "source_id": "b", "path": "q"}]
    monkeypatch.setenv("SOURCE_REGISTRY_JSON", '[{"lang": "en", "source_id": "b", "path": "new"}, {"lang": "zh", "source_id": "c"}]')
    assert [(r.source_id, r.path) for r in config.source_registry(spark, known).collect()] == [("a", "p"), ("b", "new"), ("c", None)]
    merged = sinks.merge_summaries([{"source_id": "a", "n": 1}, {"source_id": "b", "n": 1}], [{"source_id": "a", "n": 2}], ["a", "c"])
    assert merged == {"sources": [{"source_id": "a", "n": 2}, {"source_id": "b", "n": 1}], "missing": ["c"]}
    counts = spark.createDataFrame([("d", "train", 3)], "dataset string, split string, n long")
    assert sinks.dataset_manifest(counts, "d", seed=42) == {"dataset": "d", "seed": 42, "split_counts": {"train": 3}, "status": "complete"}


def test_json_shapes(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1}{"a":\n 2}\n\n{"a": 3}')
    assert sorted(r.a for r in readers.concatenated_json(spark, str(tmp_path / "c.json"), "a int").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="not an array"):
        readers.json_array(spark, str(tmp_path / "c.json"), "a int")


def test_pipeline_command(spark, tmp_path, capsys):
    for dataset, split, answers in (("dolly", "train", ["a", "b", "b"]), ("dolly", "test", ["a"]), ("other", "train", ["c"])):
        (tmp_path / "in" / dataset).mkdir(parents=True, exist_ok=True)
        rows = [{"id": f"{dataset}-{split}-{i}", "language": "en", "track": "single", "family": "qa", "question": "q", "context": "", "human_answer": a, "bucket_id": "b", "meta": "{}", "ordinal": i} for i, a in enumerate(answers)]
        (tmp_path / "in" / dataset / f"{split}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "s.json").write_text(json.dumps({"input_root": str(tmp_path / "in"), "output_root": str(tmp_path / "out"), "min_bucket_size": 2}))
    report = cli.run_pipeline(spark, str(tmp_path / "s.json"))
    assert (report["original_total"], report["final_total"], report["same_split_duplicates_removed"], report["cross_split_duplicates_removed"]) == (5, 3, 1, 1)
    kept = spark.read.json(str(tmp_path / "out" / "current"))
    assert {r.id for r in kept.collect()} == {"dolly-test-0", "dolly-train-1", "other-train-0"}
    assert spark.read.json(str(tmp_path / "out" / "references")).first()["n"] == 3
    with pytest.raises(ValueError, match="lack"):
        (tmp_path / "bad.json").write_text("{}")
        config.settings(str(tmp_path / "bad.json"))
