"""Message trees, the remaining formatters, sinks and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.operators.trees import chains
from tessera.sources import formatters, sinks


def test_chains(spark):
    rows = [("a", None, True), ("b", "a", True), ("c", "b", False), ("d", "c", True), ("e", "gone", True), ("f", "g", True), ("g", "f", True), ("h", "b", True), ("i", "", True)]
    nodes = spark.createDataFrame(rows, "id string, parent string, ok boolean")
    got = {r.id: "".join(r.chain) for r in chains(nodes, F.col("ok"), F.col("id")).collect()}
    assert got == {"a": "a", "b": "ab", "h": "abh", "e": "e", "i": "i"}
    assert chains(nodes.limit(0), F.col("ok"), F.col("id")).count() == 0


def test_dialogues(spark):
    raw = spark.createDataFrame([("d1", "Hi __eou__ Hey you __eou__ Fine . __eou__ Bye__eou__ \n"), ("d2", "Alone __eou__"), ("d3", None)], "id string, utterances string")
    got = {r.id: (r.question, r.human_answer, len(r.history)) for r in formatters.format_records("alternating_dialogue", raw).collect()}
    assert got == {"d1-turn-001": ("Hi", "Hey you", 1), "d1-turn-003": ("Fine .", "By", 3)}
    turns = [("SYSTEM", "first"), ("USER", "q1"), ("SYSTEM", "a1"), ("SYSTEM", "a2")]
    raw = spark.createDataFrame([("m", turns), ("n", [])], "dialogue_id string, turns array<struct<speaker:string,utterance:string>>")
    got = {r.id: (r.question, r.human_answer, len(r.history)) for r in formatters.format_records("task_dialogue", raw).collect()}
    assert got == {"m-turn-002": ("q1", "a1", 2), "m-turn-003": ("q1", "a2", 3)}


def test_filters(spark):
    raw = spark.createDataFrame([("checklist", 1, "c", "q", True, ["x"]), ("robust", 2, "c", "q", True, [" ", "y"]), ("robust", 3, "c", "q", None, None)], "subset string, id int, context string, question string, is_impossible boolean, answers array<string>")
    assert [(r.id, r.human_answer) for r in formatters.format_records("search_answers", raw).collect()] == [("robust-2", "y")]
    raw = spark.createDataFrame([("s", "i", "", "o1", "Human", "true"), ("s", "i", "", "o2", "", None), ("s", "i", "", "o3", "model", "1"), ("s", "i", "", "", "human", "1")], "subset string, instruction string, input string, output string, answer_from string, human_verified string")
    assert [r.human_answer for r in formatters.format_records("human_written", raw).collect()] == ["o1"]
    assert sorted(r.human_answer for r in formatters.format_records("human_written", raw.drop("human_verified")).collect()) == ["o1", "o2"]


def test_message_tree(spark):
    rows = [("1", None, "prompter", "q", False), ("2", "1", "assistant", "a", False), ("3", "2", "prompter", "r", False), ("4", "3", "assistant", "b", False), ("5", "1", "assistant", "x", True), ("6", None, "assistant", "root", False)]
    raw = spark.createDataFrame([(*r[:2], "t", *r[2:4], "zh", "ready_for_export", r[4], True) for r in rows], "message_id string, parent_id string, message_tree_id string, role string, text string, lang string, tree_state string, deleted boolean, review_result boolean")
    got = {r.id: (r.group_key, r.question, r.human_answer, [tuple(t) for t in r.history]) for r in formatters.format_records("message_tree", raw).collect()}
    assert got == {"2": ("t", "q", "a", []), "4": ("t", "r", "b", [("user", "q"), ("assistant", "a")])}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "train", "é"), ("d", "test", "y"), ("d", "train", "z")], "dataset string, split string, x string")
    root = str(tmp_path / "tree")
    sinks.corpus_tree(rows, root)
    sinks.corpus_tree(rows.limit(0), root, "skip")
    assert spark.read.json(root).count() == 3 and "é" in "".join(p.read_text() for p in (tmp_path / "tree").rglob("*.json"))
    with pytest.raises(Exception, match="already exists"):
        sinks.corpus_tree(rows, root)
    assert {tuple(r) for r in sinks.manifest(rows).collect()} == {("d", "train", 2), ("d", "test", 1)}
    wide = sinks.wide_features(spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "a", 3.0)], "id int, feature string, value double"), ["b", "a"])
    assert wide.columns == ["id", "a", "b"] and {tuple(r) for r in wide.collect()} == {(1, 1.0, 2.0), (2, 3.0, None)}
    both = sinks.merge_by_key(spark.createDataFrame([("s", 1), ("t", 2)], "k string, v int"), spark.createDataFrame([(9, "t"), (8, "u")], "v int, k string"), "k")
    assert {tuple(r) for r in both.collect()} == {("s", 1), ("t", 9), ("u", 8)}
    assert sinks.report(rows, str(tmp_path / "r.json")) == 3 and len(json.loads((tmp_path / "r.json").read_text())) == 3
    with pytest.raises(ValueError):
        sinks.report(rows, str(tmp_path / "r.json"), most=2)
    registry = str(tmp_path / "reg.json")
    sinks.upsert_registry(registry, {"a": {"n": 1}, "b": {"n": 2}})
    assert sinks.upsert_registry(registry, {"a": {"n": 3}}) == {"a": {"n": 3}, "b": {"n": 2}}


def test_command_line(spark, sf, tmp_path, capsys):
    cli.main(["queries"])
    assert "dedup_report" in capsys.readouterr().out
    cli.main(["run", "token_length_bins", "--data", sf, "--out", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out")).count() > 0
    (tmp_path / "in.json").write_text(json.dumps({"query": "q", "answer": "a"}) + "\n")
    cli.main(["format", "query_answer", "--input", str(tmp_path / "in.json"), "--schema", "query string, answer string", "--out", str(tmp_path / "f")])
    assert spark.read.json(str(tmp_path / "f")).first().human_answer == "a"
