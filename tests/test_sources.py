"""Readers, formatters and resumable appends on hand-written rows."""

import json
import zipfile

import pytest

from tessera.sources import formatters, readers
from tessera.streaming.resume import append_new

SCHEMA = "a int, b string"


def test_json_shapes(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "}{"}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "joined.json").write_text("".join(map(json.dumps, rows)) + "\n")
    want = [(1, "x"), (2, "}{")]
    for read, name in ((readers.json_lines, "lines"), (readers.json_array, "array"), (readers.concatenated_json, "joined")):
        assert sorted(map(tuple, read(spark, str(tmp_path / f"{name}.json"), SCHEMA).collect())) == want
    with pytest.raises(ValueError, match="not an object"):
        readers.split_objects("[1]")


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/acts.txt", "1\n2\n")
        z.writestr("d/text.txt", "x\ny\n")
        z.writestr("d/long/q.json", '{"a": 5}')
        z.writestr("q.json", '{"a": 7, "b": "s"}')
        z.writestr("d/odd.txt", "1\n")
    got = readers.zipped_lines(spark, str(tmp_path / "a.zip"), ["d/acts.txt", "d/text.txt"]).collect()
    assert [(r.line, r.acts, r.text) for r in got] == [(0, "1", "x"), (1, "2", "y")]
    assert readers.zipped_json(spark, str(tmp_path / "a.zip"), ["q.json"], SCHEMA).first().a == 7
    with pytest.raises(Exception, match="differ in length"):
        readers.zipped_lines(spark, str(tmp_path / "a.zip"), ["d/acts.txt", "d/odd.txt"]).count()


def test_formatters(spark):
    def run(name, row, schema):
        return formatters.format_records(name, spark.createDataFrame([row], schema)).collect()

    answers = "answers struct<text array<string>, score array<int>>"
    best = run("scored_answers", ("q", "T", "", (["a", " ", "b", "c"], [1, 9, 3, 3])), f"q_id string, title string, selftext string, {answers}")
    assert [(r.question, r.human_answer) for r in best] == [("T", "b")]
    turns = run("story_turns", ("s", ["q1", "q2"], (["a1", "a2"],)), "story string, questions array<string>, answers struct<input_text array<string>>")
    assert [(r.question, len(r.history), r.human_answer) for r in turns] == [("q1", 0, "a1"), ("q2", 2, "a2")]
    ms = run("passages", (1, "q", [""], ["w"], (["p1", "p2"], [0, 1])), "query_id int, query string, answers array<string>, wellFormedAnswers array<string>, passages struct<passage_text array<string>, is_selected array<int>>")
    assert [(r.context, r.human_answer) for r in ms] == [("p2", "w")]
    assert run("span_answers", ("i", "t", "c", "q", ([],)), "id string, title string, context string, question string, answers struct<text array<string>>")[0].human_answer == ""
    many = run("many_answers", ("i", "q", "s", ["x", "", "y"]), "id string, question string, source string, human_answers array<string>")
    assert [r.human_answer for r in many] == ["x", "y"] and len({r.group_key for r in many}) == 1
    nested = run("nested_paragraphs", ([("c", [("i", "q", [("",), ("z",)])])],), "paragraphs array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>")
    assert [(r.context, r.human_answer) for r in nested] == [("c", "z")]
    with pytest.raises(KeyError):
        formatters.format_records("none", spark.range(1))


def test_resumed_append_writes_each_key_once(spark, tmp_path):
    inp, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "k long, v string"
    stream = lambda: spark.readStream.schema(schema).parquet(inp)
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).write.parquet(inp)
    append_new(stream(), lambda d: d, out, mark, "k")
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(inp)
    append_new(stream(), lambda d: d, out, mark, "k")
    append_new(stream(), lambda d: d, out, str(tmp_path / "other"), "k")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "c")]
