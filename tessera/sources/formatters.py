"""Raw corpora to (id, group_key, question, context, history, human_answer)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.generation import strip
from tessera.functions import text as T
from tessera.functions.text import normalize_text as norm
from tessera.operators import corpus as K
from tessera.operators.trees import chains

TURNS = "array<struct<role:string,text:string>>"


def _none() -> Column:
    return F.array().cast(TURNS)


def _first_text(texts: Column) -> Column:
    """The first text that is not blank, or an empty one."""
    return F.coalesce(F.get(F.filter(texts, lambda t: norm(t) != ""), F.lit(0)), F.lit(""))


def _record(ident: Column, group: Column, question: Column, context: Column, answer: Column, history: Column | None = None) -> list[Column]:
    return [
        ident.cast("string").alias("id"), group.cast("string").alias("group_key"), norm(question).alias("question"), norm(context).alias("context"),
        (_none() if history is None else history).alias("history"), norm(answer).alias("human_answer"),
    ]


def instruction(raw: DataFrame) -> DataFrame:
    """instruction, context, response, category."""
    key = F.concat_ws("::", "instruction", "response", "category")
    return raw.select(*_record(F.sha1(key), key, F.col("instruction"), F.col("context"), F.col("response")))


def passages(raw: DataFrame) -> DataFrame:
    """Answers well formed first; selected passages, else the first three."""
    both = F.arrays_zip(F.col("passages.passage_text").alias("t"), F.col("passages.is_selected").alias("s"))
    chosen = F.transform(F.filter(both, lambda p: p["s"] == 1), lambda p: p["t"])
    texts = F.when(F.size(chosen) > 0, chosen).otherwise(F.slice("passages.passage_text", 1, 3))
    good = _first_text(F.coalesce("wellFormedAnswers", F.array().cast("array<string>")))
    answer = F.when(good != "", good).otherwise(_first_text(F.coalesce("answers", F.array().cast("array<string>"))))
    return raw.select(*_record(F.col("query_id"), F.col("query_id"), F.col("query"), F.array_join(texts, "\n\n"), answer)).where("human_answer <> ''")


def story_turns(raw: DataFrame) -> DataFrame:
    """story, questions, answers.input_text: a record a turn, history before it."""
    zipped = F.arrays_zip(F.col("questions").alias("q"), F.col("answers.input_text").alias("a"))
    turns = raw.select("story", zipped.alias("z")).select("story", "z", F.posexplode("z").alias("i", "t"))
    said = lambda p: F.array(F.struct(F.lit("user").alias("role"), norm(p["q"]).alias("text")), F.struct(F.lit("assistant").alias("role"), norm(p["a"]).alias("text")))
    history = F.flatten(F.transform(F.slice("z", F.lit(1), F.col("i")), said))
    return turns.select(*_record(F.concat_ws("-", F.sha1("story"), "i"), F.sha1("story"), F.col("t.q"), F.col("story"), F.col("t.a"), history))


def scored_answers(raw: DataFrame) -> DataFrame:
    """Highest-scored answer that is not blank; the first of equals."""
    both = F.filter(F.arrays_zip(F.col("answers.text").alias("t"), F.col("answers.score").alias("s")), lambda a: norm(a["t"]) != "")
    best = F.aggregate(both, F.struct(F.lit(None).cast("string").alias("t"), F.lit(None).cast("int").alias("s")), lambda m, a: F.when(m["s"].isNull() | (a["s"] > m["s"]), F.struct(a["t"].alias("t"), a["s"].cast("int").alias("s"))).otherwise(m))
    question = F.concat_ws("\n\n", F.col("title"), F.nullif(norm(F.col("selftext")), F.lit("")))
    return raw.select(*_record(F.col("q_id"), F.col("q_id"), question, F.lit(""), best["t"])).where("human_answer <> ''")


def span_answers(raw: DataFrame, keep_unanswered: bool = True) -> DataFrame:
    """id, title, context, question, answers.text; grouped by title and context."""
    rows = raw.select(*_record(F.col("id"), F.concat_ws("::", "title", "context"), F.col("question"), F.col("context"), F.coalesce(F.get("answers.text", F.lit(0)), F.lit(""))))
    return rows if keep_unanswered else rows.where("human_answer <> ''")


def first_spans(raw: DataFrame) -> DataFrame:
    """id, context, question, answers.text: the first answer that is not blank; rows without one go."""
    answer = _first_text(F.coalesce("answers.text", F.array().cast("array<string>")))
    return raw.select(*_record(F.col("id"), F.col("context"), F.col("question"), F.col("context"), answer)).where("human_answer <> ''")


def query_answer(raw: DataFrame) -> DataFrame:
    key = F.concat_ws("::", "query", "answer")
    return raw.select(*_record(F.sha1(key), key, F.col("query"), F.lit(""), F.col("answer")))


def nested_paragraphs(raw: DataFrame) -> DataFrame:
    """paragraphs of qas of answers."""
    rows = raw.select(F.explode("paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
    return rows.select(*_record(F.col("q.id"), F.col("context"), F.col("q.question"), F.col("context"), _first_text(F.col("q.answers.text")))).where("human_answer <> ''")


def many_answers(raw: DataFrame) -> DataFrame:
    """One record a human answer; siblings share a group."""
    group = F.concat_ws("::", "source", "id")
    rows = raw.select("id", "question", group.alias("g"), F.posexplode("human_answers").alias("i", "a"))
    return rows.select(*_record(F.concat_ws("-", "g", "i"), F.col("g"), F.col("question"), F.lit(""), F.col("a"))).where("human_answer <> ''")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def alternating_dialogue(raw: DataFrame) -> DataFrame:
    """id, utterances (one string, turns joined by __eou__): user first, roles in turn.

    The mark's characters are stripped from both ends of the string, as they would be
    by a character-set strip, so a last letter among e, o, u may go with it.
    """
    whole = F.regexp_replace(strip(F.col("utterances")), r"^[_eou]+|[_eou]+\z", "")
    said = F.filter(F.transform(F.split(whole, "__eou__"), norm), lambda t: t != "")
    turns = F.transform(said, lambda t, i: _turn(F.when(i % 2 == 0, "user").otherwise("assistant"), t))
    rows = raw.select("id", turns.alias("t")).select("id", "t", F.posexplode("t").alias("i", "turn")).where("i % 2 = 1")
    before = F.slice("t", F.lit(1), F.col("i"))
    return rows.select(*_record(F.concat_ws("-turn-", "id", F.lpad(F.col("i").cast("string"), 3, "0")), F.col("id"), F.element_at(before, -1)["text"], F.lit(""), F.col("turn.text"), before))


def task_dialogue(raw: DataFrame) -> DataFrame:
    """dialogue_id, turns of (speaker, utterance): each system turn after another turn,
    asked by the latest user turn."""
    turns = F.transform("turns", lambda t: _turn(F.when(t["speaker"] == "USER", "user").otherwise("assistant"), t["utterance"]))
    rows = raw.select(F.col("dialogue_id").alias("id"), turns.alias("t")).select("id", "t", F.posexplode("t").alias("i", "turn")).where("i > 0 and turn.role = 'assistant'")
    before = F.slice("t", F.lit(1), F.col("i"))
    asked = F.coalesce(F.try_element_at(F.filter(before, lambda t: t["role"] == "user"), F.lit(-1))["text"], F.lit(""))
    return rows.select(*_record(F.concat_ws("-turn-", "id", F.lpad(F.col("i").cast("string"), 3, "0")), F.col("id"), asked, F.lit(""), F.col("turn.text"), before))


def search_answers(raw: DataFrame) -> DataFrame:
    """subset, id, context, question, is_impossible, answers (array of texts): the first
    text; impossible rows go from the checklist subset only."""
    rows = raw.where(~(F.col("subset").eqNullSafe("checklist") & truthy(F.col("is_impossible"))))
    answer = _first_text(F.coalesce("answers", F.array().cast("array<string>")))
    return rows.select(*_record(F.concat_ws("-", "subset", "id"), F.col("context"), F.col("question"), F.col("context"), answer)).where("human_answer <> ''")


def human_written(raw: DataFrame) -> DataFrame:
    """subset, instruction, input, output, answer_from and perhaps human_verified: a blank
    origin passes; verification counts only where the column is there."""
    rows = raw.where((F.coalesce("answer_from", F.lit("")) == "") | (F.lower("answer_from") == "human")).where(F.coalesce("output", F.lit("")) != "")
    if "human_verified" in raw.columns:
        rows = rows.where(truthy(F.col("human_verified")))
    key = F.concat_ws("::", "subset", "instruction", "output")
    return rows.select(*_record(F.sha1(key), key, F.col("instruction"), F.col("input"), F.col("output")))


def message_tree(raw: DataFrame) -> DataFrame:
    """message_id, parent_id, message_tree_id, role, text, lang, tree_state, deleted,
    review_result: assistant messages whose ancestors are all usable and that follow a
    prompter."""
    usable = (
        (norm(F.col("tree_state")) == "ready_for_export") & ~truthy(F.col("deleted")) & truthy(F.col("review_result"))
        & F.lower(F.coalesce("lang", F.lit(""))).startswith("zh") & norm(F.col("role")).isin("prompter", "assistant") & (norm(F.col("text")) != "")
    )
    role = F.when(norm(F.col("role")) == "prompter", "user").otherwise("assistant")
    nodes = raw.withColumn("id", F.col("message_id")).withColumn("parent", F.col("parent_id"))
    rows = chains(nodes, usable, F.struct(role.alias("role"), F.col("text"), F.coalesce("message_tree_id", "message_id").alias("tree")))
    rows = rows.where((F.size("chain") >= 2) & (F.col("chain")[F.size("chain") - 1]["role"] == "assistant") & (F.col("chain")[F.size("chain") - 2]["role"] == "user"))
    asked, answer = F.element_at("chain", -2), F.element_at("chain", -1)
    history = F.transform(F.slice("chain", F.lit(1), F.size("chain") - 2), lambda t: _turn(t["role"], t["text"]))
    return rows.select(*_record(F.col("id"), answer["tree"], asked["text"], F.lit(""), answer["text"], history))


FORMATTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f for f in (instruction, passages, story_turns, scored_answers, span_answers, first_spans, query_answer, nested_paragraphs, many_answers, alternating_dialogue, task_dialogue, search_answers, human_written, message_tree)
}


def format_records(name: str, raw: DataFrame) -> DataFrame:
    """Records of ``raw`` by a registered formatter; an unknown name is a KeyError."""
    return FORMATTERS[name](raw)


# Of each dataset its formatter, language, track, family, style and, where its own splits are not kept, the shares of its splits by group.
_THREE, _TWO = [("train", 0.9), ("dev", 0.05), ("test", 0.05)], [("train", 0.9), ("dev", 0.1)]
DATASETS = {
    "dolly": (instruction, "en", "single", "assistant", "assistant_like", _THREE),
    "ms_marco": (passages, "en", "single", "qa", "qa_search", None),
    "coqa": (story_turns, "en", "multi", "qa", "qa_search", _TWO),
    "eli5_category": (scored_answers, "en", "single", "qa", "longform_qa", None),
    "squad_v2": (span_answers, "en", "single", "qa", "qa_search", _TWO),
    "natural_questions": (query_answer, "en", "single", "qa", "qa_search", _THREE),
    "dailydialog": (alternating_dialogue, "en", "multi", "dialogue", "open_chat", None),
    "multiwoz": (task_dialogue, "en", "multi", "dialogue", "task_dialogue", None),
    "oasst2_zh": (message_tree, "zh", "multi", "dialogue", "open_chat", _TWO),
    "dureader": (search_answers, "zh", "single", "qa", "qa_search", None),
    "cmrc2018": (first_spans, "zh", "single", "qa", "qa_search", None),
    "drcd": (nested_paragraphs, "zh", "single", "qa", "qa_search", None),
    "hc3_chinese": (many_answers, "zh", "single", "qa", "longform_qa", _THREE),
    "coig_cqia": (human_written, "zh", "single", "assistant", "assistant_like", _THREE),
}
ALIASES = {"eli5": "eli5_category", "nq": "natural_questions"}
ENGLISH = [name for name, (_, language, *_rest) in DATASETS.items() if language == "en"]
CHINESE = [name for name, (_, language, *_rest) in DATASETS.items() if language == "zh"]
# The datasets' splits by the names used here.
SPLIT_NAMES = {"train": "train", "validation": "dev", "dev": "dev", "test": "test"}


def dataset_records(name: str, raw: DataFrame, source_split: str = "train", seed: int = 42) -> DataFrame:
    """Records of a dataset's raw rows in the whole schema; an unknown name is a KeyError.

    Where a dataset is split by hash, the training rows are dealt by group, and its
    validation rows are the test split; else its own splits are kept.
    """
    known = ALIASES.get(name, name)
    if known not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; there are {', '.join(sorted([*DATASETS, *ALIASES]))}")
    formatter, language, track, family, style, shares = DATASETS[known]
    rows = formatter(raw)
    if shares is None:
        split = F.lit(SPLIT_NAMES[source_split])
    elif source_split == "train":
        split = T.choose_split(T.hash_fraction(seed, F.col("group_key")), shares)
    else:
        split = F.lit("test")
    rows = rows.withColumns({"dataset": F.lit(known), "split": split, "language": F.lit(language), "track": F.lit(track), "family": F.lit(family), "style_bucket": F.lit(style), "dialogue_history": F.col("history")})
    meta = {"source_split": F.lit(source_split), "source_id": F.col("id")}
    if track == "multi":
        meta["num_history_turns"] = F.size("history")
    if known in K.GROUP_FIELD:
        meta[K.GROUP_FIELD[known]] = F.col("group_key")
    return K.build_records(rows, meta)
