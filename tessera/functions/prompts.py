"""Prompts in two languages, judge prompts, masked texts, names and digests."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.generation import let, strip

# What prompts are made of, by language.
LOCALES = {
    "en": {
        "task": "Task:", "history": "Conversation History:", "context": "Context:", "question": "Question:", "format": "Write the response exactly in this format:", "reasoning": "Reasoning:", "final": "Final Answer:", "user": "User:", "assistant": "Assistant:",
        "system": "Follow the user's format exactly and do not echo the prompt.",
        "requirements": ["Answer the question in the requested style and length.", "Use the provided context and dialogue history when relevant.", "Stay grounded in the given information and do not copy the instructions."],
        "style": "Answer style: ", "length": "Answer length: ", "start": "Write the answer now.",
        "any_style": "Match the requested answer style closely and reason explicitly before concluding.", "any_length": "Match the requested answer length while keeping the response coherent.",
        "styles": {
            "assistant_like": "Reason clearly, then give the result.", "longform_qa": "Give an explicit multi-step explanation before concluding.", "open_chat": "Keep the tone natural while still reasoning step by step.",
            "qa_search": "Ground the reasoning in the provided context and avoid unsupported claims.", "task_dialogue": "Reason in a task-oriented way with clear constraints and next steps.",
        },
        "lengths": {
            "short": "Keep the reasoning compact and the final answer brief.", "medium": "Use a concise but complete explanation before the final answer.", "long": "Provide a detailed multi-step explanation before the final answer.",
            "xlong": "Provide a thorough multi-step explanation with careful justification before the final answer.",
        },
    },
    "zh": {
        "task": "任务要求：", "history": "对话历史：", "context": "上下文：", "question": "问题：", "format": "请严格按下面格式作答：", "reasoning": "推理：", "final": "最终答案：", "user": "用户：", "assistant": "助手：",
        "system": "严格遵守用户给出的格式要求，不要复述提示词。",
        "requirements": ["按要求的风格和长度回答问题。", "需要时依据给定上下文和历史对话作答。", "只根据给定信息作答，不要复述这些说明。"],
        "style": "作答风格：", "length": "作答长度：", "start": "现在开始作答。",
        "any_style": "尽量贴合要求的回答风格，并在结论前给出清楚推理。", "any_length": "在保持连贯的前提下，匹配要求的回答长度。",
        "styles": {
            "assistant_like": "先清楚推理，再给出结果。", "longform_qa": "先给出明确的多步说明，再下结论。", "open_chat": "语气自然，但保持逐步推理。", "qa_search": "基于给定上下文进行推理，不要补充没有依据的内容。", "task_dialogue": "围绕任务目标、约束和下一步进行推理。",
        },
        "lengths": {
            "short": "推理要简洁，最终答案要简短。", "medium": "先给出简洁但完整的说明，再给出最终答案。", "long": "先给出详细的多步说明，再给出最终答案。", "xlong": "给出充分而细致的多步推理，并谨慎说明依据后再作答。",
        },
    },
}
# The most new tokens of an answer, by length class.
MOST_TOKENS = {"short": 256, "medium": 512, "long": 1024, "xlong": 1536}


def prompt_language(language: Column, bucket_id: Column, asked: str | None = None) -> Column:
    """The asked language if there is one, else that of the record, of its bucket, or English."""
    if asked in LOCALES:
        return F.lit(asked)
    tag = lambda c: F.when(F.lower(strip(c)).startswith("zh"), "zh").when(F.lower(strip(c)).startswith("en"), "en")
    return F.coalesce(tag(F.coalesce(language, F.lit(""))), tag(F.split(F.coalesce(bucket_id, F.lit("")), r"\|")[0]), F.lit("en"))


def _in(language: Column, pick) -> Column:
    return F.when(language == "zh", pick(LOCALES["zh"])).otherwise(pick(LOCALES["en"]))


def _guidance(language: Column, key: Column, table: str, other: str) -> Column:
    def pick(locale: dict) -> Column:
        found = F.lit(locale[other])
        for name, text in locale[table].items():
            found = F.when(strip(F.coalesce(key, F.lit(""))) == name, text).otherwise(found)
        return found

    return _in(language, pick)


def task_prompt(language: Column, style: Column, length: Column, question: Column, context: Column, history: Column, extra: str = "") -> Column:
    """The whole task in one language: requirements, history, context, question and the format of the answer.

    history: array of (role, text); a last user turn that equals the question is left out, as are empty
    turns and other roles.  A missing question gives null.
    """
    said = strip(F.coalesce(question, F.lit("")))
    role = lambda t: F.when(strip(t["role"]) == "user", _in(language, lambda x: F.lit(x["user"]))).when(strip(t["role"]) == "assistant", _in(language, lambda x: F.lit(x["assistant"])))
    kept = lambda t, i: ~((i == F.size(history) - 1) & (strip(t["role"]) == "user") & (strip(t["text"]) == said))
    lines = F.filter(F.transform(F.filter(history, kept), lambda t: F.when(strip(t["text"]) != "", F.concat(role(t), F.lit(" "), strip(t["text"])))), lambda x: x.isNotNull())
    word = lambda k: _in(language, lambda x: F.lit(x[k]))
    needs = _in(language, lambda x: F.lit("\n".join(f"- {line}" for line in x["requirements"])))
    guide = F.concat_ws("\n", needs, F.concat(F.lit("- "), word("style"), _guidance(language, style, "styles", "any_style")), F.concat(F.lit("- "), word("length"), _guidance(language, length, "lengths", "any_length")))
    titled = lambda k, body: F.when(body != "", F.concat(word(k), F.lit("\n"), body))
    shape = F.concat_ws("\n", word("format"), F.concat(word("reasoning"), F.lit(" <step-by-step reasoning that matches the requested bucket>")), F.concat(word("final"), F.lit(" <final answer only>")))
    parts = [word("task"), guide, F.lit(extra.strip() or None), let(lines, lambda found: F.when(F.size(found) > 0, F.concat(word("history"), F.lit("\n"), F.array_join(found, "\n")))), titled("context", strip(F.coalesce(context, F.lit("")))), titled("question", said), shape]
    return F.when(said != "", F.concat_ws("\n\n", *parts))


def open_prompt(task: Column, language: Column) -> Column:
    """The task with the label of the reasoning to be written."""
    return F.concat(task, F.lit("\n\n"), _in(language, lambda x: F.lit(x["reasoning"])), F.lit(" "))


def most_tokens(length: Column, asked: int, length_aware: bool = True) -> Column:
    """New tokens at most: the asked number, or less where the length class has less."""
    if asked <= 0:
        raise ValueError("asked must be positive")
    cap = F.lit(None).cast("int")
    for name, n in MOST_TOKENS.items():
        cap = F.when(F.lower(strip(F.coalesce(length, F.lit("")))) == name, n).otherwise(cap)
    return F.least(F.lit(asked), cap) if length_aware else F.lit(asked)


@dataclass(frozen=True)
class Rubric:
    """Dimensions with their definitions, and composites of weighted dimensions; scores are whole numbers."""

    dimensions: dict[str, str]
    composites: dict[str, dict[str, float]]
    low: int = 1
    high: int = 5

    @classmethod
    def load(cls, text: str) -> Rubric:
        """From JSON, or from YAML where a reader of it is there."""
        try:
            raw = json.loads(text)
        except json.JSONDecodeError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError("the rubric is no JSON, and no YAML reader is installed") from e
            raw = yaml.safe_load(text)
        return cls({d["id"]: (d.get("definition") or "").strip() for d in raw["dimensions"]}, raw.get("composites") or {}, int(raw.get("score_min", 1)), int(raw.get("score_max", 5)))

    def text(self) -> str:
        return f"Give each dimension a whole number from {self.low} (fails) to {self.high} (excellent).\n" + "\n".join(f"- {k}: {v}" for k, v in self.dimensions.items())

    def json_schema(self) -> dict:
        score = {"type": "integer", "minimum": self.low, "maximum": self.high}
        scores = {"type": "object", "properties": dict.fromkeys(self.dimensions, score), "required": list(self.dimensions), "additionalProperties": False}
        errors = {"type": "array", "items": {"type": "string"}}
        return {"type": "object", "properties": {"scores": scores, "major_errors": errors, "rationale": {"type": "string"}}, "required": ["scores", "major_errors", "rationale"], "additionalProperties": False}

    def composite(self, scores: Column, name: str) -> Column:
        """A composite on 0 to 100 of a map of scores, over the dimensions that are there; 0 without any."""
        total, weight = F.lit(0.0), F.lit(0.0)
        for d, w in self.composites[name].items():
            value = F.try_element_at(scores, F.lit(d))
            total = total + F.when(value.isNotNull(), w * 100.0 * (value - self.low) / max(self.high - self.low, 1)).otherwise(0.0)
            weight = weight + F.when(value.isNotNull(), float(w)).otherwise(0.0)
        return F.when(weight > 0, F.round(total / weight, 4)).otherwise(0.0)


def judge_prompt(rubric: Rubric, metadata: list[str], history: Column, context: Column, instruction: Column, reference: Column, candidate: Column) -> Column:
    """What a judge is asked about one candidate; ``metadata`` names columns of the row."""
    block = lambda name, body: F.concat(F.lit(f"<{name}>\n"), F.when(body == "", "[none]").otherwise(body), F.lit(f"\n</{name}>"))
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    facts = F.to_json(F.struct(*[F.coalesce(F.col(m), F.lit("")).alias(m) for m in metadata]))
    asked = F.lit("Judge whether the candidate does the task and reads like a human answer of its kind.\n\n" + rubric.text() + "\n\nReturn one JSON object with scores, major_errors and rationale.")
    turns = F.array_join(F.transform(F.filter(history, lambda t: clean(t["text"]) != ""), lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), clean(t["text"]))), "\n")
    return F.concat_ws("\n\n", asked, F.concat(F.lit("Metadata:\n"), facts), block("history", turns), block("context", clean(context)), block("instruction", clean(instruction)), block("reference", clean(reference)), block("candidate", clean(candidate)), F.lit("Judge the candidate alone."))


def file_slug(name: Column) -> Column:
    """Lower case; separators become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[\\/: -]", "_"), "_{2,}", "_"), "^_+|_+$", "")


def web_slug(name: Column) -> Column:
    """Lower case; whatever is no letter, digit, dot, underscore or dash becomes one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def content_hash(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))


MASK = "<extra_id_{0}>"


def masked(text: Column, key: Column, share: float = 0.3, span: int = 2) -> Column:
    """``text`` with spans of words replaced by numbered marks; under eight words it stays as it is.

    Spans start where a hash of key and place is smallest within equal stretches, so they never overlap.
    """
    def placed(words: Column) -> Column:
        n = F.size(words)
        spans = F.greatest(F.lit(1), F.least(F.floor(share * n / max(span, 1)), F.floor(n / (span + 1)))).cast("int")

        def dealt(k: Column) -> Column:
            room = F.floor(n / k).cast("int")
            starts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (i * room + F.pmod(F.xxhash64(key, i), F.greatest(F.lit(1), room - span + 1))).cast("int"))
            return let(starts, cut)

        def cut(starts: Column) -> Column:
            end = lambda i: F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + span)
            before = F.transform(starts, lambda s, i: F.concat(F.slice(words, end(i) + 1, s - end(i)), F.array(F.concat(F.lit("<extra_id_"), i.cast("string"), F.lit(">")))))
            last = F.element_at(starts, -1) + span
            rest = F.slice(words, last + 1, F.greatest(F.lit(0), n - last))
            return F.array_join(F.concat(F.flatten(before), rest), " ")

        return F.when(n < 8, text).otherwise(let(spans, dealt))

    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), placed)


def fills(decoded: Column, n: int) -> Column:
    """What stands after each of ``n`` marks up to the next one; null if a mark is missing."""
    found = [F.regexp_extract(decoded, rf"(?s){MASK.format(i)}(.*?)(?:{MASK.format(i + 1)}|$)", 1) for i in range(n)]
    there = [F.contains(decoded, F.lit(MASK.format(i))) for i in range(n)]
    every = F.lit(True)
    for t in there:
        every = every & t
    return F.when(every, F.array(*[strip(f) for f in found]))


def filled(masked_text: Column, values: Column) -> Column:
    """The marks replaced by the values in order; marks without one go, and white space is single."""
    put = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), masked_text, lambda s, i: F.replace(s, F.concat(F.lit("<extra_id_"), i.cast("string"), F.lit(">")), F.get(values, i)))
    bare = F.regexp_replace(F.when(F.size(values) > 0, put).otherwise(masked_text), r"<extra_id_\d+>", "")
    return strip(F.regexp_replace(bare, r"\s+", " "))
