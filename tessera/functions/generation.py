"""Column functions around generation: prompts, cleaned replies, scores of models.

Null texts count as empty.  Everything is a built-in expression; arrays that are
used more than once are bound with ``let``, so that they are computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WS, normalize_text

SPACE = rf"(?:{WS}|[\n\r])"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FENCED = rf"(?s)^.*?```[a-zA-Z0-9_+-]*\n{SPACE}*(.*?){SPACE}*```.*\z"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


@dataclass(frozen=True)
class Dialect:
    """How replies of one kind of model are cleaned.

    Steps, in order: unquote, fence (if early), keep what follows ``after``, cut at the first of
    ``cuts``, strip ``labels`` in front, fence (if late), then lines.
    """

    cuts: tuple[str, ...]
    labels: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    bad_starts: tuple[str, ...] = ()
    bad_lines: tuple[str, ...] = ()
    fence: str = "none"
    unquote: bool = False
    first_line: bool = False
    paragraphs: bool = False
    drop_repeats: bool = False


# Markers, labels and line starts of each dialect.
_CHAT_CUTS = ("<|im_end|>", "<|endoftext|>", "\n<|im_start|>", "\nQuestion:", "\nUser:", "\nAssistant:")
_CHAT_BAD = ("<|im_start|>", "<|im_end|>", "Question:", "User:", "Assistant:")
DIALECTS = {
    "base": Dialect(
        cuts=("\nQuestion:", "\nUser:", "\nAssistant:", "\nExplanation:", "\nOutput:", "\n```", "\n#"),
        after=("Assistant:", "Answer:"),
        bad_starts=("The assistant should", "The correct output should", "The answer should", "Output:", "Explanation:", "Question:", "Answer:", "User:", "Assistant:", "#"),
        bad_lines=("```", "Output", "Explanation"),
        fence="early",
        unquote=True,
        first_line=True,
    ),
    "sft": Dialect(_CHAT_CUTS, labels=("Answer:",), bad_starts=_CHAT_BAD, drop_repeats=True),
    "dist_sft": Dialect(_CHAT_CUTS, labels=("Answer:", "Assistant:"), bad_starts=_CHAT_BAD),
    "pair": Dialect(_CHAT_CUTS, labels=("Answer:", "Assistant:"), bad_starts=_CHAT_BAD, fence="late"),
    "cot": Dialect(
        cuts=(
            "<|im_end|>", "<|endoftext|>", "\n<|im_start|>", "\nSystem:", "\nUser:", "\nAssistant:", "\n用户：", "\n助手：", "\nTask:",
            "\nConversation History:", "\nContext:", "\nQuestion:", "\n任务要求：", "\n对话历史：", "\n上下文：", "\n问题：",
        ),
        labels=("Assistant:", "助手："),
        bad_lines=("System:", "User:", "Assistant:", "用户：", "助手："),
        fence="late",
        paragraphs=True,
    ),
}
REASONING_STARTS = ("Reasoning:", "Reasoning：", "Final Answer:", "Final Answer：", "推理：", "推理:", "最终答案：", "最终答案:")
REASONING_LABEL = {"en": "Reasoning:", "zh": "推理："}
ANSWER_LABELS = ("final answer", "最终答案", "answer", "答案")
TOKEN_LIMIT_MARKERS = (
    "context length", "context window", "max context length", "maximum context", "max_model_len", "max model len", "max model length",
    "max seq len", "max sequence length", "maximum sequence length", "token limit", "too many tokens", "input length", "exceeds",
    "longer than the model", "input is too long", "prompt is too long", "sequence length is longer",
)
DEFAULT_SYSTEM = "You are a helpful assistant."
PROFILE_SYSTEM = "You are a helpful assistant. Follow the target response profile when answering. "
PAIR_TYPES = {"dist": "distribution", "distributional": "distribution", "local_alignment": "local", "locality": "local", "global_utility": "global", "quality": "global"}
#: Means and deviations of a curvature criterion on human and on machine text.
CURVATURE = {"human": (0.1603, 1.0791), "machine": (2.4686, 2.1582)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", "")


def any_of(literals: tuple[str, ...]) -> str:
    return "(?:" + "|".join(rf"\Q{t}\E" for t in literals) + ")"


def lines(x: Column) -> Column:
    return F.transform(F.split(x, LINE_END), strip)


def _unfenced(x: Column) -> Column:
    """What the first fence holds, or the whole text."""
    return F.regexp_replace(x, FENCED, "$1")


def clean_reply(x: Column, dialect: str) -> Column:
    """A model's reply without quoting, labels, fences, later turns and bad lines."""
    d = DIALECTS[dialect]
    x = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\r\n?", "\n")
    if d.unquote:
        x = F.replace(F.replace(x, F.lit("\n> "), F.lit("\n")), F.lit("> "), F.lit(""))
    if d.fence == "early":
        x = _unfenced(x)
    for mark in d.after:
        x = F.regexp_replace(x, rf"(?s)^.*?\Q{mark}\E{SPACE}*", "")
    x = F.regexp_replace(x, f"(?s){any_of(d.cuts)}.*", "")
    for label in d.labels:
        x = F.regexp_replace(x, rf"^\Q{label}\E{SPACE}*", "")
    if d.fence == "late":
        x = _unfenced(x)
    good = lambda t: (t != "") if not d.paragraphs else F.lit(True)
    kept = lambda t: F.lit(True) if not d.bad_starts else ~t.rlike(f"^{any_of(d.bad_starts)}")
    whole = lambda t: F.lit(True) if not d.bad_lines else ~t.isin(*d.bad_lines)
    found = F.filter(lines(x), good)
    if d.first_line:
        first = let(found, lambda a: F.coalesce(F.get(F.filter(a, lambda t: kept(t) & whole(t)), F.lit(0)), F.get(a, F.lit(0)), F.lit("")))
        bare = strip(F.regexp_replace(strip(first), r"^`+|`+\z", ""))
        return strip(F.regexp_replace(bare, r"""^(["'])(.*)\1\z""", "$2"))
    x = strip(F.array_join(F.filter(found, lambda t: kept(t) & whole(t)), "\n"))
    if d.paragraphs:
        x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    if d.drop_repeats:
        pieces = F.filter(F.transform(F.split(x, rf"(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")
        x = let(pieces, lambda a: F.array_join(F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))), " "))
    return x


def reasoned_reply(x: Column, language: str) -> Column:
    """A cleaned reasoning reply that starts with one of the labels; empty stays empty."""
    label = F.lit(REASONING_LABEL[language] + " ")
    return let(clean_reply(x, "cot"), lambda t: F.when((t == "") | t.rlike(f"^{any_of(REASONING_STARTS)}"), t).otherwise(F.concat(label, t)))


def final_answer(x: Column) -> Column:
    """What follows the first label found, in order of ``ANSWER_LABELS``; else the last line."""

    def pick(text: Column) -> Column:
        found = F.coalesce(F.try_element_at(F.filter(lines(text), lambda t: t != ""), F.lit(-1)), F.lit(""))
        for label in reversed(ANSWER_LABELS):
            pattern = rf"(?is)(?:^|\n){label}{SPACE}*[:：]{SPACE}*(.+)$"
            found = F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(found)
        return found

    return let(F.coalesce(x, F.lit("")), pick)


def plain_prompt(pairs: Column, context: Column, question: Column) -> Column:
    """History, context and question under headings, then ``Answer:``."""
    said = F.flatten(F.transform(F.coalesce(pairs, F.array().cast("array<array<string>>")), lambda p: F.array(F.concat(F.lit("User: "), F.nullif(strip(F.get(p, F.lit(0))), F.lit(""))), F.concat(F.lit("Assistant: "), F.nullif(strip(F.get(p, F.lit(1))), F.lit(""))))))
    told = F.array_join(said, "\n")
    part = lambda head, t: F.concat(F.lit(head + ":\n"), F.nullif(t, F.lit("")))
    return F.concat_ws("\n\n", part("Conversation History", told), part("Context", strip(context)), part("Question", strip(question)), F.lit("Answer:"))


def condition_prefix(context: Column, history: Column, question: Column) -> Column:
    """What an answer is conditioned on; empty if there is nothing."""
    turns = F.filter(F.transform(history, lambda t: F.struct(F.lower(normalize_text(t["role"])).alias("role"), normalize_text(t["text"]).alias("text"))), lambda t: t["text"] != "")
    asked = normalize_text(question)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    again = lambda a: F.coalesce((last(a)["role"] == "user") & (last(a)["text"] == asked), F.lit(False))
    turns = let(turns, lambda a: F.when(again(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
    told = F.array_join(F.transform(turns, lambda t: F.concat(F.when(t["role"] == "", "Unknown").otherwise(F.initcap(t["role"])), F.lit(": "), t["text"])), "\n")
    part = lambda head, t: F.concat(F.lit(head + ":\n"), F.nullif(t, F.lit("")))
    whole = F.concat_ws("\n\n", part("Context", normalize_text(context)), part("Dialogue History", told), part("Current User Message", asked))
    return let(whole, lambda w: F.when(w == "", "").otherwise(F.concat(w, F.lit("\n\nAssistant Response:\n"))))


def system_prompt(family: Column, track: Column, style: Column, length: Column, default: str = DEFAULT_SYSTEM) -> Column:
    part = lambda name, c: F.concat(F.lit(name + "="), F.nullif(normalize_text(c), F.lit("")))
    profile = F.concat_ws("; ", part("family", family), part("track", track), part("style", style), part("length", length))
    return F.when(profile == "", default).otherwise(F.concat(F.lit(PROFILE_SYSTEM), profile, F.lit(".")))


def pair_type(x: Column) -> Column:
    name = F.lower(normalize_text(x))
    found = F.when(name.isin("global", "distribution", "local"), name).otherwise("global")
    for alias, meant in PAIR_TYPES.items():
        found = F.when(name == alias, meant).otherwise(found)
    return found


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(normalize_text(x)), r"[\\/: _-]+", "_"), r"^_+|_+\z", "")


def token_estimate(x: Column, n_messages: Column) -> Column:
    """Tokens of a chat: ideographs, the greater of bytes / 4 and segments, 8 a message."""
    text = F.coalesce(x, F.lit(""))
    rest = F.regexp_replace(text, CJK, "")
    by_bytes = F.floor((F.octet_length(rest) + 3) / 4)
    by_parts = F.regexp_count(rest, F.lit(rf"[\p{{L}}\p{{N}}_]+|(?!{SPACE})[^\p{{L}}\p{{N}}_]"))
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(CJK)) + F.greatest(by_bytes, by_parts) + 8 * F.greatest(n_messages, F.lit(1))).cast("long")


def is_token_limit_error(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(any_of(TOKEN_LIMIT_MARKERS)), F.lit(False))


def truncate_left(prefix: Column, answer: Column, room: int) -> Column:
    """(prefix, answer, prefix_dropped, answer_dropped): the prefix is cut first."""
    over = F.greatest(F.lit(0), F.size(prefix) + F.size(answer) - max(1, room))
    cut = F.least(F.size(prefix), over)
    rest = F.least(F.size(answer), over - cut)
    tail = lambda a, n: F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))
    return F.struct(tail(prefix, cut).alias("prefix"), tail(answer, rest).alias("answer"), cut.alias("prefix_dropped"), rest.alias("answer_dropped"))


def deviation(values: Column, sample: bool) -> Column:
    """Standard deviation of an array in one pass with a running mean; null if undefined."""
    seen = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, v: Column) -> Column:
        step = v - s["mean"]
        mean = s["mean"] + step / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + step * (v - mean)).alias("m2"))

    return F.aggregate(values, seen, add, lambda s: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s["m2"], s["n"] - (1 if sample else 0)))))


def lm_summary(log_probs: Column, answer_tokens: Column) -> Column:
    """Sums of an array of log-probabilities, rounded to 6 places; an empty array gives zeros."""
    n = F.size(log_probs)
    div = lambda a, b: F.coalesce(F.try_divide(a, b.cast("double")), F.lit(0.0))
    none = F.lit(0.0)

    def fields(total: Column) -> Column:
        mean = div(total, n)
        made = {
            "logprob_sum": total, "logprob_mean": mean, "nll_sum": -total, "nll_mean": -mean,
            "perplexity": F.when(n > 0, F.exp(F.least(-mean, F.lit(50.0)))).otherwise(none),
            "bits_per_token": -mean / F.ln(F.lit(2.0)),
            "surprisal_std": F.when(n > 1, deviation(log_probs, False)).otherwise(none),
            "surprisal_min": F.coalesce(-F.array_max(log_probs), none), "surprisal_max": F.coalesce(-F.array_min(log_probs), none),
            "score_coverage": div(n, answer_tokens),
        }
        return F.struct(n.cast("long").alias("scored_token_count"), *[(F.bround(c, 6) + 0.0).alias(k) for k, c in made.items()])

    return let(F.aggregate(log_probs, F.lit(0.0), lambda s, v: s + v), fields)


def machine_probability(criterion: Column) -> Column:
    """Share of the machine density in both normal densities at a criterion."""

    def density(mean: float, std: float) -> Column:
        z = (criterion - mean) / std
        return F.exp(-0.5 * z * z) / (std * F.sqrt(2 * F.pi()))

    human, machine = density(*CURVATURE["human"]), density(*CURVATURE["machine"])
    return F.when(human + machine > 0, machine / (human + machine)).otherwise(0.0)


def perturbation_z(original: Column, perturbed: Column) -> Column:
    """(original - mean) / sample deviation of the perturbed values; one value counts as deviation 1."""
    n = F.size(perturbed)
    mean = F.aggregate(perturbed, F.lit(0.0), lambda s, v: s + v) / n
    return (original - mean) / F.when(n > 1, F.greatest(deviation(perturbed, True), F.lit(1e-6))).otherwise(1.0)
