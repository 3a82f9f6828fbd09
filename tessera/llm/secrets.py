"""Secret scans: fixed patterns plus character Markov models, in SQL functions.

Two first-order Markov models over characters are trained on labelled samples:
random strings (keys, tokens, digests) and ordinary identifiers.  In every run of
key characters the stretches are sought in which the sum over character pairs of
log P_random - log P_ordinary is largest; one is a secret if its sum and its mean
per pair pass their thresholds.  So a key in a path, an address or after a name is
found for itself, and several keys in a run are all found.  A secret is widened to
the whole letters and digits around its ends.  UUIDs are passed over.  Spans are in code points, end
exclusive.

Kinds, in order: assign, access, hex (the base patterns) and markov, of which the
parts outside base spans are added.

Defined cases: a null or empty text has no spans; overlapping spans of different
base kinds are all listed; a text of any length and any number of spans is scanned whole,
at a cost near linear in both; redaction joins overlapping spans into one mark;
repeated rows and ids are scanned each for itself; extra columns are ignored by
the scan and kept by ``redact``.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Both equal the unbounded run, kept only from its least length up.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Runs in which the Markov models look for secrets; of shorter ones few could reach MIN_SUM.
RUN = "[A-Za-z0-9+/_=-]{12,}"
#: Random by construction and no secret; character pairs cannot tell it from other hexadecimal strings.
UUID = "(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: What each pair of a stretch must bring, in nats; so what tells nothing beside a key is not taken with it.
COST = 0.3
#: Least mean and least sum of the log-likelihood ratio above that.
MIN_MEAN = 0.6
MIN_SUM = 19.0
#: A stretch ends where its sum has fallen by so many nats.
DROP = 12.0
MARK = "[REDACTED]"

# Words from which ordinary identifiers of the training sample are made.
_WORDS = (
    "about access account action address after again against agent album always amount analysis anchor animal answer "
    "append apply archive array attribute author backup balance banner before between binary block border bottom branch "
    "browser buffer builder button cache calendar callback category change channel character children choice client "
    "cluster collection column comment common company component compress condition config connection container content "
    "context control convert count country create current customer database default delete delivery description detail "
    "device dialog directory display document domain download driver element email enable encode engine entry error event "
    "example execute export factory feature field filter finder folder format forward function gateway general generate "
    "global group handler header height history image import index initial input insert instance integer interface "
    "internal iterator label language layout length level library limit listener loader local location logger manager "
    "mapping margin matrix maximum member memory message method minimum model module monitor network notification number "
    "object offset operation option order output package parameter parent parser partner password payment pending "
    "permission picture pipeline platform player plugin pointer position prefix preview primary process product profile "
    "project property provider public query queue random reader record reference refresh register release remote render "
    "report request resource response result return router runtime sample schedule schema script search section segment "
    "select sender sequence server service session setting shadow signal simple single socket source standard status "
    "storage stream string student subject summary support switch symbol system table target template terminal thread "
    "timeout title toolbar transaction transfer trigger update upload utility validator value variable vector version "
    "visible widget window worker wrapper writer und der die das nicht werden gesellschaft entwicklung verwaltung "
    "sicherheit mitglied zusammen leichtigkeit los las una para con desde entonces gobierno sociedad desarrollo "
    "informacion les des pour avec dans toujours gouvernement developpement societe connaissance entre mientras"
).split()


def training_samples(n: int = 4_000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Labelled samples: (random strings, ordinary identifiers)."""
    rng = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = (digits + "abcdef", digits + upper, digits + lower, digits + lower + upper, digits + lower + upper + "+/", digits + lower + upper + "-_")
    secret = ["".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 64))) for _ in range(n)]

    def identifier() -> str:
        parts = rng.choices(_WORDS, k=rng.randint(2, 6))
        style = rng.randrange(7)
        if style == 0:
            return "".join(parts)
        if style == 1:
            return parts[0] + "".join(p.title() for p in parts[1:])
        if style == 2:
            return "".join(p.title() for p in parts)
        if style == 3:
            return "_".join(parts).upper()
        tail = str(rng.randint(0, 2030)) if rng.random() < 0.3 else ""
        return {4: "_", 5: "-", 6: "/"}[style].join([*parts, tail] if tail else parts)

    rules = [c * 30 for c in lower + upper] + ["=" * 40, "-" * 40, "_" * 40, "+" * 30, "-=" * 20, "/" * 30, "0" * 24, "1234567890" * 3, "9" * 24]
    return secret, [identifier() for _ in range(n)] + rules * (n // 200)


@lru_cache(maxsize=4)
def pair_scores(n: int = 4_000, seed: int = 11, alpha: float = 0.5) -> tuple[float, ...]:
    """log P_random - log P_ordinary - COST of each character pair, row by row."""
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    logs = []
    for sample in training_samples(n, seed):
        counts = [[alpha] * size for _ in range(size)]
        for s in sample:
            for a, b in zip(s, s[1:], strict=False):
                counts[at[a]][at[b]] += 1
        logs.append([math.log(x / sum(row)) for row in counts for x in row])
    return tuple(round(r - o - COST, 4) for r, o in zip(*logs, strict=True))


_STRETCHES = "array<struct<low:int,high:int>>"


def stretches(run: Column) -> Column:
    """Places (low, high), end exclusive, of the secret stretches of a run of ALPHABET characters.

    One pass: the sum starts anew where it falls to zero or ``DROP`` below its
    best, and its best stretch before that is judged.
    """
    table = F.expr("array(" + ",".join(f"{x}D" for x in pair_scores()) + ")")
    size = len(ALPHABET)
    place = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def judged(acc: Column) -> Column:
        good = (acc["best"] >= MIN_SUM) & (acc["best"] >= MIN_MEAN * (acc["high"] - 1 - acc["low"]))
        return F.when(good, F.array_append(acc["out"], F.struct(acc["low"].alias("low"), acc["high"].alias("high")))).otherwise(acc["out"])

    def found(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            ratio = F.element_at(table, F.get(p, i - 1) * size + F.get(p, i) + 1)
            fresh = acc["sum"] <= 0
            total, start = F.when(fresh, ratio).otherwise(acc["sum"] + ratio), F.when(fresh, i - 1).otherwise(acc["start"])
            more = total > acc["best"]
            ends = total <= F.greatest(acc["best"] - DROP, F.lit(0.0))
            return F.struct(
                F.when(ends, 0.0).otherwise(total).alias("sum"), start.alias("start"), F.when(ends, 0.0).when(more, total).otherwise(acc["best"]).alias("best"),
                F.when(more, start).otherwise(acc["low"]).alias("low"), F.when(more, i + 1).otherwise(acc["high"]).alias("high"), F.when(ends, judged(acc)).otherwise(acc["out"]).alias("out"),
            )

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.array().cast(_STRETCHES).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), zero, step, judged)

    return F.element_at(F.transform(F.array(place), found), 1)


_SPANS = "array<struct<start:int,end:int,kind:int,text:string>>"
#: Items of a block when an array is walked.
_BLOCK = 256


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _gathered(items: Column, state: Column, step, kind: str) -> Column:
    """struct(state, out): what ``step`` emits, in order, as it walks ``items``.

    step: (state, item) -> struct(state, one), of which a null ``one`` emits
    nothing.  Blocks keep the cost of growing arrays near linear.
    """

    def walk(acc: Column, block: Column) -> Column:
        def one(inner: Column, item: Column) -> Column:
            return _let(step(inner["state"], item), lambda r: F.struct(r["state"].alias("state"), F.when(r["one"].isNull(), inner["out"]).otherwise(F.array_append(inner["out"], r["one"])).alias("out")))

        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return _let(F.aggregate(block, begin, one), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))
    begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = F.when(F.size(items) > 0, F.aggregate(blocks, begin, walk)).otherwise(begin)
    return _let(whole, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))


_SPAN = _SPANS[6:-1]


def _span(start: Column, end: Column, kind: int, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), text.alias("text")).cast(_SPAN)


def _located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """All leftmost non-overlapping matches with their places.

    What lies between the matches gives their places; the match is kept if the
    group has ``least`` characters.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("inner"), gaps.alias("gap"))

    def step(at: Column, p: Column) -> Column:
        start = at + p["gap"]
        end = start + F.length(p["found"])
        return F.struct(end.cast("int").alias("state"), F.when(F.length(p["inner"]) >= least, _span(start, end, kind, p["found"])).alias("one"))

    walked = _let(F.filter(parts, lambda p: p["found"].isNotNull()), lambda found: _gathered(found, F.lit(0), step, _SPAN))["out"]
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind as listed."""
    found = F.concat(_located(text, ASSIGN, 0, 2, 6), _located(text, ACCESS, 1), _located(text, HEX, 2))
    return F.array_sort(found, lambda a, b: (a["start"] - b["start"]) * 8 + a["kind"] - b["kind"])


def markov_spans(text: Column) -> Column:
    """Secret stretches of all runs, each widened to whole letters and digits; may overlap."""

    def within(span: Column) -> Column:
        def widened(s: Column) -> Column:
            run, high = span["text"], s["high"]
            inner = F.substring(run, s["low"] + 1, high - s["low"])
            before = F.length(F.regexp_extract(F.substring(run, F.lit(1), s["low"]), "[A-Za-z0-9]*$", 0))
            after = F.length(F.regexp_extract(F.substring(run, high + 1, F.length(run)), "^[A-Za-z0-9]*", 0))
            # The last letter of a word and its separator belong to the word.
            head = F.when(before > 0, F.length(F.regexp_extract(inner, "^[A-Za-z0-9]?[/_=-]+", 0))).otherwise(0)
            tail = F.when(after > 0, F.length(F.regexp_extract(inner, "[/_=-]+[A-Za-z0-9]?$", 0))).otherwise(0)
            low = s["low"] + F.when(head > 0, head).otherwise(-before)
            high = high + F.when(tail > 0, -tail).otherwise(after)
            return F.struct((span["start"] + low).alias("start"), (span["start"] + high).alias("end"), F.lit(3).alias("kind"), F.substring(span["text"], low + 1, high - low).alias("text"))

        return F.transform(stretches(F.regexp_replace(span["text"], UUID, "=" * 36)), widened)

    return F.flatten(F.transform(_located(text, RUN, 3), within)).cast(_SPANS)


def _outside(spans: Column, base: Column) -> Column:
    """The parts of ``spans`` that none of ``base`` covers; spans that overlap are joined.

    One sweep over both by start: up to ``at`` all is settled, up to ``upto`` a span reaches.
    """
    events = F.array_sort(F.concat(spans, base), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    state = lambda at, upto: F.struct(at.cast("int").alias("at"), upto.cast("int").alias("upto"))

    def step(s: Column, e: Column) -> Column:
        mine = e["kind"] == 3
        stop = F.least(s["upto"], e["start"])
        ends = ~mine | (e["start"] > s["upto"])
        after = F.when(~mine, state(F.greatest(s["at"], e["end"]), s["upto"])).when(ends, state(F.greatest(s["at"], e["start"]), F.greatest(s["upto"], e["end"]))).otherwise(state(s["at"], F.greatest(s["upto"], e["end"])))
        return F.struct(after.alias("state"), F.when(ends & (s["at"] < stop), _span(s["at"], stop, 3, F.lit(""))).alias("one"))

    def finish(r: Column) -> Column:
        last = r["state"]
        return F.when(last["at"] < last["upto"], F.array_append(r["out"], _span(last["at"], last["upto"], 3, F.lit("")))).otherwise(r["out"])

    walked = _let(events, lambda found: _gathered(found, state(F.lit(0), F.lit(0)), step, _SPAN))
    return _let(walked, finish)


def found_spans(text: Column) -> Column:
    """struct(base, all): the spans of the fixed patterns, and these with the Markov ones, by start and kind."""
    by_place = lambda spans: F.array_sort(spans, lambda a, b: (a["start"] - b["start"]) * 8 + a["kind"] - b["kind"])
    both = F.struct(base_spans(text).alias("base"), markov_spans(text).alias("markov"))
    joined = lambda x: F.when(F.size(x["markov"]) > 0, by_place(F.concat(x["base"], _outside(x["markov"], x["base"])))).otherwise(x["base"])
    return F.element_at(F.transform(F.array(both), lambda x: F.struct(x["base"].alias("base"), joined(x).alias("all"))), 1)


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row of counts and spans for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found_spans(common.text_or_empty()).alias("spans"))
    count = lambda kind: F.size(F.filter("spans.base", lambda s: s["kind"] == kind)).cast("long")
    added = F.filter("spans.all", lambda s: s["kind"] == 3)
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size(added).cast("long").alias("n_markov"),
        F.sha2(spans_text(F.col("spans.base")), 256).alias("base_sha256"), spans_text(F.col("spans.all")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``MARK``."""

    def step(at: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(MARK)))
        return F.struct(F.greatest(at, s["end"]).alias("state"), piece.alias("one"))

    return _let(_gathered(spans, F.lit(0), step, "string"), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["state"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``MARK``; n_chars, if there, follows.

    The row goes along as one column, so that no name can clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", found_spans(F.coalesce("row.text", F.lit("")))["all"].alias("spans"))
    some = F.size("spans") > 0
    rows = rows.select("row", some.alias("some"), F.when(some, redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")).alias("clean"))
    made = {"text": F.col("clean"), "n_chars": F.when(F.col("some"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars").cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
