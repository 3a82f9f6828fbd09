"""License scans: trained paragraph classifiers, scored in SQL functions.

Paragraphs are the lines of a text; every one is scored.  Its distinct word uni-
and bigrams, as 64-bit hashes, are the sparse features of two logistic
regressions trained on the driver from the labelled sample in ``notices``: a gate,
which opens for all but ``SHUT`` of held-out notices, and a multinomial one over the licence families, a class
of unknown licences and ordinary text.  Probabilities are calibrated by
temperature on held-out variants, and the least probability at which a family is
named by notices of licences outside all families, of which at most ``LEAK`` may
pass.  A family is then confirmed by comparison with its templates -- the notice
holds most of a name's n-grams, or most of its own are in a passage -- and the
version numbers must not differ.  What is not confirmed is ``unknown``.  A line
that stays unknown is read once more together with the one before or after it, if
the gate opens for that too, so that wrapped notices are found.

Defined cases: a null or empty text has no paragraph; lines for which the gate
stays shut are no notices and are not listed; equal paragraphs are listed each; a
text of any length is scanned whole; repeated rows and ids are scanned each for
itself; extra columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .notices import CLASSES, FAMILIES, FUNCTION, NOUGHT, OUTSIDE, TOKEN, notices, sample, templates

#: Least share of n-grams for a template to confirm a family; least words of a piece of a passage.
MIN_TEMPLATE, MIN_PIECE = 0.65, 6
#: A notice that no family is sure of is ordinary text at this probability of it.
ORDINARY_FROM = 0.05
#: Share of held-out notices for which the gate may stay shut; the second model knows ordinary text too.
SHUT = 0.01
#: Share of notices of outside licences that calibration lets pass as a family, before templates are compared.
LEAK = 0.1
UNKNOWN = len(FAMILIES)
#: The version in a family's name; families without one do not compare versions.
VERSIONS = {f: f.rsplit("-", 1)[1].removesuffix(".0") for f in FAMILIES if f[-1].isdigit() and "-" in f}


def key_words() -> list[list[str]]:
    """Of each template, the words that tell its family: in a name, those that names of three families at most have."""
    listed = templates()
    of: dict[str, set[str]] = {}
    for family, words, passage in listed:
        for w in words if not passage else ():
            of.setdefault(w, set()).add(family)
    return [[] if passage else sorted({w for w in words if w.isalpha() and len(of[w]) <= 3}) for _, words, passage in listed]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def grams(words: list[str]) -> set[int]:
    """Hashes of the uni- and bigrams of a word list, as Spark's xxhash64 gives them."""
    single = [_signed(xxhash.xxh64_intdigest(w, 42)) for w in words]
    pair = lambda a, b: _signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
    return {*single, *map(pair, single, single[1:])}


#: Bits of a gram's hash that are its place in the tables.
PLACE_BITS = 16


def place_of(gram: int, shift: int) -> int:
    return (gram >> shift) & ((1 << PLACE_BITS) - 1)


@dataclass(frozen=True)
class Model:
    known: tuple[int, ...]
    #: Where in a hash its place begins; no two known grams share one.
    shift: int
    gate: np.ndarray
    gate_bias: float
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def matrix(self, rows: list[set[int]]) -> np.ndarray:
        place = {g: i for i, g in enumerate(self.known)}
        x = np.zeros((len(rows), len(place)), np.float32)
        for i, found in enumerate(rows):
            x[i, [place[g] for g in found if g in place]] = 1.0
        return x


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, steps: int, rate: float = 2.0, decay: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a logistic regression by gradient descent with momentum."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        off = _softmax(x @ w + b) - y
        dw = 0.9 * dw - rate * (x.T @ off / len(x) + decay * w)
        db = 0.9 * db - rate * off.mean(0)
        w, b = w + dw, b + db
    return w, b


@lru_cache(maxsize=1)
def model() -> Model:
    told = [words for _, words, _ in templates()] + [words[:12] for words, label in sample(3) if label == "unknown"]
    idle = {g for words in told for pair in zip(words, words[1:]) if FUNCTION.issuperset(pair) for g in grams(list(pair))} | {g for w in FUNCTION for g in grams([w])}
    found = sorted({g for words in told for g in grams(words)} - idle)
    shift = max(range(0, 64 - PLACE_BITS, 4), key=lambda k: len({place_of(g, k) for g in found}))
    known = tuple({place_of(g, shift): g for g in reversed(found)}.values())
    blank = Model(known, shift, np.zeros(0), 0.0, np.zeros(0), np.zeros(0), 1.0, 0.0)
    rows = sample(1)
    x = blank.matrix([grams(words) for words, _ in rows])
    labels = np.array([CLASSES.index(label) for _, label in rows])
    gate, _ = _regression(x, np.eye(2, dtype=np.float32)[(labels == len(CLASSES) - 1).astype(int)], 160)
    w, b = _regression(x, np.eye(len(CLASSES), dtype=np.float32)[labels], 220)
    held = sample(2)
    z, truth = blank.matrix([grams(words) for words, _ in held]) @ w + b, np.array([CLASSES.index(label) for _, label in held])
    is_notice = truth < len(CLASSES) - 1
    opening = (blank.matrix([grams(words) for words, _ in held]) @ (gate[:, 0] - gate[:, 1]))[is_notice]
    gate_bias = -float(np.quantile(opening, SHUT))
    loss = lambda t: float(-np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean())
    temperature = min((0.25 * 1.25**i for i in range(20)), key=loss)
    import random

    outside = notices(random.Random(5), [("unknown", n) for n in OUTSIDE], 20)
    p = _softmax((blank.matrix([grams(words) for words, _ in outside]) @ w + b) / temperature)
    least = float(np.quantile(np.where(p.argmax(1) < UNKNOWN, p.max(1), 0.0), 1 - LEAK))
    flat = lambda a: np.round(a.astype(float), 4)
    return Model(known, shift, flat(gate[:, 0] - gate[:, 1]), float(flat(np.array(gate_bias))), flat(w), flat(b), round(temperature, 4), round(min(max(least, 0.5), 0.95), 4))


def _numbers(values, kind: str) -> Column:
    """A constant array; made from one string, as thousands of literals would be slow to plan."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_in(line: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(line), NOUGHT, "$1"), F.lit(TOKEN), F.lit(0))


def grams_in(words: Column) -> Column:
    """Hashes of the uni- and bigrams of a word array."""

    def both(h: Column) -> Column:
        pairs = F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i))))
        return F.concat(h, F.coalesce(pairs, F.array().cast("array<bigint>")))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), both)


def _table(m: Model, values, kind: str, blank="0") -> Column:
    """A constant array that holds each known gram's value at its place."""
    rows = [blank] * (1 << PLACE_BITS)
    for g, v in zip(m.known, values, strict=True):
        rows[place_of(g, m.shift)] = v
    return _numbers(rows, kind)


def _places(found: Column, m: Model) -> Column:
    """Places of the distinct known grams."""
    known = _table(m, m.known, "bigint")
    place = lambda g: F.shiftrightunsigned(g, m.shift).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")
    return F.transform(F.array_distinct(F.filter(found, lambda g: F.get(known, place(g)) == g)), place)


def gate(line: Column, m: Model) -> Column:
    """Whether a line may be a licence notice."""
    weights = _table(m, m.gate, "double")
    total = F.aggregate(_places(grams_in(words_in(line)), m), F.lit(m.gate_bias), lambda a, p: a + F.get(weights, p))
    return total > 0


_VERDICT = "struct<family:string,probability:double,likeness:double>"


def classify(paragraph: Column, m: Model) -> Column:
    """struct(family, probability, likeness) of one paragraph."""
    weights, bias, rows = _numbers(m.weights.ravel(), "double"), _numbers(m.bias, "double"), _table(m, range(len(m.known)), "int")
    n = len(CLASSES)
    texts = lambda ws: "array(" + ",".join(f"'{w}'" for w in ws) + ")" if ws else "cast(array() as array<string>)"
    listed = [(CLASSES.index(family), passage, sorted(grams(words)), keys) for (family, words, passage), keys in zip(templates(), key_words(), strict=True)]
    sources = F.expr("array(" + ",".join(f"struct({f} as family, {str(passage).lower()} as passage, array({','.join(f'{g}L' for g in gs)}) as grams, {texts(keys)} as keys)" for f, passage, gs, keys in listed) + ")")
    names, versions = F.array(*[F.lit(c) for c in CLASSES]), F.array(*[F.lit(VERSIONS.get(c)).cast("string") for c in CLASSES])

    def judged(x: Column) -> Column:
        places = F.transform(_places(x["grams"], m), lambda p: F.get(rows, p))
        logits = _let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.aggregate(ps, F.get(bias, c), lambda a, p: a + F.get(weights, p * n + c))))

        def decide(z: Column) -> Column:
            top = F.array_max(z)
            best = (F.array_position(z, top) - 1).cast("int")
            probability = 1.0 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - top) / m.temperature))
            ordinary = probability * F.exp((F.get(z, F.lit(n - 1)) - top) / m.temperature)
            own = F.size(F.array_distinct(x["grams"]))

            def alike(t: Column) -> Column:
                shared = F.size(F.array_intersect(x["grams"], t["grams"]))
                whole = F.when(F.size(F.array_except(t["keys"], x["words"])) == 0, shared / F.size(t["grams"])).otherwise(0.0)
                piece = F.when(t["passage"] & (F.size(x["words"]) >= MIN_PIECE), shared / own).otherwise(0.0)
                return F.greatest(whole, piece)

            likeness = F.coalesce(F.array_max(F.transform(F.filter(sources, lambda t: t["family"] == best), alike)), F.lit(0.0))
            numbers = F.filter(x["words"], lambda w: w.rlike(r"^[0-9](\.[0-9])?$"))
            version = F.get(versions, best)
            same = version.isNull() | (F.size(numbers) == 0) | F.array_contains(numbers, version)
            sure = (best < UNKNOWN) & (probability >= m.least) & (likeness >= MIN_TEMPLATE) & same
            return F.struct(F.when(sure, F.get(names, best)).when((best == n - 1) | (ordinary >= ORDINARY_FROM), "none").otherwise("unknown").alias("family"), F.round(probability, 4).alias("probability"), F.round(likeness, 4).alias("likeness"))

        return _let(logits, decide)

    return _let(_let(words_in(paragraph), lambda w: F.struct(w.alias("words"), grams_in(w).alias("grams"))), judged).cast(_VERDICT)


def verdicts(text: Column) -> Column:
    """The verdict on each licence notice of a text, in order."""
    m = model()
    rows = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), gate(line, m).alias("open")))

    def found(lines: Column) -> Column:
        def judged(i: Column) -> Column:
            here = F.get(lines, i)["line"]

            def again(alone: Column) -> Column:
                beside = F.filter(F.array(i - 1, i + 1), lambda j: F.coalesce(F.get(lines, j)["open"], F.lit(False)))
                joined = F.transform(beside, lambda j: classify(F.concat_ws(" ", F.get(lines, F.least(i, j))["line"], F.get(lines, F.greatest(i, j))["line"]), m))
                better = F.get(F.filter(joined, lambda v: ~v["family"].isin("unknown", "none")), 0)
                return F.when(alone["family"] == "unknown", F.coalesce(better, alone)).otherwise(alone)

            return _let(classify(here, m), again)

        opened = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i)["open"])
        return F.filter(F.transform(opened, judged), lambda v: v["family"] != "none")

    return _let(rows, found).cast(f"array<{_VERDICT}>")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, families, least_probability): a row for each row of ``docs``.

    families: the distinct families of its licence paragraphs, sorted and
    comma-joined, ``unknown`` included; empty if there is none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), verdicts(common.text_or_empty()).alias("found"))
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda c: c["family"]))), ",").alias("families"),
        F.array_min(F.transform("found", lambda c: c["probability"])).alias("least_probability"),
    )
