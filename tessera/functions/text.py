"""Column functions over text: normalisers, tokens, lengths, hashes, likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, tokens, sentence ends and length classes.
WS = r"[\t\x0b\x0c\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[^\p{L}\p{N}_\s]"
# Runs of white space that are not one space already.
_WIDE = rf" {WS}+|(?! ){WS}{WS}*"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
LENGTH_BINS = (("short", 40), ("medium", 120), ("long", 240))


def normalize_lines(x: Column) -> Column:
    """LF line ends, single spaces inside lines, no space around line ends."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, _WIDE, " "), " +\n *|\n +", "\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+\z", "")


def normalize_text(x: Column) -> Column:
    """``normalize_lines``, and at most one blank line in a row."""
    return F.regexp_replace(normalize_lines(x), r"\n{3,}", "\n\n")


def normalize_outer(x: Column) -> Column:
    """LF line ends and outer trim only."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n"), rf"^(?:{WS}|\n)+|(?:{WS}|\n)+\z", "")


def normalize_for_compare(x: Column) -> Column:
    return F.regexp_replace(normalize_outer(x), rf"(?:{WS}|\n)+", " ")


def answer_words(x: Column) -> Column:
    """Lower-case words without ASCII punctuation and articles."""
    return normalized_words(normalize_lines(x))


def normalized_words(x: Column) -> Column:
    """``answer_words`` of a text that ``normalize_lines`` would leave as it is."""
    bare = F.regexp_replace(F.lower(x), PUNCTUATION, "")
    return F.filter(F.split(bare, "[ \n]+"), lambda w: (w != "") & ~w.isin(*ARTICLES))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def length_bin(n: Column) -> Column:
    found = F.lit("xlong")
    for name, most in reversed(LENGTH_BINS):
        found = F.when(n <= most, name).otherwise(found)
    return found


def bucket_id(language: Column, track: Column, family: Column, length: Column) -> Column:
    return F.concat_ws("|", language, track, family, length)


def hash_fraction(seed: int, key: Column) -> Column:
    """First 32 bits of md5("seed:key") as a fraction of their greatest value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967295)


def choose_split(value: Column, shares: list[tuple[str, float]]) -> Column:
    """The first label whose cumulative share reaches the value, else the last."""
    found, total = F.lit(shares[-1][0]), sum(s for _, s in shares)
    for i in range(len(shares) - 1, -1, -1):
        total = sum(s for _, s in shares[: i + 1])
        found = F.when(value <= total, shares[i][0]).otherwise(found)
    return found


def ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays."""
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of an array of word hashes."""
    if n == 1:
        return hashes
    count = F.size(hashes) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def gram_key(words: Column) -> Column:
    """The hash that ``gram_hashes`` gives an n-gram of up to eight words."""
    hashed = word_hashes(words)
    found = F.lit(None).cast("long")
    for n in range(1, 9):
        key = F.get(hashed, F.lit(0)) if n == 1 else F.xxhash64(*[F.get(hashed, F.lit(i)) for i in range(n)])
        found = F.when(F.size(words) == n, key).otherwise(found)
    return found


def common_words(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays, in one pass over their sorted 63-bit hashes; no shuffle."""
    side = lambda words, bit: F.transform(words, lambda w: F.shiftleft(F.shiftright(F.xxhash64(w), 1), 1) + bit)
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))

    def step(s: Column, x: Column) -> Column:
        word, of_b = F.shiftright(x, 1), x.bitwiseAND(F.lit(1).cast("long"))
        same = s["w"].eqNullSafe(word)
        kept = lambda c: F.when(same, s[c]).otherwise(0)
        # a's come first among equals, so each further b meets one a at most
        met = F.when((of_b == 1) & (kept("a") > kept("b")), 1).otherwise(0)
        return F.struct(word.alias("w"), (kept("a") + F.when(of_b == 0, 1).otherwise(0)).alias("a"), (kept("b") + F.when(of_b == 1, 1).otherwise(0)).alias("b"), (s["n"] + met).alias("n"))

    start = F.struct(F.lit(None).cast("long").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))
    return F.aggregate(both, start, step, lambda s: s["n"])


def f1(common: Column, a: Column, b: Column) -> Column:
    """F1 of a common count; both empty 1, one empty 0."""
    n, m = F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2.0 * common / (n + m))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one table row at a time."""
    zero = F.transform(F.array_append(b, ""), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.get(b, j) == x, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.element_at(acc, -1)))
            return F.array_append(acc, best)

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), cell)).otherwise(before)

    return F.element_at(F.aggregate(a, zero, row), -1)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def syllables(word: Column) -> Column:
    """Vowel groups of the letters, a silent e less, at least one; one for up to three letters."""
    bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
    silent = bare.rlike(r"[^ly]e\z").cast("int")
    return F.when(F.length(bare) == 0, 0).when(F.length(bare) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+")) - silent))
