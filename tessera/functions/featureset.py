"""The whole feature set of a text: 134 features, row by row, and six features of short answers.

Features that need word lists or models (stop words, sentiment, parts of speech)
take the values that they have without them: no stop word, no sentiment, and every
token of the class X.  A lexicon can be given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions import text as T
from tessera.functions.generation import let

# Universal word classes, and counted classes of the finer tag set.
WORD_CLASSES = "adj adp adv conj det noun num pron prt verb x".split()
WITHOUT_LEXICON = {
    **dict.fromkeys("stopword_count content_word_count modal_count wh_word_count proper_noun_count past_verb_count gerund_verb_count past_participle_count non_3sg_present_verb_count third_person_present_verb_count base_verb_count".split(), 0),
    **dict.fromkeys("stopword_ratio content_word_ratio lexical_density modal_ratio wh_word_ratio proper_noun_ratio vader_neg vader_neu vader_pos vader_compound".split(), 0.0),
}
#: Names of the readability scores in the whole set, by their names in ``features.readability``.
READABILITY = {"flesch": "flesch_reading_ease", "fk_grade": "flesch_kincaid_grade", "fog": "gunning_fog", "smog": "smog_index", "coleman_liau": "coleman_liau", "ari": "automated_readability_index"}


def frequencies(words: Column) -> Column:
    """struct(types, once, twice, most, bits): of the words' counts c, bits the sum of c * log2 c; one pass over sorted hashes."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("run", "types", "once", "twice", "most")], F.lit(0.0).alias("bits"))

    def counted(hashes: Column) -> Column:
        # Equal hashes stand together, so a run ends where the next one differs: its length is known there.
        def step(s: Column, i: Column) -> Column:
            ends = ~F.get(hashes, i).eqNullSafe(F.get(hashes, i + 1))
            run = s["run"] + 1
            add = lambda c: F.when(ends & c, 1).otherwise(0)
            return F.struct(
                F.when(ends, 0).otherwise(run).alias("run"), (s["types"] + F.when(ends, 1).otherwise(0)).alias("types"), (s["once"] + add(run == 1)).alias("once"), (s["twice"] + add(run == 2)).alias("twice"),
                F.when(ends, F.greatest(s["most"], run)).otherwise(s["most"]).alias("most"), (s["bits"] + F.when(ends, run * F.log2(run.cast("double"))).otherwise(0.0)).alias("bits"),
            )

        return F.when(F.size(hashes) > 0, F.aggregate(F.sequence(F.lit(0), F.size(hashes) - 1), zero, step)).otherwise(zero)

    return let(F.sort_array(T.word_hashes(words)), counted)


def _r(c: Column) -> Column:
    return F.round(c, 6)


def derived() -> list[Column]:
    """Features of ``a``, ``t``, ``w``, ``e``, ``s``, the counts ``f`` and the syllables ``b``."""
    n, m, k, e = F.size("w"), F.size("t"), F.size("s"), F.size("e")
    solid = F.length(F.regexp_replace("a", "[ \n]", ""))
    sized = lambda c: F.size(F.filter("w", lambda x: c(F.length(x))))
    beats = F.aggregate("b", F.lit(0), lambda s, v: s + v)
    many = F.size(F.filter("b", lambda v: v >= 3))
    caps = lambda name: F.size(F.filter("t", lambda x: x.rlike(X.TOKENS[name])))
    ratio = lambda a, b: _r(T.safe_div(a, b))
    whole = {
        "char_count": F.length("a"), "char_no_space_count": solid, "paragraph_count": F.size(F.filter(F.split("a", "\n\n"), lambda p: F.regexp_replace(p, "[ \n]", "") != "")), "token_count": m,
        "max_token_frequency": F.col("f.most"), "syllable_count": beats, "multisyllabic_word_count": many,
    }
    shares = {
        "avg_char_per_token": ratio(solid, m), "avg_char_per_sentence": ratio(F.length("a"), k), "short_word_ratio": ratio(sized(lambda x: x <= 3), n), "long_word_ratio": ratio(sized(lambda x: x >= 7), n),
        "very_long_word_ratio": ratio(sized(lambda x: x >= 11), n), "type_token_ratio": ratio(F.col("f.types"), n), "root_ttr": ratio(F.col("f.types"), F.sqrt(n.cast("double"))), "corrected_ttr": ratio(F.col("f.types"), F.sqrt(2.0 * n)),
        "hapax_ratio": ratio(F.col("f.once"), n), "dislegomena_ratio": ratio(F.col("f.twice"), n), "max_token_frequency_ratio": ratio(F.col("f.most"), n),
        "shannon_entropy": F.when(n > 0, _r(F.log2(n.cast("double")) - F.col("f.bits") / n)).otherwise(0.0), "avg_syllables_per_word": ratio(beats, e), "multisyllabic_word_ratio": ratio(many, e),
        "punctuation_density": ratio(F.regexp_count("a", F.lit(X.COUNTED["punctuation_count"])), m), "all_caps_token_ratio": ratio(caps("all_caps_token_count"), m), "title_case_token_ratio": ratio(caps("title_case_token_count"), m),
    }
    return [c.cast("long").alias(x) for x, c in whole.items()] + [c.alias(x) for x, c in shares.items()]


def without_lexicon() -> list[Column]:
    m = F.size("t").cast("long")
    made = [F.lit(v).cast("long" if isinstance(v, int) else "double").alias(x) for x, v in WITHOUT_LEXICON.items()]
    for c in WORD_CLASSES:
        made += [(m if c == "x" else F.lit(0).cast("long")).alias(f"pos_{c}_count"), F.when(m > 0, 1.0 if c == "x" else 0.0).otherwise(0.0).alias(f"pos_{c}_ratio")]
    return made


def prepared(rows: DataFrame, text: str) -> DataFrame:
    rows = X.with_arrays(rows, text)
    return rows.withColumn("f", frequencies(F.col("w"))).withColumn("b", F.transform("e", T.syllables))


def feature_columns() -> list[Column]:
    """All 134 features of a ``prepared`` row."""
    named = [c.alias(READABILITY[x]) for x, c in zip(READABILITY, X.readability(), strict=True)]
    return [*X.counted(X.COUNTED), *X.counted(X.LOOKING), *X.token_counts(), *X.word_features(), *X.sentence_features(), *named, *derived(), *without_lexicon()]


def feature_rows(records: DataFrame, field: str = "human_answer", with_text: bool = False) -> DataFrame:
    """(id, dataset, split, field_name, [text], features): the features of each record's text as a map."""
    kept = ["id", "dataset", "split"]
    found = prepared(records.select(*kept, T.normalize_text(F.col(field)).alias("a0")), "a0").select(*kept, "a0", F.struct(*feature_columns()).alias("s"))
    names = found.schema["s"].dataType.names
    features = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[F.col(f"s.{x}").cast("double") for x in names]))
    return found.select(*kept, F.lit(field).alias("field_name"), *([F.col("a0").alias("text")] if with_text else []), features.alias("features"))


# Characters of content, of Chinese, and of punctuation.
_CJK, _CONTENT = r"[\x{4e00}-\x{9fff}]", r"[\x{4e00}-\x{9fff}A-Za-z0-9]"
_PUNCT = r"[!-/:-@\[-`{-~，。！？；：、（）《》“”‘’【】—…·「」『』]"


def short_answer_features(text: Column, context: Column) -> list[Column]:
    """Length, overlap with the context, diversity, entropy, Chinese share and punctuation, by character."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?:{T.WS}|[\r\n])+", "")
    chars = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_CONTENT), F.lit(0)), F.lower)

    def told(x: Column) -> Column:
        n, f, long = F.size(x["content"]), x["f"], F.length(x["solid"])
        count = lambda p: F.regexp_count(x["solid"], F.lit(p))
        return F.struct(
            long.cast("long").alias("length_chars"), _r(T.safe_div(F.size(F.filter(x["content"], lambda c: F.array_contains(x["seen"], c))), n)).alias("context_overlap"), _r(T.safe_div(f["types"], n)).alias("char_diversity"),
            F.when(n > 0, _r(F.log2(n.cast("double")) - f["bits"] / n)).otherwise(0.0).alias("char_entropy"), _r(T.safe_div(count(_CJK), long)).alias("chinese_ratio"), _r(T.safe_div(count(_PUNCT), long)).alias("punct_density"),
        )

    made = let(chars(text), lambda c: let(F.struct(c.alias("content"), frequencies(c).alias("f"), F.array_distinct(chars(context)).alias("seen"), solid.alias("solid")), told))
    return [F.inline(F.array(made))]
