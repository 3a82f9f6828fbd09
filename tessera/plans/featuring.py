"""Registered queries of the feature set, prompts, names and scores.

Bindings: texts are documents' answers; a context is the document's source and
language; judge replies lack a dimension where the id says so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions import featureset as S
from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.operators import metrics as M
from tessera.operators import records as R
from tessera.plans import catalogue as C

query, _sql, _r6 = C.query, C._sql, C._r6

_WORDS = f"""l0 as (select id, list_transform(list_filter(t, lambda x: regexp_matches(x, '{X.LEXICAL}')), lambda x: lower(x)) as w from f1),
l1 as (select id, x, count(*) as c from (select id, unnest(w) as x from l0) group by 1, 2),
l2 as (select id, count(*) as types, count(*) filter (c = 1) as once, count(*) filter (c = 2) as twice, max(c) as most, sum(c * log2(c)) as bits from l1 group by 1),
lex as (select l0.id as id, len(w) as n, coalesce(types, 0) as types, coalesce(once, 0) as once, coalesce(twice, 0) as twice, coalesce(most, 0) as most, coalesce(bits, 0) as bits, w from l0 left join l2 using (id))"""
_DIV = lambda a, b: f"round(case when ({b}) > 0 then ({a}) / ({b})::double else 0 end, 6)"


@query(
    _sql(
        f"""select id, types::bigint as types, n::bigint as tokens, {_DIV('types', 'n')} as ttr, {_DIV('types', 'sqrt(n)')} as root_ttr, {_DIV('types', 'sqrt(2 * n)')} as corrected_ttr, once::bigint as hapax, twice::bigint as dislegomena, most::bigint as max_frequency,
 case when n > 0 then round(log2(n) - bits / n, 6) else 0 end as entropy from lex""",
        C._F,
        _WORDS,
    )
)
def lexical_diversity(spark, d):
    """Type and token measures of every text's lexical tokens, zeros where there are none; row by row."""
    rows = C._records(spark, d).select("id", X.lexical(T.tokens(F.col("human_answer"))).alias("w"))
    rows = rows.select("id", F.size("w").alias("n"), S.frequencies(F.col("w")).alias("f"))
    n, types, div = F.col("n"), F.col("f.types"), lambda a, b: _r6(T.safe_div(a, b))
    whole = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        "id", whole(types, "types"), whole(n, "tokens"), div(types, n).alias("ttr"), div(types, F.sqrt(n.cast("double"))).alias("root_ttr"), div(types, F.sqrt(2.0 * n)).alias("corrected_ttr"), whole(F.col("f.once"), "hapax"),
        whole(F.col("f.twice"), "dislegomena"), whole(F.col("f.most"), "max_frequency"), F.when(n > 0, _r6(F.log2(n.cast("double")) - F.col("f.bits") / n)).otherwise(0.0).alias("entropy"),
    )


_SENT = f"len(list_filter(regexp_split_to_array(regexp_replace(a, '({X.TERMINAL})', '\\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> ''))"
_CAPS = lambda name: f"len(list_filter(t, lambda x: regexp_matches(x, '{X.TOKENS[name]}')))"
_ZEROS = ", ".join(f"{v}{'::bigint' if isinstance(v, int) else '::double'} as {k}" for k, v in S.WITHOUT_LEXICON.items())
_CLASSES = ", ".join(f"{'m' if c == 'x' else '0'}::bigint as pos_{c}_count, {'case when m > 0 then 1 else 0 end' if c == 'x' else '0'}::double as pos_{c}_ratio" for c in S.WORD_CLASSES)


@query(
    _sql(
        f"""select id, length(a) as char_count, solid as char_no_space_count, paragraphs::bigint as paragraph_count, m::bigint as token_count, most::bigint as max_token_frequency, y::bigint as syllable_count, many::bigint as multisyllabic_word_count,
 {_DIV('solid', 'm')} as avg_char_per_token, {_DIV('length(a)', 's')} as avg_char_per_sentence, {_DIV('short', 'n')} as short_word_ratio, {_DIV('long', 'n')} as long_word_ratio, {_DIV('vlong', 'n')} as very_long_word_ratio, {_DIV('types', 'n')} as type_token_ratio,
 {_DIV('types', 'sqrt(n)')} as root_ttr, {_DIV('types', 'sqrt(2 * n)')} as corrected_ttr, {_DIV('once', 'n')} as hapax_ratio, {_DIV('twice', 'n')} as dislegomena_ratio, {_DIV('most', 'n')} as max_token_frequency_ratio, case when n > 0 then round(log2(n) - bits / n, 6) else 0 end as shannon_entropy,
 {_DIV('y', 'e')} as avg_syllables_per_word, {_DIV('many', 'e')} as multisyllabic_word_ratio, {_DIV('puncts', 'm')} as punctuation_density, {_DIV('caps', 'm')} as all_caps_token_ratio, {_DIV('titles', 'm')} as title_case_token_ratio, {_ZEROS}, {_CLASSES} from x2""",
        C._F,
        _WORDS,
        f"""x0 as (select f1.id as id, a, len(t) as m, len(f1.e) as e, list_transform(f1.e, lambda x: lower(x)) as ew, length(regexp_replace(a, '[ \n]', '', 'g')) as solid, len(list_filter(string_split(a, chr(10) || chr(10)), lambda p: regexp_replace(p, '[ \n]', '', 'g') <> '')) as paragraphs,
 {_SENT} as s, {_CAPS('all_caps_token_count')} as caps, {_CAPS('title_case_token_count')} as titles, len(regexp_extract_all(a, '{X.COUNTED['punctuation_count']}')) as puncts from f1),
x1 as (select *, list_transform(ew, lambda x: {C._SYL}) as b from x0),
x2 as (select x1.*, lex.* exclude (id), coalesce(list_sum(b), 0) as y, len(list_filter(b, lambda k: k >= 3)) as many, len(list_filter(w, lambda x: length(x) <= 3)) as short, len(list_filter(w, lambda x: length(x) >= 7)) as long, len(list_filter(w, lambda x: length(x) >= 11)) as vlong from x1 join lex using (id))""",
    )
)
def derived_features(spark, d):
    """Ratios, densities and lexicon-free features, and those that a lexicon would give, without one."""
    return S.prepared(C._records(spark, d), "human_answer").select("id", *S.derived(), *S.without_lexicon())


@query(f"""with x as (select doc_id, regexp_replace(coalesce(text, ''), '(?:{T.WS}|[\\r\\n])+', '', 'g') as s, list_transform(regexp_extract_all(coalesce(text, ''), '{S._CONTENT}'), lambda c: lower(c)) as c, list_transform(regexp_extract_all(source || lang, '{S._CONTENT}'), lambda c: lower(c)) as k from documents),
u as (select doc_id, ch, count(*) as n from (select doc_id, unnest(c) as ch from x) group by 1, 2), f as (select doc_id, count(*) as types, sum(n * log2(n)) as bits from u group by 1)
select x.doc_id, length(s) as length_chars, {_DIV('len(list_filter(c, lambda z: list_contains(k, z)))', 'len(c)')} as context_overlap, {_DIV('coalesce(types, 0)', 'len(c)')} as char_diversity, case when len(c) > 0 then round(log2(len(c)) - bits / len(c), 6) else 0 end as char_entropy,
 {_DIV(f"len(regexp_extract_all(s, '{S._CJK}'))", 'length(s)')} as chinese_ratio, {_DIV(f"len(regexp_extract_all(s, '{S._PUNCT}'))", 'length(s)')} as punct_density from x left join f using (doc_id)""")
def short_answer_features(spark, d):
    return R.table(spark, d, "documents").select("doc_id", *S.short_answer_features(F.col("text"), F.concat("source", "lang")))


@query("select doc_id, sha1(coalesce(text, '')) as text_sha1, trim(regexp_replace(regexp_replace(lower(source || '/' || lang || ' - ' || doc_id % 7), '[\\\\/: -]', '_', 'g'), '_{2,}', '_', 'g'), '_') as file_slug, trim(regexp_replace(lower(source || '/' || lang || ' - ' || doc_id % 7), '[^a-z0-9._-]+', '-', 'g'), '-') as web_slug from documents")
def names_and_hashes(spark, d):
    name = F.concat("source", F.lit("/"), "lang", F.lit(" - "), (F.col("doc_id") % 7).cast("string"))
    return R.table(spark, d, "documents").select("doc_id", P.content_hash(F.col("text")).alias("text_sha1"), P.file_slug(name).alias("file_slug"), P.web_slug(name).alias("web_slug"))


_L = P.LOCALES["en"]
_LIT = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_LENGTHS = "case length_bin " + " ".join(f"when '{k}' then {_LIT(v)}" for k, v in _L["lengths"].items()) + " end"


@query(
    _sql(
        f"""select id, md5(concat_ws(chr(10) || chr(10), {_LIT(_L['task'])}, {_LIT(chr(10).join('- ' + r for r in _L['requirements']) + chr(10) + '- ' + _L['style'] + _L['styles']['longform_qa'] + chr(10) + '- ' + _L['length'])} || {_LENGTHS},
 case when human_answer <> '' then {_LIT(_L['history'])} || chr(10) || {_LIT(_L['user'] + ' hello')} || chr(10) || {_LIT(_L['assistant'] + ' ')} || dataset end, {_LIT(_L['context'])} || chr(10) || dataset, {_LIT(_L['question'])} || chr(10) || human_answer,
 {_LIT(_L['format'] + chr(10) + _L['reasoning'] + ' <step-by-step reasoning that matches the requested bucket>' + chr(10) + _L['final'] + ' <final answer only>')}) || chr(10) || chr(10) || {_LIT(_L['reasoning'] + ' ')}) as prompt_md5,
 case length_bin when 'short' then 256 when 'medium' then 512 else 1000 end as most_tokens from records where human_answer <> ''"""
    )
)
def task_prompts(spark, d):
    """Prompts of one language's wording, each asking the document's text, and how long their answers may be."""
    rows = C._records(spark, d).where("human_answer <> ''")
    turn = lambda r, t: F.struct(F.lit(r).alias("role"), t.alias("text"))
    history = F.array(turn("user", F.lit(" hello")), turn("assistant", F.col("dataset")), turn("system", F.lit("no")), turn("user", F.col("human_answer")))
    language = P.prompt_language(F.lit("xx"), F.col("bucket_id"))
    task = P.task_prompt(language, F.lit("longform_qa"), F.col("length_bin"), F.col("human_answer"), F.col("dataset"), history)
    return rows.select("id", F.md5(P.open_prompt(task, language)).alias("prompt_md5"), P.most_tokens(F.col("length_bin"), 1000).alias("most_tokens"))


RUBRIC = P.Rubric({d: f"How well it does in {d}." for d in M.DIMENSIONS}, M.COMPOSITES)


@query(
    "select doc_id, "
    + ", ".join(
        f"case when {' + '.join(f'(doc_id % {k + 2} <> 0)::int * {w}' for k, w in ((list(M.DIMENSIONS).index(x), w) for x, w in ws.items()))} > 0 then round(({' + '.join(f'(doc_id % {k + 2} <> 0)::int * {w} * 100.0 * ((doc_id + {k}) % 5) / 4' for k, w in ((list(M.DIMENSIONS).index(x), w) for x, w in ws.items()))})::double / ({' + '.join(f'(doc_id % {k + 2} <> 0)::int * {w}' for k, w in ((list(M.DIMENSIONS).index(x), w) for x, w in ws.items()))})::double, 4) else 0 end as {c}"
        for c, ws in M.COMPOSITES.items()
    )
    + " from documents"
)
def partial_composites(spark, d):
    """Composites over the dimensions that a judge gave, weights renormalised."""
    given = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col("doc_id") % (k + 2) != 0, F.struct(F.lit(x), ((F.col("doc_id") + k) % 5 + 1).cast("int"))) for k, x in enumerate(M.DIMENSIONS)])))
    return R.table(spark, d, "documents").select("doc_id", given.alias("s")).select("doc_id", *[RUBRIC.composite(F.col("s"), c).alias(c) for c in M.COMPOSITES])


@query("select source as source_id, count(*) as n, count(*) filter (doc_id % 13 = 0) as n_errors, round(avg(n_chars % 500) filter (doc_id % 13 <> 0), 6) as prompt_tokens_mean, max(n_chars % 500) filter (doc_id % 13 <> 0) as prompt_tokens_max from documents group by 1")
def judge_usage(spark, d):
    """Errors and prompt tokens of a judge's calls, by source."""
    tokens = F.when(F.col("doc_id") % 13 != 0, F.col("n_chars") % 500)
    return R.table(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("n"), F.count_if(tokens.isNull()).alias("n_errors"), _r6(F.avg(tokens)).alias("prompt_tokens_mean"), F.max(tokens).alias("prompt_tokens_max"))


@query()
def masked_texts(spark, d):
    """Texts with spans of words masked, and how many marks each has."""
    text = P.masked(T.normalize_text(F.col("text")), F.col("doc_id"))
    return R.table(spark, d, "documents").select("doc_id", F.md5(text).alias("masked_md5"), F.regexp_count(text, F.lit(r"<extra_id_\d+>")).cast("long").alias("marks"))


@query()
def judge_prompts(spark, d):
    """What a judge is asked about each document as an answer, by digest."""
    rows = R.table(spark, d, "documents")
    none = F.array().cast("array<struct<role:string,text:string>>")
    asked = P.judge_prompt(RUBRIC, ["lang", "source"], none, F.col("source"), F.concat(F.lit("Write in "), "lang"), F.col("text"), F.col("text"))
    return rows.select("doc_id", F.md5(asked).alias("prompt_md5"))
