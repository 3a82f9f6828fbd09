"""Registered queries over model outputs: replies, prompts, scores, matching, dynamics.

Bindings: a reply is a document's text between an answer label and a later turn;
log-probabilities are minus a tenth of word lengths; detector scores are lengths.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import generation as G
from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import metrics as M
from tessera.operators import records as R
from tessera.plans import catalogue as C

query, _sql, _r6 = C.query, C._sql, C._r6



def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^{G.SPACE}+|{G.SPACE}+\z', '', 'g')"


_CUT = G.any_of(G.DIALECTS["dist_sft"].cuts)
_BAD = G.any_of(G.DIALECTS["dist_sft"].bad_starts)


def _replies(spark, d):
    docs = R.spread(R.table(spark, d, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.concat(F.lit(" Answer: "), text, F.lit("\r\nquestion\nUser: "), text).alias("reply"))


_REPLIES = "r0 as (select doc_id, ' Answer: ' || coalesce(text,'') || chr(13) || chr(10) || 'question' || chr(10) || 'User: ' || coalesce(text,'') as x from documents)"


@query(
    f"with {_REPLIES}, r1 as (select doc_id, regexp_replace({_stripped('x')}, '\\r\\n?', chr(10), 'g') as x from r0), "
    f"r2 as (select doc_id, regexp_replace(x, '(?s){_CUT}.*', '') as x from r1), r3 as (select doc_id, regexp_replace(regexp_replace(x, '^Answer:{G.SPACE}*', ''), '^Assistant:{G.SPACE}*', '') as x from r2), "
    f"r4 as (select doc_id, list_filter(list_transform(regexp_split_to_array(x, '{G.LINE_END}'), lambda l: {_stripped('l')}), lambda l: l <> '' and not regexp_matches(l, '^{_BAD}')) as a from r3) "
    f"select doc_id, md5({_stripped('array_to_string(a, chr(10))')}) as reply_md5, len(a)::bigint as n_lines from r4"
)
def clean_replies(spark, d):
    text = G.clean_reply(F.col("reply"), "dist_sft")
    rows = _replies(spark, d).select("doc_id", text.alias("x"))
    return rows.select("doc_id", F.md5("x").alias("reply_md5"), F.when(F.col("x") == "", 0).otherwise(F.size(F.split("x", "\n"))).cast("long").alias("n_lines"))


@query()
def clean_replies_by_dialect(spark, d):
    """Length of every reply under each of the five dialects."""
    made = [F.length(G.clean_reply(F.col("reply"), k)).cast("long").alias(k) for k in G.DIALECTS]
    return _replies(spark, d).select("doc_id", *made)


@query()
def final_answers(spark, d):
    return _replies(spark, d).select("doc_id", F.md5(G.final_answer(F.col("reply"))).alias("answer_md5"))


@query(f"select doc_id, md5(concat_ws(chr(10) || chr(10), 'Context:' || chr(10) || nullif({_stripped('source')}, ''), 'Question:' || chr(10) || nullif({_stripped('text')}, ''), 'Answer:')) as prompt_md5 from documents")
def plain_prompts(spark, d):
    none = F.lit(None).cast("array<array<string>>")
    return R.table(spark, d, "documents").select("doc_id", F.md5(G.plain_prompt(none, F.col("source"), F.col("text"))).alias("prompt_md5"))


@query(_sql(f"select bucket_id, '{G.PROFILE_SYSTEM}family=qa; track=single; style=longform_qa; length=' || length_bin || '.' as system, count(*) as n from records group by 1, 2"))
def system_prompts(spark, d):
    rows = C._records(spark, d)
    system = G.system_prompt(F.lit("qa"), F.lit("single"), F.lit("longform_qa"), F.col("length_bin"))
    return rows.groupBy("bucket_id", system.alias("system")).agg(F.count("*").alias("n"))


@query(
    _sql(
        """select id, len(v)::bigint as scored_token_count, round(sum_, 6) as logprob_sum, round(-mean, 6) as nll_mean, round(exp(least(-mean, 50)), 6) as perplexity,
 round(case when len(v) > 1 then list_stddev_pop(v) else 0 end, 6) as surprisal_std, round(-list_max(v), 6) as surprisal_min, round(-list_min(v), 6) as surprisal_max
 from (select id, v, list_sum(v) as sum_, list_sum(v) / len(v) as mean from v0)""",
        f"v0 as (select id, list_transform({C._TOKENS}, lambda t: -length(t) / 10.0::double) as v from records where n_tokens > 0)",
    )
)
def lm_score_summary(spark, d):
    rows = C._records(spark, d).where("n_tokens > 0").select("id", F.transform(T.tokens(F.col("human_answer")), lambda t: -F.length(t) / F.lit(10.0)).alias("v"))
    rows = rows.select("id", G.lm_summary(F.col("v"), F.size("v")).alias("s"))
    return rows.select("id", "s.scored_token_count", "s.logprob_sum", "s.nll_mean", "s.perplexity", "s.surprisal_std", "s.surprisal_min", "s.surprisal_max")


@query(
    rf"""select doc_id, case when x = '' then 0 else len(regexp_extract_all(x, '{G.CJK}')) + greatest((strlen(r) + 3) // 4, len(regexp_extract_all(r, '[\p{{L}}\p{{N}}_]+')) + len(regexp_extract_all(regexp_replace(r, '{G.SPACE}', '', 'g'), '[^\p{{L}}\p{{N}}_]'))) + 8 end::bigint as tokens
 from (select doc_id, x, regexp_replace(x, '{G.CJK}', '', 'g') as r from (select doc_id, coalesce(text, '') as x from documents))"""
)
def chat_token_estimate(spark, d):
    return R.table(spark, d, "documents").select("doc_id", G.token_estimate(F.col("text"), F.lit(1)).alias("tokens"))


_DENSITY = "exp(-0.5 * ((x - {0}) / {1}) ** 2) / ({1} * sqrt(2 * pi()))"


@query(f"select doc_id, round(case when h + m > 0 then m / (h + m) else 0 end, 6) as probability from (select doc_id, {_DENSITY.format(*G.CURVATURE['human'])} as h, {_DENSITY.format(*G.CURVATURE['machine'])} as m from (select doc_id, (n_chars % 97) / 10.0 - 3 as x from documents))")
def curvature_probability(spark, d):
    x = (F.col("n_chars") % 97) / F.lit(10.0) - 3
    return R.table(spark, d, "documents").select("doc_id", _r6(G.machine_probability(x)).alias("probability"))


def _detected(spark, d):
    score = F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") % 101).cast("double") / 128)
    return R.table(spark, d, "documents").select(F.col("source").alias("source_id"), score.alias("score_ai"), (score > 0.4).alias("predicted_ai"))


@query(
    "select source_id, count(s) as n_scored, count(*) - count(s) as n_errors_or_unscored, count(*) filter (s > 0.4) as predicted_ai_count, count(*) filter (s <= 0.4) as predicted_human_count, round(count(*) filter (s > 0.4) / nullif(count(s), 0), 6) as predicted_ai_rate, round(avg(s), 6) as score_ai_mean from (select source as source_id, case when doc_id % 11 <> 0 then (n_chars % 101)::double / 128 end as s from documents) group by 1"
)
def detector_summary(spark, d):
    return E.detector_summary(_detected(spark, d))


@query("select count(*) as n_sources, min(n) as least, max(n) as most, count(distinct n) <= 1 as consistent from (select count(*) as n from documents group by source)")
def row_count_check(spark, d):
    return E.row_counts_agree(_detected(spark, d))


@query(
    """select round(min(least(a, b)), 6) as score_min, round(max(greatest(a, b)), 6) as score_max, round(max(greatest(a, b)) - min(least(a, b)), 6) as score_range,
 round(sqrt((sum(a * a) + sum(b * b)) / (2 * count(*)) - ((sum(a) + sum(b)) / (2 * count(*))) ** 2), 6) as score_std, count(*) filter (abs(a - b) <= 1e-10) as equal_score_records,
 count(*) filter (lang <> source) as distinct_text_pairs, count(*) filter (lang <> source and abs(a - b) <= 1e-10) as distinct_text_equal_score_records, max(greatest(a, b)) - min(least(a, b)) <= 1e-10 as all_scores_tied,
 count(*) filter (lang <> source) >= 4 and count(*) filter (lang <> source) = count(*) filter (lang <> source and abs(a - b) <= 1e-10) as collapsed
 from (select lang, source, (n_chars % 16) / 16.0::double as a, (doc_id % 16) / 16.0::double as b from documents)"""
)
def score_diagnostics(spark, d):
    docs = R.table(spark, d, "documents")
    return E.score_diagnostics(docs.select(F.col("lang").alias("chosen"), F.col("source").alias("rejected"), ((F.col("n_chars") % 16) / 16.0).alias("chosen_score"), ((F.col("doc_id") % 16) / 16.0).alias("rejected_score")))


@query(
    """with a as (select doc_id as l, lang || n_chars % 40 as e, lang || n_chars % 7 as p from documents), b as (select doc_id as r, lang || (case when doc_id % 3 = 0 then n_chars else n_chars + 1 end) % 40 as e, lang || n_chars % 7 as p from documents),
 t1 as (select l, r, 'position_exact' as tier from a join b on l = r and a.e = b.e),
 a2 as (select *, row_number() over (partition by e order by l) as n from a where l not in (select l from t1)), b2 as (select *, row_number() over (partition by e order by r) as n from b where r not in (select r from t1)),
 t2 as (select l, r, 'signature_exact' as tier from a2 join b2 using (e, n)),
 a3 as (select l, p, row_number() over (partition by p order by l) as n from a2 where l not in (select l from t2)), b3 as (select r, p, row_number() over (partition by p order by r) as n from b2 where r not in (select r from t2)),
 t3 as (select l, r, 'prompt_fallback' as tier from a3 join b3 using (p, n)),
 t as (select * from t1 union all select * from t2 union all select * from t3)
 select a.l, coalesce(r, -1) as r, coalesce(tier, 'missing') as tier from a left join t on a.l = t.l"""
)
def tiered_match(spark, d):
    docs = R.table(spark, d, "documents")
    prompt = F.concat("lang", (F.col("n_chars") % 7).cast("string")).alias("prompt")
    sign = lambda n: F.concat("lang", (n % 40).cast("string")).alias("exact")
    moved = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 1)
    index = F.col("doc_id").alias("index")
    return E.tiered_match(docs.select(index, sign(F.col("n_chars")), prompt), docs.select(index, sign(moved), prompt)).withColumn("r", F.coalesce("r", F.lit(-1)))


@query()
def tdm(spark, d):
    """Turn dynamics of answers; the generated turn is the question with half the answer's words."""
    rows = R.turn_records(R.table(spark, d, "conversations"))
    ident = F.xxhash64("conv_id", "turn")
    words = F.split("human_answer", " ")
    generated = F.concat_ws(" ", "question", F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " "))
    return E.turn_dynamics(rows.select(ident.alias("id"), F.lit("multi").alias("bucket_id"), "question", F.col("human_answer").alias("human"), generated.alias("generated")), least=2)


@query()
def pca_index(spark, d):
    """Naturalness index of buckets from coverage and mean gap, against token F1."""
    known = C.queries()
    gaps = known["wasserstein_bng"](spark, d).groupBy("bucket_id").agg(F.avg("gap").alias("bng"))
    use = known["utility_em_f1"](spark, d).where("bucket_id is not null").select("bucket_id", F.col("qa_f1").alias("utility_qa_f1"))
    table = use.join(known["human_coverage"](spark, d).select("bucket_id", "hcr"), "bucket_id", "left").join(gaps, "bucket_id", "left")
    return E.naturalness_index(table, "utility_qa_f1", ["bng", "hcr"])


@query()
def stage_trend(spark, d):
    """Trend of mean judge composites; sources stand for stages."""
    rows = C.queries()["judge_summary"](spark, d).where("judge = 1")
    place = F.dense_rank().over(Window.orderBy("source_id"))
    stage = F.element_at(F.array(*[F.lit(s) for s in M.STAGES]), (place % len(M.STAGES) + 1).cast("int"))
    return E.stage_trend(rows.select(F.lit("m").alias("model_key"), stage.alias("stage"), "overall"), "overall")
