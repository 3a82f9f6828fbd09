"""Registered queries on alignment: places, pairs, inputs, scores.

Bindings: a document is a record at its place by id; the view repeats it with some
fields changed; predictions answer places, of which some are missing, doubled,
outside or unknown, and some repeat other fields than the record's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.operators import indexing as I
from tessera.operators import records as R
from tessera.plans import catalogue as C

query, _r6 = C.query, C._r6


def _i():
    return F.col("source_index")


_PAIRS = "array<array<string>>"


def _cur(spark, d):
    docs = I.with_row_index(R.table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    history = F.when(_i() % 4 == 0, F.array(F.array(F.col("lang"), F.col("source")))).otherwise(F.array().cast(_PAIRS))
    return docs.select("source_index", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Write in "), "lang").alias("question"), F.coalesce("source", F.lit("")).alias("context"), history.alias("history"), F.coalesce("text", F.lit("")).alias("human_answer"), F.col("lang").alias("language"), F.concat_ws("|", "lang", "source").alias("bucket_id"))


def _view(cur):
    pick = lambda n, other, same: F.when(_i() % n == 0, other).otherwise(F.col(same))
    history = F.when(_i() % 36 == 0, F.lit(None).cast(_PAIRS)).otherwise(F.col("history"))
    return cur.select("source_index", pick(101, F.lit("other"), "question").alias("instruction"), pick(67, F.lit(None).cast("string"), "context").alias("input"), history.alias("history"), pick(59, F.lit("x"), "human_answer").alias("output"))


def _preds(cur):
    """Predictions with every kind of defect."""
    odd = lambda n, other, same: F.when(_i() % n == 0, other).otherwise(same)
    said = odd(23, F.col("human_answer"), odd(19, F.lit(" \n"), F.concat(F.lit("Well: "), "human_answer")))
    rows = cur.select(
        "source_index", odd(11, F.lit("other"), F.col("question")).alias("instruction"), odd(17, F.lit(""), F.col("context")).alias("input"), odd(8, F.lit(None).cast(_PAIRS), F.col("history")).alias("history"),
        odd(13, F.lit("y"), F.col("human_answer")).alias("reference_output"), said.alias("prediction"), F.lit("m").alias("model_name"),
    )
    main, again, outside = rows.where(_i() % 5 != 0), rows.where(_i() % 50 == 1), rows.where(_i() % 97 == 0).withColumn("source_index", _i() + 100_000_000)
    return main.unionByName(again).unionByName(outside).unionByName(rows.where(_i() % 89 == 0).withColumn("source_index", F.lit(None).cast("long")))


ROWS = """cur as (select row_number() over (order by doc_id) - 1 as i, cast(doc_id as varchar) as id, 'Write in ' || lang as question, coalesce(source, '') as context, coalesce(text, '') as human_answer, lang as language, concat_ws('|', lang, source) as bucket_id,
 case when (row_number() over (order by doc_id) - 1) % 4 = 0 then lang || '/' || source else '' end as h from documents),
lf as (select i, case when i % 101 = 0 then 'other' else question end as instruction, case when i % 67 <> 0 then context end as input, case when i % 36 = 0 then '' else h end as h, case when i % 59 = 0 then 'x' else human_answer end as output from cur),
p0 as (select i, case when i % 11 = 0 then 'other' else question end as instruction, case when i % 17 = 0 then '' else context end as input, case when i % 8 = 0 then '' else h end as h, case when i % 13 = 0 then 'y' else human_answer end as reference_output,
 case when i % 23 = 0 then human_answer when i % 19 = 0 then ' ' || chr(10) else 'Well: ' || human_answer end as prediction from cur),
preds as (select * from p0 where i % 5 <> 0 union all select * from p0 where i % 50 = 1 union all select * replace (i + 100000000 as i) from p0 where i % 97 = 0 union all select * replace (null as i) from p0 where i % 89 = 0)
"""


@query(
    f"""with {ROWS}, m as (select p.*, l.i is not null as good, l.instruction as li, l.input as ln, l.h as lh, l.output as lo from preds p left join lf l on p.i = l.i)
 select (select count(*) from lf) as n_test_rows, (select count(*) from cur) as n_current_test_rows, (select count(*) from lf join cur using (i) where instruction is distinct from question) as current_instruction_mismatches,
 (select count(*) from lf join cur using (i) where input is distinct from context) as current_input_mismatches, (select count(*) from lf join cur using (i) where output is distinct from human_answer) as current_output_mismatches,
 (select count(*) from lf join cur using (i) where lf.h <> cur.h) as current_history_mismatches, count(*) as n_prediction_rows, count(*) filter (not good) as bad_index_rows, min(i) filter (good) as min_index, max(i) filter (good) as max_index,
 count(*) filter (good and instruction is distinct from li) as instruction_mismatches, count(*) filter (good and input is distinct from ln) as input_mismatches, count(*) filter (good and h <> lh) as history_mismatches, count(*) filter (good and reference_output is distinct from lo) as reference_output_mismatches,
 count(distinct i) filter (good) as unique_prediction_indices, count(*) filter (good) - count(distinct i) filter (good) as duplicate_prediction_rows, (select count(*) from lf) - count(distinct i) filter (good) as missing_index_count, 0::bigint as extra_index_count from m"""
)
def alignment_report(spark, d):
    cur = _cur(spark, d)
    return A.alignment_report(_view(cur), _preds(cur), cur)


@query(f"with {ROWS} select (select count(*) from lf) as n_test_rows, count(*) as n_current_test_rows, count(*) filter (instruction is distinct from question) as current_instruction_mismatches, count(*) filter (input is distinct from context) as current_input_mismatches, count(*) filter (output is distinct from human_answer) as current_output_mismatches, count(*) filter (lf.h <> cur.h) as current_history_mismatches from lf join cur using (i)")
def positional_check(spark, d):
    cur = _cur(spark, d)
    return A.positional_check(_view(cur), cur)


_N = lambda x: C._NORM.replace("coalesce(text,'')", f"coalesce({x},'')")
JUDGED = f"""j0 as (select p.i, c.i is not null as found, {_N('p.prediction')} as rejected, {_N('c.human_answer')} as chosen, c.bucket_id, c.language,
 {_N('p.instruction')} <> '' and {_N('p.instruction')} <> {_N('c.question')} as b1, {_N('p.input')} <> '' and {_N('p.input')} <> {_N('c.context')} as b2, {_N('p.reference_output')} <> '' and {_N('p.reference_output')} <> {_N('c.human_answer')} as b3 from preds p left join cur c on p.i = c.i),
judged as (select *, case when i is null then 'bad_index' when not found then 'out_of_range' when b1 or b2 or b3 then 'mismatch' when chosen = '' then 'empty_chosen' when rejected = '' then 'empty_rejected' when chosen = rejected then 'exact_match' else 'paired' end as status from j0)
"""


@query(f"with {ROWS}, {JUDGED} select i as source_index, bucket_id, md5(chosen) as chosen_md5, md5(rejected) as rejected_md5 from judged where status = 'paired'")
def lenient_pairs(spark, d):
    cur = _cur(spark, d)
    return A.lenient_pairs(A.judged_pairs(cur, _preds(cur))).select("source_index", F.col("r.bucket_id").alias("bucket_id"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


@query(
    f"""with {ROWS}, {JUDGED} select (select count(*) from cur) as source_records, count(*) as prediction_rows, count(distinct i) filter (status = 'paired') as covered_source_indices, (select count(*) from cur) - count(distinct i) filter (status = 'paired') as missing_source_indices,
 {', '.join(f"count(*) filter (status = '{s}') as {n}" for s, n in (('bad_index', 'skipped_missing_source_index'), ('out_of_range', 'skipped_out_of_range_source_index'), ('mismatch', 'skipped_mismatch'), ('empty_chosen', 'skipped_empty_chosen'), ('empty_rejected', 'skipped_empty_rejected'), ('exact_match', 'skipped_exact_match'), ('paired', 'paired_records')))},
 count(*) filter (status = 'mismatch' and b1) as mismatch_instruction, count(*) filter (status = 'mismatch' and b2) as mismatch_input, count(*) filter (status = 'mismatch' and b3) as mismatch_reference_output from judged"""
)
def pair_counters(spark, d):
    cur = _cur(spark, d)
    return A.pair_counters(A.judged_pairs(cur, _preds(cur)), cur.count())


@query(f"with {ROWS} select i as source_index, md5({_N('human_answer')}) as chosen_md5 from cur where {_N('human_answer')} <> '' and i % 23 <> 0")
def strict_pairs(spark, d):
    """Pairs of predictions without a defect; any defect fails the query."""
    cur = _cur(spark, d)
    clean = cur.select("source_index", F.col("question").alias("instruction"), F.col("context").alias("input"), "history", F.col("human_answer").alias("reference_output"), F.when(_i() % 23 == 0, F.col("human_answer")).otherwise(F.concat(F.lit("Well: "), "human_answer")).alias("prediction"))
    return A.strict_pairs(cur, clean).select("source_index", F.md5("chosen").alias("chosen_md5"))


@query(f"with {ROWS} select i as source_index, array_to_string(list_filter([case when instruction is distinct from question then 'text' end, case when i % 7 = 0 then 'weight' end], lambda x: x is not null), ',') as fields from lf join cur using (i) where instruction is distinct from question or i % 7 = 0")
def sample_alignment(spark, d):
    """Rows of two views of one sample that differ by text or weight."""
    cur = _cur(spark, d)
    left = cur.select("source_index", F.col("question").alias("text"), F.lit(0.5).alias("weight"))
    right = _view(cur).select("source_index", F.col("instruction").alias("text"), F.when(_i() % 7 == 0, 0.5 + 1e-7).otherwise(0.5 + 1e-9).alias("weight"))
    return A.sample_alignment(left, right, ["text"], "weight").select("source_index", F.array_join("fields", ",").alias("fields"))


@query(f"with {ROWS} select c.i as source_index, id, md5(prediction) as answer_md5, 'm' as prediction_model_name from preds p join cur c on p.i = c.i")
def generated_records(spark, d):
    cur = _cur(spark, d)
    return A.generated_records(cur, _preds(cur)).select("source_index", "id", F.md5("model_answer").alias("answer_md5"), "prediction_model_name")


@query(f"with {ROWS} select count(*) as prediction_rows, (select count(*) from cur where i % 9 <> 4) as prediction_feature_rows, (select count(*) from cur where i % 9 <> 4) as aligned_prediction_feature_rows, count(*) filter (i % 9 = 4) as missing_prediction_feature_rows, round(count(*) filter (i % 9 <> 4) / count(*), 8) as prediction_feature_coverage from cur")
def feature_coverage(spark, d):
    cur = _cur(spark, d).select("source_index", "id")
    return A.feature_coverage(cur, cur.where(_i() % 9 != 4))


@query(f"with {ROWS} select i as ordinal, id, length(human_answer) as chars from cur")
def record_feature_zip(spark, d):
    """Records and their features joined by place, ids checked."""
    cur = _cur(spark, d).withColumnRenamed("source_index", "ordinal")
    return A.strict_zip(cur.select("ordinal", "id"), cur.select("ordinal", "id", F.length("human_answer").cast("long").alias("chars")))


_SCORES = "select doc_id % 400 as source_index, doc_id as o, (n_chars % {0}) / {0}.0::double as score from documents where doc_id % {1} <> 0"


@query(f"with h as ({_SCORES.format(64, 3)}), m as ({_SCORES.format(32, 4)}) select * from (select source_index, arg_max(score, o) as human_score from h group by 1) join (select source_index, arg_max(score, o) as ai_score from m group by 1) using (source_index)")
def human_ai_scores(spark, d):
    docs = R.table(spark, d, "documents")
    side = lambda k, n: docs.where(F.col("doc_id") % n != 0).select((F.col("doc_id") % 400).alias("source_index"), F.col("doc_id").alias("o"), ((F.col("n_chars") % k) / float(k)).alias("score"))
    return A.human_ai_scores(side(64, 3), side(32, 4), "o")


def _source(cur):
    """A model's rows with their own numbers: some places missing or outside, some fields absent."""
    at = F.when(_i() % 31 == 0, F.lit(None).cast("long")).when(_i() % 37 == 0, F.lit(-1).cast("long")).when(_i() % 41 == 0, _i() + 1_000_000).otherwise(_i())
    said = F.when(_i() % 29 == 0, F.lit(" \r\n")).otherwise(F.concat("human_answer", F.lit(" \r\nend ")))
    return cur.select(_i().alias("row_number"), at.alias("source_index"), said.alias("candidate"), F.when(_i() % 3 == 0, F.col("question")).when(_i() % 3 == 1, F.lit("other")).alias("instruction"), F.lit(None).cast("string").alias("input"))


SOURCE = """src as (select i as n, case when i % 31 = 0 then null when i % 37 = 0 then -1 when i % 41 = 0 then i + 1000000 else i end as j, case when i % 29 = 0 then '' else human_answer || ' ' || chr(10) || 'end' end as candidate,
 case when i % 3 = 0 then question when i % 3 = 1 then 'other' end as instruction from cur), s1 as (select *, case when j >= 0 then j else n end as place from src)"""
_OUT = C.T.WS
_TRIM = lambda x: f"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^(?:{_OUT}|\\n)+|(?:{_OUT}|\\n)+\\z', '', 'g')"


@query(
    f"""with {ROWS}, {SOURCE} select place as source_index, n as source_row_index, 'm:' || n as source_uid, coalesce(c.id, '') as id, coalesce(c.language, '') as language, coalesce(s.instruction, l.instruction, c.question, '') as instruction, coalesce(l.input, c.context, '') as input,
 sha1({_TRIM('s.candidate')}) as candidate_sha1, sha1({_TRIM("coalesce(l.output, c.human_answer, '')")}) as reference_sha1 from s1 s left join cur c on c.i = place left join lf l on l.i = place"""
)
def judge_inputs(spark, d):
    cur = _cur(spark, d)
    rows = A.judge_inputs(_source(cur), cur, _view(cur), "m")
    return rows.select("source_index", "source_row_index", "source_uid", "id", "language", "instruction", "input", "candidate_sha1", "reference_sha1")


@query(
    f"""with {ROWS}, {SOURCE} select count(*) as n_rows, count(*) filter (j is null or j < 0) as bad_source_index_rows, count(*) filter (place >= (select count(*) from cur)) as out_of_range_rows, count(*) filter ({_TRIM('candidate')} = '') as empty_candidate_rows,
 count(*) filter (coalesce(instruction, '') <> '' and instruction is distinct from question) as instruction_mismatch_rows, count(*) - count(distinct place) as duplicate_source_index_rows, count(distinct place) as unique_source_indices from s1 left join cur c on c.i = place"""
)
def input_report(spark, d):
    cur = _cur(spark, d)
    return A.input_report(_source(cur), cur, cur.count())


@query("select conv_id, turn, case when turn % 3 <> 0 then role || ',' || (turn % 2) else '' end as acts from conversations")
def dialogue_acts(spark, d):
    turns = R.table(spark, d, "conversations").select(F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("turn_id"), "role")
    acts = turns.where("turn_id % 3 <> 0").select("dialogue_id", "turn_id", F.array("role", (F.col("turn_id") % 2).cast("string")).alias("dialogue_act_types"))
    return A.acts_of_turns(turns.drop("role"), acts).select(F.col("dialogue_id").alias("conv_id"), F.col("turn_id").alias("turn"), F.array_join("dialogue_act_types", ",").alias("acts"))


@query("select a.vec_id as source_index, round(list_dot_product(a.embedding, b.embedding)::double, 3) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 3 <> 0 and a.vec_id % 2 = 0")
def paired_embeddings(spark, d):
    """Vectors of two sides for sampled places that have both, and their product."""
    rows = R.table(spark, d, "embeddings").select(F.col("vec_id").alias("source_index"), "embedding")
    human, machine = rows.where("source_index % 3 <> 0"), rows.select((F.col("source_index") - 1).alias("source_index"), "embedding")
    both = A.paired_vectors(human, machine, rows.where("source_index % 2 = 0"))
    product = F.aggregate(F.zip_with("human_embedding", "model_embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return both.select("source_index", F.round(product, 3).alias("dot"))


@query(C._sql("select id from records where id not in (select source_index from preds where observed <> 'other') and ('u' || id) not in (select 'u' || (source_index + 1) from preds where observed = 'other')", C.ALIGN))
def resume_either_key(spark, d):
    """Rows done by neither of two keys: their place, or their name."""
    preds = C._predictions(spark, d)
    rows = R.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("uid"))
    by_place = preds.where("observed <> 'other'").select(F.col("source_index").alias("id"))
    by_name = preds.where("observed = 'other'").select(F.concat(F.lit("u"), (F.col("source_index") + 1).cast("string")).alias("uid"))
    return rows.join(by_place, "id", "left_anti").join(by_name, "uid", "left_anti").select("id")


@query(C._sql("select id, round(coalesce(w, 1.0), 8) as weight from records left join (select bucket_id, sum(count(*)) over () / (count(*) over () * count(*)) as w from records group by 1 having count(*) >= 20) using (bucket_id)"))
def weight_lookup(spark, d):
    """Each record's bucket weight, 1 where its bucket has none."""
    from tessera.operators import buckets as B

    rows = C._records(spark, d).select("id", "bucket_id")
    known = B.inverse_frequency(rows.join(rows.groupBy("bucket_id").count().where("count >= 20").select("bucket_id"), "bucket_id"), "bucket_id")
    return rows.join(known.select("bucket_id", "weight"), "bucket_id", "left").select("id", F.round(F.coalesce("weight", F.lit(1.0)), 8).alias("weight"))
