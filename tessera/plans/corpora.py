"""Registered queries over whole corpora: records, deduplication, places, samples, shards.

Bindings: documents are single-turn records asked by their language; assistant
turns of conversations are records of a dialogue dataset whose groups are the
conversations, split turn by turn so that groups have conflicts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus as K
from tessera.operators import indexing as I
from tessera.operators import records as R
from tessera.plans import catalogue as C

query, _r6 = C.query, C._r6


def corpus_records(spark, d):
    """(records with an ordinal) of both tables."""
    docs = R.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("dataset"), T.choose_split(T.hash_fraction(R.SEED, F.col("doc_id")), R.SPLITS).alias("split"), F.col("lang").alias("language"),
        F.lit("single").alias("track"), F.lit("qa").alias("family"), F.lit("longform_qa").alias("style_bucket"), F.concat(F.lit("Write in "), "lang").alias("question"), F.lit("").alias("context"),
        F.array().cast(K.TURNS).alias("dialogue_history"), F.col("text").alias("human_answer"), F.lit(None).cast("string").alias("dialogue_id"), F.col("doc_id").alias("ordinal"),
    )
    turns = R.turn_records(R.table(spark, d, "conversations"))
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = turns.select(
        key.alias("id"), F.lit("dailydialog").alias("dataset"), T.choose_split(T.hash_fraction(R.SEED, key), R.SPLITS).alias("split"), F.lit("en").alias("language"), F.lit("multi").alias("track"),
        F.lit("dialogue").alias("family"), F.lit("open_chat").alias("style_bucket"), "question", F.lit("").alias("context"), F.col("history").alias("dialogue_history"), "human_answer",
        F.col("conv_id").cast("string").alias("dialogue_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
    )
    rows = docs.unionByName(turns)
    made = K.build_records(rows, {"dialogue_id": F.col("dialogue_id"), "ordinal": F.col("ordinal")})
    return made.withColumn("ordinal", F.get_json_object("meta", "$.ordinal").cast("long"))


_SPLIT_OF = lambda key: C._SPLIT.format(C._FRACTION.format(key))
CORPUS = f"""{C.TURNS}, d0 as (select doc_id, source, lang, {C._NORM} as a from documents),
c0 as (select cast(doc_id as varchar) as id, source as dataset, {_SPLIT_OF('doc_id')} as split, lang as language, 'single' as track, 'qa' as family, 'Write in ' || lang as question, '' as h, a as human_answer, null as grp, doc_id as ordinal from d0
 union all select conv_id || '/' || turn, 'dailydialog', {_SPLIT_OF("(conv_id || '/' || turn)")}, 'en', 'multi', 'dialogue', question,
  array_to_string(list_transform(list_filter(history, lambda t: t.role <> '' and t.text <> ''), lambda t: lower(t.role) || chr(1) || lower(t.text)), chr(2)), human_answer, cast(conv_id as varchar), conv_id * 1000 + turn from turns),
c1 as (select *, {C._PRIO.format('split')} as prio, case when grp is null then false else split <> arg_min(split, {C._PRIO.format('split')}) over (partition by dataset, grp) end as conflict from c0),
c2 as (select *, first_value(struct_pack(d := dataset, s := split, o := ordinal)) over (partition by lower(language), lower(track), lower(family), lower(question), lower(human_answer), h order by prio, dataset, split, ordinal) as k from c1 where not conflict),
marked as (select *, k.d = dataset and k.s = split and k.o = ordinal as kept from c2 union all select *, null, false from c1 where conflict)
"""


@query(f"with {CORPUS} select id, dataset, split, conflict as group_conflict, kept as is_kept, case when not conflict then k.d end as kept_dataset, coalesce(case when not conflict then k.o end, -1) as kept_ordinal from marked")
def dedup_records(spark, d):
    """Which record stays for each: group conflicts first, then the first seen of seven equal fields."""
    rows = K.mark_duplicates(corpus_records(spark, d))
    return rows.select("id", "dataset", "split", "group_conflict", K.is_kept().alias("is_kept"), F.col("kept.dataset").alias("kept_dataset"), F.coalesce("kept.ordinal", F.lit(-1)).alias("kept_ordinal"))


_GONE = "not conflict and not kept"


@query(
    f"""with {CORPUS} select count(*) as original_total, count(*) filter (kept) as final_total, count(*) - count(*) filter (kept) as removed_total, round((count(*) - count(*) filter (kept)) / count(*), 6) as duplicate_rate,
 count(*) filter (conflict) as group_split_conflicts_removed, count(*) filter ({_GONE}) as exact_duplicates_removed, count(*) filter ({_GONE} and split = k.s) as same_split_duplicates_removed,
 count(*) filter ({_GONE} and split <> k.s) as cross_split_duplicates_removed, count(*) filter ({_GONE} and dataset <> k.d) as cross_dataset_duplicates_removed from marked"""
)
def dedup_report(spark, d):
    return K.removal_report(K.mark_duplicates(corpus_records(spark, d)))


@query(f"with {CORPUS} select dataset, split, count(*) as original, count(*) filter (kept) as final from marked group by 1, 2")
def dedup_manifests(spark, d):
    return K.manifests(K.mark_duplicates(corpus_records(spark, d)))


@query(f"with {CORPUS} select id, dataset, split from c1 where conflict")
def group_conflicts(spark, d):
    return K.mark_duplicates(corpus_records(spark, d)).where("group_conflict").select("id", "dataset", "split")


@query(
    f"""with {CORPUS}, n as (select *, len(regexp_extract_all(human_answer, $t${T.TOKEN}$t$)) as n_tokens from c0), b as (select *, case when n_tokens<=40 then 'short' when n_tokens<=120 then 'medium' when n_tokens<=240 then 'long' else 'xlong' end as length_bin from n)
 select id, dataset, split, language, track, family, case when track = 'multi' then 'open_chat' else 'longform_qa' end as style_bucket, length_bin, md5(question) as question_md5, md5(human_answer) as answer_md5, concat_ws('|', language, track, family, length_bin) as bucket_id, n_tokens::bigint as length_tokens, grp as dialogue_id from b"""
)
def full_records(spark, d):
    """Records in the whole schema; texts as digests."""
    meta = lambda field, kind: F.get_json_object("meta", f"$.{field}").cast(kind).alias(field)
    return corpus_records(spark, d).select(
        "id", "dataset", "split", "language", "track", "family", "style_bucket", "length_bin", F.md5("question").alias("question_md5"), F.md5("human_answer").alias("answer_md5"), "bucket_id", meta("length_tokens", "bigint"), meta("dialogue_id", "string")
    )


@query(f"with {CORPUS} select case split when 'dev' then 'val' else split end as split, dataset, count(*) as n, sum(ordinal)::bigint as ordinals from c0 where split in ('train', 'dev', 'test') group by 1, 2")
def merged_splits(spark, d):
    """Rows of the merged views by split, dev renamed."""
    rows = corpus_records(spark, d).select("split", "dataset", "ordinal")
    whole = [K.merged_split(rows, s) for s in ("train", "val", "test")]
    return whole[0].unionByName(whole[1]).unionByName(whole[2]).groupBy("split", "dataset").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def _indexed(spark, d):
    return I.with_row_index(R.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


_IDX = "with i as (select doc_id, lang, source, row_number() over (order by doc_id) - 1 as source_index from documents) "


@query(_IDX + "select doc_id, source_index from i")
def row_index(spark, d):
    return _indexed(spark, d).select("doc_id", "source_index")


@query(_IDX + "select doc_id, source_index from i order by source_index limit 25")
def first_rows(spark, d):
    return I.first_n(_indexed(spark, d).select("doc_id", "source_index"), "source_index", 25)


@query(_IDX + "select doc_id, source_index from (select * from i order by md5('42:' || source_index), source_index limit 50)")
def random_rows(spark, d):
    return I.random_n(_indexed(spark, d).select("doc_id", "source_index"), "source_index", 50)


@query(_IDX + ", t as (select count(*) as n from i) select doc_id, case when source_index >= 30 then floor((source_index - 30) / ceil((n - 30) / 7))::bigint else -1 end as shard from i, t")
def tail_shards(spark, d):
    rows = _indexed(spark, d)
    return rows.select("doc_id", F.coalesce(I.tail_shards(F.col("source_index"), 30, rows.count(), 7).cast("long"), F.lit(-1)).alias("shard"))


@query("select source, count(*) as n from documents where source in (select source from (select source, row_number() over (order by source) - 1 as i from (select distinct source from documents)) where i % 3 = 1) group by 1")
def source_shards(spark, d):
    """Documents of the second of three shards of the sources."""
    docs = R.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_set("source"))
    named = docs.agg(ordered.alias("names")).select(F.posexplode("names").alias("i", "source")).where(I.source_shard(F.col("i"), 3, 1))
    return docs.join(named.select("source"), "source")


@query(_IDX + "select floor(source_index / 64)::bigint as batch, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from i group by 1")
def batches(spark, d):
    rows = _indexed(spark, d).withColumn("batch", I.batch_of(F.col("source_index"), 64).cast("long"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("select vec_id, label from (select *, row_number() over (partition by label order by md5('42:' || vec_id), vec_id) as r from embeddings) where r <= 5")
def choice_without_replacement(spark, d):
    return I.choice(R.table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 5)


@query("select source_index, arg_min(observed, p) as first_seen, arg_max(observed, p) as last_seen from (select doc_id % 300 as source_index, lang || doc_id as observed, doc_id as p from documents) group by 1")
def duplicate_indices(spark, d):
    """The first and the last of rows with one index."""
    rows = R.table(spark, d, "documents").select((F.col("doc_id") % 300).alias("source_index"), F.concat("lang", F.col("doc_id").cast("string")).alias("observed"), F.col("doc_id").alias("p"))
    first = I.keep_one(rows, ["source_index"], "p").select("source_index", F.col("observed").alias("first_seen"))
    last = I.keep_one(rows, ["source_index"], "p", last=True).select("source_index", F.col("observed").alias("last_seen"))
    return first.join(last, "source_index")
