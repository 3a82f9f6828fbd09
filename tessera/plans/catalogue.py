"""The registered queries, and the SQL that each is held against.

Bindings to the test tables: documents are single-turn records (dataset = source,
language = lang, split by hash of the id), conversations give multi-turn ones; a
record's *prediction* is its own answer with every third word replaced; *judge replies* are JSON texts of scores drawn from a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions import text as T
from tessera.operators import buckets as B
from tessera.operators import metrics as M
from tessera.operators import records as R
from tessera.operators.trees import chains as tree_chains

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LEAST = 20
#: Item keys up to which a text's n-grams are filtered before they leave it.
LEAK_KEYS = 2_000

_LINES = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''),'\r\n?',chr(10),'g'),'{T.WS}+',' ','g'),' *\n *',chr(10),'g'),'^[ \n]+|[ \n]+\z','','g')"""
_NORM = rf"""regexp_replace({_LINES},'\n{{3,}}',chr(10)||chr(10),'g')"""
_FRACTION = "(cast('0x' || substr(md5('42:' || {0}),1,8) as bigint) / 4294967295)"
_SPLIT = "case when {0} <= 0.9 then 'train' when {0} <= 0.9 + 0.05 then 'dev' else 'test' end"
_TOKENS = f"regexp_extract_all(human_answer, $t${T.TOKEN}$t$)"

RECORDS = f"""
r0 as (select doc_id as id, source as dataset, lang as language, {_NORM} as human_answer, {_FRACTION.format('doc_id')} as f from documents),
r1 as (select *, cast(len({_TOKENS}) as bigint) as n_tokens, {_SPLIT.format('f')} as split from r0),
r2 as (select *, case when n_tokens<=40 then 'short' when n_tokens<=120 then 'medium' when n_tokens<=240 then 'long' else 'xlong' end as length_bin from r1),
records as (select id, dataset, language, human_answer, n_tokens, length_bin, split, concat_ws('|', language, 'single', 'qa', length_bin) as bucket_id from r2)
"""


def _sql(body: str, *ctes: str) -> str:
    return "with " + ",".join((RECORDS, *ctes)) + body


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.single_records(R.table(spark, d, "documents"))


def _r6(c: Column | str) -> Column:
    return F.round(c, 6)


@query(_sql("select id, md5(human_answer) as answer_md5, n_tokens, length_bin, bucket_id from records"))
def normalize_records(spark, d):
    return _records(spark, d).select("id", F.md5("human_answer").alias("answer_md5"), "n_tokens", "length_bin", "bucket_id")


@query(_sql("select language, length_bin, count(*) as n, sum(n_tokens)::bigint as tokens from records group by 1, 2"))
def token_length_bins(spark, d):
    return _records(spark, d).groupBy("language", "length_bin").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))


@query(_sql("select id, split from records"))
def hash_split(spark, d):
    rows = R.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return rows.select("id", T.choose_split(T.hash_fraction(R.SEED, F.col("id")), R.SPLITS).alias("split"))


@query(f"select conv_id, turn, {_SPLIT.format(_FRACTION.format('conv_id'))} as split from conversations")
def group_split(spark, d):
    return R.table(spark, d, "conversations").select("conv_id", "turn", T.choose_split(T.hash_fraction(R.SEED, F.col("conv_id")), R.SPLITS).alias("split"))


@query()
def balanced_sample(spark, d):
    rows = _records(spark, d).select("id", "bucket_id")
    return M.balanced_sample(rows, "bucket_id", "id", 200, F.md5(F.col("id").cast("string")))


_PRIO = "case {0} when 'test' then 0 when 'validation2' then 1 when 'dev' then 2 when 'train' then 3 else 99 end"
@query(_sql(f"select id, split, arg_min(split, {_PRIO.format('split')}) over (partition by dataset, n_tokens % 50) as best from records"))
def group_best_split(spark, d):
    rows = _records(spark, d).withColumn("group", F.concat_ws("|", "dataset", F.col("n_tokens") % 50))
    return R.best_group_split(rows, "group").select("id", "split", "best")


@query(
    """select doc_id, count(*) as n_items from documents d, lateral (select item_id from benchmark b where b.text <> '' and contains(lower(d.text), lower(b.text))) group by doc_id"""
)
def benchmark_leak(spark, d):
    """Documents that hold the text of a benchmark item.

    Items are found by up to eight of their inner words and verified whole: an
    equi-join on hashes, one width at a time, verified beside the text.  Only items of
    under three words, which have no inner word, are compared with each document.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = R.table(spark, d, "benchmark").where("text <> ''").select("item_id", F.lower("text").alias("needle")).withColumn("w", words(F.col("needle")))
    width = F.least(F.lit(8), F.greatest(F.lit(0), F.size("w") - 2))
    items = items.select("item_id", "needle", width.alias("k"), T.gram_key(F.slice("w", F.lit(2), width)).alias("key"))
    docs = R.spread(R.table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.lower("text").alias("hay"))
    hashed = docs.select("doc_id", "hay", T.word_hashes(words(F.col("hay"))).alias("h"))
    found = []
    for k in sorted(r[0] for r in items.select("k").where("k > 0").distinct().collect()):  # at most eight widths
        of = items.where(F.col("k") == k)
        keys = [r[0] for r in of.select("key").distinct().limit(LEAK_KEYS + 1).collect()]
        grams = F.array_distinct(T.gram_hashes(F.col("h"), k))
        if len(keys) <= LEAK_KEYS:  # few items: only their own grams leave a text
            grams = F.array_intersect(grams, F.array(*[F.lit(x) for x in keys]))
        met = hashed.select("doc_id", "hay", F.explode(grams).alias("key")).join(of.select("item_id", "needle", "key"), "key")
        found.append(met.where(F.contains("hay", "needle")).select("doc_id", "item_id"))
    if items.where("k = 0").limit(1).count():
        found.append(docs.join(items.where("k = 0"), F.contains("hay", "needle")).select("doc_id", "item_id"))
    if not found:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_items")).limit(0)
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole.distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"))


TURNS = f"""
t0 as (select conv_id, turn, role, {_NORM} as text from conversations),
t1 as (select *, list({{'role': role, 'text': text}}) over w as history, last_value(case when role='user' then text end ignore nulls) over w as q
 from t0 window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
turns as (select conv_id, turn, coalesce(q, '') as question, history, text as human_answer from t1 where role = 'assistant' and len(history) > 0)
"""


@query(f"with {TURNS} select conv_id, turn, md5(question) as question_md5, len(history)::bigint as n_history, len(regexp_extract_all(human_answer, $t${T.TOKEN}$t$))::bigint as n_tokens from turns")
def multi_turn_records(spark, d):
    rows = R.turn_records(R.table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", F.md5("question").alias("question_md5"), F.size("history").cast("long").alias("n_history"), "n_tokens")


@query(
    f"""with {TURNS}, e as (select conv_id, turn, question, unnest(history) as t, generate_subscripts(history, 1) as k, len(history) as n from turns),
 f as (select conv_id, turn, k, t.role as role, t.text as text from e where t.text <> '' and not (k = n and t.role = 'user' and t.text = question)),
 g as (select *, max(k) filter (role = 'assistant') over w as said, max(k) filter (role = 'user') over w as asked from f window w as (partition by conv_id, turn order by k rows between unbounded preceding and 1 preceding))
 select g.conv_id, g.turn, (row_number() over (partition by g.conv_id, g.turn order by g.k) - 1)::int as i, u.text as user, g.text as assistant from g join f u on u.conv_id = g.conv_id and u.turn = g.turn and u.k = g.asked where g.role = 'assistant' and g.asked > coalesce(g.said, 0)"""
)
def history_pairs(spark, d):
    rows = R.turn_records(R.table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", R.history_pairs(F.col("history"), F.col("question")).alias("p")).select("conv_id", "turn", F.posexplode("p").alias("i", "pair")).select("conv_id", "turn", "i", F.get("pair", F.lit(0)).alias("user"), F.get("pair", F.lit(1)).alias("assistant"))


@query()
def alpaca_view(spark, d):
    return R.alpaca_view(R.turn_records(R.table(spark, d, "conversations")))


@query(_sql("select bucket_id, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 8) as weight from records group by bucket_id"))
def dist_sft_weights(spark, d):
    return B.inverse_frequency(_records(spark, d), "bucket_id")


_NIF = "greatest(0, sum(count(*)) over () / (count(*) over () * count(*)) - 1)"


@query(
    _sql(
        """select id, round(least(greatest(1.0 + b.g / nullif(max(b.g) over (), 0) + greatest(0, (id % 7) / 10.0 - 0.3) + 0.5 * l.g + 0.5 * (id % 3 = 0)::int, 0.5), 3.0), 8) as hdpo_weight
 from records join b using (bucket_id) join l using (language) where split = 'train'""",
        f"b0 as (select bucket_id, {_NIF} as g from records where split='train' group by 1), b as (select bucket_id, g from b0)",
        f"l0 as (select language, {_NIF} as g from records where split='train' group by 1), l as (select language, case when max(g) over () > 0 then g / max(g) over () else 0 end as g from l0)",
    )
)
def hdpo_weights(spark, d):
    rows = _records(spark, d).where("split = 'train'")
    bucket = B.normalized_inverse_frequency(rows, "bucket_id").withColumnRenamed("gap", "g")
    language = B.normalized_inverse_frequency(rows, "language").withColumnRenamed("gap", "l")
    joined = rows.join(F.broadcast(bucket), "bucket_id").join(F.broadcast(language), "language")
    margin, pair = (F.col("id") % 7) / 10.0 - 0.3, (F.col("id") % 3 == 0).cast("int")
    return joined.select("id", B.pair_weight(F.col("g"), margin, F.col("l"), pair).alias("hdpo_weight"))


_F = f"""f0 as (select id, bucket_id, human_answer as a, n_tokens, {_TOKENS} as t from records),
f1 as (select *, list_filter(t, lambda x: regexp_full_match(x, $t$[A-Za-z]+(?:'[A-Za-z]+)?$t$)) as e from f0)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("id", "bucket_id", F.col("human_answer").alias("a"), "n_tokens", T.tokens(F.col("human_answer")).alias("t"))
    return rows.withColumn("e", F.filter("t", lambda x: x.rlike(r"^[A-Za-z]+(?:'[A-Za-z]+)?\z")))


@query(
    _sql(
        r"""select id, length(a) as chars, length(replace(replace(a,' ',''),chr(10),'')) as chars_no_space, length(a)-length(replace(a,chr(10),'')) as newlines,
 len(regexp_extract_all(a,'\p{Nd}'))::bigint as digits, len(regexp_extract_all(a,'\p{L}'))::bigint as letters, len(regexp_extract_all(a,'[^\x00-\x7f]'))::bigint as non_ascii,
 len(regexp_extract_all(a,'[.!?]'))::bigint as terminals, len(regexp_extract_all(a,'[,;:]'))::bigint as commas, n_tokens,
 len(list_filter(t, lambda x: length(x) <= 3))::bigint as short_tokens, len(list_filter(t, lambda x: length(x) >= 7))::bigint as long_tokens,
 len(regexp_extract_all(a,'https?://[^\s]+'))::bigint as urls, round(case when n_tokens > 0 then len(e) / n_tokens else 0 end, 6) as english_ratio from f1""",
        _F,
    )
)
def text_features_core(spark, d):
    count = lambda p: F.regexp_count("a", F.lit(p)).cast("long")
    bare = F.regexp_replace("a", "[ \n]", "")
    return _features(spark, d).select(
        "id", F.length("a").cast("long").alias("chars"), F.length(bare).cast("long").alias("chars_no_space"), count("\n").alias("newlines"), count(r"\p{Nd}").alias("digits"),
        count(r"\p{L}").alias("letters"), count(r"[^\x00-\x7f]").alias("non_ascii"), count("[.!?]").alias("terminals"), count("[,;:]").alias("commas"), "n_tokens",
        F.size(F.filter("t", lambda x: F.length(x) <= 3)).cast("long").alias("short_tokens"), F.size(F.filter("t", lambda x: F.length(x) >= 7)).cast("long").alias("long_tokens"),
        count(r"https?://[^\s]+").alias("urls"), _r6(T.safe_div(F.size("e"), F.col("n_tokens"))).alias("english_ratio"),
    )


_BARE = "regexp_replace(x, '[^a-z]', '', 'g')"
_SYL = f"case when length({_BARE}) <= 3 then 1 else greatest(1, len(regexp_extract_all({_BARE},'[aeiouy]+')) - regexp_matches({_BARE}, '[^ly]e$')::int) end"
_READ = f"""g0 as (select id, a, list_transform(list_filter(t, lambda x: regexp_matches(x, '{X.LEXICAL}')), lambda x: lower(x)) as w, list_transform(e, lambda x: lower(x)) as e,
 len(list_filter(regexp_split_to_array(regexp_replace(a, '({X.TERMINAL})', '\\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> ''))::double as s from f1),
g1 as (select *, list_transform(e, lambda x: {_SYL}) as b from g0),
g2 as (select id, len(e)::double as n, len(w) / s as per, s, coalesce(list_sum(b), 0)::double as y, len(list_filter(b, lambda k: k >= 3))::double as many, len(regexp_extract_all(a, '\\p{{L}}')) as letters, length(regexp_replace(a, '[ \n]', '', 'g')) as solid from g1)"""


@query(
    _sql(
        """select id, case when n > 0 then round(206.835 - 1.015 * per - 84.6 * (y / n), 6) else 0 end as flesch, case when n > 0 then round(0.39 * per + 11.8 * (y / n) - 15.59, 6) else 0 end as fk_grade,
 case when n > 0 then round(0.4 * (per + 100 * (many / n)), 6) else 0 end as fog, case when n > 0 and many > 0 then round(1.043 * sqrt(many * (30 / s)) + 3.1291, 6) else 0 end as smog,
 case when n > 0 then round(0.0588 * (letters / n * 100) - 0.296 * (s / n * 100) - 15.8, 6) else 0 end as coleman_liau, case when n > 0 then round(4.71 * (solid / n) + 0.5 * per - 21.43, 6) else 0 end as ari from g2""",
        _F,
        _READ,
    )
)
def readability(spark, d):
    return X.with_arrays(_records(spark, d), "human_answer").select("id", *X.readability())


@query(_sql("select id, " + ", ".join(f"len(regexp_extract_all(a, '{p}'))::bigint as {n}" for n, p in X.COUNTED.items()) + " from f1", _F))
def surface_counts(spark, d):
    return X.with_arrays(_records(spark, d), "human_answer").select("id", *X.counted(X.COUNTED))


@query()
def shape_features(spark, d):
    """Features that look around or back, and those of tokens, words and sentences."""
    return X.with_arrays(_records(spark, d), "human_answer").select("id", *X.counted(X.LOOKING), *X.token_counts(), *X.word_features(), *X.sentence_features())


LONG = """long as (select id, bucket_id, 'chars' as feature, length(human_answer)::double as value from records union all select id, bucket_id, 'tokens', n_tokens::double from records
 union all select id, bucket_id, 'newlines', (length(human_answer)-length(replace(human_answer,chr(10),'')))::double from records)"""
_Q = "list_sort(list(value))[(round_even((count(*)-1)*{0}, 0))::bigint + 1] as q{1}"
REFS = f"""refs as (select bucket_id, feature, count(*) as n, min(value) as min, max(value) as max, round(avg(value),6) as mean, round(stddev_pop(value),6) as std,
 {', '.join(_Q.format(p, round(p * 100)) for p in B.QUANTILES)} from long group by 1, 2 having count(*) >= {LEAST})"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("id", "bucket_id", F.length("human_answer").cast("double").alias("chars"), F.col("n_tokens").cast("double").alias("tokens"), F.regexp_count("human_answer", F.lit("\n")).cast("double").alias("newlines"))
    return rows.unpivot(["id", "bucket_id"], ["chars", "tokens", "newlines"], "feature", "value")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Length reference of every bucket of five records or more."""
    return B.references(_long(spark, d).where("feature = 'tokens'"), 5)


@query(_sql("select * from refs", LONG, REFS))
def bucket_references(spark, d):
    return B.references(_long(spark, d), LEAST)


@query(_sql("select split, bucket_id, dataset, count(*) as n from records group by grouping sets ((), (split), (bucket_id), (dataset), (dataset, split))"))
def grouping_sets_counts(spark, d):
    return _records(spark, d).groupingSets([[], ["split"], ["bucket_id"], ["dataset"], ["dataset", "split"]], "split", "bucket_id", "dataset").agg(F.count("*").alias("n"))


@query(_sql("select id, long.bucket_id, round(avg(greatest(q10 - value, value - q90, 0) / greatest(q90 - q10, std, 1e-6)), 6) as distance from long join refs using (bucket_id, feature) group by 1, 2", LONG, REFS))
def support_distance(spark, d):
    long = _long(spark, d)
    return B.support_distance(long, B.references(long, LEAST))


@query(
    _sql(
        "select bucket_id, count(*) as n, round(avg(i::int), 6) as hcr, round(avg(r), 6) as feature_rate from (select id, long.bucket_id as bucket_id, bool_and(value between q10 and q90) as i, avg((value between q10 and q90)::int) as r from long join refs using (bucket_id, feature) group by 1, 2) group by 1",
        LONG,
        REFS,
    )
)
def human_coverage(spark, d):
    long = _long(spark, d)
    return B.coverage(long, B.references(long, LEAST))


@query(
    _sql(
        """select bucket_id, feature, round(w1 / std, 6) as gap from
 (select bucket_id, feature, coalesce(sum(abs(fa - fb) * w), 0) as w1 from (select *, sum(a) over o / sum(a) over p as fa, sum(b) over o / sum(b) over p as fb, lead(value) over o - value as w
  from (select bucket_id, feature, value, count(*) filter (id % 2 = 0) as a, count(*) filter (id % 2 = 1) as b from long group by all)
  window o as (partition by bucket_id, feature order by value), p as (partition by bucket_id, feature)) group by 1, 2)
 join (select bucket_id, feature, case when stddev_pop(value) > 1e-12 then stddev_pop(value) else 1 end as std from long where id % 2 = 0 group by 1, 2 having count(*) >= 20) using (bucket_id, feature)
 join (select bucket_id, feature from long where id % 2 = 1 group by 1, 2) using (bucket_id, feature)""",
        LONG,
    )
)
def wasserstein_bng(spark, d):
    long = _long(spark, d).withColumn("side", F.col("id") % 2)
    keys = ["bucket_id", "feature"]
    std = long.where("side = 0").groupBy(*keys).agg(F.when(F.stddev_pop("value") > 1e-12, F.stddev_pop("value")).otherwise(1.0).alias("std"), F.count("*").alias("n")).where("n >= 20")
    other = long.where("side = 1").select(*keys).distinct()
    return B.wasserstein(long, keys).join(std, keys).join(other, keys).select(*keys, _r6(F.col("w1") / F.col("std")).alias("gap"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, bucket_id, dataset, p, r): all predicted and reference words."""
    rows = _records(spark, d).select("id", "bucket_id", "dataset", T.normalized_words(F.col("human_answer")).alias("r"))
    return rows.withColumn("p", F.transform("r", lambda w, i: F.when(i % 3 == 2, F.lit("of")).otherwise(w)))


_PAIRS = rf"""p0 as (select id, bucket_id, dataset, list_filter(regexp_split_to_array(regexp_replace(lower(human_answer), '{T.PUNCTUATION}', '', 'g'), '[ \n]+'), lambda w: w <> '' and w not in ('a','an','the')) as r from records),
pairs as (select *, list_transform(r, lambda w, i: case when (i - 1) % 3 = 2 then 'of' else w end) as p from p0),
both_ as (select id, w, sum(a) as a, sum(b) as b from (select id, unnest(p) as w, 1 as a, 0 as b from pairs union all select id, unnest(r), 0, 1 from pairs) group by 1, 2),
common as (select id, sum(least(a, b)) as c from both_ group by 1)"""
_F1 = "case when len(p)=0 and len(r)=0 then 1.0 when len(p)=0 or len(r)=0 then 0.0 else 2.0 * c / (len(p) + len(r)) end"


@query()
def rouge_l(spark, d):
    rows = _pairs(spark, d).select("id", F.size("p").alias("n_p"), F.size("r").alias("n_r"), M.lcs_lengths("p", "r").alias("lcs"))
    return rows.select("id", _r6(M.f1_of_counts(F.col("lcs"), F.col("n_p"), F.col("n_r"))).alias("rouge_l"))


@query()
def self_bleu(spark, d):
    return M.self_bleu(_pairs(spark, d).select("id", "bucket_id", F.col("p").alias("words")))


ALIGN = """preds as (select doc_id as source_index, case when doc_id % 11 = 0 then 'other' else lang end as observed from documents where doc_id % 5 <> 0
 union all select doc_id, lang from documents where doc_id % 50 = 1 union all select doc_id + 100000000, lang from documents where doc_id % 97 = 0)"""


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = R.table(spark, d, "documents").select(F.col("doc_id").alias("i"), "lang")
    main = docs.where("i % 5 <> 0").select(F.col("i").alias("source_index"), F.when(F.col("i") % 11 == 0, "other").otherwise(F.col("lang")).alias("observed"))
    again = docs.where("i % 50 = 1").select("i", "lang")
    return main.union(again).union(docs.where("i % 97 = 0").select(F.col("i") + 100000000, "lang"))


@query(_sql("select source_index, language, observed, n_tokens from preds join records on id = source_index where observed = language", ALIGN))
def preference_pairs(spark, d):
    recs = _records(spark, d).select("id", "language", "n_tokens")
    return _predictions(spark, d).join(recs, F.col("source_index") == F.col("id")).where("observed = language").select("source_index", "language", "observed", "n_tokens")


@query(_sql("select id from records where id not in (select source_index from preds where observed <> 'other')", ALIGN))
def resume_antijoin(spark, d):
    done = _predictions(spark, d).where("observed <> 'other'").select(F.col("source_index").alias("id"))
    return R.table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(done, "id", "left_anti")


@query(
    """select count(*) filter (quality=1) as positives, count(*) filter (quality=0) as negatives,
 round((select sum(case when a.n_chars > b.n_chars then 1.0 when a.n_chars = b.n_chars then 0.5 else 0 end) from (select n_chars from documents join labels using (doc_id) where quality=1) a, (select n_chars from documents join labels using (doc_id) where quality=0) b)
  / (count(*) filter (quality=1) * count(*) filter (quality=0)), 6) as auc from documents join labels using (doc_id)"""
)
def roc_auc(spark, d):
    return M.roc_auc(_scored(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = R.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"), "source")
    return docs.join(R.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("positive")), "doc_id")


@query(
    """select score, (sum(p) over w)::bigint as tp, (sum(f) over w)::bigint as fp from (select n_chars as score, count(*) filter (quality=1) as p, count(*) filter (quality<>1) as f from documents join labels using (doc_id) group by 1) window w as (order by score desc)"""
)
def roc_curve(spark, d):
    return M.roc_points(_scored(spark, d)).select("score", "tp", "fp")


@query(
    """select source, count(*) as n, count(*) filter (n_chars >= 1500 and quality=1) as tp, count(*) filter (n_chars >= 1500 and quality<>1) as fp, count(*) filter (n_chars < 1500 and quality=1) as fn,
 count(*) filter (n_chars < 1500 and quality<>1) as tn, round(avg((n_chars >= 1500)::int), 6) as predicted_rate from documents join labels using (doc_id) group by source"""
)
def detector_confusion(spark, d):
    flag, pos = F.col("score") >= 1500, F.col("positive")
    count = lambda c: F.count_if(c).alias
    return _scored(spark, d).groupBy("source").agg(F.count("*").alias("n"), count(flag & pos)("tp"), count(flag & ~pos)("fp"), count(~flag & pos)("fn"), count(~flag & ~pos)("tn"), _r6(F.avg(flag.cast("int"))).alias("predicted_rate"))


def _draw(judge: int, k: int, lib: str = "spark") -> str:
    if lib == "spark":
        return f"pmod(cast(conv(substr(md5(concat('{judge}:{k}:', doc_id)),1,8),16,10) as bigint), 6)"
    return f"(cast('0x' || substr(md5('{judge}:{k}:' || doc_id),1,8) as bigint) % 6)"


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Two judges' replies a document; a score of 0 is out of range."""
    docs = R.table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    made = []
    for judge in (1, 2):
        scores = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), F.expr(_draw(judge, k)).cast("string")) for k, name in enumerate(M.DIMENSIONS)])
        fenced = F.concat(F.lit("Here:\n```json\n{"), scores, F.lit("}\n```"))
        plain = F.concat(F.lit("Scores {"), scores, F.lit("} end"))
        made.append(docs.select("doc_id", "source_id", F.lit(judge).alias("judge"), F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(plain).alias("reply")))
    return made[0].union(made[1])


def _judge_sql() -> str:
    parts = []
    for judge in (1, 2):
        parts.append(f"select doc_id, source as source_id, {judge} as judge, " + ", ".join(f"{_draw(judge, k, 'duck')} as {n}" for k, n in enumerate(M.DIMENSIONS)) + " from documents")
    valid = " and ".join(f"{n} between 1 and 5" for n in M.DIMENSIONS)
    comps = ", ".join("case when " + valid + " then round((" + " + ".join(f"{w} * ({n} - 1) / 4 * 100" for n, w in ws.items()) + f") / {sum(ws.values())!r}, 4) end as {c}" for c, ws in M.COMPOSITES.items())
    return f"with j0 as ({' union all '.join(parts)}), j as (select *, ({valid}) as valid, {comps} from j0) "


_COMPS = list(M.COMPOSITES)
_MEANS = ", ".join(f"round(avg({c}), 6) as {c}" for c in _COMPS)
_DIM_MEANS = ", ".join(f"round(avg({c}) filter (valid), 6) as {c}" for c in M.DIMENSIONS)
_AGREE = ", ".join(
    f"round(covar_pop(a.{c}, b.{c}) / nullif(stddev_pop(a.{c}) * stddev_pop(b.{c}), 0), 6) as pearson_{c}, round(avg(abs(a.{c} - b.{c})), 6) as mean_abs_diff_{c}" for c in _COMPS
)


@query(_judge_sql() + f"select doc_id, judge, valid, {', '.join(_COMPS)} from j")
def judge_parse(spark, d):
    return M.judge_parsed(_replies(spark, d)).select("doc_id", "judge", "valid", *_COMPS)


@query(_judge_sql() + f"select source_id, judge, count(*) as n, count(*) filter (valid) as n_valid, {_DIM_MEANS}, {_MEANS} from j group by 1, 2")
def judge_summary(spark, d):
    """Counts and means of valid replies' dimensions and composites, by source and judge."""
    dims = [_r6(F.avg(F.when(F.col("valid"), F.col(c)))).alias(c) for c in M.DIMENSIONS]
    comps = [_r6(F.avg(c)).alias(c) for c in _COMPS]
    return M.judge_parsed(_replies(spark, d)).groupBy("source_id", "judge").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), *dims, *comps)


@query(_judge_sql() + f"select a.source_id, count(*) as n, {_AGREE} from j a join j b using (doc_id) where a.judge = 1 and b.judge = 2 and a.valid and b.valid group by 1")
def judge_agreement(spark, d):
    """Pearson correlation and mean absolute difference of two judges, by composite."""
    rows = M.judge_parsed(_replies(spark, d)).where("valid")
    side = lambda j, c: F.max(F.when(F.col("judge") == j, F.col(c))).alias(f"{c}_{j}")
    both = rows.groupBy("doc_id", "source_id").agg(*[side(j, c) for j in (1, 2) for c in _COMPS]).where(F.col(f"{_COMPS[0]}_1").isNotNull() & F.col(f"{_COMPS[0]}_2").isNotNull())
    made = []
    for c in _COMPS:
        a, b = F.col(f"{c}_1"), F.col(f"{c}_2")
        made += [_r6(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias(f"pearson_{c}"), _r6(F.avg(F.abs(a - b))).alias(f"mean_abs_diff_{c}")]
    return both.groupBy("source_id").agg(F.count("*").alias("n"), *made)


POINTS = "pts as (select source_id, round(avg(utility) / 100, 6) as u, round(avg(conditional_naturalness) / 100, 6) as n from j group by 1)"
FRONT = "front as (select source_id, u, n from (select *, max(n) over (order by u desc, n desc rows between unbounded preceding and 1 preceding) as b from pts where u is not null and n is not null) where b is null or n > b)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return M.judge_parsed(_replies(spark, d)).groupBy("source_id").agg(_r6(F.avg("utility") / 100).alias("u"), _r6(F.avg("conditional_naturalness") / 100).alias("n"))


@query(_judge_sql() + f", {POINTS}, {FRONT} select * from front")
def pareto_frontier(spark, d):
    return M.frontier(_points(spark, d)).select("source_id", "u", "n")


@query(
    _judge_sql()
    + f", {POINTS}, {FRONT} select count(*) as n_points, round(sum((u - pu) * (n + pn) / 2), 6) as auc, round(sum((u - coalesce(pu, 0)) * n), 6) as hypervolume from (select *, lag(u) over (order by u) as pu, lag(n) over (order by u) as pn from front)"
)
def hypervolume(spark, d):
    return M.frontier_scores(M.frontier(_points(spark, d)))


@query(_judge_sql() + f", {POINTS} select source_id, round(sqrt(least(1, greatest(0, u)) * least(1, greatest(0, n))), 6) as score from pts")
def aggregate_score(spark, d):
    return _points(spark, d).select("source_id", _r6(M.bounded_geometric_mean(F.array("u", "n"))).alias("score"))


@query("select label, count(*) as n, round(avg(list_cosine_similarity(embedding, c)), 4) as mean_cosine from embeddings join (select label, list(m order by i) as c from (select label, i, avg(embedding[i]) as m from embeddings, range(1, 65) t(i) group by 1, 2) group by 1) using (label) group by 1")
def embedding_cosine(spark, d):
    """Mean likeness of each label's vectors to their centroid."""
    rows = R.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    centre = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "c") / F.sqrt(dot("v", "v") * dot("c", "c"))
    return rows.join(F.broadcast(centre), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine), 4).alias("mean_cosine"))


@query("with recursive w as (select conv_id, turn, 1 as depth from conversations where turn = 0 union all select c.conv_id, c.turn, w.depth + 1 from conversations c join w on c.conv_id = w.conv_id and c.turn = w.turn + 1) select conv_id, turn, depth::bigint as depth from w")
def message_tree_ancestry(spark, d):
    """Turns that an unbroken chain of parents joins to their root."""
    ident = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    view = R.table(spark, d, "conversations").select("conv_id", "turn", ident(turn).alias("id"), F.when(turn > 0, ident(turn - 1)).alias("parent"))
    # a turn whose parent is absent would count as a root: only first turns are
    rows = tree_chains(view, F.lit(True), F.struct("conv_id", "turn")).where("chain[0].turn = 0")
    last = F.element_at("chain", -1)
    return rows.select(last["conv_id"].alias("conv_id"), last["turn"].alias("turn"), F.size("chain").cast("long").alias("depth"))


def _all() -> None:
    """Registers the queries of the modules that build on this one."""
    from tessera.plans import alignments, corpora, featuring, outputs, reports  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
