"""Registered queries of the evaluation report.

Bindings: records of even id are human, of odd id generated; a record's prediction is
its own answer with every third word replaced.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import buckets as B
from tessera.operators import metrics as M
from tessera.operators import records as R
from tessera.operators import reports as E
from tessera.plans import catalogue as C

query, _sql, _r6 = C.query, C._sql, C._r6
LEAST = 10


def _sides(spark, d):
    long = C._long(spark, d)
    return long.where("id % 2 = 1"), long.where("id % 2 = 0")


_BANDS = f"""bands as (select bucket_id, feature, count(*) as n, round(avg(value), 6) as prototype_mean, {C._Q.format(0.5, 50)}, {C._Q.format(0.1, 10)}, {C._Q.format(0.9, 90)}, {C._Q.format(0.25, 25)}, {C._Q.format(0.75, 75)} from {{src}} group by 1, 2)"""


@query(_sql(f"select bucket_id, feature, n, n < {C.LEAST} as skipped, prototype_mean, q50 as prototype_median, q10, q90, q25, q75 from bands", C.LONG, _BANDS.format(src="long")))
def bucket_prototypes(spark, d):
    return E.prototypes(C._long(spark, d), C.LEAST)


GAPS = f"""w0 as (select bucket_id, feature, value, count(*) filter (id % 2 = 1) as a, count(*) filter (id % 2 = 0) as b from long group by all),
w1 as (select bucket_id, feature, coalesce(sum(abs(fa - fb) * w), 0) as w1, max(sa) as n from (select *, sum(a) over o / sum(a) over p as fa, sum(b) over o / sum(b) over p as fb, sum(a) over p as sa, lead(value) over o - value as w from w0
 window o as (partition by bucket_id, feature order by value), p as (partition by bucket_id, feature)) group by 1, 2),
sd as (select bucket_id, feature, case when stddev_pop(value) > 1e-12 then stddev_pop(value) else 1 end as s from long where id % 2 = 0 group by 1, 2),
gaps as (select bucket_id, feature, n, w1 / s as gap from w1 join sd using (bucket_id, feature) where n >= {LEAST}),
bng as (select bucket_id, max(n)::bigint as n_examples, count(*) as n_features, avg(gap) as bng from gaps group by 1)"""
HCR = f"""{_BANDS.format(src='(select * from long where id % 2 = 0)')},
inside as (select id, bucket_id, bool_and(value between q10 and q90)::int as i, avg((value between q10 and q90)::int) as r, count(*) as k from (select * from long where id % 2 = 1) join bands using (bucket_id, feature) group by 1, 2),
hcr as (select bucket_id, count(*) as n_examples, max(k) as n_features, avg(i) as hcr, avg(r) as rate from inside group by 1 having count(*) >= {LEAST})"""


def _gaps(spark, d):
    generated, human = _sides(spark, d)
    return E.gap_summary(E.gaps(generated, human, LEAST))


def _covered(spark, d):
    generated, human = _sides(spark, d)
    return E.coverage_summary(generated, E.prototypes(human, 0), LEAST)


@query(_sql("select bucket_id, n_examples, n_features, round(bng, 6) as bng from bng", C.LONG, GAPS))
def bucket_gaps(spark, d):
    return _gaps(spark, d).withColumn("bng", _r6("bng"))


@query(_sql("select round(avg(bng), 6) as overall_macro, round(sum(bng * n_examples) / sum(n_examples), 6) as overall_weighted from bng", C.LONG, GAPS))
def overall_gaps(spark, d):
    return E.overall(_gaps(spark, d), "bng").select(_r6("overall_macro").alias("overall_macro"), _r6("overall_weighted").alias("overall_weighted"))


@query(_sql("select bucket_id, n_examples, n_features, round(hcr, 6) as hcr, round(rate, 6) as mean_feature_inside_rate from hcr", C.LONG, HCR))
def bucket_coverage(spark, d):
    return _covered(spark, d).withColumns({"hcr": _r6("hcr"), "mean_feature_inside_rate": _r6("mean_feature_inside_rate")})


@query(_sql("select round(avg(hcr), 6) as overall_macro, round(sum(hcr * n_examples) / sum(n_examples), 6) as overall_weighted from hcr", C.LONG, HCR))
def overall_coverage(spark, d):
    return E.overall(_covered(spark, d), "hcr").select(_r6("overall_macro").alias("overall_macro"), _r6("overall_weighted").alias("overall_weighted"))


def _utility(spark, d):
    rows = C._records(spark, d).select("id", "bucket_id", "dataset", F.col("human_answer").alias("reference"))
    words = C.T.answer_words(F.col("reference"))
    rows = rows.withColumn("r", words).withColumn("p", F.transform("r", lambda w, i: F.when(i % 3 == 2, F.lit("of")).otherwise(w)))
    return E.utility_rows(rows.withColumn("prediction", F.array_join("p", " ")))


USE = f"""use as (select id, bucket_id, dataset, (array_to_string(p, ' ') = human_answer)::int as raw_em, (p = r)::int as qa_em, {C._F1} as qa_f1 from (select pairs.*, human_answer from pairs join records using (id)) left join common using (id))"""
_MEANS = "round(avg(raw_em), 6) as raw_em, round(avg(qa_em), 6) as qa_em, round(avg(qa_f1), 6) as qa_f1"


@query(_sql(f"select bucket_id, dataset, count(*) as n, {_MEANS} from use group by grouping sets ((), (bucket_id), (dataset))", C._PAIRS, USE))
def utility_em_f1(spark, d):
    """Raw and normalised exact match and token F1, overall, by bucket and by dataset; one reading, no shuffle of words."""
    means = [_r6(F.avg(c)).alias(c) for c in ("raw_em", "qa_em", "qa_f1")]
    return _utility(spark, d).groupingSets([[], ["bucket_id"], ["dataset"]], "bucket_id", "dataset").agg(F.count("*").alias("n"), *means)


@query(
    _sql(
        """select side, coalesce(bucket_id, 'all') as bucket_id, n, count(*) as total, count(distinct g) as unique_grams, round(count(distinct g) / count(*), 6) as distinct_n from (
 select side, bucket_id, 1 as n, w as g from ws union all select side, bucket_id, 2, w || ' ' || w2 from ws where w2 is not null union all select side, bucket_id, 3, w || ' ' || w2 || ' ' || w3 from ws where w3 is not null) group by grouping sets ((side, bucket_id, n), (side, n))""",
        C._PAIRS,
        """w0 as (select side, id, bucket_id, unnest(l) as w, generate_subscripts(l, 1) as i from (select 'generated' as side, id, bucket_id, p as l from pairs union all select 'human', id, bucket_id, r from pairs)),
 ws as (select side, bucket_id, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from w0 window o as (partition by side, id order by i))""",
    )
)
def distinct_n(spark, d):
    """Share of distinct 1- to 3-grams of generated and human answers, by bucket and as a whole."""
    rows = C._pairs(spark, d).select("bucket_id", F.explode(F.array(F.struct(F.lit("generated").alias("side"), F.col("p").alias("words")), F.struct(F.lit("human").alias("side"), F.col("r").alias("words")))).alias("s"))
    return E.diversity(rows.select("s.side", "bucket_id", "s.words"))


def _merged(spark, d):
    use = _utility(spark, d).groupBy("bucket_id").agg(F.avg("qa_f1").alias("utility_qa_f1"))
    return E.merge_buckets(use, _gaps(spark, d).select("bucket_id", "bng"), _covered(spark, d).select("bucket_id", "hcr"))


MERGED = "merged as (select bucket_id, avg(qa_f1) as f1, any_value(bng) as bng, any_value(hcr) as hcr from use left join bng using (bucket_id) left join hcr using (bucket_id) group by 1)"
_ALL = (C.LONG, C._PAIRS, USE, GAPS, HCR, MERGED)


@query(_sql("select bucket_id, round(f1, 6) as utility_qa_f1, round(bng, 6) as bng, round(hcr, 6) as hcr from merged", *_ALL))
def bucket_metrics(spark, d):
    return _merged(spark, d).select("bucket_id", *[_r6(c).alias(c) for c in ("utility_qa_f1", "bng", "hcr")])


_POINTS = """pts as (select bucket_id, least(1, greatest(0, f1)) as u, {n} as n from merged),
front as (select u, n from (select *, max(n) over (order by u desc, n desc rows between unbounded preceding and 1 preceding) as b from pts where u is not null and n is not null) where b is null or n > b),
vol as (select count(*) as n_points, round(sum((u - pu) * (n + pn) / 2), 6) as auc, round(sum((u - coalesce(pu, 0)) * n), 6) as hypervolume from (select *, lag(u) over (order by u) as pu, lag(n) over (order by u) as pn from front))"""
_CORE = "sqrt(1 / (1 + greatest(bng, 0)) * least(1, greatest(0, hcr)))"


@query(_sql("select * from vol", *_ALL, _POINTS.format(n=f"case when bng is not null and hcr is not null then {_CORE} end")))
def naturalness_frontier(spark, d):
    """Frontier of buckets by F1 and the geometric mean of gap score and coverage."""
    return E.frontier_summary(_merged(spark, d), "utility_qa_f1", ["bng", "hcr"])


@query(
    _sql(
        """select round(f, 6) as qa_f1, round(g, 6) as bng_score, round(h, 6) as nuf_hypervolume, 3 as component_count, round(case when f * g * h = 0 then 0 else exp((ln(f) + ln(g) + ln(h)) / 3) end, 6) as overall
 from (select least(1, greatest(0, (select avg(qa_f1) from use))) as f, 1 / (1 + greatest(0, (select avg(bng) from bng))) as g, least(1, greatest(0, (select hypervolume from vol))) as h)""",
        *_ALL,
        _POINTS.format(n="case when bng is not null then 1 / (1 + greatest(bng, 0)) end"),
    )
)
def overall_score(spark, d):
    """The overall score of F1, gap and frontier volume (the provider-scored component is absent, so three remain)."""
    f1 = _utility(spark, d).agg(F.avg("qa_f1").alias("raw_f1"))
    gap = E.overall(_gaps(spark, d), "bng").select("overall_macro")
    volume = E.frontier_summary(_merged(spark, d), "utility_qa_f1", ["bng"]).select("hypervolume")
    row = f1.crossJoin(gap).crossJoin(volume)  # one row each
    parts = {"qa_f1": E.clipped(F.col("raw_f1")), "bng_score": 1.0 / (1.0 + F.greatest(F.col("overall_macro"), F.lit(0.0))), "nuf_hypervolume": E.clipped(F.col("hypervolume"))}
    return row.select(*[_r6(c).alias(k) for k, c in parts.items()], F.lit(3).alias("component_count"), _r6(E.aggregate_score(parts)).alias("overall"))


_REPORT = [
    ("utility", "raw_em", "(select avg(raw_em) from use)"), ("utility", "qa_em", "(select avg(qa_em) from use)"), ("utility", "qa_f1", "(select avg(qa_f1) from use)"),
    ("bng", "overall_macro", "(select avg(bng) from bng)"), ("bng", "overall_weighted", "(select sum(bng * n_examples) / sum(n_examples) from bng)"),
    ("hcr", "overall_macro", "(select avg(hcr) from hcr)"), ("hcr", "overall_weighted", "(select sum(hcr * n_examples) / sum(n_examples) from hcr)"),
    ("nuf", "frontier_auc", "(select auc from vol)"), ("nuf", "hypervolume", "(select hypervolume from vol)"),
]


@query(_sql(" union all ".join(f"select '{s}' as section, '{m}' as metric, round({x}, 6)::double as value" for s, m, x in _REPORT), *_ALL, _POINTS.format(n="case when bng is not null then 1 / (1 + greatest(bng, 0)) end")))
def evaluation_report(spark, d):
    """The report's overall figures, one a row."""
    use = _utility(spark, d).agg(*[F.avg(c).alias(f"utility.{c}") for c in ("raw_em", "qa_em", "qa_f1")])
    named = lambda t, s: t.select(*[F.col(c).alias(f"{s}.{c}") for c in t.columns])
    gap, cover = named(E.overall(_gaps(spark, d), "bng"), "bng"), named(E.overall(_covered(spark, d), "hcr"), "hcr")
    front = E.frontier_summary(_merged(spark, d), "utility_qa_f1", ["bng"]).select(F.col("auc").alias("nuf.frontier_auc"), F.col("hypervolume").alias("nuf.hypervolume"))
    row = use.crossJoin(gap).crossJoin(cover).crossJoin(front)  # one row each
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), _r6(F.col(f"`{s}.{m}`").cast("double")).alias("value")) for s, m, _ in _REPORT])
    return row.select(F.inline(cells))


@query(
    """with p as (select n_chars as score, count(*) filter (quality=1) as p, count(*) filter (quality<>1) as f from documents join labels using (doc_id) group by 1),
 r as (select sum(p) over w as tp, sum(f) over w as fp, sum(p) over () as np, sum(f) over () as nf from p window w as (order by score desc))
 select """ + ", ".join(f"round(coalesce(max(tp / np) filter (fp <= {x} * nf), 0), 6) as tpr_at_fpr_{str(x).replace('.', '_').ljust(4, '0')}" for x in (0.01, 0.05, 0.1)) + " from r"
)
def detector_tpr(spark, d):
    """True-positive rates at bounded false-positive rates."""
    return M.tpr_at(C._scored(spark, d))


@query(_sql("select count(*) filter (split = 'train') as n, count(*) filter (split <> 'train') as n_skipped, round(avg(w) filter (split = 'train'), 8) as weight_mean, round(min(w) filter (split = 'train'), 8) as weight_min, round(max(w) filter (split = 'train'), 8) as weight_max from (select split, 0.5 + (id % 17) / 8.0::double as w from records)"))
def weight_summary(spark, d):
    rows = C._records(spark, d).select("split", (0.5 + (F.col("id") % 17) / 8.0).alias("weight"))
    return E.weight_summary(rows, "weight", F.col("split") != "train")


@query("select (event_id % 5)::bigint as epoch, round(avg(value), 8) as loss, round(avg(value * 0.5), 8) as reg_loss, count(*) as steps from events group by 1")
def epoch_losses(spark, d):
    rows = R.table(spark, d, "events").select((F.col("event_id") % 5).alias("epoch"), F.col("value").alias("loss"), (F.col("value") * 0.5).alias("reg_loss"))
    return E.mean_losses(rows, "epoch", ["loss", "reg_loss"])


@query(_sql("select id, long.bucket_id, round(avg(greatest(q10 - value, value - q90, 0) / greatest(q90 - q10, std, 1e-6)), 8) as target_score from long join refs using (bucket_id, feature) group by 1, 2", C.LONG, C.REFS))
def critic_targets(spark, d):
    """What a critic learns: each record's distance from its bucket's support."""
    long = C._long(spark, d)
    return B.support_distance(long, B.references(long, C.LEAST), 8).withColumnRenamed("distance", "target_score")


_BINS = 40


@query(
    f"""with r0 as (select greatest(0, quantile_cont(n_chars, 0.005)) as lo, quantile_cont(n_chars, 0.992) as hi from documents), r as (select lo, case when hi > lo then hi else lo + 1 end as hi from r0),
 c as (select lang, least(floor((least(greatest(n_chars, lo), hi) - lo) / ((hi - lo) / {_BINS})), {_BINS - 1})::int as b, count(*) as c, any_value((hi - lo) / {_BINS}) as w from documents, r group by 1, 2),
 h as (select *, c / (sum(c) over (partition by lang) * w) as h from c), k as (select k::int as k, exp(-0.5 * (k * (2.5 / 9)) * (k * (2.5 / 9))) as w from range(-9, 10) t(k))
 select lang, b + k as bin, round(sum(h * k.w) / (select sum(w) from k), 6) as density from h, k where b + k between 0 and {_BINS - 1} group by 1, 2"""
)
def length_density(spark, d):
    """Smoothed histogram of text lengths by language, over the robust range of all."""
    docs = R.table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("n"))
    low, high = E.robust_range(docs, "n")
    return E.smoothed_density(docs, "lang", "n", low, high, _BINS)


@query()
def principal_plane(spark, d):
    """Vectors on their two main axes."""
    return E.principal_plane(R.table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
