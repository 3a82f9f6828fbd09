"""Thin queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extract, licenses, mixing, quality, secrets, simhash, sketch, tokenfiles, warc
from .common import spread, table

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary of op9; a path is a parameter everywhere else.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Vocabulary of op4's token files; 50256 is free in it and ends a document.
FLAT_VOCABULARY, FLAT_EOD = "byte_bpe_50k.tiktoken", 50_256


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(spark, spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def _flat_encoder():
    """A worker's text-to-ids function of op4, by the tiktoken library."""
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(FLAT_VOCABULARY))
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.count_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), _flat_encoder, FLAT_EOD)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.dedup_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return rows.select("doc_id", simhash.fp_hex(rows.fp).alias("fingerprint"), "component_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(spread(table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.capture_log(table(spark, sf_dir, "pages")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def queries() -> dict[str, Query]:
    found = [op1_quality_rules, op2_document_fingerprints, op3_license_scan, op4_token_counts, op5_source_mixing, op6_simhash_dedup, op7_html_extraction, op8_warc_revisits, op9_byte_bpe, op10_secret_scan]
    return {q.__name__: q for q in found}


#: op8 in plain SQL: the crawl log, canonical URLs, and for each revisit its latest
#: earlier response.  Tags are always there, so dates never decide.
WARC_SQL = rf"""
with base as (select coalesce(page_id, -1) as n, url, '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' as tag, 'sha1:' || sha1(coalesce(html, '')) as sum from pages),
timed as (select *, 1700000000 + ((n % 9973) + 9973) % 9973 * 37 as t0,
 regexp_replace(trim(url), '#.*$', '') as u from base),
split_ as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\d*\.', '') as host,
 regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '(?i)^{warc.TRACKING}(=|$)'))), '&') as query from timed),
keyed as (select *, case when regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://') then host || (case when path = '' then '/' else path end) || (case when query = '' then '' else '?' || query end) else trim(url) end as key from split_),
responses as (select key, n * 3 as response_id, t0 as response_time, tag as response_tag, sum from keyed),
revisits as (select key, url, n * 3 + 1 as record_id, t0 + 3600 as time, case when n % 7 = 0 then '"changed"' else 'W/' || tag end as etag from keyed
 union all select key, url, n * 3 + 2, case when n % 5 = 0 then t0 - 60 else t0 + 200000 end, tag from keyed),
latest as (select v.record_id, v.key, max(struct_pack(t := response_time, i := response_id, g := response_tag, s := sum)) as r
 from revisits v join responses p on v.key = p.key and p.response_time < v.time group by 1, 2),
found as (select v.*, r, case when r is null then 'no-earlier-response' when regexp_replace(etag, '^W/', '') = r.g then 'resolved' else 'validator-mismatch' end as status
 from revisits v left join latest l on v.record_id = l.record_id and v.key is not distinct from l.key)
select record_id, url, key as canonical_url, time, status, case when status = 'resolved' then r.i end as response_id, case when status = 'resolved' then r.t end as response_time,
 case when status = 'resolved' then r.s end as digest,
 case when status = 'resolved' then cast(json_object('content-type', 'text/html', 'date', strftime(make_timestamp(time * 1000000), '%a, %d %b %Y %H:%M:%S GMT'), 'etag', etag) as varchar) end as headers
from found"""


#: op5 in plain SQL: sizes and coins, targets by the level at which the capped sources
#: (in the order of limit by weight) leave the rest, and marks class by class.
MIX_SQL = rf"""
with recursive sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
 cast('0x' || substr(md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce('s' || source, 'n') || ':' || md5(coalesce(text, ''))), 1, 2) as int) as bin from documents),
classed as (select *, length(bin(cast(size as bigint))) as class from sized),
totals as (select source, cast(sum(size) as double) as s, row_number() over (order by source nulls last) - 1 as position from sized group by source),
weighed as (select *, 2 * s as top, case position % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from totals),
ranked as (select *, row_number() over o as k, coalesce(sum(top) over (o rows between unbounded preceding and 1 preceding), 0) as spent,
 (sum(w) over ()) - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) as left_, 1.5 * sum(s) over () as budget from weighed window o as (order by top / w, source nulls last)),
levels as (select min((budget - spent) / left_) filter (where top > (budget - spent) / left_ * w and k = k0) as level from
 (select *, min(k) filter (where top > (budget - spent) / left_ * w) over () as k0 from ranked)),
rated as (select source, s, least(top, coalesce(level, 0) * w) as target, case when s > 0 then least(top, coalesce(level, 0) * w) / s else 0 end as rate from ranked, levels),
sums as (select source, class, bin, cast(sum(size) as double) as words from classed where size > 0 group by all),
steps as (select source, class, list(struct_pack(upto := upto, mark := bin + 1) order by upto) as steps, sum(words) as words from
 (select *, sum(words) over (partition by source, class order by bin) as upto from sums) group by all),
classes as (select *, row_number() over (partition by source order by class desc) as r, coalesce(sum(words) over (partition by source order by class rows between unbounded preceding and 1 preceding), 0) as rest from steps),
walk as (select source, 0::bigint as r, -1 as class, 0 as mark, target - floor(rate) * s as need from rated
 union all
 select source, r, class, case when up then high.mark else low.mark end, need - case when up then high.upto else low.upto end from
 (select *, off_high < off_low or (off_high = off_low and tossed * (high.upto - low.upto) < want - low.upto) as up from
 (select *, greatest(0, high.upto - need, need - high.upto - rest) as off_high, greatest(0, low.upto - need, need - low.upto - rest) as off_low from
 (select *, coalesce(over_, low) as high from
 (select source, r, class, need, rest, want, coalesce(list_filter(steps, lambda x: x.upto <= want)[-1], struct_pack(upto := 0.0::double, mark := 0)) as low, list_filter(steps, lambda x: x.upto > want)[1] as over_,
 cast('0x' || substr(md5('{mixing.SEED}:' || coalesce('s' || source, 'n') || ':' || class), 1, 8) as bigint) / 4294967296.0::double as tossed from
 (select c.source, c.r, c.class, c.steps, c.rest, w.need, w.need * c.words / (c.words + c.rest) as want from walk w join classes c on c.source is not distinct from w.source and c.r = w.r + 1)))))),
marks as (select source, class, mark from walk where r > 0)
select d.doc_id, cast(d.size as bigint) as size, cast(r.s as bigint) as source_size, r.target, cast((floor(r.rate) + case when d.bin < m.mark then 1 else 0 end) * d.size as bigint) as taken
from classed d join rated r on d.source is not distinct from r.source left join marks m on d.source is not distinct from m.source and d.class = m.class"""


def oracle_sql() -> dict[str, str]:
    """The others need trained weights, merges, or XXH64, which DuckDB lacks."""
    return {"op5_source_mixing": MIX_SQL, "op8_warc_revisits": WARC_SQL}
