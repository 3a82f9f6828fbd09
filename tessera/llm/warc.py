"""WARC: not-modified revisits resolved by an as-of join; a reader and a writer.

Each revisit takes the latest strictly earlier full response with its canonical
URL, if the validators agree: equal entity tags (weak compare) where both have
one, else equal Last-Modified; with neither to compare it stays unresolved.  The
resolved record is the response with the headers that a 304 may update.

The join is a running maximum.  A URL's records are cut into time buckets, each
scanned by itself, and a second scan over one summary a bucket carries the latest
response across buckets; a URL with most of the records is thus many small tasks.

Defined cases: a URL without a scheme is compared as it is; header names that differ
by case only count once; a null URL or time matches nothing; equal times are not earlier; of
responses at one time the largest record_id counts; null headers are empty;
repeated records are kept; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket.
BUCKET = 86_400
# Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query fields that name no resource.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)"

RECORDS = "record_id long, type string, url string, time long, etag string, last_modified string, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www and default port, no fragment, tracking or end slash.

    A URL without ``scheme://`` names nothing on a host: it stays as it is, but for white space at its ends.
    """
    bare = F.trim(url)
    u = F.regexp_replace(bare, "#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(=|$)")))
    query = F.array_join(fields, "&")
    known = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), known).otherwise(bare)


def by_lower_name(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ by case only, the first in code-point order of the names counts."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value"))))
    first = F.filter(entries, lambda e, i: (i == 0) | ~e["name"].eqNullSafe(F.get(entries, i - 1)["name"]))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["name"], e["value"])))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row a revisit: the response it stands for, or why there is none."""
    rows = records.select(*[c.split()[0] for c in RECORDS.split(", ")]).withColumn("key", canonical_url(F.col("url"))).withColumn("span", F.floor(F.col("time") / bucket))
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("headers", by_lower_name(F.coalesce("headers", none)))
    whole = F.when(F.col("type") == "response", F.struct("time", "record_id", "etag", "last_modified", "digest", F.to_json("headers").alias("headers")))
    rows = rows.withColumn("full", whole)
    usable = rows.where("key is not null and time is not null")
    near = Window.partitionBy("key", "span").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    local = usable.withColumn("near", F.max("full").over(near)).where("type = 'revisit'")
    spans = usable.groupBy("key", "span").agg(F.max("full").alias("latest"))
    past = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "span", F.max("latest").over(past).alias("far"))
    found = local.join(carried, ["key", "span"], "left").withColumn("of", F.coalesce("near", "far")).drop("near", "far")
    lost = rows.where("type = 'revisit' and (key is null or time is null)").withColumn("of", F.lit(None).cast(found.schema["of"].dataType))
    found = found.select(*found.columns).unionByName(lost.select(*found.columns))
    plain = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("of.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("of.last_modified").isNotNull()
    agrees = F.when(tags, plain(F.col("etag")) == plain(F.col("of.etag"))).when(dates, F.col("last_modified") == F.col("of.last_modified")).otherwise(False)
    status = F.when(F.col("of").isNull(), "no-earlier-response").when(agrees, "resolved").when(tags | dates, "validator-mismatch").otherwise("no-validator")
    old = F.from_json(F.col("of.headers"), "map<string,string>")
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    good = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "url", F.col("key").alias("canonical_url"), "time", "status",
        F.when(good, F.col("of.record_id")).alias("response_id"), F.when(good, F.col("of.time")).alias("response_time"), F.when(good, F.col("of.digest")).alias("digest"),
        F.when(good, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))).alias("headers"),
    )


def write_record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    fields = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(f"WARC/1.1\r\n{fields}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a plain or gzip WARC file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        yield fields, stream.read(int(length) if length.isdigit() else 0)  # a bad length is none: the next header is sought


def http_parts(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, lower-case headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k)
    return int(status[1]) if len(status) > 1 and status[1].isdigit() else 0, fields, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of WARC files as records for ``resolve_revisits``."""
    import hashlib

    schema = RECORDS + ", body binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for fields, block in parse_records(content):
                    if fields.get("warc-type") in ("response", "revisit"):
                        _, http, body = http_parts(block)
                        when = pd.to_datetime(fields.get("warc-date"), errors="coerce", utc=True)  # a bad date is none
                        ident = int.from_bytes(hashlib.sha256(fields.get("warc-record-id", "").encode()).digest()[:8], "big", signed=True)
                        rows.append((ident, fields["warc-type"], fields.get("warc-target-uri"), None if when is None or pd.isna(when) else int(when.timestamp()), http.get("etag"), http.get("last-modified"), http, fields.get("warc-payload-digest"), body))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def capture_log(pages: DataFrame) -> DataFrame:
    """Records of a made-up crawl of ``pages``: for each page one response and two
    revisits, of which some carry another tag or come too early."""
    n = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    base = pages.select(n.alias("n"), "url", tag.alias("tag"), F.concat(F.lit("sha1:"), F.sha1(F.coalesce("html", F.lit("")))).alias("sum")).withColumn("t0", 1_700_000_000 + F.pmod("n", F.lit(9_973)) * 37)

    def record(k: int, kind: str, time: Column, etag: Column, digest: Column) -> Column:
        stamp = F.date_format(F.timestamp_seconds(time), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
        fields = [F.lit("ETag"), etag, F.lit("Date"), stamp, F.lit("Content-Type"), F.lit("text/html" if kind == "response" else "text/plain")]
        return F.struct((F.col("n") * 3 + k).alias("record_id"), F.lit(kind).alias("type"), F.col("url"), time.alias("time"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.create_map(*fields).alias("headers"), digest.alias("digest"))

    other = F.when(F.pmod("n", F.lit(7)) == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    early = F.when(F.pmod("n", F.lit(5)) == 0, F.col("t0") - 60).otherwise(F.col("t0") + 200_000)
    none = F.lit(None).cast("string")
    made = F.array(record(0, "response", F.col("t0"), F.col("tag"), F.col("sum")), record(1, "revisit", F.col("t0") + 3_600, other, none), record(2, "revisit", early, F.col("tag"), none))
    return base.select(F.inline(made))
