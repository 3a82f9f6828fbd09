"""Bottom-k sketches of word-shingle hashes, in SQL functions only.

A fingerprint is the ascending array of the k smallest distinct 64-bit hashes of
a text's 5-word shingles.  Words are hashed once and a shingle is hashed from its
five word hashes.  Sketches of parts merge into the sketch of their union, and
estimate resemblance, containment and the distinct shingle count.

Defined cases: a null text is empty; fewer than five words make one shingle of
the whole sequence; no words make an empty sketch; two empty sketches have
resemblance 1, an empty and a non-empty one 0; rows with equal ids follow each
other by the hash of their text, in any order if that is equal too; null ids come
first; a lone row is followed by itself; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 128
WIDTH = 5
#: Hashes are signed; this is the size of their range.
_RANGE = float(1 << 64)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles of a text, repeats included."""
    hashed = F.transform(common.words(text), lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(width)]))
        whole = F.array(F.aggregate(h, F.lit(1).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= width, joined).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # one-element transform: the word hashes are evaluated once
    return F.element_at(F.transform(F.array(hashed), shingled), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return bottom_k(shingle_hashes(text, width), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return bottom_k(F.concat(a, b), k)


def merge_groups(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One merged sketch for each key.

    The rank filter keeps k hashes of a key in every task before the shuffle, so
    a key that holds most rows still meets as k hashes a task.
    """
    hashes = parts.select(*keys, F.explode(column).alias("_h"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_h"))
    low = hashes.withColumn("_r", rank).where(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_set("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; exact while both sets have under k members."""
    both = F.size(F.array_intersect(F.array_intersect(a, b), merged(a, b, k)))
    total = F.size(merged(a, b, k))
    return F.when(total > 0, both.cast("double") / total).otherwise(F.lit(1.0))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    position = (F.element_at(a, k).cast("double") + _RANGE / 2) / _RANGE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / position)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: |A and B| = J * |A or B|."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    own = distinct_count(a, k)
    return F.when(own > 0, F.least(F.lit(1.0), shared / own)).otherwise(F.lit(1.0))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def id_ranges(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 increasing lower bounds that cut the ids evenly."""
    probabilities = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", probabilities, 20 * parts)).first()[0] or []
    return sorted(set(found))


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Index of the range that holds an id, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    coarse = F.size(F.filter(F.expr(literal([r[0] for r in rows])), lambda b: b <= doc_id))
    table = F.expr("array(" + ",".join(literal(r) for r in rows) + ")")
    fine = lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(F.element_at(table, c), lambda b: b <= doc_id)))
    found = F.element_at(F.transform(F.array(coarse), fine), 1)
    return F.when(doc_id.isNull(), 0).otherwise(found)


def with_next(docs: DataFrame, parts: int | None = None):
    """(doc_id, text, next_text, part, place, real), and the window they are in.

    Ids are cut into even ranges, and one shuffle brings each range together;
    the first document of a range is also sent to the range before it, so no
    window spans the whole table.  ``parts`` only sizes the ranges.
    """
    spark = docs.sparkSession
    parts = parts or min(1024, 6 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    bounds = id_ranges(rows, parts)
    own = range_of(F.col("doc_id"), bounds)
    heads = rows.select("doc_id", own.alias("part")).groupBy("part").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    # first place of each range; at most ``parts`` rows.  A null id is the first of all.
    firsts = sorted((-1 << 70 if h["nulls"] else h["head"], h["part"]) for h in heads)
    sent: dict[int | None, int] = {}
    for (head, _), (_, before) in zip(firsts[1:] + firsts[:1], firsts, strict=True):
        sent[None if head == -1 << 70 else head] = before
    dealt = rows.select("doc_id", "text", own.alias("part"), F.lit(True).alias("real"))
    known = [i for i in sent if i is not None]
    if known:
        ids, to = (f"array({','.join(map(str, xs))})" for xs in ([f"{i}L" for i in known], [sent[i] for i in known]))
        starts = rows.where(F.expr(f"array_contains({ids}, doc_id)"))
        dealt = dealt.unionByName(starts.select("doc_id", "text", F.expr(f"element_at({to}, cast(array_position({ids}, doc_id) as int))").alias("part"), F.lit(False).alias("real")))
    if None in sent:
        dealt = dealt.unionByName(rows.where("doc_id is null").select("doc_id", "text", F.lit(sent[None]).alias("part"), F.lit(False).alias("real")))
    # Copied heads end their range; in the last range the very first one comes after all.
    dealt = dealt.withColumn("place", F.when(F.col("real"), 0).otherwise(1))
    order = Window.partitionBy("part").orderBy(F.col("place"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many of the next document's (all, if it has fewer).
    """
    rows, order = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.withColumn("sk", sketch(F.col("text"), k)).withColumn("edited", edited)
    rows = rows.withColumn("next_sk", F.lead("sk").over(order)).where("real")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "sk", "next_sk", sketch(F.col("edited"), k).alias("edited_sk"))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        distinct_count(F.col("sk"), k).alias("n_shingles"),
    )
