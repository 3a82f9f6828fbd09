"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source; targets share a budget by weight, stop at a multiple
of the source's own size, and the excess is shared anew by weight until no source
is above.  A source's rate is target / size; each document is emitted
floor(rate) times plus once more if a hash-seeded coin with the fraction as its
probability says so.

Independent coins would leave a source of few long documents far off its target.
So the coins of a source are read by size class (powers of two), longest first:
each class takes its share of what the source still needs, up to a mark on the
scale of coins, and what it takes too much or too little is left to the shorter
documents, whose probability moves a little.  The mark lies between two
neighbouring sums so that the class takes its share in expectation, but not where
shorter documents could no longer make up for it.  Only sums of words by source,
class and coin (``BINS`` steps) are needed for that, no order of documents.

Sources are placed and shares found from the per-source table alone, in ranges and
by one small aggregate a round.  That table joins back as a broadcast while its
counted rows are at most ``BROADCAST_SOURCES``, and by a shuffled join, whose skew
Spark splits, beyond.

Defined cases: a null text has size 0; null is a source of its own, last in
order; a source whose size is 0 has target 0 and rate 0; an empty table gives an
empty result; a coin hangs on doc_id, source and text, so rows with equal or null
ids toss their own coins unless their texts are equal too; extra columns of any
name stay on emitted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 20_240_601
#: Steps of the scale of coins: two hexadecimal digits of a hash.
BINS = 256
#: About 300 bytes a row: a broadcast of at most some 15 MB.
BROADCAST_SOURCES = 50_000


def _mark(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def coin(*parts: Column, seed: int = SEED) -> Column:
    """The MD5 digest that the coins of a document or a class are read from."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def sized(docs: DataFrame, *kept: Column) -> DataFrame:
    """(doc_id, source, size, class, bin): a row for each row of ``docs``, with ``kept`` of it."""
    text, doc_id = common.text_or_empty(), F.col("doc_id").cast("long")
    tossed = coin(F.coalesce(doc_id.cast("string"), F.lit("")), _mark(F.col("source")), F.md5(text))
    rows = docs.select(doc_id.alias("doc_id"), "source", common.word_count(text).alias("size"), F.conv(F.substring(tossed, 1, 2), 16, 10).cast("int").alias("bin"), *kept)
    return rows.withColumn("class", F.length(F.bin("size")))


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, source_size, position): one row a source, in code-point order, null last.

    Sources are dealt to ranges, numbered within each and moved by the sizes of
    the ranges before: at most a row a range reaches the driver.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    dealt, path = common.written(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset
    placed, _ = common.written(dealt.select("source", "source_size", place.cast("long").alias("position")), "placed")
    common.drop_path(rows.sparkSession, path)
    return placed


def share(sources: DataFrame, share_of_total: float, cap: float) -> DataFrame:
    """Adds ``target`` and ``rate`` to (source, source_size, weight).

    With level L a source gets min(cap * size, L * weight).  Starting from all
    sources sharing, those at their cap leave and L rises until none is above.
    """
    sources = sources.withColumn("limit", cap * F.col("source_size").cast("double"))
    budget = share_of_total * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("limit") <= level * F.col("weight")
        got = sources.agg(
            F.count_if(above).alias("full"), F.sum(F.when(above, F.col("limit")).otherwise(0.0)).alias("spent"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("left")
        ).first()
        if got["full"] == full or not got["left"]:
            break
        full = got["full"]
        level = (budget - got["spent"]) / got["left"]
    target = F.least(F.col("limit"), level * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).withColumn("rate", rate).drop("limit")


def marks(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """(source, marks): per source, (class, mark); a document of the class gets a further copy if its bin is below.

    A source has at most 64 x ``BINS`` sums, whatever its number of documents.
    """
    sums = rows.where("size > 0").groupBy("source", "class", "bin").agg(F.sum("size").cast("double").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source", "class").orderBy("bin"))
    steps = sums.withColumn("upto", upto).groupBy("source", "class").agg(F.sort_array(F.collect_list(F.struct("upto", (F.col("bin") + 1).alias("mark")))).alias("steps"), F.sum("words").alias("words"))
    by_source = steps.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "words", "steps")), asc=False).alias("classes"), F.sum("words").alias("words"))
    met = by_source.join(rated.select(F.col("source").alias("of"), "target", "rate", "source_size"), F.col("source").eqNullSafe(F.col("of")))
    extra = F.col("target") - F.floor("rate") * F.col("source_size")
    mark = _mark(F.col("source"))

    def step(acc: Column, c: Column) -> Column:
        rest, need = acc["rest"] - c["words"], acc["need"]
        want = need * c["words"] / acc["rest"]
        under, over = F.filter(c["steps"], lambda s: s["upto"] <= want), F.filter(c["steps"], lambda s: s["upto"] > want)
        nothing = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("mark"))
        low = F.coalesce(F.try_element_at(under, F.lit(-1)), nothing)
        high = F.coalesce(F.try_element_at(over, F.lit(1)), low)
        tossed = F.conv(F.substring(coin(mark, c["class"].cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)

        def chosen(x: Column) -> Column:
            off = lambda taken: F.greatest(F.lit(0.0), taken - need, need - taken - rest)
            up = (off(x["high"]["upto"]) < off(x["low"]["upto"])) | ((off(x["high"]["upto"]) == off(x["low"]["upto"])) & (tossed * (x["high"]["upto"] - x["low"]["upto"]) < want - x["low"]["upto"]))
            return F.when(up, x["high"]).otherwise(x["low"])

        best = F.element_at(F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), chosen), 1)
        return F.element_at(
            F.transform(F.array(best), lambda b: F.struct((need - b["upto"]).alias("need"), rest.alias("rest"), F.array_append(acc["out"], F.struct(c["class"].alias("class"), b["mark"].alias("mark"))).alias("out"))), 1
        )

    zero = F.struct(extra.alias("need"), F.col("words").alias("rest"), F.array().cast("array<struct<class:int,mark:int>>").alias("out"))
    return met.select("source", F.aggregate("classes", zero, step)["out"].alias("marks"))


def with_rates(rows: DataFrame, share_of_total: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, source_size, weight, target, rate, marks) of ``sized`` rows; written once."""
    spark = rows.sparkSession
    sources = source_sizes(rows)
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    rated, path = common.written(share(sources.withColumn("weight", cycle), share_of_total, cap), "rates")
    found = marks(rows, rated).withColumnRenamed("source", "of")
    whole, _ = common.written(rated.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix")
    common.drop_path(spark, path)
    return whole


def with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (with source, class, bin) and their source's size and target, and ``copies``: how often each is taken."""
    rates = rates.withColumnRenamed("source", "of").drop("weight", "position")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    met = rows.join(rates, rows["source"].eqNullSafe(rates["of"]), "left").drop("of")
    mark = F.get(F.filter("marks", lambda m: m["class"] == F.col("class")), 0)["mark"]
    return met.withColumn("copies", F.floor("rate") + F.when(F.col("bin") < mark, 1).otherwise(0)).drop("marks", "rate")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``; texts are read once."""
    rows, _ = common.written(sized(docs), "sizes")
    found = with_copies(rows, with_rates(rows))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns unchanged."""
    sizes, path = common.written(sized(docs), "sizes")
    rates = with_rates(sizes)
    common.drop_path(docs.sparkSession, path)
    # every column in one, so that no name can clash
    rows = sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return with_copies(rows, rates).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
