"""Row numbers, samples, shards and batches, and picking one row of several."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranges(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``_part``: the range of ``order`` a row is in, cut at fixed quantiles, so a lost task finds the same."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    return rows.withColumn("_part", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))) if cuts else F.lit(0))


def _looked_up(values: dict[int, int], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key)) if values else F.lit(0)


def with_row_index(rows: DataFrame, order: str, name: str = "source_index") -> DataFrame:
    """Adds each row's place, from 0, by ``order``, a number that tells all rows apart.

    Rows are dealt to ranges between quantiles and numbered in each; a range is moved
    by the rows before it, at most one count a range on the driver.  No window spans
    the table.
    """
    dealt = _ranges(rows, order)
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + _looked_up(before, "_part")
    return dealt.withColumn(name, place.cast("long")).drop("_part")


def running_sums(rows: DataFrame, order: str, columns: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running sums (new name -> column of whole numbers) along ``order``, a number that tells all rows apart.

    In ranges like ``with_row_index``: a range starts from the sums of those before it.
    """
    dealt = _ranges(rows, order)
    sums = dealt.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in columns.items()]).collect()
    earlier = (lambda q, p: q > p) if descending else (lambda q, p: q < p)
    within = Window.partitionBy("_part").orderBy(F.desc(order) if descending else F.asc(order))
    made = {n: F.sum(c).over(within) + _looked_up({r["_part"]: sum(q[n] for q in sums if earlier(q["_part"], r["_part"])) for r in sums}, "_part") for n, c in columns.items()}
    return dealt.withColumns(made).drop("_part")


def first_n(rows: DataFrame, index: str, n: int) -> DataFrame:
    """The rows of the ``n`` least places, in order; all of them for n <= 0."""
    return rows.orderBy(index) if n <= 0 else rows.orderBy(index).limit(n)


def random_n(rows: DataFrame, index: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by the order of a seeded hash of their place, put back in order; all for n <= 0."""
    return rows.orderBy(index) if n <= 0 else rows.orderBy(hashed(F.col(index), seed), index).limit(n).orderBy(index)


def hashed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def choice(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group, without replacement, by the order of a seeded hash.

    A rank filter, so that a task sends at most ``n`` rows of a group on.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hashed(F.col(key), seed), key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def tail_shards(index: Column, done: int, total: int, shards: int) -> Column:
    """The shard of a place among the rows after the first ``done``: contiguous, of ceil(rest / shards)."""
    chunk = max(1, math.ceil((total - done) / shards))
    return F.when(index >= done, F.floor((index - done) / chunk))


def source_shard(index: Column, shards: int, shard: int) -> Column:
    return F.pmod(index, F.lit(shards)) == shard


def batch_of(index: Column, size: int) -> Column:
    return F.floor(index / size)


def keep_one(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``; an aggregate, so a hot key combines before it meets."""
    whole = F.struct(*rows.columns)
    pick = (F.max_by if last else F.min_by)(whole, F.col(order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick.alias("row")).select("row.*")


def merge_in_order(*lists: Column) -> Column:
    """The members of several arrays, each once, where it first stands."""
    return F.array_distinct(F.concat(*lists))


def top_examples(rows: DataFrame, order: str, n: int = 20) -> DataFrame:
    return rows.orderBy(order).limit(n)
