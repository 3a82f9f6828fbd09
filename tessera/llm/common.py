"""Shared pieces of the training-data operators: tables, shared storage, words.

Words everywhere are maximal runs outside ``[\\x20\\x09-\\x0D]``.  That is the
white space of ``bytes.split()``, so Python kernels split UTF-8 bytes directly
and SQL uses ``WORD``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files give fewer partitions than there are; larger tables stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where it is unset, as in local tests, a folder of this machine is made
    and removed again at exit.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    No ``_SUCCESS`` marker is made: nothing reads it, and on a local file system the
    driver starts two processes for one (to set the modes of the file and its checksum).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _located(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _located(spark, path)
    return system.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    system, p = _located(spark, path)
    system.delete(p, True)


def release() -> None:
    """Give this worker's free memory back to the system: an idle worker shares its executor with the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``df`` alone, so that extra ones cannot clash."""
    return df.select(*[df[n] for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(name: str = "text") -> Column:
    """A text column as UTF-8 bytes for Arrow kernels; null becomes empty."""
    return text_or_empty(name).cast("binary")


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def words(col: Column) -> Column:
    return F.filter(F.split(col, SPACES), lambda w: w != "")


def first_of_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group, by (doc_id, text hash), nulls last.

    rows: (doc_id, text_hash, root) of each row of ``docs``; read before it returns.
    Columns stay as they are: a row goes along as one column, so no name can clash.
    """
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    first, _ = written(rows.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.i").alias("i"), F.col("k.h").alias("h")), "first")
    repeated = rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = packed.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left_semi")
    if repeated:  # rows that are equal in id and text: keep one of each
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select("row.*")
