"""Resumable appends: each key is written once, over restarts too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def append_new(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str) -> None:
    """Drain a streaming ``source`` into parquet at ``path``.

    Keys that ``path`` already holds are left out of each batch, and repeated keys
    inside a batch keep one row, so a batch that is run again adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        transform(fresh).write.mode("append").parquet(path)

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
