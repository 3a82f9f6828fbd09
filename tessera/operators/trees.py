"""Message trees: chains of ancestors, found level by level from the roots."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)


def chains(nodes: DataFrame, usable: Column, payload: Column) -> DataFrame:
    """(id, chain): payloads from the root to the node, for nodes of usable ancestors only.

    ``nodes`` has unique ``id`` and a ``parent``.  A parent that is null, empty or
    absent makes a root; an unusable ancestor drops the whole branch; cycles have no
    root and are dropped.  One join a level, each level checkpointed.
    """
    ensure_checkpoints(nodes.sparkSession)
    known = nodes.select(F.col("id").alias("_known"))
    good = nodes.where(usable).select("id", F.nullif(F.col("parent").cast("string"), F.lit("")).alias("parent"), payload.alias("payload"))
    good = good.join(known, good["parent"] == known["_known"].cast("string"), "left")
    good = good.withColumn("parent", F.when(F.col("_known").isNotNull(), F.col("parent"))).drop("_known").checkpoint()
    level = good.where("parent is null").select("id", F.array("payload").alias("chain"))
    children = good.where("parent is not null")
    found = level
    while True:
        above = level.select(F.col("id").cast("string").alias("parent"), "chain")
        level = children.join(above, "parent").select("id", F.concat("chain", F.array("payload")).alias("chain")).checkpoint()
        if level.isEmpty():
            return found
        found = found.unionByName(level)
