"""Records: one normalised row a text, with its bucket, split and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

SEED = 42
SPLITS = [("train", 0.9), ("dev", 0.05), ("test", 0.05)]
# Order in which splits win.
SPLIT_PRIORITY = {"test": 0, "validation2": 1, "dev": 2, "train": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files give fewer partitions than there are; larger tables stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def single_records(docs: DataFrame) -> DataFrame:
    """Single-turn records of documents."""
    docs = spread(docs.select("doc_id", "source", "lang", "text"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("dataset"), F.col("lang").alias("language"), T.normalize_text(F.col("text")).alias("human_answer"))
    rows = rows.withColumn("n_tokens", F.size(T.tokens(F.col("human_answer"))).cast("long"))
    rows = rows.withColumn("length_bin", T.length_bin(F.col("n_tokens")))
    rows = rows.withColumn("bucket_id", T.bucket_id(F.col("language"), F.lit("single"), F.lit("qa"), F.col("length_bin")))
    return rows.withColumn("split", T.choose_split(T.hash_fraction(SEED, F.col("id")), SPLITS))


def turn_records(conversations: DataFrame) -> DataFrame:
    """A record for each assistant turn with a non-empty history."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = conversations.select("conv_id", "turn", "role", T.normalize_text(F.col("text")).alias("text"))
    rows = rows.withColumn("history", F.collect_list(F.struct("role", "text")).over(past))
    rows = rows.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(past))
    kept = rows.where((F.col("role") == "assistant") & (F.size("history") > 0))
    n = F.size(T.tokens(F.col("text"))).cast("long")
    kept = kept.withColumn("n_tokens", n).withColumn("split", T.choose_split(T.hash_fraction(SEED, F.col("conv_id")), SPLITS))
    return kept.select("conv_id", "turn", F.coalesce("question", F.lit("")).alias("question"), "history", F.col("text").alias("human_answer"), "n_tokens", "split")


def history_pairs(history: Column, question: Column) -> Column:
    """[user, assistant] pairs: a last user turn equal to the question goes, empty
    turns are skipped, a later user turn replaces a waiting one."""
    last = F.element_at(history, -1)
    is_question = (F.size(history) > 0) & (last["role"] == "user") & (last["text"] == question)
    turns = F.filter(F.when(is_question, F.slice(history, F.lit(1), F.size(history) - 1)).otherwise(history), lambda t: t["text"] != "")
    start = F.struct(F.lit(None).cast("string").alias("user"), F.array().cast("array<array<string>>").alias("pairs"))

    def step(s: Column, t: Column) -> Column:
        done = F.struct(F.lit(None).cast("string").alias("user"), F.array_append(s["pairs"], F.array(s["user"], t["text"])).alias("pairs"))
        return F.when(t["role"] == "user", F.struct(t["text"].alias("user"), s["pairs"].alias("pairs"))).when((t["role"] == "assistant") & s["user"].isNotNull(), done).otherwise(s)

    return F.aggregate(turns, start, step, lambda s: s["pairs"])


def alpaca_view(records: DataFrame) -> DataFrame:
    pairs = history_pairs(F.col("history"), F.col("question"))
    rows = records.withColumn("pairs", pairs)
    doc = F.to_json(F.struct(F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("human_answer").alias("output"), F.when(F.size("pairs") > 0, F.col("pairs")).alias("history")))
    return rows.select("conv_id", "turn", "split", F.size("pairs").cast("long").alias("n_pairs"), doc.alias("view"))


def priority(split: Column) -> Column:
    found = F.lit(99)
    for name, rank in SPLIT_PRIORITY.items():
        found = F.when(split == name, rank).otherwise(found)
    return found


def best_group_split(records: DataFrame, group: str) -> DataFrame:
    """Adds ``best``: the winning split of the record's group."""
    best = records.groupBy(group).agg(F.min(F.struct(priority(F.col("split")).alias("p"), F.col("split").alias("s"))).alias("b"))
    return records.join(best.select(group, F.col("b.s").alias("best")), group)
