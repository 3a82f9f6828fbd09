"""The record schema, and deduplication of a corpus of records.

A record has fourteen fields: id, dataset, split, language, track, family, style_bucket,
length_bin, question, context, dialogue_history, human_answer, bucket_id and meta (JSON).
Two records are the same if seven of them are, after normalising and lower-casing:
language, track, family, question, context, human_answer and the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.records import priority

TURNS = "array<struct<role:string,text:string>>"
RECORD = (
    "id string, dataset string, split string, language string, track string, family string, style_bucket string, length_bin string, question string, context string, "
    f"dialogue_history {TURNS}, human_answer string, bucket_id string, meta string"
)
# Datasets whose records belong to groups, and where their meta names the group.
GROUP_FIELD = {"coqa": "conversation_id", "oasst2_zh": "message_tree_id", "dailydialog": "dialogue_id", "multiwoz": "dialogue_id"}


def build_records(rows: DataFrame, meta: dict[str, Column] | None = None) -> DataFrame:
    """Records of ``rows`` with id, dataset, split, language, track, family, style_bucket, question, context,
    dialogue_history and human_answer; ``meta`` adds fields beside length_tokens."""
    norm = T.normalize_text
    turns = F.transform(F.coalesce("dialogue_history", F.array().cast(TURNS)), lambda t: F.struct(t["role"].alias("role"), norm(t["text"]).alias("text")))
    rows = rows.withColumns({"question": norm(F.col("question")), "context": norm(F.col("context")), "human_answer": norm(F.col("human_answer")), "dialogue_history": turns})
    rows = rows.withColumn("length_tokens", F.size(T.tokens(F.col("human_answer"))))
    rows = rows.withColumn("length_bin", T.length_bin(F.col("length_tokens")))
    rows = rows.withColumn("bucket_id", T.bucket_id(F.col("language"), F.col("track"), F.col("family"), F.col("length_bin")))
    noted = [c.alias(name) for name, c in (meta or {}).items()]
    rows = rows.withColumn("meta", F.to_json(F.struct(*noted, F.col("length_tokens"))))
    return rows.select(*[F.col(f.split()[0]) for f in RECORD.replace(TURNS, "turns").split(", ")])


def canonical_history(history: Column) -> Column:
    """Turns with a role and a text, both normalised and lower-cased."""
    clean = F.transform(F.coalesce(history, F.array().cast(TURNS)), lambda t: F.struct(F.lower(T.normalize_text(t["role"])).alias("role"), F.lower(T.normalize_text(t["text"])).alias("text")))
    return F.filter(clean, lambda t: (t["role"] != "") & (t["text"] != ""))


def example_key() -> Column:
    """A digest of the seven fields that make two records the same."""
    same = [F.lower(T.normalize_text(F.col(c))).alias(c) for c in ("context", "family", "human_answer", "language", "question", "track")]
    return F.sha1(F.to_json(F.struct(*same, canonical_history(F.col("dialogue_history")).alias("dialogue_history"))))


def group_key() -> Column:
    """The group of a record, by its dataset's field of meta; null where records stand alone."""
    found = F.lit(None).cast("string")
    for dataset, field in GROUP_FIELD.items():
        found = F.when(F.col("dataset") == dataset, F.get_json_object("meta", f"$.{field}")).otherwise(found)
    return found


def mark_duplicates(records: DataFrame) -> DataFrame:
    """Adds ``group_conflict``, ``key`` and the first record of each key (``kept``: dataset, split, ordinal).

    records need an ``ordinal``, their place in their file.  Records whose group has
    a better split elsewhere conflict; they go first and keep no other record out.
    Both aggregates combine before their shuffle, so no group or key meets whole in
    one task.
    """
    rows = records.withColumns({"group_key": group_key(), "key": example_key()})
    best = rows.where("group_key is not null").groupBy(F.col("dataset").alias("of_dataset"), F.col("group_key").alias("of_group"))
    best = best.agg(F.min(F.struct(priority(F.col("split")).alias("p"), F.col("split").alias("s"))).alias("best"))
    met = rows.join(best, (F.col("dataset") == F.col("of_dataset")) & (F.col("group_key") == F.col("of_group")), "left")
    rows = met.withColumn("group_conflict", F.coalesce(F.col("split") != F.col("best.s"), F.lit(False))).drop("of_dataset", "of_group", "best", "group_key")
    order = F.struct(priority(F.col("split")).alias("p"), F.col("dataset"), F.col("split"), F.col("ordinal"))
    first = rows.where("not group_conflict").groupBy(F.col("key").alias("of_key")).agg(F.min(order).alias("kept"))
    return rows.join(first, F.when(~F.col("group_conflict"), F.col("key")) == F.col("of_key"), "left").drop("of_key")


def is_kept() -> Column:
    same = (F.col("kept.dataset") == F.col("dataset")) & (F.col("kept.split") == F.col("split")) & (F.col("kept.ordinal") == F.col("ordinal"))
    return F.coalesce(same, F.lit(False))


def dedup(records: DataFrame) -> DataFrame:
    """The records that stay, in the columns they came with."""
    return mark_duplicates(records).where(is_kept()).select(*records.columns)


def removal_report(marked: DataFrame) -> DataFrame:
    """Counts of what went and why; duplicates are counted against the record that stayed."""
    gone = ~F.col("group_conflict") & ~is_kept()
    count = lambda c: F.count_if(c).alias
    same = F.col("split") == F.col("kept.split")
    removed = F.count("*") - F.count_if(is_kept())
    return marked.agg(
        F.count("*").alias("original_total"), count(is_kept())("final_total"), removed.alias("removed_total"), F.round(F.coalesce(F.try_divide(removed, F.count("*")), F.lit(0.0)), 6).alias("duplicate_rate"),
        count(F.col("group_conflict"))("group_split_conflicts_removed"), count(gone)("exact_duplicates_removed"), count(gone & same)("same_split_duplicates_removed"),
        count(gone & ~same)("cross_split_duplicates_removed"), count(gone & (F.col("dataset") != F.col("kept.dataset")))("cross_dataset_duplicates_removed"),
    )


def manifests(marked: DataFrame) -> DataFrame:
    """(dataset, split, original, final): what each dataset's manifest states."""
    return marked.groupBy("dataset", "split").agg(F.count("*").alias("original"), F.count_if(is_kept()).alias("final"))


def merged_split(records: DataFrame, split: str, include_validation2: bool = False) -> DataFrame:
    """All datasets' records of a split of the merged views; dev is called val, and validation2 joins it only if asked."""
    # Names of splits in merged views.
    known = {"train": ["train"], "val": ["dev", "validation2"] if include_validation2 else ["dev"], "test": ["test"]}
    return records.where(F.col("split").isin(known[split])).withColumn("split", F.lit(split))
