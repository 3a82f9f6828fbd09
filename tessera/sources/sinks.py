"""Sinks: trees of JSON lines with a manifest, wide feature tables, merged summaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What to do where the target exists: Spark's save modes by the names used here.
MODES = {"overwrite": "overwrite", "skip": "ignore", "error": "errorifexists", "append": "append"}


def json_lines(rows: DataFrame, path: str, existing: str = "error") -> None:
    """One object a line; null fields are left out, text stays unescaped."""
    rows.write.mode(MODES[existing]).json(path)


def corpus_tree(records: DataFrame, root: str, existing: str = "error") -> None:
    """``root/dataset=.../split=...`` of JSON lines, in one pass over the records."""
    records.write.mode(MODES[existing]).partitionBy("dataset", "split").json(root)


def manifest(records: DataFrame) -> DataFrame:
    """(dataset, split, n) of a corpus."""
    return records.groupBy("dataset", "split").agg(F.count("*").alias("n"))


def wide_features(features: DataFrame, names: list[str]) -> DataFrame:
    """(id, feature, value) to one column a feature, in sorted order; absent values are null."""
    columns = [F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in sorted(names)]
    return features.groupBy("id").agg(*columns)


def csv(rows: DataFrame, path: str, existing: str = "error", header: bool = True) -> None:
    rows.write.mode(MODES[existing]).option("header", header).csv(path)


def dataset_manifest(counts: DataFrame, dataset: str, **stated: object) -> dict:
    """What is stated about a dataset: its split counts out of (dataset, split, n), and what the caller adds."""
    found = {r["split"]: r["n"] for r in counts.where(F.col("dataset") == dataset).collect()}  # at most four splits
    return {"dataset": dataset, **stated, "split_counts": dict(sorted(found.items())), "status": "complete" if found else "empty"}


def merge_summaries(old: list[dict], new: list[dict], expected: list[str], key: str = "source_id") -> dict:
    """Summaries by key: a new one takes its old one's place, others follow; and the expected keys that neither has."""
    merged = {r[key]: r for r in old} | {r[key]: r for r in new}
    return {"sources": list(merged.values()), "missing": [k for k in expected if k not in merged]}


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a row of ``new`` replaces the one of ``old`` whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def report(rows: DataFrame, path: str, most: int = 100_000) -> int:
    """A summary table as one JSON array on the driver; more rows than ``most`` are refused."""
    found = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a report holds at most {most} rows")
    Path(path).write_text(json.dumps(found, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    return len(found)


def upsert_registry(path: str, entries: dict[str, dict]) -> dict[str, dict]:
    """Adds or replaces named entries of a JSON registry file; the rest stay in order."""
    file = Path(path)
    known = json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    known |= entries
    file.write_text(json.dumps(known, ensure_ascii=False, indent=2), encoding="utf-8")
    return known
