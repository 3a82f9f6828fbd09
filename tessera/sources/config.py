"""Small things that are settled on the driver: paths, registries, rubrics, pipeline settings."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.prompts import Rubric


def feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of features; columns without a name are left out."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith(("Unnamed:", "_c"))])


def corpus_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records of ``root/dataset/split.jsonl`` with dataset and split from their path, and their line as ``ordinal``'s basis, the file."""
    rows = spark.read.schema(schema).json(f"{root}/*/*.jsonl")
    path = F.col("_metadata.file_path")
    return rows.withColumns({"dataset": F.regexp_extract(path, r"([^/]+)/[^/]+\.jsonl$", 1), "split": F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)})


def companion(path: str, *names: str, above: str = "data") -> str | None:
    """The first of ``names`` that exists under the nearest folder called ``above`` that holds ``path``; a .jsonl name may be a .csv."""
    for folder in Path(path).resolve().parents:
        if folder.name == above:
            for name in names:
                for candidate in (folder / name, (folder / name).with_suffix(".csv")):
                    if candidate.exists():
                        return str(candidate)
            return None
    return None


def rubric(path: str) -> Rubric:
    return Rubric.load(Path(path).read_text(encoding="utf-8"))


def source_registry(spark: SparkSession, known: list[dict], override: str | None = None, variable: str = "SOURCE_REGISTRY_JSON") -> DataFrame:
    """(lang, source_id, model_key, stage, path): the known sources, replaced one by one by those of a JSON file or of the environment."""
    columns = ("lang", "source_id", "model_key", "stage", "path")
    given = json.loads(Path(override).read_text(encoding="utf-8")) if override else json.loads(os.environ.get(variable) or "[]")
    rows = {(r["lang"], r["source_id"]): r for r in known}
    for r in given:
        rows[r["lang"], r["source_id"]] = rows.get((r["lang"], r["source_id"]), {}) | r
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows.values()], ", ".join(f"{c} string" for c in columns))


def settings(path: str) -> dict:
    """Pipeline settings: datasets, an input and an output root, and what to do where the output exists."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = [k for k in ("input_root", "output_root") if not raw.get(k)]
    if missing:
        raise ValueError(f"settings lack {missing}")
    return {"datasets": None, "existing": "error", "min_bucket_size": 20} | raw
