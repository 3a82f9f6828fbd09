"""Sources: JSON in four shapes, and members of zip files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line, gzip included; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each are one array of objects; any other file is refused."""
    starts = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^\s*(.)", 1).alias("c"))
    if starts.where("c <> '['").limit(1).count():
        raise ValueError(f"{path}: not an array")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def split_objects(text: str) -> list[str]:
    """The objects of a text that follow each other without a separator."""
    decoder, at, found = json.JSONDecoder(), 0, []
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        value, end = decoder.raw_decode(text, at)
        if not isinstance(value, dict):
            raise ValueError(f"not an object at {at}")
        found.append(text[at:end])
        at = end
    return found


def concatenated_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Several objects a file, one after the other, over any number of lines; a file is one value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": [o for text in frame["value"] for o in split_objects(text)]})

    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "value string")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def zipped_lines(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    """(file, line, one column a member): members of equal length, line by line."""
    names = [m.rsplit("/", 1)[-1].split(".")[0] for m in members]
    schema = "file string, line long, " + ", ".join(f"{n} string" for n in names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    texts = [z.read(m).decode("utf-8").splitlines() for m in members]
                if len({len(t) for t in texts}) != 1:
                    raise ValueError(f"{file}: members differ in length: {[len(t) for t in texts]}")
                yield pd.DataFrame({"file": file, "line": range(len(texts[0])), **dict(zip(names, texts, strict=True))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def zipped_json(spark: SparkSession, path: str, suffixes: list[str], schema: StructType | str) -> DataFrame:
    """The JSON of each zip's member with one of the suffixes; the shortest name wins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    fit = [n for n in z.namelist() if any(n.endswith(s) for s in suffixes)]
                    if not fit:
                        raise ValueError(f"no member ends with {suffixes}")
                    yield pd.DataFrame({"value": [z.read(min(fit, key=lambda n: (len(n), n))).decode("utf-8")]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
