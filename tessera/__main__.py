"""Command line: list and run queries, format corpora, remove duplicates.

    python -m tessera queries
    python -m tessera run NAME --data DIR [--out PATH]
    python -m tessera format NAME --input PATH --schema DDL --out PATH
    python -m tessera records DATASET --input PATH --schema DDL [--split SPLIT] --out PATH
    python -m tessera dedup --data DIR --out PATH
    python -m tessera dedup-corpus --data ROOT --out ROOT
    python -m tessera references --data ROOT --out PATH [--least N]
    python -m tessera pipeline --config FILE
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus, reports
from tessera.plans import catalogue
from tessera.sources import config, formatters, readers, sinks


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="tessera")
    commands = made.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(catalogue.queries()))
    form = commands.add_parser("format")
    form.add_argument("name", choices=sorted(formatters.FORMATTERS))
    form.add_argument("--input", required=True)
    form.add_argument("--schema", required=True)
    recs = commands.add_parser("records")
    recs.add_argument("name", choices=sorted([*formatters.DATASETS, *formatters.ALIASES]))
    recs.add_argument("--split", default="train")
    for p in (recs,):
        p.add_argument("--input", required=True)
        p.add_argument("--schema", required=True)
    dedup, whole, refs = commands.add_parser("dedup"), commands.add_parser("dedup-corpus"), commands.add_parser("references")
    refs.add_argument("--least", type=int, default=20)
    commands.add_parser("pipeline").add_argument("--config", required=True)
    for p in (run, dedup, whole, refs):
        p.add_argument("--data", required=True)
    for p in (run, form, recs, dedup, whole, refs):
        p.add_argument("--out", required=p is not run)
        p.add_argument("--existing", choices=sorted(sinks.MODES), default="error")
    return made


def bucket_table(records: DataFrame, least: int) -> DataFrame:
    """Prototypes and bands of answer lengths, by bucket."""
    long = records.select("id", "bucket_id", F.lit("length_tokens").alias("feature"), F.size(T.tokens(F.col("human_answer"))).cast("double").alias("value"))
    return reports.prototypes(long, least)


def run_pipeline(spark: SparkSession, path: str) -> dict[str, int]:
    """Dedup of a corpus tree and its bucket table, as the settings at ``path`` say; counts of the report."""
    said = config.settings(path)
    records = config.corpus_tree(spark, said["input_root"], corpus.RECORD + ", ordinal long")
    if said["datasets"]:
        records = records.where(F.col("dataset").isin(said["datasets"]))
    marked = corpus.mark_duplicates(records)
    kept = marked.where(corpus.is_kept()).select(*records.columns)
    sinks.corpus_tree(kept, f"{said['output_root']}/current", said["existing"])
    sinks.json_lines(bucket_table(kept, said["min_bucket_size"]), f"{said['output_root']}/references", said["existing"])
    return corpus.removal_report(marked).first().asDict()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "pipeline":
        print(run_pipeline(spark, args.config))
        return
    if args.command == "dedup-corpus":
        records = config.corpus_tree(spark, args.data, corpus.RECORD + ", ordinal long")
        sinks.corpus_tree(corpus.dedup(records), args.out, args.existing)
        return
    if args.command == "run":
        rows = catalogue.queries()[args.name](spark, args.data)
        if not args.out:
            rows.show(50, truncate=80)
            return
    elif args.command == "format":
        rows = formatters.format_records(args.name, readers.json_lines(spark, args.input, args.schema))
    elif args.command == "records":
        rows = formatters.dataset_records(args.name, readers.json_lines(spark, args.input, args.schema), args.split)
    elif args.command == "references":
        rows = bucket_table(config.corpus_tree(spark, args.data, corpus.RECORD), args.least)
    else:
        rows = catalogue.queries()["dedup_records"](spark, args.data)
    sinks.json_lines(rows, args.out, args.existing)


if __name__ == "__main__":
    main()
