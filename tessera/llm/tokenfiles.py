"""Token counts of flat, unindexed token files by a separator scan.

A file is token ids of one fixed width, documents ended by an end-of-document id,
with no index.  Spark reads files and cuts them into blocks of whole tokens; each
block is searched for the separator in one vectorised comparison and yields its
separators' places.  Documents that cross blocks are stitched by a prefix scan
over one summary a block -- the last separator so far -- taken in two levels, so
that a file of any number of blocks is scanned in pieces of ``GROUP`` blocks.

A file over ``WHOLE`` bytes is never one value: Spark's line reader cuts it into
byte ranges, whose lengths, summed up in order, give each range its place; only
then are its tokens known to begin, and its separators kept.

The writer puts the tokens and, beside them, the id of each document into two
files of one task attempt, row by row.  So names and documents belong together
by their place whatever the order of the input, and a lost task redoes both.

Defined cases: an empty file has no documents; two separators in a row are an
empty document; tokens after the last separator are an unended document, flagged;
a file whose size is no multiple of the width fails; a separator outside the
width fails.  Of written tables: a null text has no tokens, a null doc_id stays
null, repeated rows are documents of their own, an empty table has no files and
no rows, a text of any length is one document, extra columns are ignored; the
order of the rows may change from reading to reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Tokens of a block, and blocks of a piece of the prefix scan.
BLOCK = 1 << 16
GROUP = 1 << 12
#: Files of more bytes are read by byte ranges; Spark holds no value of 2 GB.
WHOLE = 1 << 30
#: Documents encoded at a time.
SLICE = 256

_FOUND = "file string, block long, stop long, ends array<long>"
#: A written document's name: whether it has an id, the id, its tokens, a line end.
_NAME = np.dtype([("has", "u1"), ("doc_id", ">i8"), ("n", ">i8"), ("end", "u1")])


def _seek(dtype: str, eod: int, block: int):
    """Separators of blocks of whole tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, numbers, data = (batch.column(i) for i in range(3))
            ends, stops = [], []
            for i, n in enumerate(numbers.to_pylist()):
                ids = np.frombuffer(data[i].as_buffer(), dtype)  # the batch's own memory
                ends.append(np.flatnonzero(ids == eod) + n * block)
                stops.append(n * block + len(ids))
            yield pa.RecordBatch.from_arrays([files, numbers, pa.array(stops, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "stop", "ends"])

    return run


def _line_end(pattern: bytes) -> int:
    """A byte at which ranges may be cut: none inside the separator, its last one if that will do."""
    return next(b for b in (pattern[-1], *range(10, 128), *range(10)) if b < 128 and b not in pattern[:-1])


def _seek_ranges(pattern: bytes, line_end: int):
    """Bytes of each range, and where in it the separator's bytes stand, at any alignment."""
    end, width = bytes([line_end]), len(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, n, hits = None, b"", 0, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in zip((*now, n, np.concatenate(hits)), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "length", "n", "hits"])

        for batch in batches:
            files, starts, lengths, lines = (batch.column(i) for i in range(4))
            at = 0
            while at < batch.num_rows:
                here = (files[at].as_py(), starts[at].as_py(), lengths[at].as_py())
                upto = at + 1
                while upto < batch.num_rows and starts[upto].as_py() == here[1] and files[upto].as_py() == here[0]:
                    upto += 1
                if here != now:
                    if now is not None:
                        yield out()
                    now, rest, n, hits = here, b"", 0, []
                data = rest + end.join(lines.slice(at, upto - at).to_pylist()) + end
                found = np.frombuffer(data, np.uint8)
                same = np.ones(max(0, len(found) - width + 1), bool)
                for k, byte in enumerate(pattern):
                    same &= found[k : k + len(same)] == byte
                hits.append(np.flatnonzero(same) + n - len(rest))
                n += len(data) - len(rest)
                rest = data[len(data) - width + 1 :] if width > 1 else b""
                at = upto
        if now is not None:
            yield out()

    return run


def _whole_tokens(length: Column, file: Column, width: int) -> Column:
    return F.when(length % width == 0, length).otherwise(F.raise_error(F.concat(F.lit("not whole tokens: "), file)).cast("long"))


def _in_blocks(files: DataFrame, eod: int, dtype: str, block: int) -> DataFrame:
    size = block * np.dtype(dtype).itemsize
    count = F.ceil(_whole_tokens(F.col("length"), F.col("path"), np.dtype(dtype).itemsize) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.cast("long").alias("block"), F.substring("content", i * size + 1, F.lit(size)).alias("data")))
    blocks = files.select(F.col("_metadata.file_path").alias("file"), F.explode(cut).alias("b")).select("file", "b.block", "b.data")
    return blocks.mapInArrow(_seek(dtype, eod, block), _FOUND)


def _in_ranges(spark: SparkSession, path: str, over: int, eod: int, dtype: str) -> DataFrame:
    """The same rows for files of more than ``over`` bytes, with ranges as their blocks."""
    pattern = np.array([eod], dtype).tobytes()
    width, line_end = len(pattern), _line_end(pattern)
    meta = {"file": "file_path", "start": "file_block_start", "length": "file_size"}
    lines = spark.read.option("lineSep", chr(line_end)).text(path).where(F.col("_metadata.file_size") > over)
    lines = lines.select(*[F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()], F.col("value").cast("binary").alias("line"))
    ranges, made = common.written(lines.mapInArrow(_seek_ranges(pattern, line_end), "file string, start long, length long, n long, hits array<long>"), "ranges")
    before = Window.partitionBy("file").orderBy("start")
    placed = ranges.withColumn("base", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("block", F.row_number().over(before).cast("long") - 1)
    length = _whole_tokens(F.col("length"), F.col("file"), width)
    bytes_at = F.transform("hits", lambda h: h + F.col("base"))
    ends = F.transform(F.filter(bytes_at, lambda h: (h % width == 0) & (h + width <= F.col("length"))), lambda h: F.floor(h / width))
    found, _ = common.written(placed.select("file", "block", F.floor(F.least(F.col("base") + F.col("n"), length) / width).alias("stop"), ends.alias("ends")), "ranged")
    common.drop_path(spark, made)
    return found


def scan(spark: SparkSession, path: str, eod: int, dtype: str = "<u4", block: int = BLOCK, group: int = GROUP, whole: int = WHOLE) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): one row a document, separators left out.

    The files themselves are read before it returns.
    """
    if not 0 <= eod <= np.iinfo(dtype).max:
        raise ValueError(f"separator {eod} does not fit {dtype}")
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    found = _in_blocks(files.where(F.col("length") <= whole), eod, dtype, block)
    if files.select("length").where(F.col("length") > whole).limit(1).count():
        found = found.unionByName(_in_ranges(spark, path, whole, eod, dtype))
    found, _ = common.written(found, "separators")

    found = found.withColumn("piece", F.floor(F.col("block") / group))
    last, n_ends = F.element_at("ends", -1), F.size("ends").cast("long")
    summary = found.select("file", "piece", "block", F.when(n_ends > 0, last).alias("last"), n_ends.alias("docs"), "stop")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inner = before("file", "piece").orderBy("block")
    local = summary.select("file", "piece", "block", F.max("last").over(inner).alias("in_last"), F.coalesce(F.sum("docs").over(inner), F.lit(0)).alias("in_docs"))
    pieces = summary.groupBy("file", "piece").agg(F.max("last").alias("p_last"), F.sum("docs").alias("p_docs"), F.max("stop").alias("p_stop"))
    outer = before("file").orderBy("piece")
    carried = pieces.select("file", "piece", F.max("p_last").over(outer).alias("out_last"), F.coalesce(F.sum("p_docs").over(outer), F.lit(0)).alias("out_docs"))
    rows = found.join(local.drop("piece"), ["file", "block"]).join(carried, ["file", "piece"])
    open_at = F.coalesce("in_last", "out_last", F.lit(-1)) + 1
    starts = F.concat(F.array(open_at), F.transform(F.col("ends"), lambda e: e + 1))
    docs = rows.select("file", (F.col("in_docs") + F.col("out_docs")).alias("base"), F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("ends")).alias("s"), F.col("ends").alias("e"))).alias("i", "d"))
    ended = docs.select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = pieces.groupBy("file").agg(F.max("p_last").alias("l"), F.sum("p_docs").alias("ordinal"), F.max("p_stop").alias("stop")).withColumn("start", F.coalesce("l", F.lit(-1)) + 1)
    rest = tails.where("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


#: Session setting under which one task keeps several files open and writes each in the order of its rows.
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_flat(docs: DataFrame, encode, path: str, eod: int) -> tuple[str, str]:
    """Write flat big-endian u2 files, each text's ids then ``eod``, and beside each file its documents' names.

    encode: builds, on a worker, a function from a text to its ids.  Spark's text
    writer puts down the bytes, so commits and retries are Spark's; the last byte
    of the separator serves as its line end and must be ASCII.  Returns the
    folders of tokens and of names (``_NAME``); the files of one task have one number.
    """
    end = eod.to_bytes(2, "big")
    if end[1] > 127:
        raise ValueError("the low byte of the separator must be ASCII")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encode()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                kinds, values = [], []
                for i, text in zip(batch.column(0).slice(at, SLICE).to_pylist(), batch.column(1).slice(at, SLICE).to_pylist(), strict=True):
                    ids = np.array(ids_of(text), ">u2")
                    kinds += ["names", "tokens"]
                    values += [np.array([(i is not None, i or 0, len(ids), 0)], _NAME).tobytes()[:-1], ids.tobytes() + end[:1]]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values, pa.binary())], names=["kind", "value"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(run, "kind string, value binary")
    before = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, 2)
    try:
        rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", chr(end[1])).text(path)
    finally:
        spark.conf.set(_OPEN_FILES, before)
    return f"{path}/kind=tokens", f"{path}/kind=names"


def names(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, doc_id, n): the documents of each file that ``write_flat`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(content.as_buffer(), _NAME)
                for at in range(0, len(found), BLOCK):
                    some = found[at : at + BLOCK]
                    ids = pa.array(some["doc_id"].astype(np.int64), mask=some["has"] == 0)
                    columns = [pa.array(np.full(len(some), part)), pa.array(np.arange(at, at + len(some))), ids, pa.array(some["n"].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "ordinal", "doc_id", "n"])

    files = spark.read.format("binaryFile").load(path).select(_part(F.col("path")).alias("part"), "content")
    return files.mapInArrow(run, "part long, ordinal long, doc_id long, n long")


def _part(file: Column) -> Column:
    return F.regexp_extract(file, r"part-(\d+)-", 1).cast("long")


def count_documents(docs: DataFrame, encode, eod: int) -> DataFrame:
    """(doc_id, n_tokens): write ``docs`` as flat files, scan them, name the documents.

    ``docs`` is read once.  The token files are removed; the places of their
    separators stay in the shared folder, as the result is read from them.
    """
    spark = docs.sparkSession
    made = common.fresh_path(spark, "tokens")
    tokens, named = write_flat(docs, encode, made, eod)
    if not common.exists(spark, tokens):  # no row was written
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    found = scan(spark, tokens, eod, ">u2").withColumn("part", _part(F.col("file")))
    common.drop_path(spark, tokens)
    rows = found.join(names(spark, named), ["part", "ordinal"], "full_outer")
    odd = F.col("start").isNull() | F.col("n").isNull() | ~F.col("ended") | (F.col("n") != F.col("n_tokens"))
    return rows.select("doc_id", F.when(odd, F.raise_error(F.lit("a document has no place in its token file")).cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens"))
