"""Exact numbers of distinct n-grams of groups of texts, counted from sorted blocks of hashes.

A gram is a 64-bit hash made of the hashes of its words.  Each task takes its texts
in chunks, sorts a chunk's grams group by group and sends what is distinct in it,
cut into ranges of hashes: one row a chunk and range, as differences in compressed byte
planes.  A range is then counted by itself, so that no group and
no frequent gram is one task, and no gram is a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grams held before a chunk is sent; only decides how much is merged beforehand.
CHUNK = 8_000_000
_COUNTED = "side string, bucket_id string, whole boolean, n int, total long, unique_grams long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser: a one-to-one map."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    x = np.sort(np.concatenate(parts) if len(parts) > 1 else parts[0])
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _packed(pieces: list[np.ndarray]) -> bytes:
    """Sorted pieces as differences in byte planes, compressed."""
    steps = np.concatenate(pieces)
    at = 0
    for piece in pieces:
        steps[at + 1 : at + len(piece)] -= piece[:-1]
        at += len(piece)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, counts: list[int]) -> list[np.ndarray]:
    m = sum(counts)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * m, codec="zstd", asbytes=True), np.uint8).reshape(8, m)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return [np.cumsum(x, dtype=np.uint64) for x in np.split(steps, np.cumsum(counts)[:-1])]


def _sent(held: dict, totals: dict, ranges: int) -> Iterator[pa.RecordBatch]:
    """A chunk's rows (range, what is in it, its grams); the totals go with the first."""
    groups = [(key, _distinct(parts)) for key, parts in held.items()]
    starts = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(u, starts).tolist(), len(u)] for _, u in groups]
    for r in range(ranges):
        found = [(key, u[c[r] : c[r + 1]]) for (key, u), c in zip(groups, cuts, strict=True) if c[r] < c[r + 1]]
        if not found and not totals:
            continue
        data = _packed([u for _, u in found]) if found else b""
        about = json.dumps({"counts": [[*key, len(u)] for key, u in found], "totals": [[*key, int(t)] for key, t in totals.items()]})
        totals = {}
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([about]), pa.array([data], pa.binary())], names=["r", "about", "data"])


def _grams(ranges: int, most: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals, size = {}, {}, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            codes = np.array([code[k] for k in keys], np.int64)
            lists = batch.column(2).take(pa.array(np.argsort(codes, kind="stable")))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the text's end
            ends = np.cumsum(np.bincount(np.sort(codes), weights=sizes, minlength=len(code)).astype(np.int64))
            g = words
            for n in range(1, most + 1):
                if n > 1:
                    g = _mixed(g[:-1]) * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] if len(g) else g
                begin = 0
                for (side, bucket), end in zip(code, ends, strict=True):
                    own = g[begin:end][left[begin : min(end, len(g))] >= n]
                    begin = end
                    key = (side, bucket, n)
                    totals[key] = totals.get(key, 0) + len(own)
                    if len(own):
                        held.setdefault(key, []).append(own := _distinct([own]))
                        size += len(own)
            if size >= chunk:
                yield from _sent(held, totals, ranges)
                held, totals, size = {}, {}, 0
        if totals:
            yield from _sent(held, totals, ranges)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of distinct grams, range by range; rows come sorted by range."""
    at, held, totals = None, {}, {}

    def result() -> pa.RecordBatch:
        rows = [(side, bucket, False, n, total, 0) for (side, bucket, n), total in totals.items()]
        rows += [(side, None, True, n, total, 0) for (side, _, n), total in totals.items()]
        wholes: dict = {}
        for key in list(held):
            u = _distinct(held.pop(key))
            rows.append((key[0], key[1], False, key[2], 0, len(u)))
            wholes.setdefault((key[0], key[2]), []).append(u)
        for side, n in list(wholes):
            rows.append((side, None, True, n, 0, len(_distinct(wholes.pop((side, n))))))
        types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _COUNTED.split(", ")])

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.column(0)[i].as_py()
            if r != at and at is not None:
                yield result()
                held, totals = {}, {}
            at, about = r, json.loads(batch.column(1)[i].as_py())
            for side, bucket, n, total in about["totals"]:
                totals[side, bucket, n] = totals.get((side, bucket, n), 0) + total
            if about["counts"]:
                pieces = _unpacked(batch.column(2)[i].as_buffer(), [x[3] for x in about["counts"]])
                for (side, bucket, n, _), u in zip(about["counts"], pieces, strict=True):
                    held.setdefault((side, bucket, n), []).append(u)
    if at is not None:
        yield result()


def counts(hashed: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """(side, bucket_id, whole, n, total, unique_grams) of (side, bucket_id, h), h the word hashes of a text.

    ``whole`` rows are of a side over all buckets.  Each range holds the hashes of one
    in ``spark.sql.shuffle.partitions`` parts of all.
    """
    ranges = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = hashed.select("side", "bucket_id", "h").mapInArrow(_grams(ranges, most, chunk), "r int, about string, data binary")
    found = blocks.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(_counted, _COUNTED)
    sums = found.groupBy("side", "bucket_id", "whole", "n").agg(F.sum("total").alias("total"), F.sum("unique_grams").alias("unique_grams"))
    return sums.where("unique_grams > 0")
