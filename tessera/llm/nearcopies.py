"""Near copies at a stated similarity: SimHash and multi-index hashing over long fingerprints.

Near copies in the usual sense -- a resemblance of 0.8 or more of their five-word
shingles -- differ in a sixth of the bits of a SimHash over these shingles, too
many for Hamming balls.  So each text has two SimHash fingerprints:

* the index, over its distinct words, which few edits hardly move: ``SEGMENTS``
  segments of 32 bits, each a table that is probed with a small Hamming ball: the
  value, and with each of the ``FLIPS`` bits flipped on which the words agree least;
* the complete fingerprint, over its distinct five-word shingles, ``BITS`` long:
  the distance gives the angle between two shingle sets, and with their sizes
  their resemblance, with a standard error of about 0.014 at 0.8.  Whatever met
  in a table is verified by it.

A table key's members are not paired all with all.  Each is verified against the one
that meets most others, what links so is contracted, and once more with a member of
another component; only keys whose members then still belong to several components
compare members of different components, block by block, and put out one link for
two components.  As equal texts are one node and linked ones one component, a large
group of copies costs about its number of texts; what costs more is a large group of
texts that are somewhat alike but no copies.

Words are lower-cased by A-Z.  Defined cases: null and empty texts and such
without words are equal and link to each other alone; fewer than five words make
one shingle; a null doc_id comes after all others; of rows equal in doc_id and
text one stays; an empty table gives an empty one; extra columns of any name stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import components
from .wordhash import mix, word_codes

WIDTH, SIMILARITY = 5, 0.8
#: What the estimated resemblance may fall short of the similarity.
SLACK = 0.02
SEGMENTS, BITS = 12, 1024
#: Bits of a segment that are flipped, one at a time: those on which the words are least agreed.
FLIPS = 6
#: About 20 bytes a row: a broadcast of at most some 10 MB.
BROADCAST_KEYS = 500_000
#: Rounds of comparing a table key's members with one of them before components left in it are compared with each other.
ROUNDS = 2
#: Members of a block; a task compares two blocks of a key, some rows of one at a time.
_BLOCK, _ROWS = 1024, 128
#: Codes hashed, and rows put out, at a time.
_CHUNK, _SLICE = 1 << 11, 512
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, SEGMENTS // 2 + BITS // 64, dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _balance(codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Twice the set bits less the number of codes, for each of 64 bits a seed."""
    total = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(codes), _CHUNK):
        hashed = mix(codes[at : at + _CHUNK, None] ^ seeds)
        total += np.unpackbits(hashed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return 2 * total - len(codes)


def _signs(balance: np.ndarray) -> np.ndarray:
    """The SimHash: 64 bits a number, as signed integers."""
    return np.packbits(balance > 0, bitorder="little").view(np.int64)


def _segments(balance: np.ndarray) -> np.ndarray:
    """A number a segment: its 32 bits, and above them the places of its least certain bits, five bits each."""
    rows = balance.reshape(-1, 32)
    value = np.packbits(rows > 0, axis=1, bitorder="little").view(np.uint32)[:, 0].astype(np.int64)
    places = np.argsort(np.abs(rows), axis=1, kind="stable")[:, :FLIPS]
    return value | (places << (32 + 5 * np.arange(FLIPS))).sum(1)


def shingle_codes(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct codes of the shingles of a word-code sequence."""
    if len(codes) == 0:
        return codes
    n = max(1, len(codes) - width + 1)
    key = np.zeros(n, np.uint64)
    for d in range(min(width, len(codes))):
        key = mix((key + codes[d : d + n]) * _MULT)
    return np.unique(key)


def prints_of(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, complete fingerprint, distinct shingles) of a UTF-8 text."""
    codes = word_codes(text.lower())
    shingles = shingle_codes(codes, width)
    half = SEGMENTS // 2
    return _segments(_balance(np.unique(codes), _SEEDS[:half])), _signs(_balance(shingles, _SEEDS[half:])), len(shingles)


_PRINTS = "doc_id long, text_hash long, node long, n long, idx array<long>, whole array<long>"


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                ids, texts, hashes = (batch.column(i).slice(at, _SLICE) for i in range(3))
                made = [prints_of(t.as_py(), width) for t in texts]
                # the node: equal fingerprints are one
                nodes = [np.uint64(xxhash.xxh64_intdigest(i.tobytes() + w.tobytes(), n)).astype(np.int64) for i, w, n in made]
                longs = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in range(2)]
                columns = [ids, hashes, pa.array(nodes, pa.int64()), pa.array([m[2] for m in made], pa.int64()), *longs]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PRINTS.split(", ")])
        common.release()

    return run


def prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Both fingerprints of each row of ``docs``, and its node."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8(), F.xxhash64(common.text_or_empty()).alias("text_hash"))
    return rows.mapInArrow(_prints(width), _PRINTS)


def _slots(nodes: DataFrame) -> DataFrame:
    """(slot, node, stored): where each node is stored and where it probes."""
    cut = nodes.where("n > 0").select("node", F.expr("posexplode(idx) as (seg, x)")).select("node", "x", F.expr("shiftleft(cast(seg as bigint), 32) | (x & 4294967295) as own"))
    flipped = F.transform(F.sequence(F.lit(0), F.lit(FLIPS - 1)), lambda k: F.struct(F.expr("own").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", F.col("x"), 32 + 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int"))).alias("slot"), F.lit(False).alias("stored")))
    ball = F.concat(F.array(F.struct(F.col("own").alias("slot"), F.lit(True).alias("stored"))), flipped)
    return cut.select("node", F.explode(ball).alias("b")).select("b.slot", "node", "b.stored")


def resemblance(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two structs (n, whole)."""
    whole = lambda x, i: F.get(F.col(f"{x}.whole"), F.lit(i))
    apart = sum((F.bit_count(whole(a, i).bitwiseXOR(whole(b, i))) for i in range(BITS // 64)), F.lit(0))
    m, n = F.col(f"{a}.n").cast("double"), F.col(f"{b}.n").cast("double")
    shared = F.cos(apart * (math.pi / BITS)) * F.sqrt(m * n)
    return shared / (m + n - shared)


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose complete fingerprints are near enough."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.struct("n", "whole").alias(f"of_{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return met.where(resemblance("of_a", "of_b") >= least).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of nodes with a link: root is the smallest node of the component."""
    spark, least, made = nodes.sparkSession, similarity - SLACK, []

    def written(rows: DataFrame, name: str) -> DataFrame:
        table, path = common.written(rows, name)
        made.append(path)
        return table

    slots = _slots(nodes)
    keys = slots.groupBy("slot").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("stored").alias("held"))
    keys = written(keys.where("low <> high and held").select("slot"), "keys")
    members = written(slots.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "slot", "left_semi"), "members")
    # What meets most others is most likely the text that its copies were made from.
    size = members.groupBy("slot").agg(F.count("*").alias("size"))
    sized = members.join(size, "slot")
    met = sized.where("stored").groupBy("node").agg(F.sum("size").alias("met"))
    members = written(sized.join(met, "node", "left").select("slot", "node", "stored", "size", F.coalesce("met", F.lit(0)).alias("met")), "met")

    labelled, roots = members.withColumn("root", F.col("node")), nodes.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(ROUNDS + 1):
        mixed = labelled.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("slot")
        left = labelled.join(mixed, "slot", "left_semi")
        if turn < ROUNDS:  # those stored there with the one that meets most, later with one of another component
            left = left.where("stored")
            first = left.groupBy("slot").agg(F.max(F.struct("met", "node", "root")).alias("top")) if turn == 0 else _others(left, turn)
            pairs = left.join(first.select("slot", F.col("top.node").alias("other"), F.col("top.root").alias("other_root")), "slot").where("root <> other_root").select(*_ordered("node", "other"))
            found = _verified(pairs.distinct(), nodes, least)
        else:
            found = _across(left, nodes, least)
        found = written(found, "near")
        if found.limit(1).count():
            roots = written(_merged(roots, found, written), "near-roots")
            labelled = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    kept, _ = common.written(roots, "linked")
    for path in made:
        common.drop_path(spark, path)
    return kept


def _merged(roots: DataFrame, found: DataFrame, written) -> DataFrame:
    """(node, root) with more links: components of the components that they join, not of all links anew."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
    joined = written(ends.where("x <> y").select(*_ordered("x", "y")).distinct(), "joined")
    step = components(joined).select(F.col("fp").alias("was"), F.col("root").alias("now"))
    moved = roots.join(step, roots["root"] == step["was"], "left").select("node", F.coalesce("now", "root").alias("root"))
    fresh = step.join(roots.select(F.col("root").alias("was")).distinct(), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return moved.unionByName(fresh)


def _across(left: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components that meet in a table key: one, at least, for each two that have any there.

    A key's members are dealt to blocks, and a task compares two blocks; comparisons
    are not rows, only links are.
    """
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", "slot"), blocks).cast("int")
    of = nodes.select("node", "n", "whole")
    rows = left.select("slot", "node", "root", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with")).join(of, "node")
    rows = rows.select("slot", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "root", "n", "whole")
    dealt = rows.repartition("slot", "i", "j").sortWithinPartitions("slot", "i", "j")
    return dealt.mapInArrow(_compare(least), "a long, b long").select(*_ordered("a", "b")).distinct()


def _compare(least: float):
    """Links between the members of each (slot, i, j); rows come sorted by it."""
    words = BITS // 64

    def links(block: np.ndarray, nodes: np.ndarray, roots: np.ndarray, n: np.ndarray, whole: np.ndarray, i: int, j: int) -> np.ndarray:
        xs, ys = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for at in range(0, len(xs), _ROWS):
            x = xs[at : at + _ROWS]
            apart = np.bitwise_count(whole[x][:, None, :] ^ whole[ys][None, :, :]).sum(-1, dtype=np.int64)
            m, o = n[x][:, None].astype(float), n[ys][None, :].astype(float)
            shared = np.cos(apart * (math.pi / BITS)) * np.sqrt(m * o)
            apart_roots = roots[x][:, None] < roots[ys][None, :] if i == j else roots[x][:, None] != roots[ys][None, :]
            p, q = np.nonzero((shared / (m + o - shared) >= least) & apart_roots)
            found.append(np.stack([x[p], ys[q]], 1))
        both = np.concatenate(found) if found else np.zeros((0, 2), int)
        _, first = np.unique(roots[both], axis=0, return_index=True)
        return nodes[both[first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            slot, i, j, block, nodes, roots, n, whole = (np.concatenate(c) for c in zip(*parts, strict=True))
            edge = np.flatnonzero((slot[1:] != slot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *edge.tolist(), len(slot)]
            made = [links(block[a:b], nodes[a:b], roots[a:b], n[a:b], whole[a:b], i[a], j[a]) for a, b in zip(bounds, bounds[1:], strict=False)]
            both = np.concatenate(made)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            now.append(batch.column(7).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words))
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last, perhaps unfinished, key begins
            if cut:
                yield out([*held, [c[:cut] for c in now]])
                held = [[c[cut:] for c in now]]
            elif held and (held[0][0][0], held[0][1][0], held[0][2][0]) != (now[0][0], now[1][0], now[2][0]):
                yield out(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield out(held)
        common.release()

    return run


def _others(left: DataFrame, turn: int) -> DataFrame:
    """Of each table key the member that meets most in its ``turn``-th smallest component, by a hash of the component."""
    place = F.xxhash64("root", F.lit(turn))
    return left.groupBy("slot").agg(F.min(F.struct(place.alias("place"), (-F.col("met")).alias("less"), "node", "root")).alias("top"))


def near_components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root) for each row of ``docs``: rows of one root are near copies, by links of links."""
    found, found_path = common.written(prints(docs, width), "prints")
    nodes, nodes_path = common.written(found.groupBy("node").agg(F.first("n").alias("n"), F.first("idx").alias("idx"), F.first("whole").alias("whole")), "nodes")
    roots = linked(nodes, similarity)
    rows, _ = common.written(found.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")), "near")
    for path in (found_path, nodes_path):
        common.drop_path(docs.sparkSession, path)
    return rows


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest (doc_id, text hash)."""
    return common.first_of_groups(docs, near_components(docs, width, similarity))
