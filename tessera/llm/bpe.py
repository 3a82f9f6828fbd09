"""Byte-level BPE by longest match and backtracking.

A text is cut by the vocabulary's pattern; each piece is encoded apart.  The
bytes of a piece are read as Latin-1 characters, so one Aho-Corasick automaton
over all tokens gives the longest match at a position, and shorter ones after it.
A sequence of tokens is the exact merge result iff each token encodes to itself
and each adjacent pair is the encoding of its own two tokens' bytes.  So the
encoder takes the longest token that is compatible with the one before, and
steps back where none is; positions known to fail are not tried again, which
makes it linear in the piece.  Pair compatibility is memoised.

Defined cases: a null or empty text has no ids; a piece that is itself a token is
that token; special-token strings in a text are ordinary text; doc_ids repeat
and may be null; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the memo tables of one worker; beyond them a table starts anew.
MAX_PIECES = 300_000
MAX_PAIRS = 1_000_000
#: Longer pieces are encoded without being remembered.
MAX_REMEMBERED = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
#: A chunk that any usual pattern leaves whole: a space and Latin letters.
_PLAIN = re.compile(r" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
_UNREACHED = (-1, -1)


class Encoder:
    """Encodes and decodes texts by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        # Cutting at spaces first is right for the pattern it was made for; any other is applied to whole texts.
        self.chunks = re.compile(r"(?<=\S)(?= \S)").split if pattern == public_tokenizers.PATTERN else (lambda text: [text])
        self.plain = _PLAIN if pattern == public_tokenizers.PATTERN else (lambda chunk: None)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._pieces: dict[str, bytes] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._chunks: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self._made: dict[int, tuple[int, int] | None] = {}
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items() if self.last_merge(rank) != _UNREACHED}
        self.longest = max(map(len, ranks))

    def merge(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """The defining algorithm by ranks under ``below``, for the bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 62))
            joined = parts[best] + parts[best + 1]
            if ranks.get(joined, below) >= below:
                break
            parts[best : best + 2] = [joined]
        return [ranks[p] for p in parts]

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte.

        A token that merging its own bytes never reaches has _UNREACHED.
        """
        if (known := self._made.get(token, 0)) == 0:
            data = self.bytes_of[token]
            known = None
            if len(data) > 1:
                parts = self.merge(data, below=token)
                known = (parts[0], parts[1]) if len(parts) == 2 else _UNREACHED
            self._made[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between the two tokens.

        Merges are undone from the latest (highest rank) back.  While a token
        stood at the border, every merge across it would have had to come later
        than the merge that replaced it.
        """
        if (known := self._pairs.get((left, right))) is not None:
            return known
        if len(self._pairs) >= MAX_PAIRS:
            self._pairs.clear()
        a, b, until, known = left, right, 1 << 62, True
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < until:
                known = False
                break
            undo_a, undo_b = self.last_merge(a), self.last_merge(b)
            if undo_a is None and undo_b is None:
                break
            # Of equal ranks the left one merges first, so the right one is undone first.
            if undo_b is None or (undo_a is not None and a > b):
                # a crossing merge of the same rank lies to the right of a's and so comes later
                until, a = a, undo_a[1]
            else:
                # a crossing merge of the same rank lies to the left of b's and so comes first
                until, b = b + 1, undo_b[0]
        self._pairs[left, right] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        if token is not None:
            return [token]
        text, n = data.decode("latin-1"), len(data)
        longest, rank_of, pairs = self.automaton.longest_prefix, self.latin.get, self._pairs
        tokens: list[int] = []
        starts: list[int] = []
        # (end, token) from which no encoding of the rest was found
        failed: set[tuple[int, int]] = set()
        at, previous = 0, -1
        length = longest(text[: self.longest])
        while at < n:
            while length:
                token = rank_of(text[at : at + length])
                if token is not None and (not failed or (at + length, token) not in failed):
                    if previous < 0:
                        break
                    fits = pairs.get((previous, token))
                    if self.compatible(previous, token) if fits is None else fits:
                        break
                length -= 1
            if length:
                tokens.append(token)
                starts.append(at)
                at += length
                previous = token
                length = longest(text[at : at + self.longest])
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte")
                failed.add((at, tokens.pop()))
                end, at = at, starts.pop()
                previous = tokens[-1] if tokens else -1
                length = end - at - 1
        return tokens

    def _encode_chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.split(chunk):
            packed = self._pieces.get(piece)
            if packed is None:
                packed = array("I", self.encode_piece(piece.encode())).tobytes()
                if len(piece) <= MAX_REMEMBERED:
                    if len(self._pieces) >= MAX_PIECES:
                        self._pieces.clear()
                    self._pieces[piece] = packed
            out.append(packed)
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        A single space between two non-spaces always begins a piece, and the
        pattern looks at nothing before a piece, so the text is first cut there
        and whole chunks are remembered.
        """
        known = self._chunks
        out = []
        for chunk in self.chunks(text):
            packed = known.get(chunk)
            if packed is None:
                packed = array("I", self.encode_piece(chunk.encode())).tobytes() if self.plain(chunk) else self._encode_chunk(chunk)
                if len(chunk) <= MAX_REMEMBERED:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[chunk] = packed
            out.append(packed)
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of ids and of the decoded bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                packed = coder.encode_packed(text)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(coder.decode_packed(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(run, ENCODED)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            ids = [memoryview(coder.encode_packed(t)).cast("I").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); undecodable bytes become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            texts = [b"".join(map(coder.bytes_of.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
