"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

A pre-token's bytes form a linked list. Every pair of neighbours that has a rank sits in the bucket of that rank; a
bitmap of two levels says which buckets are in use, and find-first-set on it gives the lowest rank. Merging a pair
changes the pairs at both its sides; what the buckets still hold of the old pairs is stale and skipped. The work is
linear in the pre-token's length for any number of merges, so a pre-token of a megabyte is no special case. Pre-tokens
seen before come from a bounded table in each Python worker.

Defined cases: a null or empty text has no tokens and decodes to nothing; texts of any length are encoded whole; equal
texts give equal ids; an empty table gives an empty result; other columns are ignored by `encode`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pathwise.llm.common import slices, table, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a Python worker keeps, twice over.
KEPT = 300_000
KEPT_BYTES = 64
BITS = 256
BIT = [1 << k for k in range(BITS)]


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is one of the public tokenizers' files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one pre-token."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    of = [get(word[i : i + 2], -1) for i in range(n)]  # rank of the pair that begins at each position; -1: none
    of[n - 1] = -1
    buckets: dict[int, list[int]] = {}
    low, top = {}, 0
    for i, r in enumerate(of):
        if r >= 0:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                h = r >> 8
                low[h] = low.get(h, 0) | BIT[r & 255]
                top |= 1 << h
    while top:
        h = (top & -top).bit_length() - 1
        bits = low[h]
        rank = (h << 8) | ((bits & -bits).bit_length() - 1)
        queue = buckets.pop(rank)
        low[h] = bits = bits & (bits - 1)
        if not bits:
            top &= top - 1
        if len(queue) > 1:
            queue.sort()
        for k, i in enumerate(queue):
            if of[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            of[j] = -1
            if end < n:
                before[end] = i
                r = get(word[i : after[end]], -1)
            else:
                r = -1
            of[i] = r
            lower = False
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    h = r >> 8
                    low[h] = low.get(h, 0) | BIT[r & 255]
                    top |= 1 << h
                lower = r <= rank
            p = before[i]
            if p >= 0:
                of[p] = r = get(word[p:end], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        buckets[r] = [p]
                        h = r >> 8
                        low[h] = low.get(h, 0) | BIT[r & 255]
                        top |= 1 << h
                    lower = lower or r <= rank
            if lower and k + 1 < len(queue):  # a new pair comes first: the rest of this bucket waits
                rest = queue[k + 1 :]
                if rank in buckets:
                    buckets[rank].extend(rest)
                else:
                    buckets[rank] = rest
                    h = rank >> 8
                    low[h] = low.get(h, 0) | BIT[rank & 255]
                    top |= 1 << h
                break
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; unknown ones are merged and kept."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        word = piece.encode()
        ids = self.older.get(piece) or np.array(merge(word, self.ranks), "<u4").tobytes()
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT:  # pieces that have come since the last time stay
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join([self[piece] for piece in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(name: str, pattern: str | None = None) -> Codec:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return Codec(vocabulary_path(name), pattern)


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks, pattern)
        for batch in slices(batches):
            ids = [of.encode(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with `decoded`, the bytes that the ids stand for."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks)
        for batch in slices(batches):
            decoded = [of.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], batch["ids"], pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """`decode(encode(docs))` in one pass, by one Python worker and one set of tables."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks, pattern)
        for batch in slices(batches):
            ids = [of.encode(x) for x in batch["text"].to_pylist()]
            decoded = [of.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    both = round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
