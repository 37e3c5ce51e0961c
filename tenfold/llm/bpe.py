"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary; a pre-token that is a vocabulary entry as a
whole is its rank, with no merges.  Second tier: the bytes of any other pre-token form a linked
list, and a heap yields the pair of neighbours with the lowest rank, the leftmost first, until no
pair is in the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tenfold.llm import common
from tenfold.llm.pretokens import IDS, Encoder, packed

#: Text bytes encoded at once.
AT_ONCE = 2 << 20


class MinimalPerfectHash:
    """Keys to 0 .. n - 1 with no gaps: hash, then displace the buckets, largest first.

    A bucket of several keys keeps the displacement that puts all on free slots; a bucket of one
    key keeps the free slot itself, as a negative number.
    """

    def __init__(self, keys: Sequence[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = -(-n // 3)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift, self.keys, self.order = [0] * self.buckets, [b""] * n, [-1] * n
        taken = bytearray(n)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                slots = {((hashes[i] >> 24) + d * (hashes[i] & 0xFFFFFF | 1)) % n for i in members[b]}
                if len(slots) == len(members[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in members[b]:
                s = ((hashes[i] >> 24) + d * (hashes[i] & 0xFFFFFF | 1)) % n
                taken[s], self.keys[s], self.order[s] = 1, keys[i], i
        free = (s for s in range(n) if not taken[s])
        for b, of in enumerate(members):
            if len(of) == 1:
                s = next(free)
                self.shift[b], self.keys[s], self.order[s] = -1 - s, keys[of[0]], of[0]

    def get(self, key: bytes) -> int:
        """The index of a key, -1 if it is none."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else ((h >> 24) + d * (h & 0xFFFFFF | 1)) % self.n
        return self.order[s] if self.keys[s] == key else -1


class BytePairs:
    """A vocabulary of ranks; `encode` gives the ids of one pre-token's bytes, `decode` the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        entries = list(ranks)
        self.hash, self.ids = MinimalPerfectHash(entries), [ranks[e] for e in entries]
        self.of = {i: e for e, i in ranks.items()}

    def encode(self, piece: bytes) -> list[int]:
        at = self.hash.get(piece)
        return [self.ids[at]] if at >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.ranks.get
        # after[i]: where the part that starts at i ends; before[i]: where the part before it starts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end or middle == end:
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.of.__getitem__, ids))


@functools.lru_cache(2)
def byte_pairs(path: str) -> BytePairs:
    """The vocabulary of a rank file."""
    with open(path, "rb") as f:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    pairs = byte_pairs(path)
    return Encoder(pattern, lambda tokens: packed([array("I", pairs.encode(t.encode())).tobytes() for t in tokens]))


def _mapped(path: str, pattern: str, schema: list, of):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pairs = encoder(path, pattern).encode, byte_pairs(path)
        for batch in batches:
            _, off = common.utf8(batch.column(1))
            for a, b in common.slices(off, AT_ONCE):
                part = batch.slice(a, b - a)
                found = [of(ids, pairs) for ids in encode([t or "" for t in part.column(1).to_pylist()])]
                columns = [part.column(0), *(pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(schema))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(n for n, _ in schema)])

    return rows


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, a null text being empty.

    Special tokens are ordinary text.  Every row of `docs` gives one row, repeated rows too.
    """
    schema = [("ids", pa.list_(pa.int32()))]
    return common.text_of(docs).mapInArrow(_mapped(path, pattern, schema, lambda ids, _: (ids.astype(np.int32),)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and data (binary) of rows of ids; null ids give no bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in batches:
            data = [pairs.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and, of the bytes decoded from those ids, decoded_sha256; null texts are empty, null and repeated doc_ids stay."""
    decimal = [b"%d" % i for i in range(max(byte_pairs(path).of) + 1)]

    def digest(ids: np.ndarray, pairs: BytePairs) -> tuple[int, str, str]:
        listed = ids.tolist()
        text = b" ".join(map(decimal.__getitem__, listed))
        return len(listed), hashlib.sha256(text).hexdigest(), hashlib.sha256(pairs.decode(listed)).hexdigest()

    schema = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return common.text_of(docs).mapInArrow(_mapped(path, pattern, schema, digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`digests` of every document by the public vocabulary of 50,000 entries."""
    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
