"""Repeats across documents without a row for each occurrence.

Documents are dealt into groups of a few megabytes.  A group reduces what it holds to distinct keys,
packs those of one bucket into one array and sends it there; a bucket answers each group with the
keys that concern it.  However often a key occurs, a bucket meets it once from each group, so no key
is hot; and a group's answer is joined by the group's number, not by document.  Both sides are sized
from Catalyst's estimate of the input, and so is the number of partitions they are dealt into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenfold.llm import common

#: Estimated input bytes of a group and of a bucket.
GROUP, BUCKET = 4 << 20, 16 << 20
#: A null doc_id counts as larger than any.
NO_ID = np.iinfo(np.int64).max
PACKED = "b int, g int, data binary"


def dealt(docs: DataFrame, size: int, groups: int) -> DataFrame:
    """g, doc_id, text and rest: all other columns, carried along as one; `size` bytes in all."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text",)]
    g = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g")
    dealt = docs.select(g, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("rest"))
    return common.spread(dealt, size, "g")


def undealt(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, text being what `finish` kept."""
    return found.select(*(F.col("kept").cast("string").alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


class Group:
    """The rows of a group, by doc_id, then text."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        if table.num_rows > 1:
            table = table.append_column("_id", pa.array(ids))
            table = table.sort_by([("_id", "ascending"), ("text", "ascending")])
            ids = table["_id"].to_numpy()
        self.table, self.ids = table, ids
        self.raw, self.off = common.utf8(table["text"])

    def slices(self, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last row, bytes and offsets of runs of rows."""
        for a, b in common.slices(self.off, most):
            yield a, b, self.raw[self.off[a] : self.off[b]], self.off[a : b + 1] - self.off[a]

    def text(self, row: int) -> bytes:
        return self.raw[self.off[row] : self.off[row + 1]].tobytes()


def pack(g: int, buckets: np.ndarray, data: np.ndarray) -> pa.Table:
    """A row for each bucket that gets any of `data`, in the order in which they stand there."""
    order = np.argsort(buckets, kind="stable")
    data, buckets = data[order], buckets[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]]) if len(buckets) else np.zeros(1, int)
    to = [int(buckets[i]) for i in cut[:-1]]
    return pa.table({"b": pa.array(to, pa.int32()), "g": pa.array([g] * len(to), pa.int32()), "data": pa.array([data[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})


def unpack(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed entries and the group of each."""
    parts = [np.frombuffer(d.as_buffer(), kind) for d in table["data"]]
    groups = np.repeat(table["g"].to_numpy().astype(np.int32), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), groups


def answer(b: int, groups: np.ndarray, data: np.ndarray) -> pa.Table:
    """Entries for each group, as rows of PACKED."""
    out = pack(b, groups, data)
    return pa.table({"b": out["g"], "g": out["b"], "data": out["data"]})


def gather(by_group: DataFrame, work: Callable[[Group], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """PACKED rows of what `work` makes of each group: buckets and entries."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pack(key[0].as_py(), *work(Group(table)))

    return by_group.groupBy("g").applyInArrow(run, PACKED)


def regather(by_group: DataFrame, answers: DataFrame, work: Callable[[Group, pa.Table], tuple]) -> DataFrame:
    """As `gather`, with the group's answers."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        return pack(key[0].as_py(), *work(Group(table), found))

    return by_group.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, PACKED)


def decide(packed: DataFrame, size: int, kind: np.dtype, work) -> DataFrame:
    """PACKED rows of what `work` answers, from the entries of a bucket and their groups: groups and entries; `size` bytes are the input's."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return answer(key[0].as_py(), *work(*unpack(table, kind)))

    return common.spread(packed, size, "b").groupBy("b").applyInArrow(run, PACKED)


def finish(by_group: DataFrame, answers: DataFrame, work: Callable[[Group, pa.Table], tuple]) -> DataFrame:
    """doc_id, kept, n, n_removed, n_spans and rest of each row; `work` gives the kept bytes and the three counts."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        group = Group(table)
        texts, n, removed, spans = work(group, found)
        own = group.table
        kept = pa.array([t if ok else None for t, ok in zip(texts, own["text"].is_valid().to_pylist())], pa.binary())
        counts = [pa.array(np.asarray(x, np.int64)) for x in (n, removed, spans)]
        return pa.Table.from_arrays([own["doc_id"], kept, *counts, own["rest"]], names=["doc_id", "kept", "n", "n_removed", "n_spans", "rest"])

    schema = StructType.fromDDL("doc_id long, kept binary, n long, n_removed long, n_spans long").add(by_group.schema["rest"])
    return by_group.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, schema)


def first_of(groups: np.ndarray, data: np.ndarray, rank: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For keys a, b: to each group whose entry is not the first by `rank`, or is marked `more`, the one that is."""
    order = np.lexsort([data[c] for c in reversed(["a", "b", *rank])])
    data, groups = data[order], groups[order]
    new = np.ones(len(data), bool)
    new[1:] = (data["a"][1:] != data["a"][:-1]) | (data["b"][1:] != data["b"][:-1])
    key = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    answered = data[starts][key]
    keep = data["more"] > 0
    for c in rank:
        keep |= data[c] != answered[c]
    return groups[keep], answered[keep]


def found_in(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 128-bit keys a, b the place of each in `keys` (sorted by a), -1 where it is not there."""
    if not len(keys):
        return np.full(len(a), -1)
    at = np.minimum(np.searchsorted(keys["a"], a), len(keys) - 1)
    return np.where((keys["a"][at] == a) & (keys["b"][at] == b), at, -1)


KEY = np.dtype("<u4")


def counted(keys: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of keys (bucket above, key below), each of a kind from 0 to 3, for `repeated`: per bucket the numbers of keys of kinds 0, 1 and 2, then the keys by kind."""
    bucket = (keys >> np.uint64(32)).astype(np.int32)
    order = np.lexsort([kind, bucket])
    keys, bucket, kind = keys[order].astype(KEY), bucket[order], kind[order]
    if not len(keys):
        return bucket, keys
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.stack([np.add.reduceat(kind == k, cut, dtype=np.int64) for k in range(3)], axis=1).astype(KEY).ravel()
    at = np.repeat(cut, 3)
    return np.insert(bucket, at, bucket[at]), np.insert(keys, at, sizes)


def repeated(data: np.ndarray, of: np.ndarray, needed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """From a bucket's `counted` keys, to each group those of its keys that occur more than once in all.

    Bit 0 of a key's kind says that it occurs more than once in its group.  With `needed` 2 a key must also
    have bit 1 of its kind in some group.
    """
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    size = np.diff(np.append(cut, len(of)))
    number = np.arange(len(of)) - np.repeat(cut, size) - 3
    kind = np.zeros(len(of), np.uint8)
    edge = np.zeros(len(cut), np.int64)
    for k in range(3):
        edge = edge + data[cut + k]
        kind += number >= np.repeat(edge, size)
    keep = number >= 0
    k, kind, of = data[keep], kind[keep], of[keep]
    order = np.argsort(k, kind="stable")
    k, kind, of = k[order], kind[order], of[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    times = np.diff(np.append(cut, len(k)))
    found = np.bitwise_or.reduceat(kind, cut)
    wanted = np.repeat(((times > 1) | (found & 1 > 0)) & (found & needed == needed), times)
    return of[wanted], k[wanted]


def member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is among sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def keys_of(found: pa.Table, kind: np.dtype) -> np.ndarray:
    """Sorted numbers of answered keys: the bucket above, the key below."""
    keys = [np.frombuffer(d.as_buffer(), kind).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, d in zip(found["b"].to_pylist(), found["data"])]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def covered(marks: np.ndarray, length: int) -> np.ndarray:
    """Positions within `length` from a mark on."""
    c = np.zeros(len(marks) + length, np.int32)
    c[: len(marks)] += marks
    c[length:] -= marks
    return np.cumsum(c)[: len(marks)] > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
