"""Conflict-constrained best-fit packing of texts into bins of a fixed number of tokens.

Bins are kept in order of the room left in them and carry bitmaps of the duplicate clusters and of
the sources they hold.  A text goes, longest first, into the tightest bin that has room for it and no
conflict: the search starts at its successor in residual order and goes on through larger residuals
until a bin is compatible, or a new one is opened.  Two texts of a duplicate cluster never share a bin,
nor do more than `same_source` texts of a source.

Documents are dealt into shards by hash and each shard is packed by one task.  A shard holds a bounded
number of documents however skewed sources or clusters are, as neither decides the shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common, words

CAPACITY, SAME_SOURCE, SHARD = 2048, 2, 8192


class Bins:
    """Open bins by residual."""

    def __init__(self, capacity: int, same_source: int):
        self.capacity, self.same_source = capacity, same_source
        self.open: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.used: list[int] = []

    def add(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes a text, and where it starts there."""
        own, of = 1 << cluster, 1 << source
        at = bisect_left(self.open, (length, -1))
        while at < len(self.open):
            b = self.open[at][1]
            if not self.clusters[b] & own and not self.sources[b][-1] & of:
                del self.open[at]
                break
            at += 1
        else:
            b = len(self.used)
            self.clusters.append(0)
            self.sources.append([0] * self.same_source)
            self.used.append(0)
        self.clusters[b] |= own
        planes = self.sources[b]  # plane k: sources with more than k texts
        for k in range(self.same_source):
            if not planes[k] & of:
                planes[k] |= of
                break
        start = self.used[b]
        self.used[b] += length
        if self.used[b] < self.capacity:
            insort(self.open, (self.capacity - self.used[b], b))
        return b, start


SIZED = "doc_id long, source string, length long, cluster binary"
PACKED = "doc_id long, piece long, bin long, bin_start long, length long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, length (words and an end mark) and cluster (a hash of the words in lower case).

    Null and empty texts are an end mark alone, all of one cluster.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.utf8(batch.column(1))
            length, cluster = [], []
            for a, b in common.slices(off, 1 << 20):
                part = raw[off[a] : off[b]]
                starts, _, row = words.spans(part, off[a : b + 1] - off[a])
                length.append(np.bincount(row, minlength=b - a) + 1)
                cluster += [xxhash.xxh3_128_digest(b" ".join(raw[off[i] : off[i + 1]].tobytes().lower().split())) for i in range(a, b)]
            n = np.concatenate(length) if length else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cluster, pa.binary())], names=["doc_id", "source", "length", "cluster"])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source")).mapInArrow(rows, SIZED)


def clustered(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of `sized` whose clusters are those of near copies: `classes` has doc_id and class_id, one row a doc_id; others keep theirs."""
    of = classes.select("doc_id", F.concat(F.lit("class "), F.col("class_id").cast("string")).cast("binary").alias("_class"))
    return sizes.join(of, "doc_id", "left").withColumn("cluster", F.coalesce("_class", "cluster")).select("doc_id", "source", "length", "cluster")


def pack(sizes: DataFrame, capacity: int = CAPACITY, same_source: int = SAME_SOURCE, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, bin, bin_start and length: where each piece of each row of `sized` goes.

    A text longer than a bin is cut into pieces of a whole bin each and a last one of what is left;
    every word of every row is in one piece.  Null sources and clusters are in no conflict.  Rows
    that repeat a doc_id are packed each on its own.  Bins are numbered across shards.
    """
    sizes = common.written(sizes, "packing-sizes")
    shards = max(1, -(-sizes.count() // shard))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["length"].to_pylist(), table["doc_id"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist()), key=lambda r: (-((r[0] - 1) % capacity), r[1] is None, r[1] or 0, r[3] or b"", r[2] or ""))
        bins, sources, clusters = Bins(capacity, same_source), {}, {}
        out, whole = [], []
        for length, doc_id, source, cluster in rows:
            pieces = -(-length // capacity)
            whole += [(doc_id, p) for p in range(pieces - 1)]
            s = sources.setdefault(source if source is not None else len(sources), len(sources))
            c = clusters.setdefault(cluster if cluster is not None else len(clusters), len(clusters))
            last = length - (pieces - 1) * capacity
            b, start = bins.add(last, s, c)
            out.append((doc_id, pieces - 1, b, start, last))
        out += [(doc_id, p, len(bins.used) + i, 0, capacity) for i, (doc_id, p) in enumerate(whole)]
        base = key[0].as_py() << 32
        doc_id, piece, b, start, length = zip(*out)
        return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "piece": pa.array(piece, pa.int64()), "bin": pa.array([base + x for x in b], pa.int64()), "bin_start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64())})

    return sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "length"), F.lit(shards))).groupBy("shard").applyInArrow(fill, PACKED)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return pack(sized(common.table(spark, sf_dir, "documents")))
