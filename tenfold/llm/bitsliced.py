"""Exact top-k inner-product search on a bit-sliced index.

Every quantised component of a block of rows is kept as bit slices: one bitmap per binary digit,
one bit per row.  A query's scores are never formed row by row; its weighted sum of components is
added up slice by slice with carry-save bitmap adders, and the best rows are selected from the most
significant slice of the sum downward.  Rows tied at the boundary are resolved exactly by vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenfold.llm import common

#: Rows in a block of the index and queries that meet it in one task.
ROWS, QUERIES_AT_ONCE = 32768, 2048
#: Quantised components from this on are no longs, as scores must be.
LARGEST = float(1 << 63)
LONG = 1 << 63


class BitSlicedBlock:
    """Slices of one block of rows; rows must be in ascending id order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, self.dims = values.shape
        top = int(np.abs(values).max(initial=1))
        self.bias = 1 << top.bit_length()
        self.width = top.bit_length() + 1
        self.words = max(1, -(-n // 64))
        kind = np.uint32 if self.width <= 32 else np.uint64
        biased = (values.astype(np.uint64) + np.uint64(self.bias)).astype(kind)
        self.largest = top
        plain = np.zeros((self.dims, self.width, self.words * 8), np.uint8)
        for bit in range(self.width):
            packed = np.packbits(((biased >> kind(bit)) & kind(1)).astype(np.uint8), axis=0, bitorder="little")
            plain[:, bit, : packed.shape[0]] = packed.T
        plain = plain.reshape(self.dims * self.width, -1).view(np.uint64)
        self.slices = np.concatenate([plain, ~plain])
        alive = np.zeros(self.words * 8, np.uint8)
        alive[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.alive = alive.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit slices, least significant first, of sum |q| * (component + bias, complemented where q < 0)."""
        columns: dict[int, list[int]] = {}
        for d in np.flatnonzero(query):
            weight, first = abs(int(query[d])), (int(d) + (self.dims if query[d] < 0 else 0)) * self.width
            for j in range(weight.bit_length()):
                if weight >> j & 1:
                    for bit in range(self.width):
                        columns.setdefault(j + bit, []).append(first + bit)
        out, carried, column = [], np.zeros((0, self.words), np.uint64), 0
        last = max(columns, default=-1)
        while column <= last or len(carried):
            x = np.concatenate([self.slices[columns.get(column, [])], carried])
            more = []
            while len(x) > 1:
                third = len(x) // 3
                if third:
                    a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                    odd = a ^ b
                    more.append((a & b) | (odd & c))
                    x = np.concatenate([odd ^ c, x[3 * third :]])
                else:
                    more.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(more) if more else carried[:0]
            column += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows without the query's own, ties to smaller ids."""
        open_rows = self.alive.copy()
        for at in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")):
            open_rows[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure = np.zeros(self.words, np.uint64)
        for digit in reversed(self.sums(query)):
            better = sure | (open_rows & digit)
            n = int(np.bitwise_count(better).sum())
            if n > k:
                open_rows &= digit
            else:
                sure = better
                open_rows &= ~digit
                if n == k:
                    break
        chosen = self._rows(sure)
        if len(chosen) < k:
            chosen = np.concatenate([chosen, self._rows(open_rows, k - len(chosen))])
        return self.ids[chosen], self._scores(chosen, query)

    def _scores(self, chosen: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products, as Python's integers where a long might not hold them."""
        if self.largest * sum(abs(int(x)) for x in query) < LONG:
            return self.values[chosen] @ query
        out = np.empty(len(chosen), object)
        out[:] = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in self.values[chosen]]
        return out

    @staticmethod
    def _rows(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
        """Rows whose bit is set, the first `most` of them."""
        words = np.flatnonzero(bitmap)[:most]
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return (words[at] * 64 + bit)[:most]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


#: `over`: -1 or 1 where the score is below or above all longs; `score` is then the least or greatest.
RESULT = "query_id long, vec_id long, score long, over int"


def _search(k: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and rows.num_rows:
            dims = max(max(t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for t in (queries, rows)), 1)
            ids = rows["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            index = BitSlicedBlock(ids[order], _matrix(rows["v"], dims)[order])
            for own, query in zip(queries["vec_id"].to_numpy(), _matrix(queries["v"], dims)):
                near, score = index.top(query, own, k)
                over = np.zeros(len(near), np.int64)
                if score.dtype == object:
                    over = np.array([int(s >= LONG) - int(s < -LONG) for s in score], np.int64)
                    score = np.array([max(-LONG, min(LONG - 1, s)) for s in score], np.int64)
                found.append((np.full(len(near), own), near, score, over))
        parts = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        parts[3] = parts[3].astype(np.int32)
        return pa.table(dict(zip(("query_id", "vec_id", "score", "over"), map(pa.array, parts))))

    return search


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(256 * x).

    Rows take no part whose vec_id or vector is null, or that hold a null or non-finite component
    or one that is no long once quantised (2**55 or more).
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < LARGEST)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(sound(x), F.lit(False))))
        .select("vec_id", F.transform("x", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    )


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, rows: int = ROWS, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query with all other rows.

    `vectors` has vec_id and embedding; a row is a query if its vec_id is divisible by `every`.
    Shorter vectors count as filled with zeros.  Rows that repeat a query's vec_id count as its own;
    a query given twice is answered once.  No rows in, no rows out.  Sums are exact at any width; if
    one of the k best scores is no long, the query fails, as its SQL does.
    Blocks of rows meet blocks of queries in tasks of bounded size; each returns k rows a query.
    """
    q = quantised(vectors)
    n = q.count()
    row_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-n // (every * queries_at_once)))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))
    index = q.withColumn("rb", block(row_blocks)).withColumn("qb", each(query_blocks))
    asked = q.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("qb", block(query_blocks)).withColumn("rb", each(row_blocks))
    found = asked.groupBy("qb", "rb").cogroup(index.groupBy("qb", "rb")).applyInArrow(_search(k), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score is no long")).cast("long")).alias("score"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query among all embeddings."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
