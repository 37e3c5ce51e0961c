"""Line deduplication by overlapping windows of three lines.

A window is three consecutive lines of one text.  A window whose lines stand, in the same order, at
an earlier place of the corpus (smaller doc_id, or the same document and an earlier line) is a later
occurrence; the lines that later occurrences cover are merged and removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common, exchange
from tenfold.llm.exchange import Group

LINES = 3
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("more", "u1")])


def _windows(group: Group) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Entries of all windows with the row of each, and every row's lines."""
    entries, rows, lines = [], [], []
    for row in range(len(group.ids)):
        own = group.text(row).split(b"\n")
        lines.append(own)
        for pos in range(len(own) - LINES + 1):
            window = own[pos : pos + LINES]
            if any(line.strip() for line in window):
                h = xxhash.xxh3_128_intdigest(b"\n".join(window))
                entries.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF, group.ids[row], pos, 0))
                rows.append(row)
    return np.array(entries, ENTRY), np.array(rows, np.int64), lines


def _distinct(entries: np.ndarray) -> np.ndarray:
    """The first entry of each window, marked if there are more."""
    e = entries[np.lexsort([entries[c] for c in ("pos", "doc", "b", "a")])]
    new = np.ones(len(e), bool)
    new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
    first = e[new]
    first["more"] = np.diff(np.append(np.flatnonzero(new), len(e))) > 1
    return first


def _found(docs: DataFrame) -> DataFrame:
    size = common.size_of(docs)
    groups, buckets = (common.parts_for(docs.sparkSession, size, x) for x in (exchange.GROUP, exchange.BUCKET))

    def send(group: Group):
        e = _distinct(_windows(group)[0])
        return (e["a"] % np.uint64(buckets)).astype(np.int32), e

    def first(entries: np.ndarray, of: np.ndarray):
        return exchange.first_of(of, entries, ["doc", "pos"])

    def remove(group: Group, answers: pa.Table):
        entries, rows, lines = _windows(group)
        firsts = np.unique(exchange.unpack(answers, ENTRY)[0])
        at = exchange.found_in(firsts, entries["a"], entries["b"])
        if len(firsts):
            first = firsts[at]
            later = (at >= 0) & ((first["doc"] < entries["doc"]) | (first["doc"] == entries["doc"]) & (first["pos"] < entries["pos"]))
        else:
            later = np.zeros(len(entries), bool)
        size = np.array([len(x) for x in lines], np.int64)
        base = np.cumsum(size) - size
        marks = np.zeros(int(size.sum()), np.int32)
        marks[base[rows[later]] + entries["pos"][later]] = 1
        gone = exchange.covered(marks, LINES)
        texts, removed, spans = [], [], []
        for own, a in zip(lines, base):
            g = gone[a : a + len(own)]
            texts.append(b"\n".join(line for line, x in zip(own, g) if not x))
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        return texts, size, removed, spans

    by_group = exchange.dealt(docs, size, groups)
    return exchange.finish(by_group, exchange.decide(exchange.gather(by_group, send), size, ENTRY, first), remove)


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with the lines of later occurrences removed from text.

    Lines end at "\\n"; windows of white space alone do not count, and texts of fewer than three
    lines stay as they are, as do null texts.  A null doc_id counts as larger than any.  Rows that
    repeat a doc_id and a text are one place: none is later than the other.
    """
    return exchange.undealt(_found(docs), docs)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (runs of removed lines) and the SHA-256 of the kept text, null as null."""
    found = _found(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_lines"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(x) - 1, 1))) AS pos, x FROM l),
k AS (SELECT doc_id, pos, array_to_string(x[pos:pos + 2], chr(10)) AS s FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS n FROM k WHERE regexp_matches(s, '[^ \\t\\n\\v\\f\\r]')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM f WHERE n > 1),
g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n, count(*) - sum(again) AS spans
      FROM (SELECT *, (lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT DISTINCT FROM pos - 1)::INT AS again FROM c) GROUP BY doc_id)
SELECT l.doc_id, len(x)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  CASE WHEN text IS NOT NULL THEN sha256(array_to_string(
    list_transform(list_filter(range(1, len(x) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: x[i]), chr(10))) END AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
