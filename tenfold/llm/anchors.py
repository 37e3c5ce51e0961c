"""Repeated runs of words by anchors: blocks of a fixed length.

Each text is cut into blocks of seven words that do not overlap; these, and only these, are the index:
any 13 words in a row hold a whole block of their text.  Every window of seven words of every text
probes it.  A window that equals some text's block is a hit, for the text that probes and for the one
whose block it is.  Hits are extended: the windows of 13 words around each are compared across the
corpus by a 128-bit hash of their words, which tells of each whether a smaller document has it too, and
such windows in a row are one maximal exact repeat.

Neither index nor probes have a row for each occurrence: a group of documents sends each distinct
key to its bucket once, so a block that a third of all texts hold is met once from each group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common, exchange, words
from tenfold.llm.exchange import Group

#: Words of a window; a block is the longest of which any window holds a whole one.
WINDOW = 13
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
PROBE = np.dtype("<u4")


def _runs(h: np.ndarray, row: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k words from a word on, and whether they are of one text."""
    rolled = words.rolled(h, k, lane)
    return rolled, row[k - 1 :] == row[: len(rolled)] if len(rolled) else np.zeros(0, bool)


def _kinds(k: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ones, and the kinds of each united; a key that is there twice is in several texts."""
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    more = np.diff(np.append(cut, len(k))) > 1
    return k[cut], np.bitwise_or.reduceat(kind, cut) | more


def _found(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    block = (window + 1) // 2
    size = common.size_of(docs)
    groups, buckets = (common.parts_for(docs.sparkSession, size, x) for x in (exchange.GROUP, exchange.BUCKET))

    def place(h: np.ndarray) -> np.ndarray:
        """Bucket and key of a block in one number."""
        return (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)

    def probes(group: Group):
        """Distinct windows of `block` words: bit 0 of their kind says that several texts have them, bit 1 that they are a block of the index."""
        keys, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for _, _, raw, off in group.slices():
            starts, ends, row = words.spans(raw, off)
            h, whole = _runs(words.hashes(raw, starts, ends), row, block)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            tile = (at - np.searchsorted(row, row[at])) % block == 0
            k = place(h[at])
            order = np.lexsort([row[at], k])
            k, r, kind = k[order], row[at][order], tile[order].astype(np.uint8) << 1
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
            k, kind = _kinds(k[cut], np.bitwise_or.reduceat(kind, cut))
            keys.append(k)
            kinds.append(kind)
        k, kind = np.concatenate(keys), np.concatenate(kinds)
        if len(keys) > 2:
            order = np.argsort(k, kind="stable")
            k, kind = _kinds(k[order], kind[order])
        return exchange.counted(k, kind)

    def shared(data: np.ndarray, of: np.ndarray):
        """To each group its keys that are a block of some text and stand in another."""
        return exchange.repeated(data, of, 2)

    def around(group: Group, keys: np.ndarray):
        """The windows of `window` words around the hits, distinct ones with their first document in the order sent, their buckets, and all of them by slice: first and last row, places, numbers of distinct ones."""
        found, slices = [np.zeros(0, ENTRY)], []
        for a, b, raw, off in group.slices():
            starts, ends, row = words.spans(raw, off)
            lanes = [words.hashes(raw, starts, ends, lane) for lane in (0, 1)]
            h, whole = _runs(lanes[0], row, block)
            near = np.concatenate([[0], np.cumsum(whole & exchange.member(keys, place(h)))])
            (p, whole), (q, _) = (_runs(lanes[lane], row, window, lane) for lane in (0, 1))
            at = np.flatnonzero(whole)
            at = at[near[at + window - block + 1] > near[at]]
            e = np.zeros(len(at), ENTRY)
            e["a"], e["b"], e["doc"] = p[at], q[at], group.ids[a + row[at]]
            found.append(e)
            slices.append((a, b, at))
        e = np.concatenate(found)
        bucket = (e["a"] % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort([e["doc"], e["b"], e["a"], bucket])
        e, bucket = e[order], bucket[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
        number = np.empty(len(e), np.int64)
        number[order] = np.cumsum(new) - 1
        edge = np.cumsum([0, *(len(at) for _, _, at in slices)])
        return e[new], bucket[new], [(*s, number[i:j]) for s, i, j in zip(slices, edge, edge[1:])]

    def extended(group: Group, answers: pa.Table):
        """Distinct windows around the hits."""
        e, bucket, _ = around(group, exchange.keys_of(answers, PROBE))
        return bucket, e

    def later(entries: np.ndarray, of: np.ndarray):
        """To each group, in the order in which it sent its windows, whether another has a smaller document with it."""
        order = np.lexsort([entries["doc"], entries["b"], entries["a"]])
        e = entries[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
        flags = np.empty(len(e), np.uint8)
        flags[order] = e["doc"] > e["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
        return of, flags

    def remove(group: Group, answers: pa.Table):
        hits, later_ = (answers.filter(pc.equal(answers["kind"], k)) for k in (0, 1))
        e, _, places = around(group, exchange.keys_of(hits, PROBE))
        gone_all = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(d.as_buffer(), np.uint8) for d in later_.sort_by("b")["data"])]) > 0
        texts, n, removed, spans = [], [], [], []
        for a, b, at, number in places:
            raw, off = group.raw[group.off[a] : group.off[b]], group.off[a : b + 1] - group.off[a]
            starts, _, row = words.spans(raw, off)
            marks = np.zeros(len(row), np.int32)
            marks[at] = gone_all[number] | (e["doc"][number] < group.ids[a + row[at]])
            gone = exchange.covered(marks, window)
            edge = np.searchsorted(row, np.arange(b - a + 1))
            n.extend(np.diff(edge).tolist())
            total = np.concatenate([[0], np.cumsum(gone)])
            removed.extend((total[edge[1:]] - total[edge[:-1]]).tolist())
            for i in range(b - a):
                text, g = raw[off[i] : off[i + 1]], gone[edge[i] : edge[i + 1]]
                spans.append(0)
                if g.any():
                    change = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                    s = np.append(starts[edge[i] : edge[i + 1]] - off[i], len(text))
                    keep = np.ones(len(text), bool)
                    for x, y in change.reshape(-1, 2):
                        keep[s[x] : s[y]] = False
                    text, spans[-1] = text[keep], len(change) // 2
                texts.append(text.tobytes())
        return texts, n, removed, spans

    by_group = exchange.dealt(docs, size, groups)
    hits = exchange.decide(exchange.gather(by_group, probes), size, PROBE, shared)
    flags = exchange.decide(exchange.regather(by_group, hits, extended), size, ENTRY, later)
    return exchange.finish(by_group, hits.withColumn("kind", F.lit(0)).unionByName(flags.withColumn("kind", F.lit(1))), remove)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` (doc_id, text and any other columns) without the words of windows that a smaller doc_id has too.

    Words are runs of other bytes than space and 0x09 to 0x0D.  A removed run of words goes with the
    separators up to the next kept word, all else of a text stays.  Repeats within a document stay,
    as do those of rows with the same doc_id; a null doc_id counts as larger than any.  Null texts
    stay null, and texts of fewer words than a window stay as they are.
    """
    return exchange.undealt(_found(docs, window), docs)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space; a null text has none."""
    found = _found(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.regexp_replace(F.coalesce(F.col("kept").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2(F.trim(kept), 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(x) - 11, 1))) AS pos, x FROM d),
k AS (SELECT doc_id, pos, array_to_string(x[pos:pos + 12], ' ') AS s FROM w),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS first FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM f WHERE first < doc_id),
g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM c GROUP BY doc_id),
p AS (SELECT d.doc_id, unnest(range(1, len(x) + 1)) AS pos, x FROM d),
t AS (SELECT p.doc_id, string_agg(x[p.pos], ' ' ORDER BY p.pos) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(x)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
