"""Repeated byte strings across the corpus, from suffix arrays of its shards.

Equal strings must meet in one shard.  Each window of `length` bytes belongs to its smallest 32-byte
substring by hash, the leftmost on ties; this depends on the window's bytes alone.  The stretch of
windows in a row that belong to one substring is a piece.  Substrings that occur once in the corpus
rule their pieces out; the other pieces go, each content once from a group of documents with its
first place, to the shard that their substring's hash names.  A shard sorts all suffixes of its
pieces by external induced sorting, and suffixes in a row with `length` bytes in common are one
string: its first place stays, all others are removed.  Equal pieces are sorted once, and pieces that
are the only one of their substring not at all, as they share no window with others: all their places
but the first are removed as they are.  So what a shard sorts depends on the distinct text around the
ends of repeats, not on how often or how far they repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common, exchange, words
from tenfold.llm.exchange import Group
from tenfold.llm.induced import SuffixSorter

LENGTH, SUBSTRING = 100, 32
#: Windows looked at together, and a shard's memory for sorting.
BLOCK, MEMORY = 1 << 17, 64 << 20
#: Estimated input bytes of a group and behind a shard.
GROUP, SHARD = 2 << 20, 1 << 20
#: Not in UTF-8: ends each piece in a shard's text.
END = 255

KEY = np.dtype("<u4")
PIECE = np.dtype([("anchor", "<u8"), ("content", "<i8"), ("row", "<i4"), ("start", "<i8"), ("length", "<i4")])
SPAN = np.dtype([("row", "<i4"), ("start", "<i8"), ("end", "<i8")])
SENT = "b int, g int, row int, start long, doc long, anchor long, bytes binary"


def pieces(group: Group, length: int = LENGTH, substring: int = SUBSTRING) -> Iterator[np.ndarray]:
    """PIECE entries of all windows of a group's texts; starts count from the text's first byte."""
    width = length - substring + 1
    raw, off = group.raw, group.off
    for a in range(0, len(raw) - length + 1, BLOCK):
        block = raw[a : a + BLOCK + length - 1]
        n = len(block) - length + 1
        h = words.rolled(words.letters(block), substring)
        key = h & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if width > reach:
            key = np.minimum(key[: reach - width], key[width - reach :])
        at = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(a, a + n)
        # windows that end within the text in which they start
        ends = _next(off, a, n)
        whole = start + length <= ends
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (ends[1:] != ends[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        last = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        out = np.zeros(len(first), PIECE)
        out["anchor"] = h[at[first]]
        row = np.searchsorted(off, first + a, "right") - 1
        out["row"], out["start"], out["length"] = row, first + a - off[row], last - first + length
        yield out


def _next(off: np.ndarray, a: int, n: int) -> np.ndarray:
    """Of each position from a on, the end of its text."""
    inner = off[(off > a) & (off < a + n)]
    sizes = np.diff(np.concatenate([[a], inner, [a + n]]))
    first = np.searchsorted(off, a, "right")
    ends = np.concatenate([[off[min(first, len(off) - 1)]], off[np.searchsorted(off, inner, "right").clip(max=len(off) - 1)]]).astype(np.int64)
    return np.repeat(ends, sizes)


def _found(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    size = common.size_of(docs)
    groups, buckets, shards = (common.parts_for(docs.sparkSession, size, x) for x in (GROUP, exchange.BUCKET, SHARD))

    def place(anchor: np.ndarray) -> np.ndarray:
        return (anchor >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)

    def anchors(group: Group):
        """Distinct places of anchors, by whether they occur once."""
        found = [place(p["anchor"]) for p in pieces(group, length)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, KEY)
        k, n = np.unique(np.concatenate(found), return_counts=True)
        return exchange.counted(k, (n > 1).astype(np.uint8))

    def shared(data: np.ndarray, of: np.ndarray):
        """To each group its keys that occur more than once in the corpus."""
        return exchange.repeated(data, of)

    def candidates(group: Group, keys: np.ndarray) -> np.ndarray:
        """Pieces with shared anchors, those of equal bytes together, by place."""
        found = [p[exchange.member(keys, place(p["anchor"]))] for p in pieces(group, length)]
        p = np.concatenate(found) if found else np.zeros(0, PIECE)
        data, at = memoryview(group.raw), group.off[p["row"]] + p["start"]
        known: dict[bytes, int] = {}
        p["content"] = [known.setdefault(bytes(data[i:j]), len(known)) for i, j in zip(at.tolist(), (at + p["length"]).tolist())]
        return p[np.lexsort([p["start"], group.ids[p["row"]], p["content"]])]

    def firsts(p: np.ndarray) -> np.ndarray:
        new = np.ones(len(p), bool)
        new[1:] = p["content"][1:] != p["content"][:-1]
        return new

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        group = Group(table)
        p = candidates(group, exchange.keys_of(found, KEY))
        p = p[firsts(p)]
        at = group.off[p["row"]] + p["start"]
        data = [group.raw[i:j].tobytes() for i, j in zip(at, at + p["length"])]
        columns = [p["anchor"] % np.uint64(shards), np.full(len(p), key[0].as_py()), p["row"], p["start"], group.ids[p["row"]], p["anchor"]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)]
        return pa.Table.from_arrays([*arrays, pa.array(data, pa.binary())], names=["b", "g", "row", "start", "doc", "anchor", "bytes"])

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        spans, owner = repeats(table, length)
        return exchange.answer(key[0].as_py(), owner, spans)

    def remove(group: Group, spans: np.ndarray, keys: np.ndarray):
        marks = np.zeros(len(group.raw) + 1, np.int32)
        at = group.off[spans["row"]]
        np.add.at(marks, at + spans["start"], 1)
        np.add.at(marks, at + spans["end"], -1)
        p = candidates(group, keys)
        if len(p):
            new = firsts(p)
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            doc = group.ids[p["row"]]
            again = p[(doc != doc[first]) | (p["start"] != p["start"][first])]
            at = group.off[again["row"]] + again["start"]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + again["length"], -1)
        gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        border = group.off[(group.off > 0) & (group.off < len(gone))]
        starts[border] = gone[border]
        ranges = list(zip(group.off[:-1], group.off[1:]))
        lost = [int(np.count_nonzero(gone[a:b])) for a, b in ranges]
        texts = [group.raw[a:b][~gone[a:b]].tobytes() if n else group.raw[a:b].tobytes() for n, (a, b) in zip(lost, ranges)]
        return texts, np.diff(group.off), lost, [int(np.count_nonzero(starts[a:b])) for a, b in ranges]

    by_group = exchange.dealt(docs, size, groups)
    hits = exchange.decide(exchange.gather(by_group, anchors), size, KEY, shared)
    sent = by_group.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(send, SENT)
    spans = common.spread(sent, size, "b").groupBy("b").applyInArrow(sort, exchange.PACKED)
    both = hits.withColumn("kind", F.lit(0)).unionByName(spans.withColumn("kind", F.lit(1)))

    def apply(group: Group, found: pa.Table):
        of = [found.filter(pc.equal(found["kind"], k)) for k in (0, 1)]
        return remove(group, exchange.unpack(of[1], SPAN)[0], exchange.keys_of(of[0], KEY))

    return exchange.finish(by_group, both, apply)


def repeats(table: pa.Table, length: int = LENGTH, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """SPAN entries that first places lose, and their groups: rows g, row, start, doc, anchor and bytes are pieces with a place.

    Of equal pieces all but the first place are lost as a whole; what the first loses, the suffix array tells.
    """
    n = table.num_rows
    content = table["bytes"].combine_chunks().dictionary_encode() if n else None
    if not n:
        return np.zeros(0, SPAN), np.zeros(0, np.int32)
    content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
    piece = content.indices.to_numpy()
    raw, off = common.utf8(content.dictionary)
    sizes = np.diff(off)
    doc, start = table["doc"].to_numpy(), table["start"].to_numpy()
    order = np.lexsort([start, doc, piece])
    first = order[np.flatnonzero(np.concatenate([[True], piece[order][1:] != piece[order][:-1]]))]
    lost = (doc != doc[first][piece]) | (start != start[first][piece])
    # a piece whose substring has no other piece shares no window with any, as equal windows share theirs
    _, kind, pieces_of = np.unique(table["anchor"].to_numpy()[first], return_inverse=True, return_counts=True)
    contested = pieces_of[kind] > 1
    length_of, raw = sizes, raw[np.repeat(contested, sizes)]
    first, sizes = first[contested], sizes[contested]
    off = np.concatenate([[0], np.cumsum(sizes)])
    # place of each piece's first byte in the corpus: rank of the document, then the position
    place = np.searchsorted(np.unique(doc), doc[first]).astype(np.int64) << np.int64(32) | start[first]
    text = np.insert(raw, off[1:], END)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    begin = off[:-1] + np.arange(len(sizes))
    sorter = SuffixSorter(text, length, memory)
    try:
        marked = [np.zeros(0, np.int64)]
        held_pos, held_new = [], []

        def flush(last: bool) -> None:
            """Mark all but the first places of the strings held, without the last string if more may follow."""
            pos, new = np.concatenate(held_pos), np.concatenate(held_new)
            cut = np.flatnonzero(new)
            if not last:
                end = int(cut[-1]) if len(cut) else 0
                if not end:
                    held_pos[:], held_new[:] = [pos], [new]
                    return
                held_pos[:], held_new[:] = [pos[end:]], [new[end:]]
                pos, new = pos[:end], new[:end]
            string = np.cumsum(new)
            own = owner[pos]
            within = begin[own] + sizes[own] - pos >= length
            pos, own, string = pos[within], own[within], string[within]
            if len(pos):
                key = place[own] + pos - begin[own]
                cut = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
                least = np.repeat(np.minimum.reduceat(key, cut), np.diff(np.append(cut, len(key))))
                marked.append(pos[key > least])

        def emit(pos: np.ndarray, shared: np.ndarray) -> None:
            held_pos.append(pos)
            held_new.append(shared < length)
            if sum(map(len, held_pos)) > 1 << 18:
                flush(False)

        sorter.descending(emit)
        if held_pos:
            flush(True)
    finally:
        sorter.close()
    pos = np.sort(np.concatenate(marked))
    own = owner[pos]
    if len(pos):
        new = np.concatenate([[True], (np.diff(pos) > 1) | (own[1:] != own[:-1])])
        a, b = pos[new], pos[np.append(new[1:], True)]
    else:
        a = b = pos
    own = owner[a]
    row, g = table["row"].to_numpy(), table["g"].to_numpy()
    whole, some = np.zeros(int(lost.sum()), SPAN), np.zeros(len(a), SPAN)
    whole["row"], whole["start"], whole["end"] = row[lost], start[lost], start[lost] + length_of[piece[lost]]
    at = first[own]
    some["row"], some["start"], some["end"] = row[at], start[at] + a - begin[own], start[at] + b - begin[own] + length
    return np.concatenate([whole, some]), np.concatenate([g[lost], g[at]]).astype(np.int32)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (binary), n, n_removed and n_spans (all in bytes) of `docs`, and `rest`, its columns but text.

    A byte is removed if a string of `length` bytes covers it that also starts earlier: in a smaller
    doc_id, or before in the same document.  A null doc_id counts as larger than any; rows that
    repeat a doc_id are one place, so neither repeats the other at the same position.  A null text
    is kept as null, with 0 bytes.  Other columns may have any names.
    """
    return _found(docs, length)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes (null text: of none)."""
    found = _found(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS pos, x FROM d),
k AS (SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, 200)) AS s FROM w),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS n FROM k),
r AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM f WHERE n > 1),
i AS (SELECT doc_id, pos, sum((prev IS NULL OR pos > prev + 100)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
s AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS b FROM i GROUP BY doc_id, run),
e AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
p AS (SELECT d.doc_id, string_agg(substr(x, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS head, sum(b - a) AS n, count(*) AS spans, max(b) AS z
      FROM d JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(z, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""
