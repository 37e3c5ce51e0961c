"""Token ids in binary files, coded by a range asymmetric numeral system with static tables.

Texts in ascending doc_id order become one stream of ids, each text's ended by an end id.  A segment
of the stream has one frequency table, shared by its blocks.  A block is coded on its own by many
interleaved coders (lane k has ids k, k + lanes, ...), so it is decoded without any other; within
it, checkpoints keep all coders' states and the place in the code every so many steps, so decoding
can also start there.  Table and code have checksums.  Files are Parquet tables of blocks in a folder
that all executors share, so blocks are decoded in parallel wherever they are.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenfold.llm import common
from tenfold.llm.pretokens import IDS, Encoder, Resolve, Rows, offsets

#: Binary digits of the sum of a table's frequencies; ids in a block, its coders, and steps between checkpoints.
SCALE, BLOCK, LANES, CHECKPOINT = 18, 1 << 15, 256, 64
#: Blocks that share a table, and bytes of text encoded at once.
BLOCKS, AT_ONCE = 64, 6 << 20
#: Pieces and pre-tokens whose ids a process remembers.
PIECES, TOKENS = 800_000, 340_000
#: Pre-tokens that the library's model gets in a row.
TOKENIZED = 1 << 7
LOW = np.uint64(1 << 31)
END = 2


def table_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies in proportion to counts, at least 1 for each id that occurs, and those before."""
    total, scale = int(counts.sum()), 1 << SCALE
    f = np.where(counts > 0, np.maximum(1, counts * scale // max(1, total)), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    rest = scale - int(f.sum())
    if rest >= 0:
        f[order[0]] += rest
    else:
        for i in order:  # the largest pay for the ids that were raised to 1
            less = min(int(f[i]) - 1, -rest, int(f[i]) // 2)
            f[i] -= less
            rest += less
            if not rest:
                break
    return f, np.cumsum(f) - f


def encode_blocks(ids: np.ndarray, f: np.ndarray, before: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Code and checkpoints (states and places, first those of the block's start) of each BLOCK of ids."""
    n = -(-len(ids) // BLOCK)
    filler = int(np.argmax(f))
    x = np.full(n * BLOCK, filler, np.int64)
    x[: len(ids)] = ids
    steps = BLOCK // LANES
    x = x.reshape(n, steps, LANES)
    state = np.full((n, LANES), LOW, np.uint64)
    words: list[np.ndarray] = []
    masks: list[np.ndarray] = []
    points = []
    shift = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        own, base = f[x[:, t]].astype(np.uint64), before[x[:, t]].astype(np.uint64)
        full = state >= own << shift
        words.append((state & np.uint64(0xFFFFFFFF)).astype("<u4"))
        masks.append(full)
        state = np.where(full, state >> np.uint64(32), state)
        q = state // own
        state = (q << np.uint64(SCALE)) + (state - q * own) + base
        if t % CHECKPOINT == 0:
            points.append((t, state.copy()))
    out = []
    counts = np.array([m.sum(axis=1) for m in masks[::-1]])  # by step: words read after it
    for b in range(n):
        code = np.concatenate([w[b][m[b]] for w, m in zip(words[::-1], masks[::-1])])
        place = np.concatenate([[0], np.cumsum(counts[:, b])])
        marks = b"".join(place[t : t + 1].astype("<u4").tobytes() + s[b].astype("<u8").tobytes() for t, s in points[::-1])
        out.append((code.astype("<u4").tobytes(), marks))
    return out


def decode_blocks(blocks: list[tuple[bytes, bytes, int]], f: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks with a table in common: code, checkpoints and number of ids of each; stretches between checkpoints are decoded side by side."""
    symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)
    size = 4 + 8 * LANES
    stretch, states, places, at = [], [], [], 0
    codes = []
    for b, (code, marks, _) in enumerate(blocks):
        for m in range(0, len(marks), size):
            places.append(at + int.from_bytes(marks[m : m + 4], "little"))
            states.append(np.frombuffer(marks, "<u8", LANES, m + 4))
            stretch.append(b)
        codes.append(np.frombuffer(code, "<u4"))
        at += len(codes[-1])
    words = np.concatenate([*codes, np.zeros(LANES, "<u4")]).astype(np.uint64)
    state, place = np.array(states, np.uint64), np.array(places, np.int64)
    out = np.empty((len(stretch), CHECKPOINT, LANES), np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    wide, low = f.astype(np.uint64), before.astype(np.uint64)
    for t in range(CHECKPOINT):
        slot = state & mask
        s = symbol[slot]
        out[:, t] = s
        state = wide[s] * (state >> scale) + slot - low[s]
        need = state < LOW
        rank = np.cumsum(need, axis=1)
        state = np.where(need, state << np.uint64(32) | words[np.minimum(place[:, None] + rank - 1, len(words) - 1)], state)
        place += rank[:, -1]
    out = out.reshape(len(blocks), -1)
    return [ids[:n] for ids, (_, _, n) in zip(out, blocks)]


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Encoder(Encoder):
    """An encoder that leaves texts with any of the file's added tokens to the library's tokenizer as a whole."""

    def __init__(self, pattern: str, resolve: Resolve, library: Tokenizer):
        super().__init__(pattern, resolve, PIECES, TOKENS)
        self.library, self.added = library, [t.content for t in library.get_added_tokens_decoder().values()]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        whole = {i for a in self.added for i, t in enumerate(texts) if a in t}
        out = super().encode(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, IDS)
        return out


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """The library's tokenizer over distinct pre-tokens.

    The texts are split by `pattern`, which is that of the library's byte-level splitter, and each
    pre-token goes to the library's model, as the library itself does with each.  Texts that hold an
    added token of the file go to the library as they are.
    """
    library = Tokenizer.from_file(path)
    model = library.model
    letters = np.array([ord(c) for _, c in sorted(_letters().items())], "<u4")
    letters[0xFF] = ord("\n")  # no byte of UTF-8, and no letter: it stands between pre-tokens

    def resolve(tokens: Sequence[str]) -> Rows:
        ids, sizes = array("I"), array("q")
        for a in range(0, len(tokens), TOKENIZED):
            raw = np.frombuffer(b"\xff".join(map(str.encode, tokens[a : a + TOKENIZED])), np.uint8)
            found = list(map(model.tokenize, letters[raw].tobytes().decode("utf-32-le").split("\n")))
            sizes.extend(map(len, found))
            ids.extend([t.id for one in found for t in one])
        return np.array(ids, IDS), offsets(np.array(sizes, np.int64))

    return _Encoder(pattern, resolve, library)


FILE = "part long, block long, n long, table binary, table_crc long, code binary, marks binary, code_crc long, docs binary"
#: A text's ids in a block: its number in the file, and how many.
SHARE = np.dtype([("doc", "<i8"), ("null", "u1"), ("first", "u1"), ("n", "<i8")])


def _segment(part: int, block: int, ids: list[np.ndarray], docs: list[tuple[int, bool]], firsts: list[bool]) -> list[dict]:
    """Rows of the blocks of a segment."""
    stream = np.concatenate(ids) if ids else np.zeros(0, IDS)
    counts = np.bincount(stream)
    f, before = table_of(counts)
    table = zlib.compress(f.astype("<u4").tobytes(), 6)
    sizes = np.array([len(x) for x in ids])
    ends = np.cumsum(sizes)
    rows = []
    for k, (code, marks) in enumerate(encode_blocks(stream, f, before)):
        a, b = k * BLOCK, min((k + 1) * BLOCK, len(stream))
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
        own = np.zeros(hi - lo + 1, SHARE)
        for j, i in enumerate(range(lo, hi + 1)):
            start = int(ends[i] - sizes[i])
            own[j] = (docs[i][0], docs[i][1], firsts[i] and start >= a, min(b, int(ends[i])) - max(a, start))
        rows.append({"part": part, "block": block + k, "n": b - a, "table": table if k == 0 else None, "table_crc": zlib.crc32(table), "code": code, "marks": marks, "code_crc": zlib.crc32(code + marks), "docs": own.tobytes()})
    return rows


def write(docs: DataFrame, path: str, pattern: str, folder: str, end: int = END) -> None:
    """Write the ids of all texts, in ascending doc_id order, to `folder`.

    Null texts are empty, null doc_ids come first, and rows that repeat a doc_id are in order of
    text.  Each row's ids end with `end`.  An empty table makes an empty folder of blocks.
    """
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("table", pa.binary()), ("table_crc", pa.int64()), ("code", pa.binary()), ("marks", pa.binary()), ("code_crc", pa.int64()), ("docs", pa.binary())])
    last = np.array([end], IDS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        part, block, ids, of, firsts, held = -1, 0, [], [], [], 0
        for batch in batches:
            _, off = common.utf8(batch.column(1))
            for a, b in common.slices(off, AT_ONCE):
                own = batch.slice(a, b - a)
                if own.num_rows:
                    part = own.column(2)[0].as_py()
                for x, d in zip(encode([t or "" for t in own.column(1).to_pylist()]), own.column(0).to_pylist()):
                    x, first = np.concatenate([x, last]), True
                    while len(x):
                        take = x[: BLOCKS * BLOCK - held]
                        ids.append(take)
                        of.append((d or 0, d is None))
                        firsts.append(first)
                        held, x, first = held + len(take), x[len(take) :], False
                        if held == BLOCKS * BLOCK:
                            yield pa.RecordBatch.from_pylist(_segment(part, block, ids, of, firsts), schema)
                            block, ids, of, firsts, held = block + BLOCKS, [], [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist(_segment(part, block, ids, of, firsts), schema)

    parts = common.parts_for(docs.sparkSession, common.size_of(docs), 16 << 20)
    ordered = common.text_of(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    coded = ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(rows, FILE)
    coded.write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, doc, null, first, n, at, crc and base: for each text's share of a block, the number of its ids, its place, their CRC-32, and the ids of all parts before.

    A checksum that does not hold fails the read.
    """

    def rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks = table.to_pylist()
        packed = blocks[0]["table"]
        f = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
        if zlib.crc32(packed) != blocks[0]["table_crc"] or any(zlib.crc32(b["code"] + b["marks"]) != b["code_crc"] for b in blocks):
            raise ValueError(f"a checksum fails in part {blocks[0]['part']}, from block {blocks[0]['block']} on")
        found = []
        for a in range(0, len(blocks), 16):
            some = blocks[a : a + 16]
            for b, ids in zip(some, decode_blocks([(b["code"], b["marks"], b["n"]) for b in some], f, np.cumsum(f) - f)):
                raw, at = ids.astype(IDS).tobytes(), 0
                for d in np.frombuffer(b["docs"], SHARE):
                    n = int(d["n"])
                    found.append((b["part"], b["block"], int(d["doc"]), bool(d["null"]), bool(d["first"]), n, at, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
        names = ["part", "block", "doc", "null", "first", "n", "at", "crc"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    blocks = spark.read.schema(FILE).parquet(folder)
    segment = F.floor(F.col("block") / BLOCKS).alias("segment")
    shares = blocks.groupBy("part", segment).applyInArrow(rows, "part long, block long, doc long, null boolean, first boolean, n long, at long, crc long")
    # one row a part, so one task can add them up however large the files are; it reads the blocks' sizes alone
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg(F.sum("n").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    return shares.join(base, "part")


def _times(matrix: list[int], v: int) -> int:
    """A matrix over GF(2), given by its columns, times a vector."""
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v, i = v >> 1, i + 1
    return out


@functools.lru_cache(1)
def _zeros() -> list[list[int]]:
    """What 2 ** k zero bytes do to a CRC-32, for each k."""
    m = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        m = [_times(m, v) for v in m]
    out = [m]
    for _ in range(40):
        out.append(m := [_times(m, v) for v in m])
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two stretches of bytes from theirs; `length` is the second's."""
    for k, m in enumerate(_zeros()):
        if length >> k & 1:
            first = _times(m, first)
    return first ^ second


def documents(shares: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each text in the files."""

    def rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found: list[list] = []
        total, start = 0, table["base"][0].as_py()
        for r in table.sort_by([("block", "ascending"), ("at", "ascending")]).to_pylist():
            if r["first"]:
                found.append([None if r["null"] else r["doc"], start + total, r["n"], r["crc"]])
            else:
                found[-1][3] = joined_crc(found[-1][3], r["crc"], 4 * r["n"])
                found[-1][2] += r["n"]
            total += r["n"]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shares.groupBy("part").applyInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, as read back from the files."""
    folder = common.new_path(spark, "token-ids")
    write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, folder)
    return documents(read(spark, folder))
