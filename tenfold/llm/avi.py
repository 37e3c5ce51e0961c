"""Media columns: AVI files of motion-JPEG frames, their shots, and bytes kept in them.

Reading goes by the file's RIFF index; frames are decoded one by one (all are intra frames).  A shot
ends where the histograms of two frames in a row differ by more than an adaptive bound: the mean
plus a multiple of the deviation of the differences around it.  Each shot is a timed clip row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common, jpeg

#: A stored payload's frames: samples across, rows of them, frames a second.
ACROSS, DOWN, FPS = 64, 16, 25
UNIT = 64
#: Text bytes stored at once.
AT_ONCE = 1 << 20
#: Shots: histogram bins, frames on each side that set the bound, deviations above their mean, least difference.
BINS, AROUND, DEVIATIONS, LEAST = 32, 8, 3.0, 0.15


class Avi(NamedTuple):
    """Frames a second, the stream's own data, and the first video stream's frames."""

    fps: float
    extra: bytes
    frames: list[bytes]


class Clip(NamedTuple):
    clip: int
    start_frame: int
    end_frame: int
    start_s: float
    end_s: float
    change: float


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write(frames: list[bytes], width: int, height: int, fps: int = FPS, extra: bytes = b"") -> bytes:
    """An AVI file of JPEG frames with an idx1 index; `extra` becomes the stream's strd chunk."""
    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    stream = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", extra)
    sizes = np.array([len(f) for f in frames], np.int64)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.cumsum(sizes + (sizes & 1) + 8) - (sizes + (sizes & 1) + 8)
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", stream)) + movi + _chunk(b"idx1", index.tobytes()))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the body of each chunk; a list's name is its kind."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + size, end)
        yield (data[start : start + 4], start + 4, stop) if name in (b"LIST", b"RIFF") else (name, start, stop)
        at = stop + (size & 1)


def read(data: bytes) -> Avi:
    """The file's frames by its index, or in file order where it has none; ValueError if it is no AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, extra, video, streams, movi, index = float(FPS), b"", 0, 0, (0, 0), None
    for name, start, stop in _chunks(data, 12, len(data)):
        if name == b"hdrl":
            for inner, a, b in _chunks(data, start, stop):
                if inner == b"strl":
                    own = {x: data[c:d] for x, c, d in _chunks(data, a, b)}
                    if own.get(b"strh", b"")[:4] == b"vids":
                        scale, rate = struct.unpack_from("<II", own[b"strh"], 20)
                        video, fps, extra = streams, rate / scale if scale else fps, own.get(b"strd", b"")
                    streams += 1
        elif name == b"movi":
            movi = (start, stop)
        elif name == b"idx1":
            index = np.frombuffer(data[start : stop - (stop - start) % 16], "<u4").reshape(-1, 4)
    wanted = [int.from_bytes(b"%02d%s" % (video, kind), "little") for kind in (b"dc", b"db")]
    if index is None:
        places = [(a, b) for name, a, b in _chunks(data, *movi) if int.from_bytes(name, "little") in wanted]
    else:
        own = index[np.isin(index[:, 0], wanted)]
        base = movi[0] + 4  # offsets count from the list's kind, to a chunk's name; some writers count from the file's start
        if len(own) and data[base - 8 + own[0, 2] :][:4] != struct.pack("<I", own[0, 0]):
            base = 8
        places = [(base + o, base + o + n) for o, n in own[:, 2:].tolist()]
    return Avi(fps, extra, [data[a:b] for a, b in places])


def images(avi: Avi) -> list[np.ndarray] | np.ndarray:
    """Decoded frames: DC images where frames are made of them, else luminance."""
    heads = [jpeg.header(f) for f in avi.frames]
    if heads and all(h is heads[0] for h in heads) and heads[0].fixed:
        return jpeg.dc_images(avi.frames, heads[0])
    return [jpeg.decode(f) for f in avi.frames]


def shots(pictures: list[np.ndarray] | np.ndarray, fps: float) -> list[Clip]:
    """Clips between cuts; `change` is the difference that opens a clip."""
    n = len(pictures)
    if not n:
        return []
    rows = np.array([np.bincount((p >> 3).ravel(), minlength=BINS) / p.size for p in pictures])
    change = np.concatenate([[0.0], np.abs(np.diff(rows, axis=0)).sum(axis=1) / 2])
    cuts = [0]
    for t in range(1, n):
        around = np.concatenate([change[max(1, t - AROUND) : t], change[t + 1 : t + 1 + AROUND]])
        bound = around.mean() + DEVIATIONS * around.std() if len(around) else 0.0
        if change[t] > max(LEAST, bound):
            cuts.append(t)
    return [Clip(k, a, b - 1, a / fps, b / fps, round(float(change[a]), 6)) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], n]))]


def clips(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """A row for each shot of each AVI file: media_id, clip, start_frame, end_frame, start_s, end_s, change.

    Frames count from 0 and end_frame is the shot's last.  A null or broken file, or one without
    frames, has no rows.  Files are read one at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    avi = read(batch.column(1)[i].as_py() or b"")
                    found = shots(images(avi), avi.fps)
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                if found:
                    columns = [pa.array([batch.column(0)[i].as_py()] * len(found), pa.int64()), *map(pa.array, zip(*found))]
                    yield pa.RecordBatch.from_arrays(columns, names=["media_id", *Clip._fields])

    schema = "media_id long, clip long, start_frame long, end_frame long, start_s double, end_s double, change double"
    return media.select(F.col(key).cast("long"), F.col(column)).mapInArrow(rows, schema)


def stored(payload: bytes) -> bytes:
    """An AVI file whose frames' samples are the payload's bytes, filled up with zeros to whole frames."""
    return _stored([np.frombuffer(payload, np.uint8)])[0]


def _stored(payloads: list[np.ndarray]) -> list[bytes]:
    out = []
    for p in payloads:
        down = max(1, min(DOWN, -(-len(p) // ACROSS)))
        size = ACROSS * down
        samples = np.zeros(max(1, -(-len(p) // size)) * size, np.uint8)
        samples[: len(p)] = p
        head = jpeg.dc_header(ACROSS, down)
        frames = [jpeg.frame_of(r.tobytes(), head) for r in jpeg.coded(samples.reshape(-1, size))]
        out.append(write(frames, ACROSS * 8, down * 8, extra=struct.pack("<Q", len(p))))
    return out


def payload_of(media: bytes) -> tuple[bytes, list[Clip]]:
    """The bytes kept in an AVI file by `stored`, and its shots."""
    avi = read(media)
    pictures = images(avi)
    return np.asarray(pictures).tobytes()[: struct.unpack("<Q", avi.extra)[0]], shots(pictures, avi.fps)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text (null: empty) as UTF-8, filled with zeros to a positive multiple of 64, in an AVI file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.utf8(batch.column(1))
            for a, b in common.slices(off, AT_ONCE):
                media = []
                for i in range(a, b):
                    p = raw[off[i] : off[i + 1]]
                    media.append(_stored([np.pad(p, (0, -len(p) % UNIT if len(p) else UNIT))])[0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(off[a : b + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.text_of(docs).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """What reading the files of `store` back gives: a row for each, its feature being its shots' frames and changes."""

    def digest(data: bytes) -> tuple:
        payload, found = payload_of(data)
        feature = ";".join(f"{c.start_frame}-{c.end_frame}@{c.change:.6f}" for c in found)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(digest(m.as_py()) for m in batch.column(2)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(found, types))], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from each document's AVI file; a null text is one of no bytes, an empty table gives no rows."""
    return digests(store(common.table(spark, sf_dir, "documents")))
