"""Baseline JPEG frames in NumPy: a decoder of intra frames and an encoder of DC images.

A DC image holds one sample a block of 8 x 8 equal pixels.  With a DC quantiser of 8 the quantised
coefficient of such a block is its sample less 128, so the samples come back exactly.  The encoder's
Huffman codes are chosen so that every block takes ten bits whatever its sample: category s has a
code of 9 - s bits and s further bits, and the end of block one bit.  Frames of such fixed-length
blocks decode as whole arrays; all other baseline frames are decoded code by code.
"""

from __future__ import annotations

import functools
import struct
from typing import NamedTuple

import numpy as np

#: Fixed values of the JPEG standard (ITU T.81): the zigzag order of coefficients.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

BLOCK_BITS = 10


class Component(NamedTuple):
    across: int
    down: int
    quant: int
    dc: int
    ac: int


class Header(NamedTuple):
    """What stands before the coded data; `start` is where that begins."""

    width: int
    height: int
    quant: dict[int, np.ndarray]
    codes: dict[tuple[int, int], dict[tuple[int, int], int]]
    restart: int
    parts: tuple[Component, ...]
    start: int

    @property
    def fixed(self) -> bool:
        """Whether each block is one sample in BLOCK_BITS bits."""
        c = self.parts[0]
        if len(self.parts) > 1 or self.restart or self.codes[1, c.ac] != {(1, 0): 0}:
            return False
        return all(length + s + 1 == BLOCK_BITS for (length, _), s in self.codes[0, c.dc].items()) and int(self.quant[c.quant][0]) == 8


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, codes in canonical order."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse(data: bytes) -> Header:
    """The header of a baseline frame; ValueError if it is no such frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quant, codes, restart, frame, size = 2, {}, {}, 0, {}, (0, 0)
    while at + 4 <= len(data):
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1")
                quant[body[0] & 15], body = table.astype(np.int32), body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15], body = _codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark in (0xC0, 0xC1):
            size = struct.unpack(">HH", body[1:5])
            frame = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            parts = tuple(Component(*frame[body[i]], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2))
            return Header(size[1], size[0], quant, codes, restart, parts, at)
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("not a baseline frame")
    raise ValueError("no scan in the frame")


@functools.lru_cache(256)
def _parsed(head: bytes) -> Header:
    return parse(head)


def header(data: bytes) -> Header:
    """As parse; frames of one clip mostly share their headers, which are then parsed once."""
    scan = data.find(b"\xff\xda")
    return _parsed(data[: scan + 2 + struct.unpack_from(">H", data, scan + 2)[0]]) if scan > 0 else parse(data)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


#: Code of a DC category: ones, then a zero; lengths 1 to 9 for categories 8 to 0.
_DC = _segment(0xC4, bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
_AC = _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))


@functools.lru_cache(64)
def dc_header(across: int, down: int) -> bytes:
    """Everything before the coded data of a DC image of so many blocks."""
    size = struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0])
    quant = bytes([0, 8, *[1] * 63])
    return b"\xff\xd8" + _segment(0xE0, b"AVI1" + bytes(4)) + _segment(0xDB, quant) + _segment(0xC0, size) + _DC + _AC + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


@functools.lru_cache(1)
def _of_difference() -> tuple[np.ndarray, np.ndarray]:
    """Ten bits for each difference + 255, and back (unused codes: 0)."""
    there, back = np.zeros(511, np.uint16), np.zeros(1 << BLOCK_BITS, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # 8 - s ones and a zero
        extra = d if d >= 0 else d + (1 << s) - 1
        there[d + 255] = (code << s | extra) << 1
        back[there[d + 255]] = d
    return there, back


def coded(samples: np.ndarray) -> np.ndarray:
    """Rows of samples (a frame each, a multiple of 4 long) as rows of coded bytes, before stuffing."""
    x = samples.astype(np.int16) - 128
    x[:, 1:] -= x[:, :-1].copy()
    c = _of_difference()[0][x + 255].reshape(len(x), -1, 4)
    out = np.empty((*c.shape[:2], 5), np.uint8)
    out[..., 0] = c[..., 0] >> 2
    out[..., 1] = (c[..., 0] & 3) << 6 | c[..., 1] >> 4
    out[..., 2] = (c[..., 1] & 15) << 4 | c[..., 2] >> 6
    out[..., 3] = (c[..., 2] & 63) << 2 | c[..., 3] >> 8
    out[..., 4] = c[..., 3] & 255
    return out.reshape(len(x), -1)


def frame_of(row: bytes, head: bytes) -> bytes:
    """A whole frame of coded bytes."""
    return b"".join((head, row.replace(b"\xff", b"\xff\x00"), b"\xff\xd9"))


def scan_of(frame: bytes, start: int) -> bytes:
    """The coded bytes of a frame without restarts."""
    end = frame.rfind(b"\xff\xd9")
    return frame[start : end if end >= start else None].replace(b"\xff\x00", b"\xff")


def dc_images(frames: list[bytes], head: Header) -> np.ndarray:
    """The samples of frames of fixed-length blocks that share a header: frames x down x across."""
    down, across = -(-head.height // 8), -(-head.width // 8)
    size = down * across * BLOCK_BITS // 8
    b = np.frombuffer(b"".join(scan_of(f, head.start)[:size] for f in frames), np.uint8).reshape(-1, 5).astype(np.uint16)
    c = np.empty((len(b), 4), np.uint16)
    c[:, 0] = b[:, 0] << 2 | b[:, 1] >> 6
    c[:, 1] = (b[:, 1] & 63) << 4 | b[:, 2] >> 4
    c[:, 2] = (b[:, 2] & 15) << 6 | b[:, 3] >> 2
    c[:, 3] = (b[:, 3] & 3) << 8 | b[:, 4]
    x = np.cumsum(_of_difference()[1][c].reshape(len(frames), -1), axis=1, dtype=np.int32) + 128
    return x.astype(np.uint8).reshape(len(frames), down, across)


class _Bits:
    """Bits of a coded stretch, most significant first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8), (len(data) + 8) * 8

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := codes.get((n, code))) is not None:
                return s
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        if not size:
            return 0
        x = self.take(size)
        return x if x >> size - 1 else x - (1 << size) + 1


@functools.lru_cache(1)
def _cosines() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    return c


def decode(frame: bytes) -> np.ndarray:
    """The luminance of any baseline frame, height x width."""
    head = header(frame)
    if head.fixed:
        return np.kron(dc_images([frame], head)[0], np.ones((8, 8), np.uint8))[: head.height, : head.width]
    most = [max(c[i] for c in head.parts) for i in (0, 1)]
    units = [-(-head.width // (8 * most[0])), -(-head.height // (8 * most[1]))]
    if len(head.parts) == 1:
        head = head._replace(parts=(head.parts[0]._replace(across=1, down=1),))
        most, units = [1, 1], [-(-head.width // 8), -(-head.height // 8)]
    luma, of = head.parts[0], {}
    end = frame.rfind(b"\xff\xd9")
    stretches = _stretches(frame[head.start : end if end >= 0 else None])
    every = head.restart or units[0] * units[1]
    for k, unit in enumerate(range(0, units[0] * units[1], every)):
        bits, last = _Bits(stretches[k]), [0] * len(head.parts)
        for u in range(unit, min(unit + every, units[0] * units[1])):
            for i, c in enumerate(head.parts):
                for block in range(c.across * c.down):
                    z = np.zeros(64, np.int32)
                    last[i] += bits.number(bits.symbol(head.codes[0, c.dc]))
                    z[0], at = last[i], 1
                    while at < 64:
                        s = bits.symbol(head.codes[1, c.ac])
                        if not s:
                            break
                        at += s >> 4
                        if s & 15:
                            z[ZIGZAG[at]] = bits.number(s & 15) * head.quant[c.quant][at]
                        at += 1
                    if not i:
                        z[0] *= head.quant[c.quant][0]
                        y, x = u // units[0] * c.down + block // c.across, u % units[0] * c.across + block % c.across
                        of[y, x] = z.reshape(8, 8)
    rows, cols = units[1] * luma.down, units[0] * luma.across
    z = np.array([[of[y, x] for x in range(cols)] for y in range(rows)])
    c = _cosines()
    image = np.clip(np.rint(c @ z @ c.T + 128), 0, 255).astype(np.uint8)
    image = image.transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
    image = image.repeat(most[1] // luma.down, 0).repeat(most[0] // luma.across, 1)
    return image[: head.height, : head.width]


def _stretches(data: bytes) -> list[bytes]:
    """Coded bytes between restart marks."""
    out, at, start = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in (*out, data[start:])]
