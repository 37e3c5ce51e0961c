"""Words and their hashes over the bytes of many texts at once.

A hash is a sum of pseudo-random numbers, one for each byte and its place in the word, and hashes of
several words are combined pairwise with a nonlinear step each time.  So nothing is a polynomial
modulo a power of two, whose values agree for words such as those of Thue and Morse.  Memory is that
of the texts at hand; tables are small and of fixed size.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from tenfold.llm.common import mix

#: Word separators: space and 0x09 to 0x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the two lanes of a 128-bit hash.
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Places with numbers of their own, bytes looked at together, and the length from which a word is hashed as a whole.
PLACES, AT_ONCE, LONG = 32, 1 << 17, 1 << 12


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the text of each."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~SEPARATORS[raw]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    border = off[(off > 0) & (off < len(raw))]
    first[border] = inside[border]
    last = inside[:-1] & ~inside[1:]
    last[border - 1] = inside[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


@functools.lru_cache(2)
def numbers(lane: int) -> np.ndarray:
    """A pseudo-random number for each place (mod PLACES) and byte; none for separators."""
    n = np.arange(1, PLACES * 256 + 1, dtype=np.uint64)
    t = mix(mix(n * np.uint64(LANES[lane])) + np.uint64(LANES[1 - lane])).reshape(PLACES, 256)
    t[:, SEPARATORS] = 0
    return t.reshape(-1)


def letters(raw: np.ndarray, lane: int = 0) -> np.ndarray:
    """A number for each byte, separators too."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(LANES[1 - lane]))[raw]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; words must be in order and apart, with only separators between those of a text."""
    out, size = np.empty(len(starts), np.uint64), ends - starts
    table, i = numbers(lane), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + AT_ONCE, "right")))
        own = starts[i:j] - starts[i]
        part = raw[starts[i] : starts[i] + (LONG if j == i + 1 and size[i] > LONG else ends[j - 1] - starts[i])]
        place = np.arange(len(part), dtype=np.int32)
        place -= np.repeat(own.astype(np.int32), np.diff(np.append(own, len(part))))
        v = table[((place & (PLACES - 1)) << 8) | part]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            v[far] = np.where(SEPARATORS[part[far]], np.uint64(0), mix(v[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(LANES[1 - lane])))
        out[i:j] = np.add.reduceat(v, own)
        i = j
    out = mix(out + size.astype(np.uint64) * np.uint64(LANES[lane]))
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_128_intdigest(raw[starts[i] : ends[i]].tobytes()) >> 64 * lane & 0xFFFFFFFFFFFFFFFF
    return out


def _joined(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    x = a * np.uint64(factor)
    x += b
    x ^= x >> np.uint64(32)
    return x


def rolled(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of each k values in a row; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, factor = len(h) - k + 1, LANES[1 - lane]
    out, taken, run, width = None, 0, h, 1
    while width <= k:
        if k & width:
            own = run[taken : taken + n]
            out, taken = own if out is None else _joined(out, own, factor ^ width << 1), taken + width
        if width * 2 <= k:
            run = _joined(run[:-width], run[width:], LANES[lane] ^ width << 1)
        width *= 2
    return mix(out)
