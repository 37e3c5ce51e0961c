"""External induced sorting of suffixes with their common prefixes.

The order of all suffixes follows from that of the leftmost suffixes that are smaller than their
successors: one scan in ascending order induces every suffix that is larger than its successor, one
in descending order all others.  What a scan induces goes into a priority queue on disk, whose
entries are tuples of a position, the bytes before it and the prefix shared with the entry before;
an entry's own predecessor is induced from the tuple alone, and the text is read again, in order of
position, only when the bytes carried along are used up.  As tuples enter a symbol's bucket in
their final order, the queue is one first-in first-out run for each symbol, and ranks need no
comparisons.  The seeds are sorted the same way: a first induction sorts the stretches between them,
whose names form a shorter string, and its suffixes are ranked recursively by doubled stretches.

Only the first `depth` bytes of a suffix count: suffixes that share them stand together in any order.
Arrays over `limit` bytes are files in a temporary folder, mapped; queues write out beyond it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from tenfold.llm.common import mix

TUPLE = np.dtype([("pos", "<i8"), ("before", "<u8"), ("left", "u1"), ("lcp", "u1")])
#: Tuples handled at once.
CHUNK = 1 << 16
#: Bytes that a tuple carries.
CARRIED = 8


class Space:
    """A temporary folder for arrays and queues beyond `limit` bytes of memory."""

    def __init__(self, limit: int):
        self.limit, self.folder, self.files = limit, None, 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def array(self, n: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        if n * kind.itemsize <= self.limit // 8:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class Queue:
    """A monotone priority queue: a run of tuples for each symbol, the longest written to disk when memory is short."""

    def __init__(self, space: Space):
        self.space, self.held = space, 0
        self.runs: list[list] = [[] for _ in range(256)]

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        self.runs[symbol].append(tuples)
        self.held += tuples.nbytes
        while self.held > self.space.limit:
            longest = max(self.runs, key=lambda run: sum(x.nbytes for x in run if not isinstance(x, str)))
            memory = [x for x in longest if not isinstance(x, str)]
            self.held -= sum(x.nbytes for x in memory)
            files = [x for x in longest if isinstance(x, str)]
            files.append(self.space.path())
            with open(files[-1], "wb") as f:
                for x in memory:
                    f.write(x.tobytes())
            longest[:] = files

    def drain(self, symbol: int) -> Iterator[np.ndarray]:
        """The symbol's tuples in order, in chunks, also those pushed meanwhile."""
        run = self.runs[symbol]
        while run:
            x = run.pop(0)
            if isinstance(x, str):
                x = np.memmap(x, TUPLE, "c")
            else:
                self.held -= x.nbytes
                more = [x]
                while run and not isinstance(run[0], str) and sum(map(len, more)) < CHUNK:
                    more.append(run.pop(0))
                    self.held -= more[-1].nbytes
                x = np.concatenate([y.view(np.uint8) for y in more]).view(TUPLE)
            for a in range(0, len(x), CHUNK):
                yield x[a : a + CHUNK]

    def backward(self, symbol: int) -> Iterator[np.ndarray]:
        """The symbol's tuples in reverse order, in chunks."""
        for x in reversed(self.runs[symbol]):
            x = np.memmap(x, TUPLE, "c") if isinstance(x, str) else x
            for b in range(len(x), 0, -CHUNK):
                yield x[max(0, b - CHUNK) : b][::-1].copy()


def _least_between(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of lcp[first .. last], each first <= last."""
    levels, width = [lcp], 1
    most = int((last - first).max(initial=0)) + 1
    while width * 2 <= most:
        x = levels[-1]
        y = x.copy()
        np.minimum(x[:-width], x[width:], out=y[:-width])
        levels.append(y)
        width *= 2
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table = np.concatenate(levels)
    base = level * len(lcp)
    return np.minimum(table[base + first], table[base + last + 1 - (1 << level)])


class SuffixSorter:
    """Suffixes of `text` (bytes, as uint8) in descending order."""

    def __init__(self, text: np.ndarray, depth: int, limit: int = 64 << 20):
        self.space, self.depth, self.n = Space(limit), depth, len(text)
        self.room = self.space.array(self.n + 2 * CARRIED, np.uint8)
        self.room[CARRIED : CARRIED + self.n] = text
        self.text = self.room[CARRIED : CARRIED + self.n]
        #: The eight bytes before each position, the last of them in the highest place.
        self.eight = np.ndarray((self.n + CARRIED + 1,), "<u8", self.room, strides=(1,))

    def close(self) -> None:
        self.space.close()

    def _tuples(self, pos: np.ndarray, lcp) -> np.ndarray:
        t = np.zeros(len(pos), TUPLE)
        t["pos"], t["before"], t["left"], t["lcp"] = pos, self.eight[pos], CARRIED, lcp
        return t

    def _seeds(self) -> np.ndarray:
        """Positions of leftmost smaller suffixes, ascending."""
        out, smaller_next = [], False  # whether the suffix after the block is smaller than its successor
        for b in range(self.n, 0, -(1 << 20)):
            a = max(0, b - (1 << 20))
            step = np.sign(np.diff(self.text[a : b + 1].astype(np.int16))).astype(np.int8)
            if b == self.n:
                step = np.append(step, np.int8(-1))
            at = np.where(step != 0, np.arange(len(step)), len(step))
            at = np.minimum.accumulate(at[::-1])[::-1]
            smaller = np.append(step, np.int8(1 if smaller_next else -1))[at] > 0
            smaller = np.append(smaller, smaller_next)
            out.append(np.flatnonzero(smaller[1:] & ~smaller[:-1]) + a + 1)
            smaller_next = bool(smaller[0])
        return np.concatenate(out[::-1]) if out else np.zeros(0, np.int64)

    def _induce(self, queue: Queue, chunk: np.ndarray, symbol: int, kind: str, state: tuple[np.ndarray, np.ndarray]) -> None:
        """Push the predecessors of `chunk` that the scan induces."""
        least, seen = state
        before = (chunk["before"] >> np.uint64(56)).astype(np.int16)
        take = {"larger": before >= symbol, "smaller": before <= symbol, "below": before < symbol}[kind] & (chunk["pos"] > 0)
        source = np.flatnonzero(take)
        lcp = chunk["lcp"]
        if len(source):
            to = before[source]
            order = np.argsort(to.astype(np.uint8), kind="stable")
            source, to = source[order], to[order]
            new = np.ones(len(to), bool)
            new[1:] = to[1:] != to[:-1]
            first = np.where(new, 0, np.append(0, source[:-1]) + 1)
            shared = _least_between(lcp, first, source)
            shared[new] = np.minimum(shared[new], least[to[new]])
            t = chunk[source]
            t["pos"] -= 1
            t["before"] <<= np.uint64(8)
            t["left"] -= 1
            t["lcp"] = np.minimum(shared.astype(np.int16) + 1, self.depth)
            t["lcp"][new & ~seen[to]] = 0
            empty = np.flatnonzero(t["left"] == 0)
            if len(empty):
                again = empty[np.argsort(t["pos"][empty], kind="stable")]
                t["before"][again], t["left"][again] = self.eight[t["pos"][again]], CARRIED
            np.minimum(least, lcp.min(), out=least)
            cut = np.flatnonzero(new)
            seen[to[cut]] = True
            ends = np.append(cut[1:], len(to))
            last = source[ends - 1]
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            least[to[cut]] = rest[last + 1]
            for s, a, b in zip(to[cut].tolist(), cut.tolist(), ends.tolist()):
                queue.push(s, t[a:b])
        elif len(lcp):
            np.minimum(least, lcp.min(), out=least)

    def _shared(self, i: int, j: int) -> int:
        """The prefix that two suffixes share, `depth` at most."""
        m = min(self.depth, self.n - max(i, j))
        differ = np.flatnonzero(self.text[i : i + m] != self.text[j : j + m])
        return int(differ[0]) if len(differ) else m

    def _scans(self, seeds: np.ndarray, lcps: np.ndarray, emit: Callable[[int, np.ndarray, bool], None]) -> None:
        """Both scans from seeds in ascending order; `emit` gets symbol, chunk and whether it is of smaller suffixes, in descending order."""
        larger, queue = Queue(self.space), Queue(self.space)
        state = np.full(256, 255, np.uint8), np.zeros(256, bool)
        if self.n:
            self._induce(queue, self._tuples(np.array([self.n]), 0), -1, "larger", state)
        firsts = self.text[seeds]
        edge = np.searchsorted(firsts, np.arange(257))
        for c in range(256):
            last = -1
            for chunk in queue.drain(c):
                if last < 0:
                    chunk["lcp"][0] = 0
                last = int(chunk["pos"][-1])
                larger.push(c, chunk)
                self._induce(queue, chunk, c, "larger", state)
            for a in range(int(edge[c]), int(edge[c + 1]), CHUNK):
                b = min(a + CHUNK, int(edge[c + 1]))
                chunk = self._tuples(seeds[a:b], lcps[a:b])
                if a == edge[c]:
                    chunk["lcp"][0] = self._shared(last, int(seeds[a])) if last >= 0 else 0
                self._induce(queue, chunk, c, "larger", state)
        queue = Queue(self.space)
        state = np.full(256, 255, np.uint8), np.zeros(256, bool)
        for c in range(255, -1, -1):
            last = -1
            for chunk in queue.drain(c):
                if last < 0:
                    chunk["lcp"][0] = 0
                last = int(chunk["pos"][-1])
                emit(c, chunk, True)
                self._induce(queue, chunk, c, "smaller", state)
            carried = -1
            for chunk in larger.backward(c):
                # a tuple's lcp is with the one before it in ascending order, so with the next one here
                own = chunk["lcp"].copy()
                chunk["lcp"][1:] = own[:-1]
                chunk["lcp"][0] = carried if carried >= 0 else self._shared(last, int(chunk["pos"][0])) if last >= 0 else 0
                carried = int(own[-1])
                emit(c, chunk, False)
                self._induce(queue, chunk, c, "below", state)

    def _lcps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The prefix each two suffixes share, `depth` at most."""
        out = np.zeros(len(i), np.uint8)
        open_, at = np.arange(len(i)), 0
        while len(open_) and at < self.depth:
            p, q = np.minimum(i[open_] + at + CARRIED, self.n + CARRIED), np.minimum(j[open_] + at + CARRIED, self.n + CARRIED)
            x = self.eight[p] ^ self.eight[q]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            ends = np.minimum(self.n - np.maximum(i[open_], j[open_]), self.depth)
            out[open_] = np.minimum(at + same, ends)
            open_ = open_[(same == 8) & (at + 8 < ends)]
            at += 8
        return out

    def _ranked(self, seeds: np.ndarray) -> np.ndarray:
        """The seeds in ascending order of their suffixes' first `depth` bytes."""
        m = len(seeds)
        found = []

        def emit(c: int, chunk: np.ndarray, smaller: bool) -> None:
            if smaller:
                found.append(chunk["pos"][((chunk["before"] >> np.uint64(56)) > c) & (chunk["pos"] > 0)])

        self._scans(seeds[np.argsort(self.text[seeds], kind="stable")], np.zeros(m, np.uint8), emit)
        order = np.searchsorted(seeds, np.concatenate(found)[::-1]) if found else np.zeros(0, np.int64)
        # names: a stretch reaches to the next seed's first byte, the last one to the end
        length = np.minimum(np.append(seeds[1:] + 1, self.n), self.n) - seeds
        key = mix(self._hashes(seeds, length) + length.astype(np.uint64))
        rank = np.zeros(m, np.int64)
        rank[order] = np.cumsum(np.append(True, key[order][1:] != key[order][:-1]))
        return self._doubled(rank, seeds, 1)

    def _hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        open_, at = np.arange(len(starts)), 0
        while len(open_):
            left = np.minimum(lengths[open_] - at, 8)
            x = self.eight[starts[open_] + at + CARRIED] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
            out[open_] = mix(out[open_] * np.uint64(0x9E3779B97F4A7C15) + mix(x) + np.uint64(1))
            open_ = open_[lengths[open_] > at + 8]
            at += 8
        return out

    def _doubled(self, rank: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
        """Order of the reduced string's suffixes, whose first k names `rank` ranks."""
        m = len(rank)
        reach = np.append(seeds[k:], np.full(min(k, m), self.n + self.depth)) - seeds
        if m < 2 or reach.min() >= self.depth or rank.max() == m:
            return np.argsort(rank)
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: m - k] |= rank[k:].astype(np.uint64)
        order = np.argsort(key)
        new = key[order]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(np.append(True, new[1:] != new[:-1]))
        return self._doubled(rank, seeds, 2 * k)

    def descending(self, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """`emit` gets positions and, of each, the prefix shared with the suffix given before it."""
        seeds = self._seeds()
        ranked = seeds[self._ranked(seeds)]
        lcps = np.zeros(len(ranked), np.uint8)
        lcps[1:] = self._lcps(ranked[1:], ranked[:-1])
        self._scans(ranked, lcps, lambda c, chunk, smaller: emit(chunk["pos"], chunk["lcp"]))
