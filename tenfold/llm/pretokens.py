"""Whole texts as token ids, through a bounded memory of the pieces between single spaces.

With the byte-level pattern, a space between two characters that are not white space always starts
a new pre-token, so what stands between two such spaces is tokenised alike wherever it occurs.
Arrow splits the texts and reduces them to distinct pieces; each is split and resolved once while it
stays in memory, and texts are then gathered from the ids of their pieces.  Nothing depends on what
is in memory but speed.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tenfold.llm.common import slices

IDS = np.dtype("<u4")
#: Pieces longer than this are resolved each time and not remembered.
LONGEST = 48
#: Pieces whose ids are gathered at once.
GATHERED = 1 << 18

#: All white space, and what of it is ASCII.
WHITE = [c for c in map(chr, range(0x10000)) if c.isspace()]
PLAIN_WHITE = [c for c in WHITE if c.isascii()]

#: Rows of ids: all of them, and the n + 1 offsets between rows.
Rows = tuple[np.ndarray, np.ndarray]
Resolve = Callable[[Sequence[str]], Rows]

TEXT = pa.large_string()


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def packed(ids: list[bytes]) -> Rows:
    """Rows from the bytes of each."""
    return np.frombuffer(b"".join(ids), IDS), offsets(np.fromiter(map(len, ids), np.int64, len(ids)) // IDS.itemsize)


def _gather(rows: Rows, at: np.ndarray) -> Rows:
    """The rows with the numbers `at`, in that order."""
    ids, off = rows
    sizes = off[at + 1] - off[at]
    new = offsets(sizes)
    place = np.repeat(off[at] - new[:-1], sizes)
    place += np.arange(new[-1])
    return ids[place], new


def _after(a: Rows, b: Rows) -> Rows:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], a[1][-1] + b[1][1:]])


class Memory:
    """What was asked for lately: about `size` keys with their ids; where there are more, those not asked for longest go until half are left."""

    def __init__(self, size: int, fill: Callable[[list[str]], Rows]):
        self.size, self.fill, self.calls = size, fill, 0
        self.at: dict[str, int] = {}  # a key's row; keys are in the order of their rows
        self.used = np.zeros(0, np.int64)
        self.rows: Rows = np.zeros(0, IDS), np.zeros(1, np.int64)

    def ids(self, keys: list[str], distinct: bool = False) -> Rows:
        """The ids of each key; a key may repeat where they are not `distinct`."""
        self.calls += 1
        known = len(self.at)
        at = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        asked = np.flatnonzero(at < 0)
        first = list(map(keys.__getitem__, asked.tolist()))
        if not distinct:
            first = list(dict.fromkeys(first))
        long = [k for k in first if len(k) > LONGEST]
        unseen = [k for k in first if len(k) <= LONGEST] + long if long else first
        self.at.update(zip(unseen, range(known, known + len(unseen))))
        self.rows = _after(self.rows, self.fill(unseen))
        at[asked] = known + np.arange(len(asked)) if len(asked) == len(unseen) and not long else [self.at[keys[i]] for i in asked.tolist()]
        found = _gather(self.rows, at)
        for k in long:
            del self.at[k]
        n, (ids, off) = len(self.at), self.rows
        self.rows = ids[: off[n]], off[: n + 1]
        self.used = np.concatenate([self.used, np.zeros(n - known, np.int64)])
        self.used[at[at < n]] = self.calls
        if n > self.size:
            half = max(1, self.size // 2)
            latest = self.used >= np.partition(self.used, n - half)[n - half]
            self.at = {k: i for i, k in enumerate(compress(self.at, latest))}
            self.rows, self.used = _gather(self.rows, np.flatnonzero(latest)), self.used[latest]
        return found


def _regular(text: str) -> bool:
    """Whether each space stands between two characters that are not white space, and the text ends in none; other texts are split as a whole."""
    for c in PLAIN_WHITE if text.isascii() else WHITE:
        if c in text and (text[-1] == c or text[0] == " " or f"{c} " in text or f" {c}" in text):
            return False
    return True


class Encoder:
    """Texts to ids; `resolve` gives the ids of distinct pre-tokens."""

    def __init__(self, pattern: str, resolve: Resolve, pieces: int = 400_000, tokens: int = 600_000):
        self.split, self.resolve = regex.compile(pattern).findall, resolve
        self.tokens, self.pieces = Memory(tokens, resolve), Memory(pieces, self._split)

    def _split(self, pieces: list[str]) -> Rows:
        """The ids of pieces, each with one space before it."""
        if not pieces:
            return np.zeros(0, IDS), np.zeros(1, np.int64)
        flat = self.split(" " + " ".join(pieces))
        ids, off = self.tokens.ids(flat)
        return ids, off[np.append(np.flatnonzero([t[0] == " " for t in flat]), len(flat))]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: Sequence[str]) -> list[np.ndarray]:
        n = len(texts)
        if not n:
            return []
        regular = np.fromiter(map(_regular, texts), bool, n)
        split = pc.split_pattern(pa.array(texts, TEXT), " ")
        off = split.offsets.to_numpy().astype(np.int64)
        more = np.where(regular, np.diff(off) - 1, 0)  # pieces after the first, which has no space before it
        after = np.repeat(regular, np.diff(off))
        after[off[:-1]] = False
        pieces = split.flatten().filter(pa.array(after))
        del split, after
        heads = [self.split(t.split(" ", 1)[0] if r else t) for t, r in zip(texts, regular)]
        ids, starts = self.tokens.ids([t for h in heads for t in h])
        head = ids, starts[offsets(np.fromiter(map(len, heads), np.int64, n))]
        coded = pieces.dictionary_encode()
        del pieces
        rows = _after(self.pieces.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), True), head)
        place = np.append(np.arange(n) + np.cumsum(more) - more, n + len(coded))
        order = np.empty(place[-1], np.int64)
        rest = np.ones(len(order), bool)
        rest[place[:-1]] = False
        order[place[:-1]], order[rest] = len(coded.dictionary) + np.arange(n), coded.indices.to_numpy()
        del coded, rest
        pa.default_memory_pool().release_unused()
        out: list[np.ndarray] = []
        for a, b in slices(place, GATHERED):
            ids, off = _gather(rows, order[place[a] : place[b]])
            at = off[place[a : b + 1] - place[a]]
            out.extend(ids[x:y] for x, y in zip(at, at[1:]))
        return out
