"""Suffix order of one shard of bytes by induced sorting.

Suffixes that are smaller than their successor are of type S, the others of type
L; an S suffix after an L one is a seed. The seeds are sorted by the substrings
up to the next seed, and by recursion on the string of those substrings' ranks
where some are equal. All other suffixes are induced: seen in ascending order, a
sorted suffix hands its predecessor to the queue of the predecessor's first
byte, if that predecessor is of type L; in descending order likewise for S. A
queue is a list of chunks in the order of arrival, which is the order of the
suffixes, so nothing is ever compared again. Chunks above a bound of memory go
to a scratch file that ends with the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY_ITEMS = 4_000_000  # queued suffixes held in memory at a time


class _Queues:
    """One first-in-first-out queue of positions per byte value."""

    def __init__(self, in_memory: int = MEMORY_ITEMS):
        self.chunks: list[list] = [[] for _ in range(257)]
        self.held, self.in_memory, self.file = 0, in_memory, None

    def put(self, byte: int, positions: np.ndarray) -> None:
        if self.held + len(positions) > self.in_memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(positions.astype(np.int64).tobytes())
            self.chunks[byte].append((at, len(positions)))
        else:
            self.held += len(positions)
            self.chunks[byte].append(positions)

    def take(self, byte: int) -> np.ndarray | None:
        """The oldest chunk of a queue."""
        if not self.chunks[byte]:
            return None
        chunk = self.chunks[byte].pop(0)
        if isinstance(chunk, tuple):
            self.file.seek(chunk[0])
            return np.frombuffer(self.file.read(8 * chunk[1]), np.int64)
        self.held -= len(chunk)
        return chunk


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte array in ascending order (the end is smaller than any byte)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _is_smaller(text)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = seeds[_seed_order(text, smaller, seeds)]
    grown = _induce(text, smaller, order, ascending=True)
    return _induce(text, smaller, grown, ascending=False)


def _is_smaller(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S: the next different byte is larger. The last suffix is of type L."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # text[i] != text[i + 1]
    out = np.zeros(n, bool)
    if len(change):
        up = text[change + 1] > text[change]
        lengths = np.diff(np.concatenate(([-1], change)))
        out[:change[-1] + 1] = np.repeat(up, lengths)
    return out


def _seed_order(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    m = len(seeds)
    if m < 2:
        return np.arange(m)
    # byte and type of each element: no seed substring is then a proper prefix of another
    coded = (text.astype(">u2") * 2 + smaller).astype(">u2").tobytes()
    ends = np.concatenate((seeds[1:] + 1, [len(text)]))
    parts = [coded[a:b] for a, b in zip((2 * seeds).tolist(), (2 * ends).tolist())]
    rank = {p: k for k, p in enumerate(sorted(set(parts)))}
    names = np.fromiter(map(rank.__getitem__, parts), np.int64, m)
    if len(rank) == m:
        return np.argsort(names)
    return _rank_order(names)


def _rank_order(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of numbers: ranks of twice the length from pairs of ranks, again and again."""
    n, rank, width = len(names), names + 1, 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[:-width] = rank[width:]
        pair = rank * (n + len(names) + 2) + follow
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n or width >= n:
            return order


def _induce(text: np.ndarray, smaller: np.ndarray, given: np.ndarray, ascending: bool) -> np.ndarray:
    """From sorted seeds the sorted L suffixes (ascending), or from those all suffixes (descending).

    The queue of each byte is worked off before the next byte's: suffixes of a run
    of equal bytes come back into the queue that is being worked off."""
    n = len(text)
    first = text[given]
    bounds = np.searchsorted(first, np.arange(257))  # ``given`` is sorted, so bytes are in order
    queues = _Queues()
    out: list[np.ndarray] = []
    if ascending:
        queues.put(int(text[-1]), np.array([n - 1]))  # follows the empty end, the smallest of all

    def hand_on(sorted_ones: np.ndarray) -> None:
        before = sorted_ones[sorted_ones > 0] - 1
        before = before[smaller[before] != ascending]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cuts):
            if len(part):
                queues.put(int(text[part[0]]), part)

    for byte in (range(256) if ascending else range(255, -1, -1)):
        mine = given[bounds[byte]:bounds[byte + 1]]
        if ascending:  # within a byte, L suffixes come before S ones
            while (chunk := queues.take(byte)) is not None:
                out.append(chunk)
                hand_on(chunk)
            hand_on(mine)
        else:
            while (chunk := queues.take(byte)) is not None:
                out.append(chunk)
                hand_on(chunk)
            larger = mine[::-1]
            out.append(larger)
            hand_on(larger)
    if not out:
        return np.empty(0, np.int64)
    whole = np.concatenate(out)
    return whole if ascending else whole[::-1]
