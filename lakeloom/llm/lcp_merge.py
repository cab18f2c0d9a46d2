"""Front-coded sorted runs of byte strings and their merge by a loser tree that knows common prefixes.

A run stores for each string the length of the prefix it shares with its predecessor and the bytes after it. While runs
are merged, each stream keeps the length of the prefix that its head shares with the last output. Of two heads the one
with the longer shared prefix is the smaller, without a look at any byte; only at equal lengths are bytes compared,
from that length on. So no byte of a known common prefix is compared again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that `start` bytes agree."""
    n, h = min(len(a), len(b)), start
    step = 16
    while h < n:
        if a[h : h + step] == b[h : h + step]:
            h += step
            step = min(step * 2, 4096)
        elif step > 1:
            step = max(1, step // 8)
        else:
            return h
    return min(h, n)


def front_code(items: Iterable[tuple[bytes, object]]) -> list[tuple[int, bytes, object]]:
    """(shared prefix, rest, payload) of items in order."""
    out, last = [], b""
    for string, payload in items:
        h = common_prefix(last, string)
        out.append((h, string[h:], payload))
        last = string
    return out


def pack_run(items: list[tuple[bytes, object]]) -> bytes:
    """A sorted run as bytes."""
    return pickle.dumps(front_code(sorted(items, key=lambda x: x[0])), protocol=5)


def unpack_run(data: bytes) -> Iterator[tuple[int, bytes, object]]:
    yield from pickle.loads(data)


class LoserTree:
    """Merge of sorted front-coded streams: yields (shared prefix with the previous output, string, payload)."""

    def __init__(self, streams: list[Iterator[tuple[int, bytes, object]]]):
        self.streams = streams
        k = 1
        while k < max(1, len(streams)):
            k *= 2
        self.k = k
        self.heads: list[bytes | None] = [None] * k
        self.payloads: list[object] = [None] * k
        self.shared = [0] * k
        for i in range(len(streams)):
            self._advance(i)
            self.shared[i] = 0
        self.losers = [0] * k
        self.top = self._build(1)
        self.compared = 0

    def _advance(self, i: int) -> None:
        item = next(self.streams[i], None)
        if item is None:
            self.heads[i] = None
            return
        h, rest, self.payloads[i] = item
        self.heads[i] = (self.heads[i] or b"")[:h] + rest
        self.shared[i] = h

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows the prefix it shares with the winner."""
        a, b = self.heads[i], self.heads[j]
        if a is None:
            return j, i
        if b is None:
            return i, j
        x, y = self.shared[i], self.shared[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        h = common_prefix(a, b, x)
        if a[h : h + 1] <= b[h : h + 1]:
            self.shared[j] = h
            return i, j
        self.shared[i] = h
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.heads[self.top] is not None:
            i = self.top
            yield self.shared[i], self.heads[i], self.payloads[i]
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                i, self.losers[node] = self._play(i, self.losers[node])
                node //= 2
            self.top = i
