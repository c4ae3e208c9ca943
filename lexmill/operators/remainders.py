"""What is left of byte strings after deletions, as numbers: which of many keys have a remainder in common
with one of a few probes.

A string's number is the sum of its bytes times powers of a factor, modulo 2^64, so that the numbers
of all remainders of equally long keys come from sums over their beginnings. Equal remainders have
equal numbers; different ones hardly ever, which costs a comparison and no more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BITS = 22
#: Numbers that are held at once.
_BLOCK = 1 << 19


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([1], np.full(n, _FACTOR))).astype(np.uint64), dtype=np.uint64)


def numbers(keys: np.ndarray, k: int) -> np.ndarray:
    """keys: bytes, a row each. The numbers of each key without up to k (0 to 2) of its bytes."""
    n, size = keys.shape
    x, w = keys.astype(np.uint64) + np.uint64(1), _powers(size + 1)
    # sums[d][:, i]: of the first i bytes, each as many places further left as d says.
    sums = []
    for d in range(min(k, size) + 1):
        s = np.zeros((n, size + 1), np.uint64)
        np.cumsum(x[:, d:] * w[: size - d], axis=1, out=s[:, d + 1 :], dtype=np.uint64)
        sums.append(s)
    out = [sums[0][:, size:]]
    if k >= 1 and size >= 1:
        out.append(sums[0][:, :size] + (sums[1][:, size:] - sums[1][:, 1:]))
    if k >= 2 and size >= 2:
        i, j = np.triu_indices(size, 1)
        out.append(sums[0][:, i] + (sums[1][:, j] - sums[1][:, i + 1]) + (sums[2][:, size:] - sums[2][:, j + 1]))
    return np.concatenate(out, axis=1)


def within(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Of pairs of byte strings, a row each, all of a equally long and all of b: the optimal string
    alignment distance, where it is no more than k; else some number above k."""
    n, far = len(a), k + 1
    row = {j: np.full(n, min(j, far), np.int8) for j in range(min(b.shape[1], k) + 1)}
    before: dict[int, np.ndarray] = {}
    none = np.full(n, far, np.int8)
    for i in range(1, a.shape[1] + 1):
        now: dict[int, np.ndarray] = {0: np.full(n, min(i, far), np.int8)} if i <= k else {}
        for j in range(max(1, i - k), min(b.shape[1], i + k) + 1):
            cell = np.minimum(row.get(j, none), now.get(j - 1, none)) + np.int8(1)
            np.minimum(cell, row.get(j - 1, none) + (a[:, i - 1] != b[:, j - 1]), out=cell)
            if i > 1 and j > 1 and j - 2 in before:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                np.minimum(cell, np.where(swapped, before[j - 2] + np.int8(1), far), out=cell)
            now[j] = np.minimum(cell, far)
        before, row = row, now
    return row.get(b.shape[1], none)


def _slot(found: np.ndarray) -> np.ndarray:
    return (found * _MIX) >> np.uint64(64 - _BITS)


class Remainders:
    """Probes, each with a budget of edits, to find keys for."""

    def __init__(self, probes: list[bytes], budgets: list[int], k: int):
        self.k, self.sizes, self.budgets = k, np.array([len(p) for p in probes], np.int64), np.array(budgets, np.int64)
        self.data = np.zeros((len(probes), max(map(len, probes), default=0)), np.uint8)
        for row, p in zip(self.data, probes):
            row[: len(p)] = np.frombuffer(p, np.uint8)
        parts = [np.unique(numbers(np.frombuffer(p, np.uint8).reshape(1, -1), b)) for p, b in zip(probes, budgets)]
        every = np.concatenate(parts)
        side = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(every, kind="stable")
        self.side = side[order]
        self.number, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.lengths = frozenset((self.sizes[:, None] + np.arange(-k, k + 1)).ravel().tolist())

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, probe) pairs, by their places, that are within the probe's budget of edits, of keys no
        longer than longest."""
        seen = np.zeros(1 << _BITS, bool)
        seen[_slot(self.number)] = True
        for size in np.unique(sizes).tolist():
            if size > longest or size not in self.lengths:
                continue
            rows = np.flatnonzero(sizes == size)
            step = max(1, _BLOCK // (1 + size + size * (size - 1) // 2))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                bytes_of = data[starts[some][:, None] + np.arange(size)]
                found = numbers(bytes_of, self.k)
                key, which = np.nonzero(seen[_slot(found)])
                number = found[key, which]
                place = np.minimum(np.searchsorted(self.number, number), len(self.number) - 1)
                same = self.number[place] == number
                key, place = key[same], place[same]
                if not len(key):
                    continue
                n = self.last[place] - self.first[place]
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs = np.repeat(key, n) * len(self.sizes) + self.side[np.repeat(self.first[place], n) + each]
                key, side = np.divmod(np.unique(pairs), len(self.sizes))
                near = np.abs(self.sizes[side] - size) <= self.budgets[side]
                key, side = key[near], side[near]
                for n in np.unique(self.sizes[side]).tolist():
                    these = np.flatnonzero(self.sizes[side] == n)
                    found = within(self.data[side[these], :n], bytes_of[key[these]], self.k)
                    these = these[found <= self.budgets[side[these]]]
                    yield some[key[these]], side[these]
