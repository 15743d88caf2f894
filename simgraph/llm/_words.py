"""Words of whole texts as 64-bit numbers, straight from Arrow's buffers.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return: ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so the work is done on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at once; arrays of eight bytes a character stay within the caches' reach.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer pieces come."""

    def __init__(self) -> None:
        self.p = self.q = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            self.p, self.q = _powers(_BASE, n), _powers(_INV, n)
        return self.p[:n], self.q[:n]


_POW = _Powers()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers; another ``seed`` gives another one."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of rows and the end) of a string array; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n, at = len(col), col.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + at)[at:].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _piece(b: np.ndarray, row_starts: np.ndarray, sep: np.ndarray, prefixes: tuple[int, ...]) -> list[np.ndarray]:
    """Starts, ends, hashes and hashes of prefixes of the words of ``b``; a row's start also starts a word."""
    n = len(b)
    w = ~sep[b]
    first = w.copy()
    first[1:] &= ~w[:-1]
    row_starts = row_starts[row_starts < n]
    first[row_starts] = w[row_starts]
    last = np.empty(n, bool)
    last[-1:] = w[-1:]
    last[:-1] = w[:-1] & (~w[1:] | first[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = _POW.get(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((b.astype(U) + U(1)) * p[:n], out=total[1:])
    out = [starts, ends, mix((total[ends] - total[starts]) * q[starts])]
    for k in prefixes:
        to = np.minimum(starts + k, ends)
        out.append(mix((total[to] - total[starts]) * q[starts], k))
    return out


def words(b: np.ndarray, offs: np.ndarray, sep: np.ndarray = SEP, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(starts, ends, hashes, first word of each row and their number, hashes of prefixes ...) for all rows.

    Works piece by piece; a row longer than a piece is cut at a separator.
    """
    got, at, n = [], 0, len(b)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            k = np.searchsorted(offs, to, "right") - 1
            if offs[k] > at:
                to = int(offs[k])
            else:
                stop = int(offs[k + 1])
                while to < stop and not sep[b[to]]:
                    step = np.flatnonzero(sep[b[to : min(stop, to + 4096)]])
                    to = to + int(step[0]) if len(step) else min(stop, to + 4096)
        inside = offs[np.searchsorted(offs, at) : np.searchsorted(offs, to)] - at
        s, e, *h = _piece(b[at:to], inside, sep, prefixes)
        got.append((s + at, e + at, *h))
        at = to
    if not got:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(len(offs), np.int64), *(np.zeros(0, U) for _ in prefixes)
    s, e, h, *more = (np.concatenate(x) for x in zip(*got, strict=True))
    return s, e, h, np.searchsorted(s, offs), *more


def slices(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def grams(h: np.ndarray, rows: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of k words, first run of each row and their number); runs stay inside a row."""
    n = len(h)
    counts = np.maximum(np.diff(rows) - (k - 1), 0)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    if n < k:
        return np.zeros(0, U), np.zeros(len(rows), np.int64)
    g = np.zeros(n - k + 1, U)
    for j in range(k):
        g *= U(0xD6E8FEB86659FD93)
        g += h[j : n - k + 1 + j]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    return mix(g[row[: n - k + 1] == row[k - 1 :]], seed), firsts


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out
