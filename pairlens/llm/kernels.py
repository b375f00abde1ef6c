"""Array helpers that run inside tasks: flat bytes of Arrow strings, words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``, and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
BY_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters close ones (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_P = U(0x9E3779B97F4A7C15 | 1)
_powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(4095, _P, U))])
CUT = 1 << 15  # bytes whose hashes are summed at once, so that they stay in a core's own cache
_at, _over = (np.concatenate([np.ones(1, U), np.cumprod(np.full(CUT - 1, x, U))]) for x in (_P, U(pow(int(_P), -1, 1 << 64))))
_LOWERED = BYTE[LOWER]


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, 2 * len(_powers)), _P, U))])
    return _powers


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and the offsets of each in them; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least: working arrays stay bounded."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased (A-Z) rows: each word's row, start and end byte, and 64-bit hash."""
    is_word = inside[LOWER][data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = is_word[cut]
    ends[cut - 1] = is_word[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return row, starts, stops, mix(_summed(data, starts, stops) + (stops - starts).astype(U)) if len(starts) else np.zeros(0, U)


def _summed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Of each word the sum of its bytes' numbers times powers of ``_P``: a difference of running sums, over the power at its start."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + CUT, "right")))
        lo, hi = starts[i], stops[j - 1]
        if j == i + 1 and hi - lo > CUT:  # a word that is longer
            out[i] = np.sum(_LOWERED[data[lo:hi]] * powers(int(hi - lo))[: hi - lo], dtype=U)
        else:
            run = np.zeros(hi - lo + 1, U)
            np.cumsum(_LOWERED[data[lo:hi]] * _at[: hi - lo], out=run[1:])
            first = starts[i:j] - lo
            out[i:j] = (run[stops[i:j] - lo] - run[first]) * _over[first]
        i = j
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, over row ends too; ``len(h) - n + 1`` of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m].copy()
    for j in range(1, n):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[j : j + m])
    return out


def whole(row: np.ndarray, n: int) -> np.ndarray:
    """Which of ``grams(h, n)`` lie in one row."""
    m = len(row) - n + 1
    return row[:m] == row[n - 1 :] if m > 0 else np.zeros(0, bool)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling; ``len(x) - w + 1`` of them."""
    got, out = 1, x
    while 2 * got <= w:
        out = np.minimum(out[:-got], out[got:])
        got *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - got :][: len(x) - w + 1]) if got < w else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
