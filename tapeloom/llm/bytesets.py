"""Vectorised views of Arrow text columns: bytes, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are worked on in groups of about so many bytes, which bounds the arrays beside them.
GROUP_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and each row's offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None


def trim() -> None:
    """Give freed memory back to the system: a worker process serves many tasks and operators."""
    if _TRIM is not None:
        _TRIM(0)


def groups(offs: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer row stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end
        at = end
    trim()


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes of the class inside, runs never crossing rows; and the rows' offsets in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    on = inside[data]
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    before = np.empty_like(on)
    before[0], before[1:] = False, on[:-1]
    starts = np.flatnonzero(on & (~before | edge))
    after = np.empty_like(on)
    after[-1], after[:-1] = False, on[1:]
    last = np.empty_like(edge)
    last[-1], last[:-1] = True, edge[1:]
    ends = np.flatnonzero(on & (~after | last)) + 1
    return starts, ends, np.searchsorted(starts, offs)


_RNG = np.random.default_rng(20_011)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_BACK = pow(_BASE, -1, 1 << 64)
MIX = [U(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 64)]
_POWERS: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, GROUP_BYTES + 1), base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= 4 * GROUP_BYTES:
            _POWERS[name] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Rolling:
    """Prefix sums of a polynomial hash over bytes: any span's hash in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * _power("up", _BASE, n)[:n], out=self.sums[1:])
        self.back = _power("down", _BACK, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of size bytes."""
        m = len(self.sums) - size
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:m]) * self.back[:m])


def word_hashes(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word after lower-casing A-Z, and the rows' offsets in them."""
    data = LOWER[data]
    starts, ends, at = spans(data, offs, inside)
    return Rolling(data).of(starts, ends), at


def run_hashes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of size words within a row, the first word's index, and the rows' offsets in the runs."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    total = words[:n] * MIX[0]
    for k in range(1, size):
        total += words[k : k + n] * MIX[k]
    count = np.maximum(np.diff(at) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(out[-1]) + np.repeat(at[:-1] - out[:-1], count)
    return mix(total[first]), first, out
