"""NumPy kernels over the bytes of a batch of texts: word bounds, 64-bit hashes, rolling hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x + U((seed * BASE + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its rows."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count or not (pa.types.is_string(a.type) or pa.types.is_large_string(a.type)):
        a = pc.fill_null(a.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    offsets = np.frombuffer(off, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def portions(offsets: np.ndarray, size: int = 1 << 20):
    """Row ranges of about ``size`` bytes, so that temporaries stay in cache and memory stays bounded."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (A-Z lowered) and the first word of each row, from raw bytes."""
    low = _LOWER[raw]
    inside = ~_WHITE[raw] if is_word is None else is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    p = powers(BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((low.astype(U) + U(1)) * p[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(INVERSE, len(raw) + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), starts, ends, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, first: np.ndarray, w: int):
    """Yields each row's sorted distinct hashes of ``w`` consecutive words; with fewer words, the whole sequence as one."""
    k = powers(0xC2B2AE3D27D4EB4F, w + 1)
    if len(h) >= w:
        s = np.zeros(len(h) - w + 1, U)
        for j in range(w):
            s += h[j : len(h) - w + 1 + j] * k[w - j]
        s = mix(s, w)
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= w:
            x = np.sort(s[a : b - w + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif n:
            yield mix((h[a:b] * k[1 : n + 1][::-1]).sum(keepdims=True), 100 + int(n))
        else:
            yield np.zeros(0, U)


def char_hashes(codes: np.ndarray, w: int) -> np.ndarray:
    """Rolling hash of every ``w`` consecutive code points, by doubling."""
    base = 0xD1342543DE82EF95
    parts, have, acc, done = [], 1, codes.astype(U) + U(7), 0
    out = None
    width = w
    while width:
        if width & 1:
            if out is None:
                out, done = acc, have
            else:
                n = min(len(out), len(acc) - done)
                out = out[:n] * U(pow(base, have, 1 << 64)) + acc[done : done + n]
                done += have
        width >>= 1
        if width:
            n = len(acc) - have
            if n <= 0:
                return np.zeros(0, U)
            acc = acc[:n] * U(pow(base, have, 1 << 64)) + acc[have : have + n]
            have *= 2
    return mix(out[: max(0, len(codes) - w + 1)])


def give_back() -> None:
    """Return freed memory to the system, as Python workers are used again by other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def bounded(work, rows: int | None):
    """``work`` on slices of at most ``rows`` rows, so that what it holds at a time does not depend on the batch size."""

    def run(batches):
        def slices():
            for b in batches:
                for i in range(0, b.num_rows, rows or max(1, b.num_rows)):
                    yield b.slice(i, rows) if rows else b

        try:
            yield from work(slices())
        finally:
            give_back()

    return run
