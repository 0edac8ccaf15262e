"""Packed k-mers of many sequences at once, in NumPy: two bits a base, linear in the number of bases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PORTION = 1 << 18
BASE = np.full(256, 4, np.uint8)
BASE[[65, 67, 71, 84]] = range(4)


def rolled(raw: np.ndarray, k: int) -> np.ndarray:
    """The packed k-mer (k <= 31) that begins at each byte, -1 where it holds a letter other than A, C, G, T."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    base = BASE[raw]
    bad = np.cumsum(np.r_[0, base == 4])
    part, width, out, done = (base & 3).astype(np.int64), 1, None, 0
    while True:  # words of 1, 2, 4, ... bases are put together for the bits of k, the lowest first
        if k & width:
            out = part[:n].copy() if out is None else (out << (2 * width)) | part[done : done + n]
            done += width
        if 2 * width > k:
            break
        part = (part[:-width] << (2 * width)) | part[width:]
        width *= 2
    out[bad[k:] > bad[:-k]] = -1
    return out


def complement(words: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements; -1 stays."""
    x = ~words.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = ((x & np.uint64(mask)) << np.uint64(shift)) | ((x >> np.uint64(shift)) & np.uint64(mask))
    return np.where(words < 0, -1, (x >> np.uint64(64 - 2 * k)).astype(np.int64))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its rows."""
    a = column.cast(pa.large_string()).fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = a.buffers()
    offsets = np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def window_batches(seq: str, k: int, step: int, gap: int | None):
    """For ``mapInArrow``: the other columns, ``offset``, ``kmer`` and, with a gap, ``kmer2`` that begins so many bases later.

    Sequences of any length go through in portions of ``PORTION`` bases that overlap by a window.
    """

    def work(batches):
        for b in batches:
            raw, offsets = bytes_of(b.column(seq))
            rest = [c for c in b.schema.names if c != seq]
            for lo in range(0, len(raw), PORTION):
                hi = min(len(raw), lo + PORTION)
                words = rolled(raw[lo : min(len(raw), hi + k - 1 + (gap or 0))], k)
                at = np.arange(lo, lo + len(words))
                row = np.searchsorted(offsets, at, "right") - 1
                ok = (words >= 0) & (at < hi) & (at + k + (gap or 0) <= offsets[row + 1]) & ((at - offsets[row]) % step == 0)
                if gap is not None:
                    there = np.minimum(np.arange(len(words)) + gap, len(words) - 1)
                    ok &= words[there] >= 0
                ok = np.flatnonzero(ok)
                if not len(ok):
                    continue
                cols = [b.column(c).take(pa.array(row[ok])) for c in rest] + [pa.array((at - offsets[row])[ok].astype(np.int32)), pa.array(words[ok])]
                names = [*rest, "offset", "kmer"]
                if gap is not None:
                    cols.append(pa.array(words[there[ok]]))
                    names.append("kmer2")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return work


def run_batches(seq: str):
    """For ``mapInArrow``: the other columns, and ``start`` and ``end`` of each run without N."""

    def work(batches):
        for b in batches:
            raw, offsets = bytes_of(b.column(seq))
            rest = [c for c in b.schema.names if c != seq]
            inside = np.zeros(len(raw) + 2, bool)
            inside[1:-1] = (raw != 78) & (raw != 110)
            border = np.zeros(len(raw) + 1, bool)
            border[offsets] = True
            starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
            ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
            row = np.searchsorted(offsets, starts, "right") - 1
            at = offsets[row]
            cols = [b.column(c).take(pa.array(row)) for c in rest] + [pa.array((starts - at).astype(np.int32)), pa.array((ends - at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "start", "end"])

    return work
