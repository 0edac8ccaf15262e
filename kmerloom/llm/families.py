"""Exact Jaccard links inside candidate families, by fragments of the order of their tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .tables import grouped, paired

FAMILY_TOKENS = 1_000_000
BITMAP_WORDS = 16
#: Families of so few members compare all pairs at once, and so many bytes of members are decoded together.
SMALL = 32
DECODED = 1 << 18


def raw_tokens(members: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, K.U) for x in members]


def _bitmap(x: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """Parity of the tokens in each of 64 * words cells (a power of two): sets differ in at least as many as bitmaps do."""
    bits = np.bincount((x >> K.U(7)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(K.U)


def bitmaps(sets: list[np.ndarray], most: int = 1024) -> list[np.ndarray]:
    """The bitmap of each set, with :func:`bitmap_words` words; up to ``most`` sets of one width are counted together."""
    out: list = [None] * len(sets)
    words = np.array([bitmap_words(len(x)) for x in sets], np.int64)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        step = max(1, most * BITMAP_WORDS // w)
        for k in range(0, len(at), step):
            part = [sets[i] for i in at[k : k + step]]
            cell = (np.concatenate(part) >> K.U(7)).astype(np.int64) & (64 * w - 1)
            cell += np.repeat(np.arange(len(part)) * (64 * w), [len(x) for x in part])
            bits = (np.bincount(cell, minlength=64 * w * len(part)) & 1).astype(np.uint8)
            for i, row in zip(at[k : k + step].tolist(), np.packbits(bits).view(K.U).reshape(len(part), w)):
                out[i] = row
    return out


def bitmap_words(n: int) -> int:
    """Words for a set of n tokens: at least as many cells as tokens."""
    return max(BITMAP_WORDS, 1 << (n // 64).bit_length())


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as one of fewer words."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, fragment: int = 4096) -> np.ndarray:
    """Overlap of each pair (a[i], b[i]): partial counts by fragment of the n-gram order, summed."""
    if sum(map(len, sets)) <= fragment and len(a) <= 64:  # all in one fragment: sorted sets are merged
        out = np.zeros(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a, b)):
            both = np.concatenate((sets[i], sets[j]))
            both.sort()
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        return out
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    new = np.r_[True, token[1:] != token[:-1]]
    rank = np.cumsum(new) - 1
    often = np.bincount(rank)[rank] > 1  # an n-gram of a single document is in no overlap
    token, of = token[often], of[often]
    total = np.zeros(len(a), np.int64)
    if not len(token):
        return total
    column = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
    for lo in range(0, int(column[-1]) + 1, fragment):
        s, e = np.searchsorted(column, [lo, lo + fragment])
        here, local = np.unique(of[s:e], return_inverse=True)
        bits = np.zeros((len(here) + 1, fragment // 8), np.uint8)
        np.bitwise_or.at(bits, (local, (column[s:e] - lo) >> 3), (1 << ((column[s:e] - lo) & 7)).astype(np.uint8))
        bits = bits.view(K.U)
        at = np.full(len(sets), len(here))
        at[here] = np.arange(len(here))
        pa_, pb_ = at[a], at[b]
        both = np.flatnonzero((pa_ < len(here)) & (pb_ < len(here)))
        for k in range(0, len(both), 20_000):
            x = both[k : k + 20_000]
            total[x] += np.bitwise_count(bits[pa_[x]] & bits[pb_[x]]).sum(1, dtype=np.int64)
    return total


class Links:
    """Links found among the members of one task: a count of partners for each, and a spanning forest."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        self.count, self.parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.copies[b])
        np.add.at(self.count, b, self.copies[a])
        parent = self.parent
        while len(a):  # hang the higher root on the lower one until no link crosses
            ra, rb = parent[a], parent[b]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            cross = hi != lo
            if not cross.any():
                break
            np.minimum.at(parent, hi[cross], lo[cross])
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]

    def rows(self):
        linked = np.flatnonzero((self.count > 0) | (self.parent != np.arange(len(self.ids))))
        return self.ids[linked], self.ids[self.parent[linked]], self.count[linked]


def link_batch(found: list) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])


def _kernel(pct: int, decode):
    def pairs(n, maps, left, right, same):
        """Candidate partners in the right block for each row of the left block."""
        order = right[np.argsort(n[right], kind="stable")]
        sizes, sorted_maps = n[order], maps[order]
        for i in left:
            lo = np.searchsorted(sizes, -(-pct * n[i] // 100))
            hi = np.searchsorted(sizes, 100 * n[i] // pct, "right")
            j = order[lo:hi]
            most = (100 - pct) * (n[i] + n[j]) // (100 + pct)
            ok = np.bitwise_count(sorted_maps[lo:hi] ^ maps[i]).sum(1, dtype=np.int64) <= most
            if same:
                ok &= j > i
            yield i, j[ok]

    def few(n, maps, left, right, same):
        """The pairs of a small family, at once."""
        if not len(left) or not len(right):
            return left[:0], left[:0]
        i, j = np.repeat(left, len(right)), np.concatenate([right] * len(left))
        ok = (n[j] >= -(-pct * n[i] // 100)) & (n[j] <= 100 * n[i] // pct)
        if same:
            ok &= j > i
        i, j = i[ok], j[ok]
        if not maps.any():  # none were made
            return i, j
        ok = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64) <= (100 - pct) * (n[i] + n[j]) // (100 + pct)
        return i[ok], j[ok]

    def group(s, at, sets, cols):
        ids_all, blk, bi, bj, weight, _ = cols
        n, block, links = np.array([len(x) for x in sets]), blk[at], Links(ids_all[at], weight[at])
        maps = np.stack([_bitmap(x) for x in sets]) if len(sets) > 4 else np.zeros((len(sets), 1), K.U)
        left, right = np.flatnonzero(block == bi[s]), np.flatnonzero(block == bj[s])
        a, b, held = [], [], 0

        def settle():
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                both = overlaps(sets, x, y)
                good = 100 * both >= pct * (n[x] + n[y] - both)
                links.add(x[good], y[good])
                a.clear()
                b.clear()

        if len(sets) <= SMALL:
            i, j = few(n, maps, left, right, bi[s] == bj[s])
            a.append(i)
            b.append(j)
        for i, j in pairs(n, maps, left, right, bi[s] == bj[s]) if len(sets) > SMALL else ():
            if len(j):
                a.append(np.full(len(j), i))
                b.append(j)
                held += len(j)
                if held > 500_000:
                    settle()
                    held = 0
        settle()
        return links.rows()

    def kernel(t, bounds):
        cols = [t.column(c).to_numpy() for c in ("node", "blk", "bi", "bj", "copies")] + [t.column("tokens")]
        found, held, raw, size = [], [], [], 0

        def settle():
            sets, k = decode(raw), 0
            for s, at in held:
                found.append(group(s, at, sets[k : k + len(at)], cols))
                k += len(at)
            held.clear()
            raw.clear()

        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                members = cols[-1].slice(s, e - s).to_pylist()
                once = {x: s + k for k, x in enumerate(zip(cols[0][s:e].tolist(), members))}  # repeated rows
                at = np.array(sorted(once.values()))
                more = [members[k - s] for k in at]
                held.append((s, at))
                raw += more
                size += sum(map(len, more))
                if size >= DECODED:
                    settle()
                    size = 0
        if held:
            settle()
        if found:
            yield link_batch(found)

    return kernel


def family_links(members: DataFrame, pct: int, decode=raw_tokens) -> DataFrame:
    """``members(family, node, copies, tokens, blk, pairs)`` -> ``(a, b, n)``: links of Jaccard >= pct/100 inside each family.

    ``decode`` turns members' bytes into their sorted distinct 64-bit tokens. Pairs within the size ratio whose parity
    bitmaps differ in at most the allowed number of bits (a lower bound of the set difference, so no link is lost) are
    counted exactly. A row names a node, a node that it is linked with directly or through others, and the copies of
    its direct partners within one pair of blocks; rows of a node are to be summed. ``blk`` and ``pairs`` come from
    ``dealt`` with about FAMILY_TOKENS tokens a block.
    """
    return grouped(paired(members), ["family", "bi", "bj"], _kernel(pct, decode), "a long, b long, n long")
