"""Breakpoints of many reads at once, from arrays of their hits (reads x k-mer offsets, one pair of strands).

Nothing walks along a read: a walk that ends at the first offset with some property is a search in a mask, its running
AND is an accumulation, its sums are differences of prefix sums. The junctions of a read follow one another, so they
are found level by level, each level for all reads that have one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FULL = (1 << 32) - 1
#: A read with more junctions than this is not called at all.
LEVELS = 3

FIELDS = ("read", "kind", "vague", "flip", "secondary", "left_code", "left_pos", "left_confi", "left_kmers", "right_code", "right_pos", "right_confi", "right_kmers", "left_bp_len", "right_bp_len", "bp_start", "bp_end", "bp_score")
EXACT, PE, LEFT_VAGUE, RIGHT_VAGUE, NO_RIGHT, NO_LEFT = range(6)


@dataclass
class Hits:
    """Hits of R reads over T offsets, R1's first: code 0 is absent, position -1 unknown; everything past ``total`` absent.

    ``code``, ``pos`` and ``score`` have the shape (2, R, T), forward strand first. ``n1`` offsets are R1's, ``border`` is
    where R1 itself ends, which differs in mates that were put together.
    """

    code: np.ndarray
    pos: np.ndarray
    score: np.ndarray
    n1: np.ndarray
    total: np.ndarray
    border: np.ndarray

    def rows(self, at: np.ndarray) -> "Hits":
        return Hits(self.code[:, at], self.pos[:, at], self.score[:, at], self.n1[at], self.total[at], self.border[at])

    def strands(self, strand: np.ndarray):
        r = np.arange(len(strand))
        return self.code[strand, r], self.pos[strand, r], self.score[strand, r]


def first(mask: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The first true offset of each row, or ``none``."""
    return np.where(mask.any(1), mask.argmax(1), none)


def last(mask: np.ndarray) -> np.ndarray:
    return np.where(mask.any(1), mask.shape[1] - 1 - mask[:, ::-1].argmax(1), -1)


def _take(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    return x[np.arange(len(x)), i]


def gap_ends(absent: np.ndarray, n1: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where a third absent offset in a row stands, from ``lo`` on, and within one mate."""
    t = np.arange(absent.shape[1])
    out = np.zeros_like(absent)
    out[:, 2:] = absent[:, 2:] & absent[:, 1:-1] & absent[:, :-2]
    across = (t[None] >= n1[:, None]) & (t[None] - 2 < n1[:, None])
    return out & ~across & (t[None] - 2 >= lo[:, None])


def strays(known: np.ndarray, pos: np.ndarray, h: Hits, sign: np.ndarray | None, border_at: np.ndarray | None) -> np.ndarray:
    """Whether some known position strays from the diagonal of the known one before by over 50, within one mate.

    With ``sign`` steps have a direction. Behind R1's own end a jump counts only from ``border_at`` (default: the one
    before) at or behind it.
    """
    t = np.arange(known.shape[1])[None]
    seen = np.maximum.accumulate(np.where(known, t, -1), 1)
    before = np.concatenate([np.full((len(known), 1), -1), seen[:, :-1]], 1)
    step = pos - np.take_along_axis(pos, np.maximum(before, 0), 1)
    step = np.abs(step) if sign is None else step * sign[:, None]
    n1, border = h.n1[:, None], h.border[:, None]
    far = np.abs(step - (t - before)) > 50
    allowed = ((before if border_at is None else border_at[:, None]) >= border) | (t < border)
    return (known & (before >= 0) & far & allowed & ~((before < n1) & (t >= n1))).any(1)


def majority_position(code, pos, sign: int, start: int, at: int) -> int:
    """The position at offset ``at`` by the most frequent diagonal of every third offset back to ``start``."""
    i = np.arange(at, start - 1, -3)
    i = i[(code[i] == code[at]) & (pos[i] >= 0)]
    if not len(i):
        return sign * at
    diagonal, votes = np.unique(pos[i] - sign * i, return_counts=True)
    return int(diagonal[votes.argmax()]) + sign * at


def _corrected(rows: np.ndarray, code, pos, sign, start, at, out) -> None:
    for r in rows:  # few: reads over repeats
        out[r] = majority_position(code[r], pos[r], int(sign[r]), int(start[r]), int(at[r]))


def find(hits: Hits, bits: int = 5) -> dict[str, np.ndarray]:
    """Breakpoint records of all reads, as one array for each of ``FIELDS``."""
    if not len(hits.n1) or not hits.code.shape[2]:
        return _table([])
    state, rows = _left_sides(hits, bits)
    out, failed = [], np.zeros(len(hits.n1), bool)
    for level in range(LEVELS):
        if not len(rows):
            break
        h = hits.rows(rows)
        right, more, lost = _right_sides(h, state, bits)
        out.append(_records(h, rows, state, right, ~lost))
        failed[rows[lost]] = True
        go = more["go"] & ~lost
        if level == LEVELS - 1:
            failed[rows[go]] = True
        state = {c: x[go] for c, x in more.items() if c != "go"}
        rows = rows[go]
    table = _table([x for part in out for x in part])
    keep = ~failed[table["read"]]
    return {c: x[keep] for c, x in table.items()}


def _left_sides(hits: Hits, bits: int):
    """The side before the first junction of each read that is not explained as a whole, and those reads."""
    r = len(hits.n1)
    zero = np.zeros(r, np.int64)
    t = np.arange(hits.code.shape[2])[None]
    stops, accs = [], []
    for s in (0, 1):
        code = hits.code[s]
        acc = np.bitwise_and.accumulate(np.where(code != 0, code, FULL), 1)
        end = ((code != 0) & (np.bitwise_count(acc) < bits)) | gap_ends(code == 0, hits.n1, zero)
        end &= t < hits.total[:, None]
        stops.append(first(end, hits.total))
        accs.append(np.where(stops[-1] > 0, _take(acc, np.maximum(stops[-1] - 1, 0)), FULL))
    upto = np.maximum(*stops)
    rows = np.flatnonzero(upto < hits.total - 3)
    h, upto = hits.rows(rows), upto[rows]
    diff = np.where(t < upto[:, None], h.score[0] - h.score[1], 0)
    confidence = diff.sum(1)
    strand = (confidence < 0).astype(int)
    sign = 1 - 2 * strand
    pick = lambda pair: np.where(strand == 0, pair[0][rows], pair[1][rows])
    stop, acc = pick(stops), pick(accs)
    code, pos, _ = h.strands(strand)
    known = (code != 0) & (pos >= 0) & (t < stop[:, None])
    li = last(known)
    lpos = np.where(li >= 0, _take(pos, np.maximum(li, 0)), -1)
    anchored = (li >= 0) & ((known & (code == acc[:, None])).sum(1) >= 2)
    fix = np.flatnonzero(anchored & strays(known, pos, h, sign, None))
    _corrected(fix, code, pos, sign, np.zeros(len(rows), int), li, lpos)
    state = {
        "idx": stop,
        "code": np.where(anchored, acc, 0),
        "pos": np.where(anchored, lpos, -1),
        "i": np.where(anchored, li, -1),
        "confi": np.where(anchored, np.where(confidence == 0, 1, confidence), sign),
        "kmers": np.where(anchored, (diff * sign[:, None] > 0).sum(1), 0),
    }
    ok = ~(anchored & (lpos < 0))
    return {c: x[ok] for c, x in state.items()}, rows[ok]


def _right_sides(h: Hits, left: dict, bits: int):
    """The right side of each read's next junction; the side before the one after it; reads whose position is lost."""
    r, width = len(h.n1), h.code.shape[2]
    t, total, n1 = np.arange(width)[None], h.total, h.n1[:, None]
    idx = left["idx"][:, None]
    inside = (t > idx) & (t < total[:, None])
    strand = (left["confi"] <= 0).astype(int)
    code, pos, _ = h.strands(strand)
    diff = h.score[0] - h.score[1]
    # The left side's own segment going on, on its diagonal.
    diagonal = np.abs(np.abs(left["pos"][:, None] - pos) - (t - left["i"][:, None])) < 15
    same = inside & (left["pos"][:, None] >= 0) & (code == left["code"][:, None]) & (pos >= 0) & diagonal
    found = same.any(1)
    # Else the strand that the scores ahead speak for, and its first pair of hits three offsets apart.
    ahead = np.cumsum(np.where(inside, diff, 0), 1)
    until = first(inside & (np.abs(ahead) > 20), total - 1)
    votes = _take(ahead, until)
    strand = np.where(found, strand, (np.where(votes == 0, np.where(left["confi"] >= 0, 1, -1), votes) <= 0).astype(int))
    code, pos, score = h.strands(strand)
    sign = 1 - 2 * strand
    pair = np.zeros_like(same)
    if width > 3:
        pair[:, :-3] = (code[:, 3:] == code[:, :-3]) & (pos[:, 3:] >= 0) & (np.abs(pos[:, 3:] - pos[:, :-3]) == 3)
    pair &= inside & (t < total[:, None] - 3) & (pos >= 0) & ~((t >= n1 - 3) & (t < n1))
    end = first(np.where(found[:, None], same, pair), total)
    anchored = end < total
    at = np.minimum(end, width - 1)
    rcode, rpos = np.where(anchored, _take(code, at), 0), np.where(anchored, _take(pos, at), -1)
    there, absent, e = code != 0, code == 0, end[:, None]
    # Back from the anchor to where its code ends (offset 0 is not looked at).
    acc = np.bitwise_and.accumulate(np.where(there & (t < e), code, FULL)[:, ::-1], 1)[:, ::-1] & rcode[:, None]
    run = np.zeros_like(absent)
    run[:, :-2] = absent[:, :-2] & absent[:, 1:-1] & absent[:, 2:]
    run &= ~((t < n1) & (t + 2 >= n1)) & (t + 2 < e)
    stop = ((there & (np.bitwise_count(acc) < bits)) | run) & (t < e) & (t > 0)
    right_idx = np.where(anchored & stop.any(1), last(stop), end)
    # On from the anchor to where its code ends.
    stop = ((there & (np.bitwise_count(code & rcode[:, None]) < bits)) | gap_ends(absent, h.n1, end)) & (t >= e) & (t < total[:, None])
    after = first(stop, total)
    go = anchored & (after < total)
    span = (t >= e) & (t < after[:, None]) & anchored[:, None]
    known = span & there & (pos >= 0)
    ni = last(known)
    npos = np.where(ni >= 0, _take(pos, np.maximum(ni, 0)), -1)
    here = np.where(span, diff, 0) * sign[:, None]
    confi = np.where(anchored, sign * np.maximum(1, here.sum(1)), np.where(left["confi"] > 0, 1, -1))
    kmers = np.where(anchored, (here > 0).sum(1), 0)
    fix = anchored & strays(known, pos, h, None, right_idx)
    _corrected(np.flatnonzero(fix), code, pos, sign, end, ni, npos)
    rpos = np.where(fix, npos - sign * (ni - end), rpos)
    lost = fix & ((npos < 0) | (rpos < 0))
    right = {"end": end, "idx": right_idx, "code": rcode, "pos": rpos, "confi": confi, "kmers": kmers}
    more = {"go": go, "idx": after, "code": rcode, "pos": npos, "i": ni, "confi": confi, "kmers": kmers}
    return right, more, lost


def _records(h: Hits, rows: np.ndarray, left: dict, right: dict, ok: np.ndarray) -> list[dict]:
    """Records by the emission table, each kind for all reads at once."""
    n1, total = h.n1, h.total
    start, end = left["i"] + 1, right["end"]
    lset, rset = left["pos"] >= 0, right["pos"] >= 0
    same = left["code"] == right["code"]
    apart = np.abs(right["pos"] - left["pos"])
    size = end - start
    border = lset & rset & (start <= n1) & (n1 <= end)
    across = border & (left["kmers"] >= 10) & (right["kmers"] >= 10) & ~(same & (apart < 50))
    pe = across & (start >= n1 - 10) & (end < n1 + 10)
    a, b = left["idx"] < n1, right["idx"] < n1
    in_r1 = (a & b) | ((a | b) & (n1 - start > end - n1))
    kinds = {
        PE: pe,
        RIGHT_VAGUE: across & ~pe & in_r1 & (start < n1 - 10),
        LEFT_VAGUE: across & ~pe & ~in_r1 & (end >= n1 + 10),
        EXACT: lset & rset & ~border & (size >= 15) & ~(same & (size == apart - 1)),
        NO_RIGHT: lset & ~rset & (left["kmers"] >= 15) & ~((start < n1) & (end == total)) & (size > 10),
        NO_LEFT: ~lset & rset & (right["kmers"] >= 15) & ~((start == 0) & (end >= n1)) & (size > 10),
    }
    # Quality of a junction: 6 less the score of each hit on it, on the better strand.
    sums = [np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(np.where(s > 0, 6 - s, 0), 1)], 1) for s in h.score]
    out = []
    for kind, mask in kinds.items():
        k = np.flatnonzero(mask & ok)
        if not len(k):
            continue
        lo = {RIGHT_VAGUE: start, LEFT_VAGUE: n1, PE: 0 * start}.get(kind, start)[k]
        hi = {RIGHT_VAGUE: n1, LEFT_VAGUE: end, PE: 0 * start}.get(kind, end)[k]
        lbp = (left["idx"] - start)[k] if kind not in (PE, LEFT_VAGUE) else 0 * k
        rbp = (end - right["idx"])[k] if kind not in (PE, RIGHT_VAGUE) else 0 * k
        sides = [{c: x[c][k] for c in ("code", "pos", "confi", "kmers")} for x in (left, right)]
        if kind in (NO_RIGHT, NO_LEFT):
            open_ = sides[1 if kind == NO_RIGHT else 0]
            open_.update(pos=np.full(len(k), -1), confi=0 * k, kmers=0 * k)
        score = np.maximum(*(s[k, hi] - s[k, lo] for s in sums))
        flip = np.abs(sides[1]["confi"]) > np.abs(sides[0]["confi"]) if kind in (PE, EXACT) else np.full(len(k), kind in (LEFT_VAGUE, NO_LEFT))
        for secondary in (False, True) if kind == EXACT else (False,):
            turn = flip != secondary
            rec = {"read": rows[k], "kind": np.full(len(k), kind), "vague": np.full(len(k), kind in (LEFT_VAGUE, RIGHT_VAGUE)), "flip": turn, "secondary": np.full(len(k), secondary)}
            for c in ("code", "pos", "confi", "kmers"):
                x, y = sides[0][c], sides[1][c]
                if c == "confi":
                    x, y = np.where(turn, -x, x), np.where(turn, -y, y)
                rec[f"left_{c}"], rec[f"right_{c}"] = np.where(turn, y, x), np.where(turn, x, y)
            rec |= {"left_bp_len": np.where(turn, rbp, lbp), "right_bp_len": np.where(turn, lbp, rbp), "bp_start": lo, "bp_end": hi, "bp_score": score}
            out.append(rec)
    return out


def _table(parts: list[dict]) -> dict[str, np.ndarray]:
    if not parts:
        return {c: np.zeros(0, bool if c in ("vague", "flip", "secondary") else np.int64) for c in FIELDS}
    return {c: np.concatenate([p[c] for p in parts]) for c in FIELDS}


def interpolated(hits: Hits) -> None:
    """Odd offsets of a mate take the hit between those three before and after, where these agree (in place).

    Counted from the mate's own first k-mer; the two first and last offsets stay. R2 runs backwards on R1's axis.
    """
    t = np.arange(hits.code.shape[2])[None]
    n1, total = hits.n1[:, None], hits.total[:, None]
    own = np.where(t < n1, t, total - 1 - t)
    size = np.where(t < n1, n1, total - n1)
    here = (t < total) & (own % 2 == 1) & (own >= 3) & (own <= size - 4)
    for s in (0, 1):
        code, pos, score = hits.code[s], hits.pos[s], hits.score[s]
        at = lambda x, d: np.roll(x, -d, 1)
        a, b = (at(code, -3), at(pos, -3), at(score, -3)), (at(code, 3), at(pos, 3), at(score, 3))
        equal = here & (a[0] == b[0])
        known = equal & (a[1] >= 0) & (b[1] >= 0) & (np.abs(a[1] - b[1]) == 6)
        neither = equal & (a[1] < 0) & (b[1] < 0)
        hits.code[s] = np.where(known | neither, a[0], code)
        hits.pos[s] = np.where(known, (a[1] + b[1]) // 2, np.where(neither, -1, pos))
        hits.score[s] = np.where(known, np.maximum(a[2], b[2]), np.where(neither, (a[0] != 0).astype(score.dtype), score))


class Pairs:
    """Composite hits by pairs of packed k-mers: exact look-ups of whole arrays."""

    def __init__(self, left, right, code, pos):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.left, a = np.unique(left, return_inverse=True)
        self.right, b = np.unique(right, return_inverse=True)
        self.key, at = np.unique(a * max(1, len(self.right)) + b, return_index=True)
        self.code, self.pos = np.asarray(code, np.int64)[at], np.asarray(pos, np.int64)[at]

    def __len__(self) -> int:
        return len(self.key)

    def get(self, left: np.ndarray, right: np.ndarray):
        """Code (0: none) and position (-1: unknown)."""
        if not len(self.key) or not len(left):
            return np.zeros(len(left), np.int64), np.full(len(left), -1)
        a, b = np.searchsorted(self.left, left), np.searchsorted(self.right, right)
        a, b = np.minimum(a, len(self.left) - 1), np.minimum(b, len(self.right) - 1)
        key = a * len(self.right) + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.left[a] == left) & (self.right[b] == right) & (self.key[at] == key)
        return np.where(hit, self.code[at], 0), np.where(hit, self.pos[at], -1)


def _moved(x: np.ndarray, d: int, fill) -> np.ndarray:
    """x at the offset ``d`` further on."""
    out = np.full_like(x, fill)
    if abs(d) < x.shape[1]:
        if d >= 0:
            out[:, : x.shape[1] - d] = x[:, d:]
        else:
            out[:, -d:] = x[:, :d]
    return out


def open_pairs(hits: Hits, strand: int, gap: int) -> np.ndarray:
    """Offsets of ambiguous hits whose partner ``gap`` bases ahead on the strand, in the same mate, is ambiguous too."""
    d = gap if strand == 0 else -gap
    t, n1, total = np.arange(hits.code.shape[2])[None], hits.n1[:, None], hits.total[:, None]
    vague = (hits.code[strand] != 0) & (hits.pos[strand] < 0) & (t < total)
    j = t + d
    return vague & _moved(vague, d, False) & (j >= 0) & (j < total) & ((t < n1) == (j < n1))


def refine(hits: Hits, words: np.ndarray, pairs: Pairs, gap: int, mask: int) -> None:
    """Ambiguous hits whose k-mer pair ``gap`` bases apart is in a composite index get its code, and its position if known.

    A position stays (score 4) in a collinear triple of equal codes three offsets apart, else the hit is ambiguous for
    all codes. Where a hit is only the last of triples, its run goes on for ``gap`` offsets whose pairs end outside it:
    every third ambiguous one there is raised to score 3. On the reverse strand, an offset whose partner got a position
    is not looked up. ``mask``: the bits of a left k-mer that count.
    """
    some = np.flatnonzero((open_pairs(hits, 0, gap) | open_pairs(hits, 1, gap) | (hits.score == 4).any(0)).any(1))
    if len(some) < len(hits.n1):  # nothing is looked up in the others, and no composite index before has changed them
        if len(some):
            part = hits.rows(some)
            refine(part, words[:, some], pairs, gap, mask)
            hits.code[:, some], hits.pos[:, some], hits.score[:, some] = part.code, part.pos, part.score
        return
    t, n1, total = np.arange(hits.code.shape[2])[None], hits.n1[:, None], hits.total[:, None]
    mate = np.where(t >= total, 2, (t >= n1).astype(int))
    start = np.where(t < n1, 0, n1)
    for s in (0, 1):
        code, pos, score = hits.code[s], hits.pos[s], hits.score[s]
        # Forward partners have not been looked up yet; backward ones were, a stretch of ``gap`` offsets before.
        rounds = [np.ones(code.shape, bool)] if s == 0 else [(t - start) // gap == k for k in range(1, code.shape[1] // gap + 1)]
        new = np.zeros(code.shape, bool)
        for part in rounds:
            r, i = np.nonzero(open_pairs(hits, s, gap) & part)
            if not len(r):
                continue
            c, p = pairs.get(words[s][r, i] & mask, words[s][r, i + (gap if s == 0 else -gap)])
            code[r, i] = np.where(c != 0, c, code[r, i])
            hit = (c != 0) & (p >= 0)
            pos[r[hit], i[hit]], score[r[hit], i[hit]] = p[hit], 4
            new[r[hit], i[hit]] = True
        d = 3 if s == 0 else -3
        mid, end = (tuple(_moved(x, k * d, f) for x, f in ((code, 0), (pos, -1), (mate, 3))) for k in (1, 2))
        whole = (pos >= 0) & (mid[1] >= 0) & (end[1] >= 0) & (mate == mid[2]) & (mate == end[2]) & (mate < 2)
        head = whole & (code == mid[0]) & (code == end[0]) & (2 * mid[1] == pos + end[1])
        held, tail = head | _moved(head, -d, False), _moved(head, -2 * d, False)
        own = (score == 4) & (mate < 2) & (_moved(mate, gap if s == 0 else -gap, 3) == mate)
        raised = np.zeros(code.shape, bool)
        for k in range(3, gap, 3):
            raised |= _moved(own & tail & ~held, -k if s == 0 else k, False)
        gone = own & ~held & ~tail
        score[raised & (score == 1)] = 3
        code[gone], pos[gone], score[gone] = FULL, -1, 1
