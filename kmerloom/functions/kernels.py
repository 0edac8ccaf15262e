"""Sequential steps that SQL can't express, as functions of plain Python values: testable without Spark."""

from __future__ import annotations

import re
from bisect import bisect_right

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def revcomp(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def cut_contig(seq: str, first: list[int], last: list[int], k: int, low: int, high: int) -> list[tuple[int, int]]:
    """Segments [start, end) of a contig: cut where two k-mers in a row are no repeats; neighbours overlap by k - 1.

    ``first`` and ``last`` are the sorted runs of offsets with repeated k-mers; runs may touch each other.
    """

    def free(i: int) -> int:
        """The first offset from i on that is no repeat."""
        r = bisect_right(first, i) - 1
        while r >= 0 and first[r] <= i <= last[r]:
            i = last[r] + 1
            r = min(r + 1, len(first) - 1)
        return i

    out: list[tuple[int, int]] = []
    for run in re.finditer("[^N]+", seq):
        start, end = run.span()
        while end - start > high:
            at = start + low + 1
            while at < start + high:
                if (p := free(at - 1)) > at - 1:
                    at = p + 1
                elif (q := free(at)) > at:
                    at = q + 1
                else:
                    break
            size = at - start if at < start + high else high
            out.append((start, min(end, start + size + k - 1)))
            start += size
        out.append((start, end))
    return out


def merge_mates(r1: str, r2: str, k: int) -> tuple[str, str]:
    """R1 and R2 put together where they overlap; R2 is then empty.

    R2's k-mers are looked for in R1, the first one (the fragment ends in R1), then the last and every fifth before it.
    The first that R1 has once decides: it gives the fragment's size, and beyond R1's end R1's last k-mer may differ
    from R2's at that place in one base.
    """
    if len(r1) < k or len(r2) < k:
        return r1, r2
    other = revcomp(r2)
    n = len(other)
    for i in (0, *range(n - k, 0, -5)):
        word = other[n - k - i : n - i]
        p = r1.find(word)
        if p < 0 or r1.find(word, p + 1) >= 0:
            continue
        tail = p + k + i - len(r1)
        if tail <= 0:
            return r1[: p + k + i], ""
        if sum(x != y for x, y in zip(r1[len(r1) - k :], other[n - k - tail : n - tail])) <= 1:
            return r1 + other[n - tail :], ""
        return r1, r2
    return r1, r2


def covered(words: list[str], known, k: int) -> int:
    """Bases of a sequence that maximal runs of known k-mers cover."""
    total = run = 0
    for w in [*words, None]:
        if w is not None and w in known:
            run += 1
        elif run:
            total += run + k - 1
            run = 0
    return total


def kmer_list(seq: str, k: int) -> list[str]:
    return [seq[i : i + k] for i in range(len(seq) - k + 1)]


def kmer_set(seq: str, k: int) -> set[str]:
    return set(kmer_list(seq, k))


def sequence_distance(this: str, other: str, k: int = 11) -> float:
    """Share of ``other`` that no run of k-mers of ``this`` covers; length beyond ``this`` counts as not covered apart."""
    if len(other) < k:
        return 1.0
    both = covered(kmer_list(other, k), kmer_set(this, k), k)
    excess = max(0, len(other) - len(this))
    return 1 - both / max(1, len(other) - excess)


def reference_distance(seq: str, reference: str, k: int = 11) -> float:
    """The same against the reference that goes on past the junction, over the part of it that there is."""
    words = kmer_list(seq, k)[: max(0, len(reference) + 5)]
    if not words:
        return 1.0
    return 1 - covered(words, kmer_set(reference, k), k) / (len(words) + k - 1)


def junction(r1: str, r2: str, k: int, start: int, end: int, turn: bool) -> str:
    """Bases from the first one past the anchor to the end of the mate; turned: the same from the other side."""
    n1 = max(0, len(r1) - k + 1)
    total = n1 + max(0, len(r2) - k + 1)
    if start < n1:
        return revcomp(r1[: end + k - 1]) if turn else r1[start:]
    # Offsets of R2 run backwards on its own strand, as it is read on R1's axis.
    other = revcomp(r2)
    a, b = start - n1, end - n1
    return revcomp(other[: b + k - 1]) if turn else other[a:] if total else ""
