"""License scans by patience alignment.

A text is searched in regions sized to a template. In a region, words that occur once in the region and once in the
template are anchors; their longest increasing subsequence is kept, and the gaps between its members are aligned in the
same way, after equal words at both ends of a gap are taken. The share of the template's words that are aligned is its
coverage, the share of the text's words from the first to the last aligned one its density. ``MIN_COVERAGE`` or more of
both is a hit if the phrases that tell the licence from its like (name, version, conditions) are aligned word by word.
Of hits that overlap, the one with more aligned words stays.

Regions come from a lossless filter. A hit holds its phrases: each occurrence in a text of the longest word of the first
one proposes the region in which it would be that word of the template. Without phrases, a hit still misses fewer than
``1 - MIN_COVERAGE`` of the template's words, so it holds one word of any set of positions larger than that; the rarest
words (the longest) propose.

Cases: null or empty text has no licence, coverage 0. Repeated rows are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .license_texts import PHRASES, TEMPLATES
from .tables import map_batches

MIN_COVERAGE = 0.8
_WORDS = re.compile(r"[^\W_]+")


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once_a, once_b = _once(a, i0, i1), _once(b, j0, j1)
        anchors = sorted((once_a[w], j) for w, j in once_b.items() if w in once_a)
        chain = _increasing(anchors)
        if not chain:
            continue
        out += chain
        ends = [(i0 - 1, j0 - 1), *chain, (i1, j1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
    return sorted(out)


def _once(x: list[str], lo: int, hi: int) -> dict[str, int]:
    at: dict[str, int] = {}
    for k in range(lo, hi):
        at[x[k]] = -1 if x[k] in at else k
    return {w: k for w, k in at.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second members."""
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            tops.append(n)
        else:
            tails[k], tops[k] = j, n
        back[n] = tops[k - 1] if k else -1
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def proposers(words: list[str], least: float) -> dict[str, list[int]]:
    """Positions of the rarest words, more of them than a hit may miss."""
    most = int((1 - least) * len(words) + 1e-9) + 1
    out: dict[str, list[int]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(map(len, out.values())) >= most:
            break
        out[w] = [k for k, x in enumerate(words) if x == w]
    return out


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


class Made:
    """The words of each template, the places of its phrases in it, and the words that propose its regions."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, list[str]], least: float):
        self.words = {n: w for n, w in ((n, words_of(t)) for n, t in templates.items()) if w}
        self.phrases: dict[str, list[list[range]]] = {}
        self.by_word: dict[str, list[tuple[str, int]]] = {}
        for n, w in self.words.items():
            self.phrases[n] = [places(w, words_of(p)) for p in phrases.get(n, ())]
            if not all(self.phrases[n]):
                raise ValueError(f"a phrase of {n} is not in its text")
            if self.phrases[n]:
                ranges = self.phrases[n][0]
                k = max(range(len(ranges[0])), key=lambda k: len(w[ranges[0][k]]))
                proposed = {w[ranges[0][k]]: [r[k] for r in ranges]}
            else:
                proposed = proposers(w, least)
            for x, at in proposed.items():
                self.by_word.setdefault(x, []).extend((n, k) for k in at)


def places(words: list[str], phrase: list[str]) -> list[range]:
    return [range(k, k + len(phrase)) for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def accepted(pairs: list[tuple[int, int]], template: list[str], phrases: list[list[range]], least: float) -> float:
    """The coverage of an alignment that is a hit, else 0."""
    cover = len(pairs) / len(template)
    if not pairs or cover < least or len(pairs) < least * (pairs[-1][0] - pairs[0][0] + 1):
        return 0.0
    at = {j: i for i, j in pairs}
    whole = lambda r: all(j in at and at[j] - at[r[0]] == j - r[0] for j in r if r[0] in at) and r[0] in at
    return cover if all(any(whole(r) for r in ranges) for ranges in phrases) else 0.0


def scan(text: str, made: Made, least: float) -> list[tuple[str, float, int, int]]:
    """Hits (name, coverage, start, end) of a text, by start; ends exclusive, in code points."""
    spans = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    words = [text[s:e].lower() for s, e in spans]
    regions = set()
    for p, w in enumerate(words):
        for name, k in made.by_word.get(w, ()):
            n = len(made.words[name])
            pad = n // 5 + 1
            regions.add((name, max(0, p - k - pad), min(len(words), p - k + n + pad)))
    hits = []
    seen: dict[str, int] = {}
    for name, lo, hi in sorted(regions):
        lo = max(lo, seen.get(name, 0))  # past a full hit of the same template
        if hi - lo < least * len(made.words[name]):
            continue
        pairs = trimmed(patience(words[lo:hi], made.words[name]), least)
        cover = accepted(pairs, made.words[name], made.phrases[name], least)
        if cover:
            first, last = lo + pairs[0][0], lo + pairs[-1][0]
            hits.append((len(pairs), name, cover, spans[first][0], spans[last][1]))
            if cover == 1:
                seen[name] = last + 1
    out: list[tuple[str, float, int, int]] = []
    for _, name, cover, s, e in sorted(hits, key=lambda h: (-h[0], -h[2], h[1], h[3])):
        if all(e <= x[2] or s >= x[3] for x in out):
            out.append((name, cover, s, e))
    return sorted(out, key=lambda x: (x[2], x[0]))


def trimmed(pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """An alignment without strays: while too few words between its ends are aligned, the end behind the wider gap goes."""
    pairs = list(pairs)
    while len(pairs) > 2 and len(pairs) < least * (pairs[-1][0] - pairs[0][0] + 1):
        head, tail = pairs[1][0] - pairs[0][0], pairs[-1][0] - pairs[-2][0]
        pairs.pop(0 if head >= tail else -1)
    return pairs


def _work(templates: dict[str, str], phrases: dict[str, list[str]], least: float):
    made = Made(templates, phrases, least)
    any_word = "|".join(sorted(map(re.escape, made.by_word), key=lambda w: (-len(w), w)))

    def work(batches):
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            text = pc.fill_null(b.column("text"), "")
            maybe = pc.match_substring_regex(text, any_word, ignore_case=True).to_numpy(zero_copy_only=False) if made.by_word else [False] * b.num_rows
            found = [scan(text[k].as_py(), made, least) if maybe[k] else [] for k in range(b.num_rows)]
            hits = pa.array([[{"license": x[0], "coverage": x[1], "start": x[2], "end": x[3]} for x in f] for f in found], kind)
            best = [max(f, key=lambda x: (x[1], -x[2])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([x and x[0] for x in best], pa.string()), pa.array([x[1] if x else 0.0 for x in best], pa.float64()), pa.array([len(f) for f in found], pa.int32()), hits], names=["doc_id", "license", "coverage", "n_hits", "hits"])

    return work


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = MIN_COVERAGE, phrases: dict[str, list[str]] = PHRASES) -> DataFrame:
    """(doc_id, license, coverage, n_hits, hits array<struct>) for each row of ``docs(doc_id, text)``; license: of the best hit."""
    return map_batches(docs.select("doc_id", "text"), _work(templates, phrases, least), "doc_id long, license string, coverage double, n_hits int, hits array<struct<license:string,coverage:double,start:long,end:long>>")
