"""Benchmark decontamination by the CGK embedding with repeated bit-sampling LSH and exact edit verification.

Texts are sequences of symbols: letters and digits (A-Z lowered), every other run of bytes one space. The CGK random
walk reads them from a window's start: at step j it puts out the symbol under its pointer and moves on if the j-th
random bit of that symbol is set, so that a small edit distance becomes a small Hamming distance of the outputs. In each
of ``REPEATS`` repetitions, with a walk of its own, the symbols put out at a few random steps are a window's key, thrice
(``KEYS``) with other steps. Windows take ``STEPS`` steps, those of shorter items fewer (``sizes``), so the number of edits in one does not grow with the
item, and a long item has many of them. Items have a window at every word, texts at every word or every second one.

Windows with an item's key propose where the item would stand; an item of ``TWICE`` symbols or more needs two keys that
propose about the same place, as a stretch of four words in common gives one. Places are verified exactly: the least edit distance (in
symbols, by Myers' bit-parallel method) of the whole item to any substring of the text around the place must be at most
``RATIO`` of the item's length. Recall by kind and share of edits is measured in the tests. An item of fewer than
8 symbols has no window: it is found where it stands exactly, as whole words.

The items come in blocks of about ``BLOCK_CHARS`` characters, each of which is collected, shipped and taken through the
texts in a pass of its own, so memory does not grow with the benchmark.

Cases: null or empty texts hold nothing. Null or wordless items are never found. Repeated items are found each. Extra
columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import cut, map_batches, release

REPEATS = 6
KEYS = 3
STEPS = 40
STRIDE = 2
TWICE = 80
RATIO = 0.15
BLOCK_CHARS = 1_000_000
STOP = 31
_SYMBOL = np.full(256, 255, np.uint8)  # five bits; 255 is a separator
_SYMBOL[48:58] = 27 + np.arange(10) % 4
_SYMBOL[65:91] = _SYMBOL[97:123] = 1 + np.arange(26)
_SYMBOL[128:] = 1 + np.arange(128) % 30
_LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_NOT_WORD = bytes(x for x in range(128) if _SYMBOL[x] == 255)
_SPACES = bytes(32 if x in _NOT_WORD else y for x, y in enumerate(_LETTERS))


def sizes() -> list[tuple[int, int, int]]:
    """For items of at least so many symbols, the steps of a window and the words between two in a text."""
    return [(8, 8, 1), (20, 14, 1), (32, 24, 1), (TWICE, STEPS, STRIDE)]


def sampled(rep: int, steps: int) -> list[list[int]]:
    """For each key of a walk, the steps whose output makes it: fewer in shorter windows."""
    rng = np.random.default_rng([rep, steps])
    return [sorted(rng.choice(steps, size=min(12, 4 + steps // 5), replace=False).tolist()) for _ in range(KEYS)]


def moves(rep: int, steps: int) -> list[int]:
    """For each step, the random bits of all symbols as one number; the walk never leaves a text."""
    bits = np.random.default_rng([77, rep, steps]).integers(0, 1 << STOP, steps)
    return [int(x) for x in bits]


def walk_keys(symbols: np.ndarray, starts: np.ndarray, rep: int, steps: int) -> list[np.ndarray]:
    """The keys of the window at each start, five bits a sampled symbol; ``symbols`` are 64-bit."""
    at, here, move = starts.astype(np.int64), np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    keys = [np.zeros(len(starts), np.int64) for _ in range(KEYS)]
    want, bits = sampled(rep, steps), moves(rep, steps)
    for j in range(max(map(max, want)) + 1):
        symbols.take(at, out=here, mode="clip")
        for key, chosen in zip(keys, want):
            if j in chosen:
                key <<= 5
                key |= here
        np.right_shift(bits[j], here, out=move)
        move &= 1
        at += move
    return keys


def edit_distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any substring of the text (Myers)."""
    m = len(pattern)
    if m == 0:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if d < best:
            best = d
            if best == 0:
                break
    return best


class Symbols:
    """The symbols of a few texts, one stop after each; where words begin; the first symbol of each text."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        code = _SYMBOL[raw]
        gap = code == 255
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        # A separator stays if a word comes before it and one after it in its text: as one space.
        last = gap.copy()
        last[1:] &= ~gap[:-1] | edge[1:-1]
        last &= ~edge[:-1]
        keep = np.flatnonzero(~gap | last)
        self.bytes_at = keep
        code = code[keep]
        code[code == 255] = 0
        first = np.searchsorted(keep, off)
        self.symbols = np.insert(code, first[1:], STOP).astype(np.int64)
        self.first = first + np.arange(len(off))
        space = self.symbols == 0
        begin = np.zeros(len(self.symbols), bool)
        begin[1:] = ~space[1:] & (space[:-1] | (self.symbols[:-1] == STOP))
        begin[:1] = ~space[:1]
        self.words = np.flatnonzero(begin & (self.symbols != STOP))
        self.first_word = np.searchsorted(self.words, self.first)

    def size(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i] - 1)


def normal(text: str) -> str:
    """The words of a text with single spaces between them, as one character a byte."""
    return b" ".join(text.encode("utf-8", "replace").translate(_SPACES).split()).decode("latin-1")


def index(items: list[tuple[int, str]]) -> dict:
    """Keys of the items' windows: for each size and repetition, sorted keys with item and place."""
    texts = [normal(t) for _, t in items]
    raw, off = K.text_bytes(pa.array([t for _, t in items], pa.string()))
    s = Symbols(raw, off)
    length = np.array([len(t) for t in texts], np.int64)
    of = np.searchsorted(s.first, s.words, "right") - 1
    tables = {}
    bounds = [least for least, _, _ in sizes()]
    for (least, steps, _), above in zip(sizes(), [*bounds[1:], 1 << 40]):
        here = (length[of] >= least) & (length[of] < above)
        # A window that reaches the item's end has no like in a text that goes on; a walk moves at every second step.
        room = here & ((4 * (s.first[of + 1] - 1 - s.words) >= 3 * steps) | (s.words == s.first[of]))
        which, place = of[room], (s.words - s.first[of])[room]
        for rep in range(REPEATS) if room.any() else ():
            for n, keys in enumerate(walk_keys(s.symbols, s.words[room], rep, steps)):
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[_slot(keys)] = True
                tables[steps, rep, n] = (keys[order], which[order], place[order], seen)
    tiny = [k for k, t in enumerate(texts) if 0 < len(t) < bounds[0]]
    return {"ids": [i for i, _ in items], "texts": texts, "length": length, "grams": [grams(s.symbols[s.first[k] : s.first[k + 1] - 1]) for k in range(len(texts))], "tables": tables, "sizes": [x for x in sizes() if any(w == x[1] for w, _, _ in tables)], "tiny": tiny}


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(K.U) * K.U(K.BASE)) >> K.U(44)).astype(np.int64)


def places(made: dict, s: Symbols, ratio: float) -> np.ndarray:
    """Columns (text, item, place): where windows with an item's key say that the item begins."""
    hits = []
    doc = np.searchsorted(s.first, s.words, "right") - 1
    word = np.arange(len(s.words)) - s.first_word[doc] if len(doc) else doc
    for _, steps, stride in made["sizes"]:
        chosen = word % stride == 0
        at, of = s.words[chosen], doc[chosen]
        for rep in range(REPEATS):
            for n, got in enumerate(walk_keys(s.symbols, at, rep, steps)):
                keys, which, place, seen = made["tables"][steps, rep, n]
                maybe = np.flatnonzero(seen.take(_slot(got)))
                left, right = np.searchsorted(keys, got[maybe], "left"), np.searchsorted(keys, got[maybe], "right")
                size = right - left
                pos = np.repeat(maybe, size)
                k = np.repeat(left, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                hits.append(np.stack([of[pos], which[k], at[pos] - s.first[of[pos]] - place[k]]))
    if not hits:
        return np.zeros((3, 0), np.int64)
    h = np.concatenate(hits, 1)
    h = h[:, np.lexsort(h[::-1])]
    length = made["length"][h[1]]
    near = np.zeros(h.shape[1], bool)
    near[1:] = (h[0, 1:] == h[0, :-1]) & (h[1, 1:] == h[1, :-1]) & (h[2, 1:] - h[2, :-1] <= 2 * ratio * length[1:] + 8)
    good = near | (length < TWICE)
    good[:-1] |= near[1:]
    return np.unique(h[:, good], axis=1)


def grams(symbols: np.ndarray) -> np.ndarray:
    """A 16-bit hash of every four symbols in a row."""
    x = (symbols[:-3] << 15) | (symbols[1:-2] << 10) | (symbols[2:-1] << 5) | symbols[3:]
    return (x ^ (x >> 11)) & 0xFFFF


def _verified(made: dict, ratio: float, text: str, symbols: np.ndarray, found: list[tuple[int, int]], memo: dict) -> dict[int, int]:
    """The least distance of each item to a text (normalised) near the places proposed, where it is within the ratio.

    An edit spoils four of an item's stretches of four symbols, so a region that lacks more of them is not measured.
    """
    out: dict[int, int] = {}
    done: dict[int, int] = {}
    for item, at in found:
        pattern = made["texts"][item]
        most = int(ratio * len(pattern))
        # Places that differ by no more than the edits allowed are in one region.
        if out.get(item) == 0 or at < done.get(item, -(1 << 60)):
            continue
        lo, hi = max(0, at - most - 1), max(0, at) + len(pattern) + 3 * most + 2
        done[item] = at + most + 1
        region = text[lo:hi]
        got = memo.get((item, region))
        if got is None:
            if len(memo) > 20_000:
                memo.clear()
            if pattern in region:
                got = 0
            else:
                here = np.zeros(1 << 16, bool)
                here[grams(symbols[lo:hi])] = True
                need = len(made["grams"][item]) - 4 * most
                got = edit_distance(pattern, region) if np.count_nonzero(here[made["grams"][item]]) >= need else most + 1
            memo[item, region] = got
        if got <= most and got < out.get(item, most + 1):
            out[item] = got
    return out


def _find(made: dict, ratio: float):
    """Items and distances of each row of a batch."""
    memo: dict = {}

    def find(text) -> list[dict[int, int]]:
        raw_all, off_all = K.text_bytes(text)
        out: list[dict[int, int]] = []
        for i, j in K.portions(off_all, 1 << 18):
            raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            found: list[dict[int, int]] = [{} for _ in range(i, j)]
            s = Symbols(raw, off)
            got = places(made, s, ratio).T.tolist()
            by_text: dict[int, list] = {}
            for d, item, at in got:
                by_text.setdefault(d, []).append((item, at))
            for d in range(j - i) if made["tiny"] else by_text:
                text = b" ".join(raw[off[d] : off[d + 1]].tobytes().translate(_SPACES).split()).decode("latin-1")
                found[d] = _verified(made, ratio, text, s.symbols[s.first[d] : s.first[d + 1] - 1], by_text.get(d, []), memo)
                for k in made["tiny"]:
                    if f" {made['texts'][k]} " in f" {text} ":
                        found[d][k] = 0
            out += found
        return out

    return find


def _blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    k = -(-total // BLOCK_CHARS)
    for i in range(k):
        rows = sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(k)) == i).collect())
        if rows:
            yield rows


def _marked(rows: list[tuple[int, str]], ratio: float):
    """Adds a block's items to ``items`` and ``distances``."""

    def work(batches):
        made = index(rows)
        find = _find(made, ratio)
        for b in batches:
            items, distances = (b.column(c).to_pylist() for c in ("items", "distances"))
            for r, got in enumerate(find(b.column("text"))):
                both = sorted([*zip(items[r], distances[r]), *((made["ids"][k], d) for k, d in got.items())])
                items[r], distances[r] = [x for x, _ in both], [d for _, d in both]
            for c, x in (("items", items), ("distances", distances)):
                b = b.set_column(b.schema.get_field_index(c), c, pa.array(x, pa.list_(pa.int64())))
            yield b

    return work


def _clean(rows: list[tuple[int, str]], ratio: float):
    def work(batches):
        find = _find(index(rows), ratio)
        for b in batches:
            yield b.filter(pa.array([not x for x in find(b.column("text"))], pa.bool_()))

    return work


def _each_block(docs: DataFrame, benchmark: DataFrame, work) -> DataFrame:
    """One pass over the rows for each block; between two passes the rows are written, so that only one block is held."""
    before = None
    for rows in _blocks(benchmark):
        if before is not None:
            written = cut(docs)
            release(before)
            docs = written
        before = docs
        docs = map_batches(docs, work(rows), docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, items array<long>, distances array<long>, contaminated) for each row of ``docs(doc_id, text)``, by item."""
    none = F.expr("cast(array() as array<long>)")
    out = _each_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("items"), none.alias("distances")), benchmark, lambda rows: _marked(rows, ratio))
    return out.drop("text").withColumn("contaminated", F.size("items") > 0)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    return _each_block(docs, benchmark, lambda rows: _clean(rows, ratio))
