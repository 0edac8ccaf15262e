"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

A line is a piece between line feeds, lower-cased, with runs of white space as one space and none at its ends; blank
lines are never dropped. Equal lines are found by a 128-bit hash. Every distinct line gets a MinHash signature over its
character shingles, cut into bands; lines with an equal band are candidates (recall at the threshold: see
``recall``). A changed letter inside a line spoils SHINGLE shingles, so it leaves lines of 9 * SHINGLE shingles (49
characters) similar; the tests hold the recall of edits by line length. Candidates whose sizes or bitmaps rule the
threshold out are no link (the n-gram join's screen: every pair of a bucket that they allow is in one family), or lines
that meet by chance would chain into one family. Families are verified by exact Jaccard and united; of each component, the first line by
(doc_id, line number) is kept and all the others are dropped.

Cases: null or empty text has no lines. A line shorter than a shingle is one shingle. Rows that share a doc_id share a
decision (a line of theirs is its own copy only where it stands at another line number). Rows with a null doc_id
keep all their lines. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .families import FAMILY_TOKENS, bitmaps, family_links
from .ngram_join import _screened_families
from .tables import components, cut, dealt, grouped, map_batches, release, thin

SHINGLE = 5
BANDS = 22
ROWS = 7
PCT = 80
SEEN = 200_000
TABLE = 1 << 17
#: Characters whose shingles are hashed at a time, and whose signatures are made together.
CHARS = 1 << 18
PORTION = 1 << 21
#: Band keys are dealt by their upper bits, KEY bytes of the rest are kept, and so many are held before they are packed.
SLOT_BITS = 12
KEY = 6
HELD = 1 << 20
#: Signatures are made of so many bytes of lines at a time, as few lines of one length make small tables.
HELD_CHARS = 1 << 23
#: Where a line stands; n_lines is 0 but at the first line of a row. So many go into one blob.
PLACE = np.dtype([("doc_id", "<i8"), ("line_no", "<i4"), ("n_lines", "<i4"), ("h", "<i8", 2)])
PLACES = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of white space other than line feed and space, and those that begin letters beyond U+00FF or below U+00C0.
_ODD = np.zeros(256, bool)
_ODD[[0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two lines of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def codes_of(lines: list[str], w: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lines, one after the other, and where each line's begin. Short lines are filled up to w."""
    text = "".join([x if len(x) >= w else x + "\0" * (w - len(x)) for x in lines])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([max(len(x), w) for x in lines])
    begin = np.cumsum(size) - size
    h = K.char_hashes(codes, w)
    inside = np.ones(len(codes), bool)
    for k in range(1, w):
        inside[begin + size - k] = False
    return h[inside[: len(h)]], np.cumsum(size - w + 1) - (size - w + 1)


def signatures(lines: list[str], w: int, bands: int, rows: int) -> np.ndarray:
    """Band keys, one row of ``bands`` 64-bit keys for each line.

    Lines of about one length are taken together as a table of their shingles (the shorter ones repeat a shingle, which
    changes no minimum): many lines as its columns, a few long ones as its rows, whichever the minimum runs along faster.
    """
    out = np.empty((len(lines), bands), K.U)
    if not lines:
        return out.view(np.int64)
    hashes, sizes = [], []
    for i, j in K.portions(np.cumsum([0, *map(len, lines)]), CHARS):
        x, begin = codes_of(lines[i:j], w)
        hashes.append((x >> K.U(32)).astype(np.uint32))
        sizes.append(np.diff(np.r_[begin, len(x)]))
    h, size = np.concatenate(hashes), np.concatenate(sizes)
    begin = np.cumsum(size) - size
    seeds = ((K.mix(np.arange(bands * rows, dtype=K.U), 11) >> K.U(32)) | K.U(1)).tolist()
    # Odd seeds have inverses, so each table is made of the one before in its place.
    factors = [np.uint32(s * pow(t, -1, 1 << 32) % (1 << 32)) for s, t in zip(seeds, [1, *seeds])]
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        most = int(size[order[at]]) * 9 // 8 + 2
        end = min(int(np.searchsorted(size[order], most, "right")), at + max(16, TABLE // most))
        part = order[at:end]
        at = end
        n = size[part]
        step = np.arange(int(n[-1]))[:, None]
        table = h[begin[part][None] + np.where(step < n[None], step, 0)]
        axis = int(len(part) < 64)
        table = np.ascontiguousarray(table.T) if axis else table
        least = np.empty((bands * rows, len(part)), np.uint32)
        for r, factor in enumerate(factors):
            np.multiply(table, factor, out=table)
            np.minimum.reduce(table, axis=axis, out=least[r])
        key = np.broadcast_to(np.arange(bands, dtype=K.U)[:, None], (bands, len(part))).copy()
        for r in range(rows):
            key = K.mix(key ^ least[r::rows], r + 1)
        out[part] = key.T
    return out.view(np.int64)


def lowered(raw: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts' bytes in lower case, and which texts this is not known for: they are to be made by :func:`normal`.

    Known are those of ASCII and of the letters U+00C0 to U+00FF in which single spaces and line feeds are all that is
    white, but for spaces at the ends of lines.
    """
    low = _LOWER[raw]
    lead = np.r_[False, raw[:-1] == 0xC3][: len(raw)]
    low[lead & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    odd = _ODD[raw] | (lead != ((raw & 0xC0) == 0x80))
    blank = raw == 0x20
    odd[1:] |= blank[1:] & blank[:-1]
    unknown, some = np.zeros(len(off) - 1, bool), off[1:] > off[:-1]
    if not len(raw):
        return b"", unknown
    unknown[some] = np.logical_or.reduceat(odd, off[:-1][some])
    unknown[some] |= (raw[off[1:][some] - 1] == 0xC3) | ((raw[off[:-1][some]] & 0xC0) == 0x80)  # letters cut off by a text's ends
    return low.tobytes(), unknown


def _lines(raw: np.ndarray, off: np.ndarray):
    """(row, line number, bytes of the normal line) of each line that is not blank."""
    low, unknown = lowered(raw, off)
    for r, (s, e, odd) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), unknown.tolist())):
        if odd:
            for k, line in enumerate(raw[s:e].tobytes().decode("utf-8", "replace").lower().split("\n")):
                if line := " ".join(line.split()):  # as normal(): no letter's small form depends on another line
                    yield r, k, line.encode("utf-8", "surrogatepass")
        else:
            for k, line in enumerate(low[s:e].split(b"\n")):
                if line := line.strip(b" "):
                    yield r, k, line


def pack(key: np.ndarray, h: np.ndarray):
    """Band keys with their lines' hashes as (slot, blob): KEY bytes of the key and eight of the hash for each.

    The slot is the key's upper bits, so that equal keys have equal slots; so many keys as a task holds make few rows.
    """
    key = key.view(K.U)
    slot = (key >> K.U(64 - SLOT_BITS)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")  # of 16 bits: a radix sort
    key, h, slot = key[order], h[order], slot[order].astype(np.int32)
    raw = np.empty((len(key), KEY + 8), np.uint8)
    raw[:, :KEY] = key[:, None].view(np.uint8)[:, :KEY]
    raw[:, KEY:] = h[:, None].view(np.uint8)
    begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    ends = np.r_[begin, len(key)].astype(np.int32) * (KEY + 8)
    blobs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(slot[begin]), blobs], names=["slot", "blob"])


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (those of one slot differ where the whole ones do) and hashes."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY + 8)
    key = np.zeros((len(raw), 8), np.uint8)
    key[:, :KEY] = raw[:, :KEY]
    return key.view(K.U)[:, 0], np.ascontiguousarray(raw[:, KEY:]).view(np.int64)[:, 0]


def _packed(w: int, bands: int, rows: int):
    """(slot, blob) of one reading of the texts: the band keys of the lines that this task sees first, and where all lines stand.

    Places have slots beyond those of keys, one for each blob by its first line, so that a common line's places are dealt out.
    """

    def work(batches):
        seen: set[bytes] = set()
        fresh, of, held = [], [], 0

        def keys():
            made = signatures([x.decode("utf-8", "surrogatepass") for x in fresh], w, bands, rows)
            return pack(made.ravel(), np.repeat(np.frombuffer(b"".join(of), np.int64)[::2], bands))

        for b in batches:
            raw, off = K.text_bytes(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in K.portions(off, PORTION):
                doc, no, digest = [], [], []
                for r, k, line in _lines(raw[off[i] : off[j]], off[i : j + 1] - off[i]):
                    d = hashlib.blake2b(line, digest_size=16).digest()
                    doc.append(r)
                    no.append(k)
                    digest.append(d)
                    if d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        fresh.append(line)
                        of.append(d)
                        held += len(line)
                        if held >= HELD_CHARS or len(fresh) * bands >= HELD:
                            yield keys()
                            fresh, of, held = [], [], 0
                if not doc:
                    continue
                at, n = np.array(doc), np.bincount(doc, minlength=j - i)
                here = np.empty(len(at), PLACE)
                here["doc_id"], here["line_no"] = ids[i:j][at], no
                here["n_lines"] = np.where(np.r_[True, at[1:] != at[:-1]], n[at], 0)
                here["h"] = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                parts = [here[k : k + PLACES] for k in range(0, len(here), PLACES)]
                slots = [(1 << SLOT_BITS) + int(x["h"][0, 0] & 0xFFFF) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slot", "blob"])
        if fresh:
            yield keys()

    return work


def _unpacked(t, bounds):
    """Rows of two kinds, FOUND: of key and h, the distinct lines of each bucket that has several, by their hashes; of the others, where lines stand."""
    slots, blobs = t.column("slot").to_numpy(), t.column("blob")
    kinds = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("n_lines", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def rows(n, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in kinds], schema=kinds)

    for s, e in zip(bounds[:-1], bounds[1:]):
        if slots[s] >> SLOT_BITS:
            x = np.frombuffer(b"".join(blobs.slice(s, e - s).to_pylist()), PLACE)
            yield rows(len(x), **{c: np.ascontiguousarray(x[c]) for c in ("doc_id", "line_no", "n_lines")}, h1=np.ascontiguousarray(x["h"][:, 0]), h2=np.ascontiguousarray(x["h"][:, 1]))
            continue
        key, h = unpack(blobs.slice(s, e - s).to_pylist())
        order = np.argsort(key)
        key, h = key[order], h[order]
        often = _often(key)
        key, h = key[often], h[often]
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])][: len(key)]
        key, h = key[new], h[new]
        often = _often(key)
        if often.any():
            key = key[often] | K.U(int(slots[s]) << 8 * KEY)
            yield rows(len(key), key=key.view(np.int64), h=h[often])


def _often(key: np.ndarray) -> np.ndarray:
    """Which of the sorted keys occur several times."""
    same = key[1:] == key[:-1]
    return (np.r_[False, same] | np.r_[same, False])[: len(key)]


FOUND = "key long, h long, doc_id long, line_no int, n_lines int, h1 long, h2 long"


def found(docs: DataFrame, w: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """FOUND: buckets and places, by one pass over the texts; see ``_unpacked``."""
    # Packed, the keys of a slot take 14 bytes a line and band in the exchange instead of the 19 of a row for each.
    return grouped(map_batches(docs, _packed(w, bands, rows), "slot int, blob binary"), ["slot"], _unpacked, FOUND)


def _met(both: DataFrame) -> DataFrame:
    return both.where("key is not null").select("key", F.col("h").alias("doc_id"))


def buckets(docs: DataFrame, w: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, doc_id): the hashes of the lines that share a band key with another line."""
    return _met(found(docs.where("doc_id is not null"), w, bands, rows))


def stars(docs: DataFrame, w: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b): each line of a bucket with the bucket's smallest hash."""
    met = buckets(docs, w, bands, rows)
    return met.join(met.groupBy("key").agg(F.min("doc_id").alias("a")), "key").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()


HELD_LINES = "doc_id long, n_shingles long, bits array<long>, tokens binary"


def _texts(w: int):
    """The wanted lines: the size of each one's set, its bitmap, and as tokens the line's bytes."""
    decode = _decode(w)

    def work(batches):
        for b in batches:
            ids, lines = [], []
            for text, wanted in zip(b.column("text"), b.column("wanted")):
                there = (text.as_py() or "").split("\n")
                for x in wanted.as_py():
                    if x["line_no"] < len(there) and (line := normal(there[x["line_no"]])):
                        raw = line.encode("utf-8", "surrogatepass")
                        if int.from_bytes(hashlib.blake2b(raw, digest_size=16).digest()[:8], "little", signed=True) == x["h1"]:
                            ids.append(x["h1"])
                            lines.append(raw)
            for i, j in K.portions(np.cumsum([0, *map(len, lines)]), CHARS):
                sets = decode(lines[i:j])
                bits = [x.view(np.int64) for x in bitmaps(sets)]
                ends = pa.array(np.cumsum([0, *map(len, bits)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits))), pa.array(lines[i:j], pa.binary())], names=["doc_id", "n_shingles", "bits", "tokens"])

    return work


def _decode(w: int):
    def decode(members: list[bytes]) -> list[np.ndarray]:
        h, begin = codes_of([x.decode("utf-8", "surrogatepass") for x in members], w)
        for x in np.split(h, begin[1:]):
            x.sort()
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        new[begin] = True
        return np.split(h[new], np.cumsum(new)[begin[1:]] - 1)

    return decode


def line_dedup(docs: DataFrame, w: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, pct: int = PCT) -> DataFrame:
    """Decisions for each doc_id of ``docs(doc_id, text)`` with a line: (doc_id, n_lines, n_near, dropped array<int>).

    ``n_lines`` counts lines that are not blank, ``dropped`` has the numbers (from 0) of the lines that go, ``n_near``
    says how many of them have no equal line that comes before them and go for a similar one.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    # The texts are read once; band keys go straight into the exchange, as they would be as large again written out.
    both = cut(found(docs, w, bands, rows))
    met, where = _met(both), both.where("line_no is not null")
    here = where.select("doc_id", "line_no", "h1", "h2")
    lines = cut(where.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("rows")))
    near = lines.join(met.select(F.col("doc_id").alias("h1")).distinct(), "h1")
    wanted = cut(near.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line_no", "h1")).alias("wanted")))
    texts = thin(docs, wanted, "doc_id").join(wanted, "doc_id").select("text", "wanted")
    held = cut(map_batches(texts, _texts(w), HELD_LINES))
    # Lines that meet by chance would chain into families that grow faster than the input: unlike ones are screened first.
    family = _screened_families(met, held, pct).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    members = dealt(family.join(held.select("doc_id", "n_shingles").distinct(), "doc_id"), ["family"], "doc_id", "n_shingles", FAMILY_TOKENS)
    members = members.join(held.select("doc_id", "tokens"), "doc_id").select("family", F.col("doc_id").alias("node"), F.lit(1).cast("long").alias("copies"), "tokens", "blk", "pairs")
    links = cut(family_links(members, pct, _decode(w)))
    united = components(links.select("a", "b")).withColumnRenamed("node", "h1")
    joined = cut(lines.join(united, "h1").select("h1", "h2", "first", "component"))
    kept = joined.groupBy("component").agg(F.min("first").alias("kept"))
    near = joined.join(kept, "component").select("h1", "h2", "kept")
    # Only lines that stand in several places or go for another one can be dropped anywhere.
    final = lines.join(near, ["h1", "h2"], "left").where("rows > 1 or kept is not null").select("h1", "h2", "first", F.coalesce("kept", "first").alias("kept"))
    at = F.struct("doc_id", "line_no")
    gone = (
        here.join(final.hint("shuffle_hash"), ["h1", "h2"])
        .where(at != F.col("kept"))
        .groupBy("doc_id")
        .agg(F.countDistinct(F.when(at == F.col("first"), F.col("line_no"))).cast("int").alias("n_near"), F.array_sort(F.collect_set("line_no")).alias("dropped"))
    )
    total = where.where("n_lines > 0").groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    result = cut(total.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.expr("cast(array() as array<int>)")).alias("dropped")))
    for done in (both, lines, wanted, held, links, joined):
        release(done)
    return result


def _without(batches):
    for b in batches:
        out = []
        for text, dropped in zip(b.column("text").to_pylist(), b.column("dropped").to_pylist()):
            if text is not None and dropped:
                gone = set(dropped)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            out.append(text)
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def without_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; columns as before, ``n_lines`` and ``dropped`` added."""
    both = docs.drop("n_lines", "dropped").join(decisions.select("doc_id", "n_lines", "dropped"), "doc_id", "left")
    return map_batches(both, _without, both.schema)
