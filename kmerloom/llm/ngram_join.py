"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, each document becomes one
segment for each fragment, and the overlaps of a pair are counted fragment by fragment and summed.

Candidates. Two sets of at most ``u`` n-grams with Jaccard >= t differ in at most ``d = floor(2u(1-t)/(1+t))`` n-grams.
With ``d + 1 + slack`` fragments, at least ``slack + 1`` segments of such a pair are equal. Each document drops its
``slack`` smallest segments in one fixed order (size, then hash) and shows the others: the larger of the two cut-offs
still leaves an equal segment that both show, so no link is lost. ``u`` comes from geometric size classes; a set whose
partners may lie in the next class shows its segments of that class too.

Verification. Documents that share a shown segment form families (distributed union-find over star links, one for each
member of a bucket). In a family, pairs within the size ratio whose parity bitmaps differ in at most the allowed number
of bits (a lower bound of the set difference, so again nothing is lost) are counted exactly: the family's n-grams that
occur twice are taken fragment by fragment as bit columns, partial overlaps are counted, and summed for each pair.
Large families are dealt over pairs of blocks. Only spanning forests and link counts leave a task.

Cases: null or empty text, or text without words, has an empty set, linked with nothing. Texts with the same set are
one class, found by a 128-bit set hash. Repeated rows are kept. Rows that share a doc_id with different texts are linked
with each other, so their components are one; ``n_links`` of such a row may count the links of the others too. A null
doc_id stays, unlinked, with a null component. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .families import FAMILY_TOKENS, Links, _bitmap, bitmap_words, family_links, folded
from .tables import components, cut, dealt, grouped, map_batches, paired, release, thin

RATIO = 1.5
BUCKET_ROWS = 10_000
#: Words of bitmaps that are compared at a time.
FOLDED = 1 << 18


def most_different(u: int, pct: int) -> int:
    """Largest symmetric difference of two sets of at most u members with 100 |a & b| >= pct |a or b|."""
    return 2 * u * (100 - pct) // (100 + pct)


def size_classes(pct: int, most: int = 1 << 26) -> list[int]:
    """Upper bounds of the size classes; a class is wider than the size ratio, so partners are at most one class away."""
    ratio, out = max(RATIO, 100 / pct * 1.01), [max(1, 100 // max(1, 100 - pct) // 2)]
    while out[-1] < most:
        out.append(math.ceil(out[-1] * ratio))
    return out


def segments(x: np.ndarray, c: int, u: int, pct: int) -> np.ndarray:
    """The hashes of the segments that the sorted set x shows in size class c with the bound u."""
    d = most_different(u, pct)
    if d == 0:
        return np.zeros(0, K.U)
    slack = (d + 1) // 5 + 1
    f = d + 1 + slack
    # Fragment i holds the hashes whose upper 32 bits, scaled by f, have the integer part i.
    bounds = np.searchsorted(((x >> K.U(32)) * K.U(f)) >> K.U(32), np.arange(f + 1, dtype=K.U))
    sums = np.zeros(len(x) + 1, K.U)
    np.cumsum(K.mix(x, 3), out=sums[1:])
    size = np.diff(bounds)
    key = K.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (K.powers(K.BASE, f + 1)[1:] + K.U(c)), 5)
    return key[np.lexsort((key, size))[slack:]]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def _sizes(w: int, screen: bool):
    """Each row's set size, 128-bit set hash and, for the screen, bitmap."""

    def work(batches):
        for b in batches:
            raw, off = K.text_bytes(b.column("text"))
            ids = b.column("doc_id")
            for i, j in K.portions(off):
                h, _, _, first = K.words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                n, h1, h2, bits = [], [], [], []
                for x in K.shingles(h, first, w):
                    n.append(len(x))
                    h1.append(int(K.mix(x, 1).sum(dtype=K.U).astype(np.int64)))
                    h2.append(int(K.mix(x, 2).sum(dtype=K.U).astype(np.int64)))
                    bits.append(_bitmap(x, bitmap_words(len(x))) if screen else np.zeros(0, K.U))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(bits)], names=["doc_id", "n_shingles", "h1", "h2", "bits"])

    return work


def _keys(w: int, pct: int):
    """The segments that each row shows, in its size class and, where partners may lie there, in the next one."""
    classes = np.array(size_classes(pct))

    def work(batches):
        for b in batches:
            raw, off = K.text_bytes(b.column("text"))
            ids = b.column("doc_id")
            for i, j in K.portions(off):
                h, _, _, first = K.words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                keys = []
                for x in K.shingles(h, first, w):
                    own = [np.zeros(0, K.U)]
                    if len(x):
                        c = int(np.searchsorted(classes, len(x)))
                        own.append(segments(x, c, int(classes[c]), pct))
                        if 100 * len(x) >= pct * (int(classes[c]) + 1):
                            own.append(segments(x, c + 1, int(classes[c + 1]), pct))
                    keys.append(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), _lists(keys)], names=["doc_id", "keys"])

    return work


MEMBERS = "family long, node long, copies long, tokens binary, blk int, pairs array<struct<bi:int,bj:int>>"


def _sets(w: int):
    """Members of families with the tokens of their sets, where a row's set is the expected one."""

    def work(batches):
        for b in batches:
            raw, off = K.text_bytes(b.column("text"))
            want = b.column("h1").to_numpy()
            for i, j in K.portions(off):
                h, _, _, first = K.words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                keep, tokens = [], []
                for r, x in zip(range(i, j), K.shingles(h, first, w)):
                    if int(K.mix(x, 1).sum(dtype=K.U).astype(np.int64)) == want[r]:
                        keep.append(r)
                        tokens.append(x.tobytes())
                at = pa.array(keep, pa.int64())
                family, node, copies, blk, pairs = (b.column(c).take(at) for c in ("family", "doc_id", "copies", "blk", "pairs"))
                yield pa.RecordBatch.from_arrays([family, node, copies, pa.array(tokens, pa.binary()), blk, pairs], names=["family", "node", "copies", "tokens", "blk", "pairs"])

    return work


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The words of a column of bitmaps, and where each row's begin and end."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.values.to_numpy().view(K.U), a.offsets.to_numpy()


def _screen(pct: int):
    def work(batches):
        for t in batches:
            na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
            ok = 100 * np.minimum(na, nb) >= pct * np.maximum(na, nb)
            (va, ea), (vb, eb) = (_flat(t.column(c)) for c in ("ba", "bb"))
            wa, wb = np.diff(ea), np.diff(eb)
            at = np.flatnonzero(ok)
            for x, y in np.unique(np.stack([wa[at], wb[at]]), axis=1).T.tolist():  # pairs of one pair of widths together
                words, same = min(x, y), at[(wa[at] == x) & (wb[at] == y)]
                for k in range(0, len(same), max(1, FOLDED // max(x, y))):
                    r = same[k : k + max(1, FOLDED // max(x, y))]
                    p, q = (np.bitwise_xor.reduce(v[e[r][:, None] + np.arange(n)].reshape(len(r), -1, words), axis=1) for v, e, n in ((va, ea, x), (vb, eb, y)))
                    ok[r] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= (100 - pct) * (na[r] + nb[r]) // (100 + pct)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    return work


def _screened(star: DataFrame, side: DataFrame, pct: int) -> DataFrame:
    """Star links whose ends may be similar by their sizes and bitmaps."""
    both = star.join(side.toDF("a", "na", "ba"), "a").join(side.toDF("b", "nb", "bb"), "b")
    return map_batches(both.select("a", "b", "na", "nb", "ba", "bb"), _screen(pct), "a long, b long")


def _levels(bits: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each bitmap width: the members with at least as many words, and their bitmaps folded to it."""
    width = np.array([len(x) for x in bits])
    return {int(w): (at := np.flatnonzero(width >= w), np.stack([folded(bits[k], int(w)) for k in at])) for w in np.unique(width)}


def _meet(pct: int):
    """A spanning forest of the pairs of a bucket's members, in each pair of blocks, that sizes and bitmaps allow."""

    def group(node, family, n, width, blk, bi, bj, bits):
        links = Links(node, np.ones(len(node), np.int64))
        _, first, of = np.unique(family, return_index=True, return_inverse=True)
        links.parent = first[of]
        if len(node) ** 2 * width[0] <= FOLDED and (width == width[0]).all():  # small: all pairs at once
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(blk == bi), np.flatnonzero(blk == bj), indexing="ij"))
            ok = (of[i] != of[j]) & (n[j] >= -(-pct * n[i] // 100)) & (n[j] <= 100 * n[i] // pct)
            i, j = i[ok], j[ok]
            maps = np.stack(bits)
            ok = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64) <= (100 - pct) * (n[i] + n[j]) // (100 + pct)
            links.add(i[ok], j[ok])
            return links.rows()[:2]
        levels = _levels(bits)
        a, b, held, right = [], [], 0, {}
        for w, (at, maps) in levels.items():
            order = np.flatnonzero(blk[at] == bj)
            order = order[np.argsort(n[at[order]], kind="stable")]
            right[w] = at[order], n[at[order]], maps[order], dict(zip(at.tolist(), range(len(at))))
        for i in np.flatnonzero(blk == bi):
            for w in (w for w in levels if w <= width[i]):
                at, sizes, maps, row = right[w]
                lo, hi = np.searchsorted(sizes, -(-pct * n[i] // 100)), np.searchsorted(sizes, 100 * n[i] // pct, "right")
                j, m = at[lo:hi], maps[lo:hi]
                ok = links.parent[j] != links.parent[i]  # the others are in one family already
                if w < width[i]:
                    ok &= width[j] == w
                if not ok.any():
                    continue
                j, m = j[ok], m[ok]
                most = (100 - pct) * (n[i] + n[j]) // (100 + pct)
                j = j[np.bitwise_count(m ^ levels[w][1][row[int(i)]]).sum(1, dtype=np.int64) <= most]
                if len(j):
                    a.append(np.full(len(j), i))
                    b.append(j)
                    held += len(j)
            if held > 1000:
                links.add(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if a:
            links.add(np.concatenate(a), np.concatenate(b))
        return links.rows()[:2]

    def kernel(t, bounds):
        node, family, n, blk, bi, bj = (t.column(c).to_numpy() for c in ("node", "family", "n_shingles", "blk", "bi", "bj"))
        words, ends = _flat(t.column("bits"))
        for s, e in zip(bounds[:-1], bounds[1:]):
            bits = [words[x:y] for x, y in zip(ends[s:e].tolist(), ends[s + 1 : e + 1].tolist())]
            x, y = group(node[s:e], family[s:e], n[s:e], np.array([len(x) for x in bits]), blk[s:e], bi[s], bj[s], bits)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return kernel


def _screened_families(keys: DataFrame, one: DataFrame, pct: int) -> DataFrame:
    """(node, component): members of a bucket that sizes and bitmaps allow to be similar are in one family.

    Buckets with the same members count once. Links to a bucket's smallest and largest id come first; where they leave
    a bucket of four or more members in several families, all its members meet, block by block.
    """
    h = F.xxhash64("doc_id")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("size"), F.sum(F.shiftrightunsigned(h, 32)).alias("s1"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s2")).where("a <> z")
    buckets = buckets.groupBy("a", "z", "size", "s1", "s2").agg(F.min("key").alias("key")).select("key", "a", "z", "size")
    met = cut(keys.join(buckets.hint("shuffle_hash"), "key"))
    # Rows that share a doc_id may have different sets: each of them is tried.
    side = one.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "bits").distinct()
    star = met.select(F.explode(F.array("a", "z")).alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    star = cut(_screened(star, side, pct))
    family = components(star).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    rows = met.where("size > 3").select("key", "doc_id").distinct().join(family, "doc_id", "left").select("key", "doc_id", F.coalesce("family", "doc_id").alias("family"))
    rows = cut(rows)
    split = rows.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("key")
    rows = dealt(rows.join(split, "key"), ["key"], "doc_id", None, BUCKET_ROWS).join(side, "doc_id").withColumnRenamed("doc_id", "node")
    more = grouped(paired(rows), ["key", "bi", "bj"], _meet(pct), "a long, b long")
    out = components(star.unionByName(more))
    for done in (met, star, rows):
        release(done)
    return out


def ngram_join(docs: DataFrame, w: int = 3, pct: int = 90, screen: bool = False) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) for each row of ``docs(doc_id, text)``; links: Jaccard >= pct/100.

    ``n_links`` is the number of other documents linked directly, copies included. At lower thresholds segments are
    short, and a shared passage can chain unlike documents into one large family. ``screen`` then leaves out links between a
    bucket's members that sizes and bitmaps rule out; no link is lost (see ``_screened_families``).
    """
    docs = docs.select("doc_id", "text")
    one = cut(map_batches(docs, _sizes(w, screen), "doc_id long, n_shingles long, h1 long, h2 long, bits array<long>"))
    classes = cut(one.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"), F.max("n_shingles").alias("n")))
    reps = classes.select(F.col("rep").alias("doc_id"), "h1", "h2", "copies", "n")
    # Copies show the same segments as their representative, so they need no join of their own before this.
    # The conditions that the join would add are stated before the exchange, so that both reads of it are one exchange.
    # Segments are made in a pass of their own and go straight into the exchange: written out, they would be as large again.
    shown = map_batches(docs.where("doc_id is not null"), _keys(w, pct), "doc_id long, keys array<long>")
    keys = shown.select("doc_id", F.explode("keys").alias("key")).where("key is not null and doc_id is not null").repartition("key")
    if screen:
        family = _screened_families(keys, one, pct)
    else:
        buckets = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z")
        star = keys.join(buckets.hint("shuffle_hash"), "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
        family = components(star)
    family = family.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    # Blocks are dealt on narrow rows; only then the texts are joined and their sets made, once.
    wanted = cut(dealt(family.join(reps, "doc_id").select("doc_id", "family", "h1", "copies", "n"), ["family"], "doc_id", "n", FAMILY_TOKENS))
    texts = thin(docs, wanted, "doc_id").join(wanted, "doc_id").select("family", "doc_id", "h1", "copies", "blk", "pairs", "text")
    out = cut(family_links(map_batches(texts, _sets(w), MEMBERS), pct))
    result = cut(_result(one.drop("bits"), classes, out))
    for done in (one, classes, wanted, out):
        release(done)
    return result


def _result(one: DataFrame, classes: DataFrame, out: DataFrame) -> DataFrame:
    # A doc_id with several sets links their classes, each named by its smallest doc_id.
    several = one.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id")
    through = one.select("doc_id", "h1", "h2").join(several, "doc_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(out.select("a", "b").unionByName(through)).withColumnRenamed("node", "rep")
    links = out.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    of = classes.drop("n").join(comp, "rep", "left").join(links, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return one.join(of, ["h1", "h2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )

