"""Embedding near-dedup by iterative quantisation (ITQ), multi-index Hamming tables and reranking.

Unit vectors are projected on their principal axes and rotated so that the signs quantise them with the least
error (ITQ); the balanced signs are the code. Principal axes and rotations are learned from a bounded sample
(``SAMPLE`` vectors, the first by a hash of vec_id); every vector is indexed. The code is cut into substrings, one hash
table each. They widen with the logarithm of the number of vectors, without a bound, so that buckets stay small, and
there are as many tables as a pair at the least cosine needs to share a bucket with probability ``RECALL`` if each bit
differs with the share of the angle in a half turn. Further rotations give the bits that a vector's dimensions do not.
Vectors that share a bucket are compared by the cosine of their original vectors in double precision. A pair that
shares buckets of several tables counts in the first.

Equal vectors are one class, so copies need no comparison. A vector goes to a table only where its bucket has another
one, as the floats that it came as. Buckets of over ``BLOCK`` vectors are dealt over pairs of blocks. Tasks return link
counts and spanning forests only.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, or have a null label or vec_id, link
with nothing and are returned as they are. Vectors of different lengths are not compared. Rows that repeat a vec_id
with different vectors are linked with each other, so their components are one; ``n_links`` is that of the row's own
vector. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .families import Links, link_batch
from .tables import components, cut, dealt, grouped, map_batches, paired, release

LEAST = 0.98
SAMPLE = 20_000
RECALL = 0.999
BLOCK = 2048
ITERATIONS = 30


def itq(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Origin and projection (dim x bits) that quantise the unit vectors x; further rotations come from other seeds.

    Directions are coded about the origin: about the mean, a sample of near copies would be split by its noise.
    """
    dim = x.shape[1]
    mean = np.zeros(dim)
    _, axes = np.linalg.eigh(x.T @ x / len(x) + 1e-12 * np.eye(dim))
    k = min(bits, dim)
    p = axes[:, ::-1][:, :k]
    v = (x - mean) @ p
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, p @ r


def tables_for(width: int, least: float) -> int:
    """Tables for a pair at the least cosine to share a bucket with probability ``RECALL``."""
    equal = (1 - np.arccos(min(1.0, max(-1.0, least))) / np.pi) ** width
    return int(np.ceil(np.log(1 - RECALL) / np.log1p(-min(equal, 1 - 1e-9))))


def learn(rows: np.ndarray, width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection for ``width * tables`` bits, from as many ITQ rotations as that takes."""
    need, parts, seed = width * tables, [], 0
    while sum(p.shape[1] for _, p in parts) < need:
        parts.append(itq(rows, need, seed))
        seed += 1
    return parts[0][0], np.concatenate([p for _, p in parts], 1)[:, :need]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """The substrings of each vector's code, one for each table."""
    bits = ((x - mean) @ projection >= 0).reshape(len(x), -1, width)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(models: dict, width: int, tables: int):
    import pyarrow as pa

    def work(batches):
        for b in batches:
            v, dims = b.column("embedding"), b.column("dim").to_numpy()
            out = np.zeros((b.num_rows, tables), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in models:
                    flat = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                    out[at] = codes(_unit(flat, int(dim)), *models[int(dim)], width)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tables, pa.int32()), pa.array(out.ravel()))], names=["group", "node", "chunks"])

    return work


def _compare(least: float, tables: int):
    def kernel(t, bounds):
        ids, copies, dim, table = (t.column(c).to_numpy() for c in ("node", "copies", "dim", "table"))
        blk, bi, bj = (t.column(c).to_numpy() for c in ("blk", "bi", "bj"))
        vectors, chunks = t.column("embedding").combine_chunks(), t.column("chunks").combine_chunks()
        found = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s < 2:
                continue
            x = _unit(vectors.slice(s, e - s).flatten().to_numpy(zero_copy_only=False), int(dim[s]))
            c = chunks.slice(s, e - s).flatten().to_numpy().reshape(-1, tables)
            left, right = np.flatnonzero(blk[s:e] == bi[s]), np.flatnonzero(blk[s:e] == bj[s])
            i, j = np.nonzero(x[left] @ x[right].T >= least)
            i, j = left[i], right[j]
            ok = (i < j) if bi[s] == bj[s] else i != j
            for k in range(table[s]):
                ok &= c[i, k] != c[j, k]  # an earlier table has the pair
            if ok.any():
                links = Links(ids[s:e], copies[s:e])
                links.add(i[ok], j[ok])
                found.append(links.rows())
        if found:
            yield link_batch(found)

    return kernel


def vector_dedup(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fit = F.expr(f"vec_id is not null and label is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = {kind}('infinity')) and exists(embedding, x -> x <> 0)")
    keyed = rows.select("vec_id", F.when(fit, F.xxhash64("label", "embedding")).alias("node"), F.when(fit, F.xxhash64(F.lit(1), "embedding", "label")).alias("e2"), "embedding", "label")
    ids = cut(keyed.select("vec_id", "node", "e2"))
    # A class of equal vectors is a node, named by a hash; a second hash tells apart the odd pair that shares it.
    classes = cut(keyed.where("node is not null").groupBy("node", "e2").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")))
    classes = classes.withColumn("dim", F.size("embedding")).withColumn("group", F.xxhash64("label", "dim"))
    biggest = classes.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    width = int(max(1, np.log2(max(2, biggest)) - 3))
    tables = tables_for(width, least)
    picked: dict[int, list] = {}
    found = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("dim", "embedding").toArrow()
    for k, d in enumerate(found.column("dim").to_pylist()):
        picked.setdefault(d, []).append(found.column("embedding")[k].values.to_numpy(zero_copy_only=False))
    models = {d: learn(_unit(np.concatenate(x), d), width, tables) for d, x in picked.items()}
    coded = cut(map_batches(classes.select("group", "dim", "node", "embedding"), _coded(models, width, tables), "group long, node long, chunks array<long>"))
    spread = coded.select("group", "node", F.posexplode("chunks").alias("table", "chunk"))
    crowd = spread.groupBy("group", "table", "chunk").count().where("count > 1").drop("count")
    placed = dealt(spread.join(crowd, ["group", "table", "chunk"]), ["group", "table", "chunk"], "node", None, BLOCK)
    vectors_of = classes.select("node", "copies", "dim", "embedding").join(coded.select("node", "chunks"), "node")
    blocks = paired(placed.join(vectors_of, "node"))
    links = cut(grouped(blocks, ["group", "table", "chunk", "bi", "bj"], _compare(least, tables), "a long, b long, n long"))
    # The vectors of a repeated vec_id hang together.
    several = ids.where("node is not null").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("all")).where("a <> z").select("a", F.explode("all").alias("b")).where("a <> b")
    united = components(links.select("a", "b").unionByName(several)).select("node", "component")
    least_id = classes.select("node", "rep").join(united, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    comp = united.join(least_id, "component").select("node", "component_id")
    direct = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of = classes.select("node", "e2", "rep", "copies").join(comp, "node", "left").join(direct, "node", "left")
    of = of.select("node", "e2", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ids.join(of, ["node", "e2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = cut(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    for done in (ids, classes, coded, links):
        release(done)
    return out
