"""Distributed union-find, block-split groups, and a Bloom filter as a join; lineage is cut by shared scratch tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, release
from . import kernels as K

ROWS = 1000


def map_batches(df: DataFrame, work, schema, rows: int | None = ROWS) -> DataFrame:
    """``mapInArrow`` on slices of at most ``rows`` rows."""
    return df.mapInArrow(K.bounded(work, rows), schema)


def _forest(batches):
    """Union-find over the links of one partition; only its spanning forest goes on."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
    nodes = [x for x in parent if find(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["hi", "lo"])


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Distributed union-find: ``links(a, b)`` of long ids -> ``(node, component)``, component = smallest id reachable.

    Each partition first unites its own links and keeps only a spanning forest. Rounds of a union step (every
    neighbour above a node is hung on that node's smallest neighbour) and a find step (every node's parents are hung
    on the smallest) then run on the forests' edges until nothing changes, which leaves one star for each component.
    All steps are aggregations with map-side combine and equi-joins, which Spark can split at a hub. Only nodes with
    a link are returned. Nulls and self links are ignored; an empty table gives an empty result.
    """
    e = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")
    edges, seen = cut(map_batches(e, _forest, "hi long, lo long").distinct()), None
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = up.groupBy("hi").agg(F.min("lo").alias("m"))
        down = up.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        after = down.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        if seen:  # stars have no more links than nodes, so the size is known: not one file for each shuffle partition
            after = after.coalesce(8 + seen[0] // 500_000)
        after = cut(after)
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        release(edges)
        edges = after
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def thin(df: DataFrame, keys: DataFrame, col: str, bits: int = 1 << 23) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be in ``keys``, so that fewer rows are shuffled by the join that follows.

    A Bloom filter with one hash, as a table of ``bits / 64`` rows at most (1 MB), is all that is broadcast. However
    many keys there are, no row with a key is lost; with very many keys the filter passes every row.
    """
    at = F.expr(f"cast(pmod(xxhash64({col}), {bits}L) % 64 as int)")
    word = F.expr(f"cast(pmod(xxhash64({col}), {bits}L) div 64 as int)")
    marks = keys.select(word.alias("_word"), at.alias("_at")).distinct().select("_word", F.expr("shiftleft(1L, _at)").alias("_bit"))
    marks = marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return df.withColumn("_word", word).withColumn("_at", at).join(F.broadcast(marks), "_word").where("(shiftrightunsigned(_bits, _at) & 1) = 1").drop("_word", "_at", "_bits")


def dealt(df: DataFrame, keys: list[str], id_col: str, weight: str | None, limit: int) -> DataFrame:
    """Adds ``blk`` and ``pairs``: a group whose weight is over ``limit`` is dealt over blocks, one task for each pair of blocks.

    Members go to a block by the hash of their id; each block meets every block once as (bi, bj), bi <= bj, so every
    pair of members meets in exactly one (bi, bj) and no task holds more than two blocks. ``pairs`` are those of a
    member's block. Best used on narrow rows, before long columns are joined.
    """
    w = F.sum(weight) if weight else F.count("*")
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(w / F.lit(limit))).cast("int").alias("_k"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(F.least("blk", j).alias("bi"), F.greatest("blk", j).alias("bj")))
    return df.join(sizes, keys).withColumn("blk", F.pmod(F.xxhash64(id_col), F.col("_k")).cast("int")).withColumn("pairs", pairs).drop("_k")


def paired(df: DataFrame) -> DataFrame:
    """One row for each of ``pairs``, as ``bi`` and ``bj``."""
    return df.select("*", F.explode("pairs").alias("_p")).select("*", "_p.bi", "_p.bj").drop("pairs", "_p")


def runs(batches, n_keys: int):
    """Whole groups from batches that are sorted by their first ``n_keys`` columns, as tables of complete groups."""
    import numpy as np

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        t = t.combine_chunks()
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for c in range(n_keys):
            x = t.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        if len(at):
            cut_at = int(at[-1]) + 1
            yield t.slice(0, cut_at), np.r_[0, at + 1]
            rest = t.slice(cut_at)
        else:
            rest = t
    if rest is not None and rest.num_rows:
        yield rest, np.r_[0, rest.num_rows]


def grouped(df: DataFrame, keys: list[str], kernel, schema: str) -> DataFrame:
    """``kernel(table, bounds)`` over the groups of ``keys``; bounded by the limit given to :func:`dealt`."""
    n = len(keys)

    def work(batches):
        for t, bounds in runs(batches, n):
            yield from kernel(t, bounds)

    cols = [*keys, *[c for c in df.columns if c not in keys]]
    return map_batches(df.select(*cols).repartition(*keys).sortWithinPartitions(*keys), work, schema, None)
