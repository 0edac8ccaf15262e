"""The k-mer index: one aggregation over all occurrences, on both strands and in known variants. K-mers are packed longs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, packed
from ..functions import seq as S
from ..plans.config import Config
from ..plans.scratch import cut, local_root, release
from . import mapped

SEGMENTS = "chrom string, chrom_idx int, start int, end int, ref string"
BLOCK = 1 << 20
BIN = 1 << 14


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is always shuffled.

    Spark takes what a Python map makes of a row to be about as large as the row, so a genome's k-mers, or its bases in
    compressed files, may look smaller than the broadcast threshold; the driver would gather them all.
    """
    return df.hint("merge")


def repeats(contigs: DataFrame, cfg: Config) -> DataFrame:
    """(kmer, n): k-mers at every third offset of the contigs that occur twice or more."""
    return S.kmers(contigs.select("seq"), "seq", cfg.k, cfg.jump).groupBy("kmer").agg(F.count("*").alias("n")).where("n >= 2")


def members(kmers: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``kmers(kmer, ...)`` whose k-mer is a repeat."""
    return kmers.join(never_broadcast(repeated.select("kmer")), "kmer", "left_semi")


def repeat_runs(contigs: DataFrame, repeated: DataFrame, cfg: Config) -> DataFrame:
    """(chrom, first, last): runs of offsets with a repeated k-mer, cut at multiples of ``BLOCK`` so that no task has a contig."""
    at = members(S.kmers(contigs.select("chrom", "seq"), "seq", cfg.k), repeated).select("chrom", "offset", F.floor(F.col("offset") / BLOCK).alias("block"))
    run = F.col("offset") - F.row_number().over(Window.partitionBy("chrom", "block").orderBy("offset"))
    return at.withColumn("run", run).groupBy("chrom", "block", "run").agg(F.min("offset").alias("first"), F.max("offset").alias("last")).select("chrom", "first", "last")


def cut_genome(contigs: DataFrame, repeated: DataFrame, cfg: Config) -> DataFrame:
    """(seg_idx, chrom, chrom_idx, start, end, code, ref): segments cut where two k-mers in a row are no repeats.

    Where a segment ends depends on where it began, so a contig is cut by one task; it gets the runs of repeats (two
    numbers each), not the k-mers.
    """
    runs = repeat_runs(contigs, repeated, cfg).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))

    def work(batches):
        for b in batches:
            for r in range(b.num_rows):
                chrom, idx, seq = (b.column(c)[r].as_py() for c in ("chrom", "chrom_idx", "seq"))
                held = b.column("runs")[r].values
                lo, hi = (held.field(c).to_pylist() if held is not None else [] for c in ("first", "last"))
                found = kernels.cut_contig(seq, lo, hi, cfg.k, cfg.min_segment, cfg.max_segment)
                for i in range(0, len(found), 128):
                    part = found[i : i + 128]
                    n = len(part)
                    cols = [pa.array([chrom] * n), pa.array([idx] * n, pa.int32()), pa.array([s for s, _ in part], pa.int32()), pa.array([e for _, e in part], pa.int32()), pa.array([seq[s : e + cfg.flank] for s, e in part])]
                    yield pa.RecordBatch.from_arrays(cols, names=["chrom", "chrom_idx", "start", "end", "ref"])

    cut = contigs.select("chrom", "chrom_idx", "seq").join(runs, "chrom", "left").mapInArrow(work, SEGMENTS)
    return number(cut, cfg)


def number(segments: DataFrame, cfg: Config) -> DataFrame:
    """Numbers segments in genome order and gives each its code.

    Only (chrom_idx, start) go through one task, and there are at most C(32, 5) = 201,376 segments.
    """
    order = segments.select("chrom_idx", "start").withColumn("seg_idx", F.row_number().over(Window.orderBy("chrom_idx", "start")).cast("int") - 1)
    order = order.withColumn("code", S.segment_code(F.col("seg_idx"), cfg.code_bits))
    return segments.join(order, ["chrom_idx", "start"]).select("seg_idx", "chrom", "chrom_idx", "start", "end", "code", "ref")


def own_bases(segments: DataFrame) -> DataFrame:
    """Segments with the bases that are their own, without the flank."""
    return segments.withColumn("bases", F.expr("substring(ref, 1, end - start)"))


def segment_of(codes: DataFrame, segments: DataFrame, code: str = "code") -> DataFrame:
    """Adds seg_idx (-1: unknown) and chrom to rows with a segment's code; the segments' table is narrow and at most 201,376 rows."""
    s = F.broadcast(segments.select(F.col("code").alias(code), "seg_idx", "chrom"))
    return codes.join(s, code, "left").withColumn("seg_idx", F.coalesce("seg_idx", F.lit(-1)))


def _strands(fwd: Column, grid: Column, k: int) -> Column:
    return F.explode(F.array(F.struct(fwd.alias("kmer"), grid.alias("is_grid")), F.struct(S.packed_revcomp(fwd, k).alias("kmer"), F.lit(False).alias("is_grid"))))


def occurrences(segments: DataFrame, cfg: Config) -> DataFrame:
    """(kmer, code, pos, is_grid): every offset of every segment, forward and reverse complement; grid: forward, every third."""
    w = S.kmers(own_bases(segments).select("code", "bases"), "bases", cfg.k)
    return w.select("code", F.col("offset").alias("pos"), _strands(F.col("kmer"), F.col("offset") % cfg.jump == 0, cfg.k).alias("o")).select("o.kmer", "code", "pos", "o.is_grid")


def variant_segments(snps: DataFrame, segments: DataFrame) -> DataFrame:
    """``snps(chrom, pos, ...)`` with seg_idx, start, end and code of each segment that holds the position.

    Segments and variants meet on (chrom, bin of ``BIN`` bases), so neither side has to fit in memory.
    """
    s = segments.select("seg_idx", "chrom", "start", "end", "code", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("_bin"))
    v = snps.withColumn("_bin", F.floor((F.col("pos") - 1) / BIN))
    return v.join(s, ["chrom", "_bin"]).where("pos - 1 >= start and pos - 1 < end").drop("_bin")


def haplotypes(snps: DataFrame, segments: DataFrame, cfg: Config, span: int | None = None) -> DataFrame:
    """(seg_idx, start, code, first, alt_len, same_length, haplotype): the variant with ``span - 1`` bases (default: k - 1) on each side.

    The segment is the one that holds the position; variants too near a segment's edge or with alleles over 150 bases
    are left out. ``first`` is the haplotype's offset in the segment.
    """
    n = (span or cfg.k) - 1
    s = snps.where("length(ref) <= 150 and length(alt) <= 150").withColumnRenamed("ref", "ref_allele")
    at = "(pos - 1 - start)"
    ok = variant_segments(s, segments).where(f"{at} >= {n} and {at} + length(ref_allele) + {n} <= end - start")
    ok = ok.join(never_broadcast(segments.select("seg_idx", "ref")), "seg_idx")
    return ok.select("seg_idx", "start", "code", F.expr(f"{at} - {n}").cast("int").alias("first"), F.expr("length(alt)").alias("alt_len"), F.expr("length(alt) = length(ref_allele)").alias("same_length"), F.expr(f"concat(substring(ref, {at} - {n - 1}, {n}), alt, substring(ref, {at} + length(ref_allele) + 1, {n}))").alias("haplotype"))


def variant_occurrences(snps: DataFrame, segments: DataFrame, cfg: Config) -> DataFrame:
    """Occurrences in haplotypes: grid-aligned ones enter the index (without position for indels), all others only count."""
    h = haplotypes(snps, segments, cfg).withColumn("size", F.length("haplotype"))
    w = S.kmers(h, "haplotype", cfg.k)
    pos = F.col("first") + F.col("offset")
    grid = (pos % cfg.jump == 0) | (~F.col("same_length") & (F.col("offset") + cfg.k == F.col("size")))
    return w.select("code", F.when(F.col("same_length"), pos).alias("pos"), _strands(F.col("kmer"), grid, cfg.k).alias("o")).select("o.kmer", "code", "pos", "o.is_grid")


def compact(occ: DataFrame, keys: tuple[str, ...] = ("kmer",)) -> DataFrame:
    """(keys, code, pos): codes united by OR; the position stays where the k-mer occurs once."""
    g = occ.groupBy(*keys).agg(F.bit_or("code").alias("code"), F.count("*").alias("n"), F.max("is_grid").alias("grid"), F.min("pos").alias("pos"))
    return g.where("grid").select(*keys, "code", F.when(F.col("n") == 1, F.col("pos")).cast("int").alias("pos"))


def neighbourhood(segments: DataFrame, index: DataFrame, cfg: Config) -> DataFrame:
    """(kmer, repeat_cat): 1 next to a k-mer of more segments than one, 2 next to one of all, 3 both; positions known.

    Between two grid k-mers in a row, the k-mers in between follow from these two by shifts.
    """
    cat = F.when(F.col("code") == 0xFFFFFFFF, 2).when(F.bit_count("code") > cfg.code_bits, 1)
    marked = index.withColumn("cat", cat).where("cat is not null").select("kmer", "cat")
    grid = never_broadcast(S.kmers(own_bases(segments).select("seg_idx", "bases"), "bases", cfg.k, cfg.jump)).join(marked, "kmer").select("seg_idx", "offset", "kmer", "cat")
    after = grid.select("seg_idx", (F.col("offset") - cfg.jump).alias("offset"), F.col("kmer").alias("next"), F.col("cat").alias("next_cat"))
    full = (1 << 2 * cfg.k) - 1
    shifted = [F.shiftleft("kmer", 2 * d).bitwiseAND(F.lit(full)).bitwiseOR(F.shiftright("next", 2 * (cfg.jump - d)).bitwiseAND(F.lit((1 << 2 * d) - 1))) for d in range(1, cfg.jump)]
    between = grid.join(after, ["seg_idx", "offset"]).select(F.explode(F.array(*shifted)).alias("kmer"), F.when((F.col("cat") == 2) & (F.col("next_cat") == 2), 2).otherwise(1).alias("cat"))
    seeds = marked.unionByName(between).distinct()
    seeds = seeds.select(F.explode(F.array(F.col("kmer"), S.packed_revcomp(F.col("kmer"), cfg.k))).alias("kmer"), "cat").distinct()
    near = seeds.select(F.explode(S.neighbours(F.col("kmer"), cfg.k)).alias("kmer"), "cat")
    return near.groupBy("kmer").agg(F.bit_or("cat").cast("int").alias("repeat_cat")).join(index.where("pos is not null").select("kmer"), "kmer")


def kmer_index(segments: DataFrame, cfg: Config, snps: DataFrame | None = None) -> DataFrame:
    """(kmer, code, pos, repeat_cat)"""
    occ = occurrences(segments, cfg)
    if snps is not None:
        occ = occ.unionByName(variant_occurrences(snps, segments, cfg))
    index = cut(compact(occ))  # read four times below
    return index.join(neighbourhood(segments, index, cfg), "kmer", "left").fillna(0, ["repeat_cat"])


def left_mask(span: int, cfg: Config) -> int:
    """The bits of the left k-mer that are part of a composite key: a spaced seed leaves out the first bases."""
    return (1 << 2 * (cfg.spaced_left if span >= 2 * cfg.k else cfg.k)) - 1


def mapped_vague(vague: DataFrame, cfg: Config) -> mapped.Mapped | None:
    """The files of the ambiguous k-mers, or None where they are joined."""
    if local_root(vague.sparkSession) is None or not cfg.mapped_rows:
        return None
    table = cut(vague.select("kmer", F.lit(False).alias("flag"), F.lit(0).cast("long").alias("value")))
    held = mapped.store(table, cfg.k) if table.limit(cfg.mapped_rows + 1).count() <= cfg.mapped_rows else None
    release(table)
    return held


def vague_pairs(df: DataFrame, seq: str, held: mapped.Mapped, gap: int, cfg: Config) -> DataFrame:
    """(l, r, code, pos, is_grid): k-mer pairs ``gap`` bases apart, both in ``held``, of segments' bases or of haplotypes.

    Haplotypes have ``first``, the offset of theirs in the segment; none of theirs is on the grid, and those in step
    with it count only on the reverse strand.
    """
    known = "first" in df.columns
    k, jump, windows = cfg.k, cfg.jump, packed.window_batches(seq, cfg.k, 1, gap)

    def work(batches):
        for b in windows(batches):
            a, z = (b.column(c).to_numpy() for c in ("kmer", "kmer2"))
            ra, rz = packed.complement(a, k), packed.complement(z, k)
            ok = held.holds(a, ra) & held.holds(z, rz)
            pos = b.column("offset").to_numpy() + (b.column("first").to_numpy() if known else 0)
            grid = pos % jump == 0
            fwd, rev = np.flatnonzero(ok[0] & ~grid if known else ok[0]), np.flatnonzero(ok[1])
            at = np.r_[fwd, rev]
            if len(at):
                on = np.r_[np.zeros(len(fwd), bool) if known else grid[fwd], np.zeros(len(rev), bool)]
                cols = [pa.array(np.r_[a[fwd], rz[rev]]), pa.array(np.r_[z[fwd], ra[rev]]), b.column("code").take(pa.array(at)), pa.array(pos[at].astype(np.int32)), pa.array(on)]
                yield pa.RecordBatch.from_arrays(cols, names=["l", "r", "code", "pos", "is_grid"])

    return df.mapInArrow(work, "l long, r long, code long, pos int, is_grid boolean")


def composite_index(segments: DataFrame, index: DataFrame, span: int, cfg: Config, snps: DataFrame | None = None) -> DataFrame:
    """(kmer_l, kmer_r, code, pos): pairs of k-mers at the ends of ``span`` bases, both in the index without a position.

    ``kmer_l`` has only the bits of ``left_mask``. Pairs in known variants enter no new rows: they add their code, and
    a row that they meet loses its position.
    """
    gap, mask = span - cfg.k, F.lit(left_mask(span, cfg))
    vague = index.where("pos is null").select("kmer")

    def pairs(windows: DataFrame, pos: Column, grid: Column, only_reverse: Column) -> DataFrame:
        ends = F.array(
            F.struct(F.col("kmer").alias("l"), F.col("kmer2").alias("r"), grid.alias("is_grid"), only_reverse.alias("_skip")),
            F.struct(S.packed_revcomp(F.col("kmer2"), cfg.k).alias("l"), S.packed_revcomp(F.col("kmer"), cfg.k).alias("r"), F.lit(False).alias("is_grid"), F.lit(False).alias("_skip")),
        )
        return windows.select("code", pos.cast("int").alias("pos"), F.explode(ends).alias("o")).where("not o._skip").select("o.l", "o.r", "code", "pos", "o.is_grid")

    held = mapped_vague(vague, cfg)
    windows = own_bases(segments).select("code", "bases"), "bases"
    variants = None if snps is None else (haplotypes(snps, segments, cfg, span).select("code", "first", "haplotype"), "haplotype")
    if held is not None:
        occ = vague_pairs(*windows, held, gap, cfg)
        if variants is not None:
            occ = occ.unionByName(vague_pairs(*variants, held, gap, cfg))
        return compact(occ.select(F.col("l").bitwiseAND(mask).alias("kmer_l"), F.col("r").alias("kmer_r"), "code", "pos", "is_grid"), ("kmer_l", "kmer_r"))
    on_grid = F.col("offset") % cfg.jump == 0
    occ = pairs(S.kmers(*windows, cfg.k, 1, gap), F.col("offset"), on_grid, F.lit(False))
    if variants is not None:
        at = F.col("first") + F.col("offset")
        occ = occ.unionByName(pairs(S.kmers(*variants, cfg.k, 1, gap), at, F.lit(False), at % cfg.jump == 0))
    occ = occ.join(vague.withColumnRenamed("kmer", "l"), "l", "left_semi").join(vague.withColumnRenamed("kmer", "r"), "r", "left_semi")
    return compact(occ.select(F.col("l").bitwiseAND(mask).alias("kmer_l"), F.col("r").alias("kmer_r"), "code", "pos", "is_grid"), ("kmer_l", "kmer_r"))


def statistics(index: DataFrame) -> DataFrame:
    """(repeat_cat, n_kmers, n_unique)"""
    return index.groupBy("repeat_cat").agg(F.count("*").alias("n_kmers"), F.count("pos").alias("n_unique"))
