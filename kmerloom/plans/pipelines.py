"""The two end-to-end plans: build an index, call structural variants."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import index as I
from ..operators import reads as R
from ..operators import supports as P
from ..operators import vcf as V
from .config import Config
from .scratch import cut


def build_index(contigs: DataFrame, cfg: Config, snps: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables ``segments``, ``kmers``, ``long``, ``spaced`` and ``contigs``."""
    segments = cut(I.cut_genome(contigs, I.repeats(contigs, cfg), cfg))
    kmers = cut(I.kmer_index(segments, cfg, snps))
    return {"segments": segments, "kmers": kmers, "long": cut(I.composite_index(segments, kmers, cfg.long_k, cfg, snps)), "spaced": cut(I.composite_index(segments, kmers, cfg.spaced_k, cfg, snps)), "contigs": contigs}


def find_breakpoints(reads: DataFrame, index: dict[str, DataFrame], cfg: Config, r1=(0, 0, 0), r2=(0, 0, 0), all_low: bool = False) -> DataFrame:
    """Breakpoint records of good reads."""
    return R.breakpoints_of_pairs(reads, index["kmers"], index["long"], index["spaced"], cfg, index.get("segments"), r1, r2, all_low)


def call_variants(breakpoints: DataFrame, index: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """Candidates from breakpoint records."""
    segments = index["segments"]
    equal = cut(P.merge_equal(P.from_breakpoints(breakpoints)))
    clustered = cut(P.cluster_splits(equal, segments, cfg))
    pairs = cut(P.merge_equal(P.apart(equal.where("kind = 'PE'")).unionByName(clustered.where("kind = 'PE'"))))
    found = P.add_pairs(pairs, clustered.where("kind = 'SPLIT'"), segments)
    merged = P.merge_ranges(P.canonical(found, segments))
    return V.candidates(merged, segments, cfg)
