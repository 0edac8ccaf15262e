"""Command line: ``python -m kmerloom index ...`` builds an index, ``python -m kmerloom call ...`` calls structural variants."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import vcf as V
from .plans import pipelines
from .plans.config import Config
from .plans.session import ship
from .sources import files

INDEXED = ("k", "long_k", "spaced_k", "jump", "min_segment", "max_segment", "code_bits", "spaced_left", "flank")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kmerloom", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    usual = Config()
    index = commands.add_parser("index", help="build an index of a genome")
    index.add_argument("--fasta", required=True)
    index.add_argument("--snps", help="VCF of known variants, plain or gzip")
    call = commands.add_parser("call", help="call structural variants from pairs of reads")
    call.add_argument("--r1", required=True)
    call.add_argument("--r2", required=True)
    call.add_argument("--out", required=True, help="folder of the VCF")
    call.add_argument("--sample", default="sample")
    for m in ("r1", "r2"):
        call.add_argument(f"--{m}-barcode", type=int, nargs=3, default=(0, 0, 0), metavar=("START", "LENGTH", "INSERT"), help="from 0; length 0: no barcode")
    call.add_argument("--all-low", action="store_true", help="reject a read only if every base is of low quality")
    for c in (index, call):
        c.add_argument("--index", required=True, help="folder of the index")
        for name in INDEXED:
            c.add_argument("--" + name.replace("_", "-"), type=int, default=getattr(usual, name))
    for name in ("min_indel", "similarity", "max_bp_score", "reliability"):
        call.add_argument("--" + name.replace("_", "-"), type=type(getattr(usual, name)), default=getattr(usual, name))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    fields = {f.name for f in dataclasses.fields(Config)}
    cfg = Config(**{k: v for k, v in vars(a).items() if k in fields})
    spark = spark or SparkSession.builder.appName("kmerloom").getOrCreate()
    ship(spark)
    params = {n: getattr(cfg, n) for n in INDEXED}
    if a.command == "index":
        files.must_exist(spark, a.fasta, *([a.snps] if a.snps else []))
        tables = pipelines.build_index(files.read_fasta(spark, a.fasta), cfg, files.read_snps(spark, a.snps) if a.snps else None)
        tables["contigs"] = tables["contigs"].select("chrom", "chrom_idx", F.length("seq").alias("len"))
        files.write_index(spark, a.index, tables, params)
        return
    files.must_exist(spark, a.r1, a.r2)
    index = files.read_index(spark, a.index, params)
    reads = files.read_fastq_pairs(spark, a.r1, a.r2)
    found = pipelines.find_breakpoints(reads, index, cfg, tuple(a.r1_barcode), tuple(a.r2_barcode), a.all_low)
    files.write_vcf(spark, V.records(pipelines.call_variants(found, index, cfg)), index["contigs"], a.out, a.sample)


if __name__ == "__main__":
    main()
