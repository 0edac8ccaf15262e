"""Readers and writers: FAI, FASTA, FASTQ pairs, SNP VCF, index tables, SV VCF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reads as R


def _chrom(c):
    return F.when(c.contains("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, len, start_byte, line_bases, line_bytes); a row without exactly five columns is an error."""
    cols = F.split("value", "\t")
    text = spark.read.text(path).where("value <> ''").withColumn("c", F.when(F.size(cols) == 5, cols).otherwise(F.raise_error(F.concat(F.lit("not an index row: "), "value"))))
    return text.select(_chrom(F.col("c")[0]).alias("chrom"), F.col("c")[1].cast("int").alias("len"), F.col("c")[2].cast("long").alias("start_byte"), F.col("c")[3].cast("int").alias("line_bases"), F.col("c")[4].cast("int").alias("line_bytes"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, chrom_idx, seq): upper-cased contigs in file order; a record is split off at each '>' by Spark's reader."""
    rec = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    seq = F.upper(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), "\\s", ""))
    out = rec.select(_chrom(F.regexp_extract("value", r"^(\S+)", 1)).alias("chrom"), "at", seq.alias("seq"))
    order = out.select("chrom", (F.row_number().over(Window.orderBy("at")) - 1).alias("chrom_idx"))  # names only
    return out.join(F.broadcast(order), "chrom").select("chrom", "chrom_idx", "seq")


def must_exist(spark: SparkSession, *paths: str) -> None:
    """Fails on the first path (or pattern) that matches no file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        if found is None or not len(found):
            raise FileNotFoundError(path)


def read_range(spark: SparkSession, fasta: str, fai: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(chrom, seq): bases start..end-1 of a contig, counted from 1; only their bytes are read, found by the FAI row."""
    row = fai.where(F.col("chrom") == chrom).first()
    if row is None:
        raise ValueError(f"no contig {chrom}")
    start, end = max(1, start), min(end, row.len + 1)
    place = lambda i: row.start_byte + i // row.line_bases * row.line_bytes + i % row.line_bases
    size = max(0, place(end - 2) + 1 - place(start - 1)) if end > start else 0
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(fasta)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(place(start - 1))
        raw = bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()
    return spark.createDataFrame([(chrom, b"".join(raw.split()).decode("ascii").upper())], "chrom string, seq string")


def sequence(contigs: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(chrom, seq) of a whole contig, or of its bases start..end-1 counted from 1."""
    one = contigs.where(F.col("chrom") == chrom)
    return one.select("chrom", "seq" if start is None else F.expr(f"substring(seq, {start}, {end - start})").alias("seq"))


def contig_info(contigs: DataFrame) -> DataFrame:
    """(chrom, chrom_idx, len) in genome order, of contigs or of an index's table of them."""
    size = F.col("len") if "len" in contigs.columns else F.length("seq").alias("len")
    return contigs.select("chrom", "chrom_idx", size).orderBy("chrom_idx")


def _assembled(before: dict[int, int]):
    """Whole records of a partition's lines, and the lines of records that begin or end in another one."""
    import pyarrow as pa

    names = ["ordinal", "head", "seq", "plus", "qual", "line", "value"]

    def whole(first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines) // 4
        none = pa.nulls(n, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), *(pa.array(lines[k::4], pa.string()) for k in range(4)), pa.nulls(n, pa.int32()), none], names=names)

    def single(at: int, line: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at // 4], pa.int64()), *(pa.nulls(1, pa.string()) for _ in range(4)), pa.array([at % 4], pa.int32()), pa.array([line], pa.string())], names=names)

    def work(batches):
        at, held = None, []
        for b in batches:
            lines = b.column("value").to_pylist()
            if at is None and lines:
                at = before[b.column("part")[0].as_py()]
            while lines and not held and at % 4:  # the end of a record that began in an earlier partition
                yield single(at, lines.pop(0))
                at += 1
            held += lines
            n = len(held) // 4 * 4
            if n:
                yield whole(at // 4, held[:n])
                held, at = held[n:], at + n
        for k, line in enumerate(held):
            yield single(at + k, line)

    return work


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, seq, qual) of FASTQ records in file order.

    A first pass counts the lines of each partition, which gives each its first line's number. Records are then put
    together where they are read; only those that two partitions share (at most one for each border) are shuffled.
    """
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("part"))
    sizes = {r[0]: r[1] for r in lines.groupBy("part").count().collect()}  # one number for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if total % 4:
        raise ValueError(f"{path}: {total} lines are no whole records")
    made = lines.mapInArrow(_assembled(before), "ordinal long, head string, seq string, plus string, qual string, line int, value string")
    take = lambda k: F.max(F.when(F.col("line") == k, F.col("value")))
    shared = made.where("line is not null").groupBy("ordinal").agg(take(0).alias("head"), take(1).alias("seq"), take(2).alias("plus"), take(3).alias("qual"))
    rec = made.where("line is null").select("ordinal", "head", "seq", "plus", "qual").unionByName(shared)
    bad = ~F.col("head").startswith("@") | ~F.col("plus").startswith("+")
    return rec.select("ordinal", F.when(bad, F.raise_error(F.concat(F.lit("not a record: "), "head"))).otherwise(F.expr("substring(head, 2)")).alias("name"), F.upper("seq").alias("seq"), F.expr("substring(qual, 1, length(seq))").alias("qual"))


def read_fastq_pairs(spark: SparkSession, r1: str, r2: str) -> DataFrame:
    """(read_id, name, r1_seq, r1_qual, r2_seq, r2_qual): mates by their place in the files; every pair's names are checked.

    Mates are in different files, so one join by ordinal shuffles each record once.
    """
    must_exist(spark, r1, r2)
    a, b = _records(spark, r1), _records(spark, r2)
    j = a.select(F.col("ordinal").alias("read_id"), "name", F.col("seq").alias("r1_seq"), F.col("qual").alias("r1_qual")).join(b.select(F.col("ordinal").alias("read_id"), F.col("name").alias("name2"), F.col("seq").alias("r2_seq"), F.col("qual").alias("r2_qual")), "read_id", "full")
    whole = F.when(F.col("name").isNull() | F.col("name2").isNull(), F.raise_error(F.lit("the files have different numbers of reads"))).otherwise(F.col("name"))
    return R.same_names(j.withColumn("name", whole)).drop("name2")


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt): first alternative; of rows at one position of a chromosome, the first in the file."""
    raw = spark.read.text(path).where("value <> '' and not startswith(value, '#')").withColumn("at", F.monotonically_increasing_id())
    c = F.split("value", "\t")
    rows = raw.select("at", _chrom(c[0]).alias("chrom"), c[1].cast("int").alias("pos"), F.upper(c[3]).alias("ref"), F.upper(F.split(c[4], ",")[0]).alias("alt"))
    return rows.groupBy("chrom", "pos").agg(F.min(F.struct("at", "ref", "alt")).alias("m")).select("chrom", "pos", "m.ref", "m.alt")


def write_index(spark: SparkSession, path: str, tables: dict[str, DataFrame], params: dict) -> None:
    """Each table as Parquet, k-mer tables sorted by key; the parameters beside them."""
    for name, df in tables.items():
        keys = [c for c in ("kmer", "kmer_l") if c in df.columns]  # sorted, so that look-ups skip row groups
        (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def read_index(spark: SparkSession, path: str, params: dict) -> dict[str, DataFrame]:
    """The tables of an index; parameters that differ are an error."""
    must_exist(spark, f"{path}/params")
    have = json.loads(spark.read.text(f"{path}/params").first()[0])
    if have != json.loads(json.dumps(params)):
        raise ValueError(f"{path} was built with {have}, not {params}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("segments", "kmers", "long", "spaced", "contigs")}


HEADER = (
    ("FILTER", "PASS", None, None, "All filters passed"), ("FILTER", "LOW_QUAL", None, None, "Low quality call"), ("FILTER", "FAKE_BP", None, None, "Breakpoint seen from one side only"),
    ("FILTER", "SMALL_EVENT", None, None, "Event is smaller than the least size"), ("INFO", "PRECISE", "0", "Flag", "Junction seen in split reads"), ("INFO", "IMPRECISE", "0", "Flag", "Pairs only"),
    ("INFO", "SVTYPE", "1", "String", "Type of structural variant"), ("INFO", "STRANDS", ".", "String", "Strands of the adjacency"), ("INFO", "REFQUA", "1", "Float", "Mapping quality of this side"),
    ("INFO", "VARQUA", "1", "Float", "Mapping quality of the other side"), ("INFO", "REFKMER", "1", "Integer", "K-mers of this side"), ("INFO", "VARKMER", "1", "Integer", "K-mers of the other side"),
    ("INFO", "BPSEQQUA", "1", "Float", "Quality of the junction's sequence"), ("INFO", "PARID", "1", "String", "Partner breakend"), ("INFO", "HOMLEN", ".", "Integer", "Length of homology"), ("INFO", "HOMSEQ", ".", "String", "Bases of homology"),
    ("FORMAT", "GT", "1", "String", "Genotype"), ("FORMAT", "SR", "1", "Integer", "Split reads"), ("FORMAT", "PE", "1", "Integer", "Read pairs"), ("FORMAT", "REFSR", "1", "Integer", "Split reads of this side"),
    ("FORMAT", "VARSR", "1", "Integer", "Split reads of the other side"), ("FORMAT", "BAR", "1", "Float", "Molecules"), ("FORMAT", "UBAR", "1", "Integer", "Molecules with one read"),
)


def vcf_header(contigs: list[tuple[str, int]], sample: str) -> list[str]:
    out = ["##fileformat=VCFv4.2", "##source=kmerloom"]
    for kind, name, number, typ, text in HEADER:
        more = f",Number={number},Type={typ}" if number else ""
        out.append(f'##{kind}=<ID={name}{more},Description="{text}">')
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def write_vcf(spark: SparkSession, records: DataFrame, contigs: DataFrame, path: str, sample: str = "sample") -> None:
    """A sorted, gzipped VCF in one file; calls are few."""
    head = vcf_header([(r.chrom, r.len) for r in contig_info(contigs).collect()], sample)
    header = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(head)], "part int, a long, b long, line string")
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    body = records.select(F.lit(1).alias("part"), F.col("seg_idx").cast("long").alias("a"), F.col("anchor").cast("long").alias("b"), F.concat_ws("\t", *(F.col(c).cast("string") for c in cols)).alias("line"))
    header.unionByName(body).coalesce(1).sortWithinPartitions("part", "a", "b", "line").select("line").write.mode("overwrite").option("compression", "gzip").text(path)


def write_flat(records: DataFrame, path: str) -> None:
    """The same records as tab-separated rows, without a header and in many files."""
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    records.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in cols)).alias("line")).write.mode("overwrite").text(path)
