"""Sequence functions on columns: packing, complement, windows, codes. Packed k-mers have two bits a base, k <= 31."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed as N


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def pack(kmer: Column) -> Column:
    """A k-mer as a long; null where it is empty or has a letter other than A, C, G, T."""
    return F.when((F.translate(kmer, "ACGT", "") == "") & (kmer != ""), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def unpack(packed: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed_complement(packed: Column, k: int) -> Column:
    """Complement of every base of a packed k-mer, order kept."""
    return packed.bitwiseXOR(F.lit((1 << 2 * k) - 1))


def packed_revcomp(packed: Column, k: int) -> Column:
    """The packed reverse complement of a packed k-mer: groups of two bits change places by halves."""
    x = F.bitwise_not(packed)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), shift).bitwiseOR(F.shiftright(x, shift).bitwiseAND(F.lit(mask)))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def barcode(seq: Column, start: int, length: int) -> Column:
    return pack(F.substring(seq, start, length))


def mismatched_bases(a: Column, b: Column) -> Column:
    """Number of bases in which two packed k-mers differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _kinds(df: DataFrame, seq: str, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != seq), more])


def kmers(df: DataFrame, seq: str, k: int, step: int = 1, gap: int | None = None) -> DataFrame:
    """One row for each window at offsets 0, step, 2 step, ...: the columns of df but ``seq``, offset and the packed kmer.

    Windows with a letter other than A, C, G, T are left out. With a ``gap``, ``kmer2`` is the k-mer that begins so many
    bases after ``kmer``; both must be whole. Work and memory are linear in the bases, however long a row is.
    """
    more = "offset int, kmer long" + (", kmer2 long" if gap is not None else "")
    return df.mapInArrow(N.window_batches(seq, k, step, gap), _kinds(df, seq, more))


def n_free_runs(df: DataFrame, seq: str) -> DataFrame:
    """One row for each run without N: the columns of df but ``seq``, start and end (exclusive)."""
    return df.mapInArrow(N.run_batches(seq), _kinds(df, seq, "start int, end int"))


def neighbours(packed: Column, k: int) -> Column:
    """The 3k packed k-mers that differ in one base."""
    masks = F.array(*(F.lit(x << 2 * i) for i in range(k) for x in (1, 2, 3)))
    return F.transform(masks, lambda m: packed.bitwiseXOR(m))


def identical_length(a: Column, b: Column) -> Column:
    """Matching bases of a prefix: a mismatch is stepped over if the next base matches, two in a row end it."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    marks = F.concat(F.array_join(F.transform(at, lambda i: F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), "1").otherwise("0")), ""), F.lit("0"))
    return F.length(F.replace(F.split_part(marks, F.lit("00"), F.lit(1)), F.lit("0"), F.lit(""))).cast("int")


def cardinality(code: Column, n: int) -> Column:
    """-1, 0 or 1 as a code has fewer than, exactly or more than n bits."""
    return F.signum(F.bit_count(code) - n).cast("int")


def is_prefix(seq_a: Column, len_a: Column, seq_b: Column, len_b: Column) -> Column:
    """Whether the shorter junction is a prefix of the longer."""
    n = F.least(len_a, len_b)
    return F.substring(seq_a, F.lit(1), n) == F.substring(seq_b, F.lit(1), n)


def code_count(bits: int = 5) -> int:
    """Number of segment codes: sets of ``bits`` of 32 bits."""
    return comb(32, bits)


def segment_code(number: Column, bits: int = 5) -> Column:
    """The code of a segment: a distinct set of ``bits`` of 32 bits, by unranking a combination; more segments than codes are an error."""
    total = code_count(bits)
    table = F.array(*(F.lit(comb(b, n)).cast("long") for b in range(32) for n in range(bits + 1)))
    start = F.struct(F.pmod(number.cast("long") * 104729, F.lit(total)).cast("long").alias("rank"), F.lit(0).cast("long").alias("code"), F.lit(bits).alias("left"))

    def step(acc: Column, bit: Column) -> Column:
        ways = F.element_at(table, bit * (bits + 1) + acc["left"] + 1)
        take = (acc["left"] > 0) & (acc["rank"] >= ways)
        return F.struct(
            (acc["rank"] - F.when(take, ways).otherwise(F.lit(0).cast("long"))).alias("rank"),
            F.when(take, acc["code"] + F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(acc["code"]).alias("code"),
            (acc["left"] - F.when(take, 1).otherwise(0)).alias("left"),
        )

    code = F.aggregate(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["code"])
    return F.when(number < total, code).otherwise(F.raise_error(F.lit(f"over {total} segments: take longer ones")).cast("long"))
