"""Candidates: positions, junction geometry, evidence filters and VCF fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.config import Config
from ..plans.scratch import cut
from . import supports as P
from .index import never_broadcast


def breakend_positions(df: DataFrame, k: int) -> DataFrame:
    """left_vcf and right_vcf from segment starts and anchors (V1)."""
    return df.withColumn("left_vcf", F.col("left_start") + F.col("left_pos") + F.when(F.col("left_fwd"), 2).otherwise(k - 1)).withColumn("right_vcf", F.col("right_start") + F.col("right_pos") + F.when(F.col("right_fwd"), k - 1).otherwise(2))


def bnd_alt(seq: Column, chrom: Column, pos: Column, here_fwd: Column, there_fwd: Column) -> Column:
    """The four bracket forms of a breakend."""
    at = F.concat(chrom, F.lit(":"), pos.cast("string"))
    mark = F.when(there_fwd, F.concat(F.lit("["), at, F.lit("["))).otherwise(F.concat(F.lit("]"), at, F.lit("]")))
    return F.when(here_fwd, F.concat(seq, mark)).otherwise(F.concat(mark, seq))


def geometry(df: DataFrame) -> DataFrame:
    """Inserted bases or homology from the identity lengths of both sides, and the moved positions (V2)."""
    total = F.col("left_same") + F.col("right_same")
    plain = total <= F.col("bp_len")
    back = "reverse(translate(substring(seq, 1, bp_len), 'ACGT', 'TGCA'))"
    df = df.withColumn("var_len", F.when(plain, F.col("bp_len") - total + 1).otherwise(1)).withColumn("left_off", F.when(plain, F.col("left_same") - 1).otherwise(F.col("bp_len") - F.col("right_same") - 1)).withColumn("right_off", F.col("right_same") - 1)
    df = df.withColumn("hom_len", F.when(plain, None).otherwise(total - F.col("bp_len")))
    df = df.withColumn("hom_seq", F.when(F.col("hom_len").isNotNull(), F.when(F.col("left_fwd"), F.expr("substring(seq, left_off + 2, hom_len)")).otherwise(F.expr(f"substring({back}, bp_len - left_same + 1, hom_len)"))))
    df = df.withColumn("seq_left", F.when(F.col("left_fwd"), F.expr("substring(seq, left_off + 1, var_len)")).otherwise(F.expr(f"substring({back}, right_off + 2, var_len)")))
    df = df.withColumn("seq_right", F.when(F.col("right_fwd"), F.expr("substring(seq, left_off + 2, var_len)")).otherwise(F.expr(f"substring({back}, right_off + 1, var_len)")))
    return df.withColumn("left_vcf", F.col("left_vcf") + F.when(F.col("left_fwd"), F.col("left_off")).otherwise(-F.col("left_off"))).withColumn("right_vcf", F.col("right_vcf") - F.when(F.col("right_fwd"), F.col("right_off")).otherwise(-F.col("right_off")))


def evidence(df: DataFrame, cfg: Config) -> Column:
    """Whether a candidate has the evidence that a call needs (V6)."""
    lk = F.try_divide(F.col("left_kmers").cast("double"), F.col("left_cnt") + F.col("pe_cnt"))
    rk = F.try_divide(F.col("right_kmers").cast("double"), F.col("right_cnt") + F.col("pe_cnt"))
    m, q = F.col("molecules") - F.col("singles") / 2, F.col("ref_qua") + F.col("var_qua")
    gate = (lk > 2.999) & (rk > 2.999) & (F.col("bpseq_qua") < cfg.max_bp_score) & (F.col("singles") / F.col("molecules") < 0.801)
    ways = ((m > cfg.reliability) & (q > 7.2) & (lk > 3.999) & (rk > 3.999)) | ((m > 5) & (q > 6.7)) | ((m > 7) & (q > 6.2)) | ((F.col("split_cnt") > 6) & (q > 9.5) & (lk > 6.999) & (rk > 6.999) & (F.col("molecules") > 1.999))
    return F.coalesce(gate & ways, F.lit(False))


def small_event(cfg: Config) -> Column:
    return (F.col("left_chrom") == F.col("right_chrom")) & (F.abs(F.col("right_vcf") - F.col("left_vcf")) < cfg.min_indel) & (F.col("var_len") - 1 < cfg.min_indel)


def average_scores(df: DataFrame) -> DataFrame:
    """ref_qua, var_qua and bpseq_qua (A15)."""
    inf = F.lit(float("inf"))
    return (
        df.withColumn("ref_qua", F.coalesce(F.try_divide(F.abs("left_score"), F.col("left_cnt") + F.col("pe_cnt")), F.lit(0.0)))
        .withColumn("var_qua", F.coalesce(F.try_divide(F.abs("right_score"), F.col("right_cnt") + F.col("pe_cnt")), F.lit(0.0)))
        .withColumn("bpseq_qua", F.when(F.col("kind") == "PE", 0.0).when(F.col("split_cnt") == 0, inf).otherwise(F.try_divide(F.col("bp_score_sum"), F.col("split_cnt"))))
    )


def identity_lengths(df: DataFrame, k: int) -> DataFrame:
    """left_same and right_same: how far a junction agrees with the reference that goes on past either anchor (F22, F23)."""

    def after(side: str) -> str:
        return f"substring({side}_ref, {side}_pos + 2, bp_len)"

    def before(side: str) -> str:
        n = f"least(bp_len, greatest(0, {side}_pos + {k - 1}))"
        return f"substring({side}_ref, {side}_pos + {k} - {n}, {n})"

    head = F.expr("substring(seq, 1, bp_len)")
    left = F.when(F.col("left_fwd"), F.expr(after("left"))).otherwise(S.revcomp(F.expr(before("left"))))
    right = F.when(F.col("right_fwd"), S.revcomp(F.expr(before("right")))).otherwise(F.expr(after("right")))
    return df.withColumn("left_same", S.identical_length(head, left)).withColumn("right_same", S.identical_length(S.revcomp(head), right))


def numbered(df: DataFrame, keys: list[str], out: str = "sv_no") -> DataFrame:
    """Adds the place of a row in the order of ``keys``, from 0; the first key is a segment's number, the second a position in it.

    Ranks are local to a stretch of 4,096 positions; the rows of the stretches before are added up in two steps, over a
    segment's stretches and over the segments, which are narrow tables.
    """
    seg, pos = keys[:2]
    df = df.withColumn("_part", F.floor(F.col(pos) / 4096))
    here = [seg, "_part"]
    parts = df.groupBy(*here).count()
    in_segment = F.sum("count").over(Window.partitionBy(seg).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    whole = parts.groupBy(seg).agg(F.sum("count").alias("_n"))
    ahead = whole.select(seg, F.sum("_n").over(Window.orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
    before = parts.withColumn("_before", in_segment).join(ahead, seg).select(*here, (F.coalesce("_before", F.lit(0)) + F.coalesce("_ahead", F.lit(0))).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*here).orderBy(*keys[1:]))
    return df.withColumn("_local", local).join(before, here).withColumn(out, F.col("_before") + F.col("_local") - 1).drop("_part", "_local", "_before")


def event_molecules(df: DataFrame, key: str) -> DataFrame:
    """(key, molecules, singles) from ``barcodes``: a molecule read from either end has its pair of barcodes in one order."""
    b = df.select(key, F.explode("barcodes").alias("b"))
    pair = F.when(F.col("b.flip"), F.struct(F.col("b.bar2").alias("x"), F.col("b.bar1").alias("y"))).otherwise(F.struct(F.col("b.bar1").alias("x"), F.col("b.bar2").alias("y")))
    return P.molecules(b.select(key, pair.alias("bar"), F.col("b.flip").alias("flip")), [key])


def flags(df: DataFrame, cfg: Config) -> DataFrame:
    """small (P17), fake: seen from one side only (P18), imprecise: in pairs only (P19)."""
    return df.withColumn("small", small_event(cfg)).withColumn("fake", F.col("flag") != 3).withColumn("imprecise", F.col("split_cnt") == 0)


def candidates(merged: DataFrame, segments: DataFrame, cfg: Config) -> DataFrame:
    """Supported records with known segments on both sides, located, measured and filtered."""
    s, refs = F.broadcast(segments.select("code", "seg_idx", "chrom", "start")), never_broadcast(segments.select("seg_idx", "ref"))
    df = merged.where("split_cnt + pe_cnt > 0 and right_pos >= 0")
    df = df.join(s.toDF("left_code", "left_seg", "left_chrom", "left_start"), "left_code").join(s.toDF("right_code", "right_seg", "right_chrom", "right_start"), "right_code")
    df = breakend_positions(df, cfg.k)
    split, pe = df.where("kind = 'SPLIT'"), df.where("kind = 'PE'")
    split = split.join(refs.toDF("left_seg", "left_ref"), "left_seg").join(refs.toDF("right_seg", "right_ref"), "right_seg")
    split = identity_lengths(split, cfg.k).drop("left_ref", "right_ref")
    split = geometry(split.where("left_same > 0 and left_same < bp_len and right_same > 0 and right_same < bp_len"))
    for c, kind in (("left_same", "int"), ("right_same", "int"), ("var_len", "int"), ("left_off", "int"), ("right_off", "int"), ("hom_len", "int"), ("hom_seq", "string")):
        pe = pe.withColumn(c, F.lit(0 if c == "var_len" else None).cast(kind))
    pe = pe.withColumn("seq_left", F.lit("N")).withColumn("seq_right", F.lit("N"))
    df = cut(numbered(average_scores(split.unionByName(pe)), ["left_seg", "left_pos", "right_seg", "right_pos", "left_fwd", "right_fwd", "seq", "kind"]))
    df = df.join(event_molecules(df, "sv_no"), "sv_no", "left").withColumn("molecules", F.coalesce("molecules", F.lit(1.0)).cast("double")).withColumn("singles", F.coalesce("singles", F.lit(0)).cast("int"))
    return flags(df.withColumn("pass_evidence", evidence(df, cfg)), cfg)


def _fields(df: DataFrame, side: str, other: str, prefix: str) -> DataFrame:
    left = side == "left"
    filters = F.concat_ws(";", F.when(~F.col("pass_evidence"), "LOW_QUAL"), F.when(F.col("fake"), "FAKE_BP"), F.when(F.col("small"), "SMALL_EVENT"))
    sign = lambda c, plus, minus: F.when(F.col(c), plus).otherwise(minus)
    strands = F.concat(sign("left_fwd", "+", "-"), sign("right_fwd", "+", "-")) if left else F.concat(sign("right_fwd", "-", "+"), sign("left_fwd", "-", "+"))
    qua = ("ref_qua", "var_qua") if left else ("var_qua", "ref_qua")
    info = F.concat_ws(";", sign("imprecise", "IMPRECISE", "PRECISE"), F.lit("SVTYPE=BND"), F.concat(F.lit("STRANDS="), strands), F.format_string("REFQUA=%.2f;VARQUA=%.2f", *qua), F.concat(F.lit("REFKMER="), F.col(f"{side}_kmers").cast("string")), F.concat(F.lit("VARKMER="), F.col(f"{other}_kmers").cast("string")), F.format_string("BPSEQQUA=%.2f", "bpseq_qua"), F.concat(F.lit(f"PARID={prefix}"), F.col("sv_no").cast("string"), F.lit("_2" if left else "_1")), F.when(F.col("hom_seq").isNotNull(), F.concat(F.lit("HOMLEN="), F.length("hom_seq").cast("string"), F.lit(";HOMSEQ="), "hom_seq")))
    seq = F.col(f"seq_{side}")
    here, there = (F.col("left_fwd"), F.col("right_fwd")) if left else (~F.col("right_fwd"), ~F.col("left_fwd"))
    # The reference base is the one next to the anchor: the first base if the sequence comes before the bracket.
    base = F.when(here, F.substring(seq, 1, 1)).otherwise(F.substring(seq, -1, 1))
    sample = F.concat_ws(":", F.lit("./."), *(F.col(c).cast("string") for c in ("split_cnt", "pe_cnt", f"{side}_cnt", f"{other}_cnt", "molecules", "singles")))
    return df.select(
        F.col(f"{side}_chrom").alias("chrom"), F.col(f"{side}_vcf").cast("long").alias("pos"), F.concat(F.lit(prefix), F.col("sv_no").cast("string"), F.lit("_1" if left else "_2")).alias("id"), base.alias("ref"),
        bnd_alt(seq, F.col(f"{other}_chrom"), F.col(f"{other}_vcf"), here, there).alias("alt"), F.lit(".").alias("qual"), F.when(filters == "", "PASS").otherwise(filters).alias("filter"), info.alias("info"),
        F.lit("GT:SR:PE:REFSR:VARSR:BAR:UBAR").alias("format"), sample.alias("sample"), F.col(f"{side}_seg").alias("seg_idx"), F.col(f"{side}_pos").alias("anchor"),
    )


def records(cands: DataFrame, prefix: str = "sv") -> DataFrame:
    """Two breakend records for each candidate."""
    return _fields(cands, "left", "right", prefix).unionByName(_fields(cands, "right", "left", prefix))
