"""Registered queries over the whole supplied tables, and the same in SQL where SQL can express them.

The tables hold no DNA; fixtures derive contigs, reads, variants and support records from them (see ``fixtures``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import seq as S
from ..operators import index as I
from ..operators import reads as R
from ..operators import supports as P
from ..operators import vcf as V
from . import fixtures as X
from . import pipelines
from .config import Config

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "e2e_sv_calls"
CFG = Config(min_segment=2000, max_segment=4000)
K = CFG.k


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Shared SQL

ACGT = "NOT regexp_matches({}, '[^ACGT]')"
REV = "reverse(translate({}, 'ACGT', 'TGCA'))"
PACK = "CAST(list_sum(list_transform(range(0, {k}), lambda i: (instr('ACGT', substr({s}, CAST(i + 1 AS BIGINT), 1)) - 1) * (CAST(1 AS BIGINT) << CAST(2 * ({k} - 1 - i) AS INT)))) AS BIGINT)"
KMER = PACK.format(s="kmer", k=K)
CONTIGS, READS = X.CONTIGS_SQL, X.READS_SQL
_TILES = """tiles AS (SELECT CAST(row_number() OVER (ORDER BY chrom_idx, t) - 1 AS INT) AS seg_idx, chrom, CAST(t * 2000 AS INT) AS "start", CAST(least(length(seq), (t + 1) * 2000 + 22) AS INT) AS "end", seq
  FROM contigs, unnest(range(0, CAST(greatest(1, ceil(length(seq) / 2000)) AS BIGINT))) u(t)),
segments AS (SELECT seg_idx, chrom, "start", "end", (CAST(31 AS BIGINT) << (seg_idx % 28)) AS code, substr(seq, "start" + 1, "end" - "start") AS bases FROM tiles)"""
_OCC = f"""fwd AS (SELECT seg_idx, code, CAST(i AS INT) AS pos, substr(bases, CAST(i + 1 AS BIGINT), {K}) AS kmer FROM segments, unnest(range(0, length(bases) - {K - 1})) u(i)),
occ AS (SELECT kmer, code, pos, pos % 3 = 0 AS is_grid FROM fwd UNION ALL SELECT {REV.format("kmer")}, code, pos, false FROM fwd)"""
_IDX = "idx AS (SELECT kmer, bit_or(code) AS code, CASE WHEN count(*) = 1 THEN min(pos) END AS pos FROM occ GROUP BY kmer HAVING bool_or(is_grid))"
_CATS = f"""marked AS (SELECT kmer, CASE WHEN code = 4294967295 THEN 2 ELSE 1 END AS cat FROM idx WHERE bit_count(code) > 5),
gridk AS (SELECT seg_idx, f.pos, f.kmer, cat FROM fwd f JOIN marked USING (kmer) WHERE f.pos % 3 = 0),
seeds AS (SELECT kmer, cat FROM marked UNION SELECT b.kmer, CASE WHEN g.cat = 2 AND h.cat = 2 THEN 2 ELSE 1 END FROM gridk g JOIN gridk h ON h.seg_idx = g.seg_idx AND h.pos = g.pos + 3
  JOIN fwd b ON b.seg_idx = g.seg_idx AND b.pos > g.pos AND b.pos < h.pos),
ways AS (SELECT kmer, cat FROM seeds UNION SELECT {REV.format("kmer")}, cat FROM seeds),
near AS (SELECT substr(kmer, 1, CAST(i - 1 AS BIGINT)) || x || substr(kmer, CAST(i + 1 AS BIGINT)) AS kmer, cat FROM ways, unnest(range(1, {K + 1})) a(i), unnest(['A', 'C', 'G', 'T']) b(x) WHERE substr(kmer, CAST(i AS BIGINT), 1) <> x),
cats AS (SELECT kmer, CAST(bit_or(cat) AS INT) AS repeat_cat FROM near JOIN (SELECT kmer FROM idx WHERE pos IS NOT NULL) USING (kmer) GROUP BY 1),
scored AS (SELECT kmer, code, pos, coalesce(repeat_cat, 0) AS repeat_cat FROM idx LEFT JOIN cats USING (kmer))"""
TILES = f"{CONTIGS}, {_TILES}"
OCC = f"{TILES}, {_OCC}"
INDEX = f"{OCC}, {_IDX}"
SCORED = f"{INDEX}, {_CATS}"
COPIES = f"{X.COPIES_SQL}, {_TILES}"
CODES = """codes AS (SELECT row_number() OVER (ORDER BY c) - 1 AS rank, c AS code FROM (
  SELECT (CAST(1 AS BIGINT) << a) + (CAST(1 AS BIGINT) << b) + (CAST(1 AS BIGINT) << c) + (CAST(1 AS BIGINT) << d) + (CAST(1 AS BIGINT) << e) AS c
  FROM range(32) t1(a) JOIN range(32) t2(b) ON b < a JOIN range(32) t3(c) ON c < b JOIN range(32) t4(d) ON d < c JOIN range(32) t5(e) ON e < d))"""
REPEATS = f"rep AS (SELECT substr(seq, CAST(i + 1 AS BIGINT), {K}) AS kmer, count(*) AS n FROM contigs, unnest(range(0, length(seq) - {K - 1}, 3)) u(i) GROUP BY 1 HAVING count(*) >= 2)"
CUT = f"""{CONTIGS}, {REPEATS},
place AS (SELECT chrom, CAST(i AS INT) AS i, substr(seq, CAST(i + 1 AS BIGINT), {K}) IN (SELECT kmer FROM rep) AS bad FROM contigs, unnest(range(0, length(seq))) u(i)),
good AS (SELECT *, CASE WHEN NOT bad AND NOT lag(bad) OVER (PARTITION BY chrom ORDER BY i) THEN i END AS g FROM place),
ahead AS MATERIALIZED (SELECT chrom, i AS "start", CASE WHEN g2 < i + {CFG.max_segment} THEN g2 ELSE i + {CFG.max_segment} END AS next FROM
  (SELECT *, min(g) OVER (PARTITION BY chrom ORDER BY i RANGE BETWEEN {CFG.min_segment + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS g2 FROM good)),
walk AS (SELECT chrom, CAST(0 AS INT) AS "start" FROM contigs UNION ALL SELECT w.chrom, CAST(a.next AS INT) FROM walk w JOIN ahead a ON a.chrom = w.chrom AND a."start" = w."start" JOIN contigs c ON c.chrom = w.chrom WHERE length(c.seq) - w."start" > {CFG.max_segment}),
cuts AS (SELECT CAST(row_number() OVER (ORDER BY chrom_idx, "start") - 1 AS INT) AS seg_idx, chrom, chrom_idx, "start",
  CAST(coalesce(least(length(seq), lead("start") OVER (PARTITION BY chrom ORDER BY "start") + {K - 1}), length(seq)) AS INT) AS "end", seq FROM walk JOIN contigs USING (chrom)),
{CODES},
segments AS (SELECT seg_idx, chrom, chrom_idx, "start", "end", code, substr(seq, "start" + 1, "end" - "start") AS bases FROM cuts JOIN codes ON rank = (seg_idx * 104729) % 201376)"""
SUPPORTS = f"""sup AS (
  SELECT {X.ROW_ID} AS sup_id, CASE WHEN l_linenumber % 4 = 0 THEN 'PE' ELSE 'SPLIT' END AS kind,
         CAST(l_suppkey % 25 AS INT) AS left_seg, CAST(l_partkey % 25 AS INT) AS right_seg, CAST((l_orderkey * 7) % 2000 AS INT) AS left_pos, CAST((l_partkey * 13) % 2000 AS INT) AS right_pos,
         l_linestatus = 'O' AS left_fwd, l_returnflag = 'R' AS right_fwd, l_orderkey % 97 AS bar, l_linenumber % 2 = 0 AS flip,
         CAST(l_quantity AS BIGINT) AS left_kmers, CAST(l_quantity AS BIGINT) + l_linenumber AS right_kmers, l_linenumber AS cnt, l_extendedprice AS score FROM lineitem)"""


def tiles(spark: SparkSession, sf_dir: str, bases: Column | None = None) -> DataFrame:
    """Segments for queries that SQL checks: pieces of 2,000 bases with k - 1 more, and codes of five bits in a row."""
    t = X.tiles(spark, sf_dir, 2000, K - 1, bases).withColumnsRenamed({"tile_idx": "seg_idx", "seq": "ref"})
    return t.select("seg_idx", "chrom", "chrom_idx", "start", "end", F.expr("shiftleft(31L, seg_idx % 28)").alias("code"), "ref")


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").selectExpr(
        f"{X.ROW_ID} as sup_id", "case when l_linenumber % 4 = 0 then 'PE' else 'SPLIT' end as kind", "cast(l_suppkey % 25 as int) as left_seg", "cast(l_partkey % 25 as int) as right_seg",
        "cast((l_orderkey * 7) % 2000 as int) as left_pos", "cast((l_partkey * 13) % 2000 as int) as right_pos", "l_linestatus = 'O' as left_fwd", "l_returnflag = 'R' as right_fwd", "l_orderkey % 97 as bar", "l_linenumber % 2 = 0 as flip",
        "cast(l_quantity as bigint) as left_kmers", "cast(l_quantity as bigint) + l_linenumber as right_kmers", "l_linenumber as cnt", "l_extendedprice as score",
    )


# Sources and contigs


@query(f"WITH {CONTIGS} SELECT chrom, chrom_idx, CAST(length(seq) AS INT) AS len FROM contigs")
def s5_contig_info(spark, d):
    from ..sources.files import contig_info

    return contig_info(X.contigs(spark, d))


@query(f"WITH {CONTIGS} SELECT chrom, substr(seq, 101, 400) AS seq FROM contigs WHERE chrom = 'chr3'")
def s2_range_scan(spark, d):
    from ..sources.files import sequence

    return sequence(X.contigs(spark, d), "chr3", 101, 501)


@query(f"WITH {CONTIGS} SELECT chrom, seq FROM contigs WHERE chrom = 'chr2'")
def s3_contig_scan(spark, d):
    from ..sources.files import sequence

    return sequence(X.contigs(spark, d), "chr2")


@query(f"WITH {CONTIGS}, {READS} SELECT read_id, split_part(name || '/1', '/', 1) AS name FROM reads")
def s9_pair_names(spark, d):
    r = X.reads(spark, d).select("read_id", F.concat("name", F.lit("/1")).alias("name"), F.concat("name", F.lit("/2")).alias("name2"))
    return R.same_names(r).drop("name2")


# Sequence functions


def _dna(spark, d):
    return X.table(spark, d, "part").select("p_partkey", X.dna(F.col("p_partkey")).alias("s"))


_NEAR_COPY_SQL = "concat(substr(s, 1, cast(p_partkey % 29 as int)), 'AC', substr(s, cast(p_partkey % 29 + 3 as int)))"
_SIZE, _WINDOW = "(40 + read_id % 200)", "substr(fragment, cast(greatest(1, 40 + read_id % 200 - 99) as int), cast(least(100, 40 + read_id % 200) as int))"
MATES = {
    "r1": f"case when {_SIZE} < 100 then concat(substr(fragment, 1, cast({_SIZE} as int)), repeat('AGATCGGAAG', 6)) else substr(fragment, 1, 100) end",
    "r2": f"reverse(translate(concat(repeat('CTTCCGATCT', case when {_SIZE} < 100 then 6 else 0 end), case when read_id % 3 = 0 then concat(substr({_WINDOW}, 1, 30), translate(substr({_WINDOW}, 31, 1), 'ACGT', 'CGTA'), substr({_WINDOW}, 32)) else {_WINDOW} end), 'ACGT', 'TGCA'))",
}

DNA = f"SELECT p_partkey, {X.DNA_SQL.format('p_partkey')} AS s FROM part"


@query(f"WITH t AS ({DNA}) SELECT p_partkey, {PACK.format(s='s', k=23)} AS packed FROM t")
def f1_pack_kmer(spark, d):
    return _dna(spark, d).select("p_partkey", S.pack(F.substring("s", 1, 23)).alias("packed"))


@query(f"WITH t AS ({DNA}) SELECT p_partkey, CAST(i AS INT) AS \"offset\", substr(s, CAST(i + 1 AS BIGINT), 11) AS kmer FROM t, unnest(range(0, 22, 3)) u(i)")
def f2_windows(spark, d):
    return S.kmers(_dna(spark, d), "s", 11, 3).select("p_partkey", "offset", S.unpack(F.col("kmer"), 11).alias("kmer"))


@query(f"WITH t AS ({DNA}) SELECT p_partkey, {REV.format('s')} AS rc, {REV.format('substr(s, 1, 23)')} AS packed FROM t")
def f3_reverse_complement(spark, d):
    packed = S.unpack(S.packed_revcomp(S.pack(F.substring("s", 1, 23)), 23), 23)
    return _dna(spark, d).select("p_partkey", S.revcomp(F.col("s")).alias("rc"), packed.alias("packed"))


@query(f"WITH t AS ({DNA}) SELECT p_partkey, substr(s, 1, 23) AS kmer FROM t")
def f7_unpack(spark, d):
    return _dna(spark, d).select("p_partkey", S.unpack(S.pack(F.substring("s", 1, 23)), 23).alias("kmer"))


@query(f"WITH t AS ({DNA}) SELECT p_partkey, {PACK.format(s='substr(s, 11, 8)', k=8)} AS bar FROM t")
def f8_barcode(spark, d):
    return _dna(spark, d).select("p_partkey", S.barcode(F.col("s"), 11, 8).alias("bar"))


@query(f"""WITH t AS ({DNA}) SELECT p_partkey, CAST(list_sum(list_transform(range(1, 24), lambda i: CASE WHEN substr(s, CAST(i AS BIGINT), 1) = substr({X.DNA_SQL.format('p_partkey + 1')}, CAST(i AS BIGINT), 1) THEN 0 ELSE 1 END)) AS INT) AS mismatches FROM t""")
def f9_mismatched_bases(spark, d):
    t = _dna(spark, d).withColumn("o", X.dna(F.col("p_partkey") + 1))
    return t.select("p_partkey", S.mismatched_bases(S.pack(F.substring("s", 1, 23)), S.pack(F.substring("o", 1, 23))).cast("int").alias("mismatches"))


@query(f"WITH {TILES}, {CODES} SELECT seg_idx, codes.code FROM segments JOIN codes ON rank = (seg_idx * 104729) % 201376")
def f10_segment_codes(spark, d):
    return I.number(tiles(spark, d).drop("code", "seg_idx"), CFG).select("seg_idx", "code")


@query("SELECT l_orderkey, l_linenumber, CAST(sign(bit_count(CAST((l_partkey * 2654435761) % 4294967296 AS BIGINT)) - 14) AS INT) AS cmp FROM lineitem")
def f11_code_cardinality(spark, d):
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.cardinality(F.expr("(l_partkey * 2654435761L) % 4294967296L"), 14).alias("cmp"))


@query(f"""WITH t AS ({DNA}), p AS (SELECT p_partkey, {PACK.format(s='s', k=11)} AS v FROM t)
SELECT p_partkey, xor(v, CAST(x << CAST(2 * i AS INT) AS BIGINT)) AS neighbour FROM p, unnest(range(0, 11)) a(i), unnest([CAST(1 AS BIGINT), 2, 3]) b(x)""")
def f15_neighbours(spark, d):
    return _dna(spark, d).select("p_partkey", F.explode(S.neighbours(S.pack(F.substring("s", 1, 11)), 11)).alias("neighbour"))


@query("""SELECT a.doc_id, b.doc_id AS other, substr(a.text, 1, least(length(a.text), length(b.text))) = substr(b.text, 1, least(length(a.text), length(b.text))) AS is_prefix
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def f16_prefix(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", "text")
    j = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("text").alias("t2")), "doc_id")
    return j.select("doc_id", "other", S.is_prefix(F.col("text"), F.length("text"), F.col("t2"), F.length("t2")).alias("is_prefix"))


@query(f"WITH t AS ({DNA}) SELECT p_partkey, count(DISTINCT substr(s, CAST(i AS BIGINT), 11)) AS n FROM t, unnest(range(1, 23)) u(i) GROUP BY 1")
def f19_kmer_set(spark, d):
    @F.pandas_udf("long")
    def size(s):
        return s.map(lambda x: len(kernels.kmer_set(x, CFG.merge_k)))

    return _dna(spark, d).select("p_partkey", size("s").alias("n"))


@query(f"""WITH t AS ({DNA}), two AS (SELECT p_partkey, s AS a, {_NEAR_COPY_SQL} AS b FROM t),
w AS (SELECT p_partkey, CAST(i AS INT) AS i, contains(a, substr(b, CAST(i + 1 AS BIGINT), 11)) AS b_in_a, contains(b, substr(a, CAST(i + 1 AS BIGINT), 11)) AS a_in_b, a, b FROM two, unnest(range(0, 22)) u(i)),
r AS (SELECT *, coalesce(lag(b_in_a) OVER o, false) AS p_b, coalesce(lag(a_in_b) OVER o, false) AS p_a FROM w WINDOW o AS (PARTITION BY p_partkey ORDER BY i)),
m AS (SELECT p_partkey, CAST(i AS INT) AS i, substr(a, CAST(i AS BIGINT), 1) = substr(b, CAST(i AS BIGINT), 1) AS eq FROM two, unnest(range(1, 33)) u(i)),
e AS (SELECT p_partkey, min(CASE WHEN NOT eq AND NOT coalesce(nx, false) THEN i ELSE 33 END) AS stop FROM (SELECT *, lead(eq) OVER (PARTITION BY p_partkey ORDER BY i) AS nx FROM m) GROUP BY 1),
same AS (SELECT m.p_partkey, CAST(count(*) FILTER (WHERE eq AND i < stop) AS INT) AS same FROM m JOIN e USING (p_partkey) GROUP BY 1)
SELECT r.p_partkey, 1 - CAST(count(*) FILTER (WHERE b_in_a) + 10 * count(*) FILTER (WHERE b_in_a AND NOT p_b) AS DOUBLE) / 32 AS distance,
1 - CAST(count(*) FILTER (WHERE a_in_b) + 10 * count(*) FILTER (WHERE a_in_b AND NOT p_a) AS DOUBLE) / 32 AS reference, any_value(same) AS same FROM r JOIN same USING (p_partkey) GROUP BY 1""")
def f20_f22_distances(spark, d):
    """k-mer distances and identity length of a sequence and a copy of it with two changes."""

    @F.pandas_udf("distance double, reference double")
    def both(a, b):
        import pandas as pd

        return pd.DataFrame([(kernels.sequence_distance(x, y), kernels.reference_distance(x, y)) for x, y in zip(a, b)], columns=["distance", "reference"])

    t = _dna(spark, d).withColumn("o", F.expr(_NEAR_COPY_SQL))
    return t.withColumn("m", both("s", "o")).select("p_partkey", "m.distance", "m.reference", S.identical_length(F.col("s"), F.col("o")).alias("same"))


@query(f"WITH {SUPPORTS} SELECT sup_id, right_pos AS left_pos, left_pos AS right_pos, NOT right_fwd AS left_fwd, NOT left_fwd AS right_fwd, right_kmers AS left_kmers, left_kmers AS right_kmers, {REV.format('substr(dna, 1, 20)')} AS seq, bar + 1 AS bar1, bar AS bar2, NOT flip AS flip FROM (SELECT *, {X.DNA_SQL.format('bar')} AS dna FROM sup)")
def f24_turn(spark, d):
    s = supports(spark, d).withColumn("seq", X.dna(F.col("bar"))).withColumn("bp_len", F.lit(20)).withColumn("barcodes", F.array(F.struct(F.col("bar").alias("bar1"), (F.col("bar") + 1).alias("bar2"), "flip")))
    return P.turned(s, F.lit(True)).select("sup_id", "left_pos", "right_pos", "left_fwd", "right_fwd", "left_kmers", "right_kmers", "seq", F.col("barcodes")[0]["bar1"].alias("bar1"), F.col("barcodes")[0]["bar2"].alias("bar2"), F.col("barcodes")[0]["flip"].alias("flip"))


# Projections and filters

MASKED_READS = {
    "r1_seq": "case when read_id % 13 = 0 then concat(substr(r1_seq, 1, 50), 'N', substr(r1_seq, 52)) else r1_seq end",
    "r2_seq": "case when read_id % 17 = 0 then concat('N', substr(r2_seq, 2)) else r2_seq end",
    "r1_low": "cast(read_id % 101 as int)",
    "r2_low": "cast(read_id * 7 % 43 as int)",
}
_MASKED_READS_SQL = "masked AS (SELECT read_id, " + ", ".join(f"{x} AS {c}" for c, x in MASKED_READS.items()) + " FROM reads)"
MASKED = "translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACNN')"


@query(f"""WITH t AS (SELECT p_partkey, {MASKED} AS s FROM part),
c AS (SELECT p_partkey, CAST(i AS INT) AS i, substr(s, CAST(i + 1 AS BIGINT), 1) = 'N' AS n FROM t, unnest(range(0, 32)) u(i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, n ORDER BY i) AS grp FROM c)
SELECT p_partkey, min(i) AS "start", max(i) + 1 AS "end" FROM g WHERE NOT n GROUP BY p_partkey, grp""")
def p1_n_free_runs(spark, d):
    t = X.table(spark, d, "part").select("p_partkey", F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACNN").alias("s"))
    return S.n_free_runs(t, "s")


@query(f"""WITH {CONTIGS}, {READS}, {_MASKED_READS_SQL}, whole AS (SELECT * FROM masked WHERE NOT contains(r1_seq, 'N') AND NOT contains(r2_seq, 'N'))
SELECT read_id, false AS all_low FROM whole WHERE r1_low < 40 AND r2_low < 40 UNION ALL SELECT read_id, true FROM whole WHERE r1_low < 100 AND r2_low < 100""")
def p2_read_quality(spark, d):
    """Both forms of the quality filter, on reads of which some have an N and some have up to 100 low bases."""
    r = X.reads(spark, d).withColumns({c: F.expr(x) for c, x in MASKED_READS.items()})
    r = r.withColumns({f"{m}_qual": F.expr(f"concat(repeat(':', {m}_low), repeat('I', 100 - {m}_low))") for m in ("r1", "r2")})
    way = lambda all_low: R.good_quality(r, all_low=all_low).select("read_id", F.lit(all_low).alias("all_low"))
    return way(False).unionByName(way(True))


@query(f"WITH {CONTIGS}, {READS} SELECT read_id, {PACK.format(s='substr(r1_seq, 11, 8)', k=8)} AS bar1, {PACK.format(s='substr(r2_seq, 11, 8)', k=8)} AS bar2 FROM reads")
def p3_barcodes(spark, d):
    return R.with_barcodes(X.reads(spark, d)).select("read_id", "bar1", "bar2")


@query(f"WITH {CONTIGS}, {READS} SELECT read_id, substr(r1_seq, 9) AS r1_seq, xor({PACK.format(s='substr(r1_seq, 1, 8)', k=8)}, {PACK.format(s='substr(r1_seq, 29, 8)', k=8)}) AS bar1 FROM reads")
def p4_insert_trim(spark, d):
    return R.with_barcodes(X.reads(spark, d), (0, 8, 8), (0, 8, 8)).select("read_id", "r1_seq", "bar1")


@query(f"WITH {CONTIGS}, {READS} SELECT read_id, CAST(50 + read_id % 51 - {K - 1} AS BIGINT) AS n_kmers FROM reads WHERE 50 + read_id % 51 - {K - 1} > 50")
def p5_least_length(spark, d):
    r = X.reads(spark, d).select("read_id", F.expr("substring(r1_seq, 1, cast(50 + read_id % 51 as int))").alias("r1_seq"), "r2_seq")
    return R.scanned_lengths(r, CFG)


def snps(spark, d, bases=None):
    """A substitution at every 997th base of each contig: the next base in A, C, G, T."""
    c = X.points(spark, d, 997, bases).withColumn("ref", F.expr("substring(seq, 1, 1)"))
    return c.select("chrom", "pos", "ref", F.translate("ref", "ACGT", "CGTA").alias("alt"))


def indels(spark, d):
    """At every 499th base of each contig, in turn three bases deleted and three bases inserted."""
    c = X.points(spark, d, 499).where("length(seq) = 5")
    return c.selectExpr("chrom", "pos", "substring(seq, 1, if(pos % 2 = 0, 4, 1)) as ref", "if(pos % 2 = 0, substring(seq, 1, 1), concat(substring(seq, 1, 1), 'ACG')) as alt")


INDELS = """snps AS (SELECT chrom, CAST(p AS INT) AS pos, substr(seq, CAST(p AS BIGINT), CASE WHEN p % 2 = 0 THEN 4 ELSE 1 END) AS ref,
  CASE WHEN p % 2 = 0 THEN substr(seq, CAST(p AS BIGINT), 1) ELSE substr(seq, CAST(p AS BIGINT), 1) || 'ACG' END AS alt FROM contigs, unnest(range(499, length(seq) - 3, 499)) u(p))"""
SNPS = "snps AS (SELECT chrom, CAST(p AS INT) AS pos, substr(seq, CAST(p AS BIGINT), 1) AS ref, translate(substr(seq, CAST(p AS BIGINT), 1), 'ACGT', 'CGTA') AS alt FROM contigs, unnest(range(997, length(seq) + 1, 997)) u(p))"


@query(f"""WITH {TILES}, {SNPS} SELECT seg_idx, pos, CAST(pos - 1 - "start" - {K - 1} AS INT) AS first, substr(bases, pos - "start" - {K - 1}, {K - 1}) || alt || substr(bases, pos - "start" + 1, {K - 1}) AS haplotype
FROM snps JOIN segments USING (chrom) WHERE pos - 1 >= "start" AND pos - 1 < "end" AND pos - 1 - "start" >= {K - 1} AND pos - "start" + {K - 1} <= "end" - "start" """)
def p6_p7_haplotypes(spark, d):
    h = I.haplotypes(snps(spark, d), tiles(spark, d), CFG)
    return h.select("seg_idx", (F.col("first") + F.col("start") + K).alias("pos"), "first", "haplotype")


@query(f"WITH {SUPPORTS} SELECT sup_id FROM sup WHERE kind = 'PE' AND NOT (left_seg = right_seg AND abs(left_pos - right_pos) < 500 AND left_fwd = right_fwd)")
def p12_pair_distance(spark, d):
    return P.apart(_located(spark, d)[0].where("kind = 'PE'")).select("sup_id")


def _located(spark, d):
    """Support records with segment numbers as codes on 25 segments of two chromosomes."""
    seg = spark.range(25).selectExpr("id as code", "cast(id as int) as seg_idx", "concat('chr', cast(id div 13 as string)) as chrom", "cast((id % 13) * 2000 as int) as start")
    return supports(spark, d).withColumn("left_code", F.col("left_seg").cast("long")).withColumn("right_code", F.col("right_seg").cast("long")), seg


@query(f"""WITH {SUPPORTS} SELECT sup_id FROM sup WHERE left_fwd <> right_fwd OR left_seg // 13 <> right_seg // 13
OR abs((left_seg % 13) * 2000 + left_pos - (right_seg % 13) * 2000 - right_pos) > 1000""")
def p13_far_or_inverted(spark, d):
    s, seg = _located(spark, d)
    return P.far_or_inverted(s, seg).select("sup_id")


EVIDENCE = f"""{SUPPORTS}, ev AS (SELECT *, CAST(left_kmers AS DOUBLE) / cnt AS lk, CAST(right_kmers AS DOUBLE) / cnt AS rk, CAST(bar % 13 + 1 AS DOUBLE) AS molecules, bar % 7 AS singles, (score % 600) / 100 AS rq, (score % 500) / 100 AS vq, (score % 400) / 100 AS bq FROM sup),
fl AS (SELECT *, lk > 2.999 AND rk > 2.999 AND bq < 3.0 AND singles / molecules < 0.801 AND (
  (molecules - singles / 2 > 2.499 AND rq + vq > 7.2 AND lk > 3.999 AND rk > 3.999) OR (molecules - singles / 2 > 5 AND rq + vq > 6.7) OR (molecules - singles / 2 > 7 AND rq + vq > 6.2)
  OR (cnt > 6 AND rq + vq > 9.5 AND lk > 6.999 AND rk > 6.999 AND molecules > 1.999)) AS good FROM ev)"""


@query(f"WITH {EVIDENCE} SELECT sup_id, good FROM fl")
def p16_v6_evidence(spark, d):
    s = supports(spark, d).selectExpr("*", "cast(bar % 13 + 1 as double) as molecules", "bar % 7 as singles", "(score % 600) / 100 as ref_qua", "(score % 500) / 100 as var_qua", "(score % 400) / 100 as bpseq_qua", "cnt as left_cnt", "cnt as right_cnt", "0 as pe_cnt", "cnt as split_cnt")
    return s.select("sup_id", V.evidence(s, CFG).alias("good"))


@query(f"WITH {SUPPORTS} SELECT sup_id, left_seg = right_seg AND abs(right_pos - left_pos) < 50 AND cnt - 1 < 50 AS small, cnt % 4 <> 3 AS fake, cnt % 3 = 0 AS imprecise FROM sup")
def p17_p19_flags(spark, d):
    s = supports(spark, d).selectExpr("*", "cast(left_seg as string) as left_chrom", "cast(right_seg as string) as right_chrom", "left_pos as left_vcf", "right_pos as right_vcf", "cnt as var_len", "cnt % 4 as flag", "cnt % 3 as split_cnt")
    return V.flags(s, CFG).select("sup_id", "small", "fake", "imprecise")


# Aggregations of the index


@query(f"WITH {CONTIGS}, {REPEATS} SELECT {KMER} AS kmer, n FROM rep")
def a1_repeats(spark, d):
    return I.repeats(X.contigs(spark, d), CFG)


@query(f"WITH {OCC} SELECT {KMER} AS kmer, code, pos, is_grid FROM occ")
def a2_occurrences(spark, d):
    return I.occurrences(tiles(spark, d), CFG)


@query(f"WITH {INDEX} SELECT {KMER} AS kmer, code, pos FROM idx")
def a4_a5_kmer_index(spark, d):
    return I.compact(I.occurrences(tiles(spark, d), CFG))


def _haplotypes_sql(n: int) -> str:
    """Haplotypes with n bases on each side of a variant."""
    return f"""hap AS (SELECT code, CAST(pos - 1 - "start" - {n} AS INT) AS first, length(alt) = length(ref) AS same, substr(bases, pos - "start" - {n}, {n}) || alt || substr(bases, CAST(pos - "start" + length(ref) AS BIGINT), {n}) AS h
  FROM snps JOIN segments USING (chrom) WHERE pos - 1 >= "start" AND pos - 1 < "end" AND pos - 1 - "start" >= {n} AND pos - 1 - "start" + length(ref) + {n} <= "end" - "start")"""


VARIANT = f"""{_haplotypes_sql(K - 1)},
vfwd AS (SELECT code, CASE WHEN same THEN CAST(first + i AS INT) END AS pos, substr(h, CAST(i + 1 AS BIGINT), {K}) AS kmer, (first + i) % 3 = 0 OR (NOT same AND i + {K} = length(h)) AS g FROM hap, unnest(range(0, length(h) - {K - 1})) u(i)),
vocc AS (SELECT * FROM occ UNION ALL SELECT kmer, code, pos, g FROM vfwd UNION ALL SELECT {REV.format("kmer")}, code, pos, false FROM vfwd)"""


@query(f"WITH {OCC}, {SNPS}, {VARIANT} SELECT {KMER} AS kmer, bit_or(code) AS code, CASE WHEN count(*) = 1 THEN min(pos) END AS pos FROM vocc GROUP BY kmer HAVING bool_or(is_grid)")
def a3_a6_variant_index(spark, d):
    t = tiles(spark, d)
    return I.compact(I.occurrences(t, CFG).unionByName(I.variant_occurrences(snps(spark, d), t, CFG)))


@query(f"WITH {OCC}, {INDELS}, {VARIANT} SELECT {KMER} AS kmer, bit_or(code) AS code, CASE WHEN count(*) = 1 THEN min(pos) END AS pos FROM vocc GROUP BY kmer HAVING bool_or(is_grid)")
def a3_indel_index(spark, d):
    t = tiles(spark, d)
    return I.compact(I.occurrences(t, CFG).unionByName(I.variant_occurrences(indels(spark, d), t, CFG)))


@query(f"WITH {SCORED} SELECT {KMER} AS kmer, repeat_cat FROM cats")
def a7_neighbourhood(spark, d):
    t = tiles(spark, d)
    return I.neighbourhood(t, I.compact(I.occurrences(t, CFG)), CFG)


def _composite_sql(span: int, variants: bool = False) -> str:
    gap = span - K
    left = PACK.format(s="kmer_l", k=K) + (f" & {(1 << 36) - 1}" if span >= 2 * K else "")
    more = f"""{SNPS}, {_haplotypes_sql(span - 1)},
vw AS (SELECT code, CAST(first + i AS INT) AS pos, substr(h, CAST(i + 1 AS BIGINT), {K}) AS l, substr(h, CAST(i + {gap + 1} AS BIGINT), {K}) AS r FROM hap, unnest(range(0, length(h) - {span - 1})) u(i)),"""
    both = f" UNION ALL SELECT l, r, code, pos, false FROM vw WHERE pos % 3 <> 0 UNION ALL SELECT {REV.format('r')}, {REV.format('l')}, code, pos, false FROM vw"
    return f"""WITH {COPIES}, {_OCC}, {_IDX}, vague AS (SELECT kmer FROM idx WHERE pos IS NULL), {more if variants else ''}
pf AS (SELECT code, CAST(i AS INT) AS pos, substr(bases, CAST(i + 1 AS BIGINT), {K}) AS l, substr(bases, CAST(i + {gap + 1} AS BIGINT), {K}) AS r FROM segments, unnest(range(0, length(bases) - {span - 1})) u(i)),
po AS (SELECT l AS kmer_l, r AS kmer_r, code, pos, pos % 3 = 0 AS g FROM pf UNION ALL SELECT {REV.format("r")}, {REV.format("l")}, code, pos, false FROM pf{both if variants else ''}),
keyed AS (SELECT {left} AS kmer_l, {PACK.format(s="kmer_r", k=K)} AS kmer_r, code, pos, g FROM po WHERE kmer_l IN (SELECT kmer FROM vague) AND kmer_r IN (SELECT kmer FROM vague))
SELECT kmer_l, kmer_r, bit_or(code) AS code, CASE WHEN count(*) = 1 THEN min(pos) END AS pos FROM keyed GROUP BY 1, 2 HAVING bool_or(g)"""


def _composite(spark, d, span, variants=None):
    t = tiles(spark, d, F.expr(X.COPY_BASES))
    return I.composite_index(t, I.compact(I.occurrences(t, CFG)), span, CFG, variants)


@query(_composite_sql(41))
def a8_a9_long_index(spark, d):
    return _composite(spark, d, CFG.long_k)


@query(_composite_sql(83))
def a8_a9_spaced_index(spark, d):
    return _composite(spark, d, CFG.spaced_k)


@query(_composite_sql(41, True))
def a10_long_index_variants(spark, d):
    return _composite(spark, d, CFG.long_k, snps(spark, d, F.expr(X.COPY_BASES)))


@query(_composite_sql(83, True))
def a10_spaced_index_variants(spark, d):
    return _composite(spark, d, CFG.spaced_k, snps(spark, d, F.expr(X.COPY_BASES)))


@query(f"WITH {SCORED} SELECT repeat_cat, count(*) AS n_kmers, count(pos) AS n_unique FROM scored GROUP BY 1")
def a20_index_statistics(spark, d):
    return I.statistics(I.kmer_index(tiles(spark, d), CFG))


# Aggregations of support records

SUP_KEYS = ["kind", "left_seg", "left_pos", "left_fwd", "right_seg", "right_pos", "right_fwd"]


@query(f"""WITH {SUPPORTS} SELECT kind, left_seg, left_pos, left_fwd, right_seg, right_pos, right_fwd, CAST(sum(left_kmers) AS BIGINT) AS left_kmers, CAST(sum(right_kmers) AS BIGINT) AS right_kmers,
CAST(sum(cnt) AS DOUBLE) AS left_score, CAST(sum(cnt) AS BIGINT) AS split_cnt, CAST(count(*) AS INT) AS n_bars, CAST(sum(bar) AS BIGINT) AS bars, CAST(bit_or(CASE WHEN flip THEN 2 ELSE 1 END) AS INT) AS flag FROM sup GROUP BY ALL""")
def a12_a14_merge_equal(spark, d):
    s = supports(spark, d).withColumn("flag", F.when(F.col("flip"), 2).otherwise(1)).withColumn("left_score", F.col("cnt").cast("double")).withColumn("split_cnt", F.col("cnt").cast("long"))
    s = s.withColumn("barcodes", F.array(F.struct(F.col("bar").alias("bar1"), F.col("bar").alias("bar2"), "flip")))
    m = P.merge_equal(s, SUP_KEYS)
    return m.withColumn("n_bars", F.size("barcodes")).withColumn("bars", F.aggregate("barcodes", F.lit(0).cast("long"), lambda a, b: a + b["bar1"])).drop("barcodes")


@query(f"WITH {SUPPORTS}, g AS (SELECT left_seg, right_seg, bar, count(*) AS n, count(DISTINCT flip) AS w FROM sup GROUP BY ALL) SELECT left_seg * 25 + right_seg AS event, CAST(count(*) + 0.5 * sum(CASE WHEN w > 1 THEN 1 ELSE 0 END) AS DOUBLE) AS molecules, count(*) FILTER (WHERE n = 1) AS singles FROM g GROUP BY ALL")
def a16_a17_molecules(spark, d):
    """Molecules of the supports of each pair of segments; those read from the other end have their barcodes swapped."""
    other = F.col("bar") + 100
    bar = F.struct(F.when(F.col("flip"), other).otherwise(F.col("bar")).alias("bar1"), F.when(F.col("flip"), F.col("bar")).otherwise(other).alias("bar2"), "flip")
    s = supports(spark, d).select((F.col("left_seg") * 25 + F.col("right_seg")).alias("event"), F.array(bar).alias("barcodes"))
    return V.event_molecules(s, "event").withColumn("molecules", F.col("molecules").cast("double"))


@query("""WITH g AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT value > 50) AS w FROM events GROUP BY ALL)
SELECT event_type, CAST(count(*) + 0.5 * sum(CASE WHEN w > 1 THEN 1 ELSE 0 END) AS DOUBLE) AS molecules, count(*) FILTER (WHERE n = 1) AS singles FROM g GROUP BY ALL""")
def a16_a17_event_molecules(spark, d):
    e = X.table(spark, d, "events").withColumn("way", F.col("value") > 50)
    return P.molecules(e, ["event_type"], "user_id", "way").withColumn("molecules", F.col("molecules").cast("double"))


@query(f"WITH {SUPPORTS} SELECT sup_id, row_number() OVER (ORDER BY left_seg, left_pos, sup_id) - 1 AS sv_no FROM sup")
def a19_numbering(spark, d):
    return V.numbered(supports(spark, d).select("sup_id", "left_seg", (F.col("left_pos") * 10).alias("left_pos")), ["left_seg", "left_pos", "sup_id"]).select("sup_id", "sv_no")


# Look-ups and joins

READ_KMERS = f"""{READS},
rk AS (SELECT read_id, substr(r1_seq, CAST(i + 1 AS BIGINT), {K}) AS kmer FROM reads, unnest(range(0, {100 - K + 1})) u(i)
  UNION ALL SELECT read_id, substr({REV.format("r2_seq")}, CAST(i + 1 AS BIGINT), {K}) FROM reads, unnest(range(0, {100 - K + 1})) u(i))"""


@query(f"""WITH {SCORED}, {READ_KMERS}, s AS (SELECT read_id, kmer, 0 AS strand FROM rk UNION ALL SELECT read_id, {REV.format("kmer")}, 1 FROM rk)
SELECT read_id, CAST(strand AS INT) AS strand, count(*) AS n, CAST(sum(CASE WHEN pos IS NULL THEN 1 WHEN repeat_cat > 0 THEN 3 ELSE 5 END) AS BIGINT) AS score, CAST(sum(coalesce(pos, -1)) AS BIGINT) AS pos FROM s JOIN scored USING (kmer) GROUP BY ALL""")
def j1_j4_look_up(spark, d):
    hits = R.hits_of(X.reads(spark, d), I.kmer_index(tiles(spark, d), CFG), CFG)
    return hits.groupBy("read_id", "strand").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("score"), F.sum("pos").alias("pos"))


@query(f"WITH {CONTIGS}, {REPEATS} SELECT chrom, count(*) AS n, CAST(sum(i) AS BIGINT) AS offsets FROM contigs, unnest(range(0, length(seq) - {K - 1})) u(i) WHERE substr(seq, CAST(i + 1 AS BIGINT), {K}) IN (SELECT kmer FROM rep) GROUP BY 1")
def j2_repeat_membership(spark, d):
    c = X.contigs(spark, d)
    return I.members(S.kmers(c.select("chrom", "seq"), "seq", K), I.repeats(c, CFG)).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@query(f'WITH {TILES}, {SNPS} SELECT s.chrom, s.pos, t.seg_idx FROM snps s JOIN segments t ON s.chrom = t.chrom AND t."start" <= s.pos - 1 AND s.pos - 1 < t."end"')
def j8_variant_segment(spark, d):
    return I.variant_segments(snps(spark, d), tiles(spark, d)).select("chrom", "pos", "seg_idx")


@query(f"WITH {TILES}, {SUPPORTS} SELECT sup_id, coalesce(seg_idx, -1) AS seg_idx, chrom FROM sup LEFT JOIN segments ON code = (CAST(31 AS BIGINT) << left_seg) AND seg_idx < 28")
def j9_code_segment(spark, d):
    return I.segment_of(supports(spark, d).withColumn("code", F.expr("shiftleft(31L, left_seg)")), tiles(spark, d).where("seg_idx < 28")).select("sup_id", "seg_idx", "chrom")


@query(f"""WITH {CONTIGS}, {READS}, m AS (SELECT read_id, {MATES['r1']} AS r1, {MATES['r2']} AS r2 FROM fragments_of),
o AS (SELECT *, {REV.format('r2')} AS other FROM m),
k1 AS (SELECT read_id, substr(r1, CAST(i + 1 AS BIGINT), {K}) AS word, min(i) AS p FROM m, unnest(range(0, length(r1) - {K - 1})) u(i) GROUP BY 1, 2 HAVING count(*) = 1),
probe AS (SELECT o.*, CAST(i AS BIGINT) AS i, substr(other, CAST(length(other) - {K} - i + 1 AS BIGINT), {K}) AS word FROM o, unnest(list_concat([0], range(length(other) - {K}, 0, -5))) u(i)),
hit AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY i = 0 DESC, i DESC) AS rn FROM probe JOIN k1 USING (read_id, word)),
size AS (SELECT read_id, p + i + {K} AS size FROM hit WHERE rn = 1),
tail AS (SELECT o.*, size, CAST(size - length(r1) AS BIGINT) AS tail FROM o LEFT JOIN size USING (read_id)),
ok AS (SELECT *, CASE WHEN tail > 0 THEN list_sum(list_transform(range(0, {K}), lambda x: CASE WHEN substr(r1, CAST(length(r1) - x AS BIGINT), 1) = substr(other, CAST(length(other) - tail - x AS BIGINT), 1) THEN 0 ELSE 1 END)) <= 1 END AS alike FROM tail)
SELECT read_id, CASE WHEN size IS NULL THEN r1 WHEN tail <= 0 THEN substr(r1, 1, CAST(size AS BIGINT)) WHEN alike THEN r1 || substr(other, CAST(length(other) - tail + 1 AS BIGINT)) ELSE r1 END AS r1,
CASE WHEN size IS NULL OR (tail > 0 AND NOT alike) THEN r2 ELSE '' END AS r2 FROM ok""".replace("fragments_of", "fragments"))
def j10_mate_merge(spark, d):
    """Mates of fragments of 40 to 239 bases: read through, overlapping and apart, with changed bases in some of R2."""

    @F.pandas_udf("r1 string, r2 string")
    def merged(a, b):
        import pandas as pd

        return pd.DataFrame([kernels.merge_mates(x, y, K) for x, y in zip(a, b)], columns=["r1", "r2"])

    r = X.reads(spark, d).select("read_id", "fragment").select("read_id", F.expr(MATES["r1"]).alias("r1_seq"), F.expr(MATES["r2"]).alias("r2_seq"))
    return r.withColumn("m", merged("r1_seq", "r2_seq")).select("read_id", "m.r1", "m.r2")


NEAR = "((abs(p.left_pos - s.left_pos) < 200 AND abs(p.right_pos - s.right_pos) < 50) OR (abs(p.left_pos - s.left_pos) < 50 AND abs(p.right_pos - s.right_pos) < 200))"


@query(f"""WITH {SUPPORTS}, j AS (SELECT p.sup_id AS pe_id, s.sup_id AS split_id, abs(s.left_pos - p.left_pos) AS far FROM sup p JOIN sup s
  ON p.kind = 'PE' AND s.kind = 'SPLIT' AND p.left_seg = s.left_seg AND p.right_seg = s.right_seg AND p.left_fwd = s.left_fwd AND p.right_fwd = s.right_fwd
  AND {NEAR} AND CASE WHEN p.left_fwd THEN s.left_pos >= p.left_pos ELSE s.left_pos <= p.left_pos END)
SELECT pe_id, split_id FROM (SELECT *, row_number() OVER (PARTITION BY pe_id ORDER BY far, split_id) AS rn FROM j) WHERE rn = 1""")
def c10_pairs_to_splits(spark, d):
    s, _ = _located(spark, d)
    return P.assign_pairs(s.where("kind = 'PE'").withColumnRenamed("sup_id", "pe_id"), s.where("kind = 'SPLIT'").withColumnRenamed("sup_id", "split_id"))


@query(f"""WITH {SUPPORTS}, t AS (SELECT *, left_seg > right_seg OR (left_seg = right_seg AND left_pos > right_pos) AS turn FROM sup)
SELECT sup_id, CASE WHEN turn THEN right_seg ELSE left_seg END AS seg_idx, CASE WHEN turn THEN right_pos ELSE left_pos END AS left_pos, CASE WHEN turn THEN left_pos ELSE right_pos END AS right_pos,
CASE WHEN turn THEN NOT right_fwd ELSE left_fwd END AS left_fwd, CASE WHEN turn THEN NOT left_fwd ELSE right_fwd END AS right_fwd, CASE WHEN turn THEN 2 ELSE 1 END AS flag FROM t""")
def m1_canonical(spark, d):
    s, seg = _located(spark, d)
    return P.canonical(s.withColumn("flag", F.lit(0)), seg).select("sup_id", "seg_idx", "left_pos", "right_pos", "left_fwd", "right_fwd", "flag")


@query(f"""WITH {SUPPORTS}, o AS (SELECT *, left_pos - lag(left_pos) OVER (PARTITION BY left_seg ORDER BY left_pos, sup_id) AS gap FROM sup),
f AS (SELECT *, CASE WHEN gap IS NULL OR gap > 5 THEN left_pos END AS b FROM o)
SELECT sup_id, max(b) OVER (PARTITION BY left_seg ORDER BY left_pos, sup_id) AS session FROM f""")
def m3_sessions(spark, d):
    return P.sessions(supports(spark, d), ["left_seg"], "left_pos", 5).select("sup_id", "session")


# Rendering


@query(f"WITH {SUPPORTS} SELECT sup_id, left_seg * 2000 + left_pos + CASE WHEN left_fwd THEN 2 ELSE {K - 1} END AS left_vcf, right_seg * 2000 + right_pos + CASE WHEN right_fwd THEN {K - 1} ELSE 2 END AS right_vcf FROM sup")
def v1_positions(spark, d):
    s = supports(spark, d).withColumn("left_start", F.col("left_seg") * 2000).withColumn("right_start", F.col("right_seg") * 2000)
    return V.breakend_positions(s, K).select("sup_id", "left_vcf", "right_vcf")


@query(f"""WITH {SUPPORTS} SELECT sup_id, CASE WHEN left_fwd THEN 'N' ELSE '' END || CASE WHEN right_fwd THEN '[' ELSE ']' END || 'chr' || right_seg || ':' || right_pos || CASE WHEN right_fwd THEN '[' ELSE ']' END || CASE WHEN left_fwd THEN '' ELSE 'N' END AS alt FROM sup""")
def v3_v4_breakends(spark, d):
    s = supports(spark, d)
    return s.select("sup_id", V.bnd_alt(F.lit("N"), F.concat(F.lit("chr"), F.col("right_seg").cast("string")), F.col("right_pos"), F.col("left_fwd"), F.col("right_fwd")).alias("alt"))


@query(f"""WITH t AS ({DNA}), g AS (SELECT p_partkey, s AS seq, {REV.format('s')} AS back, 32 AS n, CAST(5 + p_partkey % 20 AS INT) AS l, CAST(5 + (p_partkey // 7) % 20 AS INT) AS r, p_partkey % 2 = 0 AS lf, p_partkey % 3 = 0 AS rf FROM t),
h AS (SELECT *, l + r <= n AS apart, CASE WHEN l + r <= n THEN n - l - r + 1 ELSE 1 END AS v, CASE WHEN l + r <= n THEN l - 1 ELSE n - r - 1 END AS lo FROM g)
SELECT p_partkey, v AS var_len, CASE WHEN NOT apart THEN l + r - n END AS hom_len,
CASE WHEN apart THEN NULL WHEN lf THEN substr(seq, n - r + 1, l + r - n) ELSE substr(back, n - l + 1, l + r - n) END AS hom_seq,
CASE WHEN lf THEN substr(seq, lo + 1, v) ELSE substr(back, r + 1, v) END AS seq_left, CASE WHEN rf THEN substr(seq, lo + 2, v) ELSE substr(back, r, v) END AS seq_right,
1000 + CASE WHEN lf THEN lo ELSE -lo END AS left_vcf, 5000 - CASE WHEN rf THEN r - 1 ELSE 1 - r END AS right_vcf FROM h""")
def v2_geometry(spark, d):
    g = _dna(spark, d).selectExpr("p_partkey", "s as seq", "32 as bp_len", "cast(5 + p_partkey % 20 as int) as left_same", "cast(5 + (p_partkey div 7) % 20 as int) as right_same", "p_partkey % 2 = 0 as left_fwd", "p_partkey % 3 = 0 as right_fwd", "1000 as left_vcf", "5000 as right_vcf")
    return V.geometry(g).select("p_partkey", "var_len", "hom_len", "hom_seq", "seq_left", "seq_right", "left_vcf", "right_vcf")


def _merge_sql(name: str, frm: str) -> str:
    """One pass of the range merge: each record hangs on its best similar one, roots take in their trees."""
    key = "CASE WHEN kind = 'SPLIT' THEN bp_len ELSE 2147483648 END, kind, left_pos, right_pos, id"
    add = lambda c, always: f"CAST(sum(CASE WHEN r.id = t.root OR {'true' if always else chr(114) + '.kind = ' + chr(39) + 'SPLIT' + chr(39)} THEN r.{c} ELSE 0 END) AS BIGINT) AS {c}"
    sums = ", ".join(add(c, c in ("left_kmers", "right_kmers", "pe_cnt")) for c in ("left_kmers", "right_kmers", "split_cnt", "pe_cnt", "left_cnt", "right_cnt"))
    return f"""{name}_r AS (SELECT *, row_number() OVER (ORDER BY {key}) AS rk FROM {frm}),
{name}_p AS (SELECT a.id, arg_min(b.id, b.rk) AS up FROM {name}_r a JOIN {name}_r b ON a.left_seg = b.left_seg AND a.right_seg = b.right_seg AND a.left_fwd = b.left_fwd AND a.right_fwd = b.right_fwd
  AND CASE WHEN a.kind = 'SPLIT' AND b.kind = 'SPLIT' THEN abs(a.left_pos - b.left_pos) < w(a) AND abs(a.right_pos - b.right_pos) < w(a)
      ELSE (abs(a.left_pos - b.left_pos) < 200 AND abs(a.right_pos - b.right_pos) < 50) OR (abs(a.left_pos - b.left_pos) < 50 AND abs(a.right_pos - b.right_pos) < 200) END GROUP BY a.id),
{name}_t AS (SELECT id, id AS root FROM {name}_p WHERE up = id UNION ALL SELECT p.id, t.root FROM {name}_p p JOIN {name}_t t ON p.up = t.id WHERE p.up <> p.id),
{name} AS (SELECT t.root AS id, any_value(h.kind) AS kind, any_value(h.left_seg) AS left_seg, any_value(h.right_seg) AS right_seg, any_value(h.left_pos) AS left_pos, any_value(h.right_pos) AS right_pos, any_value(h.left_fwd) AS left_fwd,
  any_value(h.right_fwd) AS right_fwd, any_value(h.bp_len) AS bp_len, {sums}, bit_or(r.flag) AS flag FROM {name}_t t JOIN {name}_r r ON r.id = t.id JOIN {name}_r h ON h.id = t.root GROUP BY t.root)""".replace("w(a)", "CASE WHEN a.left_seg = a.right_seg AND abs(a.left_pos - a.right_pos) < 100 THEN 15 ELSE 100 END")


@query(f"""WITH RECURSIVE {SUPPORTS}, z AS (SELECT sup_id AS id, kind, left_seg, right_seg, left_pos, right_pos, left_fwd, right_fwd, CAST(sup_id % 1000003 AS INT) AS bp_len, left_kmers, right_kmers, CASE WHEN kind = 'SPLIT' THEN 1 ELSE 0 END AS split_cnt, CASE WHEN kind = 'PE' THEN 1 ELSE 0 END AS pe_cnt,
  1 AS left_cnt, 1 AS right_cnt, CAST(1 + cnt % 2 AS INT) AS flag FROM sup),
{_merge_sql("one", "z")}, {_merge_sql("two", "one")}
SELECT kind, CAST(left_seg AS BIGINT) AS left_code, CAST(right_seg AS BIGINT) AS right_code, left_pos, right_pos, left_fwd, right_fwd, bp_len, left_kmers, right_kmers, split_cnt, pe_cnt, left_cnt, right_cnt, flag FROM two""")
def m3_merge_ranges(spark, d):
    """Similar support records merged over ranges of each pair of segments."""
    s = supports(spark, d).selectExpr(
        "kind", "false as vague", "cast(left_seg as long) as left_code", "left_pos", "left_fwd", "cast(right_seg as long) as right_code", "right_pos", "right_fwd", "lpad(cast(sup_id as string), 20, '0') as seq", "cast(sup_id % 1000003 as int) as bp_len", "left_kmers", "right_kmers", "1.0D as left_score", "1.0D as right_score",
        "case when kind = 'SPLIT' then 1L else 0L end as split_cnt", "case when kind = 'PE' then 1L else 0L end as pe_cnt", "1L as left_cnt", "1L as right_cnt", "0.0D as bp_score_sum", f"cast(array() as {P.BARS}) as barcodes", "cast(1 + cnt % 2 as int) as flag",
    )
    return P.merge_ranges(s).select("kind", "left_code", "right_code", "left_pos", "right_pos", "left_fwd", "right_fwd", "bp_len", "left_kmers", "right_kmers", "split_cnt", "pe_cnt", "left_cnt", "right_cnt", "flag")


# Whole plans

_INDEXES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _index(spark, d):
    """The index of the fixture's contigs; like a program's index files, it is built once and read by every call after it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = pipelines.build_index(X.contigs(spark, d), CFG)
    return _INDEXES[key]


@query(f'WITH RECURSIVE {CUT} SELECT seg_idx, chrom, chrom_idx, "start", "end", code FROM segments')
def g1_segments(spark, d):
    c = X.contigs(spark, d)
    return I.cut_genome(c, I.repeats(c, CFG), CFG).drop("ref")


@query(f"WITH RECURSIVE {CUT}, {_OCC}, {_IDX}, {_CATS} SELECT {KMER} AS kmer, code, pos, repeat_cat FROM scored")
def e2e_index(spark, d):
    return pipelines.build_index(X.contigs(spark, d), CFG)["kmers"]


@query()
def e2e_breakpoints(spark, d):
    return pipelines.find_breakpoints(X.reads(spark, d), _index(spark, d), CFG)


@query()
def e2e_sv_calls(spark, d):
    """Structural variants, as VCF records, called from all reads against an index of all contigs."""
    index = _index(spark, d)
    bp = pipelines.find_breakpoints(X.reads(spark, d), index, CFG)
    return V.records(pipelines.call_variants(bp, index, CFG))


@query()
def c3_c8_cluster(spark, d):
    """Clusters of the splits of all reads, and the pairs that vague ones turn into."""
    index = _index(spark, d)
    bp = pipelines.find_breakpoints(X.reads(spark, d), index, CFG)
    return P.cluster_splits(P.merge_equal(P.from_breakpoints(bp)), index["segments"], CFG).drop("barcodes")
