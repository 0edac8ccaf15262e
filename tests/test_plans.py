import dataclasses
import gzip
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.__main__ import INDEXED, main
from kmerloom.functions import kernels, packed, seq
from kmerloom.operators import index as index_of
from kmerloom.operators import mapped
from kmerloom.operators import reads as R
from kmerloom.operators import vcf
from kmerloom.plans import catalog, fixtures, pipelines
from kmerloom.plans.scratch import cut
from kmerloom.sources import files

SF = "/root/testdata/sf0.001"


def test_planted_junctions_are_called(spark):
    cfg = catalog.CFG
    index = pipelines.build_index(fixtures.contigs(spark, SF), cfg)
    calls = pipelines.call_variants(pipelines.find_breakpoints(fixtures.reads(spark, SF), index, cfg), index, cfg)
    got = {(r.left_chrom, r.right_chrom) for r in calls.collect()}
    assert len(got) >= 4 and vcf.records(calls).count() == 2 * calls.count()


def test_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">1 first\nacgt\nACGN\n>chr2\nTTTT\n")
    got = [(r.chrom, r.chrom_idx, r.seq) for r in files.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("chrom_idx").collect()]
    assert got == [("chr1", 0, "ACGTACGN"), ("chr2", 1, "TTTT")]
    for n in (1, 2):
        with gzip.open(tmp_path / f"r{n}.fq.gz", "wt") as f:
            f.write("".join(f"@a{i}/{n}\nACGT{'A' * i}\n+\n@III{'I' * i}\n" for i in range(3)))
    pairs = files.read_fastq_pairs(spark, str(tmp_path / "r1.fq.gz"), str(tmp_path / "r2.fq.gz")).orderBy("read_id").collect()
    assert [(r.name, r.r1_seq, r.r2_qual) for r in pairs] == [("a0", "ACGT", "@III"), ("a1", "ACGTA", "@IIII"), ("a2", "ACGTAA", "@IIIII")]
    (tmp_path / "s.vcf").write_text("##x\n1\t5\t.\ta\tC,G\n1\t5\t.\tA\tT\n")
    assert [(r.chrom, r.pos, r.ref, r.alt) for r in files.read_snps(spark, str(tmp_path / "s.vcf")).collect()] == [("chr1", 5, "A", "C")]


def test_fastq_records_over_partition_borders(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    n = 400
    for m in (1, 2):
        (tmp_path / f"r{m}.fq").write_text("".join(f"@a{i} {m}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@' * (4 * (i % 7 + 1))}\n" for i in range(n)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = files.read_fastq_pairs(spark, str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq")).orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.read_id, r.name, len(r.r1_seq), len(r.r2_qual)) for r in rows] == [(i, f"a{i}", 4 * (i % 7 + 1), 4 * (i % 7 + 1)) for i in range(n)]


def test_names_of_a_pair_must_be_equal(spark):
    pairs = spark.createDataFrame([("a/1", "a/2"), ("b/1", "c/2")], "name string, name2 string")
    assert [r.name for r in R.same_names(pairs.where("name = 'a/1'")).collect()] == ["a"]
    with pytest.raises(Exception, match="names of a pair differ"):
        R.same_names(pairs).collect()


def test_fasta_ranges_by_index(spark, tmp_path):
    rng = random.Random(8)
    seqs = {c: "".join(rng.choice("ACGTacgtN") for _ in range(n)) for c, n in (("chr1", 95), ("chr2", 61), ("chr3", 20))}
    text, fai = "", ""
    for c, s in seqs.items():
        text += f">{c}\n"
        fai += f"{c}\t{len(s)}\t{len(text)}\t20\t21\n"
        text += "".join(s[i : i + 20] + "\n" for i in range(0, len(s), 20))
    (tmp_path / "g.fa").write_text(text)
    (tmp_path / "g.fa.fai").write_text(fai)
    index = files.read_fai(spark, str(tmp_path / "g.fa.fai"))
    whole = files.read_fasta(spark, str(tmp_path / "g.fa"))
    for c, a, b in (("chr1", 1, 96), ("chr1", 20, 41), ("chr2", 21, 22), ("chr2", 40, 62), ("chr3", 5, 5), ("chr1", 81, 200)):
        assert files.read_range(spark, str(tmp_path / "g.fa"), index, c, a, b).first().seq == seqs[c][a - 1 : b - 1].upper()
    assert files.sequence(whole, "chr1", 20, 41).first().seq == seqs["chr1"][19:40].upper()
    with pytest.raises(FileNotFoundError):
        files.must_exist(spark, str(tmp_path / "none.fa"))


def test_command_line(spark, tmp_path):
    """index and call from files, with a known variant; the VCF has a header, and two records for each event."""
    contigs, reads = fixtures.contigs(spark, SF), fixtures.reads(spark, SF)
    with open(tmp_path / "g.fa", "w") as f:
        for r in contigs.orderBy("chrom_idx").collect():
            f.write(f">{r.chrom}\n" + "".join(r.seq[i : i + 60] + "\n" for i in range(0, len(r.seq), 60)))
    first = contigs.where("chrom = 'chr0'").first().seq
    with gzip.open(tmp_path / "s.vcf.gz", "wt") as f:
        f.write(f"##x\n0\t700\t.\t{first[699]}\t{'A' if first[699] != 'A' else 'C'}\n")
    rows = reads.collect()
    for m in (1, 2):
        with gzip.open(tmp_path / f"r{m}.fq.gz", "wt") as f:
            f.write("".join(f"@{r.name}/{m}\n{r[f'r{m}_seq']}\n+\n{r[f'r{m}_qual']}\n" for r in rows))
    sizes = ["--min-segment", "2000", "--max-segment", "4000"]
    main(["index", "--fasta", str(tmp_path / "g.fa"), "--snps", str(tmp_path / "s.vcf.gz"), "--index", str(tmp_path / "idx"), *sizes], spark)
    stored = files.read_index(spark, str(tmp_path / "idx"), {n: getattr(catalog.CFG, n) for n in INDEXED})
    assert all(stored[n].count() for n in ("segments", "kmers", "contigs"))
    with pytest.raises(ValueError):
        files.read_index(spark, str(tmp_path / "idx"), {"k": 21})
    main(["call", "--r1", str(tmp_path / "r1.fq.gz"), "--r2", str(tmp_path / "r2.fq.gz"), "--index", str(tmp_path / "idx"), "--out", str(tmp_path / "out"), "--sample", "s1", *sizes], spark)
    lines = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert any(x.startswith("#CHROM") and x.endswith("\ts1") for x in lines) and len(body) >= 8 and len(body) % 2 == 0
    assert all(len(x) == 10 and x[7].count("PARID=") == 1 for x in body)


def repeat_reads(spark, seed=2):
    """Contigs with many copies of an element, a base changed here and there, and pairs over junctions between them."""
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))

    def copy(s, every):
        return "".join(rng.choice("ACGT") if rng.random() < 1 / every else c for c in s)

    element = dna(700)
    contigs = ["".join(dna(300) + copy(element, every) for every in (50, 90, 150, 60)) + dna(300) for _ in range(3)]
    rows = []
    for i in range(240):
        a, b = rng.choice(contigs), rng.choice(contigs)
        x, y = rng.randrange(200, len(a) - 200), rng.randrange(200, len(b) - 200)
        whole = a[x - 150 : x] + b[y : y + 150]
        insert = whole[: rng.choice((180, 200, 220, 300))]
        if i % 2:
            insert = kernels.revcomp(insert)
        rows.append((i, insert[:140], kernels.revcomp(insert[-140:]), i, 1000 + i))
    reads = spark.createDataFrame(rows, "read_id long, r1_seq string, r2_seq string, bar1 long, bar2 long")
    return spark.createDataFrame([(f"chr{k}", k, s) for k, s in enumerate(contigs)], "chrom string, chrom_idx int, seq string"), reads


def test_joined_and_broadcast_paths_give_equal_rows(spark):
    cfg = catalog.CFG
    contigs, reads = repeat_reads(spark)
    index = pipelines.build_index(contigs, cfg)
    assert index["long"].count() and index["spaced"].count()
    find = lambda c, long, spaced: sorted(map(tuple, R.breakpoints(reads, index["kmers"], long, spaced, c).collect()))
    joined = dataclasses.replace(cfg, broadcast_rows=0)
    for long, spaced in ((index["long"], index["spaced"]), (None, None)):
        want = find(cfg, long, spaced)
        assert want and find(joined, long, spaced) == want
    assert find(cfg, index["long"], index["spaced"]) != want  # the composite look-ups matter here


def shuffled(spark) -> int:
    """Bytes that this application's stages have shuffled so far."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def long_parts(spark, path, n=60_000) -> str:
    """A folder with ``n`` parts, which make contigs of 32 * n / 5 bases."""
    spark.range(n).selectExpr("id as p_partkey").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_tiles_of_long_contigs_are_cut_from_pieces(spark, tmp_path):
    """Tiles equal those of whole contigs, and no contig is shuffled once for each of its tiles."""
    d = long_parts(spark, tmp_path)
    for bases, contigs in ((None, fixtures.contigs), (F.expr(fixtures.COPY_BASES), fixtures.copies)):
        whole = {r.chrom_idx: r.seq for r in contigs(spark, d).collect()}
        want = [(c, s, min(len(seq), s + 2022), seq[s : s + 2022]) for c, seq in sorted(whole.items()) for s in range(0, len(seq), 2000)]
        before = shuffled(spark)
        got = sorted(map(tuple, catalog.tiles(spark, d, bases).select("seg_idx", "chrom_idx", "start", "end", "ref").collect()))
        assert got == [(i, *x) for i, x in enumerate(want)]
        assert shuffled(spark) - before < 10 * sum(map(len, whole.values()))


def test_variants_of_long_contigs_are_made_from_pieces(spark, tmp_path):
    """Known variants equal those of whole contigs, and no contig is copied once for each of them."""
    d = long_parts(spark, tmp_path)
    whole = {f"chr{r.chrom_idx}": r.seq for r in fixtures.contigs(spark, d).collect()}
    turn = str.maketrans("ACGT", "CGTA")
    want = [(c, p, s[p - 1], s[p - 1].translate(turn)) for c, s in whole.items() for p in range(997, len(s) + 1, 997)]
    before = shuffled(spark)
    assert sorted(map(tuple, catalog.snps(spark, d).repartition(2).collect())) == sorted(want)
    want = [(c, p, s[p - 1 : p + 3], s[p - 1]) if p % 2 == 0 else (c, p, s[p - 1], s[p - 1] + "ACG") for c, s in whole.items() for p in range(499, len(s) - 3, 499)]
    assert sorted(map(tuple, catalog.indels(spark, d).repartition(2).collect())) == sorted(want)
    assert shuffled(spark) - before < 10 * sum(map(len, whole.values()))
    short = long_parts(spark, tmp_path / "short", 7)  # contigs of one and two pieces
    assert catalog.snps(spark, short).count() == 0 and catalog.tiles(spark, short).count() == 5


@pytest.mark.parametrize("make", [lambda s, d: catalog.snps(s, d), lambda s, d: catalog.indels(s, d), lambda s, d: catalog.tiles(s, d)])
def test_fixtures_explode_no_contig(spark, make):
    """No row with a contig's bases goes into a generator, which would copy it for each tile or variant."""
    plan = make(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    held = [x for x in plan.splitlines() if "Generate " in x]
    assert held and "array_join" not in "".join(plan.splitlines()[plan.splitlines().index(held[-1]) :])


def test_mapped_table_finds_both_strands(spark):
    """Every k-mer and its reverse complement, of odd and of even length, against a dictionary; -1 is never found."""
    rng = random.Random(4)
    for k in (5, 6, 23, 31):
        words = sorted({rng.randrange(1 << 2 * k) for _ in range(700)})
        rows = [(w, rng.random() < 0.5, rng.randrange(-(1 << 62), 1 << 62)) for w in words]
        table = mapped.store(spark.createDataFrame(rows, "kmer long, flag boolean, value long"), k)
        known = {w: (f, v) for w, f, v in rows}
        ask = np.array(words[::2] + [int(x) for x in packed.complement(np.array(words), k)] + [rng.randrange(1 << 2 * k) for _ in range(300)] + [-1], np.int64)
        turned = packed.complement(ask, k)
        got = sorted(zip(*(x.tolist() for x in table.matches(ask, turned))))
        want = sorted((i, s, *known[w]) for i, (a, b) in enumerate(zip(ask.tolist(), turned.tolist())) for s, w in ((0, a), (1, b)) if a >= 0 and w in known)
        assert got == want and want
    empty = mapped.store(spark.createDataFrame([], "kmer long, flag boolean, value long"), 23)
    assert not empty.holds(np.array([5, -1]), np.array([7, -1])).any()


@pytest.mark.parametrize("span", [41, 83])
@pytest.mark.parametrize("variants", [False, True])
def test_composite_index_sends_only_pairs_of_ambiguous_kmers(spark, span, variants):
    """Looked up in mapped files and joined, the rows are equal; mapped, no window is shuffled to be told whether it is ambiguous."""
    cfg, bases = catalog.CFG, F.expr(fixtures.COPY_BASES)
    t = cut(catalog.tiles(spark, SF, bases))
    index = cut(index_of.compact(index_of.occurrences(t, cfg)))
    snps = catalog.snps(spark, SF, bases) if variants else None
    joined, there = (index_of.composite_index(t, index, span, c, snps) for c in (dataclasses.replace(cfg, mapped_rows=0), cfg))
    want = sorted(map(tuple, joined.collect()), key=str)
    assert want and sorted(map(tuple, there.collect()), key=str) == want
    assert "LeftSemi" not in there._jdf.queryExecution().optimizedPlan().toString()


def test_mapped_and_broadcast_look_ups_give_equal_breakpoints(spark, monkeypatch):
    """An index beyond ``broadcast_rows`` is searched in files: the reads' k-mers are not shuffled."""
    contigs, reads = repeat_reads(spark, 5)
    index = pipelines.build_index(contigs, catalog.CFG)
    pairs = index["long"].count() + index["spaced"].count()
    assert 0 < pairs < index["kmers"].count()
    find = lambda c: R.breakpoints(reads, index["kmers"], index["long"], index["spaced"], c)
    want = sorted(map(tuple, find(catalog.CFG).collect()))
    large = find(dataclasses.replace(catalog.CFG, broadcast_rows=pairs))
    assert "Join" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert want and sorted(map(tuple, large.collect())) == want
    monkeypatch.setattr(R, "SMALL", 0)
    assert sorted(map(tuple, find(catalog.CFG).collect())) == want


def test_hits_of_reads_are_not_shuffled(spark):
    """Mapped and joined hits are equal, also of short reads, of N, of empty and null mates; no join where mapped."""
    contigs, reads = repeat_reads(spark, 6)
    index = pipelines.build_index(contigs, catalog.CFG)["kmers"]
    some = [tuple(r)[:3] for r in reads.limit(20).collect()]
    odd = [(900, "", some[0][2]), (901, some[1][1], None), (902, some[2][1][:60] + "N" + some[2][1][61:], some[2][2][:22]), (903, None, some[3][2])]
    rows = spark.createDataFrame(some + odd, "read_id long, r1_seq string, r2_seq string")
    there = R.hits_of(rows, index, catalog.CFG)
    want = sorted(map(tuple, R.joined_hits(rows, index, catalog.CFG).collect()))
    assert want and sorted(map(tuple, there.collect())) == want
    assert "Join" not in there._jdf.queryExecution().optimizedPlan().toString()


def test_reads_carry_no_chunk_into_a_shuffle(spark):
    """What a row of lineitem is cut from is left at the join that finds it."""
    plan = fixtures.reads(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3  # of a fragment from one contig, and of the two halves of a planted one
    db = duckdb.connect()
    for name in ("part", "lineitem"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = db.execute(f"with {fixtures.CONTIGS_SQL}, {fixtures.READS_SQL} select read_id, r1_seq, r2_seq from reads").fetchall()
    assert sorted(map(tuple, fixtures.reads(spark, SF).select("read_id", "r1_seq", "r2_seq").collect())) == sorted(want)


def test_reads_without_a_breakpoint_give_no_rows(spark):
    """A batch none of whose reads has a record, whichever way k-mers are looked up."""
    contigs, _ = repeat_reads(spark, 7)
    seq = contigs.first().seq
    index = pipelines.build_index(contigs, catalog.CFG)
    reads = spark.createDataFrame([(i, seq[:140], kernels.revcomp(seq[60:200]), 1, 2) for i in range(3)], "read_id long, r1_seq string, r2_seq string, bar1 long, bar2 long")
    for cfg in (catalog.CFG, dataclasses.replace(catalog.CFG, broadcast_rows=0)):
        assert R.breakpoints(reads, index["kmers"], index["long"], index["spaced"], cfg).collect() == []


def test_kmers_are_never_broadcast(spark, tmp_path):
    """What a Python map makes of a small file may be large, whatever Spark takes its size to be."""
    path = str(tmp_path / "segments")
    spark.createDataFrame([(0, 0, 64, 31, "ACGT" * 16)], "seg_idx int, start int, end int, code long, ref string").write.parquet(path)
    segments = spark.read.parquet(path)
    index = spark.createDataFrame([(1, 31, None)], "kmer long, code long, pos int")
    kmers = seq.kmers(segments.select("ref"), "ref", catalog.CFG.k)
    reads = segments.select(F.col("seg_idx").cast("long").alias("read_id"), F.col("ref").alias("r1_seq"), F.col("ref").alias("r2_seq"))
    for df in (index_of.neighbourhood(segments, index, catalog.CFG), index_of.members(kmers, kmers), R.joined_hits(reads, index.withColumn("repeat_cat", F.lit(0)), catalog.CFG)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_reads_that_stand_in_a_segment_are_not_scanned(spark, monkeypatch):
    """Only reads that have no breakpoint are left out: both mates as they are, on one strand, in one segment."""
    contigs, reads = repeat_reads(spark, 8)
    index = pipelines.build_index(contigs, catalog.CFG)
    monkeypatch.setattr(R, "SMALL", 0)
    find = lambda segments: sorted(map(tuple, R.breakpoints(reads, index["kmers"], index["long"], index["spaced"], catalog.CFG, segments).collect()))
    want = find(None)
    assert want and find(index["segments"]) == want

    index = pipelines.build_index(fixtures.contigs(spark, SF), catalog.CFG)
    held, bases = R.mapped_index(index["kmers"], catalog.CFG), mapped.store_bases(index_of.own_bases(index["segments"]))
    (s, e), (t, f) = ((r.ref[: r.end - r.start], r.end - r.start) for r in index["segments"].orderBy("seg_idx").take(2))
    back = kernels.revcomp
    x = 500
    cases = [
        (s[x : x + 100], back(s[x + 200 : x + 300]), True),
        (back(s[x + 200 : x + 300]), s[x : x + 100], True),
        (s[x : x + 140], back(s[x + 60 : x + 200]), True),  # mates that are put together
        (s[:100], back(s[e - 90 :]), True),
        (s[x : x + 50] + back(s[x + 50]) + s[x + 51 : x + 100], back(s[x + 200 : x + 300]), False),
        (s[x : x + 50] + "N" + s[x + 51 : x + 100], back(s[x + 200 : x + 300]), False),
        (s[x : x + 100].lower(), back(s[x + 200 : x + 300]), False),
        (s[x : x + 100], s[x + 200 : x + 300], False),
        (s[x : x + 100], back(t[x : x + 100]), False),
        (s[x : x + 100], "", False),
        (s[e - 60 :] + t[22:62], back(t[x : x + 100]), False),  # over the border
    ]
    got = R.explained(pa.array([a for a, _, _ in cases]), pa.array([b for _, b, _ in cases]), held, bases, catalog.CFG)
    assert got.tolist() == [c for _, _, c in cases]


def test_mates_put_together_wrongly_are_scanned(spark):
    """A word of R2 that R1 has at another place makes of two pieces of a segment something that is none."""
    rng = random.Random(9)
    seq = "".join(rng.choices("ACGT", k=3000))
    seq = seq[:600] + seq[270:310] + seq[640:]
    index = pipelines.build_index(spark.createDataFrame([("c", 0, seq)], "chrom string, chrom_idx int, seq string"), catalog.CFG)
    held, bases = R.mapped_index(index["kmers"], catalog.CFG), mapped.store_bases(index_of.own_bases(index["segments"]))
    r1, r2 = seq[210:330], kernels.revcomp(seq[520:640])
    assert kernels.merge_mates(r1, r2, catalog.CFG.k)[1] == ""
    assert R.explained(pa.array([r1, r1]), pa.array([r2, kernels.revcomp(seq[400:520])]), held, bases, catalog.CFG).tolist() == [False, True]


def test_reads_are_made_ready_in_batches(spark):
    """The batches' filters and barcodes equal those in SQL, also of nulls, empty, short and other letters."""
    rng = random.Random(10)
    rows = []
    for i in range(300):
        n = rng.choice([0, 5, 12, 30, 100])
        mates = ["".join(rng.choices("ACGTN" if rng.random() < 0.1 else "ACGT", k=n)) for _ in range(2)]
        quals = ["".join(rng.choices("!5:;I ", [1, 1, 1, 3, 3, 1], k=n)) for _ in range(2)]
        for x in (mates, quals):
            if rng.random() < 0.1:
                x[rng.randrange(2)] = rng.choice([None, "", "é" + "ACGT" * 10, "ACGTé" * 9, "acgt" * 10])
        rows.append((i, *mates, *quals))
    df = spark.createDataFrame(rows, "read_id long, r1_seq string, r2_seq string, r1_qual string, r2_qual string").coalesce(1)
    for r1, r2, all_low in (((0, 0, 0), (0, 0, 0), False), ((0, 8, 8), (2, 5, 3), True)):
        want = R.with_barcodes(R.good_quality(df, all_low=all_low), r1, r2).select(R.READY)
        got = df.mapInArrow(R.ready_batches(r1, r2, all_low=all_low), want.schema)
        assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
