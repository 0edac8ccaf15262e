"""DNA fixtures derived from the star-schema tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S

DNA_SQL = "translate(md5(cast({} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"

CONTIGS_SQL = f"""contigs AS (
  SELECT 'chr' || (p_partkey % 5) AS chrom, CAST(p_partkey % 5 AS INT) AS chrom_idx,
         string_agg({DNA_SQL.format("CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 50 ELSE p_partkey END")}, '' ORDER BY p_partkey) AS seq
  FROM part GROUP BY ALL)"""

ROW_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"  # order and line alone repeat

READS_SQL = f"""plan AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, {ROW_ID} AS read_id,
         l_orderkey % 20 = 0 AS planted, (l_orderkey // 20) % 20 AS j FROM lineitem),
placed AS (
  SELECT p.*, a.seq AS a_seq, b.seq AS b_seq,
         CASE WHEN planted THEN 200 + 40 * j ELSE (l_orderkey * 37 + l_linenumber * 101) % (length(a.seq) - 400) END AS a_pos,
         300 + 40 * j AS b_pos, 30 + (l_linenumber * 7 + l_orderkey) % 41 AS s
  FROM plan p JOIN contigs a ON a.chrom_idx = CASE WHEN planted THEN j % 5 ELSE l_orderkey % 5 END
              JOIN contigs b ON b.chrom_idx = (j + 1) % 5),
fragments AS (
  SELECT read_id, l_orderkey, l_suppkey, planted,
         CASE WHEN planted THEN substr(a_seq, CAST(a_pos - s + 1 AS BIGINT), CAST(s AS BIGINT)) || substr(b_seq, CAST(b_pos + 1 AS BIGINT), CAST(300 - s AS BIGINT))
              ELSE substr(a_seq, CAST(a_pos + 1 AS BIGINT), 300) END AS fragment FROM placed),
reads AS (
  SELECT read_id, 'read' || read_id AS name, substr(fragment, 1, 100) AS r1_seq,
         reverse(translate(substr(fragment, length(fragment) - 99, 100), 'ACGT', 'TGCA')) AS r2_seq,
         repeat(CASE WHEN read_id % 11 = 0 THEN '5' ELSE 'I' END, 100) AS r1_qual, repeat('I', 100) AS r2_qual,
         l_orderkey, l_suppkey, planted FROM fragments)"""


# Contigs that are every other 512 bases a copy of one element; a base out of six is changed in about half of the
# copies, so that a k-mer is in several copies and a longer word in few. The same text is SQL for both engines.
_D = "translate(md5(cast({} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_BLOCK, _PIECE = "cast(floor(p_partkey / 80) as int)", "cast(floor(p_partkey / 5) as int) % 16"
_E, _M = _D.format(f"100000 + {_PIECE}"), f"md5(cast(({_BLOCK} * 5 + p_partkey % 5) * 16 + {_PIECE} as string))"
_CHANGED = ", ".join(f"case when substr({_M}, {q}, 1) < '8' then translate(substr({_E}, {q}, 1), 'ACGT', 'CGTA') else substr({_E}, {q}, 1) end, substr({_E}, {q + 1}, {4 if q == 28 else 5})" for q in (4, 10, 16, 22, 28))
COPY_BASES = f"case when {_BLOCK} % 2 = 1 then concat(substr({_E}, 1, 3), {_CHANGED}) else {_D.format('p_partkey')} end"
COPIES_SQL = f"""contigs AS (
  SELECT 'chr' || (p_partkey % 5) AS chrom, CAST(p_partkey % 5 AS INT) AS chrom_idx, string_agg({COPY_BASES}, '' ORDER BY p_partkey) AS seq FROM part GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(x: Column) -> Column:
    return F.translate(F.md5(x.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


CHUNK = 32  # pieces of 32 bases; a chunk has 12 more, so that it holds every fragment that begins in it
MORE = 12


def _pieces(spark: SparkSession, sf_dir: str, bases: Column | None = None) -> DataFrame:
    """(chrom_idx, r, bases): the pieces of 32 bases of the contigs in order."""
    from pyspark.sql import Window

    key = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 50).otherwise(F.col("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("chrom_idx"), (dna(key) if bases is None else bases).alias("bases"))
    return part.select("chrom_idx", (F.row_number().over(Window.partitionBy("chrom_idx").orderBy("p_partkey")) - 1).alias("r"), "bases")


def tiles(spark: SparkSession, sf_dir: str, size: int, more: int, bases: Column | None = None) -> DataFrame:
    """(tile_idx, chrom, chrom_idx, start, end, seq): tiles of ``size`` bases of the contigs with ``more`` after them, in order.

    Tiles are put together from pieces, so that no row holds a contig and none is copied for each of its tiles.
    """
    from pyspark.sql import Window

    pieces = _pieces(spark, sf_dir, bases)
    n = F.ceil(F.count("*") * 32 / size).cast("int")
    first = pieces.groupBy("chrom_idx").agg(n.alias("n")).select("chrom_idx", (F.sum("n").over(Window.orderBy("chrom_idx")) - F.col("n")).cast("int").alias("_first"))  # five contigs
    at = F.expr(f"explode(sequence(greatest(0, cast(floor((r * 32 - {size + more}) / {size}) as int) + 1), cast(floor((r * 32 + 31) / {size}) as int)))")
    t = _joined(pieces.select("*", at.alias("tile")), "chrom_idx", "tile", first="_r").join(F.broadcast(first), "chrom_idx")
    t = t.withColumn("start", F.col("tile") * size).withColumn("seq", F.expr(f"substring(seq, start - _r * 32 + 1, {size + more})"))
    return _named(t, (F.col("_first") + F.col("tile")).alias("tile_idx"), "start", (F.col("start") + F.length("seq")).alias("end"))


def points(spark: SparkSession, sf_dir: str, step: int, bases: Column | None = None) -> DataFrame:
    """(chrom, chrom_idx, pos, seq): every ``step``-th base of each contig, counted from 1, and up to four bases after it."""
    from pyspark.sql import Window

    pieces = _pieces(spark, sf_dir, bases).withColumn("after", F.coalesce(F.lead("bases").over(Window.partitionBy("chrom_idx").orderBy("r")), F.lit("")))
    at = pieces.withColumn("pos", F.explode(F.expr(f"filter(transform(sequence(cast(r * 32 div {step} as int), cast((r + 1) * 32 div {step} as int)), x -> x * {step}), x -> x > r * 32 and x <= (r + 1) * 32)")))
    return _named(at.withColumn("seq", F.expr("substring(concat(bases, after), pos - r * 32, 5)")), "pos")


def _joined(pieces: DataFrame, *keys: str, first: str | None = None) -> DataFrame:
    """The bases of each group in order, and if ``first`` is given the least ``r`` under that name."""
    parts = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "bases"))).alias("parts"))
    return parts.select(*keys, F.array_join(F.transform("parts", lambda x: x["bases"]), "").alias("seq"), *([F.col("parts")[0]["r"].alias(first)] if first else []))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, chrom_idx, seq)"""
    return _named(_joined(_pieces(spark, sf_dir), "chrom_idx"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, chrom_idx, seq) with many copies of an element."""
    return _named(_joined(_pieces(spark, sf_dir, F.expr(COPY_BASES)), "chrom_idx"))


def _named(contigs: DataFrame, *more) -> DataFrame:
    return contigs.select(F.concat(F.lit("chr"), F.col("chrom_idx").cast("string")).alias("chrom"), "chrom_idx", *more, "seq")


def chunks(pieces: DataFrame) -> DataFrame:
    """(chrom_idx, chunk, seq): overlapping chunks, so that a fragment is cut from a short row."""
    own = F.floor(F.col("r") / CHUNK).cast("int")
    both = F.when((F.col("r") % CHUNK < MORE) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return _joined(pieces.withColumn("chunk", F.explode(both)), "chrom_idx", "chunk")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, name, r1_seq, r2_seq, r1_qual, r2_qual, l_orderkey, l_suppkey, planted, fragment)"""
    item = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"{ROW_ID} as read_id").repartition(spark.sparkContext.defaultParallelism)  # the table is one file
    item = item.withColumn("planted", F.col("l_orderkey") % 20 == 0).withColumn("j", F.expr("(l_orderkey div 20) % 20"))
    pieces = _pieces(spark, sf_dir)
    size = pieces.groupBy(F.col("chrom_idx").alias("a_idx")).agg((F.count("*") * 32).alias("size"))  # five contigs
    chunk = chunks(pieces)
    item = item.withColumn("a_idx", F.expr("cast(case when planted then j % 5 else l_orderkey % 5 end as int)")).withColumn("b_idx", F.expr("cast((j + 1) % 5 as int)")).join(F.broadcast(size), "a_idx")
    item = item.selectExpr("*", "30 + (l_linenumber * 7 + l_orderkey) % 41 as s", "300 + 40 * j as b_at")
    item = item.selectExpr("*", "case when planted then 200 + 40 * j - s else (l_orderkey * 37 + l_linenumber * 101) % (size - 400) end as a_at", "case when planted then s else 300 end as a_n")
    base = 32 * CHUNK

    def at(rows: DataFrame, x: str, n: str, name: str) -> DataFrame:
        """Adds ``n`` bases of contig ``x``; the chunk they are cut from goes at once, as what is shuffled next would carry it."""
        rows = rows.withColumn("chunk", F.expr(f"cast({x}_at div {base} as int)")).join(chunk.toDF(f"{x}_idx", "chunk", "_seq"), [f"{x}_idx", "chunk"], "left")
        return rows.withColumn(name, F.expr(f"substr(_seq, cast({x}_at % {base} + 1 as int), cast({n} as int))")).drop("_seq", "chunk")

    columns = ["read_id", "l_orderkey", "l_suppkey", "planted"]
    plain = at(item.where("not planted"), "a", "a_n", "fragment").select(*columns, "fragment")
    two = at(at(item.where("planted"), "a", "a_n", "_a"), "b", "300 - s", "_b").select(*columns, F.concat("_a", "_b").alias("fragment"))
    both = plain.unionByName(two)
    return both.select(
        "read_id",
        F.concat(F.lit("read"), F.col("read_id").cast("string")).alias("name"),
        F.expr("substr(fragment, 1, 100)").alias("r1_seq"),
        S.revcomp(F.expr("substr(fragment, length(fragment) - 99, 100)")).alias("r2_seq"),
        F.expr("repeat(case when read_id % 11 = 0 then '5' else 'I' end, 100)").alias("r1_qual"),
        F.expr("repeat('I', 100)").alias("r2_qual"),
        "l_orderkey",
        "l_suppkey",
        "planted",
        "fragment",
    )
