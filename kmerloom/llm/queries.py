"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, langid, license_scan, line_dedup, ngram_join, packing, quality, secrets, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    return F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its numbers of lines and the lines that go, as copies or near copies of kept ones."""
    docs = table(spark, sf_dir, "documents")
    got = line_dedup.line_dedup(docs)
    out = docs.select("doc_id").join(got, "doc_id", "left")
    n = F.coalesce("n_lines", F.lit(0)).cast("long")
    gone = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - gone).alias("n_kept"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_dedup(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "license", "coverage", "n_hits", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["start"].cast("string"), h["end"].cast("string"))), ",").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(), "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "contaminated", F.array_join(F.col("items").cast("array<string>"), ",").alias("item_ids"), F.array_join(F.col("distances").cast("array<string>"), ",").alias("distances"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out(), "lang_pred", "score", "rejected")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), 3, 90)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.secret_scan(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex"))
    return got.select("doc_id", *counts, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.concat(base, "random")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_vector_dedup, op3_license_scan, op4_quality, op5_decontaminate, op6_language_id, op7_ngram_join, op8_html_text, op9_packing, op10_secret_scan)}

#: The smallest id that links reach, from ``link(a, b)`` in both directions and ``node(id)``; links are few at the scale of the check.
_REACH = "reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op2_vector_dedup": f"""WITH RECURSIVE fit AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fit p JOIN fit q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_inner_product(p.v, q.v) / sqrt(list_inner_product(p.v, p.v) * list_inner_product(q.v, q.v)) >= 0.98),
node AS (SELECT vec_id AS id FROM embeddings), {_REACH},
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id""",
    "op7_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
size AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), flat AS (SELECT doc_id, unnest(s) AS x FROM s),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
node AS (SELECT doc_id AS id FROM documents), {_REACH},
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT size.doc_id, size.n AS n_shingles, coalesce(counted.n, 0) AS n_links, component_id FROM size JOIN least ON least.a = size.doc_id LEFT JOIN counted ON counted.a = size.doc_id""",
}
