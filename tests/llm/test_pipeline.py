"""The corpus pipeline on planted documents: what goes at each stage, and what stays."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    junk = ["".join(rng.choice("QXZ!#0123456789") for _ in range(rng.randint(3, 9))) for _ in range(200)]
    line = lambda n, w=words: " ".join(rng.choice(w) for _ in range(n))
    clean = [(i, "\n".join(line(rng.randint(12, 30)) for _ in range(rng.randint(2, 6)))) for i in range(120)]
    bad = [(1000 + i, "\n".join(line(14, junk) for _ in range(4))) for i in range(60)]
    item = line(20)
    more = [(2000 + i, t) for i, t in clean[:10]]  # exact copies
    # near copies differ in three words of one long line
    long = [(3000 + 2 * i, line(200)) for i in range(8)]
    near = []
    for i, t in long:
        w = t.split()
        for k in (30, 90, 150):
            w[k] = rng.choice(words)
        near.append((i + 1, " ".join(w)))
    hold = [(4000 + i, f"{line(30)} {item} {line(30)}") for i in range(5)]
    extra = [(5000, None), (5001, ""), (5002, clean[0][1].split("\n")[0])]  # the last has a line of another only
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*clean, *bad, *more, *long, *near, *hold, *extra]]
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda rows: {i for i, _ in rows}
    return ids(clean), ids(bad), ids(more), ids(long), ids(near), ids(hold)


def test_each_stage_takes_what_is_planted_and_nothing_else(spark, tmp_path):
    clean, bad, copies, long, near, hold = corpus(spark, str(tmp_path))
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, str(tmp_path)))
        left.append((name, {r[0] for r in docs.select("doc_id").collect()}))
        if stage is not pipeline.STAGES[-1][1]:
            assert docs.columns == pipeline.COLUMNS
    after = dict(left)
    assert not after["quality classifier"] & bad and after["quality classifier"] >= clean | copies | long | near | hold
    lines = after["line dedup"]
    assert lines >= clean | long | hold and not lines & copies and 5002 not in lines
    joined = after["n-gram Jaccard join"]
    assert joined >= clean | long and not joined & near
    assert after["benchmark decontamination"] >= clean | long and not after["benchmark decontamination"] & hold
    assert after["packing"] == {i for i in after["benchmark decontamination"] if i != 5001 and i != 5000}
    whole = pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in whole.select("doc_id").collect()} == after["packing"]


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        docs = pipeline.cut(out) if name != "packing" else docs


@pytest.mark.parametrize("k", range(4))
def test_stages_take_nulls_repeated_rows_and_other_columns(spark, tmp_path, k):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words of an item that no text has in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None, 1), (None, "a text without an id", None, None, None, 1), (1, "one line of words", "en", "s", 17, 1), (1, "one line of words", "en", "s", 17, 1), (2, "", "en", "s", 0, 1), (3, "word " * 30_000, "en", None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", component_id int")
    out = pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.columns == pipeline.COLUMNS and {r.doc_id for r in out.collect()} >= {None, 1, 3}
