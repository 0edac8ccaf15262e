"""Packing into optimal length buckets.

Token counts come from a public byte-level BPE. A document over ``MAX_TOKENS`` is cut into pieces of that many tokens
and a rest. Dynamic programming over the global histogram of piece lengths (at most ``MAX_TOKENS`` bins, so of fixed
size) chooses the bucket bounds that minimise padding; inside each bucket, batches hold ``BATCH_TOKENS // bound`` pieces each.

Batch numbers need a rank within a bucket. Pieces are dealt by a hash of their id over enough salts that each salt of a
bucket is small; ranks are local to a salt, and offsets come from the counts by (bucket, salt), summed over ranges of
``SALTS`` salts first and then inside each range.

Cases: a null or empty text has no tokens and no piece, and is in no batch; a table without tokens gives no rows.
Repeated rows are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, map_batches

MAX_TOKENS = 2048
BUCKETS = 16
BATCH_TOKENS = 32768
SALT_ROWS = 20_000
SALTS = 1000


#: Fixed value: how the default vocabulary splits a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary() -> str:
    """Path of the default vocabulary; callers may give another."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, pattern: str = PATTERN):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def work(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in (v.as_py() for v in b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return work


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    return map_batches(docs.select("doc_id", "text"), _count(path or vocabulary()), "doc_id long, n_tokens long")


def optimal_bounds(histogram: dict[int, int], k: int) -> list[int]:
    """At most k bucket bounds that cover every length with the least padding (exact, by dynamic programming)."""
    lengths = np.array(sorted(x for x, c in histogram.items() if c > 0 and x > 0), np.int64)
    if not len(lengths):
        return []
    count = np.r_[0, np.cumsum([histogram[int(x)] for x in lengths])]
    m = len(lengths)
    cost = np.full(m + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    back = []
    for _ in range(min(k, m)):
        after, frm = cost.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            # Padded tokens of a bucket with the lengths i..j-1 are its rows times its bound.
            total = cost[:j] + (count[j] - count[:j]) * lengths[j - 1]
            i = int(total.argmin())
            if total[i] < after[j]:
                after[j], frm[j] = total[i], i
        back.append(frm)
        cost = after
    out, j = [], m
    for frm in reversed(back):
        if frm[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(frm[j])
        if j == 0:
            break
    return sorted(out)


def pack(counts: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``counts(doc_id, n_tokens)`` -> (doc_id, piece, piece_tokens, bucket, bound, batch, slot), one row for each piece."""
    whole = F.lit(max_tokens)
    counts = cut(counts)  # read three times below
    pieces = (
        counts.where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / whole))).alias("piece"))
        .select("doc_id", "piece", F.least(whole.cast("long"), F.col("n_tokens") - F.col("piece") * whole).alias("piece_tokens"))
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("piece_tokens").count().collect()}
    bounds = optimal_bounds(histogram, buckets)
    if not bounds:
        return pieces.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot")).limit(0)
    bucket = F.lit(0)
    for x in bounds[:-1]:
        bucket = bucket + (F.col("piece_tokens") > x).cast("int")
    salts = max(1, -(-sum(histogram.values()) // salt_rows))
    dealt = pieces.withColumn("bucket", bucket).withColumn("bound", F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("long"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    part = dealt.groupBy("bucket", "salt").count()
    # The counts are bucket x salt rows; ranges of salts are added up first, so that no task sums all of them.
    part = part.withColumn("range", F.floor(F.col("salt") / SALTS))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = part.groupBy("bucket", "range").agg(F.sum("count").alias("n"))
    ranges = ranges.select("bucket", "range", F.coalesce(F.sum("n").over(earlier(["bucket"], "range")), F.lit(0)).alias("ahead"))
    inside = part.withColumn("inside", F.coalesce(F.sum("count").over(earlier(["bucket", "range"], "salt")), F.lit(0)))
    before = inside.join(ranges, ["bucket", "range"]).select("bucket", "salt", (F.col("inside") + F.col("ahead")).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("piece_tokens", "doc_id", "piece"))
    ranked = dealt.withColumn("local", local).join(before, ["bucket", "salt"])
    rank = F.col("before") + F.col("local") - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bound")))
    return ranked.select("doc_id", "piece", "piece_tokens", "bucket", "bound", F.floor(rank / size).alias("batch"), (rank % size).cast("long").alias("slot"))
