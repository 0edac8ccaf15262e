"""Tables of packed k-mers in files of the shared folder, which Python workers map into memory and search.

No row of such a table goes through the driver, none is shuffled again for a look-up, and the pages that are mapped are
shared by all workers of a machine and given back when memory is short.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed
from ..plans.scratch import local_root, remove_at_exit

#: Keys are dealt over so many parts of the files, each of which one task writes.
PARTS = 1 << 8
_LOW = np.uint64((1 << 62) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OPEN: dict = {}


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one map of 62-bit keys that makes their upper bits even."""
    return (keys.astype(np.uint64) * _ODD) & _LOW


class Mapped:
    """A table by strand-free k-mers: records (key, bits above it: 62 held as the smaller strand, 63 a flag; a value)
    in the order of mixed keys, and where each bucket of the keys' first ``bits`` bits begins."""

    def __init__(self, path: str, k: int, n: int, bits: int):
        self.path, self.k, self.n, self.bits = path, k, n, bits

    def _arrays(self):
        if self.path not in _OPEN:
            if len(_OPEN) > 8:
                _OPEN.clear()
            kind = np.dtype(np.uint64)
            _OPEN[self.path] = (np.asarray(np.memmap(f"{self.path}/starts", np.int64, "r")), np.asarray(np.memmap(f"{self.path}/records", kind, "r", shape=(self.n, 2))) if self.n else np.zeros((0, 2), kind))
        return _OPEN[self.path]

    def matches(self, words: np.ndarray, turned: np.ndarray):
        """(query, strand, flag, value) of each record that equals a k-mer (strand 0) or its reverse complement (1); -1 has none."""
        starts, records = self._arrays()
        low = words <= turned
        key = mixed(np.where(low, words, turned))
        bucket = (key >> np.uint64(62 - self.bits)).astype(np.int64)
        at, end = starts[bucket], starts[bucket + 1]
        live = np.flatnonzero((at < end) & (words >= 0))
        at, end, key = at[live], end[live], key[live]
        found: list[tuple] = []
        while len(live):
            head = records[at, 0]
            hit = np.flatnonzero((head & _LOW) == key)
            if len(hit):
                q, h = live[hit], head[hit]
                value, flag, own = records[at[hit], 1].astype(np.int64), (h >> np.uint64(63)).astype(bool), ((h >> np.uint64(62)) & np.uint64(1)).astype(bool) == low[q]
                found.append((q, np.where(own, 0, 1), flag, value))
                both = np.flatnonzero(words[q] == turned[q])  # only k-mers of even length
                if len(both):
                    found.append((q[both], np.ones(len(both), np.int64), flag[both], value[both]))
            at = at + 1
            go = np.flatnonzero(at < end)
            at, end, key, live = at[go], end[go], key[go], live[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def holds(self, words: np.ndarray, turned: np.ndarray) -> np.ndarray:
        """(2, n): whether each k-mer, and its reverse complement, is in the table."""
        out = np.zeros((2, len(words)), bool)
        query, strand, _, _ = self.matches(words, turned)
        out[strand, query] = True
        return out


class Bases:
    """The own bases of segments, one after the other in the order of their codes; ``table`` has each one's code and where it begins."""

    def __init__(self, path: str):
        self.path = path

    def arrays(self):
        """(codes, begins, bases): ``begins`` has one number more than there are segments."""
        if self.path not in _OPEN:
            if len(_OPEN) > 8:
                _OPEN.clear()
            codes, begins = np.fromfile(f"{self.path}/table", np.int64).reshape(2, -1)
            n = os.path.getsize(f"{self.path}/bases")
            _OPEN[self.path] = (codes[:-1], begins, np.asarray(np.memmap(f"{self.path}/bases", np.uint8, "r")) if n else np.zeros(0, np.uint8))
        return _OPEN[self.path]


def store_bases(segments: DataFrame) -> Bases | None:
    """The files of ``segments(code, bases)``; None where the shared folder is no local path or codes are not distinct.

    Segments are at most 201,376, and only their codes and sizes go through the driver.
    """
    spark = segments.sparkSession
    root = local_root(spark)
    if root is None:
        return None
    sizes = segments.select("code", F.octet_length("bases").alias("n")).toArrow().sort_by("code")
    codes, n = (sizes.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    if len(np.unique(codes)) < len(codes):
        return None
    begins = np.cumsum(np.r_[0, n])
    path = f"{root}/kmerloom-{uuid.uuid4().hex}"
    os.makedirs(path)
    remove_at_exit(spark, path)
    np.concatenate([codes, [-1], begins]).tofile(f"{path}/table")
    with open(f"{path}/bases", "wb") as f:
        f.truncate(int(begins[-1]))

    def write(batches):
        done = 0
        f = os.open(f"{path}/bases", os.O_WRONLY)
        try:
            for b in batches:
                for code, bases in zip(b.column("code").to_pylist(), b.column("bases").to_pylist()):
                    _write(f, bases.encode(), int(begins[np.searchsorted(codes, code)]))
                    done += 1
            os.fsync(f)
        finally:
            os.close(f)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    written = segments.select("code", "bases").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if written != len(codes):
        raise RuntimeError(f"{written} of {len(codes)} segments are in the files: the table changed between two readings")
    return Bases(path)


def _write(f: int, raw, place: int) -> None:
    raw, done = memoryview(raw).cast("B"), 0
    while done < len(raw):
        done += os.pwrite(f, raw[done:], place + done)


def store(table: DataFrame, k: int) -> Mapped | None:
    """The files of ``table(kmer, flag boolean, value long)``; None where the shared folder is no local path.

    The table is read twice, so it had better be a written one. K-mers are distinct and not null.
    """
    spark = table.sparkSession
    root = local_root(spark)
    if root is None:
        return None

    def keyed(batches):
        for b in batches:
            words = b.column("kmer").to_numpy(zero_copy_only=False)
            turned = packed.complement(words, k)
            own = words <= turned
            key = mixed(np.where(own, words, turned))
            head = key | (own.astype(np.uint64) << np.uint64(62)) | (b.column("flag").to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(54)).astype(np.int32)), pa.array(head.view(np.int64)), b.column("value")], names=["part", "head", "value"])

    rows = table.select("kmer", "flag", "value").mapInArrow(keyed, "part int, head long, value long")
    counts = np.zeros(PARTS, np.int64)
    for r in rows.groupBy("part").count().collect():
        counts[r["part"]] = r["count"]
    n, first = int(counts.sum()), np.cumsum(counts) - counts
    bits = max(8, int(max(n - 1, 1)).bit_length())
    path, each = f"{root}/kmerloom-{uuid.uuid4().hex}", 1 << bits - 8
    os.makedirs(path)
    remove_at_exit(spark, path)
    with open(f"{path}/starts", "wb") as f:  # also those of parts without a row
        for p in range(PARTS):
            np.full(each, first[p], np.int64).tofile(f)
        np.array([n], np.int64).tofile(f)
    with open(f"{path}/records", "wb") as f:
        f.truncate(16 * n)

    def write(batches):
        held = [(b.column("part").to_numpy(), b.column("head").to_numpy(), b.column("value").to_numpy()) for b in batches]
        if held:
            part, head, value = (np.concatenate(x) for x in zip(*held))
            head = head.view(np.uint64)
            order = np.argsort(head & _LOW, kind="stable")
            part, head, value = part[order], head[order], value[order]
            for p in np.unique(part):
                lo, hi = np.searchsorted(part, [p, p + 1])
                bucket = ((head[lo:hi] & _LOW) >> np.uint64(62 - bits)).astype(np.int64) - p * each
                for name, place, data in (("records", 16 * first[p], np.column_stack([head[lo:hi], value[lo:hi].astype(np.uint64)])), ("starts", 8 * p * each, first[p] + np.searchsorted(bucket, np.arange(each)))):
                    f = os.open(f"{path}/{name}", os.O_WRONLY)
                    try:
                        _write(f, np.ascontiguousarray(data), int(place))
                        os.fsync(f)
                    finally:
                        os.close(f)
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x[0]) for x in held)], pa.int64())], names=["n"])

    written = rows.repartition("part").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise RuntimeError(f"{written} of {n} rows are in the files: the table changed between two readings")
    return Mapped(path, k, n, bits)
