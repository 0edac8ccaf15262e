"""Quality by compression: one zstandard dictionary from good and one from bad labelled text.

A text's bytes are compressed in pieces with either dictionary; the difference of the compressed sizes divided by the
length becomes a probability by a logistic curve. The curve is fitted to differences by dictionaries that have not seen
the text (``FOLDS`` folds), so every label serves both; the dictionaries of the model are then built from all of them.
Where the sample cuts a class, its rows weigh as much as the class, so the probabilities are those of all labelled rows.

Fitting reads a bounded sample (``SAMPLE`` labelled documents of each class, the first by a hash of doc_id, and of each
at most ``PIECES`` pieces spread over the text); every document is scored on its whole text. Only the text is an input
of the score.

Cases: null or empty text has difference 0 and gets the score of that. Without labelled documents of both classes the
score is 0.5. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import map_batches

SAMPLE = 2500
PIECES = 6
PIECE = 4096
DICTIONARY = 100_000
LEVEL = 3
FOLDS = 4


def in_training(col: str = "doc_id"):
    """Rows outside the held-out fold."""
    return F.expr(f"crc32(cast({col} as string)) % 5 <> 0")


def _pieces(text: bytes, most: int | None = None) -> list[bytes]:
    out = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    if most and len(out) > most:
        out = [out[i * (len(out) - 1) // (most - 1)] for i in range(most)]
    return out


def _compressor(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def difference(text: bytes, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) / length."""
    if not text:
        return 0.0
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in _pieces(text)) / len(text)


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float, float]:
    """Slope, intercept and scale of a logistic curve by Newton's method; ``weight``: how many rows one stands for."""
    scale = float(np.std(x)) or 1.0
    weight = np.ones(len(x)) if weight is None else weight / weight.mean()
    z = np.stack([x / scale, np.ones(len(x))], 1)
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (t - p)) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), scale


def dictionaries(docs: list[tuple[list[bytes], int]]) -> list[bytes] | None:
    """A dictionary for each class, from texts in pieces with their labels; none if a class has too little."""
    made = []
    for y in (0, 1):
        parts = [q[:PIECE] for ps, v in docs if v == y for p in ps for q in _pieces(p) if len(q) >= 16]
        if len(parts) < 8:
            return None
        try:
            made.append(zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, parts)) // 8)), parts, k=256, d=8).as_bytes())
        except zstandard.ZstdError:
            made.append(b"".join(parts)[:DICTIONARY])
    return made


def learn(docs: list[tuple[list[bytes], int]], weight: dict[int, float]) -> dict:
    """The model from labelled texts in pieces; ``weight``: rows of a class for one of the sample."""
    made = dictionaries(docs)
    if made is None:
        return {}
    x, y = [], []
    for k in range(FOLDS):
        fold = dictionaries([d for i, d in enumerate(docs) if i % FOLDS != k])
        if fold is None:
            continue
        bad, good = map(_compressor, fold)
        for ps, v in docs[k::FOLDS]:
            x.append(difference(b"".join(ps), good, bad))
            y.append(v)
    if len(set(y)) < 2:
        return {}
    a, b, scale = platt(np.array(x), np.array(y, float), np.array([weight[v] for v in y]))
    return {"good": made[1], "bad": made[0], "slope": a, "intercept": b, "scale": scale}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Dictionaries and the curve from labelled rows outside the held-out fold."""
    some, count = None, {}
    for y in (0, 1):
        one = labels.where((F.col("quality") == y) & F.col("doc_id").isNotNull() & in_training()).select("doc_id", "quality").distinct()
        count[y] = one.count()
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = one if some is None else some.unionByName(one)
    size, step = PIECE, PIECE * 2
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("length(text) > 0")
    # Long texts go to the driver as PIECES pieces spread over them.
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", (i * (F.length("text") - size) / (PIECES - 1) + 1).cast("int"), F.lit(size)))
    rows = rows.select("doc_id", "quality", F.when(F.length("text") <= step, F.array("text")).otherwise(spread).alias("pieces")).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    docs_ = [([p.encode() for p in rows.column("pieces")[int(i)].as_py()], rows.column("quality")[int(i)].as_py()) for i in order]
    return learn(docs_, {y: max(1.0, count[y] / sample) for y in (0, 1)})


def _score(model: dict, threshold: float):
    def work(batches):
        good, bad = (_compressor(model["good"]), _compressor(model["bad"])) if model else (None, None)
        for batch in batches:
            raw, off = K.text_bytes(batch.column("text"))
            data = raw.tobytes()
            if model:
                x = np.array([difference(data[off[r] : off[r + 1]], good, bad) for r in range(len(off) - 1)])
                score = 1 / (1 + np.exp(-np.clip(model["slope"] * x / model["scale"] + model["intercept"], -30, 30)))
            else:
                x, score = np.zeros(len(off) - 1), np.full(len(off) - 1, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(x, pa.float64())], names=["doc_id", "score", "predicted", "difference"])

    return work


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, difference) of every row of ``docs(doc_id, text)``."""
    return map_batches(docs.select("doc_id", "text"), _score(model, threshold), "doc_id long, score double, predicted int, difference double")


def _keep(model: dict, threshold: float):
    def work(batches):
        judge = _score(model, threshold)
        for batch in batches:
            for got in judge([batch.select(["doc_id", "text"])]):
                yield batch.filter(pa.array(got.column("predicted").to_numpy() == 1))

    return work


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    return map_batches(docs, _keep(model, threshold), docs.schema)
