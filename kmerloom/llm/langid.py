"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in NumPy.

Subwords are the byte n-grams of the text with A-Z lowered. The model is learned from a bounded sample of labelled
rows (``SAMPLE`` documents of each language, the first by a hash of doc_id, ``SPAN`` characters of each; the
``LANGUAGES`` languages with most rows, as the model has a column for each); every document is predicted from its whole text. A temperature, fitted on rows that training left out, calibrates the probabilities;
the rejection cut-off is set there so that a share of ``REJECT`` of true predictions fall below it.

Cases: null text, or text without a letter, is ``und`` with score 0. With no labelled rows, everything is ``und``.
Repeated rows are predicted each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .quality import in_training
from .tables import map_batches

SAMPLE = 800
LANGUAGES = 1000
SPAN = 3000
SIZES = (3, 5)
BITS = 16
DIM = 16
EPOCHS = 6
REJECT = 0.001
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def buckets(raw: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram at each byte."""
    low = K._LOWER[raw]
    return [(K.char_hashes(low, n) >> K.U(64 - BITS)).astype(np.int64) for n in SIZES]


def _bag(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.concatenate(buckets(raw))


def train(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """A bucket-by-language table of logits, the bias, the temperature and the rejection cut-off."""
    names = sorted(set(langs))
    if not names:
        return {}
    y_all = np.array([names.index(x) for x in langs])
    bags = [_bag(t) for t in texts]
    use = np.array([len(b) > 0 for b in bags])
    held = use & (np.arange(len(bags)) % 5 == 4)
    learn = np.flatnonzero(use & ~held)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    steps, total = 0, EPOCHS * max(1, -(-len(learn) // 32))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // 32))) if len(learn) else []:
            rate = 0.5 * (1 - steps / total) + 0.01
            steps += 1
            size = np.array([len(bags[i]) for i in part])
            ids = np.concatenate([bags[i] for i in part])
            mean = np.add.reduceat(e[ids], np.cumsum(size) - size) / size[:, None]
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y_all[part]] -= 1
            p /= len(part)
            back = (p @ w.T) / size[:, None]
            w -= rate * (mean.T @ p).astype(np.float32)
            b -= rate * p.sum(0).astype(np.float32)
            grow = np.repeat(back, size, axis=0)
            for k in range(DIM):  # scatter of the gradient, one column after the other
                e[:, k] -= (rate * 200 * np.bincount(ids, weights=grow[:, k], minlength=1 << BITS)).astype(np.float32)
    table = e @ w
    z = np.array([table[bags[i]].mean(0) + b for i in np.flatnonzero(held)]).reshape(-1, len(names))
    y = y_all[held]
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60):
        if len(z):
            q = z / t
            loss = float((np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(y)), y]).mean()) + 1e-4 / t
            if loss < best:
                best, temperature = loss, float(t)
    cut = 0.0
    if len(z):
        q = z / temperature
        p = np.exp(q - q.max(1, keepdims=True))
        top = (p / p.sum(1, keepdims=True)).max(1)[z.argmax(1) == y]
        cut = float(np.quantile(top, REJECT)) if len(top) else 0.0
    return {"names": names, "table": table.astype(np.float32), "bias": b, "temperature": temperature, "cut": cut}


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> dict:
    """Two scans whatever the number of languages: the rows of each are counted, then those with small hashes are taken."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & in_training())
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not most:
        return {}
    # So that the sample is there almost surely; of what is more, the smallest hashes stay.
    share = {r[0]: min(1.0, 1.2 * (sample + 5 * sample**0.5) / r[1]) for r in most}
    least = F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))
    h = F.xxhash64("doc_id")
    unit = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 11) / float(1 << 53)
    head, tail = F.substring("text", 1, SPAN), F.expr(f"substring(text, greatest(length(text) - {SPAN} + 1, 1), {SPAN})")
    picked = rows.where(unit <= F.element_at(least, F.col("lang"))).select("doc_id", "lang", h.alias("h"), F.when(F.col("doc_id") % 2 == 0, head).otherwise(tail).alias("text"))
    of: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.h, r.doc_id, r.text)):
        if len(of.setdefault(r.lang, [])) < sample:
            of[r.lang].append(r)
    chosen = sorted((r for x in of.values() for r in x), key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in chosen], [r.lang for r in chosen])


def _predict(model: dict):
    def work(batches):
        names = model.get("names", [])
        for batch in batches:
            raw, off = K.text_bytes(batch.column("text"))
            n = len(off) - 1
            z = np.zeros((n, max(1, len(names))))
            letter = np.zeros(n, bool)
            for i, j in K.portions(off, 1 << 18) if names else ():
                part, at = raw[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64)
                seen = np.r_[0, np.cumsum(_LETTER[part])]
                letter[i:j] = seen[at[1:]] > seen[at[:-1]]
                for r in np.flatnonzero(~letter[i:j] & (at[1:] > at[:-1])):
                    letter[i + r] = any(c.isalpha() for c in part[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace"))
                count = np.zeros(j - i)
                for size, ids in zip(SIZES, buckets(part)):
                    ok = np.flatnonzero(at[1:] - at[:-1] >= size)
                    if len(ok):
                        bounds = np.stack([at[ok], at[ok + 1] - size + 1], 1).ravel()
                        got = np.concatenate([model["table"][ids], np.zeros((1, len(names)), np.float32)])
                        z[i + ok] += np.add.reduceat(got, bounds)[::2]
                        count[ok] += bounds[1::2] - bounds[::2]
                z[i:j] /= np.maximum(count, 1)[:, None]
            if names:
                q = (z + model["bias"]) / model["temperature"]
                p = np.exp(q - q.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best, score = p.argmax(1), np.where(letter, p.max(1), 0.0)
                lang = [names[k] if ok else "und" for k, ok in zip(best, letter)]
                rejected = ~letter | (score < model["cut"])
            else:
                lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return work


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs(doc_id, text)``; the model is of fixed size."""
    return map_batches(docs.select("doc_id", "text"), _predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
