"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (counts
of character classes and hashed words, repetition, shape) and embedded; gated
attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages, and
the weighted sum is scored. Only the document's label teaches the attention. The
model is fitted with Adam on at most MAX_TRAIN labelled documents, chosen by a hash
of their id; scoring reads every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, let_go, parquet, tidy

PASSAGE, HASHED, EMBED, ATTEND = 48, 64, 32, 16
MAX_TRAIN, EPOCHS, THRESHOLD, FOLDS = 4000, 60, 0.3, 5

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".", ",", "|", "!", "?", "#", "$", "%", "&", "*", "@", "\"'`", "()[]{}<>", "-_=+/\\~^", ":;"]
_KINDS = len(_CLASSES) + 2
_TABLE = np.full(256, _KINDS - 1, np.int64)
_TABLE[128:] = _KINDS - 2
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c.encode())] = _i
SIZE = _KINDS + HASHED + 9


def encode(text: str | None) -> np.ndarray:
    """One row of features per passage; a text without words has one passage of zeros."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    if not words:
        return np.zeros((1, SIZE), np.float32)
    n = len(words)
    count = -(-n // PASSAGE)
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1]
    at = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    kinds = np.bincount(at * _KINDS + _TABLE[data], minlength=count * _KINDS).reshape(count, _KINDS).astype(np.float32)
    codes = np.fromiter(map(crc32, words), np.int64, n)
    bag = np.arange(n) // PASSAGE
    sizes = np.bincount(bag, minlength=count).astype(np.float32)
    hashed = np.bincount(bag * HASHED + codes % HASHED, minlength=count * HASHED).reshape(count, HASHED) / sizes[:, None]
    distinct = np.bincount(np.unique((bag << 32) | codes) >> 32, minlength=count) / sizes
    again = np.zeros(n)
    again[1:] = codes[1:] == codes[:-1]
    repeat = np.bincount(bag, again, count) / sizes
    chars = kinds.sum(1)
    _, tally = np.unique(codes, return_counts=True)
    shape = np.stack([
        distinct, repeat, np.log1p(sizes), chars / sizes / 10, kinds[:, 1] / (kinds[:, 0] + kinds[:, 1] + 1), np.log1p(kinds[:, 4]),
        np.full(count, len(tally) / n), np.full(count, tally.max() / n), np.full(count, np.log1p(n) / 5),
    ], 1)
    return np.concatenate([np.sqrt(kinds / chars[:, None]), np.sqrt(hashed), shape], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights as plain arrays, so that a closure carries them to the executors."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)
        self.w = {"E": draw(SIZE, EMBED), "e": np.zeros(EMBED), "V": draw(EMBED, ATTEND), "U": draw(EMBED, ATTEND), "a": draw(ATTEND, 1)[:, 0], "c": draw(EMBED, 1)[:, 0], "b": np.zeros(1)}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """x: passages of several documents in a row; first: where each document begins."""
        w = self.w
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        energy = (v * u) @ w["a"]
        sizes = np.diff([*first, len(x)])
        weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), sizes))
        weight /= np.repeat(np.add.reduceat(weight, first), sizes)
        pooled = np.add.reduceat(h * weight[:, None], first, axis=0)
        return z, h, v, u, weight, sizes, pooled, _sigmoid(pooled @ w["c"] + w["b"])

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant if self.constant is not None else 0.0)
        first = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags), first)[-1]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Model:
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(labels) else 0.5
            return self
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 0.02
        rng, w = np.random.default_rng(seed), self.w
        slow, fast = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
        step, total = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                own = [bags[i] for i in at]
                first = np.cumsum([0, *map(len, own)])[:-1]
                z, h, v, u, weight, sizes, pooled, p = self.forward(np.concatenate(own), first)
                d = (p - labels[at]) / len(at)
                grad = {"c": pooled.T @ d, "b": np.array([d.sum()])}
                d_pool = np.repeat(d[:, None] * w["c"], sizes, axis=0)
                d_weight = (h * d_pool).sum(1)
                d_energy = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, first), sizes))
                grad["a"] = (v * u).T @ d_energy
                gate = d_energy[:, None] * w["a"]
                d_v, d_u = gate * u * (1 - v * v), gate * v * u * (1 - u)
                grad["V"], grad["U"] = h.T @ d_v, h.T @ d_u
                d_h = (d_pool * weight[:, None] + d_v @ w["V"].T + d_u @ w["U"].T) * (1 - h * h)
                grad["E"], grad["e"] = z.T @ d_h, d_h.sum(0)
                step += 1
                pace = rate * (1 - step / (total + 1))
                for name in w:
                    g = grad[name] + decay * w[name]
                    slow[name] = 0.9 * slow[name] + 0.1 * g
                    fast[name] = 0.999 * fast[name] + 0.001 * g * g
                    w[name] -= pace * (slow[name] / (1 - 0.9**step)) / (np.sqrt(fast[name] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> Model:
    """Fits on at most ``most`` labelled documents outside the held-out fold. Without labels of
    both classes the score is the one label, or 0.5."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("__y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``most``
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").alias("__y"))  # one row of a repeated id

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["__y"].astype("int32"), "x": [encode(t).tobytes() for t in pdf["text"]]})

    bounded_batches(docs)
    rows = picked.mapInPandas(tidy(features), "doc_id long, y int, x binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    bags = [np.frombuffer(x, np.float32).reshape(-1, SIZE) for x in rows["x"]]
    return Model().fit(bags, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` and ``out`` of every row; null and empty texts are scored as a passage without words."""
    names = [*keep, *([] if text in keep else [text])]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            scores: list[float] = []
            for k in range(0, batch.num_rows, 128):
                scores += model.score([encode(t) for t in batch.column(at).slice(k, 128).to_pylist()]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, out])

    bounded_batches(docs)
    kept = docs.select(*names)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(tidy(run), f"{head}, `{out}` double")


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels outside the held-out fold. Null and empty texts have the
    score of a passage without words; repeated rows are scored each; an empty table has no rows."""
    docs = parquet(spark, sf_dir, "documents")
    model = train(docs, parquet(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
