"""Toxicity by a linear classifier on character n-grams that naive Bayes log-count ratios scale.

The document frequencies of hashed n-grams in either class give each feature its log-count ratio; the
features whose frequency in the toxic class is farthest from that in all rows, in standard errors, are kept, and logistic
regression is fitted on presence times ratio. Labelled rows for training are a bounded sample: a hash of doc_id keeps about
SAMPLE of them if there are more. Scoring covers every text as a whole.

Defined cases: null and empty texts have no features and get the score of the intercept, but are kept by keep(); rows without a
training label are only scored; of rows with one doc_id the least text trains; repeated rows and null ids are scored as they stand; without training rows of
both classes every score is the share of the toxic label (0 if there is none); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training rows at most (about), hash buckets, kept features, n-gram lengths, threshold of the decision.
SAMPLE, BUCKETS, FEATURES, LENGTHS, CUTOFF = 16_000, 1 << 20, 4096, (3, 4, 5, 6), 0.3


def grams(text: str) -> np.ndarray:
    """Buckets of the character n-grams of a lower-cased text whose white space runs are single spaces, with a space at either end."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in LENGTHS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= c[i : len(c) - n + 1 + i] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out.append(h >> np.uint32(12))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's rows: how many documents of either class hold each bucket."""
    df = np.zeros((2, BUCKETS), np.int32)
    for b in batches:
        for text, label in zip(b["text"], b["toxic"], strict=True):
            if isinstance(text, str):
                df[int(label), np.unique(grams(text))] += 1
    at = np.flatnonzero(df.any(axis=0))
    yield pd.DataFrame({"bucket": at, "neg": df[0, at], "pos": df[1, at]})


def _presence(lookup: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [present(t, lookup) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "toxic": b["toxic"], "features": [r.astype("<u2").tobytes() for r in rows]})

    return run


def present(text: str | None, lookup: np.ndarray) -> np.ndarray:
    f = lookup[grams(text)] if isinstance(text, str) and text else np.empty(0, np.int32)
    return np.unique(f[f >= 0])


def logistic(col: np.ndarray, offset: np.ndarray, y: np.ndarray, scale: np.ndarray, epochs: int = 16, batch: int = 128, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (scale included) and intercept by Adam over batches of rows in order; the features of row i are col[offset[i]:offset[i + 1]]."""
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, n = np.append(np.zeros(len(scale)), np.log(base / (1 - base))), len(y)
    m, v, t = np.zeros(len(w)), np.zeros(len(w)), 0
    for epoch in range(max(epochs, -(-300 * batch // max(n, 1)))):
        rate = 0.03 / (1 + epoch / 3)
        for at in range(0, n, batch):
            to, t = min(n, at + batch), t + 1
            own = col[offset[at] : offset[to]]
            row = np.repeat(np.arange(to - at), np.diff(offset[at : to + 1]))
            z = np.bincount(row, (scale * w[:-1])[own], to - at) + w[-1]
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at:to]
            g = np.append(np.bincount(own, e[row], len(scale)) * scale / (to - at) + decay * w[:-1], e.mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1] * scale, float(w[-1])


class Model:
    """lookup: feature of a bucket, or -1; weights of features; intercept."""

    def __init__(self, lookup: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.lookup, self.weights, self.intercept = lookup, weights, intercept

    def score(self, text: str | None) -> float:
        z = self.weights[present(text, self.lookup)].sum() + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sampled(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """About sample of n rows, by a hash of doc_id; all if there are no more."""
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n))) if n > sample else rows


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of a sample of the labels (doc_id, toxic: one row for each doc_id).

    The labels are sampled before they meet the texts, so that about sample ids (of 12 bytes) are broadcast and no text is
    shuffled but theirs.
    """
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    some = _sampled(labels, labels.count(), sample)
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return own.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic")


def train(labelled: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model from labelled (doc_id, text, toxic)."""
    labelled = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    n, pos = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    empty = np.full(BUCKETS, -1, np.int32)
    if not 0 < pos < n:
        return Model(empty, np.zeros(1), 30.0 if n and pos == n else -30.0)
    labelled = _sampled(labelled, n, sample)
    counts = labelled.mapInPandas(_frequencies, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).filter("neg + pos >= 4")
    held = counts.select(*[F.col(c).cast("int").alias(c) for c in ("bucket", "neg", "pos")]).toArrow()  # at most BUCKETS rows of 12 bytes
    bucket, with_neg, with_pos = (held.column(c).to_numpy() for c in ("bucket", "neg", "pos"))
    ratio = np.log(((with_pos + 1.0) / (pos + 2)) / ((with_neg + 1.0) / (n - pos + 2)))
    share = (with_pos + with_neg) / n
    worth = np.abs(with_pos - pos * share) / np.sqrt(pos * (n - pos) / n * share * (1 - share) + 1e-9)
    best = np.lexsort((bucket, -worth))[:features]
    lookup = empty
    lookup[bucket[best]] = np.arange(len(best))
    keyed = labelled.select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic")
    data = keyed.mapInPandas(_presence(lookup), "key long, toxic int, features binary").toArrow()  # 2 bytes a feature
    order = np.lexsort((data.column("toxic").to_numpy(), data.column("key").to_numpy()))  # the same whatever the partitions
    rows = [np.frombuffer(data.column("features")[int(i)].as_buffer(), "<u2") for i in order]
    offset = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    weights, intercept = logistic(np.concatenate(rows), offset, data.column("toxic").to_numpy()[order].astype(float), ratio[best])
    return Model(lookup, weights, intercept)


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((model.lookup, model.weights, model.intercept))  # 4 MB and 100 KB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*held.value)
        for b in batches:
            s = np.array([own.score(t) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= cutoff).astype("int32")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs (text, ...) whose score is below the cutoff, and those without text, which say nothing."""
    held = docs.sparkSession.sparkContext.broadcast((model.lookup, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            yield b.filter(pa.array([not t or not t.strip() or own.score(t) < cutoff for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
