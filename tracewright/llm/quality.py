"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A whole text becomes counts of its terms (hashed byte trigrams, and how often words recur), log-scaled and weighted by inverse document frequency, then a vector of
the leading singular directions of the labelled sample. The labelled vectors are broadcast (their number is a parameter); every document is
compared with all of them in blocks, and its nearest neighbours vote with their cosines as weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_ids, with_columns

#: Hash buckets for trigrams, further terms for the recurrence of words (two scales of 20 steps), latent dimensions, neighbours that vote, power of a cosine as weight, documents compared at once.
TRIGRAMS, RECUR, DIMS, NEIGHBOURS, SHARPNESS, ROWS = 2048, 20, 64, 15, 4, 256
FEATURES = TRIGRAMS + 2 * RECUR


def term_counts(text: bytes | None) -> np.ndarray:
    """log(1 + count) of each hashed byte trigram of the whole text; white space counts as one blank, digits as one digit. Then one of RECUR terms for
    the share of words that repeat the one before, and one for the share of words seen before, each as heavy as a word in every place."""
    words = (text or b"").split()
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    x = np.where((x >= 48) & (x <= 57), np.uint8(48), x).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(FEATURES, np.float32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    out = np.zeros(FEATURES, np.float32)
    out[:TRIGRAMS] = np.log1p(np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=TRIGRAMS))
    if len(words) > 3:
        again, before = sum(map(eq, words, words[1:])) / len(words), 1 - len(set(words)) / len(words)
        out[TRIGRAMS + int((RECUR - 1) * again)] = out[TRIGRAMS + RECUR + int((RECUR - 1) * before)] = 2 * np.sqrt(len(words))
    return out


@dataclass
class VoteModel:
    """Bounded by FEATURES, DIMS and the number of labelled documents: safe to broadcast."""

    project: np.ndarray  # FEATURES x DIMS, idf included
    vectors: np.ndarray  # labelled unit vectors
    y: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = counts @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.y):
            return out
        k = min(NEIGHBOURS, len(self.y))
        for at in range(0, len(texts), ROWS):
            v = self.embed(np.stack([term_counts(t) for t in texts[at : at + ROWS]]))
            cos = v @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** SHARPNESS
            total = w.sum(axis=1)
            vote = (w * self.y[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + len(v)] = np.where(total > 1e-9, vote, self.prior)
        return out.clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", per_class: int = 1500) -> VoteModel:
    """Fit on at most ``per_class`` labelled documents of each class, the least text of each id (3,000 rows of 2,088 numbers reach the driver, at any size)."""

    def run(batches):
        for b in batches:
            rows = [term_counts(t).astype(np.float16).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["y", "x"])

    ids = labelled_ids(labels, label, keep, per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # one row for each id
    rows = rows.select("y", "text").mapInArrow(run, "y int, x binary").collect()
    if not rows:
        return VoteModel(np.zeros((FEATURES, DIMS), np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0), 0.5)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["y"], bytes(rows[i]["x"])))  # the same model whatever order rows come in
    x = np.stack([np.frombuffer(bytes(rows[i]["x"]), np.float16) for i in order]).astype(np.float32)
    y = np.array([rows[i]["y"] for i in order], float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    weighed = x * idf
    weighed /= np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)
    _, v = np.linalg.eigh((weighed.T @ weighed).astype(np.float64))
    model = VoteModel(np.ascontiguousarray(idf[:, None] * v[:, ::-1][:, :DIMS]).astype(np.float32), np.empty(0), y, float(y.mean()))
    model.vectors = model.embed(x)
    return model


def score(docs: DataFrame, model: VoteModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier), columns of these names replaced. Null, empty and blank texts get the share of
    label 1 in the sample; equal texts get equal scores. Without any labelled row every score is 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield with_columns(b, {"score": pa.array(held.value.score(texts), pa.float64())})

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != "score"] + ["score double"])
    return docs.select([c for c in docs.columns if c != "score"]).mapInArrow(run, schema)
