"""Quality by the votes of the nearest labelled documents.

Documents are counts of terms: runs of four character classes (letters, capitals, digits, each
sign of its own), so "word*** w" and "WORD!! W" are different terms, and repeats of the word
before. Term counts are weighted and projected on the leading latent-semantic axes of the
labelled documents. Their vectors, a bounded number, are sent to all tasks; each block of
documents meets all of them in one matrix product of exact cosines, and the nearest ones' labels
are averaged, weighted by similarity.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents kept per label, axes, hashed terms, voters; rows in a block.
EXAMPLES, AXES, TERMS, VOTERS, BLOCK = 2000, 32, 512, 15, 256
_SIGNS = {c: 4 + i for i, c in enumerate(" \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r")}
_CLASS = bytes(1 if c.islower() or ord(c) > 127 else 2 if c.isupper() else 3 if c.isdigit()
               else _SIGNS.get(c, 0) for c in map(chr, range(256)))


class Model(NamedTuple):
    weights: np.ndarray  # of each term
    axes: np.ndarray  # terms x axes
    vectors: np.ndarray  # examples x axes, of length 1
    labels: np.ndarray
    voters: int


def term_shares(text: str) -> np.ndarray:
    """Shares of hashed terms in a text; zeros for a text without words."""
    raw = text.encode()
    classes = np.frombuffer(raw.translate(_CLASS), np.uint8)
    change = np.ones(len(classes), bool)
    change[1:] = classes[1:] != classes[:-1]
    runs = classes[change].astype(np.uint64)
    words = raw.lower().split()
    out = np.zeros(TERMS, np.float32)
    if not words:
        return out
    padded = np.concatenate((np.zeros(3, np.uint64), runs))
    codes = (padded[3:] | padded[2:-1] << np.uint64(6) | padded[1:-2] << np.uint64(12)
             | padded[:-3] << np.uint64(18))
    # Multiplicative hashing: the upper bits of the product are well mixed.
    slots = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    counts = np.bincount((slots % np.uint64(TERMS - 1)).astype(np.int64), minlength=TERMS)
    out[:] = counts / len(runs)
    out[-1] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    return out


def _weighted(shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.log1p(100 * shares) * weights


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(shares: np.ndarray, labels: np.ndarray, axes: int = AXES, voters: int = VOTERS) -> Model:
    """Axes from the examples' second moments; signs and order are fixed, so reruns agree."""
    seen = (shares > 0).sum(axis=0)
    weights = np.log((1 + len(shares)) / (1 + seen)) + 1
    rows = _weighted(shares, weights)
    _, vectors = np.linalg.eigh(rows.T @ rows)
    chosen = vectors[:, ::-1][:, :axes]
    return Model(weights, chosen, _unit(rows @ chosen), labels.astype(np.float64), voters)


def _votes(model: Model, shares: np.ndarray) -> np.ndarray:
    """Mean label of the nearest examples; 0 for texts without words, 0.5 without examples."""
    if not len(model.labels):
        return np.where(shares.any(axis=1), 0.5, 0.0)
    cosines = _unit(_weighted(shares, model.weights) @ model.axes) @ model.vectors.T
    k = min(model.voters, len(model.labels))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    close = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1) + 1e-9
    votes = (close * model.labels[near]).sum(axis=1) / close.sum(axis=1)
    return np.where(shares.any(axis=1), np.clip(votes, 0, 1), 0.0)


def _shares(docs: DataFrame) -> DataFrame:
    """``label, shares`` of rows (label, text)."""
    def of(batches):
        for batch in batches:
            rows = [term_shares(t.as_py() or "").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())],
                                             names=["label", "shares"])

    return docs.select("label", "text").mapInArrow(of, "label int, shares binary")


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, axes: int = AXES,
          voters: int = VOTERS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """From up to ``examples`` documents of each label, the first by hash of their id.

    Labels other than 0 and 1, and ids labelled both ways, teach nothing. Only term counts of
    the examples come to the driver.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
             .where(F.col("label") == F.col("most")))
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(examples) for v in (0, 1)]
    ids = chosen[0].union(chosen[1]).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Ids of at most 2 x examples documents: a bounded side. Repeated ids teach once.
    rows = (_shares(texts.join(F.broadcast(ids), "doc_id")).distinct()
            .orderBy("label", "shares").limit(4 * examples).collect())
    shares = np.array([np.frombuffer(r.shares, np.float32) for r in rows]).reshape(-1, TERMS)
    return fit(shares, np.array([r.label for r in rows]), axes, voters)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row of ``docs``: 0 to 1, higher where label 1 is likelier.

    Null texts, and texts without words, score 0. Without examples all others score 0.5. Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                shares = np.array([term_shares(t.as_py() or "") for t in part.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_votes(shared.value, shares), pa.float64())],
                    names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        of, "doc_id long, score double")
