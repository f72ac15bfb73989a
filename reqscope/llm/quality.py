"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-Proximal) updates, scored as sparse dot
products.

Features are hashed token unigrams and bigrams; a token is a run of letters and
digits (any non-ASCII byte counts as a letter) or a run of one punctuation
mark. A document's vector holds ``count / sqrt(number of features)``, so its
score is one gather of weights and one sum per document.

Training rounds run as grouped Spark jobs: each shard of the training sample
walks its own documents from the common state, and a grouped mean over the
shards that touched a coordinate gives the next state. The sample is bounded
(``max_train`` documents, the smallest id hashes), the state has ``dims``
coordinates; everything else, scoring included, covers every row.

Defined results: a null or empty text has no feature and gets the score of the
intercept alone; without any training row every score is 0.5; with one class
only, the intercept moves towards that class. Label rows with a null id or a
label other than 0 and 1 are ignored; a document labelled twice trains twice.
Repeated documents are scored each. Columns other than those named are kept
out of the way and returned untouched only by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import materialize


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 17  #: log2 of the number of hashed coordinates
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 1e-4
    rounds: int = 4
    shards: int = 6
    max_train: int = 12_000  #: bound of the training sample, in documents

    @property
    def dims(self) -> int:
        return (1 << self.bits) + 1  # the last coordinate is the intercept


#: Token class of each byte: 0 space, 1 letter or digit, else the mark itself.
_CLASS = np.arange(256, dtype=np.int16)
_CLASS[B.SPACE] = 0
_CLASS[128:] = 1
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _CLASS[_lo:_hi] = 1


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of every token and token pair, by document (offsets)."""
    n_docs = len(offsets) - 1
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    cls = _CLASS[buf]
    new = np.empty(len(buf), bool)
    new[0] = True
    new[1:] = cls[1:] != cls[:-1]
    new[offsets[offsets < len(buf)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(buf))
    keep = cls[starts] != 0
    starts, ends = starts[keep], ends[keep]
    kind = cls[starts].astype(np.uint64)
    h = np.where(kind == 1, B.span_hash(B.prefix_hash(buf), starts, ends), B.mix(kind + np.uint64(7)))
    first = np.searchsorted(starts, offsets)
    pair = B.mix(h[:-1] * np.uint64(3) + h[1:])
    pair[h[:-1] == h[1:]] = B.BASES[1]  # "the same token again" is one feature, whichever token it is
    joined = np.ones(len(h), bool)
    inner = first[1:-1]
    joined[inner[inner > 0] - 1] = False  # no pair across documents
    joined[-1:] = False
    order = np.concatenate([np.arange(len(h)), np.flatnonzero(joined)])
    idx = (np.concatenate([h, pair[joined[:-1]]]) >> np.uint64(64 - bits)).astype(np.int64)
    doc = np.searchsorted(first, order, side="right") - 1
    by_doc = np.argsort(doc, kind="stable")
    counts = np.bincount(doc, minlength=n_docs)
    return idx[by_doc], np.concatenate([[0], np.cumsum(counts)])


def _scores(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty(len(column))
    for row, last, buf, offsets in B.blocks(column):
        idx, first = features(buf, offsets, bits)
        total = B.segment_sum(weights[idx], first)
        size = np.maximum(first[1:] - first[:-1], 1)
        out[row:last] = total / np.sqrt(size) + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def _vectors(docs: DataFrame, bits: int, text: str) -> DataFrame:
    """One row per training document: its distinct coordinates and their values, as packed arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed_idx, packed_val = [], []
            for _, _, buf, offsets in B.blocks(batch.column("text")):
                idx, first = features(buf, offsets, bits)
                for k in range(len(offsets) - 1):
                    own, count = np.unique(idx[first[k]: first[k + 1]], return_counts=True)
                    packed_idx.append(own.astype(np.int32).tobytes())
                    packed_val.append((count / np.sqrt(max(count.sum(), 1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("place"), batch.column("y"),
                 pa.array(packed_idx, pa.binary()), pa.array(packed_val, pa.binary())],
                names=["shard", "place", "y", "idx", "val"])

    rows = docs.select("shard", "place", "y", F.col(text).alias("text"))
    return rows.mapInArrow(run, "shard int, place long, y double, idx binary, val binary")


def _walk(pdf: pd.DataFrame, z: np.ndarray, n: np.ndarray, p: FtrlParams) -> pd.DataFrame:
    """One FTRL pass over a shard; returns the coordinates it touched."""
    z, n, touched = z.copy(), n.copy(), np.zeros(p.dims, bool)
    pdf = pdf.sort_values(["place", "y"], kind="stable")
    for y, raw_idx, raw_val in zip(pdf["y"], pdf["idx"], pdf["val"]):
        i = np.append(np.frombuffer(raw_idx, np.int32), p.dims - 1)
        x = np.append(np.frombuffer(raw_val, np.float32).astype(float), 1.0)
        zi, ni = z[i], n[i]
        w = _weights(zi, ni, p)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        root = np.sqrt(ni + g * g)
        z[i] = zi + g - (root - np.sqrt(ni)) / p.alpha * w
        n[i] = ni + g * g
        touched[i] = True
    at = np.flatnonzero(touched)
    return pd.DataFrame({"i": at, "z": z[at], "n": n[at]})


def _walker(state, params: FtrlParams):
    return lambda pdf: _walk(pdf, *state.value, params)


def _weights(z: np.ndarray, n: np.ndarray, p: FtrlParams) -> np.ndarray:
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) > p.l1, w, 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str, params: FtrlParams = FtrlParams(),
          doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id") -> np.ndarray:
    """Fit weights (``params.dims`` numbers) on the labelled documents of ``docs``."""
    key = F.xxhash64(F.col(label_id))
    chosen = (
        labels.where(F.col(label_id).isNotNull() & F.col(label).isin(0, 1))
        .select(F.col(label_id).alias("train_id"), F.col(label).cast("double").alias("y"), key.alias("place"))
        .orderBy("place", "train_id", "y").limit(params.max_train)
    )
    sample = docs.select(F.col(doc_id).alias("train_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "train_id")  # at most max_train rows of three numbers
    sample = sample.withColumn("shard", F.pmod("place", F.lit(params.shards)).cast("int"))
    vectors = materialize(_vectors(sample, params.bits, "text"), "ftrl")
    z, n = np.zeros(params.dims), np.zeros(params.dims)
    sc = vectors.sparkSession.sparkContext
    for _ in range(params.rounds):
        state = sc.broadcast((z, n))
        steps = vectors.groupBy("shard").applyInPandas(_walker(state, params), "i int, z double, n double")
        mean = steps.groupBy("i").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()  # <= dims rows
        at = mean["i"].to_numpy()
        z, n = z.copy(), n.copy()
        z[at], n[at] = mean["z"].to_numpy(), mean["n"].to_numpy()
        state.unpersist()
    return _weights(z, n, params)


def score(docs: DataFrame, weights: np.ndarray, params: FtrlParams = FtrlParams(),
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row: the probability of label 1."""
    weights = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).astype(float))
    bits = params.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_scores(batch.column(1), weights.value, bits))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float, params: FtrlParams = FtrlParams(),
              text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are (no shuffle)."""
    weights = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).astype(float))
    bits, at = params.bits, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), weights.value, bits) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's text leaves ``fold`` modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def quality_scores(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), label: str = "quality",
                   folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """Train on the labels outside the held-out fold and score every document."""
    weights = train(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)), label, params)
    out = score(docs, weights, params)
    return out.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
