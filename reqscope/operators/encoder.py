"""A small text encoder for batch scoring (I13, L3): weights from a written table, whole texts, micro-batches.

The model: word vectors plus positions, one self-attention layer with a residual, the
mean over a window's words, the mean of a text's windows weighted by their words, and
a linear head. Texts are cut into windows of ``window`` words, so every word counts
however long the text; an unknown word has the zero vector, a text without words the
zero mean.

Weights are a small Parquet table (one row an array), read once by the driver, checked
against ``MAX_BYTES`` and broadcast once per executor; a Python worker unpacks them
once. In a task the windows of an Arrow batch are sorted by length and cut into
micro-batches by the bytes of their padded attention table, so one long text does not
pad many short ones and no batch outgrows its memory.

``train`` fits the word vectors (MLlib's Word2Vec) and the head (MLlib's logistic
regression on the encoded texts). The attention weights are not trained: queries, keys
and values are the vectors themselves.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

MAX_BYTES = 256 << 20  # of all arrays together
TASK_WORDS = 4_000_000  # that one task fits word vectors on, about
_worker: dict = {}  # the model this Python worker has unpacked, by the call that shipped it


class Encoder:
    """The forward pass on numpy arrays ``vectors (words + 1, d)``, ``pos (window, d)``, ``wq, wk, wv (d, d)``, ``head (d, k)``, ``bias (k)``."""

    def __init__(self, words: list[str], arrays: dict[str, np.ndarray], batch_bytes: int = 8 << 20):
        self.index = {w: i for i, w in enumerate(words)}
        self.a, self.batch_bytes = arrays, batch_bytes
        self.window, self.d = arrays["pos"].shape

    def _windows(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Mean vectors of padded windows."""
        a = self.a
        x = (a["vectors"][ids] + a["pos"][: ids.shape[1]]) * mask[:, :, None]
        s = (x @ a["wq"]) @ (x @ a["wk"]).transpose(0, 2, 1) / math.sqrt(self.d)
        s = np.where(mask[:, None, :], s, -np.inf)
        s = np.exp(s - s.max(axis=2, keepdims=True))
        h = x + (s / s.sum(axis=2, keepdims=True)) @ (x @ a["wv"])
        return (h * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)

    def batches(self, lengths: np.ndarray):
        """Windows in order of length, cut where the padded tables would exceed ``batch_bytes``."""
        order = np.argsort(lengths, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order):
                n = int(lengths[order[hi]])
                if (hi + 1 - lo) * n * (n + 4 * self.d) * 8 > self.batch_bytes:
                    break
                hi += 1
            yield order[lo:hi]
            lo = hi

    def encode(self, texts: list[str]) -> np.ndarray:
        """One mean vector a text."""
        unknown = len(self.index)
        windows, owner = [], []
        for t, text in enumerate(texts):
            ids = [self.index.get(w, unknown) for w in text.lower().split()]
            for at in range(0, len(ids), self.window):
                windows.append(np.array(ids[at:at + self.window]))
                owner.append(t)
        out, total = np.zeros((len(texts), self.d)), np.zeros(len(texts))
        lengths = np.array([len(w) for w in windows], np.int64)
        owner = np.array(owner, np.int64)
        for rows in self.batches(lengths):
            size = lengths[rows]
            ids = np.full((len(rows), int(size.max())), unknown)
            for i, r in enumerate(rows):
                ids[i, : size[i]] = windows[r]
            mask = np.arange(ids.shape[1]) < size[:, None]
            np.add.at(out, owner[rows], self._windows(ids, mask) * size[:, None])
            np.add.at(total, owner[rows], size)
        return out / np.maximum(total, 1)[:, None]

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts) @ self.a["head"] + self.a["bias"]


def save_weights(spark: SparkSession, path: str, words: list[str], arrays: dict[str, np.ndarray]) -> None:
    """Write a model: its words in order (joined by line ends) and its arrays as doubles."""
    rows = [("words", [len(words)], "\n".join(words).encode())]
    rows += [(k, list(v.shape), np.ascontiguousarray(v, "<f8").tobytes()) for k, v in sorted(arrays.items())]
    spark.createDataFrame([(n, s, bytearray(b)) for n, s, b in rows], "name string, shape array<bigint>, data binary").coalesce(1).write.parquet(path)


def _shipped(spark: SparkSession, path: str):
    """The weights as a broadcast; a model beyond ``MAX_BYTES`` is an error."""
    table = spark.read.parquet(path)
    size = table.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if not 0 < size <= MAX_BYTES:
        raise ValueError(f"the model at {path} has {size} bytes; at most {MAX_BYTES} are shipped to executors")
    return spark.sparkContext.broadcast([(r["name"], list(r["shape"]), bytes(r["data"])) for r in table.collect()])


def _model(call: str, shipped, batch_bytes: int) -> Encoder:
    """The worker's model: unpacked by the first task of a call, held for the tasks after it."""
    if call not in _worker:
        _worker.clear()
        _worker[call] = _unpacked(shipped, batch_bytes)
    return _worker[call]


def _unpacked(shipped, batch_bytes: int) -> Encoder:
    parts = {n: (s, b) for n, s, b in shipped.value}
    n_words, text = parts.pop("words")
    words = text.decode().split("\n") if n_words[0] else []
    return Encoder(words, {n: np.frombuffer(b, "<f8").reshape(s) for n, (s, b) in parts.items()}, batch_bytes)


def _mapped(df: DataFrame, keys, text: str, path: str, column: str, method: str, batch_bytes: int, profile) -> DataFrame:
    keys = list(keys)
    src = df.select(*keys, F.col(text).alias("_in"))
    shipped, call = _shipped(df.sparkSession, path), uuid.uuid4().hex
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + f", {column} array<double>"

    def run(batches):
        model = _model(call, shipped, batch_bytes)
        for pdf in batches:
            out = pdf[keys].copy()
            out[column] = pd.Series(list(getattr(model, method)(pdf["_in"].fillna("").tolist())), index=pdf.index, dtype="object")
            yield out

    return src.mapInPandas(run, schema, profile=profile)


def encode_texts(df: DataFrame, keys, text: str, path: str, batch_bytes: int = 8 << 20, profile=None) -> DataFrame:
    """(keys..., encoded array<double>) for every row; ``profile`` is a Spark resource profile for this stage."""
    return _mapped(df, keys, text, path, "encoded", "encode", batch_bytes, profile)


def score_encoded(df: DataFrame, keys, text: str, path: str, batch_bytes: int = 8 << 20, profile=None) -> DataFrame:
    """(keys..., logits array<double>) for every row; null texts are empty."""
    return _mapped(df, keys, text, path, "logits", "logits", batch_bytes, profile)


def positions(window: int, d: int, scale: float = 0.02) -> np.ndarray:
    """Sine and cosine positions, small beside the word vectors."""
    angle = np.arange(window)[:, None] / 10000 ** (2 * (np.arange(d) // 2) / d)
    return scale * np.where(np.arange(d) % 2 == 0, np.sin(angle), np.cos(angle))


def tasks(n_words: int | None) -> int:
    """Tasks that fit the word vectors: none has more words the more there are."""
    return max(1, -(-(n_words or 0) // TASK_WORDS))


def train(df: DataFrame, text: str, label: str, path: str, d: int = 32, window: int = 256, max_words: int = 20_000,
          epochs: int = 1, partitions: int | None = None, seed: int = 42) -> None:
    """Fit word vectors and head on the rows of ``df`` (labels 0 and 1) and write the model to ``path``.

    Word vectors are fitted in ``partitions`` tasks, one for every ``TASK_WORDS`` words of the texts if not given.
    Of the vocabulary at most ``max_words`` words, by count, get a vector; words tied with the first word beyond stay out.
    """
    spark = df.sparkSession
    rows = materialize(df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label")), "encoder")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    counts = rows.select(F.explode(words).alias("w")).groupBy("w").count()
    counts = materialize(counts, "encoder_words")
    partitions = partitions or tasks(counts.agg(F.sum("count")).first()[0])
    top = [r["count"] for r in counts.orderBy(F.desc("count")).limit(max_words + 1).select("count").collect()]
    least = top[-1] + 1 if len(top) > max_words else 1
    listed, vectors = [], np.zeros((1, d))
    if top and top[0] >= least:
        fitted = Word2Vec(vectorSize=d, minCount=least, maxIter=epochs, numPartitions=partitions, seed=seed, inputCol="words",
                          outputCol="v").fit(rows.select(words.alias("words")))
        found = sorted((r["word"], r["vector"].toArray()) for r in fitted.getVectors().collect())
        listed = [w for w, _ in found]
        matrix = np.array([v for _, v in found])
        vectors = np.vstack([matrix / max(float(np.sqrt((matrix**2).sum(axis=1).mean())), 1e-12), np.zeros((1, d))])
    one = np.eye(d)
    arrays = {"vectors": vectors, "pos": positions(window, d), "wq": one, "wk": one, "wv": one, "head": np.zeros((d, 2)), "bias": np.zeros(2)}
    save_weights(spark, f"{path}-body", listed, arrays)
    encoded = encode_texts(rows, ["label"], "text", f"{path}-body").select("label", array_to_vector("encoded").alias("features"))
    head = LogisticRegression(regParam=1e-4, maxIter=100).fit(materialize(encoded, "encoded"))
    if head.numClasses == 2:  # one class only: its logit wins everywhere, from the intercept
        arrays["head"][:, 1] = head.coefficients.toArray()
    arrays["bias"][1] = min(max(head.intercept, -1e6), 1e6)
    save_weights(spark, path, listed, arrays)
