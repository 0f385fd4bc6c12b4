"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its hashed subwords (byte n-grams
inside words, with word boundaries); a linear layer and softmax give the
language.  Trained by stochastic gradient descent in numpy.  For scoring the
linear layer is folded into the embedding table, so a text costs one gather
of as many numbers as there are languages per subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory, _sample, _text

#: Labelled documents used for fitting and calibration, at most (about).
MAX_LABELLED = 4_000
BUCKET_BITS = 18
DIM = 16
ORDERS = (3, 4)
EPOCHS = 4
#: Share of correctly labelled held-out texts that the rejection threshold keeps, at least.
KEEP = 0.999
#: Share of texts in no language that it should reject, where that leaves KEEP.
REJECT = 0.95


def _subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword, grouped by text, and the n+1 offsets of the texts."""
    data, bounds = _text.spaced(_text.normalise(texts))
    space = data == 32
    c = _text.prefix_hash(data)
    found, owner = [], []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        bad = np.zeros(m, bool)
        for k in range(1, n - 1):
            bad |= space[k : m + k]
        at = np.flatnonzero(~bad)
        found.append((_text.span_hash(c, at, at + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owner.append(np.searchsorted(at, bounds - 1))  # a text's pieces may begin at the space before it
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    sizes = sum(np.diff(o) for o in owner)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out, fill = np.empty(offsets[-1], np.int32), offsets[:-1].copy()
    for f, o in zip(found, owner):
        size = np.diff(o)
        out[np.arange(o[0], o[-1]) - np.repeat(o[:-1], size) + np.repeat(fill, size)] = f[o[0] : o[-1]]
        fill += size
    return out, offsets


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits and number of subwords of each text."""
        bucket, at = _subwords(texts)
        count = np.diff(at)
        total = np.zeros((len(count), len(self.languages)))
        some = np.flatnonzero(count)
        if len(some):
            for k in range(len(self.languages)):  # a column at a time keeps the scratch space small
                total[some, k] = np.add.reduceat(self.table[bucket, k].astype(np.float64), at[some])
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, calibrated confidence, and whether the text is rejected."""
        z, count = self.logits(texts)
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        sure = np.where(count > 0, p[np.arange(len(p)), best], 0.0)
        return best, sure, (sure < self.threshold) | (count == 0)


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on about ``max_labelled`` labelled rows at most; a fifth of them is held out to calibrate.

    Rows with a null text or language are left out.  With no labelled row the
    model knows one language, ``und``, and rejects everything.
    """
    rows = _sample.bounded(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL"), "text", max_labelled, "language")
    rows = rows.take(np.argsort([hash_of(t) for t in rows.column("text").to_pylist()], kind="stable")) if rows.num_rows else rows
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Model(["und"], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), 1.0, 2.0)
    y = np.array([languages.index(x) for x in names])
    bags = []
    for b in _text.slices(rows.to_batches(), "text"):
        bucket, at = _subwords(b.column("text").cast(pa.string()))
        bags += [np.unique(bucket[at[i] : at[i + 1]], return_counts=True) for i in range(len(at) - 1)]
    rng = np.random.default_rng(7)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    seen = np.zeros(1 << BUCKET_BITS, bool)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    for i in train:
        seen[bags[i][0]] = True
    steps, t = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            bucket, n = bags[i]
            rate, t = 0.25 * (1 - t / steps), t + 1
            if not len(bucket):
                continue
            share = (n / n.sum()).astype(np.float32)
            h = share @ emb[bucket]
            z = h @ w + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            emb[bucket] -= rate * back  # as much for each subword, so that rare ones learn too
    emb[~seen] = 0
    model = Model(languages, (emb @ w).astype(np.float32), bias.astype(np.float64))
    return _calibrate(model, rows.filter(pa.array(held)) if held.any() else rows, y[held] if held.any() else y)


def _calibrate(model: Model, rows: pa.Table, y: np.ndarray) -> Model:
    """Temperature by likelihood on held-out rows, threshold between them and texts in no language.

    The latter are the held-out texts with every letter replaced by a random
    one.  The threshold lies half way (in log odds) between the confidence
    that REJECT of them don't reach and the one that KEEP of the correctly
    labelled texts reach; if the two overlap, at the latter.
    """
    parts = [model.logits(b.column("text").cast(pa.string())) for b in _text.slices(rows.to_batches(), "text")]
    z, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def chance(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(chance(t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss))
    p = chance(model.temperature)
    right = (p.argmax(1) == y) & (count > 0)
    low = np.quantile(p[right].max(1), 1 - KEEP, method="lower") if right.any() else 0.0
    low = min(max(low, 1 / p.shape[1]), 1 - 1e-6)
    sure = np.concatenate([model.predict(b)[1] for b in _nonsense(rows)] or [np.zeros(0)])
    high = min(max(np.quantile(sure, REJECT) if len(sure) else 0.0, 1e-6), 1 - 1e-6)
    odds = lambda x: np.log(x / (1 - x))
    model.threshold = float(1 / (1 + np.exp(-(odds(low) + odds(high)) / 2)) if high < low else low * 0.98)
    return model


def _nonsense(rows: pa.Table) -> Iterator[pa.Array]:
    """The texts with every word letter replaced by a random one of the letters that occur, as likely as another."""
    rng = np.random.default_rng(11)
    for b in _text.slices(rows.to_batches(), "text"):
        normal = _text.normalise(b.column("text")).to_pylist()
        letters = np.array(sorted(set("".join(normal)) - {" "}))
        if not len(letters):
            continue
        made = []
        for t in normal:
            points = np.array(list(t)) if t else np.zeros(0, "<U1")
            word = points != " "
            points[word] = letters[rng.integers(len(letters), size=int(word.sum()))]
            made.append("".join(points.tolist()))
        yield pa.array([t for t in made if t], pa.string())


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _apply(docs: DataFrame, model: Model, schema, emit) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            yield emit(b, *shared.value.predict(b.column("text").cast(pa.string())), shared.value.languages)

    return docs.mapInArrow(_memory.lean(run), schema)


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, predicted, confidence, rejected`` for every row, from its whole text.

    ``rejected`` where the calibrated confidence is under the threshold; a
    null text, or one without letters or digits, has confidence 0 and is
    rejected.  Ties go to the language first in the alphabet.  Repeated rows
    repeat; a null doc_id stays null; other columns are not read.
    """

    def emit(b, best, sure, out, languages):
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([languages[k] for k in best], pa.string()), pa.array(sure), pa.array(out)], ["doc_id", "predicted", "confidence", "rejected"])

    return _apply(docs.select("doc_id", "text"), model, "doc_id bigint, predicted string, confidence double, rejected boolean", emit)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept; cases as in ``identify_language``."""
    return _apply(docs, model, docs.schema, lambda b, best, sure, out, languages: b.filter(pa.array(~out)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_language(docs, fit(docs))
