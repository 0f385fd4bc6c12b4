"""Toxicity severity by cumulative-link (proportional odds) ordinal regression.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector is shared by ordered
thresholds theta_1 < theta_2 < ...; the expected severity is the sum of the
exceedance probabilities.  Features are sparse: whole words and five-byte
pieces of words, log-damped by their count in the text.

``labels`` say only whether a document is toxic.  Grades are derived from it:
0 for clean documents, and 1 to 3 for toxic ones by tertiles of how often the
terms that set toxic documents apart occur in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory, _sample, _text

#: Labelled documents used for fitting, at most (about): the model has few parameters and doesn't gain from more.
MAX_LABELLED = 10_000
GRADES = 4
#: A document is toxic if P(grade > 0) is at least this.
CUT = 0.3
PIECE = 5
#: A term is kept if the log-likelihood ratio of its association with toxic documents is at least this (about 1e-9 by
#: chance), or at least this share of what a term in all toxic and no clean documents would have. The share doesn't
#: depend on the number of labelled documents: terms that mark many toxic documents are kept at every size.
LEAST_G2, LEAST_SHARE = 38.0, 0.2
_WORD_SALT = np.uint64(0xA5A5F00D12345678)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece hashes with their byte positions, word hashes with theirs) as one (hash, position) list, and text bounds."""
    data, bounds = _text.spaced(_text.normalise(texts))
    starts, ends, _ = _text.words(data, bounds)
    c = _text.prefix_hash(data)
    word = _text.span_hash(c, starts, ends) ^ _WORD_SALT
    m = len(data) - PIECE + 1
    if m <= 0:
        return word, starts, bounds
    space = data == 32
    at = np.flatnonzero(~(space[1 : m + 1] | space[2 : m + 2] | space[3 : m + 3]))
    return np.concatenate([word, _text.span_hash(c, at, at + PIECE)]), np.concatenate([starts, at]), bounds


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def __post_init__(self):
        self.door = np.zeros(1 << 20, bool)
        self.door[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term index, count) of the model's terms in the texts."""
        hashes, at, bounds = _terms(texts)
        maybe = np.flatnonzero(self.door[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.terms) or not len(maybe):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        hit = self.terms[k] == hashes[maybe]
        row = np.searchsorted(bounds - 1, at[maybe[hit]], "right") - 1  # a piece may begin at the space before its text
        pair, n = np.unique(row * len(self.terms) + k[hit], return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), n

    def exceed(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES-2, a row per text."""
        row, term, n = self.counts(texts)
        score = np.bincount(row, self.weights[term] * np.log1p(n), minlength=len(texts))[: len(texts)] if len(row) else np.zeros(len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def _chunks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return _text.slices(table.to_batches(), "text")


def _select(toxic: pa.Table, clean: pa.Table) -> np.ndarray:
    """Hashes of the terms whose document frequency sets toxic documents apart (log-likelihood ratio)."""

    def unique(batch: pa.RecordBatch) -> np.ndarray:
        hashes, at, bounds = _terms(batch.column("text"))
        row = np.searchsorted(bounds - 1, at, "right")
        if not len(hashes):
            return hashes
        order = np.lexsort((hashes, row))
        r, h = row[order], hashes[order]
        return h[np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])]

    found = [unique(b) for b in _chunks(toxic)]
    if not found:
        return np.zeros(0, np.uint64)
    terms, k1 = np.unique(np.concatenate(found), return_counts=True)
    often = k1 >= 3
    terms, k1 = terms[often], k1[often].astype(float)
    k0 = np.zeros(len(terms))
    for b in _chunks(clean):
        if len(terms):
            h = unique(b)
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            k0 += np.bincount(at[terms[at] == h], minlength=len(terms))
    n1, n0 = float(toxic.num_rows), float(max(1, clean.num_rows))

    def part(k, n, k_all, n_all):
        with np.errstate(divide="ignore", invalid="ignore"):
            yes = np.where(k > 0, k * np.log(k * n_all / (n * k_all)), 0)
            rest, rest_all = n - k, n_all - k_all
            return yes + np.where(rest > 0, rest * np.log(rest * n_all / (n * np.maximum(rest_all, 1e-9))), 0)

    g2 = 2 * (part(k1, n1, k1 + k0, n1 + n0) + part(k0, n0, k1 + k0, n1 + n0))
    most = 2 * (n1 * np.log((n1 + n0) / n1) + n0 * np.log((n1 + n0) / n0))
    return terms[(g2 >= min(LEAST_G2, LEAST_SHARE * most)) & (k1 / n1 > 10 * k0 / n0)]


def _fit(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, n_terms: int, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam over (w, theta_1, log gaps of theta)."""
    row, term, value = x
    n, levels = len(y), GRADES - 1
    p = np.zeros(n_terms + levels)
    p[:n_terms] = 0.5
    p[n_terms] = 2.0
    mean, var = np.zeros_like(p), np.zeros_like(p)
    above = (y[:, None] > np.arange(levels)[None, :]).astype(float)
    for t in range(1, steps + 1):
        w, gaps = p[:n_terms], np.exp(p[n_terms + 1 :])
        theta = p[n_terms] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[term] * value, minlength=n)
        q = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -30, 30)))  # P(y > k)
        full = np.concatenate([np.ones((n, 1)), q, np.zeros((n, 1))], 1)
        slope = np.concatenate([np.zeros((n, 1)), q * (1 - q), np.zeros((n, 1))], 1)
        at = np.arange(n)
        mass = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        # d log mass / d score and / d theta_k
        d_low, d_high = slope[at, y] / mass, slope[at, y + 1] / mass
        g_score = -(d_low - d_high)
        g_theta = np.zeros(levels + 2)
        np.add.at(g_theta, y, d_low)
        np.add.at(g_theta, y + 1, -d_high)
        g_theta = g_theta[1 : levels + 1]
        g = np.concatenate([np.bincount(term, g_score[row] * value, minlength=n_terms) / n + l2 * w, [g_theta.sum() / n], np.cumsum(g_theta[::-1])[::-1][1:] / n * gaps])
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        p -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    return p[:n_terms], p[n_terms] + np.concatenate([[0], np.cumsum(np.exp(p[n_terms + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on about ``max_labelled`` labelled documents at most.

    Null labels, ids and texts are left out; a document labelled twice counts
    as toxic if any label says so; a repeated text counts once.  Without clean
    examples, and without terms that at least three toxic ones share, the
    model finds nothing toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n = known.count()
    if n > max_labelled:  # thin the labels before the join: what is broadcast is bounded by max_labelled
        known = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    rows = _sample.bounded(texts.join(F.broadcast(known), "doc_id").select("text", "toxic").dropDuplicates(["text"]), "text", max_labelled, "texts")
    label = rows.column("toxic").to_numpy()
    return _model(rows.filter(pa.array(label > 0)), rows.filter(pa.array(label == 0)))


def _model(toxic: pa.Table, clean: pa.Table) -> Model:
    """The model of these texts."""
    terms = _select(toxic, clean)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 30.0), 0.5)
    if not len(terms) or not clean.num_rows:
        return none
    probe = Model(terms, np.ones(len(terms)), np.zeros(GRADES - 1), 0.5)
    parts, base, y = [], 0, []
    for table, bad in ((clean, 0), (toxic, 1)):
        for b in _chunks(table):
            row, term, count = probe.counts(b.column("text"))
            parts.append((row + base, term, count))
            y.append(np.full(b.num_rows, bad))
            base += b.num_rows
    row, term, count = (np.concatenate(p) for p in zip(*parts))
    grade = np.concatenate(y)
    hits = np.bincount(row, count, minlength=base)
    third, two = np.quantile(hits[(grade > 0) & (hits > 0)], [1 / 3, 2 / 3])
    grade = np.where(grade > 0, 1 + (hits > third) + (hits > two), 0).astype(np.int64)
    weights, thresholds = _fit((row, term, np.log1p(count)), grade, len(terms))
    return Model(terms, weights, thresholds, CUT)


def _scored(docs: DataFrame, model: Model, schema: str, emit) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            yield emit(b, shared.value.exceed(b.column("text").cast(pa.string())), shared.value)

    return docs.mapInArrow(_memory.lean(run), schema)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, grade, toxic`` for every row: expected severity (0 to 3), most probable grade, decision.

    A null or empty text has no feature and is judged by the thresholds alone
    (clean).  Rows are judged one by one on their whole text; repeated rows
    repeat; a null doc_id stays null; other columns are not read.
    """

    def emit(b, q, m):
        mass = -np.diff(np.concatenate([np.ones((len(q), 1)), q, np.zeros((len(q), 1))], 1), axis=1)
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(q.sum(1)), pa.array(mass.argmax(1).astype(np.int32)), pa.array(q[:, 0] >= m.cut)], ["doc_id", "severity", "grade", "toxic"])

    return _scored(docs.select("doc_id", "text"), model, "doc_id bigint, severity double, grade int, toxic boolean", emit)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns kept; cases as in ``score_toxicity``."""
    return _scored(docs, model, docs.schema, lambda b, q, m: b.filter(pa.array(q[:, 0] < m.cut)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
