"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, its pairs of neighbouring words and its pairs
of words with one word between them, each hashed into 2**bits buckets; a value is
the feature's count. Training is FTRL-proximal with per-coordinate rates on
mini-batches; its L1 term leaves few weights, and only those are broadcast.

Edge cases: a null or empty text has no features and scores the bias; repeated
rows are scored each; an empty table gives no rows; without any labelled row
every score is 0.5. A null doc_id counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, batches, bounded_sample, fold, sampled_labels, sampled_texts, word_hashes

_HALF = np.uint64(32)


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 30.0
    l2: float = 0.1
    epochs: int = 4
    batch: int = 64
    max_rows: int = 24_000  # labelled rows to learn from, at most about
    max_bytes: int = 128 << 20  # of their texts; a word's hash takes 4


@dataclass(frozen=True)
class SparseWeights:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def features(words: np.ndarray, offsets: np.ndarray, bits: int):
    """Buckets of all features of all texts and the text of each. words: the upper 32 bits of word hashes."""
    words = words.astype(np.uint64) << _HALF
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - bits)
    parts, docs = [(words * a) >> shift], [doc]
    for gap in (1, 2):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (words[:-gap] ^ np.uint64(gap)) * b + words[gap:] * a
            parts.append(((pair * a) >> shift)[same])
            docs.append(doc[gap:][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


def train(words: list[np.ndarray], labels: np.ndarray, p: ToxicityParams) -> SparseWeights:
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        w = (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= p.l1, 0.0, w)

    lengths = np.array([len(w) for w in words], np.int64)
    rng = np.random.default_rng(7)
    for _ in range(p.epochs if len(words) else 0):
        order = rng.permutation(len(words))
        for at in range(0, len(order), p.batch):
            rows = order[at : at + p.batch]
            off = np.concatenate(([0], np.cumsum(lengths[rows])))
            flat = np.concatenate([words[r] for r in rows])
            bucket, doc = features(flat, off, p.bits)
            bucket = np.concatenate((bucket, np.full(len(rows), size)))  # the bias
            doc = np.concatenate((doc, np.arange(len(rows))))
            i, inverse = np.unique(bucket, return_inverse=True)
            w = weights(i)
            s = np.bincount(doc, w[inverse], len(rows))
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[rows]
            grad = np.bincount(inverse, g[doc], len(i))
            square = n[i] + grad * grad
            z[i] += grad - (np.sqrt(square) - np.sqrt(n[i])) / p.alpha * w
            n[i] = square
    w = weights(np.arange(size + 1))
    kept = np.flatnonzero(w[:size])
    return SparseWeights(kept.astype(np.int64), w[kept].astype(np.float64), float(w[size]))


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> SparseWeights:
    """Learns from about max_rows labelled documents and max_bytes of text at most, whose fold is not 0. Only their words' hashes reach the driver."""
    sample = bounded_sample(docs, sampled_labels(labels, "toxic", fold("doc_id", 5) != 0, p.max_rows), p.max_bytes)

    def hashed(it):
        for b in batches(it):
            h, off = word_hashes(b.column("text"), ALNUM)
            top = (h >> _HALF).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([top[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary())], ["doc_id", "y", "words"])

    source = sampled_texts(docs, sample, [F.col("text").cast("string").alias("text")])
    rows = source.mapInArrow(hashed, "doc_id long, y int, words binary").toArrow().sort_by("doc_id")
    words = [np.frombuffer(x, np.uint32) for x in rows.column("words").to_pylist()]
    return train(words, np.array(rows.column("y").to_pylist(), np.float64), p)


def score(docs: DataFrame, model: SparseWeights, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(it):
        m = sent.value
        w = np.zeros(1 << p.bits)
        w[m.buckets] = m.weights
        for b in batches(it, 8 << 20):
            words, off = word_hashes(b.column("text"), ALNUM)
            bucket, doc = features((words >> _HALF).astype(np.uint32), off, p.bits)
            s = np.bincount(doc, w[bucket], len(off) - 1) + m.bias
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(docs, fit(docs, labels, p), p)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
