"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (hashed, each occurrence of value 1/n), and one
feature for the bin of each structure statistic (shares of upper case, digits,
signs, repeated words, ...) and of the length. The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]),

so pairwise interactions cost time linear in the number of features.

Edge cases: a null or empty text has no words and the bins of zeros; a null doc_id
counts as held out; without any labelled row every score is 0.5; repeated rows are
scored each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, batches, bounded_sample, fold, sampled_labels, sampled_texts, segment_sum, utf8, word_hashes

STATS = ("upper", "digit", "sign", "space", "newline", "word_length", "repeat1", "repeat2", "log_words", "log_bytes", "log_chars")


@dataclass(frozen=True)
class QualityParams:
    bits: int = 14
    bins: int = 12
    rank: int = 4
    rate: float = 0.1
    l2: float = 1e-4
    epochs: int = 6
    batch: int = 64
    max_rows: int = 8_000  # labelled rows to learn from, at most about
    max_bytes: int = 128 << 20  # of their texts; a word's hash takes 4
    threshold: float = 0.7


@dataclass(frozen=True)
class FactorModel:
    edges: np.ndarray  # of the bins of each statistic
    bias: float
    w: np.ndarray
    v: np.ndarray


def _classes() -> np.ndarray:
    """Of each byte: 0 other, 1 upper case, 2 digit, 3 sign, 4 blank, 5 newline."""
    out = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.isupper() else 2 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 3 if 32 < b < 127 and not c.isalnum() else 0
    return out


_CLASS = _classes()


def statistics(texts: pa.Array, n_chars: pa.Array, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data, at = utf8(texts)
    n = len(at) - 1
    out = np.zeros((n, len(STATS)))
    size = np.diff(at).astype(np.float64)
    kinds = _CLASS[data]
    some = np.maximum(size, 1)
    for k in range(5):
        total = np.zeros(n)
        full = np.flatnonzero(size > 0)
        if len(full):
            total[full] = np.add.reduceat((kinds == k + 1).view(np.uint8), at[full], dtype=np.int64)
        out[:, k] = total / some
    n_words = np.diff(offsets).astype(np.float64)
    out[:, 5] = size * (1 - out[:, 3] - out[:, 4]) / np.maximum(n_words, 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    for k, gap in ((6, 1), (7, 2)):
        if len(words) > gap:
            same = (words[gap:] == words[:-gap]) & (doc[gap:] == doc[:-gap])
            out[:, k] = np.bincount(doc[gap:][same], minlength=n) / np.maximum(n_words, 1)
    out[:, 8], out[:, 9] = np.log1p(n_words), np.log1p(size)
    out[:, 10] = np.log1p(np.maximum(np.asarray(n_chars.fill_null(0).cast(pa.int64())), 0))
    return out


def _binned(stats: np.ndarray, edges: np.ndarray, bits: int) -> np.ndarray:
    """Feature numbers of the statistics, behind those of the words."""
    width = edges.shape[1] + 1
    return np.stack([(1 << bits) + k * width + np.searchsorted(edges[k], stats[:, k], "right") for k in range(len(STATS))], axis=1)


def _scores(bucket, offsets, extra, bias, w, v):
    n_words = np.maximum(np.diff(offsets), 1).astype(np.float64)
    both = np.concatenate((w[:, None], v, v * v), axis=1).astype(np.float32)
    k = v.shape[1]
    of_words = segment_sum(both[bucket], offsets)
    of_words[:, : k + 1] /= n_words[:, None]
    of_words[:, k + 1 :] /= (n_words**2)[:, None]
    total = of_words + both[extra].sum(axis=1)
    s = total[:, 1 : k + 1]
    return bias + total[:, 0] + 0.5 * ((s * s).sum(axis=1) - total[:, k + 1 :].sum(axis=1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, p: QualityParams) -> FactorModel:
    quantiles = np.linspace(0, 1, p.bins + 1)[1:-1]
    edges = np.stack([np.quantile(stats[:, k], quantiles) for k in range(len(STATS))]) if len(stats) else np.zeros((len(STATS), p.bins - 1))
    size = (1 << p.bits) + len(STATS) * p.bins
    rng = np.random.default_rng(11)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, p.rank))
    gw, gv = np.full(size, 1e-6), np.full((size, p.rank), 1e-6)
    rate = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    bias = float(np.log(rate / (1 - rate)))
    extra = _binned(stats, edges, p.bits) if len(stats) else np.zeros((0, len(STATS)), np.int64)
    shift = np.uint64(64 - p.bits)
    buckets = [(x >> shift).astype(np.int64) for x in words]
    lengths = np.array([len(x) for x in words], np.int64)
    for _ in range(p.epochs if len(words) else 0):
        order = rng.permutation(len(words))
        for at in range(0, len(order), p.batch):
            rows = order[at : at + p.batch]
            m = lengths[rows]
            off = np.concatenate(([0], np.cumsum(m)))
            flat = np.concatenate([buckets[r] for r in rows])
            idx = np.concatenate((flat, extra[rows].ravel()))
            doc = np.concatenate((np.repeat(np.arange(len(rows)), m), np.repeat(np.arange(len(rows)), len(STATS))))
            x = np.concatenate((np.repeat(1 / np.maximum(m, 1), m), np.ones(len(rows) * len(STATS))))
            s = np.stack([np.bincount(doc, v[idx, f] * x, len(rows)) for f in range(p.rank)], axis=1)
            g = _sigmoid(_scores(flat, off, extra[rows], bias, w, v)) - labels[rows]
            gx = g[doc] * x / len(rows)
            bias -= p.rate * g.mean()
            d = np.bincount(idx, gx, size)
            touched = np.flatnonzero(np.bincount(idx, minlength=size))
            d = d[touched] + p.l2 * w[touched]
            gw[touched] += d * d
            w[touched] -= p.rate * d / np.sqrt(gw[touched])
            for f in range(p.rank):
                e = np.bincount(idx, gx * (s[doc, f] - v[idx, f] * x), size)[touched] + p.l2 * v[touched, f]
                gv[touched, f] += e * e
                v[touched, f] -= p.rate * e / np.sqrt(gv[touched, f])
    return FactorModel(edges, bias if len(words) else 0.0, w, v if len(words) else np.zeros_like(v))


def _inputs(docs: DataFrame) -> list:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return [F.col("text").cast("string").alias("text"), chars.alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> FactorModel:
    """Learns from about max_rows labelled documents and max_bytes of text at most, whose fold is not 2. Word hashes and statistics reach the driver, texts don't."""
    sample = bounded_sample(docs, sampled_labels(labels, "quality", fold("doc_id", 4) != 2, p.max_rows), p.max_bytes)

    def prepared(it):
        for b in batches(it):
            h, off = word_hashes(b.column("text"), ALNUM)
            st = statistics(b.column("text"), b.column("n_chars"), h, off)
            top = (h >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([top[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary()), pa.array(list(st), pa.list_(pa.float64()))], ["doc_id", "y", "words", "stats"])

    rows = sampled_texts(docs, sample, _inputs(docs)).mapInArrow(prepared, "doc_id long, y int, words binary, stats array<double>").toArrow().sort_by("doc_id")
    words = [np.frombuffer(x, np.uint32).astype(np.uint64) << np.uint64(32) for x in rows.column("words").to_pylist()]
    stats = np.array(rows.column("stats").to_pylist(), np.float64).reshape(-1, len(STATS))
    return train(words, stats, np.array(rows.column("y").to_pylist(), np.float64), p)


def score(docs: DataFrame, model: FactorModel, p: QualityParams = QualityParams(), key: str = "doc_id") -> DataFrame:
    """key, score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shift = 64 - p.bits

    def scored(it):
        m = sent.value
        for b in batches(it, 4 << 20):
            h, off = word_hashes(b.column("text"), ALNUM)
            extra = _binned(statistics(b.column("text"), b.column("n_chars"), h, off), m.edges, p.bits)
            s = _scores((h >> np.uint64(shift)).astype(np.int64), off, extra, m.bias, m.w, m.v)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(_sigmoid(s))], [key, "score"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), *_inputs(docs)).mapInArrow(scored, f"`{key}` {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(docs, fit(docs, labels, p), p)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(it):
        m = sent.value
        for b in batches(it, 4 << 20):
            texts = b.column(text)
            n_chars = b.column(chars) if chars >= 0 else pc.utf8_length(texts)
            h, off = word_hashes(texts, ALNUM)
            extra = _binned(statistics(texts, n_chars, h, off), m.edges, p.bits)
            s = _sigmoid(_scores((h >> np.uint64(64 - p.bits)).astype(np.int64), off, extra, m.bias, m.w, m.v))
            yield b.filter(pa.array(s >= p.threshold))

    return docs.mapInArrow(run, docs.schema)
