"""Shared text kernels: word hashing over Arrow buffers, label folds, bounded label samples.

All kernels work on whole texts. A null text is treated as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_P = np.uint64(0x9E3779B97F4A7C55)
_PINV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_CHUNK = 1 << 17


def byte_table(is_word) -> np.ndarray:
    """256 flags: is byte b part of a word."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: words of [^\x20\x09-\x0D]+
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: words of ASCII letters and digits and of everything beyond ASCII
ALNUM = byte_table(lambda b: b >= 128 or chr(b).isalnum())
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class _Powers:
    """P^i and P^-i up to the longest buffer seen, at least one chunk."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = max(n, _CHUNK)
            for name, base in (("up", _P), ("down", _PINV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _hash_block(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = table[data]
    begin = np.zeros(n + 1, bool)
    inner = offsets[:-1][np.diff(offsets) > 0]
    begin[inner] = True
    start = np.flatnonzero(word[:n] & (begin[:n] | ~np.concatenate(([False], word[: n - 1]))))
    end = np.flatnonzero(word[:n] & (begin[1:] | ~word[1:])) + 1
    up, down = _Powers.get(n)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=acc[1:])
    h = (acc[end] - acc[start]) * down[start]
    h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(start, offsets).astype(np.int64), start, end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and its offsets in them. Nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_places(texts: pa.Array, table: np.ndarray):
    """As word_hashes, and the first byte of each word and the byte behind it, both counted from the first text's beginning.

    Texts are hashed in small blocks that fit the cache, so that memory stays bounded by
    that or by the longest single text.
    """
    data, offsets = utf8(texts)
    parts, bounds, base, i, n = [], [np.zeros(1, np.int64)], 0, 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        h, b, start, end = _hash_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
        parts.append((h, start + offsets[i], end + offsets[i]))
        bounds.append(b[1:] + base)
        base += len(h)
        i = j
    h, start, end = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, k) for k in (np.uint64, np.int64, np.int64))
    return h, np.concatenate(bounds), start, end


def word_hashes(texts: pa.Array, table: np.ndarray):
    """64-bit hashes of all words of all texts, A-Z lower-cased, in order; and the words' offsets by text."""
    return word_places(texts, table)[:2]


def sequence_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence h[start:end] of word hashes."""
    up, down = _Powers.get(len(h) + 1)
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=acc[1:])
    return mix64((acc[end] - acc[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_BYTES = [mix64(np.arange(1, 257, dtype=np.uint64) * k) for k in (_P, np.uint64(0xD1B54A32D192ED03))]


def span_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each data[bounds[i]:bounds[i + 1]], made in small blocks as in word_places."""
    n = len(bounds) - 1
    out, i = (np.empty(n, np.uint64), np.empty(n, np.uint64)), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _CHUNK, "right")) - 1)
        part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        up, down = _Powers.get(len(part) + 1)
        size = np.diff(at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for h, table in zip(out, _BYTES):
            acc = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], out=acc[1:])
            h[i:j] = mix64((acc[at[1:]] - acc[at[:-1]]) * down[at[:-1]] + size)
        i = j
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along the first axis; 0 for empty segments."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def hash_share(key: Column, count: int, limit: int) -> Column:
    """Whether a row belongs to the share of about limit / count rows of least key hash; all do where count is at most limit."""
    if count <= limit:
        return F.lit(True)
    return F.xxhash64(key) < int(-(1 << 63) + (1 << 64) * limit / count)


def sampled_labels(labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """About `limit` (doc_id, y) at most, with y in {0, 1}, those of least key hash; `learn` says of a doc_id whether it may be learned from.

    The rows are counted first, and the hash below which a row is taken follows from that,
    so that no task or driver sees more than its share. A doc_id labelled twice counts
    once, with its larger label.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return usable.where(hash_share(F.col("doc_id"), usable.count(), limit))


def sampled_texts(docs: DataFrame, sample: DataFrame, columns: list[Column]) -> DataFrame:
    """The sample's documents: doc_id, y and `columns`; of rows that share a doc_id the one of least columns. The sample has a bounded number of rows, so that it may be broadcast."""
    names = [docs.select(c).columns[0] for c in columns]
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", *columns).join(F.broadcast(sample), "doc_id")
    one = keyed.groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("m"))
    return one.select("doc_id", "y", *(F.col(f"m.{n}").alias(n) for n in names))


def bounded_sample(docs: DataFrame, sample: DataFrame, max_bytes: int) -> DataFrame:
    """The sample (doc_id, y), or, if its texts have more bytes, those of least key hash whose texts together have at most max_bytes.

    The sample has a bounded number of rows; only their ids and sizes reach the driver. Of rows that share a doc_id the longest counts.
    """
    sizes = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).cast("long").alias("size")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.max("size").alias("size"))
    rows = sizes.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", F.coalesce("size", F.lit(0)).alias("size")).collect()
    if sum(r.size for r in rows) <= max_bytes:
        return sample
    kept, left = [], max_bytes
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        if r.size <= left:
            kept.append((r.doc_id, r.y))
            left -= r.size
    return docs.sparkSession.createDataFrame(kept, sample.schema)


def _give_back() -> None:
    """What earlier tasks of this worker have freed goes back to the system: workers live through many stages, and their libraries keep freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def batches(it: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most 4096 rows, cut further while the text column has over `most` bytes and over one row."""
    _give_back()
    for batch in it:
        at = batch.schema.get_field_index("text")
        todo = [batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)]
        while todo:
            b = todo.pop(0)
            size = b.column(at).nbytes if at >= 0 else 0
            if size > most and b.num_rows > 1:
                half = b.num_rows // 2
                todo[:0] = [b.slice(0, half), b.slice(half)]
            else:
                yield b


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
