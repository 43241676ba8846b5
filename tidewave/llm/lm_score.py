"""Scoring by an n-gram language model in a log-frequency Bloom filter.

Tokens are words without white space, A-Z lower-cased, and one end of each text, which
is also what stands before its first word. The n-grams of the training texts are counted
exactly in one aggregation. A count c is quantised to the level 1 + floor(log_base c), and
an n-gram of level q is in the filter q times, together with 1, ..., q. Its count is read by
asking for 1, 2, ... until the answer is no, so that a false answer makes a level one too high
with a probability that falls with each step. The filter is built in segments by the hash of the
n-gram, each of bounded size and by one task, and then broadcast as a whole.

A token's probability is, from shorter to longer contexts,

    p1 = (c(w) + 0.5) / (N + 0.5 (V + 1)),   pk = (min(c(h w), c(h)) + mu p(k-1)) / (c(h) + mu),

with the counts from the filter. The base score takes exact counts: those of the most
frequent tokens are broadcast as a sorted table of `table_bytes` at most; any other token
that the filter does not exclude is joined to the count table, pre-aggregated by text.

`max_bytes` bounds the filter, whatever the corpus: n-grams enter from the least level on with which
all fit, and single tokens are the last to stay outside. Where a least level is set, n-grams enter from it on, not from 1.
The levels of those outside are exact. Some follow from what is known: an n-gram of a text that was learned from occurs, so
below a least level of 2 it has level 1; and none occurs more often than the shorter ones in it. The level of any other that the filter
knows not is asked of the count table: slices of texts send each such n-gram once to its segment and get the level back, and only
then are these tokens scored. Texts that were learned from and others are in different slices.
`min_counts`, the least counts by order, are part of the model.

Edge cases: a null or empty text has one token, its end; a null doc_id counts as held
out; rows that repeat count, and are returned, as often as they occur; without training texts
all counts are 0 and every probability is 1 (score 0); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared_store import staged
from .text import NOT_SPACE, batches, fold, mix64, segment_sum, word_hashes

_END = np.uint64(0x7C0FFEE15EADBEEF)
_STEP, _ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEYS = 5  # bits set for an item, in one word of the filter
_CHUNK = 1 << 19  # tokens at a time


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    base: float = 2.0  # of the levels
    mu: float = 3.0  # weight of the shorter context
    min_counts: tuple[int, ...] = (1, 1, 2)  # for n-grams of 1, 2 and 3 tokens
    max_bytes: int = 96 << 20  # of the filter; n-grams beyond are looked up in the count table
    table_bytes: int = 32 << 20  # of exact counts, 16 bytes each
    item_bits: int = 16  # of the filter, for each item
    segment_bytes: int = 4 << 20  # of text, for a segment
    least_bits: int = 8  # of a segment's number


def levels(n: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(base) + 1e-9).astype(np.int64)


def level_count(q: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for: 0 for level 0, else the middle of those it holds."""
    low = np.ceil(np.power(base, np.maximum(q, 1) - 1.0) - 1e-9)
    high = np.maximum(np.ceil(np.power(base, np.maximum(q, 1) * 1.0) - 1e-9) - 1, low)
    return np.where(q > 0, (low + high) / 2, 0.0)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each begun and closed by an end, and the texts' offsets in them."""
    h, at = word_hashes(texts, NOT_SPACE)
    n = len(at) - 1
    words = np.diff(at)
    offsets = np.concatenate(([0], np.cumsum(words + 2)))
    out = np.full(int(offsets[-1]), _END)
    out[np.arange(len(h)) + np.repeat(1 + 2 * np.arange(n), words)] = h
    return out, offsets


def grams(t: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length, the hash of the n-gram that ends at each token of t, and whether there is one. first: the distance to the text's beginning."""
    out = [(mix64(t ^ _STEP), first >= 0)]
    h = t * _ODD + _STEP
    for k in range(1, order):
        before = np.concatenate((np.zeros(k, np.uint64), t[:-k])) if len(t) > k else np.zeros(len(t), np.uint64)
        h = mix64(h + before * _MORE) * _ODD + np.uint64(k)
        out.append((mix64(h), first >= k))
    return out


def _slices(t: np.ndarray, offsets: np.ndarray, order: int, most: int = 0):
    """Slices of at most `most` (else _CHUNK) tokens with the tokens before them: (first and last token, tokens in front, slice, distance to the text's beginning)."""
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    most = most or _CHUNK
    for a in range(0, len(t), most):
        z = min(a + most, len(t))
        lead = min(order - 1, a)
        yield a, z, lead, t[a - lead : z], np.arange(a - lead, z) - begin[a - lead : z]


def _small(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _large(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def _sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences, bytes of equal weight together: of hashes, those that are all chance and those that are mostly 0."""
    return _small(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _read_sorted(raw: bytes) -> np.ndarray:
    planes = np.ascontiguousarray(_large(raw, np.uint8).reshape(8, -1).T)
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64)


def _short(gram: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits of a hash behind those of its segment."""
    return (gram << np.uint64(bits)) >> np.uint64(24)


def _long(low: np.ndarray, segment: int, bits: int) -> np.ndarray:
    """The hashes that _short cut, with zeros in what is lost."""
    return (np.uint64(segment) << np.uint64(64 - bits)) | (low << np.uint64(24 - bits))


def segment_bits(docs: DataFrame, p: LmParams) -> int:
    """So many segments, as a power of two, that each gets the n-grams of about `segment_bytes` of text."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(total, 1) / p.segment_bytes)), p.least_bits, 20))


_COUNTED = "k int, segment int, grams binary, counts binary, levels binary, spread array<long>, n long"


def counts(docs: DataFrame, p: LmParams, bits: int) -> DataFrame:
    """A row for each number of tokens k and segment: its n-grams from min_counts on, with counts (k = 1) and levels; spread: how many there are of each level; n: all occurrences.

    An n-gram of one token is known by 64 bits, longer ones by those of the segment and 40 more.
    """

    def run(it):
        for b in batches(it, 8 << 20):
            t, offsets = tokens_of(b.column("text"))
            for _, _, lead, part, first in _slices(t, offsets, p.order, 2 * _CHUNK):
                for k, (h, there) in enumerate(grams(part, first, p.order)):
                    # the end before a text is context only; it is no token
                    keep = there & (first > 0)
                    keep[:lead] = False
                    gram, n = np.unique(h[keep], return_counts=True)
                    segment = (gram >> np.uint64(64 - bits)).astype(np.int64)
                    some, at = np.unique(segment, return_index=True)
                    cuts = list(zip(at, np.append(at[1:], len(gram))))
                    rows = gram if k == 0 else _short(gram, bits)
                    packed = [pa.array([_sorted(rows[i:j]) for i, j in cuts], pa.binary()), pa.array([_small(n[i:j].astype("<u4")) for i, j in cuts], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k + 1, np.int32)), pa.array(some.astype(np.int32)), *packed], ["k", "segment", "grams", "counts"])

    def total(t: pa.Table) -> pa.Table:
        k, segment = t.column("k")[0].as_py(), t.column("segment")[0].as_py()
        gram, n = np.concatenate([_read_sorted(x.as_py()) for x in t.column("grams")]), np.concatenate([_large(x.as_py(), "<u4") for x in t.column("counts")]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        gram, n = gram[head], np.add.reduceat(n, head)
        every = int(n.sum())
        keep = n >= p.min_counts[k - 1]
        gram, n = gram[keep], n[keep]
        level = levels(n, p.base)
        spread = np.bincount(level, minlength=1)
        values = ([k], [segment], [_sorted(gram)], [_small(n.astype("<i8")) if k == 1 else b""], [_small(level.astype("<u2"))], [spread], [every])
        return pa.table([pa.array(v, x) for v, x in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()))], names=[c.split()[0] for c in _COUNTED.split(", ")])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k int, segment int, grams binary, counts binary")
    return found.groupBy("k", "segment").applyInArrow(total, _COUNTED)


def _hashes(raw: bytes, k: int, segment: int, bits: int) -> np.ndarray:
    """The n-grams of a row of the count table, as the filter knows them."""
    gram = _read_sorted(raw)
    return shortened(gram, 1 << bits) if k == 1 else _long(gram, segment, bits)


def _single(table: DataFrame, low: int, high: int) -> DataFrame:
    """gram, n of the single tokens whose level is from low to below high."""

    def run(it):
        for b in it:
            for gram, n, level in zip(*(b.column(c).to_pylist() for c in ("grams", "counts", "levels"))):
                q = _large(level, "<u2")
                keep = (q >= low) & (q < high)
                yield pa.RecordBatch.from_arrays([pa.array(_read_sorted(gram)[keep].view(np.int64)), pa.array(_large(n, "<i8")[keep])], ["gram", "n"])

    return table.where("k = 1").select("grams", "counts", "levels").mapInArrow(run, "gram long, n long")


def _places(gram: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In a segment of `size` words: the word of (gram, level), and the bits in it."""
    h = mix64(gram * _ODD + np.uint64(level * int(_STEP) % (1 << 64)))
    word = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for k in range(_KEYS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), mask


def segment_of(gram: np.ndarray, segments: int) -> np.ndarray:
    """segments: a power of two."""
    return (gram >> np.uint64(65 - segments.bit_length())).astype(np.int64) if segments > 1 else np.zeros(len(gram), np.int64)


def shortened(gram: np.ndarray, segments: int) -> np.ndarray:
    """A hash as the filter knows it."""
    lost = np.uint64(25 - segments.bit_length())
    return gram >> lost << lost


def fill(gram: np.ndarray, level: np.ndarray, size: int, least: int = 0) -> np.ndarray:
    """A segment's words; levels are entered from `least` on."""
    out = np.zeros(size, np.uint64)
    for q in range(max(least, 1), int(level.max(initial=0)) + 1):
        word, mask = _places(gram[level >= q], q, size)
        np.bitwise_or.at(out, word, mask)
    return out


def probe(bits: np.ndarray, gram: np.ndarray, deepest: int, least: int = 0) -> np.ndarray:
    """The level of each gram in the filter (segments by words), entered from `least` on and at most `deepest`; 0 where it is not there."""
    level = np.zeros(len(gram), np.int64)
    at, q = np.arange(len(gram)), max(least, 1) - 1
    segment, gram = segment_of(gram, len(bits)), shortened(gram, len(bits))
    while len(at) and q < deepest:
        q += 1
        word, mask = _places(gram[at], q, bits.shape[1])
        at = at[(bits[segment[at], word] & mask) == mask]
        level[at] = q
    return level


@dataclass(frozen=True)
class Model:
    bits: np.ndarray  # segments by words
    total: int  # tokens learned from
    distinct: int
    deepest: int  # the highest level
    table: tuple[np.ndarray, np.ndarray]  # the most frequent single tokens (sorted) and their exact counts
    top: int  # the least level in the table; 1: it has every token
    rest: DataFrame | None  # gram, n of the others
    least: tuple[int, ...]  # by order, the least level in the filter; 0: all are in it
    counted: DataFrame | None  # the count table, if n-grams are outside the filter


def _entries(level: int, least: int) -> int:
    """How often an n-gram of this level is in the filter."""
    return level + 1 - max(least, 1)


def least_levels(spread: list, p: LmParams) -> tuple[int, ...]:
    """By order, the least level of the n-grams in a filter of max_bytes; 0 where all are in it. spread: k, level, c (how many).

    Those leave first that spare most of the filter for each token that must be looked up then; single tokens last.
    """
    least, tokens = [0] * p.order, sum(r.c * level_count(r.level, p.base) for r in spread if r.k == 1)
    inside = lambda k, q: [r for r in spread if r.k == k + 1 and r.level >= q]
    size = lambda k, q: sum(r.c * _entries(r.level, q) for r in inside(k, q))
    asked = lambda k, q: tokens - sum(r.c * level_count(r.level, p.base) for r in inside(k, q)) if q else 0
    while sum(size(k, q) for k, q in enumerate(least)) * p.item_bits > 8 * p.max_bytes:
        after = {k: 1 + min(r.level for r in inside(k, least[k])) for k in range(p.order) if inside(k, least[k])}
        cost = lambda k: (asked(k, after[k]) - asked(k, least[k])) / (size(k, least[k]) - size(k, after[k]))  # noqa: B023, E731
        k = min((k for k in after if k or len(after) == 1), key=cost)
        least[k] = after[k]
    return tuple(least)


def fit(docs: DataFrame, p: LmParams = LmParams()) -> Model:
    """Learns from all texts of docs."""
    bits = segment_bits(docs, p)
    segments = 1 << bits
    table = staged(counts(docs, p, bits))
    # a row for each number of tokens and level, and one for each number of tokens
    spread = table.select("k", F.posexplode("spread").alias("level", "c")).where("c > 0").groupBy("k", "level").agg(F.sum("c").alias("c")).collect()
    total = table.where("k = 1").agg(F.sum("n")).first()[0] or 0
    distinct = sum(r.c for r in spread if r.k == 1)
    least = least_levels(spread, p)
    size = -(-sum(r.c * _entries(r.level, least[r.k - 1]) for r in spread if r.level >= least[r.k - 1]) * p.item_bits // (64 * segments)) + 1

    def build(it):
        for b in it:
            for k, segment, gram, level in zip(*(b.column(c).to_pylist() for c in ("k", "segment", "grams", "levels"))):
                g, q = _hashes(gram, k, segment, bits), _large(level, "<u2")
                keep = q >= least[k - 1]
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([fill(g[keep], q[keep], size, least[k - 1]).tobytes()], pa.binary())], ["segment", "bits"])

    made = np.zeros((segments, size), np.uint64)
    for r in table.select("k", "segment", "grams", "levels").mapInArrow(build, "segment int, bits binary").toLocalIterator():
        made[r.segment] |= np.frombuffer(r.bits, np.uint64)
    room, top = p.table_bytes // 16, 1
    while sum(r.c for r in spread if r.k == 1 and r.level >= top) > room:
        top += 1
    known = _single(table, top, 1 << 16).toArrow()
    gram, n = np.asarray(known.column("gram")).view(np.uint64), np.asarray(known.column("n"))
    order = np.argsort(gram)
    return Model(made, total, distinct, max((r.level for r in spread), default=0), (gram[order], n[order]), top, None if top == 1 else _single(table, 1, top), least, table if any(least) else None)


def log_probabilities(level: list[np.ndarray], there: list[np.ndarray], m: tuple[int, int], p: LmParams) -> np.ndarray:
    """log10 of each token's probability, from the levels of the n-grams that end there. The context of an n-gram is the one of a token less that ends at the token before."""
    c = [level_count(q, p.base) for q in level]
    total, distinct = m
    prob = (c[0] + 0.5) / (total + 0.5 * (distinct + 1))
    for k in range(1, len(c)):
        context = np.concatenate(([0.0], c[k - 1][:-1]))
        longer = (np.minimum(c[k], context) + p.mu * prob) / (context + p.mu)
        prob = np.where(there[k], longer, prob)
    return np.log10(np.minimum(prob, 1.0))


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, grams array<long>, times array<int>"
_SLICE = "pack long, lead int, levels binary, places binary, rows array<long>, starts array<long>, asked array<struct<k:int,segment:int,grams:binary>>"


def _kind(deepest: int) -> str:
    """Of a slice's levels; its largest number stands for what is to be asked."""
    return "<u1" if deepest < 255 else "<u2"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _asked(outside: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[np.ndarray, list[dict]]:
    """outside: by order, whether an n-gram of a slice's positions is outside the filter, and the n-grams. The number of each of those in what is asked, and what is asked by order and segment."""
    places, asked, before = [], [], 0
    for k, (out, gram) in enumerate(outside):
        each, back = np.unique(shortened(gram[out], 1 << bits), return_inverse=True)
        segment, at = np.unique(segment_of(each, 1 << bits), return_index=True)
        for x, i, j in zip(segment.tolist(), at, np.append(at[1:], len(each))):
            asked.append({"k": k + 1, "segment": x, "grams": _sorted(_short(each[i:j], bits))})
        places.append(before + back)
        before += len(each)
    return np.concatenate(places).astype("<i4"), asked


def _answers(asks: DataFrame, counted: DataFrame, least: tuple[int, ...], bits: int) -> DataFrame:
    """pack, at, levels: those of the n-grams in asks (pack, at, k, segment, grams), which are below the least ones."""

    def beyond(it):
        for b in it:
            for k, segment, gram, level in zip(*(b.column(c).to_pylist() for c in ("k", "segment", "grams", "levels"))):
                q = _large(level, "<u2")
                keep = q < least[k - 1]
                low = _short(_hashes(gram, k, segment, bits)[keep], bits)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([segment], pa.int32()), pa.array([_sorted(low)], pa.binary()), pa.array([_small(q[keep])], pa.binary())], ["k", "segment", "grams", "levels"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"pack": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "levels": pa.array([], pa.binary())})
        gram, level = np.zeros(0, np.uint64), np.zeros(0, "<u2")
        for raw, q in zip(right.column("grams"), right.column("levels")):  # one row, if any
            gram, level = _read_sorted(raw.as_py()), _large(q.as_py(), "<u2")
        found = []
        for raw in left.column("grams"):
            want = _read_sorted(raw.as_py())
            at = np.minimum(np.searchsorted(gram, want), max(len(gram) - 1, 0))
            found.append(_small((np.where(gram[at] == want, level[at], 0) if len(gram) else np.zeros(len(want))).astype("<u2")))
        return pa.table({"pack": left.column("pack"), "at": left.column("at"), "levels": pa.array(found, pa.binary())})

    rest = counted.where(F.col("k").isin([k + 1 for k, q in enumerate(least) if q])).select("k", "segment", "grams", "levels").mapInArrow(beyond, "k int, segment int, grams binary, levels binary")
    return asks.groupBy("k", "segment").cogroup(rest.groupBy("k", "segment")).applyInArrow(answer, "pack long, at int, levels binary")


def _asked_scores(slices: DataFrame, model: Model, p: LmParams) -> DataFrame:
    """row, score: the model's scores of all slices' tokens by row, with the levels that the filter lacks from the count table."""
    total, distinct, bits, kind = model.total, model.distinct, len(model.bits).bit_length() - 1, _kind(model.deepest)
    asks = slices.select("pack", F.posexplode("asked").alias("at", "a")).select("pack", "at", "a.k", "a.segment", "a.grams")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        lead = left.column("lead")[0].as_py()
        level = _large(left.column("levels")[0].as_py(), kind).reshape(p.order, -1).astype(np.int64)
        rows, starts = (np.asarray(left.column(c)[0].values) for c in ("rows", "starts"))
        order = np.argsort(np.asarray(right.column("at")), kind="stable")
        found = np.concatenate([_large(right.column("levels")[i].as_py(), "<u2") for i in order.tolist()])
        level[level == np.iinfo(kind).max] = found[_large(left.column("places")[0].as_py(), np.uint8).reshape(4, -1).T.copy().view("<i4")[:, 0]]
        at = np.arange(level.shape[1])
        doc = np.searchsorted(starts, at, "right") - 1
        first = at - starts[doc]
        token = (first > 0) & (at >= lead)
        logs = log_probabilities(list(level), [first >= k for k in range(p.order)], (total, distinct), p)
        return pa.table({"row": pa.array(rows), "score": pa.array(np.bincount(doc[token], logs[token], len(rows)))})

    state = slices.select("pack", "lead", "levels", "places", "rows", "starts")
    parts = state.groupBy("pack").cogroup(_answers(asks, model.counted, model.least, bits).groupBy("pack")).applyInArrow(finish, "row long, score double")
    return parts.groupBy("row").agg(F.sum("score").alias("asked_score"))


def _settled(level: list[np.ndarray], outside: list[np.ndarray], least: tuple[int, ...], learned: bool, p: LmParams) -> None:
    """Takes those out of outside whose level follows from what is known, and sets it."""
    before = lambda x: np.concatenate(([False], x[:-1]))
    for k, out in enumerate(outside):
        need = int(levels(np.array(p.min_counts[k]), p.base))
        if k and p.min_counts[k - 1] <= p.min_counts[k] and least[k - 1] <= need:
            few = level[k - 1] < need  # the filter has all of that level
            out &= ~(few | before(few))
        if learned and p.min_counts[k] == 1 and least[k] == 2:
            level[k][out] = 1
            out[:] = False


def scores(docs: DataFrame, model: Model, p: LmParams = LmParams(), learned: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. learned: whether the model has learned from the row, as far as is known."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bits, model.table, model.total, model.distinct, model.deepest, model.top))
    least, asking = model.least, model.counted is not None
    n_bits = len(model.bits).bit_length() - 1
    schema = f"{_SCORED}, {_SLICE}" if asking else _SCORED
    kinds = list(to_arrow_schema(StructType.fromDDL(schema)))

    def run(it):
        bits, (known, known_n), total, distinct, deepest, top = sent.value
        below = np.log10(total + 0.5 * (distinct + 1))
        row = TaskContext.get().partitionId() << 40
        pack = row
        for b, seen in _parted(it, 4 << 20):
            t, offsets = tokens_of(b.column("text"))
            n = len(offsets) - 1
            base, model_score, sure = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            rare: list[tuple] = []
            for a, z, lead, part, first in _slices(t, offsets, p.order):
                level, there, outside = [], [], []
                for k, (h, ok) in enumerate(grams(part, first, p.order)):
                    each, back = np.unique(h, return_inverse=True)
                    q = probe(bits, each, deepest, least[k])
                    if k == 0:
                        at = np.minimum(np.searchsorted(known, each), max(len(known) - 1, 0))
                        hit = known[at] == each if len(known) else np.zeros(len(each), bool)
                        exact = np.where(hit, known_n[at], 0) if len(known) else np.zeros(len(each), np.int64)
                        open_ = ~hit & ((q > 0) | (least[0] > 0)) & (top > 1)
                        if seen and top == 2 and p.min_counts[0] == 1 and levels(np.array(2), p.base) > 1:  # what was learned from occurs, here once
                            exact, open_ = np.where(hit, exact, 1), np.zeros(len(each), bool)
                    out = q < least[k]
                    level.append(q[back])
                    there.append(ok)
                    outside.append((out[back] & ok, h))
                    if k == 0:
                        back0, each0 = back, each
                token = first > 0
                token[:lead] = False
                doc = np.searchsorted(offsets, np.arange(a - lead, z), "right") - 1
                if asking:
                    _settled(level, [out for out, _ in outside], least, seen, p)
                if any(out.any() for out, _ in outside):
                    places, asked = _asked(outside, n_bits)
                    shown = np.stack([np.where(out, np.iinfo(_kind(deepest)).max, q) for q, (out, _) in zip(level, outside)]).astype(_kind(deepest))
                    docs_in = np.arange(doc[0], doc[-1] + 1)
                    yield _row(kinds, pack=pack, lead=lead, levels=_small(shown), places=_small(places.view(np.uint8).reshape(-1, 4).T), rows=row + docs_in, starts=offsets[docs_in] - (a - lead), asked=asked)
                    pack += 1
                else:
                    logs = log_probabilities(level, there, (total, distinct), p)
                    model_score += np.bincount(doc[token], logs[token], n)
                sure_at = token & ~open_[back0]
                base += np.bincount(doc[sure_at], (np.log10(exact + 0.5) - below)[back0[sure_at]], n)
                sure += np.bincount(doc[sure_at & (exact[back0] > 0)], minlength=n)
                left = np.flatnonzero(token & open_[back0])
                if len(left):
                    rare.append((doc[left], each0[back0[left]]))
            doc_of = np.concatenate([x[0] for x in rare]) if rare else np.zeros(0, np.int64)
            gram_of = np.concatenate([x[1] for x in rare]) if rare else np.zeros(0, np.uint64)
            order = np.lexsort((gram_of, doc_of))
            doc_of, gram_of = doc_of[order], gram_of[order]
            head = np.flatnonzero(np.concatenate(([True], (doc_of[1:] != doc_of[:-1]) | (gram_of[1:] != gram_of[:-1])))) if len(doc_of) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(doc_of)))
            at = pa.array(np.searchsorted(doc_of[head], np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(gram_of[head].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))]
            columns = [pa.array(row + np.arange(n)), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(offsets) - 1), pa.array(sure), pa.array(base), pa.array(model_score), *lists]
            columns += [pa.nulls(n, f.type) for f in kinds[len(columns) :]]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kinds])
            row += n

    held = F.coalesce(fold("doc_id", 5) == 1, F.lit(True))
    seen = F.coalesce(learned if learned is not None else F.lit(False), F.lit(False))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), seen.alias("learned")).mapInArrow(run, schema)
    if asking or model.rest is not None:
        both = staged(scored)
        rows = both.where("pack is null") if asking else both
        scored = rows.select(*_names(_SCORED)[:-2])
    if asking:
        found = _asked_scores(both.where("pack is not null").select(*_names(_SLICE)), model, p)
        scored = scored.join(found, "row", "left").withColumn("score", F.col("score") + F.coalesce("asked_score", F.lit(0.0)))
    if model.rest is not None:
        below = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
        open_ = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
        met = open_.join(model.rest, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        sums = met.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - below)).alias("b"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("kn"))
        both = scored.join(sums, "row", "left")
        scored = both.withColumn("base_score", F.col("base_score") + F.coalesce("b", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("kn", F.lit(0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _parted(it, most: int):
    """The rows that were learned from, and the others, which are gathered to about `most` bytes."""
    others, size = [], 0
    for b in batches(it, most):
        seen = b.column("learned")
        part = b.filter(seen)
        if part.num_rows:
            yield part, True
        part = b.filter(pc.invert(seen))
        if part.num_rows:
            others.append(part)
            size += part.nbytes
        if size >= most:
            yield _joined(others), False
            others, size = [], 0
    if others:
        yield _joined(others), False


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _row(kinds: list[pa.Field], **values) -> pa.RecordBatch:
    """One row; null where no value is given."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in kinds], [f.name for f in kinds])


def language_model(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """Scores of all rows by a model of those whose crc32(doc_id) mod 5 is not 1."""
    learned = fold("doc_id", 5) != 1
    return scores(docs, fit(docs.where(learned), p), p, learned)
