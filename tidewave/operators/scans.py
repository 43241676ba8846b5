"""Scans over blocks of a signal: recurrences and decoders whose state runs through a signal of any length.

A signal is cut into rows (signal_id, block, x), blocks numbered from 0 without gaps. Each block is
reduced to the map that it applies to the state before it: an affine map for a linear
recurrence, a states x states matrix for a Markov chain, a table of back pointers for a path.
Maps compose associatively, so `prefix` combines those of all earlier blocks in groups of
`span` blocks, then the groups' totals in the same way, and so on: a task holds `span` maps at
most, however long a signal is. With the state before each block known, a second pass over
the blocks gives the result. Samples are read twice and shuffled only where the table of states is too large to be sent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..store import staged

_SENT_BYTES = 32 << 20


def _kind(df: DataFrame, column: str = "signal_id") -> str:
    return df.select(column).schema[0].dataType.simpleString()


def _lists(values: list) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, float).ravel() for v in values], pa.list_(pa.float64()))


def _vectors(column) -> list:
    return [np.asarray(v.values, float) if v.is_valid else None for v in column]


def prefix(maps: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], span: int = 256, reverse: bool = False) -> DataFrame:
    """signal_id, block, before: the combination of the maps m of all earlier blocks (later ones if reverse), null where there are none.

    combine(a, b) is given what comes first in the order of the scan as a.
    """
    ship(maps.sparkSession)
    kind = _kind(maps)

    def local(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("block")), kind="stable")
        t = t.take(pa.array(order[::-1] if reverse else order))
        before, all_ = [], None
        for m in _vectors(t.column("m")):
            before.append(all_)
            all_ = m if all_ is None else combine(all_, m)
        total = [None] * (len(before) - 1) + [all_]
        return pa.table({"signal_id": t.column("signal_id"), "block": t.column("block"), "part": t.column("part"), "before": _lists(before), "total": _lists(total)})

    parted = maps.select("signal_id", "block", F.floor(F.col("block") / span).alias("part"), "m")
    parts = staged(parted.groupBy("signal_id", "part").applyInArrow(local, f"signal_id {kind}, block long, part long, before array<double>, total array<double>"))
    totals = parts.where("total is not null").select("signal_id", F.col("part").alias("block"), F.col("total").alias("m"))
    if not totals.groupBy("signal_id").count().where("count > 1").limit(1).count():
        return parts.select("signal_id", "block", "before")
    carried = prefix(totals, combine, span, reverse).select("signal_id", F.col("block").alias("part"), F.col("before").alias("carry"))

    def run(it):
        for b in it:
            both = [x if c is None else c if x is None else combine(c, x) for c, x in zip(_vectors(b.column("carry")), _vectors(b.column("before")))]
            yield pa.RecordBatch.from_arrays([b.column("signal_id"), b.column("block"), _lists(both)], ["signal_id", "block", "before"])

    return parts.join(carried, ["signal_id", "part"]).select("signal_id", "block", "before", "carry").mapInArrow(run, f"signal_id {kind}, block long, before array<double>")


def beside(blocks: DataFrame, states: DataFrame, numbers: int) -> DataFrame:
    """blocks with the states (`numbers` numbers a row) of the same signal_id and block; these are sent to the blocks if they are few enough, else both are shuffled."""
    few = states.count() * (8 * numbers + 64) <= _SENT_BYTES
    return blocks.join(F.broadcast(states) if few else states, ["signal_id", "block"], "left")


def _mapped(df: DataFrame, kernel: Callable, columns: list[str], schema: str) -> DataFrame:
    """A row (signal_id, block, *kernel(row)) for each row; kernel is given the named columns, arrays as numpy arrays."""
    ship(df.sparkSession)
    types = [x.split()[1] for x in schema.split(", ")]

    def run(it):
        for b in it:
            read = [_vectors(b.column(c)) if pa.types.is_list(b.column(c).type) else b.column(c).to_pylist() for c in columns]
            made = [kernel(*row) for row in zip(*read)]
            out = [_lists(list(v)) if t.startswith("array") else pa.array(list(v), pa.float64()) for t, v in zip(types, zip(*made))] if made else [pa.array([], pa.list_(pa.float64()) if t.startswith("array") else pa.float64()) for t in types]
            yield pa.RecordBatch.from_arrays([b.column("signal_id"), b.column("block"), *out], ["signal_id", "block", *[x.split()[0] for x in schema.split(", ")]])

    return df.select("signal_id", "block", *[c for c in columns if c != "block"]).mapInArrow(run, f"signal_id {_kind(df)}, block long, {schema}")


# --- linear recurrences


@dataclass(frozen=True)
class Recurrence:
    """y = c s + e x with the state s before a row, and s' = A s + b x behind it; every column of x has its own state."""

    A: np.ndarray
    b: np.ndarray
    c: np.ndarray
    e: float

    @property
    def size(self) -> int:
        return len(self.b)

    def run(self, x: np.ndarray, s: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(y, state behind the last row) of x (rows by columns) from state s (size by columns); `step` rows at a time as matrix products."""
        n, q = len(x), len(x) // step
        out = np.empty(x.shape)
        if q:
            power = [np.eye(self.size)]
            for _ in range(step):
                power.append(power[-1] @ self.A)
            seen = np.stack([self.c @ m for m in power[:-1]])
            answer = np.concatenate(([self.e], seen[:-1] @ self.b))
            gap = np.arange(step)[:, None] - np.arange(step)
            direct = np.where(gap >= 0, answer[np.maximum(gap, 0)], 0.0)
            gained = np.stack([m @ self.b for m in power[step - 1 :: -1]], axis=1)
            parts = x[: q * step].reshape(q, step, -1)
            added = gained @ parts
            before = np.empty((q, self.size, x.shape[1]))
            for k in range(q):
                before[k] = s
                s = power[step] @ s + added[k]
            out[: q * step] = (direct @ parts + seen @ before).reshape(q * step, -1)
        for i in range(q * step, n):
            out[i] = self.c @ s + self.e * x[i]
            s = self.A @ s + self.b[:, None] * x[i]
        return out, s

    def then(self, other: Recurrence) -> Recurrence:
        """This one, followed by another."""
        corner = np.zeros((self.size, other.size))
        a = np.block([[self.A, corner], [np.outer(other.b, self.c), other.A]])
        return Recurrence(a, np.concatenate((self.b, other.b * self.e)), np.concatenate((other.e * self.c, other.c)), other.e * self.e)


def one_pole(a: float, gain: float = 1.0) -> Recurrence:
    """y = gain x + a y before."""
    return Recurrence(np.array([[a]]), np.array([gain]), np.array([a]), gain)


def biquads(sections) -> Recurrence:
    """A cascade of sections (b0, b1, b2, a1, a2)."""
    made = None
    for b0, b1, b2, a1, a2 in sections:
        each = Recurrence(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0)
        made = each if made is None else made.then(each)
    return made


def filtered(blocks: DataFrame, r: Recurrence, columns: int = 1, start: Callable[[np.ndarray], np.ndarray] | None = None, span: int = 256) -> DataFrame:
    """signal_id, block, y of a recurrence over blocks (signal_id, block, x); x has rows of `columns` numbers, one after another.

    The state is 0 before the first row, or start(first row). A delay by more than one sample is a
    recurrence over as many columns, of which blocks then have whole rows (the last may not). An empty block passes the state on.
    """
    size, d = r.size, r.size * r.size

    def first(block, x):
        zero = np.zeros((size, columns))
        return np.broadcast_to(start(x[0]), zero.shape) if start is not None and block == 0 and len(x) else zero

    def rows(x):
        """Behind the signal's end, a last row is filled with zeros."""
        return np.append(x, np.zeros(-len(x) % columns)).reshape(-1, columns)

    def reduce(block, x):
        x = rows(x)
        _, s = r.run(x, first(block, x))
        return (np.concatenate((np.linalg.matrix_power(r.A, len(x)).ravel(), s.ravel())),)

    def combine(m, n):
        power = n[:d].reshape(size, size)
        return np.concatenate(((power @ m[:d].reshape(size, size)).ravel(), (power @ m[d:].reshape(size, columns)).ravel() + n[d:]))

    def apply(block, x, before):
        m = rows(x)
        s = first(block, m) if before is None else before[d:].reshape(size, columns)
        return (r.run(m, s)[0].ravel()[: len(x)],)

    carried = prefix(_mapped(blocks, reduce, ["block", "x"], "m array<double>"), combine, span)
    return _mapped(beside(blocks, carried, d + size * columns), apply, ["block", "x", "before"], "y array<double>")


# --- Markov chains


def _best(x, axis):
    return x.max(axis=axis)


def _sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _product(total: Callable, states: int):
    def combine(a, b):
        a, b = a.reshape(states, states), b.reshape(states, states)
        return total(a[:, :, None] + b[None], 1).ravel()

    return combine


@dataclass(frozen=True)
class Chain:
    """Log scores of a chain's beginning and steps; blocks have log scores of the states, row by row, as x."""

    init: np.ndarray
    trans: np.ndarray

    @property
    def states(self) -> int:
        return len(self.init)

    def _maps(self, blocks: DataFrame, total: Callable) -> DataFrame:
        """m: scores of the paths from each state before a block to each at its end. The first block's are those from the beginning, whatever the state."""

        def reduce(block, x):
            rows = x.reshape(-1, self.states)
            if block == 0:
                m = np.broadcast_to(self.init + rows[0], (self.states, self.states))
                rows = rows[1:]
            else:
                m = np.where(np.eye(self.states, dtype=bool), 0.0, -np.inf)
            for o in rows:
                m = total(m[:, :, None] + self.trans[None], 1) + o
            return (m,)

        return _mapped(blocks, reduce, ["block", "x"], "m array<double>")

    def _ahead(self, rows: np.ndarray, before, total: Callable) -> np.ndarray:
        """Scores of all states at each row, from those before the block."""
        out = np.empty(rows.shape)
        a = None if before is None else before[: self.states]
        for t, o in enumerate(rows):
            a = (self.init if a is None else total(a[:, None] + self.trans, 0)) + o
            out[t] = a
        return out

    def _traced(self, rows: np.ndarray, before):
        """Scores at the last row, and back pointers by row; ties go to the lower state."""
        a, back = None if before is None else before[: self.states], np.zeros(rows.shape, np.int64)
        for t, o in enumerate(rows):
            if a is None:
                a = self.init + o
            else:
                m = a[:, None] + self.trans
                back[t] = m.argmax(axis=0)
                a = m.max(axis=0) + o
        return a, back

    def viterbi(self, blocks: DataFrame, span: int = 256) -> DataFrame:
        """signal_id, block, y: the likeliest path's states."""
        k = self.states
        before = staged(prefix(self._maps(blocks, _best), _product(_best, k), span))
        known = staged(beside(blocks, before, k * k))

        def entry(x, before):
            a, back = self._traced(x.reshape(-1, k), before)
            at = np.append(np.arange(k), a.argmax())  # behind the last block the best state counts
            for row in back[::-1]:
                at = row[at]
            return (at,)

        ends = prefix(_mapped(known, entry, ["x", "before"], "m array<double>"), lambda later, m: m[later.astype(np.int64)], span, reverse=True).withColumnRenamed("before", "later")

        def path(x, before, later):
            a, back = self._traced(x.reshape(-1, k), before)
            at = int(a.argmax()) if later is None else int(later[k])
            out = np.zeros(len(back))
            for t in range(len(back) - 1, -1, -1):
                out[t] = at
                at = back[t, at]
            return (out,)

        return _mapped(beside(known, ends, k + 1), path, ["x", "before", "later"], "y array<double>")

    def posteriors(self, blocks: DataFrame, span: int = 256) -> DataFrame:
        """signal_id, block, y: the states' probabilities, row by row."""
        k = self.states
        maps = staged(self._maps(blocks, _sum))
        product = _product(_sum, k)
        before = prefix(maps, product, span)
        after = prefix(maps, lambda later, m: product(m, later), span, reverse=True).withColumnRenamed("before", "later")

        def both(x, before, later):
            rows = x.reshape(-1, k)
            a, out = self._ahead(rows, before, _sum), np.empty(rows.shape)
            b = np.zeros(k) if later is None else _sum(later.reshape(k, k), 1)
            for t in range(len(rows) - 1, -1, -1):
                g = a[t] + b
                out[t] = np.exp(g - _sum(g, 0))
                b = _sum(self.trans + rows[t] + b, 1)
            return (out,)

        return _mapped(beside(beside(blocks, before, k * k), after, k * k), both, ["x", "before", "later"], "y array<double>")

    def log_partition(self, blocks: DataFrame, span: int = 256) -> DataFrame:
        """signal_id, z: the logarithm of the sum over all paths."""
        k = self.states
        before = prefix(self._maps(blocks, _sum), _product(_sum, k), span)
        ended = _mapped(beside(blocks, before, k * k), lambda x, before: (float(_sum(self._ahead(x.reshape(-1, k), before, _sum)[-1], 0)),), ["x", "before"], "z double")
        return ended.groupBy("signal_id").agg(F.max_by("z", "block").alias("z"))
