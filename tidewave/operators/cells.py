"""All pairs of a signal's frames, by cells of a row block and a column block.

Blocks grow with their signal, so that it has at most _PARTS of them until they have _MOST frames: a frame is sent to 2 * _PARTS
cells, whatever the length. A cell is worked through in slices of rows, each of which is given
on as soon as it is done: a task holds two blocks and a slice, never a matrix. What is the same for (i, j) and (j, i) needs only the
cells on the diagonal and above it, and where cells keep little, blocks can be wider (_WIDE of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .lift import as_matrix
from .segment import path_sizes
from .sequence import TINY

_PARTS, _MOST = 16, 8192
_WIDE = 8  # blocks of a signal where a cell only holds its frames and a slice
_SLICE = 1 << 19  # pairs at a time
_TILE = 512  # columns of a run of pairs: what stores them finds that columns repeat


def block_size(n, least: int, parts: int = _PARTS):
    """Frames in a block, as a column, of a signal of n frames."""
    return F.least(F.greatest(F.lit(least), F.ceil(n / parts)), F.greatest(F.lit(least), F.lit(_MOST))).cast("long")


def lengths(frames: DataFrame, least: int, parts: int = _PARTS) -> DataFrame:
    """signal_id, n, size of a block, last block: a row for each signal."""
    n = frames.groupBy("signal_id").agg((F.max("i") + 1).alias("n")).withColumn("size", block_size(F.col("n"), least, parts))
    return n.withColumn("last", F.floor((F.col("n") - 1) / F.col("size")).cast("int"))


def dealt(frames: DataFrame, least: int, parts: int = _PARTS, half: bool = False):
    """The cells: signal_id, i, v, query (whether a row of the cell), row, col, grouped by cell. frames: signal_id, i (from 0 without gaps), v; half: only those with row <= col."""
    placed = frames.select("signal_id", "i", "v").join(lengths(frames, least, parts), "signal_id").withColumn("b", F.floor(F.col("i") / F.col("size")).cast("int"))
    columns, rows = F.sequence(F.col("b") if half else F.lit(0), F.col("last")), F.sequence(F.lit(0), F.col("b") if half else F.col("last"))
    place = lambda query, row, col: F.struct(F.lit(query).alias("query"), row.alias("row"), col.alias("col"))
    both = F.concat(F.transform(columns, lambda c: place(True, F.col("b"), c)), F.transform(rows, lambda c: place(False, c, F.col("b"))))
    return _spread(placed.select("signal_id", "i", "v", F.explode(both).alias("c")).select("signal_id", "i", "v", "c.*"))


def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and frames of a cell's rows, and of its columns, both in order."""
    query, i = np.asarray(t.column("query")), np.asarray(t.column("i"))
    v = as_matrix(t.column("v").combine_chunks())
    a, b = np.flatnonzero(query), np.flatnonzero(~query)
    a, b = a[np.argsort(i[a], kind="stable")], b[np.argsort(i[b], kind="stable")]
    return i[a], v[a], i[b], v[b]


def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The distance of x[a[k]] and y[b[k]] for each k; equal rows are at distance 0."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 15):
        u, w = x[a[at : at + (1 << 15)]], y[b[at : at + (1 << 15)]]
        if metric == "cosine":
            out[at : at + len(u)] = 1 - (u * w).sum(axis=1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(w, axis=1), TINY)
        else:
            out[at : at + len(u)] = np.sqrt(((u - w) ** 2).sum(axis=1))
    return out


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances by a matrix product; where it would cancel, by differences."""
    if metric == "cosine":
        return 1 - (x @ y.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None], TINY)
    with np.errstate(invalid="ignore"):
        scale = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
        d = scale - 2 * (x @ y.T)
        close = np.nonzero(~(d >= 1e-3 * scale))  # those without a number too
        d = np.sqrt(np.maximum(d, 0))
        if len(close[0]):
            d[close] = exact(x, y, *close)
    return d


def _slices(rows: int, columns: int):
    step = max(1, _SLICE // max(columns, 1))
    return ((at, min(at + step, rows)) for at in range(0, rows, step))


def pairs(frames: DataFrame, metric: str = "euclidean", block: int = 256) -> DataFrame:
    """signal_id, i, j, d of all pairs of frames, each with itself too.

    A cell above the diagonal gives its transpose as well. It gives a row of distances at a time; Spark makes the rows of pairs from these.
    """
    ship(frames.sparkSession)
    kind = frames.select("signal_id").schema[0].dataType.simpleString()

    def lists(name: pa.Scalar, i: np.ndarray, first: int, d: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.arange(len(i) + 1, dtype=np.int32) * d.shape[1])
        return pa.RecordBatch.from_arrays([pa.repeat(name, len(i)), pa.array(i), pa.array(np.full(len(i), first)), pa.ListArray.from_arrays(at, pa.array(d.ravel()))], ["signal_id", "i", "first", "d"])

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        name, (i, x, j, y) = t.column("signal_id")[0], sides(t)
        for a, z in _slices(len(x), _TILE):
            for c in range(0, len(y), _TILE):
                d = distances(x[a:z], y[c : c + _TILE], metric)
                yield lists(name, i[a:z], j[c], d)
                if i[0] != j[0]:
                    yield lists(name, j[c : c + _TILE], i[a], d.T)

    rows = dealt(frames, block, _WIDE, half=True).applyInArrow(cell, f"signal_id {kind}, i long, first long, d array<double>")
    return rows.select("signal_id", "i", "first", F.posexplode("d").alias("at", "d")).select("signal_id", "i", (F.col("first") + F.col("at")).alias("j"), "d")


def recurrent(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs are of two frames and nearer than the threshold."""
    d = distances(x, y)
    edge = np.nonzero(np.abs(d - threshold) < 1e-6)
    if len(edge[0]):
        d[edge] = exact(x, y, *edge)
    return (d < threshold) & (i[:, None] != j[None])


def below(frames: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """signal_id, i, j of the pairs of two frames that are nearer than the threshold."""
    ship(frames.sparkSession)
    kind = frames.select("signal_id").schema[0].dataType.simpleString()

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, x, j, y = sides(t)
        for a, z in _slices(len(x), len(y)):
            r, c = np.nonzero(recurrent(i[a:z], x[a:z], j, y, threshold))
            yield pa.RecordBatch.from_arrays([pa.repeat(t.column("signal_id")[0], len(r)), pa.array(i[a:z][r]), pa.array(j[c])], ["signal_id", "i", "j"])

    return dealt(frames, block).applyInArrow(cell, f"signal_id {kind}, i long, j long")


# --- recurrence quantification


def _runs(on: np.ndarray, i0: int, j0: int):
    """(kind, line, start, length, times) of the runs of a cell's points: kind 0 along diagonals (line j - i), 1 down columns (line j). Runs at the
    cell's border, which may go on beyond it, one by one; the others by length, with no line and start."""
    h, w = on.shape
    one = np.zeros((2, w), np.int64)
    inner = [np.zeros(h + 2, np.int64), np.zeros(h + 2, np.int64)]
    found: list[list] = [[], [], [], []]
    column = np.arange(w)

    def open_(kind, end, c, n):  # runs of n points, the last in row `end` and columns c
        start = i0 + end - n + 1
        for to, part in zip(found, (np.full(len(c), kind), j0 + c - (i0 + end) if kind == 0 else j0 + c, start, n)):
            to.append(part)

    for r in range(h + 1):
        here = on[r] if r < h else np.zeros(w, bool)
        # diagonals: the point behind (r - 1, c) is (r, c + 1)
        goes_on = np.append(here[1:], False)
        for kind, stays in ((0, goes_on), (1, here)):
            c = np.flatnonzero((one[kind] > 0) & ~stays)
            if len(c):
                n = one[kind][c]
                edge = (n == r) | (r == h)
                if kind == 0:
                    edge |= (n == c + 1) | (c == w - 1)
                inner[kind] += np.bincount(n[~edge], minlength=h + 2)
                if edge.any():
                    open_(kind, r - 1, c[edge], n[edge])
        one[0] = np.where(here, np.append(0, one[0][:-1]) + 1, 0)
        one[1] = np.where(here, one[1] + 1, 0)
    kind, line, start, n = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)
    times = np.ones(len(n), np.int64)
    known = np.ones(len(n), bool)
    for k, counted in enumerate(inner):
        some = np.flatnonzero(counted)
        kind, n, times = np.append(kind, np.full(len(some), k)), np.append(n, some), np.append(times, counted[some])
        line, start, known = np.append(line, np.zeros(len(some), np.int64)), np.append(start, np.zeros(len(some), np.int64)), np.append(known, np.zeros(len(some), bool))
    return kind, pa.array(line, mask=~known), pa.array(start, mask=~known), n, times


def quantified(frames: DataFrame, threshold: float, least: int = 2, block: int = 256) -> DataFrame:
    """signal_id and the measures of `segment.rqa` of the pairs nearer than the threshold. Runs are found in cells; those at borders are joined."""
    ship(frames.sparkSession)
    kind_of = frames.select("signal_id").schema[0].dataType.simpleString()

    def cell(t: pa.Table) -> pa.Table:
        i, x, j, y = sides(t)
        on = np.empty((len(x), len(y)), bool)
        for a, z in _slices(len(x), len(y)):
            on[a:z] = recurrent(i[a:z], x[a:z], j, y, threshold)
        kind, line, start, n, times = _runs(on, int(i[0]), int(j[0]))
        return pa.table({"signal_id": pa.repeat(t.column("signal_id")[0], len(n)), "kind": pa.array(kind, pa.int64()), "line": line, "start": start, "n": pa.array(n), "times": pa.array(times)})

    runs = dealt(frames, block).applyInArrow(cell, f"signal_id {kind_of}, kind long, line long, start long, n long, times long").groupBy("signal_id", "kind", "line", "start", "n").agg(F.sum("times").alias("times"))
    order = Window.partitionBy("signal_id", "kind", "line").orderBy("start")
    parts = runs.where("line is not null").withColumn("new", F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("n")).over(order), F.lit(True)).cast("long"))
    whole = parts.withColumn("run", F.sum("new").over(order)).groupBy("signal_id", "kind", "line", "run").agg(F.sum("n").alias("n")).select("signal_id", "kind", "n", F.lit(1).cast("long").alias("times"))
    # a row for each length
    spread = whole.unionByName(runs.where("line is null").select("signal_id", "kind", "n", "times")).groupBy("signal_id", "kind", "n").agg(F.sum("times").alias("times"))
    long = F.col("n") >= least
    points = F.col("n") * F.col("times")
    of = lambda kind, c, f=F.sum: f(F.when((F.col("kind") == kind) & long, c))
    # minus the sum of q log2 q, with q = times / all
    sums = spread.groupBy("signal_id").agg(
        F.sum(F.when(F.col("kind") == 0, points)).alias("total"), of(0, points).alias("dl"), of(0, F.col("times")).alias("dn"), of(0, F.col("n"), F.max).alias("longest"),
        of(1, points).alias("vl"), of(1, F.col("times")).alias("vn"), of(0, F.col("times") * F.log2("times")).alias("tl"),
    )
    n = frames.groupBy("signal_id").agg((F.max("i") + 1).alias("frames"))
    share = lambda a, b: F.coalesce(F.col(a) / F.col(b), F.lit(0.0))
    return n.join(sums, "signal_id", "left").select(
        "signal_id", (F.coalesce("total", F.lit(0)) / F.greatest(F.col("frames") * (F.col("frames") - 1), F.lit(1))).alias("rate"), share("dl", "total").alias("determinism"), share("vl", "total").alias("laminarity"),
        share("dl", "dn").alias("mean_diagonal"), share("vl", "vn").alias("mean_vertical"), F.coalesce(F.col("longest").cast("double"), F.lit(0.0)).alias("longest"), F.coalesce(F.log2("dn") - F.col("tl") / F.col("dn"), F.lit(0.0)).alias("entropy"),
    )


# --- path enhancement


def enhanced(links: DataFrame, lengths_of: DataFrame, size: int = 5, n_filters: int = 7, block: int = 512) -> DataFrame:
    """signal_id, i, j, v: `segment.path_enhance` of the matrix that has ones at links (signal_id, i, j), for all cells of it. lengths_of: signal_id, n.

    A cell of block rows and _PARTS * block columns gets the links in it and in a margin around it. It gives runs of equal values along
    its rows, as few as the links ask for; Spark makes the rows from these.
    """
    ship(links.sparkSession)
    boxes = path_sizes(size, n_filters)
    reach = max(max(b) for b in boxes)  # no less than a rectangle sees
    wide = _PARTS * block
    kind = links.select("signal_id").schema[0].dataType.simpleString()
    last = lambda step: F.floor((F.col("n") - 1) / step)
    every = lambda step: F.explode(F.sequence(F.lit(0).cast("long"), last(step)))
    blank = lengths_of.withColumn("row", every(block)).withColumn("col", every(wide)).select("signal_id", "n", "row", "col", F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"))
    seen = lambda c, step: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - reach) / step), F.lit(0)), F.least(F.floor((F.col(c) + reach) / step), last(step))))
    near = links.join(lengths_of, "signal_id").withColumn("row", seen("i", block)).withColumn("col", seen("j", wide)).select("signal_id", "n", "row", "col", "i", "j")

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        n, row, col = (t.column(c)[0].as_py() for c in ("n", "row", "col"))
        links_of = t.filter(t.column("i").is_valid())
        i, j = np.divmod(np.unique(np.asarray(links_of.column("i")) * n + np.asarray(links_of.column("j"))), n)
        (a, z), (c, e) = ((k * step, min((k + 1) * step, n)) for k, step in ((row, block), (col, wide)))
        i, j = _mirrored(i, j, n, a - reach, z + reach)
        j, i = _mirrored(j, i, n, c - reach, e + reach)
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        found = []
        for at in range(c, e, block):
            end = min(at + block, e)
            f, g = np.searchsorted(j, (at - reach, end + reach))
            found.append(_runs_of(*_medians(i[f:g], j[f:g], boxes, (a, z), (at, end)), (a, z), (at, end)))
        y, first, to, count = (np.concatenate(k) for k in zip(*found))
        for f in range(0, len(y), _SLICE):
            s = slice(f, f + _SLICE)
            yield pa.RecordBatch.from_arrays([pa.repeat(t.column("signal_id")[0], len(y[s])), pa.array(y[s]), pa.array(first[s]), pa.array(to[s]), pa.array(count[s] / n_filters)], ["signal_id", "i", "first", "last", "v"])

    runs = _spread(blank.unionByName(near)).applyInArrow(cell, f"signal_id {kind}, i long, first long, last long, v double")
    return runs.select("signal_id", "i", F.explode(F.sequence("first", "last")).alias("j"), "v")


def _runs_of(y: np.ndarray, x: np.ndarray, count: np.ndarray, rows: tuple[int, int], columns: tuple[int, int]):
    """Row, first and last column and value of runs that fill rows and columns: the cells (y, x), in order, have a value, and the others 0."""
    (a, z), (c, e) = rows, columns
    w, size = e - c, (z - a) * (e - c)
    place = (y - a) * w + x - c
    # a run begins with a row, with a value and behind one
    first = np.unique(np.concatenate((np.arange(0, size, w), place, place[place + 1 < size] + 1)))
    v = np.zeros(len(first), np.int64)
    v[np.searchsorted(first, place)] = count
    return a + first // w, c + first % w, c + (np.append(first[1:], size) - 1) % w, v


def _mirrored(i: np.ndarray, j: np.ndarray, n: int, low: int, high: int):
    """The points (i, j) and their images as i is mirrored at 0 and n (the edges count twice), as far as these have an i from low to below high."""
    turns = 2 * n * np.arange(low // (2 * n), high // (2 * n) + 2)
    i = np.concatenate([i + t for t in turns] + [t - 1 - i for t in turns])
    j = np.tile(j, 2 * len(turns))
    here = (i >= low) & (i < high)
    return i[here], j[here]


def _medians(i: np.ndarray, j: np.ndarray, boxes: list[tuple[int, int]], rows: tuple[int, int], columns: tuple[int, int]):
    """Row, column and number of rectangles whose upper median is 1, of the cells where there are any. Points may lie around them, as far as a rectangle sees."""
    (a, z), (c, e) = rows, columns
    h, w = z - a, e - c
    count = np.zeros(0, np.int64)
    if len(i) * sum(b * d for b, d in boxes) < h * w:  # few: each point goes to the cells that see it
        votes = []
        for b, d in boxes:
            dy, dx = np.arange(b) - b // 2, np.arange(d) - d // 2
            y, x = np.broadcast_arrays((i[:, None] - dy)[:, :, None] - a, (j[:, None] - dx)[:, None, :] - c)
            inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            at, ones = np.unique((y * w + x)[inside], return_counts=True)
            votes.append(at[ones >= b * d - b * d // 2])  # the upper median is 1
        at, count = np.unique(np.concatenate(votes), return_counts=True)
    else:
        reach = max(max(b) for b in boxes)
        m = np.zeros((h + 2 * reach, w + 2 * reach), np.int64)
        m[i - a + reach, j - c + reach] = 1
        sums = np.pad(m.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        v = np.zeros((h, w), np.int64)
        for b, d in boxes:
            y, x = reach - b // 2, reach - d // 2
            of = lambda dy, dx: sums[y + dy : y + dy + h, x + dx : x + dx + w]  # noqa: B023, E731
            v += of(b, d) - of(0, d) - of(b, 0) + of(0, 0) >= b * d - b * d // 2
        at = np.flatnonzero(v)
        count = v.ravel()[at]
    return a + at // w, c + at % w, count


def _spread(placed: DataFrame):
    """Grouped by cell, in as many tasks as there are shuffle partitions: cells are small to read and long to work through."""
    return placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "signal_id", "row", "col").groupBy("signal_id", "row", "col")
