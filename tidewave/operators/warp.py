"""Dynamic time warping over tiles, for sequences whose cost matrix fits no task.

The cost matrix is cut into tiles. Those of one anti-diagonal depend only on the two before, so
each is a pass over all of them at once, in which a tile gets the last row of the
tile above, the last column of the one to the left and the corner between. Only these borders are kept; the
frames of a tile are its two blocks. Tiles grow with the longest sequence, to at most _PARTS a side until they have
_MOST frames a side, as each anti-diagonal reads all blocks. Tiles outside the band are never made. The path is found
backwards: a pass makes the tiles anew in which paths stand, and follows each to where it leaves its tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..store import drop, staged
from .cells import distances, exact

_PARTS, _MOST = 16, 2048


def _blocks(frames: DataFrame, size: int, number: str) -> DataFrame:
    """signal_id, a block's number, its frames one after another as x, their number n."""
    each = frames.groupBy("signal_id", F.floor(F.col("i") / size).alias(number)).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("f"))
    return each.select("signal_id", number, F.flatten(F.transform("f", lambda f: f["v"])).alias(f"x_{number}"), F.size("f").alias(f"n_{number}"))


def tile(cost: np.ndarray, above: np.ndarray | None, left: np.ndarray | None, corner: float, side: float, inside: np.ndarray) -> np.ndarray:
    """Cumulative costs of a tile, in rows and columns from 1 on, with the row above it and the column to its left (infinite where there is none); `inside`: the cells in the band; side: weight of steps along one sequence only."""
    h, w = cost.shape
    d = np.full((h + 1, w + 1), np.inf)
    d[0, 0] = corner
    if above is not None:
        d[0, 1:] = above
    if left is not None:
        d[1:, 0] = left
    flat, cost, inside = d.reshape(-1), np.ascontiguousarray(cost).reshape(-1), np.ascontiguousarray(inside).reshape(-1)
    for k in range(h + w - 1):
        # from one cell of an anti-diagonal to the next: a row down, a column back
        i, z = max(0, k - w + 1), min(h, k + 1)
        c = cost[i * w + k - i : (z - 1) * w + k - z + 2 : max(w - 1, 1)]
        at = slice((i + 1) * (w + 1) + k - i + 1, z * (w + 1) + k - z + 3, w)
        corner_, over, back = (flat[at.start - o : at.stop - o : w] for o in (w + 2, w + 1, 1))
        best = np.minimum(np.minimum(corner_ + c, over + side * c), back + side * c)
        flat[at] = np.where(inside[i * w + k - i : (z - 1) * w + k - z + 2 : max(w - 1, 1)], best, np.inf)
    return d


class Warp:
    """The alignment of two tables of frames (signal_id, i, v) signal by signal; i from 0 without gaps.

    size: the least frames of a tile's side. A signal that one of them lacks has none. Costs are distances of `metric`; `band`: the cells at most so many of the longer side off the diagonal.
    """

    def __init__(self, first: DataFrame, second: DataFrame, size: int = 1024, band: int | None = None, side: float = 1.0, metric: str = "euclidean"):
        self.band, self.side, self.metric = band, float(side), metric
        spark = ship(first.sparkSession)
        self.kind = first.select("signal_id").schema[0].dataType.simpleString()
        lengths = first.groupBy("signal_id").agg((F.max("i") + 1).alias("n")).join(second.groupBy("signal_id").agg((F.max("i") + 1).alias("m")), "signal_id")
        longest = lengths.agg(F.max(F.greatest("n", "m"))).first()[0] or 0
        self.size = size = max(size, min(-(-longest // _PARTS), _MOST))
        self.a = staged(_blocks(first, size, "p").join(lengths, "signal_id"))
        self.b = staged(_blocks(second, size, "q").join(lengths, "signal_id"))
        top = self.a.agg(F.max("p"), F.max("n")).first(), self.b.agg(F.max("q")).first()
        self.last = (top[0][0] or 0) + (top[1][0] or 0) if top[0][0] is not None and top[1][0] is not None else -1
        self.rounds: list[DataFrame] = []
        schema = f"signal_id {self.kind}, p long, q long, n long, m long, row array<double>, col array<double>, corner double, cost double"
        nothing = spark.createDataFrame([], schema)
        for r in range(self.last + 1):
            self.rounds.append(staged(self._tiles(r, *(self.rounds[-k] if len(self.rounds) >= k else nothing for k in (1, 2))).mapInArrow(self._forward, schema)))

    def _tiles(self, r: int, one: DataFrame, two: DataFrame) -> DataFrame:
        """The tiles of anti-diagonal r with frames and borders; one, two: the anti-diagonals before."""
        # each side leaves out blocks without a tile in this anti-diagonal, or in the band of it, before the frames are joined
        a, b = self.a.withColumn("q", F.lit(r) - F.col("p")), self.b.withColumn("p", F.lit(r) - F.col("q"))
        a, b = self._near(a.where("q >= 0"), n_q=self.size), self._near(b.where("p >= 0"), n_p=self.size)
        tiles = self._near(a.join(b.drop("p", "n", "m"), ["signal_id", "q"]))
        above = one.select("signal_id", (F.col("p") + 1).alias("p"), "q", F.col("row").alias("above"))
        left = one.select("signal_id", "p", (F.col("q") + 1).alias("q"), F.col("col").alias("left"))
        corner = two.select("signal_id", (F.col("p") + 1).alias("p"), (F.col("q") + 1).alias("q"), "corner")
        for border in (above, left, corner):
            tiles = tiles.join(border, ["signal_id", "p", "q"], "left")
        return tiles.select("signal_id", "p", "q", "n", "m", "x_p", "n_p", "x_q", "n_q", "above", "left", "corner")

    def _near(self, tiles: DataFrame, n_p: int | None = None, n_q: int | None = None) -> DataFrame:
        """The tiles that touch the band. n_p, n_q: bounds of the sides, where they aren't columns."""
        if self.band is None:
            return tiles
        end = lambda c, n: F.col(c) * self.size + (F.col(f"n_{c}") if n is None else F.lit(n)) - 1
        # the cell of a tile nearest to the diagonal, as shares of the sides
        gap = F.greatest(F.col("p") * self.size / F.col("n") - end("q", n_q) / F.col("m"), F.col("q") * self.size / F.col("m") - end("p", n_p) / F.col("n"))
        return tiles.where(gap <= self.band / F.greatest("n", "m") + 1e-9)

    def _made(self, b: pa.RecordBatch, k: int) -> np.ndarray:
        read = lambda c: None if not b.column(c)[k].is_valid else np.asarray(b.column(c)[k].values, float)
        p, q, n, m = (b.column(c)[k].as_py() for c in "pqnm")
        x, y = read("x_p").reshape(b.column("n_p")[k].as_py(), -1), read("x_q").reshape(b.column("n_q")[k].as_py(), -1)
        corner = b.column("corner")[k].as_py()
        if p == q == 0:
            corner = 0.0
        inside = np.ones((len(x), len(y)), bool)
        if self.band is not None:
            i, j = p * self.size + np.arange(len(x)), q * self.size + np.arange(len(y))
            inside = np.abs(i[:, None] / n - j[None] / m) <= self.band / max(n, m)
            cost = np.full(inside.shape, np.inf)
            cost[inside] = exact(x, y, *np.nonzero(inside), self.metric)
        else:
            cost = distances(x, y, self.metric)
        return tile(cost, read("above"), read("left"), np.inf if corner is None else corner, self.side, inside)

    def _forward(self, it):
        for b in it:
            for k in range(b.num_rows):
                d = self._made(b, k)
                numbers = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(c).slice(k, 1) for c in ("signal_id", "p", "q", "n", "m")] + [pa.array([d[-1, 1:]], numbers), pa.array([d[1:, -1]], numbers), pa.array([d[-1, -1]]), pa.array([d[-1, -1]])], ["signal_id", "p", "q", "n", "m", "row", "col", "corner", "cost"])

    def __getstate__(self):  # tasks need the sizes only
        return {k: self.__dict__[k] for k in ("size", "band", "side", "metric")}

    def _at_end(self) -> DataFrame:
        """The last tile of each signal."""
        found = [t.where((F.floor((F.col("n") - 1) / self.size) == F.col("p")) & (F.floor((F.col("m") - 1) / self.size) == F.col("q"))) for t in self.rounds]
        out = found[0]
        for t in found[1:]:
            out = out.unionByName(t)
        return out

    def cost(self) -> DataFrame:
        """signal_id, cost of the cheapest path; infinite if the band leaves none."""
        return self._at_end().select("signal_id", "cost")

    def path(self) -> DataFrame:
        """signal_id, i, j of the cheapest path's cells; of equal ways back the diagonal one counts, then the one along the first table."""
        now = staged(self._at_end().where("cost < double('inf')").select("signal_id", (F.col("n") - 1).alias("i"), (F.col("m") - 1).alias("j")))
        schema = f"signal_id {self.kind}, i array<long>, j array<long>, next_i long, next_j long"
        pieces = []
        for r in range(self.last, -1, -1):
            here = now.withColumn("p", F.floor(F.col("i") / self.size)).withColumn("q", F.floor(F.col("j") / self.size))
            before = [self.rounds[r - k] if r >= k else self.rounds[0].where("false") for k in (1, 2)]
            tiles = self._tiles(r, *before).join(here.where(F.col("p") + F.col("q") == r), ["signal_id", "p", "q"])
            piece = staged(tiles.mapInArrow(self._back, schema))
            pieces.append(piece)
            moved = piece.where("next_i >= 0").select("signal_id", F.col("next_i").alias("i"), F.col("next_j").alias("j"))
            # those of tiles that come later
            onward = staged(moved.unionByName(here.where(F.col("p") + F.col("q") != r).select("signal_id", "i", "j")))
            drop(now)
            now = onward
        cells = pieces[0]
        for piece in pieces[1:]:
            cells = cells.unionByName(piece)
        return cells.select("signal_id", F.explode(F.arrays_zip("i", "j")).alias("c")).select("signal_id", "c.i", "c.j")

    def _back(self, it):
        for b in it:
            for k in range(b.num_rows):
                d = self._made(b, k)
                p, q = b.column("p")[k].as_py() * self.size, b.column("q")[k].as_py() * self.size
                i, j = b.column("i")[k].as_py() - p, b.column("j")[k].as_py() - q
                cells = ([], [])
                while i >= 0 and j >= 0:
                    cells[0].append(p + i)
                    cells[1].append(q + j)
                    if p + i == q + j == 0:
                        i = j = -1 - max(p, q)
                        break
                    step = int(np.argmin([d[i, j], d[i, j + 1], d[i + 1, j]]))
                    i, j = i - (step != 2), j - (step != 1)
                ended = cells[0][-1] == cells[1][-1] == 0
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("signal_id").slice(k, 1), pa.array([cells[0]], longs), pa.array([cells[1]], longs), pa.array([-1 if ended else p + i], pa.int64()), pa.array([-1 if ended else q + j], pa.int64())], ["signal_id", "i", "j", "next_i", "next_j"])
