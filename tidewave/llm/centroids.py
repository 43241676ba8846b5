"""Centroid clustering by Lloyd's rounds with Hamerly's bounds, in exact integers.

A vector of `dimension` components becomes integers floor(scale * x). Beside it one
upper bound of the distance to its centroid and one lower bound of the distance to
every other are kept, in a table that each round writes anew. When centroids have
moved, both are loosened by how far they moved. Where the upper bound stays below the
lower one, or below half the way to the next centroid, the nearest centroid can't have
changed; else the bound is tightened by the exact distance, and where that doesn't
decide, all centroids are scanned with exact integers, ties to the smaller number.

A round is one pass over the vectors without a shuffle, and one aggregation to a row
for each centroid; only these rows (at most `k`) reach the driver. Centroids are sent
back as a broadcast of k * dimension integers.

Edge cases: a null vector, one of another length or with a null, NaN or infinite
component takes no part; so does one with a component of 2^27 or more after scaling,
whose squared distance might not fit a long. A null vec_id is clustered but is no
starting centroid. Rows that repeat are vectors of their own; where equal ids compete for a start, the lesser components come
first. With fewer vectors than `k` there are fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_store import drop, staged

_LARGEST = 1 << 27
_EXACT = 1 << 21  # 64 * (2^22)^2 and its parts are exact in double precision
_STATE = "vec_id long, x array<int>, cluster int, up double, low double, scanned boolean, distance long"


@dataclass(frozen=True)
class ClusterParams:
    k: int = 40
    rounds: int = 5
    dimension: int = 64
    scale: int = 256
    seed: str = "2:"


def prepared(vectors: DataFrame, p: ClusterParams) -> DataFrame:
    """vec_id and x (integers) of the vectors that take part."""
    whole = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double") * p.scale) < _LARGEST, F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * p.scale).cast("int"))
    return vectors.where((F.size("embedding") == p.dimension) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def starts(kept: DataFrame, p: ClusterParams) -> np.ndarray:
    """The first centroids: the vectors of least hash."""
    h = F.sha2(F.concat(F.lit(p.seed), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").select(h.alias("h"), "x").orderBy("h", "x").limit(p.k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), p.dimension)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by centres), as integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0))
    if largest < _EXACT and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def halves(centres: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other."""
    if len(centres) < 2:
        return np.full(len(centres), np.inf)
    d = np.sqrt(squared(centres, centres).astype(np.float64))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1) / 2


def assign(x: np.ndarray, cluster: np.ndarray, up: np.ndarray, low: np.ndarray, centres: np.ndarray, drift: np.ndarray | None):
    """cluster, up, low after centroids moved by `drift`, and which vectors were scanned. Without a drift all are."""
    n = len(x)
    scan = np.ones(n, bool)
    if drift is not None and n:
        most = int(drift.argmax())
        others = np.delete(drift, most).max(initial=0.0)
        up = up + drift[cluster]
        low = low - np.where(cluster == most, others, drift[most])
        bound = np.maximum(halves(centres)[cluster], low)
        slack = lambda u: u * (1 + 1e-9) + 1e-9 < bound  # noqa: E731  # bounds are rounded
        unsure = np.flatnonzero(~slack(up))
        up[unsure] = np.sqrt(((x[unsure] - centres[cluster[unsure]]) ** 2).sum(axis=1).astype(np.float64))
        scan = ~slack(up)
    at = np.flatnonzero(scan)
    if len(at):
        d = squared(x[at], centres)
        best = d.argmin(axis=1)
        cluster = cluster.copy()
        cluster[at] = best
        rows = np.arange(len(at))
        up[at] = np.sqrt(d[rows, best].astype(np.float64))
        if len(centres) > 1:
            d[rows, best] = np.iinfo(np.int64).max
            low[at] = np.sqrt(d.min(axis=1).astype(np.float64))
        else:
            low[at] = np.inf
    return cluster, up, low, scan


def _pass(state: DataFrame, centres: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast((centres, drift))

    def run(it):
        centres, drift = sent.value
        for whole in it:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                x = np.asarray(b.column("x").flatten()).astype(np.int64).reshape(b.num_rows, centres.shape[1])
                if drift is None:
                    cluster, up, low = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows)
                else:
                    cluster, up, low = (np.array(b.column(c)) for c in ("cluster", "up", "low"))
                cluster, up, low, scanned = assign(x, cluster, up, low, centres, drift)
                d = ((x - centres[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(up), pa.array(low), pa.array(scanned), pa.array(d, pa.int64())], [c.split()[0] for c in _STATE.split(", ")])

    return staged(state.mapInArrow(run, _STATE))


def _moved(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The floors of the means of the clusters; an empty cluster's centroid stays."""
    out = centres.copy()
    for r in state.groupBy("cluster").agg(F.count("*"), *[F.sum(F.col("x")[i].cast("long")) for i in range(centres.shape[1])]).collect():
        out[r[0]] = [s // r[1] for s in r[2:]]
    return out


def assignments(vectors: DataFrame, p: ClusterParams = ClusterParams()) -> tuple[DataFrame, np.ndarray]:
    """The last round's table (vec_id, x, cluster, up, low, scanned, distance), in the shared folder, and the final centroids."""
    kept = prepared(vectors, p)
    centres = starts(kept, p)
    if not len(centres):
        return kept.where("false").selectExpr("vec_id", "x", "0 AS cluster", "0D AS up", "0D AS low", "true AS scanned", "0L AS distance"), centres
    state = _pass(kept, centres, None)
    for _ in range(p.rounds):
        moved = _moved(state, centres)
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1).astype(np.float64))
        before, state = state, _pass(state, moved, drift)
        drop(before)
        centres = moved
    return state, centres


def clusters(vectors: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. An inertia that doesn't fit a long is null."""
    state, centres = assignments(vectors, p)
    spark = vectors.sparkSession
    # a row for each centroid
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(p: ClusterParams = ClusterParams()) -> str:
    """The same in DuckDB's SQL, every round a full scan."""
    near = lambda c: f"SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, CAST(list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept CROSS JOIN {c}) GROUP BY rid"
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda z: CAST(floor({p.scale} * CAST(z AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {p.dimension} AND len(list_filter(embedding, lambda z: coalesce(abs({p.scale} * CAST(z AS DOUBLE)) < {_LARGEST}, false))) = {p.dimension})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('{p.seed}' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {p.k}))", f"a0 AS MATERIALIZED ({near('c0')})"]
    for k in range(p.rounds):
        parts += [
            f"s{k} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({p.dimension})) AS i FROM a{k} JOIN kept USING (rid)) GROUP BY 1, 2)",
            f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(n.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c) n USING (c))",
            f"a{k + 1} AS MATERIALIZED ({near(f'c{k + 1}')})",
        ]
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{p.rounds} a JOIN kept USING (rid) JOIN c{p.rounds} z ON z.c = a.c"
