"""Approximate nearest neighbours by an adaptive dimension scan.

Unit vectors are turned by one random rotation and dealt to the lists of their nearest
centroids, which are fitted on a bounded sample. A query probes its nearest lists.
Within a list candidates are scanned in blocks of columns: after each block a
hypothesis test on the partial distance, which after a random rotation estimates the
whole, abandons candidates that are very unlikely to come under the k-th best distance
so far. Candidates that remain are scored exactly on the original vectors.

Lists are bundled, and long ones split, so that a task holds about `block` candidates
and `query_block` queries however frequent some vectors are. A query is sent once to
each bundle with a list that it probes, and goes through those lists from the nearest
on, with the best distances met so far.

Edge cases: vectors that are null, zero, or that hold null or non-finite components take
no part, nor do rows without a vec_id; vectors of different lengths have no cosine, so
each length is searched by itself; rows that share the query's vec_id are its own; a
vec_id with several vectors gives several candidates or queries; equal rows count once;
ties go to the smaller vec_id; a query probes on until it has met k candidates, or all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared_store import staged
from .text import hash_share


@dataclass(frozen=True)
class AnnParams:
    k: int = 5
    every: int = 50  # rows whose id is divisible by this are the queries
    sample: int = 16_384  # vectors that the centroids are fitted on, at most about; a list has at least 4 of them
    probed: float = 0.6  # share of the lists that a query probes
    columns: int = 16
    epsilon: float = 2.1
    block: int = 8192
    query_block: int = 2048
    seed: int = 5


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision; equal rows give equal values.

    Each vector is first scaled by the power of two that brings its largest component
    near 1, which changes no digit and keeps squares from overflow and underflow.
    """
    x, q = _scaled(x), _scaled(q[None, :])[0]
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def scan(q: np.ndarray, x: np.ndarray, k: int, columns: int, epsilon: float, radius: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x (rotated unit vectors) that may be among the k nearest to q, and their squared distances. Abandons the others early; radius: the k-th least squared distance so far."""
    n, dim = x.shape
    if n > k:
        first = min(n, max(4 * k, 256)) if radius == np.inf else min(n, 4 * k)
        radius = min(radius, np.partition(((x[:first] - q) ** 2).sum(axis=1), k - 1)[k - 1])
    alive, partial = np.arange(n), np.zeros(n)
    for at in range(0, dim, columns):
        to = min(at + columns, dim)
        part = x[alive, at:to] if at else x[:, at:to]
        partial = partial + ((part - q[at:to]) ** 2).sum(axis=1)
        slack = 1.0 if to == dim else (1 + epsilon / np.sqrt(to)) ** 2
        keep = partial * (dim / to) <= radius * slack + 1e-9
        alive, partial = alive[keep], partial[keep]
    if len(alive) > k:
        near = partial <= np.partition(partial, k - 1)[k - 1] + 1e-9
        alive, partial = alive[near], partial[near]
    return alive, partial


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bundles(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bundle of each list, and in how many bundles it lies: lists in a row with at most `block` vectors together share one, longer lists have several."""
    first, parts, now, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i, n in enumerate(counts):
        if filled and filled + n > block:
            now, filled = now + 1, 0
        first[i] = now
        if n > block:
            parts[i] = -(-n // block)
            now, filled = now + int(parts[i]), 0
        else:
            filled += n
    return first, parts


def search(vectors: DataFrame, p: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest vectors found."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.where(finite)
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in v.groupBy(F.size("e").alias("dim")).count().orderBy("dim").collect():  # a row for each length of vectors
        out = out.unionByName(_search(v.where(F.size("e") == r["dim"]), r["dim"], r["count"], p))
    ranked = out.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(v: DataFrame, dim: int, n: int, p: AnnParams) -> DataFrame:
    """query_id, vec_id, score of the nearest in each bundle; all vectors have the same length."""
    turn = rotation(dim, p.seed)
    picked = v.where(hash_share(F.col("vec_id"), n, p.sample)).groupBy("vec_id").agg(F.min("e").alias("e")).toArrow().sort_by("vec_id")
    sample = _unit(np.array(picked.column("e").to_pylist(), np.float64).reshape(-1, dim)) @ turn
    if not len(sample):  # every vec_id has a larger hash, as when few ids have most rows
        sample = _unit(np.array([r["e"] for r in v.select("e").orderBy("e").limit(p.k).collect()], np.float64)) @ turn
    lists = int(np.clip(round(np.sqrt(n)), 1, max(1, len(sample) // 4)))
    model = v.sparkSession.sparkContext.broadcast((turn, kmeans(sample, lists, p.seed)))

    def deal(it):
        turn, centroids = model.value
        for whole in it:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = np.asarray(b.column("e").flatten()).reshape(-1, dim)
                near = (_unit(x) @ turn @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "list", "v"])

    dealt = staged(v.mapInArrow(deal, "vec_id long, list int, v binary"))
    counts = np.zeros(lists, np.int64)
    for r in dealt.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    first, parts = bundles(counts, p.block)
    probes = max(1, int(np.ceil(lists * p.probed)))
    splits = max(1, -(-n // (p.every * p.query_block)))  # parts of the queries

    def wanted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists from the nearest on, and how many of them each unit vector probes."""
        order = np.argsort(-(x @ model.value[1].T), axis=1, kind="stable")
        met = np.cumsum(counts[order], axis=1)
        return order, np.minimum(np.maximum((met < p.k + 1).sum(axis=1) + 1, probes), lists)

    def probe(it):
        for whole in it:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                order, many = wanted(_unit(_matrix(b.column("v"), dim)) @ model.value[0])
                rows, places = [], []
                for i in range(b.num_rows):
                    probed = order[i, : many[i]]
                    probed = probed[counts[probed] > 0]
                    mine = np.unique(np.repeat(first[probed], parts[probed]) + np.concatenate([np.arange(k) for k in parts[probed]]))
                    rows.append(np.full(len(mine), i))
                    places.append(mine)
                take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                bundle = pa.array(np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([bundle, b.column("vec_id").take(take), b.column("v").take(take)], ["bundle", "query_id", "q"])

    queries = dealt.where(F.col("vec_id") % p.every == 0).select("vec_id", "v")
    sent = queries.mapInArrow(probe, "bundle int, query_id long, q binary").withColumn("part", F.pmod(F.xxhash64("query_id", "q"), F.lit(splits)).cast("int"))
    known = v.sparkSession.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(lists)], "list int, first int, parts int")
    place = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")
    held = dealt.join(F.broadcast(known), "list").select(place.alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), "list", "vec_id", "v")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            turn = model.value[0]
            right = right.sort_by([("list", "ascending"), ("vec_id", "ascending")])
            raw_q, raw_x = _matrix(left.column("q"), dim), _matrix(right.column("v"), dim)
            ids, lists_of = np.asarray(right.column("vec_id")), np.asarray(right.column("list"))
            q, x = _unit(raw_q) @ turn, _unit(raw_x) @ turn
            here, begin = np.unique(lists_of, return_index=True)
            end = np.append(begin[1:], len(ids))
            slot = np.full(len(counts), -1)
            slot[here] = np.arange(len(here))
            order, many = wanted(q)
            for i, own in enumerate(left.column("query_id").to_pylist()):
                rows, far = np.zeros(0, np.int64), np.zeros(0)
                for s in slot[order[i, : many[i]]]:
                    if s < 0:
                        continue
                    pool = np.arange(begin[s], end[s])
                    if (ids[pool] == own).any():
                        pool = pool[ids[pool] != own]
                    part = x[pool] if len(pool) < end[s] - begin[s] else x[begin[s] : end[s]]
                    radius = np.partition(far, p.k - 1)[p.k - 1] if len(far) >= p.k else np.inf
                    near, d = scan(q[i], part, p.k, p.columns, p.epsilon, radius)
                    rows, far = np.concatenate((rows, pool[near])), np.concatenate((far, d))
                if len(rows) > p.k:
                    rows = rows[far <= np.partition(far, p.k - 1)[p.k - 1] + 1e-9]
                score = cosine(raw_q[i], raw_x[rows]) if len(rows) else far
                for j in np.lexsort((ids[rows], -score))[: p.k]:
                    for c, value in zip(out, (own, int(ids[rows[j]]), float(score[j]))):
                        c.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return sent.groupBy("bundle", "part").cogroup(held.groupBy("bundle", "part")).applyInArrow(nearest, "query_id long, vec_id long, score double")
