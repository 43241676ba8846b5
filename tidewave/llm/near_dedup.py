"""MinHash near-dedup with sequential Bayesian verification.

1. Each document's set of distinct word shingles is hashed to 64 bits; its digest,
   size and MinHash signature are written once. Equal sets form a class, and only a
   class's least doc_id goes on.
2. Signatures are cut into bands. In each bucket of equal bands every member is paired
   with the bucket's least member: as many pairs as members, however large the bucket.
3. Pairs are pruned in sequence: after each batch of signature values a pair goes if
   the posterior probability that its similarity reaches the threshold is below
   `miss`. Survivors are verified exactly on their full sets.
4. Links are joined into components. Buckets that then still hold more than one
   component are tied to families, which are cut into blocks; each pair of blocks is a
   group in which members of different components are compared as in 3, signatures
   first and sets then, and only links leave it. So no pair that shares a bucket is left
   out but those already in one component. Components are joined again.

A pair of similarity s shares no bucket with probability (1 - s^rows)^bands, which is
6e-7 at 0.8 here and falls fast above.

A bucket with more members than a share of all of them is hot: there are few such
buckets, so they are sent to their members, which stay where they are.

Edge cases: a null or empty text has an empty set and links with nothing; a text of
fewer words than a shingle has one shingle, all its words; rows of equal doc_id are one
node, linked by the texts of each, and share a component; a row without doc_id links with
nothing and is kept, with a null component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared_store import drop, staged
from .skew import crowded, join_hot
from .text import NOT_SPACE, batches, free_name, mix64, word_hashes


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    percent: int = 80  # least Jaccard similarity, in hundredths
    bands: int = 36
    rows: int = 5
    batch: int = 30  # signature values compared at a time
    block: int = 256  # members of a family that meet as many others in a group
    miss: float = 1e-6
    broadcast_ids: int = 2_000_000  # 8 bytes each
    hot: int = 10_000  # members of a hot bucket, at least; and at least all members of all buckets divided by this
    crowd: int = 20_000  # pairs with one leader, beyond which its signature and set are sent to them


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and their offsets."""
    words, at = word_hashes(texts, NOT_SPACE)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C55) + words[k : k + n]
    inside = doc[:n] == doc[width - 1 :]
    hashes, owner = mix64(rolled[inside]), doc[:n][inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            whole[has] = whole[has] * np.uint64(0x9E3779B97F4A7C55) + words[at[:-1][short[has]] + k]
        hashes, owner = np.concatenate((hashes, mix64(whole + count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))), np.concatenate((owner, short))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(count) + 1)).astype(np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """16 bits of the least of each of `size` hash functions over each set; 0 for empty sets."""
    rng = np.random.default_rng(2024)
    factors = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32) | np.uint32(1)
    masks = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)
    out = np.zeros((len(offsets) - 1, size), np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    for k in range(size):
        h = (low ^ masks[k]) * factors[k]
        h ^= high
        least = np.minimum.reduceat(h, offsets[full])
        least = least * np.uint32(0x85EBCA6B)
        out[full, k] = ((least ^ (least >> np.uint32(15))) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def least_matches(p: NearParams) -> list[tuple[int, int]]:
    """(values compared, least matches to go on), batch by batch.

    With a uniform prior the similarity's posterior after m matches of n is
    Beta(m + 1, n - m + 1), whose upper tail at t is P(Bin(n + 1, t) <= m).
    """
    t, size, out = p.percent / 100, p.bands * p.rows, []
    for n in range(p.batch, size + 1, p.batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= p.miss:
                out.append((n, m))
                break
    return out


def _described(docs: DataFrame, p: NearParams) -> DataFrame:
    """doc_id, n, d1, d2 (the set's digest) and sig of every row."""

    def run(it):
        for b in batches(it, 2 << 20):
            sets, at = shingle_sets(b.column("text"), p.shingle)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets))))
            other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)))))
            n = np.diff(at)
            sig = signatures(sets, at, p.bands * p.rows)
            columns = [b.column("doc_id"), pa.array(n), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)), pa.array([row.tobytes() for row in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary")


def _banded(nodes: DataFrame, p: NearParams) -> DataFrame:
    """key, id for each band of each node."""

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, p.bands, p.rows).astype(np.uint64)
                h = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), sig.shape[:2]).copy()
                for k in range(p.rows):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C55) + sig[:, :, k])
                ids = np.repeat(np.asarray(b.column("id")), p.bands)
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return nodes.select("id", "sig").mapInArrow(run, "key long, id long")


def _pruned(pairs: DataFrame, nodes: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) whose similarity may reach the threshold, by their signatures."""
    steps = least_matches(p)

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                alive, matches, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
                for n, least in steps:
                    matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                    keep = matches >= least
                    alive, matches, done = alive[keep], matches[keep], n
                yield b.select(["a", "b"]).take(pa.array(alive))

    # the leader of a large bucket is in all its pairs
    first = join_hot(pairs, nodes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), ["a"], crowded(pairs, ["a"], p.crowd))
    both = first.join(nodes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """id, set (the sorted shingle hashes) of the documents in ids."""

    def to_sets(it):
        for b in batches(it, 4 << 20):
            sets, at = shingle_sets(b.column("text"), p.shingle)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([sets[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["id", "set"])

    # a few ids are sent to the texts; more of them than the bound meet the texts in a shuffle
    wanted = staged(ids)
    wanted = F.broadcast(wanted) if wanted.count() <= p.broadcast_ids else wanted
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return source.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(to_sets, "id long, set binary")


def _verified(pairs: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) that are similar by their full sets."""

    def compare(it):
        for b in it:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                inter = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * inter >= p.percent * (len(u) + len(v) - inter))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = staged(_sets(ids, docs, p))
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = join_hot(first, sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), ["a"], crowded(pairs, ["a"], p.crowd), "set_a")
    out = staged(both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long").distinct())
    drop(sets)
    return out


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    survivors = staged(_pruned(pairs, nodes, p).distinct())
    out = _verified(survivors, docs, p)
    drop(survivors)
    return out


def _family_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """Links (a, b) between different components of a family. members: family, id, component.

    A family's largest component is only compared with the family's other members,
    so it is dealt out once for each block of those.
    """
    steps = least_matches(p)
    parts = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    facts = parts.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("m")).select("family", F.col("m.component").alias("major"), F.col("m.n").alias("n_major"), (F.col("all") - F.col("m.n")).alias("n_minor"))
    blocks = lambda n: F.greatest(F.ceil(n / p.block), F.lit(1)).cast("int")
    known = members.join(facts, "family").select("family", "id", "component", (F.col("component") == F.col("major")).alias("major"), blocks(F.col("n_major")).alias("jb"), blocks(F.col("n_minor")).alias("mb"))
    known = known.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("major"), F.col("jb")).otherwise(F.col("mb"))).cast("int"))
    all_minor, all_major = F.sequence(F.lit(0), F.col("mb") - 1), F.sequence(F.lit(0), F.col("jb") - 1)
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    met = F.when(F.col("major"), F.transform(all_minor, lambda k: place(k, F.col("block")))).otherwise(
        F.concat(F.transform(all_major, lambda h: place(F.col("block"), h)), F.transform(all_minor, lambda k: place(F.least(k, F.col("block")), F.col("jb") + F.greatest(k, F.col("block")))))
    )
    sets = _sets(known.select("id").distinct(), docs, p)
    full = known.join(nodes.select("id", "sig"), "id").join(sets, "id")
    dealt = full.select("family", "id", "component", "major", "jb", "block", "sig", "set", F.inline(met))

    def compare(t: pa.Table) -> pa.Table:
        ids, comp = np.asarray(t.column("id")), t.column("component").to_pylist()
        major, block = np.asarray(t.column("major")), np.asarray(t.column("block"))
        x, y, jb = t.column("x")[0].as_py(), t.column("y")[0].as_py(), t.column("jb")[0].as_py()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        sets = [np.frombuffer(v, np.uint64) for v in t.column("set").to_pylist()]
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        left = np.flatnonzero(~major & (block == x))
        right = np.flatnonzero(major) if y < jb else np.flatnonzero(~major & (block == y - jb))
        out = [], []
        for i in left:
            mine = root(comp[i])
            near = np.array([j for j in right if (y < jb or x != y - jb or j > i) and root(comp[j]) != mine], np.int64)
            done, matches = 0, np.zeros(len(near), np.int64)
            for n, least in steps:
                if not len(near):
                    break
                matches = matches + (sig[near, done:n] == sig[i, done:n]).sum(axis=1)
                keep = matches >= least
                near, matches, done = near[keep], matches[keep], n
            for j in near:
                if root(comp[j]) == root(comp[i]):
                    continue
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter >= p.percent * (len(sets[i]) + len(sets[j]) - inter):
                    parent[root(comp[j])] = root(comp[i])
                    out[0].append(int(ids[i]))
                    out[1].append(int(ids[j]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return staged(dealt.groupBy("family", "x", "y").applyInArrow(compare, "a long, b long"))


def _buckets(nodes: DataFrame, p: NearParams) -> tuple[DataFrame, int]:
    """key, leader, id, n of the members of all buckets with several, and how many members make a bucket hot."""
    banded = _banded(nodes, p)
    shared = staged(banded.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    hot = max(p.hot, (shared.agg(F.sum("n")).first()[0] or 0) // p.hot)
    few = F.broadcast(shared.where(F.col("n") > hot))  # at most p.hot rows
    columns = ["key", "leader", "id", "n"]
    here = banded.join(few, "key").select(columns)
    moved = banded.join(few, "key", "left_anti").join(shared.where(F.col("n") <= hot), "key").select(columns)
    buckets = staged(here.unionByName(moved))
    drop(shared)
    return buckets, hot


def _several(known: DataFrame, hot: int) -> DataFrame:
    """Of buckets (key, leader, id, component, n), the members of those with several components."""
    parts = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("n").alias("n")).where("lo <> hi")
    here = known.where(F.col("n") > hot).join(F.broadcast(parts.where(F.col("n") > hot).select("key")), "key", "left_semi")
    moved = known.where(F.col("n") <= hot).join(parts.where(F.col("n") <= hot).select("key"), "key", "left_semi")
    return here.unionByName(moved).select("leader", "id", "component").distinct()


def _repeated(linkable: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: each doc_id with several texts, and the node of each text's class."""
    ids = linkable.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi").select("doc_id")
    texts = linkable.select("doc_id", "d1", "d2").join(ids, "doc_id", "left_semi").distinct()
    return texts.join(nodes.select("d1", "d2", "id"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    described = staged(_described(docs, p))
    linkable = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    least = linkable.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").alias("id"), "sig")).alias("m"))
    nodes = staged(least.select("d1", "d2", "m.id", "m.sig"))
    repeated = staged(_repeated(linkable, nodes))

    buckets, hot = _buckets(nodes, p)
    stars = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = _links(stars, nodes, docs, p).unionByName(repeated)
    member = staged(components(links))  # id, component of every linked node

    # buckets of three or more whose members aren't all in one component
    known = buckets.where("n > 2").join(member, "id", "left").select("key", "leader", "id", F.coalesce("component", "id").alias("component"), "n")
    rest = staged(_several(known, hot))
    if not rest.isEmpty():
        families = components(rest.select(F.col("leader").alias("a"), F.col("id").alias("b")))
        members = staged(rest.select("id", "component").distinct().join(families.withColumnRenamed("component", "family"), "id"))
        extra = _family_links(members, nodes, docs, p)
        if not extra.isEmpty():
            member = staged(components(links.unionByName(extra)))
    drop(rest)
    drop(buckets)

    of_class = nodes.select("d1", "d2", "id").join(member, "id", "left").groupBy("d1", "d2").agg(F.min(F.coalesce("component", "id")).alias("component"))
    rows = described.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("d1")).alias("d1"), "d2")
    joined = rows.join(of_class, ["d1", "d2"], "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    if not repeated.isEmpty():  # rows without words whose doc_id has other rows share their component
        by_id = linkable.select("doc_id", "d1", "d2").join(of_class, ["d1", "d2"]).groupBy("doc_id").agg(F.min("component").alias("of_id"))
        joined = joined.join(by_id, "doc_id", "left")
        component = F.coalesce(F.col("component"), F.col("of_id"), F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """One document of each group of near duplicates, with all its columns. Rows that share that document's doc_id stay; so do those without one.

    The ids that go are counted; a bounded number is sent to the texts, which then stay
    where they are.
    """
    gone = free_name(docs, "gone")
    found = staged(near_duplicates(docs, p).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct())
    found = F.broadcast(found) if found.count() <= p.broadcast_ids else found
    return docs.join(found, docs["doc_id"].cast("long") == F.col(gone), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id WHERE r.root < e.y),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""
