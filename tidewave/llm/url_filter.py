"""URL filters by a sorted digest array.

The filter list's keys are hashed with 64-bit xxhash and sorted; digests, offsets and
the keys themselves are three flat files that each executor maps into memory. URLs
are judged in batches: all their candidate keys are hashed, probed with one vectorised
binary search, and each match is confirmed against the stored full key.

A key of the block list is a host, standing for itself and its subdomains, or a
host and path, standing for that page. A rule is a host and a path: it fits its host
and all subdomains if the URL's path starts with the rule's; of the rules that fit the
longest wins (then the first in order), and a rule outweighs the block list.

Edge cases: a null URL, or one without "://", has an empty host and path and is
allowed without a rule; repeated rows are judged each; an empty list blocks nothing.
A candidate longer than every key is never tried, so hosts of any length cost little.
The list's size is checked against `max_bytes` before its files are made; a longer list,
given as a DataFrame, is joined with the candidates in a shuffle instead.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BYTES = 1 << 30
_sent: set[tuple[str, str]] = set()

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


#: parts of the names in the default list
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ly ch wh be ble sh ing tion".split()


def default_blocklist() -> list[str]:
    """Hosts by a rule: names of three syllables under example.org, of advertising and tracking, and of two kinds of spam; 130,000 keys or so."""
    named = [f"{a}{b}{c}.example.org" for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]
    served = [f"{kind}{i}.example.{top}" for kind in ("ads", "track") for i in range(500) for top in ("com", "net", "org")]
    return named + served + [f"{kind}.example.{top}" for kind in ("spam-farm", "cheap-pills") for top in ("com", "net", "org")]


class ListTooLarge(ValueError):
    pass


@dataclass(frozen=True)
class DigestArray:
    """Files of a sorted digest array."""

    digests: str
    offsets: str
    keys: str

    @staticmethod
    def build(keys: Iterable[str], folder: str, max_bytes: int = MAX_BYTES) -> DigestArray:
        raw = sorted({k.encode() for k in keys}, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        size = sum(map(len, raw)) + 16 * len(raw)
        if size > max_bytes:
            raise ListTooLarge(f"{size} bytes; the bound is {max_bytes}")
        blob = b"".join(raw)
        ends = np.concatenate(([0], np.cumsum([len(k) for k in raw]))).astype(np.int64)
        name = hashlib.sha256(blob + ends.tobytes()).hexdigest()[:24]
        found = DigestArray(*(str(Path(folder, f"{name}.{x}")) for x in ("digests", "offsets", "keys")))
        np.array([xxhash.xxh64_intdigest(k) for k in raw], np.uint64).tofile(found.digests)
        ends.tofile(found.offsets)
        Path(found.keys).write_bytes(blob)
        return found

    def open(self, where=str) -> MappedArray:
        return MappedArray(*(where(x) for x in (self.digests, self.offsets, self.keys)))


def _mapped(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if Path(path).stat().st_size else np.zeros(0, kind)


class MappedArray:
    def __init__(self, digests: str, offsets: str, keys: str):
        self.digests, self.offsets, self.keys = _mapped(digests, np.uint64), _mapped(offsets, np.int64), _mapped(keys, np.uint8)
        self.longest = int(np.diff(self.offsets).max()) if len(self.digests) else 0  # bytes, and so no fewer than characters

    def contains(self, candidates: list[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Which of the candidates are keys. Equal digests of different keys are told apart by the keys."""
        raw = [c.encode("utf-8", "surrogatepass") for c in candidates]
        out = np.zeros(len(raw), bool)
        if not raw or not len(self.digests):
            return out
        d = np.array([digest(x) for x in raw], np.uint64)
        at = np.searchsorted(self.digests, d)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == d):
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == d[i] and not out[i]:
                out[i] = self.keys[self.offsets[k] : self.offsets[k + 1]].tobytes() == raw[i]
                k += 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def suffixes(host: str, longest: int) -> list[str]:
    """The host and the domains above it, those of at most `longest` characters."""
    out, at = [], len(host)
    while host and at >= 0 and len(host) - at - 1 <= longest:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 <= longest:
            out.append(host[at + 1 :])
        if at < 0:
            break
    return out[::-1]


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, blocklist: Iterable[str] | DataFrame | None = None, url: str = "url", key: str = "page_id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """key, host, path, rule (like "net/es/", or null) and verdict (allow or block) for every row. blocklist: keys, or a table with the column `entry`."""
    if isinstance(blocklist, DataFrame):
        entries = blocklist.select(F.col("entry").cast("string").alias("entry")).where(F.col("entry").isNotNull()).distinct()
        if (entries.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0) > max_bytes:
            return judge_by_join(spark, pages, entries, rules, url, key)
        blocklist = (r.entry for r in entries.toLocalIterator())
    folder = tempfile.mkdtemp(prefix="tidewave-urls")
    verdicts = {h + p: v for h, p, v in rules}
    arrays = [DigestArray.build(verdicts, folder, max_bytes), DigestArray.build(default_blocklist() if blocklist is None else blocklist, folder, max_bytes)]
    sc = spark.sparkContext
    for a in arrays:
        for f in (a.digests, a.offsets, a.keys):
            if (sc.applicationId, Path(f).name) not in _sent:  # names tell contents
                sc.addFile(f)
                _sent.add((sc.applicationId, Path(f).name))
    order = {h + p: i for i, (h, p, _) in enumerate(rules)}
    cuts = sorted({len(p) for _, p, _ in rules}, reverse=True)
    names = [DigestArray(*(Path(f).name for f in (a.digests, a.offsets, a.keys))) for a in arrays]

    def run(it):
        known_rules, blocked = (a.open(SparkFiles.get) for a in names)
        for b in it:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            tried, rows, listed, owners = [], [], [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                found = [t + p[:c] for t in suffixes(h, known_rules.longest) for c in cuts if len(p) >= c]
                tried += found
                rows += [i] * len(found)
                found = suffixes(h, blocked.longest)
                if h and len(h) + len(p) <= blocked.longest:
                    found.append(h + p)
                listed += found
                owners += [i] * len(found)
            best: dict[int, str] = {}
            for k in np.flatnonzero(known_rules.contains(tried)):
                i, r = rows[k], tried[k]
                if i not in best or (-len(r), order[r]) < (-len(best[i]), order[best[i]]):
                    best[i] = r
            bad = {owners[k] for k in np.flatnonzero(blocked.contains(listed))}
            rule = [best.get(i) for i in range(len(hosts))]
            verdict = [verdicts[r] if r is not None else "block" if i in bad else "allow" for i, r in enumerate(rule)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [key, "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url))
    kind = pages.select(F.col(key)).schema[0].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(spark: SparkSession, pages: DataFrame, entries: DataFrame, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """As judge, for a list (column `entry`) of any size: the candidate keys of each distinct host and path are joined with it."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    seen = rows.where(F.col("host") != "").select("host", "path").distinct()
    longest = max(1, entries.agg(F.max(F.length("entry"))).first()[0] or 0)
    known = spark.createDataFrame([(h + p, v, -len(h + p), i) for i, (h, p, v) in enumerate(rules)], "entry string, verdict string, size int, nth int")

    def tails(most: int) -> Column:
        parts = F.split("host", r"\.")
        last = F.least(F.size(parts), F.lit(most))  # as many labels as the longest key has characters
        made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
        return F.filter(made, lambda x: F.length(x) <= most)

    cuts = F.array(*(F.when(F.length("path") >= c, F.substring("path", 1, c)) for c in sorted({len(p) for _, p, _ in rules}))) if rules else F.array().cast("array<string>")
    heads = tails(max((len(h) for h, _, _ in rules), default=1))
    tried = F.flatten(F.transform(heads, lambda t: F.transform(F.array_compact(cuts), lambda c: F.concat(t, c))))
    fitting = seen.select("host", "path", F.explode(tried).alias("entry")).join(F.broadcast(known), "entry")
    ruled = fitting.groupBy("host", "path").agg(F.min(F.struct("size", "nth", "entry", "verdict")).alias("r"))
    listed = F.filter(F.array_distinct(F.concat(tails(longest), F.array(F.concat("host", "path")))), lambda x: F.length(x) <= longest)
    bad = seen.select("host", "path", F.explode(listed).alias("entry")).join(entries, "entry", "left_semi").select("host", "path").distinct()
    judged = ruled.select("host", "path", F.col("r.entry").alias("rule"), F.col("r.verdict").alias("by_rule")).join(bad.withColumn("listed", F.lit(True)), ["host", "path"], "full")
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block"), F.lit("allow"))
    return rows.join(judged, ["host", "path"], "left").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def oracle_sql() -> str:
    """SQL for the verdicts under RULES and the default list."""
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(ads|track)(0|[1-9][0-9]?|[1-4][0-9][0-9])\.example\.(com|net|org)$') THEN 'block'
    WHEN regexp_matches(host, '(^|\.)({"|".join(SYLLABLES)}){{3}}\.example\.org$') THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.example\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
