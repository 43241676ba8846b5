"""Substring dedup by hashing of normalised units.

Units are the lines of a text, cut further before every pair of words whose hash is
the least within `radius` words on either side, and after `longest` words. Where such
cuts fall depends on the words around them alone, so a passage has the same units
wherever it stands and wherever sentences begin or end. A unit is normalised (lower
case, white space collapsed) and hashed to 128 bits; digests are grouped over all
documents, and the occurrence of least (doc_id, text, position) is kept. Neighbouring
units of a document that all occur earlier form a run. A run is extended at both ends
word by word, as long as the words are those beside the earlier occurrence of one of
its units; runs that then have at least `min_words` words are removed, and their
offsets in the original text (code points, end exclusive) are returned.

`min_words` is part of the definition: shorter repeats (set phrases, short lines) are
left alone. A word repeated over and over has no cuts of its own but those after `longest`
words, so such stretches are found as far as these coincide. Digests, positions and words at the ends of runs are shuffled, and of the
texts only those that have such ends. A unit that a whole corpus shares is reduced to
its least occurrence on the map side; where occurrences are joined to that, what more than
`hot` of them ask for is sent to them, and the rest is shuffled (see skew.py).

Whole lines and paragraphs are units too (`repeated_lines`): of those of `line_words` words or
more, each but the earliest occurrence is found, whatever stands around it. `dedup` removes
both these and the passages; `passages` lists the latter only.

Edge cases: a null or empty text has no units; a null doc_id ranks behind all others;
repeats inside a document count as later occurrences; rows with the same doc_id share
one rank, so that none of them removes another; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared_store import drop, staged
from .skew import crowded, join_hot
from .text import NOT_SPACE, batches, free_name, mix64, sequence_hashes, utf8, word_hashes, word_places

_LAST = (1 << 63) - 1
_STEP = np.uint64(0x9E3779B97F4A7C55)
_LEFT, _RIGHT = 0, 1


@dataclass(frozen=True)
class DedupParams:
    min_words: int = 50  # of a removed passage
    radius: int = 5  # words on either side that a cut depends on
    longest: int = 32  # words of a unit, at most
    line_words: int = 5  # of a removed line or paragraph
    hot: int = 20_000  # occurrences of a unit, or ends of runs at one place, that are not shuffled
    broadcast_ids: int = 1_000_000  # texts with ends of runs, 16 bytes each; beyond it they meet the texts in a shuffle


def reach(p: DedupParams) -> int:
    """Words that a run may be extended by: those of the unit beside it, and of the next as far as a cut between them depends on words beyond the passage."""
    return p.longest + p.radius + 1


def cuts(h: np.ndarray, offsets: np.ndarray, line: np.ndarray, p: DedupParams) -> np.ndarray:
    """The words that begin a unit. h: hashes of the words of all texts; line: whether a word begins a line."""
    n = len(h)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    following = np.append(h[1:], np.zeros(min(n, 1), np.uint64))
    following[offsets[1:][np.diff(offsets) > 0] - 1] = 0
    pair = mix64(h * _STEP + following)
    least = np.ones(n, bool)
    for k in range(1, min(p.radius, n - 1) + 1):
        apart = doc[k:] != doc[:-k]
        least[k:] &= (pair[k:] < pair[:-k]) | apart
        least[:-k] &= (pair[:-k] <= pair[k:]) | apart
    least[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(least | line)
    length = np.diff(np.append(at, n))
    more = np.maximum(-(-length // p.longest), 1)
    nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    return np.repeat(at, more) + nth * p.longest


def units(texts: pa.Array, p: DedupParams) -> dict[str, np.ndarray]:
    """Of every unit of all texts, in order: doc (which text), unit (its number there), at (words before it), words, h1, h2, inner (at of an equal unit earlier in the same text, or -1)."""
    low = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    h, offsets, start, _ = word_places(low, NOT_SPACE)
    lines = np.cumsum(utf8(low)[0] == 10)
    line = np.diff(lines[start], prepend=0) > 0
    begin = cuts(h, offsets, line, p)
    end = np.append(begin[1:], len(h))[: len(begin)]
    doc = np.searchsorted(offsets, begin, "right") - 1
    h1 = sequence_hashes(h, begin, end).view(np.int64)
    h2 = sequence_hashes(mix64(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), begin, end).view(np.int64)
    at = begin - offsets[doc]
    order = np.lexsort((begin, h2, h1, doc))
    same = np.zeros(len(begin), bool)
    a, b = order[:-1], order[1:]
    same[1:] = (doc[a] == doc[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    inner = np.full(len(begin), -1)
    inner[order[same]] = at[order[first[same]]]
    nth = np.arange(len(begin)) - np.searchsorted(doc, doc)
    return {"doc": doc, "unit": nth, "at": at, "words": end - begin, "h1": h1, "h2": h2, "inner": inner}


def _source(docs: DataFrame) -> DataFrame:
    """rank (doc_id), row (hash of the text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"), F.xxhash64(text).alias("row"), text.alias("text"))


def unit_table(docs: DataFrame, p: DedupParams) -> DataFrame:
    """A row for each unit: rank, row and the columns of units."""

    def run(it):
        for b in batches(it, 4 << 20):
            u = units(b.column("text"), p)
            doc = pa.array(u.pop("doc"))
            numbers = [pa.array(u[c], pa.int64() if c in ("h1", "h2") else pa.int32()) for c in u]
            yield pa.RecordBatch.from_arrays([b.column("rank").take(doc), b.column("row").take(doc), *numbers], ["rank", "row", *u])

    return _source(docs).mapInArrow(run, "rank long, row long, unit int, at int, words int, h1 long, h2 long, inner int")


def _later(table: DataFrame, p: DedupParams) -> DataFrame:
    """Of every text, later: its units that occur earlier, with the place of that occurrence."""
    outer = table.where("inner < 0")
    first = outer.groupBy("h1", "h2").agg(F.min(F.struct("rank", "row", "at")).alias("s"), F.count("*").alias("n")).where("n > 1")
    first = staged(first)
    across = join_hot(outer, first.drop("n"), ["h1", "h2"], first.where(F.col("n") > p.hot).select("h1", "h2")).where(F.col("rank") > F.col("s.rank"))
    columns = ["rank", "row", "unit", "at", "words"]
    places = across.select(*columns, F.col("s.rank").alias("s_rank"), F.col("s.row").alias("s_row"), F.col("s.at").alias("s_at"))
    within = table.where("inner >= 0").select(*columns, F.col("rank").alias("s_rank"), F.col("row").alias("s_row"), F.col("inner").alias("s_at"))
    # rows that are equal in doc_id and text give each unit once
    return places.unionByName(within).groupBy("rank", "row").agg(F.array_sort(F.collect_set(F.struct("unit", "at", "words", "s_rank", "s_row", "s_at"))).alias("later"))


_ENDS = "rank long, row long, lo int, hi int, units int, first long, side int, s_rank long, s_row long, s_at int"


def _ends(later: DataFrame, p: DedupParams) -> DataFrame:
    """A row for each end of a run and each earlier text that holds a unit of it: the run (lo and hi in words), its side, and the place beside which the earlier text's words are to be compared."""

    def run(it):
        for b in it:
            out = [[] for _ in range(10)]
            for rank, row, found in zip(b.column("rank").to_pylist(), b.column("row").to_pylist(), b.column("later").to_pylist()):
                for piece in _consecutive(found):
                    lo, hi = piece[0]["at"], piece[-1]["at"] + piece[-1]["words"]
                    if hi - lo <= p.radius:  # a passage longer than the units beside its ends has more whole units
                        continue
                    for s_rank, s_row, shift in {(u["s_rank"], u["s_row"], u["s_at"] - u["at"]) for u in piece}:
                        for side, at in ((_LEFT, lo), (_RIGHT, hi)):
                            if at + shift >= 0:
                                for column, value in zip(out, (rank, row, lo, hi, len(piece), piece[0]["s_rank"], side, s_rank, s_row, at + shift)):
                                    column.append(value)
            kinds = [pa.int64() if c.endswith("long") else pa.int32() for c in _ENDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in _ENDS.split(", ")])

    return later.mapInArrow(run, _ENDS)


def _consecutive(found: list[dict]) -> list[list[dict]]:
    out: list[list[dict]] = []
    for x in found:
        if out and x["unit"] == out[-1][-1]["unit"] + 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _beside(docs: DataFrame, ends: DataFrame, p: DedupParams) -> DataFrame:
    """rank, row, at, side, words (hashes of those from the word `at` on, outwards, as many as an extension can have) and places (offsets of the run's end, were it extended by 0, 1, ... of them)."""
    own = ends.select("rank", "row", F.when(F.col("side") == _LEFT, F.col("lo")).otherwise(F.col("hi")).alias("at"), "side")
    other = ends.select(F.col("s_rank").alias("rank"), F.col("s_row").alias("row"), F.col("s_at").alias("at"), "side")
    asked = staged(own.unionByName(other).groupBy("rank", "row").agg(F.collect_set(F.struct("at", "side")).alias("asked")))
    source = _source(docs)
    if asked.count() <= p.broadcast_ids:
        source = source.join(F.broadcast(asked.select("rank", "row")), ["rank", "row"], "left_semi")
    most = reach(p)

    def run(it):
        for b in batches(it, 4 << 20):
            texts = b.column("text").fill_null("").cast(pa.large_string())
            h = word_hashes(pc.utf8_lower(texts), NOT_SPACE)[0].view(np.int64)
            _, offsets, start, end = word_places(texts, NOT_SPACE)
            data, bytes_at = utf8(texts)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            out = [[] for _ in range(6)]
            for i, asked in enumerate(b.column("asked").to_pylist()):
                lo, hi, zero = int(offsets[i]), int(offsets[i + 1]), int(points[bytes_at[i]])
                for x in asked:
                    at = lo + x["at"]
                    if at > hi:
                        continue
                    if x["side"] == _LEFT:
                        begin = max(lo, at - most)
                        words, places = h[begin:at][::-1], points[start[begin : at + 1]][::-1]
                    else:
                        stop = min(hi, at + most)
                        words, places = h[at:stop], points[end[max(at - 1, 0) : stop]]
                    for column, value in zip(out, (b.column("rank")[i], b.column("row")[i], x["at"], x["side"], words, places - zero)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["rank", "row", "at", "side", "words", "places"])

    found = source.join(asked, ["rank", "row"]).mapInArrow(run, "rank long, row long, at int, side int, words array<long>, places array<int>")
    return staged(found.dropDuplicates(["rank", "row", "at", "side"]))


def passages(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """A row for each removed passage: doc_id, start, end, words, units (whole ones in it), first_doc_id (the document that keeps its first whole unit), text_hash (xxhash64 of the text)."""
    table = staged(unit_table(docs, p))
    ends = staged(_ends(_later(table, p), p))
    drop(table)
    beside = _beside(docs, ends, p)
    theirs = beside.select(F.col("rank").alias("s_rank"), F.col("row").alias("s_row"), F.col("at").alias("s_at"), "side", F.col("words").alias("s_words"))
    mine = beside.select("rank", "row", "at", "side", "words", "places")
    place = ["s_rank", "s_row", "s_at", "side"]
    pairs = join_hot(ends, theirs, place, crowded(ends, place, p.hot)).withColumn("at", F.when(F.col("side") == _LEFT, F.col("lo")).otherwise(F.col("hi"))).join(mine, ["rank", "row", "at", "side"])
    equal = F.zip_with("words", "s_words", lambda a, b: a.eqNullSafe(b))
    length = F.array_position(F.concat(equal, F.array(F.lit(False))), False).cast("int") - 1
    farthest = F.max(F.struct(length.alias("n"), F.get("places", length).cast("long").alias("place")))
    sides = pairs.groupBy("rank", "row", "lo", "hi", "units", "first", "side").agg(farthest.alias("r"))
    part = lambda side, name: F.max(F.when(F.col("side") == side, F.col(f"r.{name}")))
    runs = sides.groupBy("rank", "row", "lo", "hi", "units", "first").agg(part(_LEFT, "n").alias("before"), part(_RIGHT, "n").alias("after"), part(_LEFT, "place").alias("start"), part(_RIGHT, "place").alias("end"))
    spans = runs.select("rank", "row", F.struct((F.col("lo") - F.col("before")).alias("a"), (F.col("hi") + F.col("after")).alias("z"), "start", "end", "units", "first").alias("x"))
    joined = spans.groupBy("rank", "row").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def run(it):
        for b in it:
            out = [[] for _ in range(7)]
            for rank, row, found in zip(b.column("rank").to_pylist(), b.column("row").to_pylist(), b.column("x").to_pylist()):
                made: list[dict] = []
                for x in found:
                    if made and x["a"] <= made[-1]["z"]:
                        made[-1] |= {"z": max(x["z"], made[-1]["z"]), "end": max(x["end"], made[-1]["end"]), "units": x["units"] + made[-1]["units"]}
                    else:
                        made.append(x)
                for x in made:
                    if x["z"] - x["a"] >= p.min_words:
                        values = (None if rank == _LAST else rank, x["start"], x["end"], x["z"] - x["a"], x["units"], None if x["first"] == _LAST else x["first"], row)
                        for column, value in zip(out, values):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "end", "words", "units", "first_doc_id", "text_hash"])

    return joined.mapInArrow(run, "doc_id long, start long, end long, words long, units long, first_doc_id long, text_hash long")


def lines(texts: pa.Array, least: int) -> dict[str, np.ndarray]:
    """Of every line of at least so many words, and every paragraph (lines without an empty one between) of several lines: doc, paragraph (or a line), at (words before it), start and end (code points of the text), words, h1, h2."""
    texts = texts.fill_null("").cast(pa.large_string())
    h, offsets, _, _ = word_places(pc.utf8_lower(texts), NOT_SPACE)
    _, _, start, end = word_places(texts, NOT_SPACE)
    data, bytes_at = utf8(texts)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    newline = np.concatenate(([0], np.cumsum(data == 10)))
    row = newline[start]
    fresh = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    begins_line = fresh | (np.diff(row, prepend=-1) > 0)
    # between the words before and here: two line ends with nothing else than blanks
    begins_paragraph = fresh | (np.diff(row, prepend=-1) > 1)
    out: dict[str, list] = {k: [] for k in ("doc", "paragraph", "at", "start", "end", "words", "h1", "h2")}
    for paragraph, begins in ((False, begins_line), (True, begins_paragraph)):
        a = np.flatnonzero(begins)
        z = np.append(a[1:], len(h))[: len(a)]
        keep = z - a >= least
        if paragraph:
            keep &= row[np.maximum(z - 1, 0)] > row[a] if len(a) else keep
        a, z = a[keep], z[keep]
        zero = points[bytes_at[doc[a]]]
        for name, value in (("doc", doc[a]), ("paragraph", np.full(len(a), paragraph)), ("at", a - offsets[doc[a]]), ("start", points[start[a]] - zero), ("end", points[end[z - 1]] - zero), ("words", z - a), ("h1", sequence_hashes(h, a, z)), ("h2", sequence_hashes(mix64(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), a, z))):
            out[name].append(value)
    return {k: np.concatenate(v) for k, v in out.items()}


def repeated_lines(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """A row for each line or paragraph that stands earlier, in a document of lesser doc_id or before it in the same text: doc_id, start, end, words, paragraph, first_doc_id, text_hash.

    Lines are equal if their words are, in lower case. Equal rows give each line once; rows with the same doc_id don't remove each other's.
    """

    def run(it):
        for b in batches(it, 4 << 20):
            u = lines(b.column("text"), p.line_words)
            at = pa.array(u.pop("doc"))
            columns = [pa.array(v.view(np.int64)) if v.dtype == np.uint64 else pa.array(v, pa.bool_() if k == "paragraph" else pa.int64()) for k, v in u.items()]
            yield pa.RecordBatch.from_arrays([b.column("rank").take(at), b.column("row").take(at), *columns], ["rank", "row", *u])

    found = _source(docs).mapInArrow(run, "rank long, row long, paragraph boolean, at long, start long, end long, words long, h1 long, h2 long")
    table = staged(found.dropDuplicates(["rank", "row", "paragraph", "at"]))
    key = ["paragraph", "h1", "h2"]
    first = staged(table.groupBy(*key).agg(F.min(F.struct("rank", "row", "at")).alias("s"), F.count("*").alias("n")).where("n > 1"))
    met = join_hot(table, first.drop("n"), key, first.where(F.col("n") > p.hot).select(*key))
    # within a text the first one counts, also where another row of the same doc_id has an earlier one
    own = F.min("at").over(Window.partitionBy(*key, "rank", "row"))
    later = met.withColumn("own", own).where((F.col("rank") > F.col("s.rank")) | (F.col("at") > F.col("own")))
    unknown = lambda c: F.when(c != _LAST, c)
    return later.select(unknown(F.col("rank")).alias("doc_id"), "start", "end", "words", "paragraph", unknown(F.col("s.rank")).alias("first_doc_id"), F.col("row").alias("text_hash"))


def merged(spans):
    """An array of structs start and end, sorted by start, with those that meet made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(made, x):
        top = F.get(made, F.size(made) - 1)
        meets = (F.size(made) > 0) & (x["start"] <= top["end"])
        joined = F.concat(F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))), F.array(F.struct(top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))))
        return F.when(meets, joined).otherwise(F.concat(made, F.array(x)))

    return F.aggregate(spans, none, add)


def dedup(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """The documents with repeated passages, lines and paragraphs cut out of their texts, and a column removed (array of start, end; null where nothing is).

    Cuts belong to a doc_id and a text, so rows that share a doc_id (or have none) lose
    only their own repeats. Where docs has a column `removed`, underscores are added to the new one's name.
    """
    name, key, row = (free_name(docs, c) for c in ("removed", "cut_id", "cut_row"))
    spans = passages(docs, p).select("doc_id", "text_hash", "start", "end").unionByName(repeated_lines(docs, p).select("doc_id", "text_hash", "start", "end"))
    cut = spans.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(row)).agg(merged(F.array_sort(F.collect_set(F.struct("start", "end")))).alias(name))
    mine = docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(row))
    joined = docs.join(cut, mine, "left").drop(key, row)
    at = F.col(name)
    gap = F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"]).alias("a"), F.coalesce(F.get(at, i)["start"], F.length("text").cast("long")).alias("b")))
    kept = F.array_join(F.transform(gap, lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")
    return joined.withColumn("text", F.when(at.isNull(), F.col("text")).otherwise(kept))


def lines_sql(p: DedupParams = DedupParams()) -> str:
    """repeated_lines in DuckDB's SQL, without text_hash, for tables in which a doc_id stands once."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
o AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - len(line) - 1 AS off, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS w FROM l),
n AS (SELECT doc_id, no, w, off + len(line) - len(ltrim(line, {blank})) AS a, off + len(rtrim(line, {blank})) AS z, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS g FROM o WHERE len(w) > 0),
u AS (SELECT doc_id, false AS paragraph, a, z, w FROM n UNION ALL SELECT doc_id, true, min(a), max(z), flatten(list(w ORDER BY no)) FROM n GROUP BY doc_id, g HAVING count(*) > 1),
f AS (SELECT *, min(coalesce(doc_id, {_LAST})) OVER (PARTITION BY paragraph, w) AS first, min(a) OVER (PARTITION BY paragraph, w, doc_id) AS own FROM u WHERE len(w) >= {p.line_words})
SELECT doc_id, CAST(a AS BIGINT) AS start, CAST(z AS BIGINT) AS "end", len(w) AS words, paragraph, first AS first_doc_id FROM f WHERE coalesce(doc_id, {_LAST}) > first OR a > own"""
