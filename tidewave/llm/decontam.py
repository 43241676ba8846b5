"""Benchmark decontamination with DataFrame functions only.

The distinct windows of the benchmark items form a hash set that is broadcast; its
size is checked first. Each document row scans its own windows: their hashes are
exploded, probed against the set within the same stage, and each hit is confirmed word by
word. Only hits, and one row for each document, leave that stage. A set beyond the bound
meets the windows' hashes and places in a shuffle; what is met there goes back to its
document, whose words confirm it.

A word is a run of ASCII letters, digits and characters beyond ASCII, A-Z
lower-cased. A window is `window` consecutive words of an item; an item of fewer
words, but not none, is one window. A word of a document inside any occurrence of
a window is hit.

Edge cases: a null or empty text has no words and isn't contaminated; items without
words have no windows; an item_id that is null counts as the empty string; rows that
repeat are each returned; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_store import staged
from .text import free_name

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
MAX_BROADCAST_BYTES = 128 << 20
MAX_BROADCAST_TEXTS = 1_000_000  # digests of texts, 32 bytes each


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _hashes(hashed: Column, n: Column, length: int) -> Column:
    """Hashes of all windows of a length, by start from 1."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashed, i, length)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, win (its words, blank-joined), h, items (the ids of the items that hold it)."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = w.select("item", length.alias("length"), "w", F.explode(starts).alias("i")).select("item", "length", F.slice("w", F.col("i"), F.col("length")).alias("w"))
    return each.groupBy("length", F.array_join("w", " ").alias("win"), F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("h")).agg(F.collect_set("item").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For every document row: doc_id, text_md5, n_words, hits (array of start, length and items; start from 1), copies (equal rows)."""
    windows = benchmark_windows(benchmark, window)
    facts = windows.agg(F.collect_set("length").alias("lengths"), F.sum(F.length("win") + 64 + 24 * F.size("items")).alias("bytes")).first()
    lengths = sorted(facts.lengths)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"), words(F.col("text").cast("string")).alias("w"))
    base = base.select("doc_id", "text_md5", "w", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    # hw is referred to more than once, so that the optimizer computes it once a row and not once a window
    n = F.size("hw")
    # place 0 stands for the row itself and matches nothing
    blocks = [F.array(F.lit(None).cast("bigint"))] + [_hashes(F.col("hw"), n, k) for k in lengths]
    probe = base.select("doc_id", "text_md5", "w", "n_words", F.concat(*blocks).alias("probe"))
    start, length, passed = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for k in lengths:
        count = F.greatest(F.col("n_words").cast("int") - k + 1, F.lit(0))
        inside = (F.col("place") > passed) & (F.col("place") <= passed + count)
        start, length, passed = F.when(inside, F.col("place") - passed).otherwise(start), F.when(inside, F.lit(k)).otherwise(length), passed + count
    windows = windows.withColumnRenamed("length", "bench_length")
    if (facts.bytes or 0) * 2 > max_bytes:
        return _shuffled_hits(probe, windows, start, length)
    scanned = probe.select("doc_id", "text_md5", "w", "n_words", F.posexplode_outer("probe").alias("place", "h"))
    met = scanned.join(F.broadcast(windows), "h", "left_outer").where((F.col("place") == 0) | F.col("win").isNotNull())
    hit = met.select("doc_id", "text_md5", "n_words", (F.col("place") == 0).alias("own"), start.alias("start"), length.alias("length"), "w", "win", "items")
    true_hit = (F.col("start").isNotNull()) & (F.array_join(F.slice("w", F.coalesce("start", F.lit(1)), F.coalesce("length", F.lit(1))), " ") == F.col("win"))
    hit = hit.where(F.col("own") | true_hit).select("doc_id", "text_md5", "n_words", "own", F.when(~F.col("own"), F.struct("start", "length", "items")).alias("hit"))
    return hit.groupBy("doc_id", "text_md5", "n_words").agg(F.collect_set("hit").alias("hits"), F.count(F.when(F.col("own"), 1)).alias("copies"))


def _shuffled_hits(probe: DataFrame, windows: DataFrame, start: Column, length: Column) -> DataFrame:
    """find_hits without a broadcast. Of the documents' windows only hashes and places are shuffled, and no row has a null key."""
    key = ["doc_id", "text_md5", "n_words"]
    # the outer form, as the other would filter by the array's size and compute it a second time for that, window by window
    scanned = probe.select(*key, F.posexplode_outer("probe").alias("place", "h")).where("place > 0").distinct()
    met = scanned.join(windows, "h").select(*key, F.struct(start.alias("start"), length.alias("length"), "win", "items").alias("hit"))
    met = met.groupBy(*key).agg(F.collect_set("hit").alias("met")).withColumnRenamed("doc_id", "met_id")
    rows = probe.select(*key, "w")
    both = rows.join(met, (rows["text_md5"] == met["text_md5"]) & rows["doc_id"].eqNullSafe(met["met_id"]), "left").select(*(rows[c] for c in (*key, "w")), "met")
    true_hits = F.filter("met", lambda x: F.array_join(F.slice("w", x["start"], x["length"]), " ") == x["win"])
    hits = F.transform(F.coalesce(true_hits, F.array()), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["items"].alias("items")))
    return both.select(*key, hits.alias("hits"), F.lit(1).alias("copies"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For every document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words as start:end from 0, end exclusive), text_md5."""
    found = find_hits(docs, benchmark, window, max_bytes)
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    got = found.select("doc_id", "n_words", "text_md5", places.alias("places"), items.alias("item_ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    got = got.withColumn("n_hit", F.size("places").cast("long"))
    # places are in order, so a span begins or ends where the place beside is not the next number
    firsts = F.filter("places", lambda x, i: (i == 0) | (F.get("places", i - 1) != x - 1))
    lasts = F.filter("places", lambda x, i: (i == F.size("places") - 1) | (F.get("places", i + 1) != x + 1))
    spans = F.when(F.col("n_hit") == 0, F.lit("")).otherwise(F.array_join(F.zip_with(firsts, lasts, lambda a, b: F.concat((a - 1).cast("string"), F.lit(":"), b.cast("string"))), ","))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), spans.alias("spans"), "text_md5",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, max_texts: int = MAX_BROADCAST_TEXTS) -> DataFrame:
    """The documents that aren't contaminated, with all their columns.

    The digests of contaminated texts are counted; a bounded number is sent to the
    documents, which then stay where they are.
    """
    digest = free_name(docs, "contaminated_md5")
    bad = staged(decontaminate(docs, benchmark, window, share).where("contaminated").select(F.col("text_md5").alias(digest)).distinct())
    bad = F.broadcast(bad) if bad.count() <= max_texts else bad
    return docs.join(bad, F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")) == F.col(digest), "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
hits AS (SELECT rid, i, di.k AS k, item FROM di JOIN bw ON bw.k = di.k AND bw.win = array_to_string(w[i:i + di.k - 1], ' ')),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
