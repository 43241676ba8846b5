"""Spelling variant grouping: halves of words in Aho-Corasick automata.

Words are maximal runs of letters, A-Z lower-cased, of `least_length` code points and
`least_count` occurrences at least. Two words are near if one inserted, deleted or
replaced code point turns one into the other. Such an edit leaves one half of a word
unchanged: its first half still begins the other word, or its second half still ends it.

Every word sends its two halves, as patterns, and itself, as a text, to shards by the
hash of a half: its own ones, and those that a word one code point shorter or longer
would have. A shard holds an automaton of its patterns and scans its texts; a match at
the offset of that half, with lengths that differ by one at most, is verified on the rest.
Shards have a bounded number of words, as their number grows with the vocabulary.

A half that so many words share that its pairs would pass `most_pairs` is left out of the
shards. Its words meet on what remains of them instead, by one code point less: with that
point's place for replacements, without it for insertions. A key of that kind is shared
by no more words than there are letters (and places), so nothing grows with the square.

A word's form is its near word of most occurrences if these are at least `ratio` times its
own, so that forms lead upwards, and a root is found by doubling the steps.

Edge cases: a null or empty text has no words; a null doc_id deletes no code point;
copies of rows count as often as they occur; words without near words are returned with
n_near 0; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_store import drop, staged

LETTERS = "([A-Za-zÀ-ÿ]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIRST, _SECOND = 0, 1


@dataclass(frozen=True)
class SpellingParams:
    least_length: int = 5
    least_count: int = 3
    damage: int = 97  # a run whose hash this divides loses a code point; 0: none
    ratio: int = 2
    shard_words: int = 4_000
    most_pairs: int = 250_000  # of texts and patterns that share a half
    broadcast_keys: int = 1_000_000


def words(docs: DataFrame, p: SpellingParams) -> DataFrame:
    """word and n of the vocabulary."""
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(1))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    word: Column = F.col("run")
    if p.damage:
        h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
        at = (h % size).cast("int")
        lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
        word = F.when(h % p.damage == 0, lost).otherwise(word)
    return low.select(word.alias("word")).where(F.length("word") >= p.least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.least_count)


def _half(word: Column, size: Column, kind: int) -> Column:
    """The half of that kind that a word of `size` code points with this beginning or end has."""
    first = F.floor(size / 2).cast("int")
    return F.substring(word, F.lit(1), first) if kind == _FIRST else F.substring(word, F.length(word) - (size - first) + 1, size - first)


def _halves(table: DataFrame) -> DataFrame:
    """text (whether a row is a text or a pattern), kind, half, word, n: patterns have their own halves, texts all that a near word may have. A half is there once a word."""
    size = F.length("word")
    kinds = lambda text, steps: F.array_distinct(F.array(*[F.struct(F.lit(text).alias("text"), F.lit(k).alias("kind"), _half(F.col("word"), size + d, k).alias("half")) for k in (_FIRST, _SECOND) for d in steps]))
    rows = table.select("word", "n", F.explode(F.concat(kinds(False, (0,)), kinds(True, (-1, 0, 1)))).alias("h"))
    return rows.select("h.*", "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def scan(patterns: list[tuple[int, str, str, int]], texts: list[str]):
    """(text, word, n) of the texts and the patterns (kind, half, word, n) near them, by one automaton over the halves."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    held: dict[str, dict[tuple[int, int], list]] = {}
    for kind, half, word, n in patterns:
        held.setdefault(half, {}).setdefault((kind, len(word)), []).append((word[len(half) :] if kind == _FIRST else word[: -len(half)], word, n))
    for half, of in held.items():
        automaton.add_word(half, (len(half), of))
    if not held:
        return
    automaton.make_automaton()
    for text in texts:
        size = len(text)
        for end, (length, of) in automaton.iter(text):
            # a first half begins the text, a second half ends it
            for kind, here, rest in ((_FIRST, end + 1 == length, text[length:]), (_SECOND, end + 1 == size, text[: size - length])):
                if here:
                    for other in (size - 1, size, size + 1):
                        for remains, word, n in of.get((kind, other), ()):
                            if one_edit(remains, rest):
                                yield text, word, n


def _scanned(rows: DataFrame, shards: int) -> DataFrame:
    def run(shard: pa.Table) -> pa.Table:
        patterns, texts = [], set()
        for text, kind, half, word, n in zip(*(shard.column(c).to_pylist() for c in ("text", "kind", "half", "word", "n"))):
            if text:
                texts.add(word)
            else:
                patterns.append((kind, half, word, n))
        found = list(zip(*scan(patterns, sorted(texts)))) or [(), (), ()]
        return pa.table({"word": pa.array(found[0], pa.string()), "near": pa.array(found[1], pa.string()), "near_n": pa.array(found[2], pa.int64())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("kind", "half"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "word string, near string, near_n long")


def _by_rest(rows: DataFrame) -> DataFrame:
    """Pairs of the halves that too many words share, by what remains of a word without one code point."""
    size = F.length("half")
    rest = F.when(F.col("kind") == _FIRST, F.substring("word", size + 1, F.length("word"))).otherwise(F.substring("word", F.lit(1), F.length("word") - size))
    base = rows.select("text", F.xxhash64("kind", "half").alias("key"), "word", "n", rest.alias("rest"))
    less = lambda i: F.concat(F.substring("rest", F.lit(1), i), F.substring("rest", i + 2, F.length("rest")))
    places = F.when(F.length("rest") > 0, F.sequence(F.lit(0), F.length("rest") - 1)).otherwise(F.array().cast("array<int>"))
    # a replaced code point: equal without it; place -1: the word itself, place -2: without any one code point
    gone = F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(less(i)).alias("h")))
    own = F.array(F.struct(F.lit(-1).alias("place"), F.xxhash64("rest").alias("h")))
    any_place = F.array_distinct(F.transform(places, lambda i: F.struct(F.lit(-2).alias("place"), F.xxhash64(less(i)).alias("h"))))
    each = base.select("text", "key", "word", "n", F.explode(F.concat(gone, own, any_place)).alias("v")).select("text", "key", "word", "n", "v.place", "v.h")
    t = each.where("text").select("key", "word", "h", F.when(F.col("place") == -1, -2).when(F.col("place") == -2, -1).otherwise(F.col("place")).alias("place"))
    w = each.where("not text").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "place", "h")
    return t.join(w, ["key", "place", "h"]).where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def near_words(table: DataFrame, p: SpellingParams) -> DataFrame:
    """word, near, near_n: each ordered pair of near words once. table: word, n, each word once."""
    rows = _halves(table)
    per_key = rows.groupBy("kind", "half").agg(F.sum(F.when(F.col("text"), 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("text"), 0).otherwise(1)).alias("w"))
    # texts without a pattern meet nothing, but must not crowd a shard either
    hot = staged(per_key.where(F.col("t") * F.greatest("w", F.lit(1)) > p.most_pairs).select("kind", "half"))
    count = hot.count()
    pairs = None
    if count:
        few = F.broadcast(hot) if count <= p.broadcast_keys else hot
        pairs = _by_rest(rows.join(few, ["kind", "half"], "left_semi"))
        rows = rows.join(few, ["kind", "half"], "left_anti")
    found = _scanned(rows, max(1, -(-table.count() // p.shard_words)))
    return (found if pairs is None else found.unionByName(pairs)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form. forms: word, form. A step goes twice as far each round."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(now)
        if not jumped.where("moved").limit(1).count():
            return jumped.select("word", "root")
        now = jumped.select("word", "root")


def variants(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    table = staged(words(docs, p))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    per_word = near_words(table, p).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    joined = table.join(per_word, "word", "left")
    holds = -F.col("b.m") >= p.ratio * F.col("n")
    facts = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("b.near")).alias("form"), F.when(holds, -F.col("b.m")).alias("form_n")))
    drop(table)
    roots = _roots(facts.where("form is not null").select("word", "form"))
    return facts.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
