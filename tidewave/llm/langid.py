"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sampled labelled text is built. A text is
parsed from left to right into the longest phrases that occur in that text: a
phrase ends where the automaton has no further transition. The language with the
least phrases times the logarithm of its training length wins, that is with the
least estimated cross entropy; on ties the language first in order.

Texts are parsed whole, many blocks of `block` characters at a time: one step moves
all blocks by one character through a language's table of transitions. Each block is
first parsed as if it began a phrase; then what the block before it left unfinished is
carried into it, up to the place from where both parses agree, so that the phrases are
those of the whole text. The table has columns for the language's most
frequent letters; transitions by its other letters are found by binary search.
Characters other than letters count as spaces.

Edge cases: a null text and one without any letter gets `und` and score 0; so does
every text if nothing can be learned. A null doc_id counts as held out. Repeated
rows are predicted each, an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batches, fold

_LETTER = re.compile(r"[^\W\d_]")
PAD, OTHER, SPACE = 0, 1, 2


@dataclass(frozen=True)
class LangParams:
    docs_per_lang: int = 64  # documents of a language to learn from, at most
    chars_per_lang: int = 25_000  # of their whole texts together, at most
    total_chars: int = 4 << 20  # of all languages; with many of them each gets its share
    total_docs: int = 1 << 16  # looked at in all; likewise
    alphabet: int = 96  # letters of a language with a column in its table, at most; the rest are searched
    block: int = 256
    table_bytes: int = 256 << 20  # of all tables, about; with many languages fewer letters have columns


@dataclass(frozen=True)
class Automaton:
    column: np.ndarray  # column of each symbol
    rare: np.ndarray  # number of each symbol without a column, or -1
    width: int
    table: np.ndarray  # at state + column: 2 * next state + whether a phrase ended; the start is 0
    keys: np.ndarray  # state * rare letters + number, in order
    after: np.ndarray  # 2 * next state of each key
    restart: np.ndarray  # of each rare letter: as in table, where no transition is found


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    chars: str  # character of symbol 3 + i
    automata: list[Automaton]
    cost: np.ndarray  # bits for each phrase


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the start."""
    trans, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


def _letters(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def build(texts: dict[str, list[str]], p: LangParams) -> LangModel:
    """texts: training texts by language."""
    langs = sorted(k for k, v in texts.items() if any(_LETTER.search(t) for t in v))
    joined = {k: " ".join(map(_letters, texts[k])) for k in langs}
    chars = "".join(sorted(set().union(*joined.values()) - {" "}))
    symbol = {c: 3 + i for i, c in enumerate(chars)} | {" ": SPACE}
    made = [_automaton([symbol[c] for c in joined[k]], 3 + len(chars), p.alphabet, p.table_bytes // len(langs)) for k in langs]
    return LangModel(langs, chars, made, np.array([np.log2(max(len(joined[k]), 2)) for k in langs]))


def _automaton(seq: list[int], symbols: int, most: int, size: int) -> Automaton:
    trans = suffix_automaton(seq)
    found, n = np.unique([c for c in seq if c != SPACE], return_counts=True)
    found = found[np.lexsort((found, -n))]
    few = max(0, min(most, len(found), size // (4 * len(trans)) - 3))
    width, rest = 3 + few, max(1, len(found) - few)
    column, rare = np.full(symbols, OTHER, np.int32), np.full(symbols, -1, np.int64)
    column[[PAD, SPACE]] = PAD, SPACE
    column[found[:few]] = np.arange(3, width)
    rare[found[few:]] = np.arange(len(found) - few)
    t, keys = np.full((len(trans), width), -1, np.int64), {}
    for s, row in enumerate(trans):
        for c, to in row.items():
            if rare[c] < 0:
                t[s, column[c]] = to
            else:
                keys[s * width * rest + int(rare[c])] = to * width * 2
    full = np.where(t >= 0, t * width * 2, np.where(t[0] >= 0, t[0], 0) * width * 2 + 1)
    full[:, PAD] = 0
    order = sorted(keys)
    return Automaton(column, rare, width, full.astype(np.int32).ravel(), np.array(order, np.int64), np.array([keys[k] for k in order], np.int32), np.array([keys[r] + 1 for r in range(len(found) - few)], np.int32))


@cache
def _spaces() -> np.ndarray:
    return np.array([not chr(c).isalpha() for c in range(0x110000)])


def _symbols(chars: str) -> np.ndarray:
    lut = np.where(_spaces(), SPACE, OTHER).astype(np.min_scalar_type(3 + len(chars)))
    for i, c in enumerate(chars):
        lut[ord(c)] = 3 + i
        if len(c.upper()) == 1:
            lut[ord(c.upper())] = 3 + i
    return lut


def phrases(texts: list[str], model: LangModel, lut: np.ndarray, block: int) -> np.ndarray:
    """Ended phrases of each text (rows) for each language (columns)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n_blocks = -(-sizes // block)
    first = np.concatenate(([0], np.cumsum(n_blocks)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lanes = np.zeros(first[-1] * block, lut.dtype)
    start = np.concatenate(([0], np.cumsum(sizes)))
    lanes[np.arange(len(codes)) + np.repeat(first[:-1] * block - start[:-1], sizes)] = lut[codes]
    steps = np.ascontiguousarray(lanes.reshape(-1, block).T)
    inner = np.ones(first[-1], bool)
    inner[first[:-1][n_blocks > 0]] = False
    out = [_ended(steps, a, inner) for a in model.automata]
    total = np.concatenate((np.zeros((len(out), 1), np.int64), np.cumsum(out, axis=1)), axis=1)
    return (total[:, first[1:]] - total[:, first[:-1]]).T + (n_blocks > 0)[:, None]


def _moved(state: np.ndarray, row: np.ndarray, a: Automaton) -> np.ndarray:
    """2 * next state + whether a phrase ended, of each lane."""
    after, n = a.table.take(state + a.column.take(row)), len(a.restart)
    if n:
        number = a.rare.take(row)
        at = np.flatnonzero(number >= 0)
        number = number[at]
        key = state[at].astype(np.int64) * n + number
        found = np.minimum(np.searchsorted(a.keys, key), len(a.keys) - 1)
        after[at] = np.where(a.keys[found] == key, a.after[found], a.restart[number])
    return after


def _ended(steps: np.ndarray, a: Automaton, inner: np.ndarray) -> np.ndarray:
    """Ended phrases of each lane. inner: whether a lane goes on where the one before it ends."""
    state, ended = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
    for row in steps:
        after = _moved(state, row, a)
        ended += after & 1
        state = after >> 1
    fresh, extra = state.copy(), np.zeros_like(ended)
    lanes = np.flatnonzero(inner)
    while len(lanes):
        extra[lanes], last = _carried(steps, a, lanes, state[lanes - 1], fresh[lanes])
        changed = lanes[last != state[lanes]]
        state[lanes] = last
        lanes = changed + 1
        lanes = lanes[lanes < len(inner)]
        lanes = lanes[inner[lanes]]
    return ended + extra


def _carried(steps: np.ndarray, a: Automaton, lanes: np.ndarray, start: np.ndarray, last: np.ndarray):
    """By how many ended phrases each lane differs if it begins in the state `start`, and its state at the end; `last` is that of a lane that begins anew."""
    extra, end = np.zeros(len(lanes), np.int32), last.copy()
    at, mine, other = np.arange(len(lanes)), start, np.zeros(len(lanes), np.int32)
    for k, row in enumerate(steps):
        if k % 8 == 0:
            apart = mine != other
            at, mine, other = at[apart], mine[apart], other[apart]
            if not len(at):
                break
        row = row[lanes[at]]
        x, y = _moved(mine, row, a), _moved(other, row, a)
        extra[at] += (x & 1) - (y & 1)
        mine, other = x >> 1, y >> 1
    end[at] = mine
    return extra, end


def predict_texts(texts: list[str | None], model: LangModel, lut: np.ndarray, p: LangParams) -> tuple[list[str], list[float]]:
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.langs else []
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if known:
        bits = phrases([texts[i] for i in known], model, lut, p.block) * model.cost
        best = bits.argmin(axis=1)
        low = np.sort(bits, axis=1)
        score = 1 - low[:, 0] / low[:, 1] if bits.shape[1] > 1 else np.ones(len(known))
        for i, b, s in zip(known, best, score):
            langs[i], scores[i] = model.langs[b], float(s)
    return langs, scores


def _within(rows: list, budget: int) -> list:
    """Of a language's documents (h, doc_id, size), in the order of their hashes, those that still fit the budget; the shortest if none does."""
    kept, left = [], budget
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        if 0 < r.size <= left:
            kept.append(r.doc_id)
            left -= r.size
    return kept or [min(rows, key=lambda r: (r.size, r.h)).doc_id]


def fit(docs: DataFrame, p: LangParams = LangParams()) -> LangModel:
    """Learns every language, from whole texts of a bounded sample of its documents whose fold is not 2.

    Within a language, the document of least hash in each of docs_per_lang hash
    buckets is looked at; only ids, languages and lengths are read for that. Texts are taken in the order
    of their hashes while they fit the language's budget of characters. All languages together have bounds of
    documents and characters too, beyond one document each.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length(F.col("text").cast("string")).alias("size"))
    n = max(usable.select("lang").distinct().count(), 1)
    h = F.xxhash64("doc_id")
    picked = usable.groupBy("lang", F.pmod(h, F.lit(max(1, min(p.docs_per_lang, p.total_docs // n)))).alias("bucket")).agg(F.min(F.struct(h.alias("h"), "doc_id", F.coalesce("size", F.lit(0)).alias("size"))).alias("m"))
    by_lang: dict[str, list] = {}
    for r in picked.collect():
        by_lang.setdefault(r.lang, []).append(r.m)
    rows = [(k, lang) for lang, found in by_lang.items() for k in _within(found, min(p.chars_per_lang, p.total_chars // n))]
    ids = docs.sparkSession.createDataFrame(rows, "doc_id long, lang string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])
    texts: dict[str, list[str]] = {}
    # of rows that share a doc_id the one of least text, as many characters as were counted
    for r in sorted(found.groupBy("doc_id", "lang").agg(F.min(F.struct(F.length("text").alias("size"), "text")).alias("m")).collect(), key=lambda r: (r.lang, r.doc_id)):
        texts.setdefault(r.lang, []).append(r.m.text or "")
    return build(texts, p)


def language_id(docs: DataFrame, p: LangParams = LangParams(), model: LangModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, p))

    def predicted(it):
        m = sent.value
        lut = _symbols(m.chars)
        for b in batches(it, 4 << 20):
            langs, scores = predict_texts(b.column("text").to_pylist(), m, lut, p)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
