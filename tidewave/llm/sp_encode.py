"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses a space mark or a newline from the left: none has a
space mark behind another character, and none holds a newline. So a text may be
cut before every run of spaces and before every newline, and each chunk's segments
don't depend on its neighbours. `cuts_are_safe` checks the property for a model; for a
model without it whole texts are encoded.

The chunks of all texts are counted in one aggregation. Each distinct chunk that occurs
more than once is segmented once, by the library, and goes into a table with its ids.
The table is sent to the texts, where ids are joined back to the chunks by position, all
of a batch at a time. Its size is measured first: if it is over `table_bytes`, it keeps
the most frequent chunks. A chunk that the table lacks, as those that occur once in the
corpus, is segmented where it stands. Chunks are told apart by 128-bit hashes.

Edge cases: a null text is an empty one, which has no ids; texts that hold the space
mark itself are encoded whole; control pieces' strings, lone bytes and long runs of
spaces are encoded as the library does. Repeated rows are encoded each; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_store import drop, staged
from .text import batches, span_hashes, utf8

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def cuts_are_safe(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece has a newline, or a space mark behind another character; and the model changes no text but for a leading mark."""
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        if "\n" in piece or MARK in piece.lstrip(MARK):
            return False
    probe = "A  b\n céﬁ́ \t d  "
    return sp.decode(sp.encode(probe)) == probe and sp.encode("a")[0] == sp.encode(" a", out_type=int)[-1]


@lru_cache(maxsize=4)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """One processor for each Python worker."""
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, in order, each text with a space before it; and the chunks' offsets by text. Empty texts have none."""
    texts = texts.fill_null("").cast(pa.large_string())
    empty = pa.scalar("", pa.large_string())
    padded = pc.if_else(pc.equal(pc.binary_length(texts), 0), empty, pc.binary_join_element_wise(empty, texts, pa.scalar(" ", pa.large_string())))
    data, at = utf8(padded)
    space = data == 32
    begin = data == 10
    begin[1:] |= space[1:] & ~space[:-1]
    begin[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(begin)
    bounds = np.append(start, len(data)).astype(np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return out, np.searchsorted(start, at)


def _hashes(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(found.cast(pa.large_binary()).view(pa.large_string()))
    return span_hashes(data, at)


def segment(found: list[str], sp: sentencepiece.SentencePieceProcessor) -> list[list[int]]:
    """Ids of each chunk. The library puts a mark before what it encodes, which stands for a chunk's first space."""
    ids = sp.encode([c[1:] if c[0] == " " else c for c in found], num_threads=1)
    alone = [sp.piece_to_id(MARK)]
    return [x if c[0] == " " and len(c) > 1 else alone if c[0] == " " else x[1:] for c, x in zip(found, ids)]


@dataclass(frozen=True)
class ChunkTable:
    """Distinct chunks by their hashes, in the order of the first; ids[at[i] : at[i + 1]] are those of chunk i."""

    h1: np.ndarray
    h2: np.ndarray
    at: np.ndarray
    ids: np.ndarray


def _ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] of all i, one behind the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def ids_of(texts: pa.Array, table: ChunkTable, sp: sentencepiece.SentencePieceProcessor) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one behind the other, and the ids' offsets by text."""
    found, bounds = chunks(texts)
    h1, h2 = _hashes(found)
    _, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
    if (h2 != h2[first][inverse]).any():  # two chunks of equal first hash in one batch
        _, first, inverse = np.unique(np.stack((h1, h2), axis=1), axis=0, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
    k1, k2 = h1[first], h2[first]
    where = np.minimum(np.searchsorted(table.h1, k1), max(len(table.h1) - 1, 0))
    known = (table.h1[where] == k1) & (table.h2[where] == k2) if len(table.h1) else np.zeros(len(k1), bool)
    size, start = np.zeros(len(k1), np.int64), np.zeros(len(k1), np.int64)
    start[known] = table.at[where[known]]
    size[known] = table.at[where[known] + 1] - start[known]
    pool = _ragged(table.ids, start[known], size[known])
    new = segment([c.decode() for c in found.take(pa.array(first[~known])).to_pylist()], sp)
    size[~known] = [len(x) for x in new]
    pool = np.concatenate((pool, np.array([i for x in new for i in x], np.int32)))
    order = np.concatenate((np.flatnonzero(known), np.flatnonzero(~known)))
    start[order] = np.cumsum(size[order]) - size[order]
    ids = _ragged(pool, start[inverse], size[inverse])
    ends = np.concatenate(([0], np.cumsum(size[inverse])))
    return ids, ends[bounds]


def chunk_table(docs: DataFrame, model: Broadcast, table_bytes: int) -> ChunkTable:
    """model: the model's bytes. The ids of the distinct chunks of all texts that occur more than once; the most frequent of them, if all need more than table_bytes."""

    def counted(it):
        for b in batches(it, 4 << 20):
            found, _ = chunks(b.column("text"))
            _, first, n = np.unique(_hashes(found)[0], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([found.take(pa.array(first)).cast(pa.binary()), pa.array(n)], ["chunk", "n"])

    def segmented(it):
        sp = processor(model.value)
        for whole in it:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                h1, h2 = _hashes(b.column("chunk"))
                ids = [np.array(x, np.int32).tobytes() for x in segment([c.decode() for c in b.column("chunk").to_pylist()], sp)]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.binary()), b.column("n")], ["h1", "h2", "ids", "n"])

    each = docs.mapInArrow(counted, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    made = staged(each.mapInArrow(segmented, "h1 long, h2 long, ids binary, n long"))
    step = F.floor(F.log2("n"))  # frequencies by powers of two: a few dozen rows
    least, total = 0, 0
    for r in made.groupBy(step.alias("step")).agg(F.sum(F.length("ids") + 20).alias("bytes")).orderBy(F.desc("step")).collect():
        total += r["bytes"]
        if total > table_bytes:
            least = r["step"] + 1
            break
    rows = made.where(step >= least).select("h1", "h2", "ids").toArrow()
    drop(made)
    h1, h2 = (np.asarray(rows.column(c)).view(np.uint64) for c in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    raw, at = utf8(rows.column("ids").cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
    at = at // 4
    size = np.diff(at)[order]
    ids = _ragged(np.frombuffer(raw, np.int32), at[:-1][order], size)
    return ChunkTable(h1[order], h2[order], np.concatenate(([0], np.cumsum(size))).astype(np.uint32), ids)


def encode(docs: DataFrame, model: str | None = None, table_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (string), ids_sha256 and decoded_sha256 of every whole text."""
    proto = Path(model or default_model()).read_bytes()
    safe = cuts_are_safe(processor(proto))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(proto)
    table = sc.broadcast(chunk_table(source.select("text"), sent, table_bytes) if safe else None)

    def run(it):
        sp, sha = processor(sent.value), hashlib.sha256
        for b in batches(it, 2 << 20):
            texts = b.column("text").fill_null("").cast(pa.large_string())
            whole = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) if safe else np.ones(len(texts), bool)
            found: list = [None] * len(texts)
            for i in np.flatnonzero(whole):
                found[i] = np.array(sp.encode(texts[i].as_py()), np.int32)
            rest = np.flatnonzero(~whole)
            if len(rest):
                ids, at = ids_of(texts.take(pa.array(rest)), table.value, sp)
                for i, x, y in zip(rest, at[:-1], at[1:]):
                    found[i] = ids[x:y]
            lists = [x.tolist() for x in found]
            decoded = sp.decode(lists, num_threads=1)
            columns = [
                b.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), _int_lists(found), pa.array(decoded, pa.string()),
                pa.array([sha(",".join(map(str, x)).encode()).hexdigest() for x in lists], pa.string()), pa.array([sha(x.encode()).hexdigest() for x in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string")


def _int_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))
