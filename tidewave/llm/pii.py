"""Personal data: exact base patterns, and a character-level BiLSTM with CRF transitions.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by
fixed patterns. The tagger, trained in numpy from labelled spans, adds spans of the
same kinds that the patterns miss. It reads texts in overlapping windows; each window is
decoded by Viterbi, and each character takes its label from the window in whose middle
it lies, so spans are put together over the whole text. A span without a digit or an "@"
is never accepted; so windows without one in themselves or in a neighbour are skipped.

Edge cases: a null text is an empty one and has no spans; repeated rows are each
searched; an empty table gives no rows. Base spans may overlap those of other kinds; an
added span overlaps none.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_ANCHOR = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match of this pattern never begins inside a run of digits, as it ends at the end of one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """As the leftmost matches of one pattern: each has one "@" and begins with the run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    if not _ANCHOR.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- tagger ---------------------------------------------------------------------


@dataclass(frozen=True)
class TaggerParams:
    embed: int = 12
    hidden: int = 16
    window: int = 64  # characters; windows overlap by half
    examples: int = 3000
    steps: int = 260
    batch: int = 64
    rate: float = 0.03
    seed: int = 3


VOCABULARY = 130  # ASCII, other characters, padding
PADDING = 129
N_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(a, 128).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM in each direction (stacked on the first axis), linear layer, CRF."""

    def __init__(self, p: TaggerParams):
        rng, d, h = np.random.default_rng(p.seed), p.embed, p.hidden
        n = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = p
        self.w = {"e": n(VOCABULARY, d) * np.float32(np.sqrt(VOCABULARY) * 0.3), "x": n(2, d, 4 * h), "h": n(2, h, 4 * h), "b": np.zeros((2, 1, 4 * h), np.float32), "o": n(2 * h, N_TAGS), "c": np.zeros(N_TAGS, np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32)}
        self.w["b"][:, :, h : 2 * h] = 1  # forget gates begin open

    def forward(self, x: np.ndarray, keep: bool = False):
        """Tag scores (batch, time, tags) of x (batch, time)."""
        w, h = self.w, self.p.hidden
        n, steps = x.shape
        table = w["e"] @ w["x"] + w["b"]  # (2, vocabulary, 4h)
        order = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, kept = np.zeros((2, n, steps, h), np.float32), []
        for t in range(steps):
            g = state @ w["h"]
            g[0] += table[0][order[0][:, t]]
            g[1] += table[1][order[1][:, t]]
            gates = _sigmoid(g[:, :, : 3 * h])
            i, f, o, z = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :], np.tanh(g[:, :, 3 * h :])
            before, state_before = cell, state
            cell = f * cell + i * z
            tanh = np.tanh(cell)
            state = o * tanh
            out[:, :, t] = state
            if keep:
                kept.append((i, f, o, z, before, tanh, state_before))
        both = np.concatenate((out[0], out[1][:, ::-1]), axis=2)
        scores = both @ w["o"] + w["c"]
        return (scores, both, kept, order) if keep else scores

    def loss_and_gradients(self, x: np.ndarray, tags: np.ndarray):
        w, h = self.w, self.p.hidden
        scores, both, kept, order = self.forward(x, keep=True)
        n, steps, _ = scores.shape
        a = scores.astype(np.float64)
        trans = w["t"].astype(np.float64)
        alpha, beta = np.zeros_like(a), np.zeros_like(a)
        alpha[:, 0] = a[:, 0]
        for t in range(1, steps):
            m = alpha[:, t - 1, :, None] + trans
            top = m.max(axis=1, keepdims=True)
            alpha[:, t] = a[:, t] + top[:, 0] + np.log(np.exp(m - top).sum(axis=1))
        for t in range(steps - 2, -1, -1):
            m = trans + (a[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = m.max(axis=2, keepdims=True)
            beta[:, t] = top[:, :, 0] + np.log(np.exp(m - top).sum(axis=2))
        top = alpha[:, -1].max(axis=1, keepdims=True)
        z = top[:, 0] + np.log(np.exp(alpha[:, -1] - top).sum(axis=1))
        rows = np.arange(n)[:, None]
        gold = a[rows, np.arange(steps), tags].sum(axis=1) + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        loss = (z - gold).mean()
        d = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (a[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        d[rows, np.arange(steps), tags] -= 1
        d = (d / n).astype(np.float32)
        grad = {"t": (pair / n).astype(np.float32), "o": np.tensordot(both, d, ((0, 1), (0, 1))), "c": d.sum(axis=(0, 1)), "h": np.zeros_like(w["h"])}
        back = d @ w["o"].T
        back = np.stack([back[:, :, :h], back[:, ::-1, h:]])
        table = np.zeros((2, VOCABULARY, 4 * h), np.float32)
        ds, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, zz, before, tanh, state_before = kept[t]
            ds = ds + back[:, :, t]
            dc = dc + ds * o * (1 - tanh * tanh)
            dg = np.concatenate((dc * zz * i * (1 - i), dc * before * f * (1 - f), ds * tanh * o * (1 - o), dc * i * (1 - zz * zz)), axis=2)
            grad["h"] += np.matmul(state_before.transpose(0, 2, 1), dg)
            for k in (0, 1):
                np.add.at(table[k], order[k][:, t], dg[k])
            ds, dc = dg @ w["h"].transpose(0, 2, 1), dc * f
        grad["b"] = table.sum(axis=1, keepdims=True)
        grad["x"] = w["e"].T @ table
        grad["e"] = (table @ w["x"].transpose(0, 2, 1)).sum(axis=0)
        return loss, grad

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window, by Viterbi."""
        a = self.forward(x)
        n, steps, _ = a.shape
        best, back = a[:, 0], np.zeros(a.shape, np.int8)
        for t in range(1, steps):
            m = best[:, :, None] + self.w["t"]
            back[:, t] = m.argmax(axis=1)
            best = m.max(axis=1) + a[:, t]
        out = np.zeros((n, steps), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[rows, t, out[:, t]]
        return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, s, e in spans:
        tags[s:e] = 2 + 2 * KINDS.index(kind)
        tags[s] -= 1
    return tags


def train(examples: list[tuple[str, list[Span]]], p: TaggerParams = TaggerParams()) -> Tagger:
    """Adam on random windows of labelled texts."""
    tagger, rng = Tagger(p), np.random.default_rng(p.seed + 1)
    data = [(codes(t), tags_of(len(t), s)) for t, s in examples]
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    for step in range(1, p.steps + 1):
        x, y = np.full((p.batch, p.window), PADDING), np.zeros((p.batch, p.window), np.int64)
        for r, k in enumerate(rng.integers(0, len(data), p.batch)):
            c, t = data[k]
            at = int(rng.integers(0, max(1, len(c) - p.window + 1)))
            part = c[at : at + p.window]
            x[r, : len(part)], y[r, : len(part)] = part, t[at : at + p.window]
        _, grad = tagger.loss_and_gradients(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate, clip = p.rate * (1 - 0.95 * step / p.steps), np.float32(min(1.0, 20 / max(norm, 1e-9)))
        for k, g in grad.items():
            g = g * clip
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            tagger.w[k] = (tagger.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def examples(p: TaggerParams = TaggerParams()) -> list[tuple[str, list[Span]]]:
    """Labelled texts, made by rule: invented words around spans in the patterns' forms and in common other ones, and around numbers that are no personal data."""
    rng = np.random.default_rng(p.seed + 2)
    pick = lambda a: a[int(rng.integers(0, len(a)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = [a + b for a in "bcdfghklmnprstvwz" for b in ("a", "e", "i", "o", "u", "en", "er", "é", "ß", "ó")]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    ascii_word = lambda: re.sub(r"[^a-z]", "", word()) or "x"

    def email():
        local = ascii_word() + pick(["", ".", "_", "-", "+"]) + pick([ascii_word(), digits(2)])
        return local + pick(["@", "@", "@", " @ "]) + ascii_word() + pick(["", digits(1)]) + pick([".example", ""]) + pick([".com", ".org", ".net", ".de"])

    def ip():
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def card():
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(["", "", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{pick('1234')} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}"])

    def plain():
        return pick([digits(4), f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", digits(6), f"{digits(1)}.{digits(1)}.{digits(1)}", f"#{digits(5)}", f"{digits(3)},{digits(3)}.{digits(2)}", "@" + ascii_word()])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(p.examples):
        text, spans = "", []
        for _ in range(int(rng.integers(8, 26))):
            roll = rng.random()
            if roll < 0.09:
                kind = pick(KINDS)
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
            else:
                made = plain() if roll < 0.15 else word()
                made = made.capitalize() if rng.random() < 0.15 else made
            text += made + pick([" ", " ", " ", " ", ", ", ". ", "\n"])
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=2)
def default_tagger(p: TaggerParams = TaggerParams()) -> Tagger:
    return train(examples(p), p)


def _plausible(kind: str, text: str) -> bool:
    n = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(re.fullmatch(r"\S+ ?@ ?\S+\.[A-Za-z]{2,}", text))
    if kind == "ip":
        return text.count(".") == 3 and all(x.isdigit() and len(x) <= 3 for x in text.split("."))
    if kind == "card":
        return 14 <= n <= 19 and luhn(re.sub(r"[^0-9]", "", text)) and not re.search(r"[^0-9 .-]", text)
    return 10 <= n <= 15 and not re.search(r"[^0-9 ().+-]", text)


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger, at_once: int = 2048) -> list[list[Span]]:
    """The tagger's spans of each text that are plausible and overlap no base span."""
    size = tagger.p.window
    half, edge = size // 2, size // 4
    where, rows = [], []
    coded = {}
    for i, t in enumerate(texts):
        if not _ANCHOR.search(t):
            continue
        coded[i] = c = codes(t)
        n = max(1, -(-max(len(c) - size, 0) // half) + 1)
        marks = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))
        near = np.zeros(n + 2, bool)
        for k in (marks // half, marks // half - 1):
            near[np.clip(k, 0, n - 1) + 1] = True
        near = near[1:-1] | near[:-2] | near[2:]
        where += [(i, int(k)) for k in np.flatnonzero(near)]
    labels = {i: np.zeros(len(c), np.int8) for i, c in coded.items()}
    for at in range(0, len(where), at_once):
        part = where[at : at + at_once]
        x = np.full((len(part), size), PADDING)
        for r, (i, k) in enumerate(part):
            piece = coded[i][k * half : k * half + size]
            x[r, : len(piece)] = piece
        for (i, k), y in zip(part, tagger.decode(x)):
            start, n = k * half, len(coded[i])
            a = 0 if k == 0 else edge
            b = size if start + size >= n else size - edge
            b = min(b, n - start)
            labels[i][start + a : start + b] = y[a:b]
    out: list[list[Span]] = [[] for _ in texts]
    for i, y in labels.items():
        t, s, n = texts[i], 0, len(y)
        for s in np.flatnonzero(y % 2 == 1):
            e = s + 1
            while e < n and y[e] == y[s] + 1:
                e += 1
            a, b = int(s), int(e)
            while a < b and t[a] in " \n.,;:":
                a += 1
            while a < b and t[b - 1] in " \n.,;:(-":
                b -= 1
            kind = KINDS[(int(y[s]) - 1) // 2]
            if a < b and _plausible(kind, t[a:b]) and not any(x < b and a < z for _, x, z in base[i]):
                out[i].append((kind, a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + a, key=lambda s: (s[1], KINDS.index(s[0])))) for b, a in zip(base, added_spans(texts, base, tagger))]


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())

    def run(it):
        for b in batches(it, 8 << 20):
            found = find([t or "" for t in b.column("text").to_pylist()], sent.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([joined(a) for _, a in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span, or group of overlapping spans, becomes its first kind in brackets."""
    out, done = [], 0
    for kind, s, e in spans:
        if s < done:  # overlaps what is gone already
            done = max(done, e)
            continue
        out += [text[done:s], f"[{kind.upper()}]"]
        done = e
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The documents, all their columns, with personal data replaced; a null text stays null. n_chars, where there is one, follows."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(it):
        for b in batches(it, 8 << 20):
            texts = b.column(at).to_pylist()
            found = find([t or "" for t in texts], sent.value)
            new = [None if t is None else redact_text(t, a) if a else t for t, (_, a) in zip(texts, found)]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            if chars >= 0:
                old = b.column(chars).to_pylist()
                columns[chars] = pa.array([len(t) if a and t is not None else n for t, n, (_, a) in zip(new, old, found)], b.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
