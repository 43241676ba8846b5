"""Centroids, language model and spelling variants against plain loops, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from tidewave.llm import centroids, lm_score, queries, spelling

DOCS = "doc_id long, text string, lang string, word string, n long, k int, gram long, level int, near string, row long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3, 4, "x", 5) for i, t in texts], DOCS)


# --- centroids


def lloyd(rows, p):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == p.dimension and all(x is not None and math.isfinite(x) and abs(x * p.scale) < 1 << 27 for x in v):
            kept.append((vec_id, [math.floor(p.scale * float(x)) for x in v]))
    first = sorted((hashlib.sha256(f"{p.seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[: p.k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(p.rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if groups[k] else c for k, c in enumerate(centres)]
    return sorted(((i if i is not None else -1, *near(v)[::-1]) for i, v in kept)), centres


@pytest.mark.parametrize("spread", [0, 3, 400])
def test_centroids_against_plain_rounds(spark, spread):
    r = random.Random(spread)
    p = centroids.ClusterParams(k=7, rounds=4, dimension=5)
    rows = [(i, [r.gauss(0, 1) + spread * (i % 4) for _ in range(5)]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 4), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (None, [0.5] * 5), (5, rows[5][1]), (7, [0.25] * 5), (305, [1e30] * 5), (306, [-5e5] * 5), (307, [])]
    table = spark.createDataFrame([(i, v, 3, 4, 0.5) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance long, x double")
    want, centres = lloyd(rows, p)
    got = centroids.clusters(table, p).collect()
    assert sorted((g.vec_id if g.vec_id is not None else -1, g.cluster, g.distance) for g in got) == want
    assert {g.inertia for g in got} == {sum(d for _, _, d in want)}
    for g in got:
        assert g.cluster_inertia == sum(d for _, c, d in want if c == g.cluster)
        assert g.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[g.cluster])).encode()).hexdigest()
    assert centroids.clusters(table.limit(0), p).count() == 0
    assert {g.cluster for g in centroids.clusters(table.where("vec_id = 1"), p).collect()} == {0}
    same = spark.createDataFrame([(i, [2.0] * 5) for i in range(20)], "vec_id long, embedding array<double>")
    assert {(g.cluster, g.distance) for g in centroids.clusters(same, p).collect()} == {(0, 0)}


def test_bounds_skip_scans_and_stay_valid():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 20, (400, 6)) for m in (0, 300, 600, 900)]).astype(np.int64)
    centres = x[[1, 500, 900, 1300]].copy()
    cluster, up, low, _ = centroids.assign(x, np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x)), centres, None)
    for _ in range(3):
        moved = np.stack([x[cluster == c].sum(axis=0) // (cluster == c).sum() for c in range(4)])
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1))
        centres = moved
        cluster, up, low, scanned = centroids.assign(x, cluster, up, low, centres, drift)
        d = np.sqrt(centroids.squared(x, centres))
        assert (cluster == d.argmin(axis=1)).all()
        rows = np.arange(len(x))
        assert (up >= d[rows, cluster] - 1e-6).all()
        d[rows, cluster] = np.inf
        assert (low <= d.min(axis=1) + 1e-6).all()
    assert scanned.mean() < 0.05


def test_squares_of_large_components():
    x, c = np.array([[(1 << 27) - 1, -(1 << 27) + 1]]), np.array([[-(1 << 27) + 1, (1 << 27) - 1]])
    assert centroids.squared(x, c)[0, 0] == 2 * (2 * ((1 << 27) - 1)) ** 2


# --- language model


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_scores(rows, p):
    """doc_id, held_out, n_tokens, n_known, N, base, score, by dictionaries of whole n-grams."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None]
    fold = lambda i: True if i is None else zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in rows:
        if not fold(i):
            words = [None, *split(t)]
            counts.update(tuple(words[j - k : j + 1]) for j in range(1, len(words)) for k in range(p.order) if j >= k)
    total = sum(n for g, n in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def read(g):
        n = counts[g]
        if n < p.min_counts[len(g) - 1]:
            return 0.0
        q = 1 + math.floor(math.log(n, p.base) + 1e-9)
        held = [c for c in range(1, 1 << q) if 1 + math.floor(math.log(c, p.base) + 1e-9) == q]
        return (held[0] + held[-1]) / 2

    out = []
    for i, t in rows:
        words, base, score, known = [None, *split(t)], 0.0, 0.0, 0
        for j in range(1, len(words)):
            base += math.log10((counts[(words[j],)] + 0.5) / (total + 0.5 * (distinct + 1)))
            known += counts[(words[j],)] > 0
            prob = (read((words[j],)) + 0.5) / (total + 0.5 * (distinct + 1))
            for k in range(1, p.order):
                if j >= k:
                    context = read(tuple(words[j - k : j])) if j - k > 0 or k == 1 else read(tuple(words[:j]))
                    prob = (min(read(tuple(words[j - k : j + 1])), context) + p.mu * prob) / (context + p.mu)
            score += math.log10(min(prob, 1.0))
        out.append((i, fold(i), len(words) - 1, known, total, base, score))
    return out


def lm_rows():
    r = random.Random(5)
    words = "the a red green fish tree </s> null é́ x,y Z".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, " \n\t"), (63, "THE the The"), (None, "the unseen word"), (4, rows[4][1]), (64, "only " * 3), (65, "漢字 😀  "), (66, "w" * 30_000)]


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(g) for g in got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-7)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], atol=1e-7)


@pytest.mark.parametrize("table_bytes", [0, 16 * 5, 1 << 20])
@pytest.mark.parametrize("order, base, least", [(3, 2.0, (1, 1, 2)), (2, 1.5, (1, 2))])
def test_language_model_against_dictionaries(spark, table_bytes, order, base, least):
    rows = lm_rows()
    # a filter so large that it gives no false answers
    p = lm_score.LmParams(order=order, base=base, min_counts=least, table_bytes=table_bytes, item_bits=3000, least_bits=2)
    got = lm_score.language_model(documents(spark, rows), p)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(got.collect(), plain_scores(rows, p))


@pytest.mark.parametrize("max_bytes, chunk", [(0, 50), (40_000, 1 << 19), (200_000, 7)])
def test_language_model_beyond_the_filter(spark, monkeypatch, max_bytes, chunk):
    rows = lm_rows()
    monkeypatch.setattr(lm_score, "_CHUNK", chunk)
    p = lm_score.LmParams(table_bytes=16 * 5, item_bits=3000, least_bits=2, max_bytes=max_bytes)
    model = lm_score.fit(documents(spark, [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]), p)
    assert any(model.least) and 8 * model.bits.size <= max_bytes + 8 * 4 and (model.least[0] > 0) == (max_bytes == 0)
    compare(lm_score.scores(documents(spark, rows), model, p).collect(), plain_scores(rows, p))


def test_language_model_asks_no_more_than_it_must(spark, monkeypatch):
    """Below a least level of 2, only texts that were not learned from ask, and only for n-grams whose parts are known."""
    rows, asked, real = lm_rows(), [], lm_score._asked_scores
    monkeypatch.setattr(lm_score, "_asked_scores", lambda slices, model, p: asked.append((slices, model)) or real(slices, model, p))
    p = lm_score.LmParams(table_bytes=16 * 5, item_bits=3000, least_bits=2, max_bytes=580_000)
    compare(lm_score.language_model(documents(spark, rows), p).collect(), plain_scores(rows, p))
    (slices, model), = asked
    assert model.least == (0, 2, 0)
    lengths = [(a.k, len(lm_score._read_sorted(a.grams))) for r in slices.collect() for a in r.asked]
    unlearned = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 == 1]
    assert {k for k, _ in lengths} == {2} and 0 < sum(n for _, n in lengths) < len({g for w in unlearned for g in zip([None, *w], [*w, None])})


@pytest.mark.parametrize("base", [1.5, 2.0])
def test_language_model_counts_what_occurs_once(spark, base):
    """With all but the least level in the table, texts that were learned from need no lookup of the rest."""
    rows = lm_rows()
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    n = Counter(w for _, t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None])
    p = lm_score.LmParams(base=base, table_bytes=16 * sum(c >= base for c in n.values()), item_bits=3000, least_bits=2)
    assert lm_score.fit(documents(spark, train), p).top == 2 and 1 in n.values()
    compare(lm_score.language_model(documents(spark, rows), p).collect(), plain_scores(rows, p))


def test_language_model_in_pieces(spark, monkeypatch):
    rows = lm_rows()
    t, offsets = lm_score.tokens_of(pa.array([x for _, x in rows]))
    whole = lm_score.grams(t, np.arange(len(t)) - np.repeat(offsets[:-1], np.diff(offsets)), 3)
    monkeypatch.setattr(lm_score, "_CHUNK", 7)
    for a, z, lead, part, first in lm_score._slices(t, offsets, 3):
        for (h, there), (h1, there1) in zip(lm_score.grams(part, first, 3), whole):
            assert (there[lead:] == there1[a:z]).all() and (h[lead:][there[lead:]] == h1[a:z][there1[a:z]]).all()


def test_language_model_on_empty_tables(spark):
    rows = documents(spark, [(1, "a b"), (2, None)])
    assert lm_score.language_model(rows.limit(0)).count() == 0
    untrained = lm_score.scores(rows, lm_score.fit(rows.limit(0))).collect()
    assert [(r.base_score, r.score, r.n_known, r.train_tokens) for r in untrained] == [(pytest.approx(0), pytest.approx(0), 0, 0)] * 2


def test_filter_levels_and_bound():
    rng = np.random.default_rng(1)
    gram, level = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(1, 9, 20_000)
    size = int(level.sum()) * 12 // 64
    bits = lm_score.fill(lm_score.shortened(gram, 1), level, size)[None]
    got = lm_score.probe(bits, gram, 9)
    assert (got >= level).all() and (got > level).mean() < 0.03
    assert (lm_score.probe(bits, rng.integers(0, 1 << 63, 20_000).astype(np.uint64), 9) > 0).mean() < 0.03


def test_filter_that_must_leave_out_rare_grams(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    p = lm_score.LmParams(max_bytes=1 << 16, table_bytes=1 << 14)
    model = lm_score.fit(d, p)
    whole = lm_score.fit(d)
    assert model.bits.nbytes <= p.max_bytes < whole.bits.nbytes
    exact = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm_score.scores(d, whole).collect()}
    assert exact == {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm_score.scores(d, model, p).collect()}


def test_context_probabilities_sum_to_one(spark):
    """Over the vocabulary, the unseen share and the levels' rounding are all that is missing from 1, or beyond it."""
    rows = lm_rows()
    vocabulary = sorted({w for _, t in rows for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))})
    p = lm_score.LmParams(order=2, base=1.05, min_counts=(1, 1), item_bits=400, least_bits=2)
    model = lm_score.fit(documents(spark, rows), p)
    texts = documents(spark, [(k, f"red {w}") for k, w in enumerate([*vocabulary, ""])])
    t, offsets = lm_score.tokens_of(pa.array([r.text for r in texts.collect()]))
    first = np.arange(len(t)) - np.repeat(offsets[:-1], np.diff(offsets))
    found = lm_score.grams(t, first, 2)
    logs = lm_score.log_probabilities([lm_score.probe(model.bits, h, model.deepest) for h, _ in found], [x for _, x in found], (model.total, model.distinct), p)
    share = sum(10 ** logs[offsets[:-1] + 2])
    assert 0.9 < share < 1.1


# --- spelling variants


def plain_variants(rows, p):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            if i is not None and p.damage:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % p.damage == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
            if len(run) >= p.least_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= p.least_count}
    near = {w: [v for v in n if spelling.one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v is not None and n[v] >= p.ratio * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def variant_rows():
    r = random.Random(9)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abcabcabc", "Großes", "z" * 300, "z" * 301]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = r.choice(base)
            if r.random() < 0.4:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abc") + w[k:], w[:k] + "b" + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "7", "×", "\n"]).join(words)))
    return rows + [(150, None), (151, ""), (None, "plain words plain words plain words"), (3, rows[3][1]), (152, "÷÷÷÷÷÷ ĀĀĀĀĀ ąąąąą ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ")]


@pytest.mark.parametrize("shard_words, most_pairs", [(20_000, 250_000), (30, 250_000), (30, 40), (20_000, 0)])
def test_variants_against_all_pairs(spark, shard_words, most_pairs):
    rows, p = variant_rows(), spelling.SpellingParams(shard_words=shard_words, most_pairs=most_pairs, damage=7)
    got = spelling.variants(documents(spark, rows), p)
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == plain_variants(rows, p)
    assert len(plain_variants(rows, p)) > 200


def test_variants_of_few_words(spark):
    assert spelling.variants(documents(spark, []).limit(0)).count() == 0
    one = spelling.variants(documents(spark, [(None, "lonely Lonely LONELY word")])).collect()
    assert [tuple(one[0][c] for c in ("word", "n", "n_near", "form", "form_n", "root"))] == [("lonely", 3, 0, None, None, "lonely")]


def test_one_edit():
    assert all(spelling.one_edit(*x) for x in (("abc", "abd"), ("abc", "ab"), ("bc", "abc"), ("", "a"), ("aab", "ab")))
    assert not any(spelling.one_edit(*x) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "a"), ("ab", "cd"), ("abc", "cab")))


def test_queries_on_the_smallest_tables(spark):
    documents_ = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_spelling(spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect())) == plain_variants(documents_, spelling.SpellingParams())
    want = {(r[0]): r for r in plain_scores(documents_, lm_score.LmParams())}
    apart = []
    for r in queries.op12_language_model(spark, SF).collect():
        assert tuple(r)[:5] == want[r.doc_id][:5]
        assert math.isclose(r.base_score, want[r.doc_id][5], rel_tol=1e-9)
        apart.append(abs(r.score - want[r.doc_id][6]))
    # a false answer counts as often as a text repeats itself
    assert sum(apart) < 0.02 * sum(abs(w[6]) for w in want.values())
    assert queries.op11_centroids(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
