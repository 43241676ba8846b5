"""The text operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewave.llm import ann, decontam, langid, near_dedup, pii, quality, queries, skew, sp_encode, substring_dedup, text, toxicity, url_filter
from tidewave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, id long, row long, rank long, h string"
WORDS = "red green blue fish tree stone river cloud seven eight under over again never light".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    long = prose(60_000, 1)
    a, b = prose(80, 2), prose(80, 3)
    texts = [(1, a), (2, a), (3, a.upper()), (4, b), (4, b), (5, None), (6, ""), (7, " \n\t "), (8, long), (9, "one"), (10, "ONE"), (None, a), (None, None), (11, a + " extra"), (12, "mail x.y@z.example.org or +1 (555) 123-4567"), (13, "x" * 50_000), (14, "\u2581\u2581 \n\n a  b\x00"), (15, "漢字 😀 é")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t), 0.5, None, 1, 2, 3, "x") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 0, 0), (None, 1, 1), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_scores_on_awkward_tables(spark, messy, labels, empty):
    none = labels.limit(0)
    for op in (toxicity.toxicity, quality.quality):
        got = op(messy, labels).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in messy.collect())
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id == 4}) == 1
        assert all(r.score == 0.5 for r in op(messy, none).collect())
        assert op(empty, labels).count() == 0
    assert quality.accepted(messy, labels).columns == messy.columns


def test_folds(spark, docs):
    r = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)


def auc(score, y):
    r = np.argsort(np.argsort(score))
    return (r[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for out, label, least in ((toxicity.toxicity(d, lab), "toxic", 0.9), (quality.quality(d, lab), "quality", 0.97)):
        t = out.where("held_out").join(lab, "doc_id").select("score", label).toPandas()
        assert auc(t.score.values, t[label].values) > least
    t = langid.language_id(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (t.lang == t.lang_pred).mean() > 0.97


def test_word_hashes_against_plain_words():
    texts = ["", "One two  TWO", "é́ x", " a\nb ", "b", "two"]
    h, at = text.word_hashes(pa.array(texts), text.NOT_SPACE)
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in texts]
    assert list(np.diff(at)) == [len(w) for w in words]
    seen = {}
    for w, x in zip((w for ws in words for w in ws), h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=60), rng.normal(size=(60, 3))
    bucket, at, extra = np.array([1, 2, 2, 5]), np.array([0, 3, 4]), np.array([[50, 55], [51, 56]])
    got = quality._scores(bucket, at, extra, 0.3, w, v)
    for d, (words, more) in enumerate([([1, 2, 2], [50, 55]), ([5], [51, 56])]):
        x = [(i, 1 / len(words)) for i in words] + [(i, 1.0) for i in more]
        want = 0.3 + sum(w[i] * a for i, a in x) + sum(v[i] @ v[j] * a * b for k, (i, a) in enumerate(x) for j, b in x[k + 1 :])
        assert np.isclose(got[d], want, atol=1e-4)


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.Com/x?y", "http://x.example.com/en/a", "https://www.example.com/en/", "http://b.net/es/1", "http://b.net/es", "http://ads7.example.org/q", "x://thering.example.org#f", "http://com", "http://notexample.com/en/", "http://ads7.example.com/en/z", "http://é.example/p"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(None, urls[3], "h", "p")], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_filter.judge(spark, pages).collect()}
    assert len(got) == len(urls) + 1
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.com", "/x", "com/", "allow")
    assert [got[k].verdict for k in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "block", "allow"]
    assert [got[k].rule for k in (0, 4, 5, 6, 7, 10, 11)] == [None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/"]
    listed = spark.createDataFrame([(x,) for x in [*url_filter.default_blocklist()[-3100:], "b.net/es"]] + [(None,)], "entry string")
    long = spark.createDataFrame([(90, "http://" + "a." * 20_000 + "ads7.example.org/q", "h", "p"), (91, "http://" + "a." * 20_000 + "com/q", "h", "p"), (92, "http://x./", "h", "p"), (93, "http://..com/", "h", "p")], pages.schema)
    both = pages.unionByName(long)
    by_array, by_join = (url_filter.judge(spark, both, blocklist=listed, max_bytes=m) for m in (1 << 20, 1 << 10))
    assert by_array.columns == by_join.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, by_array.collect())) == sorted(map(str, by_join.collect()))
    assert {r.page_id: (r.rule, r.verdict) for r in by_array.collect() if r.page_id and r.page_id >= 90} == {90: (None, "block"), 91: ("com/", "allow"), 92: (None, "allow"), 93: ("com/", "allow")}
    assert {r.page_id: r.verdict for r in by_array.collect()}[7] == "block"
    assert url_filter.judge(spark, pages, blocklist=listed.limit(0), rules=()).where("verdict = 'block' or rule is not null").count() == 0
    assert url_filter.judge(spark, pages.limit(0)).count() == 0
    with pytest.raises(url_filter.ListTooLarge):
        url_filter.judge(spark, pages, max_bytes=10)


def test_digest_collisions(tmp_path):
    a = url_filter.DigestArray.build(["k1", "k2", "k3"], str(tmp_path)).open()
    a.digests = np.zeros(3, np.uint64)
    assert a.contains(["k1", "k2", "k3", "k4"], lambda _: 0).tolist() == [True, True, True, False]


LAST = (1 << 63) - 1


def plain_units(t, p):
    """(first word, number of words) of each unit, and all words, by loops."""
    words = t.lower().split()
    h, _ = text.word_hashes(pa.array([" ".join(words)]), text.NOT_SPACE)
    pair = text.mix64(h * np.uint64(0x9E3779B97F4A7C55) + np.append(h[1:], np.uint64(0))).tolist() if words else []
    lines = [0]
    for line in t.split("\n"):
        lines.append(lines[-1] + len(line.split()))
    begin = [0] if words else []
    for i in range(1, len(words)):
        least = all(pair[i] < x for x in pair[max(0, i - p.radius) : i]) and all(pair[i] <= x for x in pair[i + 1 : i + p.radius + 1])
        if least or i in lines or i - begin[-1] == p.longest:
            begin.append(i)
    return [(i, j - i) for i, j in zip(begin, [*begin[1:], len(words)])], words


def passages_by_brute_force(rows, p):
    """(doc_id, start, end, words, first_doc_id) of removed passages; rows have distinct doc_ids."""
    keyed = {(k if k is not None else LAST): t for k, t in rows if t}
    made = {k: plain_units(t, p) for k, t in keyed.items()}
    first, out = {}, set()
    for k in sorted(made):
        for at, n in made[k][0]:
            first.setdefault(tuple(made[k][1][at : at + n]), (k, at))
    for k, (found, words) in made.items():
        spans, run = [], []
        for u in [*found, None]:
            if u and first[tuple(words[u[0] : u[0] + u[1]])] != (k, u[0]):
                run.append((*u, *first[tuple(words[u[0] : u[0] + u[1]])]))
                continue
            if run and run[-1][0] + run[-1][1] - run[0][0] > p.radius:
                lo, hi, least, most = run[0][0], run[-1][0] + run[-1][1], run[0][0], run[-1][0] + run[-1][1]
                for at, _, source, s_at in run:
                    theirs, x, y = made[source][1], lo, hi
                    while x > max(0, lo - substring_dedup.reach(p)) and 0 < x + s_at - at <= len(theirs) and words[x - 1] == theirs[x - 1 + s_at - at]:
                        x -= 1
                    while y < min(len(words), hi + substring_dedup.reach(p)) and 0 <= y + s_at - at < len(theirs) and words[y] == theirs[y + s_at - at]:
                        y += 1
                    least, most = min(least, x), max(most, y)
                spans.append((least, most, run[0][2]))
            run = []
        joined = []
        for x, y, source in sorted(spans):
            if joined and x <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(y, joined[-1][1]), joined[-1][2])
            else:
                joined.append((x, y, source))
        places = [m.span() for m in re.finditer(r"\S+", keyed[k])]
        out |= {(None if k == LAST else k, places[x][0], places[y - 1][1], y - x, None if s == LAST else s) for x, y, s in joined if y - x >= p.min_words}
    return out


def repeated_words(rows, least):
    """(doc_id, word) of all words in a sequence of `least` words that occurs earlier; rows have distinct doc_ids."""
    first, out = {}, set()
    for _, k, t in sorted(((k if k is not None else LAST), k, t) for k, t in rows if t):
        words = t.lower().split()
        for i in range(len(words) - least + 1):
            if first.setdefault(tuple(words[i : i + least]), (k, i)) != (k, i):
                out |= {(k, j) for j in range(i, i + least)}
    return out


def words_of_passages(rows, found):
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    return {(k, i) for k, t in rows for i, m in enumerate(re.finditer(r"\S+", t or "")) for r in by.get(k, []) if r.start <= m.start() and m.end() <= r.end}


@pytest.mark.parametrize("ids, hot", [(0, 20_000), (1_000_000, 1)])
def test_passages_against_brute_force(spark, docs, messy, empty, ids, hot):
    r, made = random.Random(8), []
    for k in range(40):
        w = prose(r.randint(60, 180), r.randint(0, 12)).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(["edit.", "Cut", "x"])
        made.append((k, " ".join([*prose(r.randint(0, 9), 900 + k).split(), *w[r.randint(0, 20) :]])))
    made += [(50, "again " * 90), (51, "So it goes on.\n" * 30), (None, made[3][1])]
    p = substring_dedup.DedupParams(broadcast_ids=ids, hot=hot)
    for d in (spark.createDataFrame(made, "doc_id long, text string"), docs, messy.dropDuplicates(["doc_id"])):
        rows = [(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()]
        found = substring_dedup.passages(d, p).collect()
        assert {(x.doc_id, x.start, x.end, x.words, x.first_doc_id) for x in found} == passages_by_brute_force(rows, p)
        # the same word over and over has no cuts of its own but every 32 words
        prose_only = [(k, t) for k, t in rows if t and 2 * sum(a == b for a, b in zip(t.split(), t.split()[1:])) < len(t.split())]
        want = repeated_words(prose_only, p.min_words)
        assert len(want - words_of_passages(rows, found)) <= 0.05 * len(want)
    assert substring_dedup.passages(empty, p).count() == 0


def plain_lines(text, least):
    """(paragraph, start, end, words) of the lines and paragraphs of a text."""
    out, inside = [], []

    def close():
        if len(inside) > 1:
            out.append((True, inside[0][1], inside[-1][2], sum((x[3] for x in inside), [])))
        inside.clear()

    at = 0
    for line in (text or "").split("\n"):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", line))
        if found:
            inside.append((False, at + found[0].start(), at + found[-1].end(), [m.group().lower() for m in found]))
            out.append(inside[-1])
        else:
            close()
        at += len(line) + 1
    close()
    return [x for x in out if len(x[3]) >= least]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_lines_against_loops(spark, docs, messy, empty, hot):
    one, two = "a line of five words", "Another one that repeats itself"
    made = [(1, f"{one}\n{two}\n\nshort\nlines of few words\n"), (2, f"x\n  A LINE\tof five words \r\n{two}\n \nshort\nlines of few words"), (3, f"{one}\n{one}\n\n{one}"), (4, f"short\nlines of few words\n{two}"), (5, f"é😀 {one}\n{one}"), (6, None), (7, ""), (None, one), (8, one), (8, one), (9, f"{two}\x0b\n{two}")]
    p = substring_dedup.DedupParams(hot=hot)
    for d in (spark.createDataFrame(made, "doc_id long, text string"), docs, messy.dropDuplicates(["doc_id"])):
        rows = sorted({(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()}, key=lambda x: (x[0] is None, x[0] or 0))
        seen, want = {}, set()
        for k, t in rows:
            for paragraph, a, z, words in sorted(plain_lines(t, p.line_words), key=lambda x: (x[0], x[1])):
                first = seen.setdefault((paragraph, tuple(words)), (k, a, paragraph))
                if first != (k, a, paragraph):
                    want.add((k, a, z, len(words), paragraph, first[0]))
        got = [(x.doc_id, x.start, x.end, x.words, x.paragraph, x.first_doc_id) for x in substring_dedup.repeated_lines(d, p).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.repeated_lines(empty, p).count() == 0
    # after removal no line stands twice
    left = [x.text for x in substring_dedup.dedup(docs, p).select("text").collect()]
    every = Counter(tuple(w) for t in left for paragraph, _, _, w in plain_lines(t, 5) if not paragraph)
    before = Counter(tuple(w) for t in docs.select("text").collect() for paragraph, _, _, w in plain_lines(t.text, 5) if not paragraph)
    again = lambda c: sum(n - 1 for n in c.values())
    assert again(every) < 0.05 * again(before)


def test_merged_spans(spark):
    df = spark.createDataFrame([([(0, 3), (2, 5), (5, 6), (8, 9), (8, 8)],), ([],)], "x array<struct<start:bigint,end:bigint>>")
    assert [[tuple(y) for y in r.m] for r in df.select(substring_dedup.merged(F.array_sort("x")).alias("m")).collect()] == [[(0, 6), (8, 9)], []]


def test_join_with_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    facts = spark.createDataFrame([("hot", 7), ("a", 8), ("c", 9)], "k string, f int")
    want = sorted(map(tuple, rows.join(facts, ["k"]).collect()))
    for limit in (0, 1, 10, 100):
        hot = rows.groupBy("k").count().where(F.col("count") > limit).select("k").where("k is not null")
        assert sorted(map(tuple, skew.join_hot(rows, facts, ["k"], hot).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=150), max_size=4), st.integers(1, 4), st.integers(2, 7))
def test_cuts_against_loops(texts, radius, longest):
    p = substring_dedup.DedupParams(radius=radius, longest=longest)
    u = substring_dedup.units(pa.array([*texts, None], pa.string()), p)
    for i, t in enumerate(texts):
        mine = u["doc"] == i
        assert list(zip(u["at"][mine].tolist(), u["words"][mine].tolist())) == plain_units(t, p)[0]


def test_passage_cut_in_mid_sentence(spark, tmp_path):
    w = prose(60, 4)
    d = spark.createDataFrame([(1, f"It begins {w} and goes on."), (2, f"Others say {w} or nothing. End."), (3, "short " + prose(40, 4))], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert [(x.doc_id, x.words, x.first_doc_id) for x in queries.op2_substring_dedup(spark, str(tmp_path)).collect()] == [(2, 60, 1)]
    got = {x.doc_id: x for x in substring_dedup.dedup(d).collect()}
    assert got[2].text == "Others say  or nothing. End." and len(got[2].removed) == 1 and got[1].removed is None


def test_dedup_of_rows_that_share_an_id_or_have_none(spark):
    a, b, c, d = (prose(80, k) for k in (61, 62, 63, 64))
    rows = [(1, a), (2, f"{a} and {b}"), (2, c), (None, f"{a} {d}"), (None, c), (None, None), (9, b)]
    df = spark.createDataFrame([(k, t, "u", 1, 2) for k, t in rows], "doc_id long, text string, removed string, cut_id long, cut_row long")
    got = substring_dedup.dedup(df)
    assert got.columns == [*df.columns, "removed_"]
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, a), (2, f" and {b}"), (2, c), (None, f" {d}"), (None, ""), (None, None), (9, "")}
    assert all(r.removed == "u" for r in got.collect())


@given(st.text(alphabet="ab.@+-12 9(0)4%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_against_the_patterns(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    assert pii.base_spans(t) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_tagger_gradients():
    p = pii.TaggerParams(embed=3, hidden=2)
    t, rng = pii.Tagger(p), np.random.default_rng(0)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    x, y = rng.integers(0, 20, (2, 5)), rng.integers(0, 9, (2, 5))
    _, g = t.loss_and_gradients(x, y)
    for k, w in t.w.items():
        i = (x[0, 0], 0) if k == "e" else tuple(rng.integers(0, s) for s in w.shape)
        old, losses = w[i], []
        for d in (1e-3, -1e-3):
            w[i] = old + d
            losses.append(t.loss_and_gradients(x, y)[0])
        w[i] = old
        assert np.isclose((losses[0] - losses[1]) / 2e-3, g[k][i], atol=1e-3)


def test_personal_data(spark, messy, empty):
    tagger = pii.default_tagger()
    other = pii.examples(pii.TaggerParams(seed=77, examples=150))
    found = [set(pii.added_spans([t], [[]], tagger)[0]) for t, _ in other]
    assert sum(len(f & set(s)) for f, (_, s) in zip(found, other)) > 0.85 * sum(len(s) for _, s in other)
    got = {r.doc_id: r for r in pii.personal_data(messy.where("doc_id <> 4")).collect()}
    assert (got[12].n_email, got[12].n_phone) == (1, 1) and got[5].spans == "" == got[6].spans
    assert got[6].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[12].base_sha256 == hashlib.sha256(b"email:5:22,phone:26:43").hexdigest()
    red = {r.doc_id: r for r in pii.redacted(messy.where("doc_id in (5, 8, 12)")).collect()}
    assert red[12].text == "mail [EMAIL] or [PHONE]" and red[12].n_chars == len(red[12].text) and red[5].text is None
    assert pii.personal_data(empty).count() == 0
    edge = "a" * 70 + "@" + "b" * 70 + ".com" + " 4111 1111 1111 1111"
    assert pii.find([edge], tagger)[0][0] == [("email", 0, 145), ("card", 146, 165)]


@given(st.text(max_size=40) | st.lists(st.sampled_from([" ", "\u2581", "\n", "a", "the", "<s>", "</s>", "<0x0A>", "é", "😀", "  ", "x.", "\t"]), max_size=20).map("".join))
@settings(max_examples=500, deadline=None)
def test_chunks_against_the_library(t):
    sp = library()
    known, _ = sp_encode.chunks(pa.array([t, "a b\n c", None, ""]))
    h1, h2 = sp_encode._hashes(known)
    ids = sp_encode.segment([c.decode() for c in known.to_pylist()], sp)
    first = np.unique(h1, return_index=True)[1][::2]  # a table that lacks every other chunk
    table = sp_encode.ChunkTable(h1[first], h2[first], np.cumsum([0, *(len(ids[i]) for i in first)]), np.array([x for i in first for x in ids[i]], np.int32))
    texts = [t.replace(sp_encode.MARK, "_"), "", f"b {t} a".replace(sp_encode.MARK, "\n"), None, "a b"]
    got, at = sp_encode.ids_of(pa.array(texts), table, sp)
    assert [got[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [sp.encode(x or "") for x in texts]


def library():
    return sp_encode.processor(Path(sp_encode.default_model()).read_bytes())


@pytest.mark.parametrize("table_bytes", [128 << 20, 2000, 0])
def test_encode(spark, messy, docs, empty, table_bytes):
    sp = library()
    for d in (messy, docs):
        found = sp_encode.encode(d, table_bytes=table_bytes).collect()
        want = sorted((str(r.doc_id), sp.encode(r.text or "")) for r in d.collect())
        assert sorted((str(r.doc_id), r.ids) for r in found) == want
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert all(r.decoded == sp.decode(r.ids) and r.n_tokens == len(r.ids) and r.decoded_sha256 == sha(r.decoded) and r.ids_sha256 == sha(",".join(map(str, r.ids))) for r in found)
    assert sp_encode.encode(empty, table_bytes=table_bytes).count() == 0


def test_repeated_chunks_are_in_the_table(spark):
    d = spark.createDataFrame([("twice here twice",), ("here once",), (None,)], "text string")
    proto = spark.sparkContext.broadcast(Path(sp_encode.default_model()).read_bytes())
    table = sp_encode.chunk_table(d, proto, 1 << 20)
    found, _ = sp_encode.chunks(pa.array([" twice", "here"]))
    assert sorted(table.h1.tolist()) == sorted(sp_encode._hashes(pa.array([b" twice", b" here"]))[0].tolist()) and len(found) == 2


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)) + rng.normal(size=(10, 24))[rng.integers(0, 10, 1500)] * 2
    x[200:260] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0]), (None, [1.0] * 24), (5200, [None] * 24)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(v).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 1500, 50))
    hits = 0
    for q, found in got.items():
        s = ann.cosine(x[q], x)
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s))[:5]
        hits += len({i for i, _ in found.values()} & set(best))
        assert sorted(found) == [1, 2, 3, 4, 5] and all(s[i] == w for i, w in found.values())
    assert hits >= 0.9 * 5 * len(got)
    assert [i for i, _ in (got[200][k] for k in range(1, 6))] == [100, 201, 202, 203, 204]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(few).orderBy("rank").collect()] == [2, 1]
    small = ann.search(v, ann.AnnParams(block=100, query_block=8)).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in small if r.query_id == 200} == {(200, k, i, w) for k, (i, w) in got[200].items()}
    assert ann.search(v.limit(0)).count() == 0


def test_nearest_on_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    size = 10.0 ** rng.choice([-200, 0, 200], 300)
    rows = [(i, [float(c * k) for c in r], None, 1.0, i) for i, (r, k) in enumerate(zip(x, size))] + [(7, [float(c) for c in x[7] * size[7]], None, 1.0, 0)]
    rows += [(1000 + i, [float(c) for c in rng.normal(size=3)], "x", 0.0, i) for i in range(10)] + [(1000, [0.0, 0.0, 1.0], "x", 0.0, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, e string, v double, list long")
    got = ann.search(v, ann.AnnParams(probed=1.0)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        s = unit @ unit[q]
        s[q] = -9
        assert [i for _, i, _ in mine] == list(np.argsort(-s)[:5]) and np.allclose([w for *_, w in mine], np.sort(s)[::-1][:5], atol=1e-12)
    assert {r.vec_id for r in got if r.query_id == 1000} <= set(range(1001, 1010)) and max(r.rank for r in got if r.query_id == 1000) == 5
    assert ann.bundles(np.array([3, 4, 0, 25, 2, 9]), 10)[0].tolist() == [0, 0, 0, 1, 4, 5]


def linked(rows, width, percent=80):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, near_dedup.NearParams(shingle=width)).collect()}
    assert got == linked([(r.doc_id, r.text) for r in docs.collect()], width)


def test_near_duplicate_families(spark):
    """Chains of edited copies around the threshold, in groups larger than a block."""
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = prose(60, 100 + g).split()
        for k in range(60):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = near_dedup.NearParams(shingle=2, block=8)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(d, p).collect()} == linked(rows, 2)


def test_near_duplicates_on_awkward_tables(spark, messy, empty):
    got = near_dedup.near_duplicates(messy, near_dedup.NearParams(shingle=2)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == messy.count()
    assert [by[k].component_id for k in (1, 2, 3, 4, 5, 6, 9, 10, 11)] == [1, 1, 1, 4, 5, 6, 9, 9, 1]
    assert [by[k].n_shingles for k in (5, 6, 7, 9)] == [0, 0, 0, 1]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = near_dedup.deduplicated(messy, near_dedup.NearParams(shingle=2))
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, None} and kept.where("doc_id in (2, 3, 10, 11)").count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (prose(60, k) for k in (71, 72, 73))
    rows = [(3, a), (5, a), (5, b), (7, b + " one"), (8, c), (8, ""), (9, c), (9, prose(60, 74)), (10, prose(60, 74)), (11, prose(60, 75)), (11, prose(60, 75)), (None, a)]
    d = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, gone long, contaminated_md5 long, of_id long")
    for p in (near_dedup.NearParams(), near_dedup.NearParams(hot=1, crowd=1, broadcast_ids=0)):
        got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(d, p).collect()}
        assert got == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (10, 8), (11, 11), (None, None)}
        left = near_dedup.deduplicated(d, p)
        assert left.columns == d.columns and Counter(r.doc_id for r in left.collect()) == {3: 1, 8: 2, 11: 2, None: 1}


def test_hot_buckets(spark):
    r = random.Random(4)
    base = prose(80, 5).split()
    rows = []
    for k in range(300):
        w = list(base)
        w[r.randrange(80)] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(300 + k, prose(40, 500 + k // 2)) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    cold, hot = ({(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(d, near_dedup.NearParams(shingle=2, hot=h, crowd=h)).collect()} for h in (10_000, 8))
    assert cold == hot and {c for _, c in hot} == {0, *range(300, 360, 2)}


def test_pruning_keeps_pairs_at_the_threshold():
    from math import comb

    for n, least in near_dedup.least_matches(near_dedup.NearParams()):
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least)) < 2e-6


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_on_awkward_tables(spark, messy, empty):
    item = " ".join(prose(80, 2).split()[10:30])
    bench = spark.createDataFrame([(1, item), (2, "one"), (3, None), (4, "..."), (None, item.upper()), (2, "one")], "item_id long, text string")
    got = decontam.decontaminate(messy, bench).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == messy.count()
    assert (by[1].n_hit, by[1].n_items, by[1].spans, by[1].contaminated) == (20, 2, "10:30", True)
    assert (by[9].n_hit, by[9].n_words, by[10].n_hit) == (1, 1, 1) and by[9].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert (by[5].n_words, by[5].contaminated, by[13].n_hit) == (0, False, 0) and by[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, decontam.decontaminate(messy, bench, max_bytes=0).collect())) == sorted(map(str, got))
    more = messy.withColumn("contaminated_md5", F.lit("x")).withColumn("w", F.lit(1)).withColumn("hits", F.lit(2))
    assert sorted(map(str, decontam.remove_contaminated(more, bench, max_texts=0).collect())) == sorted(map(str, decontam.remove_contaminated(more, bench).collect()))
    left = decontam.remove_contaminated(messy, bench)
    assert left.columns == messy.columns and left.where("doc_id in (1, 2, 3, 9, 10, 11)").count() == 0 and left.where("doc_id in (4, 5, 8)").count() == 4
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(messy, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_language_on_awkward_tables(spark, messy, empty):
    got = {r.doc_id: r for r in langid.language_id(messy).collect()}
    assert got[5].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.language_id(empty).count() == 0
    assert {r.lang_pred for r in langid.language_id(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def longest_phrases(t, train):
    """Phrases of a text, by search in the training text."""
    n = i = 0
    while i < len(t):
        j = i + 1
        while j <= len(t) and t[i:j] in train:
            j += 1
        n += 1
        i = max(j - 1, i + 1)
    return n


def test_cross_parsing_against_search():
    train = {"x": ["abcabd cab bad dab"], "y": ["zzzy yzz zxy xyz"]}
    p = langid.LangParams(block=8)
    m = langid.build(train, p)
    lut = langid._symbols(m.chars)
    r = random.Random(2)
    for _ in range(200):
        t = r.choice(["", "abcabd cab bad dab" * 3, "zzzy yzz" * 4]) + "".join(r.choice("abcdxyz ") for _ in range(r.randint(1, 40)))
        got = langid.phrases([t], m, lut, p.block)[0]
        for k, lang in enumerate(m.langs):
            if set(t) <= set(train[lang][0]):
                assert got[k] == longest_phrases(t, train[lang][0])


def test_every_script_and_language(spark):
    r = random.Random(7)
    scripts = {"latin": range(97, 123), "cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "han": range(0x4E00, 0x4E00 + 400)}
    rows, k = [], 0
    for lang, span in {**scripts, **{f"l{i}": range(0x5000 + 40 * i, 0x5000 + 40 * i + 30) for i in range(70)}}.items():
        words = ["".join(chr(r.choice(span)) for _ in range(r.randint(2, 6))) for _ in range(60)]
        for _ in range(12):
            rows.append((k, " ".join(r.choice(words) for _ in range(40)), lang))
            k += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: lang for i, _, lang in rows}
    assert all(truth[x.doc_id] == x.lang_pred for x in langid.language_id(d).collect())


@pytest.mark.parametrize("alphabet,size", [(0, 1 << 20), (2, 1 << 20), (96, 100)])
def test_cross_parsing_with_searched_letters(alphabet, size):
    train = {"x": ["abcabd cab bad dab"], "y": ["zzzy yzz zxy xyz \u4e00\u4e01"]}
    p = langid.LangParams(block=8, alphabet=alphabet, table_bytes=size)
    m = langid.build(train, p)
    r = random.Random(2)
    for _ in range(100):
        t = "".join(r.choice("abcdxyz \u4e00\u4e02") for _ in range(r.randint(1, 40)))
        got = langid.phrases([t], m, langid._symbols(m.chars), p.block)[0]
        want = langid.phrases([t], langid.build(train, langid.LangParams(block=8)), langid._symbols(m.chars), p.block)[0]
        assert list(got) == list(want)
        for k, lang in enumerate(m.langs):
            if set(t) <= set(train[lang][0]):
                assert got[k] == longest_phrases(t, train[lang][0])


def test_languages_that_share_their_beginnings(spark):
    r = random.Random(9)
    head, words = "the same header " * 30, {"a": "kivo tamu leri", "b": "zhun gwep drox"}
    rows = [(k, head + " ".join(r.choice(words[lang].split()) for _ in range(600)), lang) for k, lang in enumerate("ab" * 60)]
    rows += [(1000 + k, " ".join(words[lang].split() * 20), lang) for k, lang in enumerate("ab")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d.where("doc_id < 1000"))
    assert {x.doc_id: x.lang_pred for x in langid.language_id(d, model=model).where("doc_id >= 1000").collect()} == {1000: "a", 1001: "b"}


def test_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        f = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))  # noqa: B023, E731
        assert f(got) == f(want), name
