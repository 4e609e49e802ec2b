"""Operators 11 to 13 against plain restatements of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import lexical, queries, runs, suffix

from helpers import DOCS, LOWER, SF, WORDS, awkward

CLASH = "id row m at n key rank score block doc"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 11 suffix arrays


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(3)
    for _ in range(3000):
        n, k = rng.randint(0, 25), rng.randint(1, 4)
        s = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffix.suffix_array(s) == sorted(range(n + 1), key=lambda i: s[i:])
    for s in ([1] * 500 + [0], [1, 2] * 300 + [0], list(range(300, 0, -1)) + [0], list(range(1, 300)) + [0], ([2] * 20 + [1]) * 20 + [0]):
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix.suffix_array([0]) == [0]


def brute_repeats(texts):
    """[(bytes, spans)] of each text: a byte goes if a string of 200 bytes over it starts twice anywhere."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    out = []
    for x in data:
        flags = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                flags[i] += 1
                flags[i + 200] -= 1
        gone = np.concatenate(([False], np.cumsum(flags[:-1]) > 0, [False])).astype(int)
        edges = np.flatnonzero(np.diff(gone))
        out.append((x, list(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    return out


def repeated_texts(seed):
    """Texts that share passages, with edits, within and across documents, of many bytes a letter and of few letters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(30, 120)) for _ in range(6)]
    out = [prose(rng.randint(0, 150)) for _ in range(15)]
    for _ in range(60):
        p = rng.choice(passages)
        if rng.random() < 0.5:
            k = rng.randrange(len(p))
            p = p[:k] + rng.choice("xyz") + p[k + rng.randint(0, 2) :]
        lo = rng.randrange(20)
        out.append(prose(rng.randint(0, 9)) + " " + p[lo : len(p) - rng.randrange(20)] + rng.choice(["", " " + prose(5), " " + p]))
    out += ["a" * 199, "a" * 200, "b" * 201, "c" * 5000, "ab" * 150, "ba" * 101 + "q" + "ab" * 100, "", None, passages[0], passages[0], "abc" * 900 + "d" + "abc" * 66]
    return out


@pytest.mark.parametrize("hot", [1 << 20, 1])
def test_removed_bytes(spark, monkeypatch, hot):
    """Also with every bucket spread string by string."""
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = repeated_texts(hot)
    rows = suffix.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, (data, spans) in enumerate(brute_repeats(texts)):
        assert [tuple(s) for s in got[i].spans] == spans, i
        assert got[i].n_bytes == len(data)
        keep = np.ones(len(data), bool)
        for a, b in spans:
            keep[a:b] = False
        assert bytes(got[i].kept) == np.frombuffer(data, np.uint8)[keep].tobytes()


def test_pieces_hold_every_string_once():
    """Every string of 200 bytes lies in one piece; equal strings have one bucket; long texts are cut."""
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (0, 150, 200, 700, 5000)] + [b"x" * 6000]
    texts[4] += texts[3]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    met, bucket = Counter(), {}
    for row, at, n, m, _, s, e in suffix.pieces_of(buf, off):
        for r, a, k, b, x, y in zip(row.tolist(), at.tolist(), n.tolist(), m.tolist(), s.tolist(), e.tolist()):
            assert texts[r][a : a + k] == buf[x:y].tobytes() and k <= suffix.LONGEST + 199
            for i in range(a, a + k - 199):
                met[r, i] += 1
                assert bucket.setdefault(texts[r][i : i + 200], b) == b
    assert met == {(r, i): 1 for r, t in enumerate(texts) for i in range(len(t) - 199)}


def test_suffix_edges(spark):
    found = suffix.remove_repeats(awkward(spark, CLASH)).collect()
    assert len(found) == 10
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert [len(r.kept) for r in by_id[6]] == [34, 34]  # short copies stay
    assert [(r.n_bytes, bytes(r.kept), r.spans) for r in by_id[1]] == [(0, b"", [])] and by_id[None][0].n_bytes == len("some words without any id here today")
    long = spark.createDataFrame([(None, "z" + "long repeated row " * 20)] * 2 + [(7, "short")], "doc_id string, text string")
    assert sorted(len(r.kept) for r in suffix.remove_repeats(long).collect()) == [0, 0, 5]
    empty = spark.createDataFrame([], DOCS)
    assert suffix.remove_repeats(empty).collect() == []


# -- 12 ranked search

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall


def brute_search(docs, items, k=10):
    tf = [(d, Counter(TERMS((t or "").translate(LOWER)))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    big_n, big_l = len(tf), sum(n for *_, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = {}
    for item, text in items:
        scores = []
        for d, c, n in tf:
            m = 100 - 75 + (75 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERMS((text or "").translate(LOWER)) if t in c)
            if s > 0:
                scores.append((-s, d))
        out[item] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def ranked(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.item_id, r.rank)):
        assert r.rank == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


@pytest.mark.parametrize("group_terms", [lexical.GROUP_TERMS, 300])
def test_search_on_the_tables(spark, docs, monkeypatch, group_terms):
    """Also with queries in several groups."""
    monkeypatch.setattr(lexical, "GROUP_TERMS", group_terms)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = ranked(lexical.search(lexical.build(docs), items).collect())
    assert got == {i: x for i, x in want.items() if x}


def test_search_with_ties_and_few_hits(spark):
    """Equal scores go by id, also where they fill more than k places and lie in several blocks."""
    rows = [(i, f"same words here {'rare' if i in (5, 900) else ''}") for i in range(1200)] + [(i, "others") for i in range(2000, 3500)] + [(5000, None), (5001, "!!!")]
    items = [(1, "SAME words, same"), (2, "rare"), (3, "nowhere"), (4, None), (5, "rare rare rare same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ranked(lexical.search(lexical.build(df), spark.createDataFrame(items, "item_id long, text string"), k=4).collect())
    want = brute_search(rows, items, 4)
    assert got == {i: x for i, x in want.items() if x} and [d for d, _ in got[1]] == [0, 1, 2, 3] and len(got[2]) == 2


def test_search_edges(spark):
    index = lexical.build(awkward(spark, CLASH))
    items = spark.createDataFrame([(1, "repeat me exactly once", "x"), (None, "漢字 ünïcode", "x"), (1, "repeat me exactly once", "x")], "item_id long, text string, row string")
    rows = lexical.search(index, items).collect()
    assert sorted((r.doc_id, r.rank) for r in rows if r.item_id == 1) == [(6, 1), (6, 1), (6, 2), (6, 2)]
    assert [r.doc_id for r in rows if r.item_id is None] == [7]  # Ü isn't lower-cased
    assert lexical.search(lexical.build(spark.createDataFrame([], DOCS)), items).collect() == []
    assert lexical.search(index, spark.createDataFrame([], "item_id long, text string")).collect() == []
    named = spark.createDataFrame([("b", "one two"), (None, "one two"), ("a", "one two")], "doc_id string, text string")
    rows = lexical.search(lexical.build(named), spark.createDataFrame([(9, "two")], "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.rank)] == ["a", "b", None]


def test_blocks_under_the_threshold_are_not_scored(monkeypatch):
    q = lexical._Queries.of([(0, "needle hay")])
    q.weigh(np.array([2, 90]), 100)
    scored = []
    score = lexical._Block.score
    monkeypatch.setattr(lexical._Block, "score", lambda self, *a: scored.append(len(self.ids)) or score(self, *a))
    open_ = lexical._cut_blocks(pa.int64())
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 10)
    monkeypatch.setattr(lexical.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    texts = ["hay " * 3] * 200 + ["needle hay"] * 2 + ["hay"] * 98
    raw = list(open_(iter([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["id", "t"])])))
    done = list(lexical._finish_blocks(300, 900, pa.int64())(pa.record_batch(b.select(["block", "terms", "held", "docs", "tf", "ids", "lengths"])) for b in raw))
    (out,) = lexical._rank_blocks(q, 2, np.zeros(1), pa.int64())(b.select(["terms", "most", "held", "docs", "impact", "ids"]) for b in done)
    assert sorted(out.column("doc_id").to_pylist()) == [200, 201] and len(done) == 30 and len(scored) < 5


def test_long_text_is_read_by_slices():
    text = "wörd " * 300_000 + "x" * 1_200_000 + " last"
    assert sum(map(len, lexical.terms_of(text))) == 300_002
    known, ids = runs.word_ids(text)
    assert known == ["wörd", "x" * 1_200_000, "last"] and len(ids) == 300_002


# -- 13 runs


def brute_runs(w, least=6, periods=4):
    """Every stretch of equal words q apart, the smallest q for each place."""
    n, out = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for t in range(6000):
        n, k = rng.randint(0, 40), rng.randint(1, 4)
        w = [rng.randrange(k) for _ in range(n)]
        if t % 3 == 0 and n > 5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert runs.runs(w) == brute_runs(w)
        assert runs.runs(w, 2, 2) == brute_runs(w, 2, 2)
    with pytest.raises(ValueError):
        runs.runs([1, 1], least_periods=1)


def test_runs_of_long_sequences(monkeypatch):
    """Highly repetitive sequences stay linear; flat arrays give what lists give."""
    from array import array

    fib = [[0], [0, 1]]
    while len(fib[-1]) < 50_000:
        fib.append(fib[-1] + fib[-2])
    nest = ([1] * 50 + [2] + [1] * 50 + [3]) * 500
    assert runs.runs([1] * 200_000) == [(0, 200_000, 1)]
    assert runs.runs(list(range(5000)) * 40) == [(0, 200_000, 5000)]
    assert runs.runs(fib[-1]) == []  # exponents under 4
    small = runs.runs(nest)
    monkeypatch.setattr(runs, "_LONG", 10)
    assert runs.runs(array("i", nest)) == small and len(small) == 1001


def described(doc_id, text, plant):
    w = WORDS(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        n, len(found), *top, top[0] is not None and 1000 * top[1] // top[2] or None,
        sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()),
    )


def test_runs_on_the_tables(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    short = {d: t for d, t in texts.items() if len(t or "") < 6000}
    assert len(got) == len(texts) and {d: got[d] for d in short} == {d: described(d, t, True) for d, t in short.items()}
    assert sum(v[1] > 0 for v in got.values()) > 5


def test_runs_edges(spark):
    rows = [(1, "a a a a a a"), (2, "a A a A a A a A"), (3, "x " * 5), (4, "é\té\né é  é é end"), (5, "p q p q p q p q p"), (None, "b b b b b b b"), (6, None), (6, " \n")]
    got = {(r[0], r[1]): tuple(r)[1:] for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, len(WORDS(t or ""))): described(d, t, False) for d, t in rows}
    assert got[1, 6][1:6] == (1, 0, 6, 1, 6000) and got[2, 8][2:5] == (0, 8, 2) and got[3, 5][1] == 0
    assert runs.periodic_runs(awkward(spark, CLASH)).count() == 10
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
