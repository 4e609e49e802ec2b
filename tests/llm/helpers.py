"""Plain restatements of the contracts, and awkward rows for every operator."""

import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def fold(doc_id, folds=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def lower_words(text):
    return WORDS((text or "").translate(LOWER))


def shingle_set(text, size=5):
    w = lower_words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(docs, percent=85):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        common = Counter(o for s in sets[d] for o in holders[s])
        for o, k in common.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[o]) - k):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def brute_contaminated(docs, items, share=0.5):
    """(doc, item) pairs of (id, text) rows where the document has at least ``share`` of the item's windows of five words, by plain containment."""

    def windows(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    grams = {i: windows(t) for i, t in items}
    return {(d, i) for d, t in docs for own in [windows(t)] for i, g in grams.items() if g and len(g & own) >= share * len(g)}


def awkward(spark, extra=""):
    """Nulls in every column, empty, long, one-word and repeated rows."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, "en", "src0", None), (2, "", None, None, 0), (None, "some words without any id here today", "en", "src1", 5), (3, " \n\t ", "de", "src2", 4), (4, "single", "fr", None, 6),
        (5, long_text, "en", "src3", len(long_text)), (6, "repeat me exactly once more please", "en", "src4", 10), (6, "repeat me exactly once more please", "en", "src4", 10),
        (7, "Ünïcode ß 漢字 𝄞 and more words of it", "de", "nowhere", 1), (8, "!!! ??? 123 456", "es", "src5", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in extra.split():
            df = df.withColumn(c, F.lit("x"))
    return df
