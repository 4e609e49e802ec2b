"""Periodic run detection: maximal repetitions of words by Lyndon arrays on the ordered alphabet of words.

A run's smallest period is the length of a Lyndon word that is the longest one
at its place under one of two orders, the alphabet's and its reverse (the end
of a text is less than any word in both).  So each order is swept once from
right to left: every place gets the next place whose suffix is less, and how
far both suffixes agree.  What was matched is used again instead of compared
again: beside the extension of the place that was passed last, a new one is
either the smaller of two known ones or goes on where they end, and a whole
period matched goes on with the extension one period later.  Each run is then
read off at its leftmost root, with fewer than a period of steps to the left.
Words are only compared, through their ranks; no suffix structures or
fingerprints.

Runs belong to one document, so documents stay in their tasks and nothing is
shuffled; a task takes one document at a time, long ones in about 30 bytes a
word plus their distinct words.

Cases: a null, empty or blank text has no words and no runs (the digests are
those of the empty text); equal words count as equal byte by byte, case
included; runs that end at a text's end are runs; among longest runs the first
by start, then period, is named; repeated rows and rows without an id are
answered one by one; other columns are never read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

LEAST_LENGTH = 6
LEAST_PERIODS = 4
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_GAP = re.compile("[\x20\x09-\x0d]")
#: Characters that are split into words at a time.
_SLICE = 1 << 20
#: From so many words on places are kept in flat arrays.
_LONG = 1 << 17
FIELDS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_ids(text: str | None) -> tuple[list[str], array]:
    """The distinct words of a text, and the number of each of its words among them."""
    known: dict[str, int] = {}
    ids = array("i")
    text = text or ""
    lo = 0
    while lo < len(text):
        hi = lo + _SLICE
        if hi < len(text):
            gap = _GAP.search(text, hi)
            hi = gap.start() if gap else len(text)
        words = _WORDS.findall(text, lo, hi)
        for w in words:
            if w not in known:
                known[w] = len(known)
        ids.extend(map(known.__getitem__, words))
        lo = hi
    return list(known), ids


def _roots(w: list | array, found: set[tuple[int, int, int]], least_length: int, least_periods: int) -> None:
    """Adds (start, length, period) of the runs whose Lyndon roots are longest under the order of ``w``'s numbers."""
    n = len(w)
    room = (lambda: array("i", bytes(4 * (n + 1)))) if n >= _LONG else (lambda: [0] * (n + 1))
    after, agree, beside = room(), room(), room()
    less = False  # whether suffix i is less than suffix i + 1
    after[n] = n
    for i in range(n - 1, -1, -1):
        j = i + 1
        if j == n:
            after[i] = n
            less = False
            continue
        a, b = w[i], w[j]
        if a != b:
            k = 0
            less = a < b
        else:
            k = 1 + beside[j]  # and the order is that one place later
        beside[i] = k
        smaller = less
        while smaller:
            nxt, known = after[j], agree[j]
            j = nxt
            if j == n:
                k = 0
                break
            if k > known:
                k = known
                break
            if k == known:
                period = j - i
                while True:
                    if k == period and after[j] == j + period:
                        k += agree[j]
                        smaller = False
                        break
                    if j + k >= n:
                        smaller = False
                        break
                    a, b = w[i + k], w[j + k]
                    if a != b:
                        smaller = a < b
                        break
                    k += 1
        after[i] = j
        agree[i] = k
    for i in range(n):
        j, k = after[i], agree[i]
        p = j - i
        if k > (least_periods - 2) * p and j < n:  # else fewer than a period to the left can't make up for it
            if i >= p and after[i - p] == i and agree[i - p] >= p:
                continue  # not the leftmost root
            left = 0
            while left < i and w[i - left - 1] == w[j - left - 1]:
                left += 1
            length = left + p + k
            if length >= least_length and length >= least_periods * p:
                found.add((i - left, length, p))


def runs(w: list | array, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of at least ``least_length`` places and ``least_periods`` (two or more) periods, in order of start, then period.

    ``w``: numbers, equal where the symbols are equal, in any fixed order.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    found: set[tuple[int, int, int]] = set()
    if len(w) >= max(least_length, 2):
        w = w if len(w) < _LONG else array("i", w)
        _roots(w, found, least_length, least_periods)
        _roots([-x for x in w] if len(w) < _LONG else array("i", (-np.frombuffer(w, np.int32)).tobytes()), found, least_length, least_periods)
    return sorted(found, key=lambda r: (r[0], r[2]))


def keeps(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n places stay when each run keeps its first period alone."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def _described(known: list[str], ids: array) -> tuple:
    small = len(ids) < _LONG
    found = runs(ids.tolist() if small else ids)
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
    stay = keeps(len(ids), found) if found else np.ones(len(ids), bool)
    places = np.frombuffer(ids, np.int32)[stay].tolist() if small else memoryview(array("i", np.frombuffer(ids, np.int32)[stay].tobytes()))
    collapsed = hashlib.sha256(" ".join(map(known.__getitem__, places)).encode("utf-8", "surrogatepass")).hexdigest()
    if not found:
        return len(ids), 0, None, None, None, None, digest, collapsed
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
    return len(ids), len(found), start, length, period, 1000 * length // period, digest, collapsed


Change = Callable[[str, array], array]


def planted(doc_id: str, ids: array) -> array:
    """The numbers of a document's words, every tenth document (by its id's crc32) with a tail that repeats: the input that the contract names."""
    h = zlib.crc32(doc_id.encode())
    n, g = len(ids), h // 10
    if h % 10 or not n:
        return ids
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    block = ids[a : a + period]
    return ids[:a] + (block * (-(-(n - a) // len(block))))[: n - a]


def _detect(change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(1), b.column(2), strict=True):
                known, ids = word_ids(text.as_py())
                rows.append(_described(known, change(key.as_py() or "", ids) if change else ids))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Change | None = None) -> DataFrame:
    """One row for each document: its words, its runs, the longest one and the digests of all runs and of the text with each run cut to its first period.

    ``change`` may replace the word numbers before they are searched.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(tidy(_detect(change)), f"doc_id {kind}, {FIELDS}")
