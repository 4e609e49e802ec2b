"""Suffix-array dedup: bytes under strings of ``LEAST`` bytes that occur anywhere else are removed.

The suffix array comes from linear grouping: suffixes are grouped by their
Lyndon prefixes, groups are processed in descending order, each extending by
its own prefix the suffixes that its previous-smaller pointers lead to, and a
last scan emits every group in order along the same pointers; nothing is
renamed and nothing recurses (``suffix_array``).

A corpus doesn't fit one array, so strings are dealt out by content.  Each
string of ``LEAST`` bytes belongs to the bucket of the least hash among its
substrings of ``ANCHOR`` bytes; neighbouring strings of one bucket form a
piece.  Equal strings are in one bucket, whatever their documents.

1. Pieces (bucket, digest, place) are made in one pass; buckets met once go.
2. A piece that occurs twice or more is repeated as a whole; copies are counted
   where they lie and never gathered.  A piece that occurs once, in a bucket
   with others, is contested; so is one whose bucket's hash comes twice in it.
3. One text of each contested piece goes to its bucket.  Buckets fill arrays of
   bounded size; two suffixes that agree on ``LEAST`` bytes lie side by side.
   Before, what has no second occurrence of its ``TRIM``-byte substrings in the
   bucket is cut off, and equal stretches are settled together.
4. Buckets with more than ``HOT`` bytes of different pieces are spread string by string,
   under a digest of each, so no task gathers a hot passage's surroundings.

Digests are MD5; strings that meet in an array are compared byte by byte.  All
documents are saved once with a row number, so every pass sees the same rows.

Cases: a null or empty text has no bytes and loses none (its digest is that of
no bytes); texts under ``LEAST`` bytes stay whole; matches don't cross
documents; repeated rows are copies of each other, and both lose what they
share; an id has no part in it and may be null or repeat; very long texts are
read in stretches; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import discard, handed, own_session, saved, tidy

LEAST = 200
ANCHOR = 64
TRIM = 64
#: Bytes of a bucket's different pieces that still go to one task, and strings of a piece at most.
HOT = 1 << 20
LONGEST = 2048
#: Bytes of text that fill one array, and that one task is meant to read.
ARRAY_BYTES = 128 << 10
TASK_BYTES = 1 << 20
_STRETCH = 1 << 18
#: Rows of an Arrow batch: texts and pieces lie in it several times over.
_BATCH_ROWS = 1000
_PIECES = "m long, d1 long, d2 long, row long, at int, n int, twice boolean"


def suffix_array(s: list[int]) -> list[int]:
    """The suffixes of ``s`` in ascending order; its last number is 0 and the others are greater."""
    n = len(s)
    order = np.argsort(np.array(s), kind="stable")
    first = np.searchsorted(np.sort(np.array(s)), np.array(s)) if n else order
    sa, group = order.tolist(), first.tolist()
    place = [0] * n
    for k, i in enumerate(sa):
        place[i] = k
    size = np.bincount(first, minlength=n).tolist()
    smaller = [-1] * n

    end = n
    while end > 0:
        i = sa[end - 1]
        g = group[i]
        if g == end - 1:  # one member
            j = i - 1
            while j >= 0 and group[j] > g:
                j = smaller[j]
            if j >= 0:
                smaller[i] = j
                h = group[j]
                k = size[h] - 1
                if k:
                    size[h] = k
                    k += h
                    other, x = sa[k], place[j]
                    sa[k], sa[x] = j, other
                    place[j], place[other] = k, x
                    group[j] = k
                    size[k] = 1
            end = g
            continue
        times: dict[int, int] = {}
        for i in sorted(sa[g:end]):
            j = i - 1
            while j >= 0 and group[j] > g:
                j = smaller[j]
            if j >= 0 and group[j] == g:
                j = smaller[j]
            if j >= 0:
                smaller[i] = j
                times[j] = times.get(j, 0) + 1
        end = g
        # who is followed by more copies of the group's prefix is greater, and leaves its group first
        by_times = defaultdict(list)
        for j, t in times.items():
            by_times[t].append(j)
        for t in sorted(by_times, reverse=True):
            for j in by_times[t]:
                h = group[j]
                k = size[h] - 1
                size[h] = k
                k += h
                other, x = sa[k], place[j]
                sa[k], sa[x] = j, other
                place[j], place[other] = k, x
            for j in by_times[t]:
                group[j] += size[group[j]]
            for j in by_times[t]:
                size[group[j]] += 1

    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    if n:
        out[0] = n - 1
        placed[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            k = free[g]
            free[g] = k + 1
            out[k] = j
            placed[j] = 1
            j = smaller[j]
    return out


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``_hashes`` takes the hash of any substring."""
    up, down = bt._power_tables(len(buf))
    total = np.zeros(len(buf) + 1, bt.U64)
    np.cumsum(bt._TABLE[buf] * up[: len(buf)], out=total[1:])
    return total, down


def _hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """The hash of every substring of ``size`` bytes."""
    total, down = _sums(buf)
    return bt.avalanche((total[size:] - total[:-size]) * down[: len(buf) - size + 1])


def _least_in(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def pieces_of(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the row, bytes, bucket, whether its hash comes twice, start and end in ``buf``) of all pieces of the rows of a chunk."""
    for lo in range(0, len(buf) - LEAST + 1, _STRETCH):
        part = buf[lo : lo + _STRETCH + LEAST - 1]
        h = _hashes(part, ANCHOR)
        m = _least_in(h, LEAST - ANCHOR + 1)
        n = len(m)
        row = np.searchsorted(off, np.arange(lo, lo + n), "right") - 1
        fits = np.arange(lo, lo + n) + LEAST <= off[row + 1]
        cut = np.ones(n, bool)
        cut[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        again = np.zeros(n + 1, bool)
        again[: n - 1] = (h[: n - 1] == m[:-1]) & (m[1:] == m[:-1])
        long = end - start > LONGEST
        if long.any():
            counts = -(-(end - start) // LONGEST)
            k = bt.ragged(np.zeros(len(start), np.int64), counts)
            start, last = np.repeat(start, counts) + LONGEST * k, np.repeat(end, counts)
            end = np.minimum(start + LONGEST, last)
        ok = fits[start]
        start, end = start[ok], end[ok]
        seen = bt.prefix_count(again)
        twice = seen[end] > seen[start]
        yield row[start], start + lo - off[row[start]], end - start + LEAST - 1, m[start], twice, start + lo, end + lo + LEAST - 1


def _make_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy()
        for lo, _, buf, off, _ in bt.text_chunks(b.column(1)):
            data = memoryview(buf)
            for row, at, n, m, twice, s, e in pieces_of(buf, off):
                digests = b"".join([hashlib.md5(data[x:y], usedforsecurity=False).digest() for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(ids[lo + row]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["m", "d1", "d2", "row", "at", "n", "twice"],
                )


def _take_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that each row's list names."""
    names = ["m", "row", "at", "sure", "hot", "piece"]
    for b in batches:
        for i in range(b.num_rows):
            data = memoryview((b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"))
            asked = b.column(2)[i].values
            at, n = (asked.field(k).to_numpy() for k in ("at", "n"))
            pieces = pa.array([data[x:y] for x, y in zip(at.tolist(), (at + n).tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([asked.field("m"), pa.array(np.full(len(at), b.column(0)[i].as_py())), asked.field("at"), asked.field("sure"), asked.field("hot"), pieces], names)


def repeated_starts(stretches: list[bytes]) -> list[np.ndarray]:
    """For each of different byte strings the starts of the strings of ``LEAST`` bytes in it that start elsewhere too, in it or in another."""
    buf = np.frombuffer(b"".join(stretches), np.uint8).astype(np.int64) + 2
    sizes = np.array([len(s) for s in stretches])
    ends = np.cumsum(sizes + 1)
    s = np.insert(buf, np.cumsum(sizes), 1)  # a mark that is less than any byte ends each
    order = np.array(suffix_array([*s.tolist(), 0]))[1:]
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(s))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((left[a] >= LEAST) & (left[b] >= LEAST))
    code = s.astype(np.int16)
    step = 8
    for k in range(0, LEAST, step):  # most pairs part soon
        x, y = a[near], b[near]
        same = np.ones(len(near), bool)
        for j in range(k, min(k + step, LEAST)):
            same &= code[x + j] == code[y + j]
        near = near[same]
    flag = np.zeros(len(s), bool)
    flag[a[near]] = flag[b[near]] = True
    return [np.flatnonzero(flag[e - 1 - n : e - 1]) for e, n in zip(ends, sizes, strict=True)]


def _settle(m: np.ndarray, row: np.ndarray, at: np.ndarray, sure: np.ndarray, pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(row, start, bytes) of what is repeated in the unsure pieces of whole buckets."""
    sizes = np.array([len(p) for p in pieces])
    off = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    # what has no second occurrence of its substrings in its bucket is in no repeated string
    h = _hashes(buf, TRIM)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(h)]
    inside = np.flatnonzero(np.arange(len(h)) + TRIM <= off[owner + 1])
    key = bt.combine(h[inside], m.view(bt.U64)[owner[inside]])
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    live = np.zeros(len(h), bool)
    live[inside[order[1:][equal]]] = live[inside[order[:-1][equal]]] = True
    s, e = bt.spans(live, off[:-1])
    e = e + TRIM - 1
    s, e = s[e - s >= LEAST], e[e - s >= LEAST]
    places = defaultdict(lambda: defaultdict(list))  # bucket -> stretch -> places
    data = buf.tobytes()
    for i, x, y in zip((np.searchsorted(off, s, "right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
        places[int(m[i])][data[x:y]].append((i, x - int(off[i])))
    out, asked = [], []
    for own in places.values():
        open_ = False
        for text, where in own.items():
            if len(where) > 1:
                out += [(int(row[i]), int(at[i]) + x, len(text)) for i, x in where if not sure[i]]
            elif not sure[where[0][0]]:
                open_ = True
        if open_:
            asked += own.items()
    if asked:
        for (_, where), starts in zip(asked, repeated_starts([t for t, _ in asked]), strict=True):
            i, x = where[0]
            if len(where) == 1 and not sure[i] and len(starts):
                runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
                out += [(int(row[i]), int(at[i]) + x + int(r[0]), len(r) + LEAST - 1) for r in runs]
    return out


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted by bucket, to repeated spans; as many whole buckets at a time as fill an array."""
    kept: list[tuple] = []
    size = 0

    def settled() -> pa.RecordBatch:
        m, row, at, sure, pieces = zip(*kept, strict=True)
        out = _settle(np.array(m), np.array(row), np.array(at), np.array(sure), list(pieces))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["row", "at", "n"])

    for b in batches:
        for new in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kept and size >= ARRAY_BYTES and kept[-1][0] != new[0]:
                yield settled()
                kept, size = [], 0
            kept.append(new)
            size += len(new[4])
    if kept:
        yield settled()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, kept bytes, removed spans) of each row with its list of repeated stretches."""
    for b in batches:
        n_bytes, kept, starts, ends, sizes = [], [], [], [], [0]
        for text, found in zip(b.column(1), b.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            s = e = np.zeros(0, np.int64)
            if found.is_valid and len(found.values):
                at, n = (found.values.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
                order = np.argsort(at, kind="stable")
                at, reach = at[order], np.maximum.accumulate((at + n)[order])
                first = np.concatenate([[True], at[1:] > reach[:-1]])
                s, e = at[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)]
                gone, last = [], 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    gone.append(data[last:x])
                    last = y
                rest = b"".join([*gone, data[last:]])
            else:
                rest = data
            n_bytes.append(len(data))
            kept.append(rest)
            starts.append(s)
            ends.append(e)
            sizes.append(sizes[-1] + len(s))
        span = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (starts, ends)], ["start", "end"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), span)], ["doc_id", "n_bytes", "kept", "spans"])


def _by_strings(texts: DataFrame) -> DataFrame:
    """Repeated spans of hot buckets: each string goes its own way, under its digest."""
    each = texts.select("row", "at", "sure", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - LEAST)).alias("k"))
    each = each.select("row", (F.col("at") + F.col("k")).alias("at"), "sure", F.md5(F.substring("piece", F.col("k") + 1, F.lit(LEAST))).alias("digest"))
    met = each.groupBy("digest").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("digest")
    return each.where(~F.col("sure")).join(met, "digest").select("row", "at", F.lit(LEAST).alias("n"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, spans), one row for each input row: what is left of its UTF-8 bytes, and the (start, end) of what was removed."""
    kind = docs.schema[doc_id].dataType.simpleString()
    own = own_session(docs.sparkSession, _BATCH_ROWS)
    rows = handed(saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("t")), "rows"), own)

    pieces = saved(rows.select("row", "t").mapInArrow(tidy(_make_pieces), _PIECES), "pieces")
    met = pieces.groupBy("m").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("c")).where(F.col("c") > 1).select("m")
    shared = saved(pieces.join(met, "m"), "shared")
    discard(pieces)

    equal = shared.groupBy("m", "d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("row", "at")).alias("one"), F.max("twice").alias("twice"), F.max("n").alias("n"))
    contested = equal.groupBy("m").agg(F.count("*").alias("kinds"), F.sum("n").alias("bytes"), F.min("c").alias("least"), F.max("twice").alias("twice"))
    contested = contested.where((F.col("least") == 1) & ((F.col("kinds") > 1) | F.col("twice"))).select("m", (F.col("bytes") > HOT).alias("hot"))
    equal = equal.drop("twice", "n").join(contested, "m", "left").where((F.col("c") > 1) | F.col("hot").isNotNull())
    judged = shared.drop("twice").join(equal, ["m", "d1", "d2"]).select("m", "row", "at", "n", (F.col("c") > 1).alias("sure"), "hot", (F.col("hot").isNotNull() & (F.col("one") == F.struct("row", "at"))).alias("fetch"))
    judged = saved(judged.where(F.col("sure") | F.col("fetch")), "judged")
    discard(shared)

    lists = judged.where("fetch").groupBy("row").agg(F.collect_list(F.struct("m", "at", "n", "sure", "hot")).alias("asked"))
    texts = rows.select("row", "t").join(lists, "row").select("row", "t", "asked").mapInArrow(tidy(_take_texts), "m long, row long, at int, sure boolean, hot boolean, piece binary")
    texts = saved(texts, "contested")
    size = texts.where(~F.col("hot")).agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    tasks = max(1, -(-size // TASK_BYTES))
    sorted_out = texts.where(~F.col("hot")).drop("hot").repartition(tasks, "m").sortWithinPartitions("m").mapInArrow(tidy(_sort_buckets), "row long, at int, n int")
    by_strings = saved(_by_strings(texts.where("hot")), "hot")  # a query of its own, so that a hot string's side of the join can be split
    spans = saved(judged.where("sure").select("row", "at", "n").unionByName(sorted_out).unionByName(by_strings), "spans")
    discard(texts)
    discard(judged)

    found = spans.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    done = rows.join(found, "row", "left").select("id", "t", "found").mapInArrow(tidy(_cut_out), f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    done = saved(done, "kept")
    discard(spans)
    discard(rows)
    return handed(done, docs.sparkSession)
