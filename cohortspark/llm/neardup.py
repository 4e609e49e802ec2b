"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification and union-find by stars.

A document's set holds its distinct shingles of five lower-cased words (with
fewer words, the whole sequence as one; without words, nothing).  Documents are
linked where 100 * intersection >= ``percent`` * union of the whole sets, and a
group is what is reachable over links.

How it stays linear in hot groups:

* Equal sets collapse first, by a 128-bit set fingerprint, so copies never meet.
* A band bucket emits one pair for each member, with the bucket's hub; of these
  each document verifies only its most similar one.
* After the first grouping only pairs *between* groups are looked at: in each
  bucket, members outside the bucket's largest group are held against the
  bucket in square blocks of bounded size, by an exact bound, by 8-bit
  signature samples and by half-width sets; what passes is verified on the full
  sets.  The bound: a
  shingle that no other document of the open buckets has is in no
  intersection, so with u such shingles of n the intersection is at most n - u.
  In a large group of near copies, whose edits are each their own, it leaves
  little but true links.  No bucket, partner or candidate is capped, so what is
  lost is only what shares no band (under 1e-5 of the pairs at a similarity of
  0.85) or falls short in the sample (likewise).
* Groups are found by alternating large-star and small-star steps; every step
  is a partial aggregation and a join, written to the shared folder; older steps
  are removed.
* Joins on bucket keys read written tables on both sides, so adaptive execution
  can split a bucket that is hot.

Cases: ids are whole numbers (other kinds are cast to them); null ids are linked
with nothing (component null, kept); rows that share an id are one document,
with one component, linked with what any of them with words is; null and empty
texts are linked with nothing; ties of similarity go to the larger id; a very
long text is compared whole; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, discard, saved, tidy

WORDS = 5
BANDS, ROWS = 20, 5
PERCENT = 85
#: Of the 100 sampled signature bytes, how many have to agree before a pair is verified.
AGREE = 68
BLOCK = 2048


def shingles(words: np.ndarray, first_word: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's shingles, repeats included, and where each row's begin."""
    have = np.diff(first_word)
    n = np.where(have >= size, have - size + 1, (have > 0).astype(have.dtype))
    at = bt.ragged(first_word[:-1], n)
    length = np.repeat(np.minimum(have, size), n)
    h = np.where(length < size, length, 0).astype(np.uint64) * bt._MIX[50]
    last = max(len(words) - 1, 0)
    for k in range(size):
        part = words[np.minimum(at + k, last)] * bt._MIX[k]
        part[length <= k] = 0
        h += part
    return bt.avalanche(h), np.concatenate(([0], np.cumsum(n)))


def shingle_sets(column, size: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of an Arrow string column: first row, the rows' sorted distinct shingle hashes one after another, and where each row's begin."""
    for lo, _hi, buf, off, _ in bt.text_chunks(column):
        starts, ends, first = bt.word_spans(buf, off)
        h, begin = shingles(bt.hash_spans(buf, starts, ends, lower=True), first, size)
        parts = []
        for a, b in zip(begin[:-1], begin[1:]):
            s = np.sort(h[a:b])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            parts.append(s)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        yield lo, np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


def superminhash(elements: np.ndarray, begin: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (one row for each set) of hashed elements.

    Step j of an element draws r in [0, 1) and the j-th entry p of its own
    random permutation of the slots, and offers j + r to slot p.  A set is
    finished once all its slots hold less than the next step number: nothing
    later can be smaller.  All sets advance together, unfinished ones only.
    """
    sets = len(begin) - 1
    sig = np.full(sets * slots, np.uint64(2**64 - 1), np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(begin))
    live, perm = elements, None
    for j in range(slots):
        if not len(live):
            break
        r = bt.avalanche(live * bt._MIX[42] + np.uint64((0x632BE59BD9B4E019 * (j + 1)) % 2**64))
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot, first = k, k
        else:
            row = np.arange(len(live))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = slot
        value = (np.uint64(j) << np.uint64(56)) | (bt.avalanche(r + bt._MIX[43]) >> np.uint64(8))
        np.minimum.at(sig, owner * slots + slot, value)
        open_sets = sig.reshape(sets, slots).max(axis=1) >= np.uint64(j + 1) << np.uint64(56)
        stay = open_sets[owner]
        if not stay.all() or perm is None:
            if perm is None:
                first = first[stay]
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (int(stay.sum()), 1))
                perm[np.arange(len(first)), first] = 0
                perm[:, 0] = first
            else:
                perm = perm[stay]
            live, owner = live[stay], owner[stay]
    return sig.reshape(sets, slots)


def _features(bands: int, rows: int):
    slots = bands * rows
    names = ["id", "n", "f1", "f2", "bands", "sample"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, h, begin in shingle_sets(batch.column(1)):
                n = np.diff(begin)
                sig = superminhash(h, begin, slots)
                total = [np.concatenate(([np.uint64(0)], np.cumsum(bt.avalanche(h * bt._MIX[c] + bt._MIX[c + 1])))) for c in (44, 46)]
                f1, f2 = (t[begin[1:]] - t[begin[:-1]] for t in total)
                key = np.empty((len(n), bands), np.uint64)
                for b in range(bands):
                    acc = np.full(len(n), (b + 1) * int(bt._MIX[48]) % 2**64, np.uint64)
                    for k in range(rows):
                        acc += sig[:, b * rows + k] * bt._MIX[k]
                    key[:, b] = bt.avalanche(acc)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(key.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
                sample = pa.FixedSizeBinaryArray.from_buffers(pa.binary(slots), len(n), [None, pa.py_buffer(np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8)))]).cast(pa.binary())
                ids = batch.column(0).slice(lo, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), keys, sample], names)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, h, begin in shingle_sets(batch.column(1)):
            data = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(begin) - 1), data], ["id", "members"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, token) of the shingles of sets (id, members)."""
    for batch in batches:
        sizes, h = _buffers(batch.column(1), np.int64)
        for lo in range(0, len(sizes), 256):  # some hundred thousand tokens at a time
            part = sizes[lo : lo + 256]
            at = int(sizes[:lo].sum())
            owner = batch.column(0).take(pa.array(lo + np.repeat(np.arange(len(part)), part)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(h[at : at + int(part.sum())])], ["id", "token"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by the low half of every hash: intersections can only grow."""
    for batch in batches:
        sizes, h = _buffers(batch.column(1), np.uint64)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        off = np.concatenate(([0], np.cumsum(sizes)))
        data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(low)])
        yield pa.RecordBatch.from_arrays([batch.column(0), data], ["id", "half"])


def _buffers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """How many values each binary row holds, and all the values."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.diff(off) // 8, values[off[0] : off[-1]].view(dtype) if len(off) else np.zeros(0, dtype)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = np.concatenate((a, b))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= percent * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _agreeing(least: int):
    """Of pairs with two samples: those that agree in at least ``least`` bytes, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(batch), -1) for c in (batch.column(2), batch.column(3)))
            same = (x == y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], ["a", "b", "same"]).filter(pa.array(same >= least))

    return run


def _across(least: int, percent: int):
    """Of rows sorted by (key, i, j): pairs of an outsider (side 0) and a member of another group (side 1) that look linked."""

    def pairs(t: pa.Table) -> np.ndarray:
        side = t["side"].to_numpy()
        s, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        if len(s) and len(m):
            ids, comp, n, own = (t[c].to_numpy() for c in ("id", "comp", "n", "own"))
            sample = np.frombuffer(b"".join(t["sample"].to_pylist()), np.uint8).reshape(len(side), -1)
            half = t["half"].to_pylist()
            for i in s:
                most = np.minimum(n[i] - own[i], n[m] - own[m])
                hit = m[(comp[m] != comp[i]) & (100 * most >= percent * (n[i] + n[m] - most))]
                hit = hit[(sample[hit] == sample[i]).sum(axis=1) >= least]
                for k in hit:
                    both = np.frombuffer(half[i] + half[k], np.uint32).copy()
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= percent * (n[i] + n[k] - inter):
                        found.append((ids[i], ids[k]))
        return np.array(found, np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(t: pa.Table, ended: bool) -> tuple[list[np.ndarray], pa.Table]:
            k = [t[c].to_numpy() for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            cuts = np.concatenate(([0], cuts, [len(t)] if ended else []))
            return [pairs(t.slice(a, z - a)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())], t.slice(int(cuts[-1]))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            found, held = blocks(pa.concat_tables([held, t]).combine_chunks() if held is not None else t, False)
            if found and len(every := np.concatenate(found)):
                yield pa.RecordBatch.from_arrays([pa.array(every.min(axis=1)), pa.array(every.max(axis=1))], ["a", "b"])
        if held is not None and len(held):
            every = np.concatenate(blocks(held, True)[0])
            yield pa.RecordBatch.from_arrays([pa.array(every.min(axis=1)), pa.array(every.max(axis=1))], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each linked id.  ``links``: a > b pairs.

    Large-star: a node hands its larger neighbours to the least of its
    neighbourhood; small-star: likewise its smaller ones and itself.  Both need
    only a minimum for each node, so no neighbourhood is gathered anywhere.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u > v").distinct())
        discard(large)
        # stars only: no centre is itself a leaf, no leaf has two centres
        leaves = now.select(F.col("u").alias("x"))
        moved = now.join(leaves, F.col("v") == F.col("x"), "left_semi").limit(1).count() or now.groupBy("u").count().where("count > 1").limit(1).count()
        edges = now
        if not moved:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = rows.join(wanted, "id", "left_semi").mapInArrow(tidy(_sets), "id long, members binary")
    sets = saved(sets, "sets")
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
    full = first.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")
    found = cut(full.mapInArrow(tidy(_linked(percent)), "a long, b long").distinct())
    discard(sets)
    return found


def _same_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes that hold texts of one id."""
    one = F.struct("f1", "f2", "n")
    several = usable.groupBy("id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("id")
    held = usable.join(several, "id", "left_semi").select("id", "f1", "f2", "n").distinct().join(classes, ["f1", "f2", "n"]).select("id", "rep")
    least = held.groupBy("id").agg(F.min("rep").alias("b"))
    return held.join(least, "id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, agree: int = AGREE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row."""
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    feats = saved(base.mapInArrow(tidy(_features(bands, rows)), "id long, n long, f1 long, f2 long, bands array<long>, sample binary"), "features")
    usable = feats.where("id is not null and n > 0")
    # equal sets are one class, named after its smallest id
    classes = usable.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    reps = usable.join(classes.select(F.col("rep").alias("id"), "f1", "f2"), ["id", "f1", "f2"], "left_semi")
    reps = saved(reps.select("id", "n", "bands", "sample"), "reps")
    # buckets with two members or more; one hub each, by turns the smallest and the largest id
    members = reps.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.when(F.col("key") % 2 == 0, F.min("id")).otherwise(F.max("id")).alias("hub")).where("size > 1")
    buckets = cut(buckets)
    members = cut(members.join(buckets, "key").select("key", "id", "hub", "size"))
    sample = reps.select("id", "sample")
    star = members.where("id <> hub").select("id", "hub").distinct()
    star = star.join(sample.select(F.col("id").alias("hub"), F.col("sample").alias("hs")), "hub").join(sample, "id").select("id", "hub", "sample", "hs")
    star = star.mapInArrow(tidy(_agreeing(agree)), "a long, b long, same long")
    best = star.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
    texts = base.where("id is not null")
    links = _verified(cut(best), texts, percent)
    comp = components(links)
    # second round: only between groups
    grouped = members.join(comp, "id", "left").select("key", "id", "size", F.coalesce("comp", "id").alias("comp"))
    tally = grouped.groupBy("key", "comp").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    open_ = tally.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.max("size").alias("size")).where("most < size")
    open_ = cut(open_)
    at = grouped.drop("size").join(open_, "key").join(reps.select("id", "n", "sample"), "id")
    pool = cut(at.select("id").distinct())
    sets = saved(texts.join(pool, "id", "left_semi").mapInArrow(tidy(_sets), "id long, members binary"), "pool")
    own = sets.mapInArrow(tidy(_tokens), "id long, token long").groupBy("token").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    # the bound is of one set, so it doesn't hold for an id with several
    own = own.join(sets.groupBy("id").count().where("count > 1").select("id"), "id", "left_anti")
    facts = sets.mapInArrow(tidy(_halves), "id long, half binary").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    at = at.join(facts, "id")
    parts = lambda rows_: F.greatest(F.lit(1), F.ceil(rows_ / block)).cast("int")
    n_out, n_all = parts(F.col("size") - F.col("most")), parts(F.col("size"))
    mine = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    out = at.where("comp <> main").select("key", "id", "comp", "n", "own", "sample", "half", F.lit(0).alias("side"), mine(n_out).alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"))
    all_ = at.select("key", "id", "comp", "n", "own", "sample", "half", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), n_out - 1)).alias("i"), mine(n_all).alias("j"))
    cells = out.unionByName(all_).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
    more = cells.mapInArrow(tidy(_across(agree, percent)), "a long, b long").distinct()
    links = links.unionByName(_verified(cut(more), texts, percent)).unionByName(_same_id(usable, classes))
    comp = components(links)
    named = classes.join(comp, F.col("rep") == F.col("id"), "left").select("f1", "f2", "n", F.coalesce("comp", "rep").alias("comp"))
    named = cut(named)
    result = feats.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id"))
    return result.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
