"""Exact nearest-neighbour joins.

The query side (exposed rows, few by nature) is taken in blocks of at most
``QUERY_BLOCK`` rows (fewer with a large k, see ``HELD``), whose values go to the
executors; the reference side streams past in blocks that are cut into cells
(``operators.cells``).  A cell is compared with the queries whose k-th best so
far its floor doesn't exceed, NumPy computing a bounded tile of distances at a
time.  Each task keeps the k best of its partition for every query, and a window
over those partial results leaves the k best of all.  No pair is materialised
that isn't among the best of its partition.  Queries with the same values are
computed once, and of references with the same values a list can only hold
those of least id, so copies of rows cost little but their share of the result.  Order is (distance, reference id),
so results don't hang on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells, quantiles
from .checkpoints import saved

QUERY_BLOCK = 20_000
#: What a task keeps at most: so many (query, reference) pairs.
HELD = 20_000_000
TILE = 1 << 21
#: References that are cut into cells at a time.
CELL_BLOCK = 1 << 16
#: Equal references are looked for by so many values at most, and cut to the length of the lists up to so long ones.
EQUAL_VALUES, EQUAL_KEPT = 16, 1000
#: About how many pairs a share of a bucket of a band join looks at.
BAND_PAIRS = 10_000_000


@dataclass(frozen=True)
class Band:
    """Only references within ``width`` (inclusive) of the query in ``column`` are eligible."""

    column: str
    width: float


@dataclass
class _Side:
    """One side of a block of distances."""

    ids: np.ndarray
    numbers: np.ndarray
    codes: np.ndarray
    band: np.ndarray | None


def _columns(df: DataFrame, id_col: str, metric, band: Band | None) -> tuple[DataFrame, int, int]:
    numbers, strings = metric.side(df)
    picked = df.select(F.col(id_col).alias("id"), *(x.cast("double").alias(f"n{i}") for i, x in enumerate(numbers)), *(x.cast("string").alias(f"c{i}") for i, x in enumerate(strings)), *([F.col(band.column).cast("double").alias("band")] if band else []))
    return picked, len(numbers), len(strings)


def _side(t: pa.Table | pa.RecordBatch, p: int, q: int, books: list[pa.Array]) -> _Side:
    n = t.num_rows
    numbers = np.full((n, p), np.nan)
    for i in range(p):
        numbers[:, i] = t.column(1 + i).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(1 + i).to_numpy()
    codes = np.full((n, q), -2, np.int64)
    for i in range(q):
        column = t.column(1 + p + i)
        found, null = pc.fill_null(pc.index_in(column, books[i]), -2), pc.is_null(column)
        codes[:, i] = np.where(null.to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else null.to_numpy(), -1, found.to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else found.to_numpy())
    ids = t.column(0)
    ids = ids.to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else ids.to_numpy()
    band = None
    if t.num_columns > 1 + p + q:
        x = t.column(1 + p + q)
        band = x.to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else x.to_numpy()
    return _Side(ids, numbers, codes, band)


def _taken(side: _Side, at: np.ndarray) -> _Side:
    return _Side(side.ids[at], side.numbers[at], side.codes[at], None if side.band is None else side.band[at])


def _joined(sides: list[_Side]) -> _Side:
    return _Side(*(np.concatenate([getattr(s, n) for s in sides]) for n in ("ids", "numbers", "codes")), None if sides[0].band is None else np.concatenate([s.band for s in sides]))


def _blocks(batches: Iterator[pa.RecordBatch], p: int, s: int, books: list[pa.Array]) -> Iterator[_Side]:
    """The references in blocks of about ``CELL_BLOCK``."""
    kept: list[_Side] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(_side(batch, p, s, books))
            if sum(len(x.ids) for x in kept) >= CELL_BLOCK:
                yield _joined(kept)
                kept = []
    if kept:
        yield _joined(kept)


def _tiles(q: _Side, r: _Side, metric, width: float | None) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, TILE // max(len(r.ids), 1))
    for lo in range(0, len(q.ids), step):
        hi = lo + step
        d = metric.block(q.numbers[lo:hi], q.codes[lo:hi], r.numbers, r.codes)
        d[np.isnan(d)] = np.inf
        if width is not None:
            with np.errstate(invalid="ignore"):
                d[~(np.abs(q.band[lo:hi, None] - r.band[None]) <= width)] = np.inf
        yield lo, d


class _Lists:
    """The k best references of every query so far; ``worst`` is what a further one must not exceed.

    A long list is put in order when half of its length has come anew, a short one at once.
    """

    def __init__(self, n: int, k: int, limit: float) -> None:
        self.k, self.dist, self.ids, self.worst = k, [np.zeros(0)] * n, [None] * n, np.full(n, limit)
        self.new: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.room = np.zeros(n, np.int64)

    def offer(self, at: np.ndarray, d: np.ndarray, of: np.ndarray) -> None:
        for i in np.flatnonzero(d.min(axis=1, initial=np.inf) <= self.worst[at]):
            q, row = int(at[i]), d[i]
            near = np.flatnonzero((row <= self.worst[q]) & (row < np.inf))
            if not len(near):
                continue
            if len(near) > self.k:
                near = near[row[near] <= np.partition(row[near], self.k - 1)[self.k - 1]]
            self.new[q].append((row[near], of[near]))
            self.room[q] -= len(near)
            if self.room[q] <= 0:
                self.settle(q)

    def settle(self, q: int) -> None:
        """Put what has come anew in its place."""
        if not self.new[q]:
            return
        old = [] if self.ids[q] is None else [(self.dist[q], self.ids[q])]
        dd, ii = (np.concatenate(x) for x in zip(*old, *self.new[q]))
        order = np.lexsort((ii, dd))[: self.k]
        self.dist[q], self.ids[q], self.new[q] = dd[order], ii[order], []
        if len(order) == self.k:
            self.worst[q] = dd[order[-1]]
        self.room[q] = 0 if self.k < 256 else max(self.k - len(order), self.k // 2)

    def batches(self, ids: np.ndarray, kind: pa.DataType) -> Iterator[list[pa.Array]]:
        for q in range(len(self.dist)):
            self.settle(q)
        full = [i for i in range(len(self.dist)) if len(self.dist[i])]
        for a in range(0, len(full), 1000):
            part = full[a : a + 1000]
            yield [pa.array(np.repeat(ids[part], [len(self.dist[i]) for i in part])), pa.array(np.concatenate([self.ids[i] for i in part]), kind), pa.array(np.concatenate([self.dist[i] for i in part]))]


def _best(q: _Side, p: int, s: int, books: list[pa.Array], metric, k: int, limit: float, width: float | None, kind: pa.DataType, compared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(len(q.ids), k, limit)
        for r in _blocks(batches, p, s, books):
            found = cells.build(r.numbers, r.codes, r.band, metric.scales(p))
            for at, members in cells.worth_comparing(q.numbers, q.codes, q.band, found, metric, lists.worst, width):
                side, part = _taken(q, at), _taken(r, members)
                if compared is not None:
                    compared.add(len(at) * len(members))
                for lo, d in _tiles(side, part, metric, width):
                    lists.offer(at[lo : lo + len(d)], d, part.ids)
        for columns in lists.batches(q.ids, kind):
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "ref_id", "distance"])

    return run


_EDGE_AND_TALLY = "ref_id {0}, distance double, eligible long, within_threshold long, low double, high double"


def _swept(q: _Side, p: int, s: int, books: list[pa.Array], metric, k: int, limit: float, threshold: float, width: float, kind: pa.DataType, compared=None):
    """Edges and tallies from one sweep along the caliper; a tally has no reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(q.ids)
        lists, every = _Lists(n, k, limit), np.full(n, np.inf)
        eligible, within = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        names = ["query_id", "ref_id", "distance", "eligible", "within_threshold", "low", "high"]
        for r in _blocks(batches, p, s, books):
            found = cells.build(r.numbers, r.codes, r.band, metric.scales(p))
            for at, members in cells.worth_comparing(q.numbers, q.codes, q.band, found, metric, every, width, every=True):
                side, part = _taken(q, at), _taken(r, members)
                if compared is not None:
                    compared.add(len(at) * len(members))
                for lo, d in _tiles(side, part, metric, width):
                    own, ok = at[lo : lo + len(d)], np.isfinite(d)
                    eligible[own] += ok.sum(1)
                    within[own] += (d <= threshold).sum(1) if math.isfinite(threshold) else ok.sum(1)
                    low[own] = np.minimum(low[own], d.min(1, initial=np.inf))
                    high[own] = np.maximum(high[own], np.where(ok, d, -np.inf).max(1, initial=-np.inf))
                    lists.offer(own, d, part.ids)
        none = lambda x, n: pa.nulls(n, x)
        for columns in lists.batches(q.ids, kind):
            m = len(columns[0])
            yield pa.RecordBatch.from_arrays([*columns, none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), none(pa.float64(), m)], names)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids), none(kind, n), none(pa.float64(), n), *map(pa.array, (eligible, within, low, high))], names)

    return run


def _stats(q: _Side, p: int, s: int, books: list[pa.Array], metric, threshold: float, width: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(q.ids)
        eligible, within = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high, total = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, d in _tiles(q, _side(batch, p, s, books), metric, width):
                ok = np.isfinite(d)
                part = slice(lo, lo + len(d))
                eligible[part] += ok @ weight
                within[part] += (ok & (d <= threshold)) @ weight
                low[part] = np.minimum(low[part], d.min(1, initial=np.inf))
                high[part] = np.maximum(high[part], np.where(ok, d, -np.inf).max(1, initial=-np.inf))
                total[part] += np.where(ok, d, 0.0) @ weight
        yield pa.RecordBatch.from_arrays([pa.array(q.ids), pa.array(eligible), pa.array(within), pa.array(low), pa.array(high), pa.array(total)], ["query_id", "eligible", "within_threshold", "low", "high", "total"])

    return run


def _spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores: a small file is one partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _shared(queries: DataFrame, id_col: str, metric, band: Band | None) -> tuple[DataFrame, DataFrame | None]:
    """(the queries' values, those of equal queries once under their least id; (id, query_id) of all queries, or None where no two are equal)."""
    left, _, _ = _columns(queries, id_col, metric, band)
    least = F.min("id").over(Window.partitionBy(*(c for c in left.columns if c != "id")))
    left = saved(left.withColumn("query_id", least), "queries")
    members = left.select("id", "query_id") if left.where("id <> query_id").limit(1).count() else None
    return left.where("id = query_id").drop("query_id"), members


def members_of(queries: DataFrame, id_col: str, metric, band: Band | None = None) -> DataFrame | None:
    """(id, query_id): every query and the least id among those of the same values; None where no two are equal."""
    return _shared(queries, id_col, metric, band)[1]


def _for_all(found: DataFrame, members: DataFrame | None) -> DataFrame:
    """What was found for one of equal queries, for each of them."""
    if members is None:
        return found
    return found.join(members, "query_id").select(F.col("id").alias("query_id"), *(c for c in found.columns if c != "query_id"))


def _equal_cut(right: DataFrame, most: int) -> DataFrame:
    """Of references with the same values those of least id, as many as a list holds: the others would come after them in every list."""
    values = [c for c in right.columns if c != "id"]
    if not values or len(values) > EQUAL_VALUES or most > EQUAL_KEPT:
        return right
    place = F.row_number().over(Window.partitionBy(*values).orderBy("id"))
    return right.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def _equal_counted(right: DataFrame) -> DataFrame:
    """References with the same values as one, with their number as ``weight``."""
    values = [c for c in right.columns if c != "id"]
    return right.groupBy(*values).agg(F.min("id").alias("id"), F.count("*").cast("int").alias("weight")).select("id", *values, "weight")


def _each_block(queries: DataFrame, refs: DataFrame, id_col: str, metric, band: Band | None, make, schema: str, block: int = QUERY_BLOCK, left: DataFrame | None = None, ready=lambda right: right) -> DataFrame:
    """``left``: the queries' values, if they are at hand; ``ready``: what is done to the references' values before."""
    picked, p, s = _columns(queries, id_col, metric, band)
    left = picked if left is None else left
    right = _spread(ready(_columns(refs, id_col, metric, band)[0]))
    # one job if the queries are few, which is the usual case
    first = left.limit(block + 1).toArrow()
    blocks = 1 if first.num_rows <= block else -(-left.count() // block)
    out: DataFrame | None = None
    for b in range(blocks):
        t = first if blocks == 1 else left.where(F.pmod(F.xxhash64("id"), blocks) == b).toArrow()
        t = t.sort_by("id").combine_chunks()
        books = [pa.array(sorted({x for x in t.column(1 + p + j).unique().to_pylist() if x is not None}), pa.string()) for j in range(s)]
        found = right.mapInArrow(make(_side(t, p, s, books), p, s, books), schema)
        if blocks > 1:
            found = saved(found, "knn")
        out = found if out is None else out.unionByName(found)
    return out


def top_k(queries: DataFrame, refs: DataFrame, id_col: str, metric, k: int, limit: float = math.inf, band: Band | None = None, compared=None) -> DataFrame:
    """(query_id, ref_id, distance, rank): the k nearest references of each query within ``limit`` and, if given, the band.

    ``compared``: an accumulator that counts the pairs whose distance was computed.
    """
    kind = refs.schema[id_col].dataType.simpleString()
    other = queries.schema[id_col].dataType.simpleString()
    schema = f"query_id {other}, ref_id {kind}, distance double"
    arrow = refs.select(id_col).limit(0).toArrow().schema.field(0).type
    left, members = _shared(queries, id_col, metric, band)
    make = lambda q, p, s, books: _best(q, p, s, books, metric, k, limit, band.width if band else None, arrow, compared)
    found = _each_block(queries, refs, id_col, metric, band, make, schema, max(1, min(QUERY_BLOCK, HELD // max(k, 1))), left, lambda right: _equal_cut(right, k))
    return _for_all(_first_k(found, k), members)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def swept(queries: DataFrame, refs: DataFrame, id_col: str, metric, k: int, threshold: float, band: Band, limit: float | None = None, compared=None) -> tuple[DataFrame, DataFrame]:
    """(edges as of ``top_k``, diagnostics) within a caliper, from one pass that computes the eligible pairs and, at the ends of cells, few others."""
    kind = refs.schema[id_col].dataType.simpleString()
    arrow = refs.select(id_col).limit(0).toArrow().schema.field(0).type
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, {_EDGE_AND_TALLY.format(kind)}"
    make = lambda q, p, s, books: _swept(q, p, s, books, metric, k, threshold if limit is None else limit, threshold, band.width, arrow, compared)
    left, members = _shared(queries, id_col, metric, band)
    both = saved(_each_block(queries, refs, id_col, metric, band, make, schema, max(1, min(QUERY_BLOCK, HELD // max(k, 1))), left), "swept")
    edges, tallies = _first_k(both.where("ref_id is not null").select("query_id", "ref_id", "distance"), k), _summed_up(both.where("eligible is not null"), k)
    return _for_all(edges, members), _for_all(tallies, members)


def _tallied(queries: DataFrame, refs: DataFrame, id_col: str, metric, threshold: float, band: Band | None) -> tuple[DataFrame, DataFrame | None]:
    """((query_id, eligible, within_threshold, low, high, total), one row for each task and query, equal ones once; all queries as of ``_shared``)."""
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, eligible long, within_threshold long, low double, high double, total double"
    left, members = _shared(queries, id_col, metric, band)
    return _each_block(queries, refs, id_col, metric, band, lambda q, p, s, books: _stats(q, p, s, books, metric, threshold, band.width if band else None), schema, left=left, ready=_equal_counted), members


def _finite(c) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def diagnostics(queries: DataFrame, refs: DataFrame, id_col: str, metric, k: int, threshold: float, band: Band | None = None) -> DataFrame:
    """For each query: how many references are eligible and within the threshold, extreme distances, and whether k cuts either off."""
    parts, members = _tallied(queries, refs, id_col, metric, threshold, band)
    return _for_all(_summed_up(parts, k), members)


def _summed_up(parts: DataFrame, k: int) -> DataFrame:
    got = parts.groupBy("query_id").agg(F.sum("eligible").alias("eligible"), F.sum("within_threshold").alias("within_threshold"), _finite(F.min("low")).alias("min_distance"), _finite(F.max("high")).alias("max_distance"))
    return judged(got, k)


def judged(tallies: DataFrame, k: int) -> DataFrame:
    """Diagnostics of lists of k, from tallies or from diagnostics of other lists."""
    return tallies.select("query_id", "eligible", F.least("eligible", F.lit(k).cast("long")).alias("retained"), "within_threshold", "min_distance", "max_distance", (F.col("eligible") > k).alias("truncated_by_k"), (F.col("within_threshold") > k).alias("within_threshold_truncated_by_k"))


#: Fixed shares of the caliper report.
PERCENTILES = (0, 25, 50, 75, 100)


def percentiles(found: DataFrame, columns=("eligible", "retained", "within_threshold", "min_distance", "max_distance")) -> DataFrame:
    """(measure, percentile, value): exact percentiles over the queries with an eligible reference, by linear interpolation."""
    long = found.where("eligible > 0").select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    got = quantiles.grouped(long, "measure", "value", [p / 100 for p in PERCENTILES])
    return got.select("measure", F.round(F.col("share") * 100).cast("int").alias("percentile"), "value")


def summary(queries: DataFrame, refs: DataFrame, id_col: str, metric, band: Band | None = None) -> DataFrame:
    """(query_id, n, low, mean, high) of each query's distances to all references, summed up within the tiles."""
    parts, members = _tallied(queries, refs, id_col, metric, math.inf, band)
    got = parts.groupBy("query_id").agg(F.sum("eligible").alias("n"), _finite(F.min("low")).alias("low"), F.sum("total").alias("total"), _finite(F.max("high")).alias("high"))
    return _for_all(got.select("query_id", "n", "low", F.try_divide(F.col("total"), F.col("n")).alias("mean"), "high"), members)


def _every(q: _Side, p: int, s: int, books: list[pa.Array], metric):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _side(batch, p, s, books)
            for lo, d in _tiles(q, r, metric, None):
                n = len(d)
                ids = batch.column(0).take(pa.array(np.tile(np.arange(len(r.ids)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids[lo : lo + n], len(r.ids))), ids, pa.array(d.ravel())], ["query_id", "ref_id", "distance"])

    return run


def all_pairs(queries: DataFrame, refs: DataFrame, id_col: str, metric) -> DataFrame:
    """(query_id, ref_id, distance) of every pair, tile by tile: meant for a bounded query side, whose values go to the executors."""
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, ref_id {refs.schema[id_col].dataType.simpleString()}, distance double"
    return _each_block(queries, refs, id_col, metric, None, lambda q, p, s, books: _every(q, p, s, books, metric), schema)


class Metric:
    """What every fitted distance offers over two tables with the same columns."""

    def scales(self, p: int) -> np.ndarray:
        """What a step of each of the p numbers weighs in the distance; only the choice of cells hangs on it."""
        return np.ones(p)

    def kneighbors(self, queries: DataFrame, refs: DataFrame, id_col: str, k: int, limit: float = math.inf, band: Band | None = None) -> DataFrame:
        return top_k(queries, refs, id_col, self, k, limit, band)

    def cdist(self, queries: DataFrame, refs: DataFrame, id_col: str) -> DataFrame:
        return all_pairs(queries, refs, id_col, self)


def band_join(queries: DataFrame, refs: DataFrame, id_col: str, column: str, width: float) -> DataFrame:
    """(query_id, ref_id, gap): pairs within ``width`` (inclusive) of each other in ``column``.

    Values are cut into buckets of the band's width and each query looks into
    its own bucket and the two beside it: an equi-join that shuffles both sides
    once, instead of a nested loop.  A width of 0 joins equal values.  The
    pairs to look at are counted by bucket first: a bucket's references are
    dealt over as many shares as its pairs need, each of which meets all its
    queries, and there are as many partitions as all pairs need, so that no
    task makes more than a few ``BAND_PAIRS``.
    """
    size = width if width > 0 else 1.0
    bucket = lambda c: F.floor(F.col(c) / size).cast("long") if width > 0 else F.xxhash64(c)
    near = F.explode(F.array(*(bucket("qv") + d for d in (-1, 0, 1)))) if width > 0 else bucket("qv")
    q = saved(queries.select(F.col(id_col).alias("query_id"), F.col(column).cast("double").alias("qv")).where("qv is not null").withColumn("b", near), "band")
    r = saved(refs.select(F.col(id_col).alias("ref_id"), F.col(column).cast("double").alias("rv")).where("rv is not null").withColumn("b", bucket("rv")), "band")
    n = q.groupBy("b").agg(F.count("*").alias("nq")).join(r.groupBy("b").agg(F.count("*").alias("nr")), "b")
    shares = saved(n.select("b", F.col("nq").cast("double") * F.col("nr") / BAND_PAIRS).toDF("b", "load").select("b", "load", F.ceil("load").cast("int").alias("shares")), "band-shares")
    parts = math.ceil(shares.agg(F.sum("load")).first()[0] or 0) + q.sparkSession.sparkContext.defaultParallelism
    # as many shares as a bucket has: its references have one each, its queries all of them
    q = q.join(shares, "b").select("query_id", "qv", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    r = r.join(shares, "b").select("ref_id", "rv", "b", F.pmod(F.xxhash64("ref_id"), F.col("shares")).cast("int").alias("share"))
    q, r = q.repartition(parts, "b", "share"), r.repartition(parts, "b", "share")
    pairs = q.hint("shuffle_hash").join(r, ["b", "share"]).select("query_id", "ref_id", F.abs(F.col("qv") - F.col("rv")).alias("gap"))
    return pairs.where(F.col("gap") <= width)


def relaxed_band_join(queries: DataFrame, refs: DataFrame, id_col: str, column: str, width: float) -> DataFrame:
    """Like ``band_join``; queries that meet nobody try again with twice the width."""
    first = band_join(queries, refs, id_col, column, width)
    met = first.select(F.col("query_id").alias(id_col)).distinct()
    rest = queries.join(met, id_col, "left_anti")
    return first.withColumn("relaxed", F.lit(False)).unionByName(band_join(rest, refs, id_col, column, 2 * width).withColumn("relaxed", F.lit(True)))


def pairs(queries: DataFrame, refs: DataFrame, id_col: str, distance: Column, features) -> DataFrame:
    """Every pair and its distance (cdist): meant for small sides or a bounded query set."""
    side = lambda df, prefix: df.select(F.col(id_col).alias(f"{prefix}id"), *(F.col(c).alias(f"{prefix}{c}") for c in features))
    return side(refs, "r_").crossJoin(side(queries, "q_")).select(F.col("q_id").alias("query_id"), F.col("r_id").alias("ref_id"), distance.alias("distance"))
