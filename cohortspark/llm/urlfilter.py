"""URL filters by temporal list join, in DataFrame functions only.

A list is a log of dated entries: a rule (a domain with its subdomains, or a
host with a path prefix), a verdict (block or allow), and whether it was added
or removed.  For each rule the log becomes validity intervals: an added entry is
active until the rule is added again, with either verdict, or this verdict is
removed.  So a rule has one active entry at most.  A capture is looked up by the
keys its URL has (every domain suffix, every path prefix) and as of its fetch
time, so each key is decided by one interval at most.  The longest active rule
decides; between a path and a domain of one length the path.

The as-of step is two equi-joins.  A rule with n intervals has a time grid of its
own, about n equal cells from its first to its last date, and an interval lies in
every cell it meets: as a rule's intervals don't overlap, that makes 2 n + 2
pieces at most, and about two in a cell.  A key finds its rule's grid, then its
cell's pieces, however long the rule's history is.

Scale: only keys are joined, never texts.  A list of at most ``LIST_ROWS``
intervals (counted) is broadcast.  Beyond that, captures are salted over
``SALTS`` tasks for each key, since one host may have a third of all rows, and
the list is repeated for each salt.

Cases: a null or hostless URL and a null time match nothing and pass; entries
of one rule at one time count in the order of their ids (the largest last);
entries with a null rule or time are void; rows that repeat are judged alike; a
very long URL has a key for each of its path's parts; empty tables give no
match; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
#: Pieces of intervals that are broadcast at most (some 50 bytes each).
LIST_ROWS = 200_000


def host(url: Column) -> Column:
    """The lower-case host, without user, port and closing dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def keys(url: Column) -> Column:
    """All rules that can match: d:<domain suffix> and p:<host><path prefix ending in a slash, or whole path>."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.split(path, "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("p:"), h, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < n, "/").otherwise("")))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.when(path == "", F.array().cast("array<string>")).otherwise(prefixes))))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, entry_id, verdict, since, until) of the active intervals of a log (entry_id, rule, verdict, op, ts)."""
    order = ("ts", "entry_id")
    added = F.min(F.when(F.col("op") == "add", F.col("ts"))).over(Window.partitionBy("rule").orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
    removed = F.min(F.when(F.col("op") != "add", F.col("ts"))).over(Window.partitionBy("rule", "verdict").orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
    dated = entries.where("rule is not null and ts is not null").withColumn("until", F.least(added, removed))
    return dated.where((F.col("op") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("ts")))).select("rule", "entry_id", "verdict", F.col("ts").alias("since"), "until")


def _gridded(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule, first, width, top): the grids; (rule, cell, entry_id, verdict, since, until): the intervals by cell.  ``top`` is the cell of all that comes after the last date."""
    ends = live.groupBy("rule").agg(F.min("since").alias("first"), F.max(F.coalesce("until", "since")).alias("last"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("last") - F.col("first")) / F.col("n"))).cast("long")
    grids = ends.withColumn("width", width).select("rule", "first", "width", (F.floor((F.col("last") - F.col("first")) / F.col("width")) + 1).alias("top"))
    end = F.when(F.col("until").isNull(), F.col("top")).otherwise(_cell(F.col("until") - 1))
    pieces = live.join(grids, "rule").withColumn("cell", F.explode(F.sequence(_cell(F.col("since")), end)))
    return grids, pieces.select("rule", "cell", "entry_id", "verdict", "since", "until")


def _cell(at: Column) -> Column:
    return F.least(F.floor((at - F.col("first")) / F.col("width")), F.col("top"))


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = SALTS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(page_id, url, fetched, rule, entry_id, blocked), one row for each capture (page_id, url, fetched)."""
    rows = captures.select("page_id", "url", "fetched")
    grids, pieces = _gridded(intervals(entries))
    distinct = rows.where("url is not null and fetched is not null").distinct()
    asked = distinct.withColumn("rule", F.explode(keys(F.col("url"))))
    by = ["rule"]
    if pieces.count() <= list_rows:
        grids, pieces = F.broadcast(grids), F.broadcast(pieces)
    else:
        by = ["rule", "salt"]
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        grids, pieces = grids.withColumn("salt", every), pieces.withColumn("salt", every)
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(salts)).cast("int"))
    asked = asked.join(grids, by).where("fetched >= first").withColumn("cell", _cell(F.col("fetched"))).drop("first", "width", "top")
    met = asked.join(pieces, [*by, "cell"]).where("fetched >= since and (until is null or fetched < until)")
    # longest rule, then path before domain ('p' > 'd')
    rank = F.struct(F.length("rule").alias("n"), "rule", (F.col("verdict") == "block").alias("block"), "entry_id")
    best = met.groupBy("page_id", "url", "fetched").agg(F.max(rank).alias("best"))
    best = best.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched").alias("_f"), "best")
    same = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & F.col("fetched").eqNullSafe(F.col("_f"))
    return rows.join(best, same, "left").select("page_id", "url", "fetched", F.col("best.rule").alias("rule"), F.col("best.entry_id").alias("entry_id"), F.coalesce("best.block", F.lit(False)).alias("blocked"))
