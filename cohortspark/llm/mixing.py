"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in a seeded order, are cut into blocks.  In the ideal fluid
mix every source with rows left gets a share of the output in proportion to its
weight; block i of a source is being served in the fluid mix over an interval
whose floor and ceiling are the block's release slot and deadline slot.
Earliest deadline first over released blocks then fills one slot with each
block, and never leaves a source a whole block ahead of or behind the fluid mix.
Once a source runs out, the others share its weight, so no row is dropped.

Scale: with integer weights the fluid mix comes to whole blocks once in every
period (each source at most its weight in blocks), so periods are independent.
Periods with the same sources left are alike, and only those where a source
runs out, and the next ones, differ: at most two for each source and one more.
Only those are scheduled (a fold over at most ``sum of weights`` blocks), and
the schedule, whose size the weights bound, is broadcast to the rows.  Ranks
within a source come from hash buckets, their counts and prefix sums, so a
source with a third of all rows is spread over many tasks.

Cases: weights that add up to more than ``MOST_WEIGHT`` raise; texts aren't
looked at, however long; sources without a weight, null included, form one pooled source ``*``;
weights of sources without rows count for nothing; rows that repeat get a place
each; an empty table gives an empty result.  Rows of equal id are ordered by the
hash of all their columns; columns of the result that the input already has get
underscores in front.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

POOLED = "*"
BLOCK_ROWS = 8
#: A period has as many blocks as the weights add up to; it is scheduled in one task and its schedule is broadcast.
MOST_WEIGHT = 4096


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + value(x))


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative numbers."""
    return ((a - a % b) / b).cast("long")


def schedule(sizes: DataFrame) -> DataFrame:
    """(c, cs, base, per, slot, src, j, release, deadline): the periods that differ.

    ``sizes``: one row for each source with src, w (weight) and nb (blocks).
    c: the first period of such a kind; cs: all of these; base: blocks before
    it; per: blocks in it; j: the block's number within its source's part of
    the period; slot, release and deadline count from the period's start.
    """
    one = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "w", "nb"))).alias("all"))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("all", lambda x: F.array(_div(x["nb"], x["w"]), _div(x["nb"], x["w"]) + 1))))))
    kinds = one.select("all", marks.alias("cs")).select("all", "cs", F.explode("cs").alias("c"))
    left = F.filter(F.transform("all", lambda x: F.struct(x["src"].alias("src"), x["w"].alias("w"), F.least(x["w"], x["nb"] - x["w"] * F.col("c")).alias("n"))), lambda x: x["n"] > 0)
    jobs = F.flatten(F.transform(left, lambda x: F.transform(F.sequence(F.lit(1).cast("long"), x["n"]), lambda j: F.struct(x["src"].alias("src"), x["w"].alias("w"), j.alias("j")))))
    base = _sum(F.col("all"), lambda x: F.least(x["nb"], x["w"] * F.col("c")))
    kinds = kinds.select("c", "cs", base.alias("base"), jobs.alias("jobs")).where(F.size("jobs") > 0)

    def served(x: Column, upto: Column) -> Column:
        """w times the blocks that the fluid mix has served when source x has had ``upto`` of its blocks."""
        return _sum(F.col("jobs"), lambda y: F.greatest(F.lit(0).cast("long"), F.least(x["w"], upto * y["w"] - (y["j"] - 1) * x["w"])))

    timed = F.transform("jobs", lambda x: F.struct(
        _div(served(x, x["j"]) + x["w"] - 1, x["w"]).alias("deadline"), x["src"].alias("src"), x["j"].alias("j"), _div(served(x, x["j"] - 1), x["w"]).alias("release")))
    kinds = kinds.select("c", "cs", "base", F.size("jobs").cast("long").alias("per"), timed.alias("jobs"))
    job = "array<struct<deadline:bigint,src:string,j:bigint,release:bigint>>"
    start = F.struct(F.col("jobs").cast(job).alias("open"), F.array().cast(job).alias("done"))

    def step(acc: Column, t: Column) -> Column:
        pick = F.array_min(F.filter(acc["open"], lambda x: x["release"] <= t))
        return F.struct(F.filter(acc["open"], lambda x: x != pick).alias("open"), F.concat(acc["done"], F.array(pick)).alias("done"))

    done = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("per") - 1), start, step, lambda acc: acc["done"])
    out = kinds.select("c", "cs", "base", "per", F.posexplode(done).alias("slot", "x"))
    return out.select("c", "cs", "base", "per", F.col("slot").cast("long").alias("slot"), "x.src", "x.j", "x.release", "x.deadline")


def mix(rows: DataFrame, weights: Mapping[str, int], source: str = "source", doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS, pooled_weight: int = 1, seed: int = 17) -> DataFrame:
    """The rows with all their columns and four more: mix_block (number within its source), mix_slot, mix_rank (within the block) and mix_position (slot * block_rows + rank)."""
    if pooled_weight < 1 or any(int(w) != w or w < 1 for w in weights.values()) or POOLED in weights or block_rows < 1:
        raise ValueError("weights and block_rows have to be positive whole numbers; '*' names the pooled source")
    if sum(map(int, weights.values())) + pooled_weight > MOST_WEIGHT:
        raise ValueError(f"the weights add up to more than {MOST_WEIGHT}; give them as smaller whole numbers")
    names = {c: free_name(rows, c) for c in ("mix_block", "mix_slot", "mix_rank", "mix_position")}
    n = rows.count()
    buckets = 2 ** max(6, math.ceil(math.log2(math.sqrt(max(n, 1)))))
    known = F.create_map(*(F.lit(x) for k, w in {**weights, POOLED: pooled_weight}.items() for x in (k, int(w))))
    src = F.when(F.col(source).isin(list(weights)), F.col(source).cast("string")).otherwise(F.lit(POOLED)) if weights else F.lit(POOLED)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    # the row is packed away, so no column of it can clash
    packed = rows.select(F.struct(*rows.columns).alias("row"), src.alias("s"), order.alias("o"), F.xxhash64(*rows.columns).alias("tie"))
    bucket = F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * buckets / 2**32
    packed = packed.withColumn("b", F.floor(bucket).cast("long"))
    counts = packed.groupBy("s", "b").agg(F.count("*").alias("k"))
    run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("s", "b", F.coalesce(F.sum("k").over(run), F.lit(0)).alias("before"))
    sizes = counts.groupBy("s").agg(F.sum("k").alias("rows")).select(F.col("s").alias("src"), F.element_at(known, F.col("s")).cast("long").alias("w"), F.ceil(F.col("rows") / block_rows).cast("long").alias("nb"))
    plan = schedule(sizes)
    marks = plan.groupBy("src").agg(F.first("cs").alias("cs")).join(sizes.select("src", "w"), "src").select(F.col("src").alias("s"), "cs", "w")
    within = Window.partitionBy("s", "b").orderBy("o", F.col("row")[doc_id], "tie")
    ranked = packed.withColumn("i", F.row_number().over(within) - 1).join(before, ["s", "b"]).join(F.broadcast(marks), "s")
    r = F.col("before") + F.col("i")
    ranked = ranked.select("row", "s", "cs", "w", r.alias("r"), _div(r, F.lit(block_rows)).alias("no"))
    ranked = ranked.withColumn("v", _div(F.col("no"), F.col("w"))).withColumn("c", F.array_max(F.filter("cs", lambda c: c <= F.col("v")))).withColumn("j", F.col("no") % F.col("w") + 1)
    plan = plan.select("c", F.col("src").alias("s"), "j", "base", "per", F.col("slot").alias("within"))
    placed = ranked.join(F.broadcast(plan), ["c", "s", "j"])
    slot = F.col("base") + (F.col("v") - F.col("c")) * F.col("per") + F.col("within")
    rank = F.col("r") % block_rows
    new = {"mix_block": F.col("no"), "mix_slot": slot, "mix_rank": rank, "mix_position": slot * block_rows + rank}
    return placed.select(*(F.col("row")[c].alias(c) for c in rows.columns), *(x.alias(names[c]) for c, x in new.items()))
