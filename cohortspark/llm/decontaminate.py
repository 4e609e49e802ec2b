"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits.  Numbers (in digits or words), units
after a number and capitalised words inside a sentence become typed
placeholders; a run of such words is one name, and everything else is
lower-cased.  A capital may also begin a sentence or be mere style (a title, a
heading), so a text is read three ways: capitals that begin a sentence as words,
as names too, and no names at all; a window counts again where that changes it.
Windows of five canonical tokens (at least two of them literal) are hash-joined
between documents and benchmark items.  Matches of one document and item are
grouped by alignment (difference of positions, and the ways both were read).
Within an alignment each filler of the item stands for one filler of the document, the
one that most of its windows have (of equally many its own, else the smallest hash); a window
counts if each of its slots has that filler or the item's own, so windows
without slots and verbatim ones always count.  Two fillers of an item may stand
for the same filler of a document, as new values are drawn independently.  A
document is contaminated by an item when the windows that count, by any
alignment, cover at least ``COVERAGE`` of the item's.

So a question whose numbers, names or units were replaced throughout is caught,
and a text that merely shares a sentence pattern with other fillers each time
isn't.  An item of fewer than five tokens has no window and matches nothing.

Scale: documents emit only windows whose hash occurs in the benchmark.  With up
to ``BROADCAST_WINDOWS`` benchmark windows (counted first) their hashes go to
the executors as one sorted array; beyond that all windows are shuffled.  Both
ways give the same rows.

Cases: null or wordless texts and items match nothing; items or documents that
repeat are matched each; rows with equal id and text are one document; a null
id is kept as an id of its own; a very long text is read whole; without items
nothing is contaminated, without documents nothing is found; other columns are
never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, free_name, tidy

WORDS = 5
LITERALS = 2
COVERAGE = 0.5
BROADCAST_WINDOWS = 300_000
ALIGNMENT = ("id", "part", "item_id", "item_part", "kind", "shift")
#: Unit words that become a placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent degrees degree dollars dollar euros euro cents cent usd eur gbp mph kmh kph hz khz mhz ghz w kw v volts watts joules newtons"
).split()

#: Numbers in words.  One is left out, as it is a pronoun more often.
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
#: Whether a character of one or two bytes, by these, is a capital.
_CAPITAL = np.zeros((256, 64), bool)
_CAPITAL[65:91] = True
for _cp in range(0x80, 0x800):
    _CAPITAL[0xC0 | _cp >> 6, _cp & 63] = chr(_cp).isupper()
_BREAK = np.isin(np.arange(256), np.frombuffer(b".!?:;|\n\"()[]", np.uint8))
_SLOTS = {kind: np.uint64(h) for kind, h in (("number", 0xA5A5_0001_9E37_0001), ("unit", 0xA5A5_0002_9E37_0003), ("name", 0xA5A5_0003_9E37_0007))}


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    buf = np.frombuffer(data, np.uint8)
    starts, ends, _ = bt.word_spans(buf, np.array([0, len(buf)]))
    return bt.hash_spans(buf, starts, ends, lower=True)


_UNIT_HASHES = np.sort(_hash_words(UNITS))
_NUMBER_HASHES = np.sort(_hash_words(NUMBER_WORDS))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


@dataclass(frozen=True)
class Reading:
    """A piece of texts read one way: of each canonical token its template hash, filler hash, whether it is a slot, whether this way changed it, and its place among the plain tokens; where each row begins, here and there."""

    kind: int
    template: np.ndarray
    filler: np.ndarray
    slot: np.ndarray
    changed: np.ndarray
    origin: np.ndarray
    first: np.ndarray
    first_plain: np.ndarray


def _capital(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _CAPITAL[buf[at], buf[np.minimum(at + 1, len(buf) - 1)] & 63]


def readings(buf: np.ndarray, off: np.ndarray) -> Iterator[Reading]:
    """The three ways: inner capitals as names; those that begin a sentence, too; no names."""
    inside = _IN_TOKEN[buf]
    point = (buf == 46) | (buf == 44)
    if len(buf) > 2:
        digit = _DIGIT[buf]
        inside[1:-1] |= point[1:-1] & digit[:-2] & digit[2:]
    starts, ends = bt.spans(inside, off)
    if not len(starts):
        return
    first = np.searchsorted(starts, off)
    filler = bt.hash_spans(buf, starts, ends, lower=True)
    number = _DIGIT[buf[starts]] | _member(_NUMBER_HASHES, filler)
    opens = np.zeros(len(starts), bool)
    opens[first[:-1][first[:-1] < len(starts)]] = True
    unit = _member(_UNIT_HASHES, filler)
    unit[1:] &= number[:-1]
    unit[0] = False
    unit &= ~opens & ~number
    breaks = bt.prefix_count(_BREAK[buf])
    inner = ~opens
    inner[1:] &= breaks[starts[1:]] == breaks[ends[:-1]]
    capital = _capital(buf, starts)
    # a word in capitals between others like it is a heading's, not a name
    loud = capital & (ends - starts > 1) & _capital(buf, np.minimum(starts + 1 + (buf[starts] >= 0xC0), len(buf) - 1))
    beside = np.zeros(len(starts), bool)
    beside[1:] |= loud[:-1] & inner[1:]
    beside[:-1] |= loud[1:] & inner[1:]
    capital &= ~(loud & beside) & ~number & ~unit
    for kind, name, changed in ((0, capital & inner, None), (1, capital, capital & ~inner), (2, None, capital & inner)):
        if kind and not changed.any():
            continue
        name = np.zeros(len(starts), bool) if name is None else name
        goes_on = name & inner
        goes_on[1:] &= name[:-1]
        goes_on[0] = False
        at = np.flatnonzero(~goes_on)
        within = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
        whole = np.add.reduceat(np.where(within == 0, filler, filler * bt._MIX[within & 31]), at)
        template = whole.copy()
        for slot, flags in (("number", number), ("unit", unit), ("name", name)):
            template[flags[at]] = _SLOTS[slot]
        touched = np.zeros(len(at), bool) if changed is None else np.logical_or.reduceat(changed, at)
        yield Reading(kind, template, whole, (number | unit | name)[at], touched, at, bt.prefix_count(~goes_on)[first], first)


def _windows(known: np.ndarray | None):
    """Windows of each row with enough literals; only those in ``known`` if given."""
    bitmap = None
    if known is not None:
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(known >> np.uint64(42)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off, _ in bt.text_chunks(b.column(2)):
                for r in readings(buf, off):
                    h, at = bt.window_hashes(r.template, r.first, WORDS)
                    keep = np.ones(len(h), bool) if bitmap is None else bitmap[(h >> np.uint64(42)).astype(np.int64)]
                    if r.kind:  # only windows that differ
                        changed = bt.prefix_count(r.changed)
                        keep &= changed[at + WORDS] > changed[at]
                    if known is not None:
                        keep[keep] = _member(known, h[keep])
                    h, at = h[keep], at[keep]
                    slots_before = bt.prefix_count(r.slot)
                    rich = WORDS - (slots_before[at + WORDS] - slots_before[at]) >= LITERALS
                    h, at = h[rich], at[rich]
                    row = np.searchsorted(r.first, at, "right") - 1
                    place = np.flatnonzero(r.slot)
                    a, z = slots_before[at], slots_before[at + WORDS]
                    values = r.filler[place[bt.ragged(a, z - a)]].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(z - a))).astype(np.int32)), pa.array(values))
                    pick = pa.array(lo + row)
                    columns = [b.column(0).take(pick), b.column(1).take(pick), pa.array(np.full(len(h), r.kind, np.int32)), pa.array(h.view(np.int64)), pa.array(at - r.first[row]), pa.array(r.origin[at] - r.first_plain[row]), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "part", "kind", "h", "pos", "origin", "slots"])

    return run


def windows(rows: DataFrame, id_col: str, text: str, known: np.ndarray | None = None) -> DataFrame:
    """(id, part, kind, h, pos, origin, slots): part tells rows of equal id but other text apart; kind is the way of reading, pos the place in it, origin that among plain tokens."""
    picked = rows.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("part"), F.col(text).alias("t"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(tidy(_windows(known)), f"id {kind}, part long, kind int, h long, pos long, origin long, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, part, item_id, n_matched, n_windows, n_slots): one row for each document and item that contaminates it."""
    # an item is told apart by id and text; equal ones are one item
    items = cut(windows(benchmark.select(item_id, item_text).distinct(), item_id, item_text))
    small = items.count() <= broadcast_windows
    known = np.unique(items.select("h").distinct().toArrow()["h"].to_numpy()).view(np.uint64) if small else None
    if known is not None:
        known = np.sort(known)
    found = windows(docs, doc_id, text, known)
    items = items.select(F.col("id").alias("item_id"), F.col("part").alias("item_part"), F.col("kind").alias("ikind"), "h", F.col("pos").alias("iat"), F.col("origin").alias("ipos"), F.col("slots").alias("islots"))
    sizes = items.groupBy("item_id", "item_part").agg(F.count_distinct("ipos").alias("n_windows"))
    pairs = found.join(F.broadcast(items) if small else items, "h")
    aligned = pairs.select(*ALIGNMENT[:-2], (F.col("kind") * 3 + F.col("ikind")).alias("kind"), (F.col("pos") - F.col("iat")).alias("shift"), "ipos", F.arrays_zip("islots", "slots").alias("fill"))
    # dealt by alignment, so what follows needs no other shuffle
    slots = aligned.repartition(*ALIGNMENT).distinct().select("*", F.explode_outer("fill").alias("f")).select(*ALIGNMENT, "ipos", "fill", F.col("f.islots").alias("own"), F.col("f.slots").alias("other"))
    often = slots.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy(*ALIGNMENT, "own", "other")))
    judged = often.withColumn("stands", F.first("other").over(Window.partitionBy(*ALIGNMENT, "own").orderBy(F.desc("often"), F.col("other") != F.col("own"), "other")))
    fits = F.col("own").isNull() | F.col("other").isin(F.col("own"), F.col("stands"))
    counting = judged.groupBy(*ALIGNMENT, "ipos", "fill").agg(F.every(fits).alias("fits")).where("fits")
    consistent = counting.groupBy(*ALIGNMENT).agg(F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set("fill"))).alias("fill"))
    covered = consistent.groupBy("id", "part", "item_id", "item_part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"), F.max(F.size("fill")).cast("long").alias("n_slots"))
    same_item = [covered[c].eqNullSafe(sizes[c]) for c in ("item_id", "item_part")]
    held = covered.join(F.broadcast(sizes) if small else sizes, same_item).where(F.col("n_matched") >= coverage * F.col("n_windows"))
    return held.select(F.col("id").alias("doc_id"), "part", covered["item_id"], "n_matched", "n_windows", "n_slots")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that no benchmark item contaminates."""
    own_id, own_part = free_name(docs, "_bad"), free_name(docs, "_part")
    bad = contaminated(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(own_id), F.col("part").alias(own_part)).distinct()
    return docs.join(cut(bad), docs[doc_id].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text]) == F.col(own_part)), "left_anti")
