"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to
three letters, a word edge counting as a letter), most frequent first.  A
document's own list is compared with each profile: every n-gram costs the
difference of its two ranks, or ``top`` where the profile lacks it.  The
language with the least total is predicted; ``score`` is one minus that total
over the largest possible one.

Cases: a null or letterless text is ``und`` with score 0; ties go to the
language name that sorts first; rows with null labels teach nothing; without
any labelled row every prediction is ``und``, and ``accepted`` accepts nothing;
repeated rows count each and are predicted alike; a very long text is worked on
whole, in some sixty bytes of memory for each of its own; an empty table gives no
profile and no prediction; only the id, text and language columns (and those that
the caller wants kept) are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import text_chunks
from .common import tidy

TOP = 300
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: A text whose score is lower is in none of the learned languages.  The least of 10,000 documents of the test tables has 0.37, their hundredth part 0.5; letters at random have 0.1 to 0.3, other languages in the same script up to 0.3, other scripts 0.
LEAST = 0.3
#: Texts are worked on in pieces of so many bytes; a byte takes up to a hundred while its n-grams are sorted.
PIECE = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point: its lower-case letter plus one, or one for what isn't a letter."""
    global _letters
    if _letters is None:
        table = np.ones(0x110000, np.uint64)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                table[cp] = ord(ch.lower()[0]) + 1
        _letters = table
    return _letters


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the 1-, 2- and 3-grams at each position (0: none), for the whole piece, and where each row begins."""
    marked = np.insert(buf, offsets[:-1], 10) if len(buf) else np.full(len(offsets) - 1, 10, np.uint8)
    rows = len(offsets) - 1
    begin_byte = offsets[:-1] + np.arange(rows)
    lead = (marked & 0xC0) != 0x80
    begin_cp = np.concatenate(([0], np.cumsum(lead)))[begin_byte]
    cps = np.frombuffer(marked.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    code = _letter_table()[cps]
    edge = code == 1
    keep = ~edge
    keep[1:] |= ~edge[:-1]
    keep[begin_cp] = True
    # the edge that closes a row is the next row's mark, unless the row ends in one already
    before = np.concatenate(([0], np.cumsum(keep)))
    begin = before[begin_cp]
    c = code[keep]
    return c, begin, np.append(begin[1:], len(c))


def _row_keys(c: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """All n-gram keys of one row, edge marks on both sides."""
    body = c[lo:hi]
    if len(body) < 2:
        return np.zeros(0, np.uint64)
    if body[-1] != 1:
        body = np.append(body, np.uint64(1))
    one = body[body != 1]
    two = (body[:-1] << np.uint64(21)) | body[1:]
    three = (two[:-1] << np.uint64(21)) | body[2:]
    return np.concatenate((one, two, three))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        held: dict[str, list[np.ndarray]] = {}
        for lo, hi, buf, off, _ in text_chunks(batch.column(0), PIECE):
            c, begin, end = _grams(buf, off)
            for i in range(hi - lo):
                keys = _row_keys(c, begin[i], end[i])
                if len(keys):
                    held.setdefault(langs[lo + i], []).append(keys)
            for lang, parts in held.items():
                k, n = _counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()


@dataclass(frozen=True)
class RankProfiles:
    """Learned profiles: ``langs`` sorted, and for every known n-gram its rank in each language (``top`` where absent)."""

    langs: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    top: int

    def predict(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text has a letter, for an Arrow string column."""
        names: list[str] = []
        scores: list[np.ndarray] = []
        for lo, hi, buf, off, _ in text_chunks(column, PIECE):
            c, begin, end = _grams(buf, off)
            tops, sizes = [], np.zeros(hi - lo, np.int64)
            for i in range(hi - lo):
                keys = _row_keys(c, begin[i], end[i])
                if len(keys):
                    k, n = _counted(keys)
                    best = k[np.argsort(-n, kind="stable")[: self.top]]
                    tops.append(best)
                    sizes[i] = len(best)
            best_lang, score = np.full(hi - lo, -1), np.zeros(hi - lo)
            full = np.flatnonzero(sizes)
            if len(full) and self.langs:
                keys, n = np.concatenate(tops), sizes[full]
                starts = np.cumsum(n) - n
                rank = np.arange(len(keys)) - np.repeat(starts, n)
                at = np.searchsorted(self.grams, keys)
                at[at == len(self.grams)] = 0
                at = np.where(self.grams[at] == keys, at, len(self.grams))
                cost = np.empty((len(full), len(self.langs)))
                for j in range(len(self.langs)):
                    r = self.ranks[at, j]
                    cost[:, j] = np.add.reduceat(np.where(r == self.top, self.top, np.abs(r - rank)), starts)
                best_lang[full] = np.argmin(cost, axis=1)
                score[full] = 1 - cost.min(axis=1) / (self.top * n)
            names += [self.langs[x] if x >= 0 else UNKNOWN for x in best_lang]
            scores.append(score)
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> RankProfiles:
    """Count every n-gram of every labelled text and keep each language's ``top`` most frequent (ties: smaller key).

    What reaches the driver is at most ``MAX_LANGUAGES * top`` rows; more labels than that raise.
    """
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = known.mapInArrow(tidy(_count_batches), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)
    got = best.limit(MAX_LANGUAGES * top + 1).toArrow()
    if got.num_rows > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = tuple(sorted(set(got["lang"].to_pylist())))
    gram = got["gram"].to_numpy().astype(np.uint64)
    grams = np.unique(gram)
    ranks = np.full((len(grams) + 1, len(langs)), top)
    column = {x: i for i, x in enumerate(langs)}
    ranks[np.searchsorted(grams, gram), [column[x] for x in got["lang"].to_pylist()]] = got["rank"].to_numpy()
    return RankProfiles(langs, grams, ranks, top)


def predict(rows: DataFrame, profiles: RankProfiles, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score, one row for each input row."""
    picked = rows.select(F.col(text).alias("_t"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = profiles.predict(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def accepted(rows: DataFrame, profiles: RankProfiles, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, whose text has a predicted language with a score of at least ``least``."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = profiles.predict(b.column(at))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, score)], pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.schema)
