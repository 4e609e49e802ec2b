"""Quality rules: gradient-boosted trees over document statistics.

One pass over the texts yields a narrow table of statistics; the trees are
fitted on at most ``SAMPLE`` labelled rows of it (those with the smallest id
hashes; a documented bound, the only one) and scored on all of it.  Trees are
flattened into numpy arrays of complete binary trees, so scoring walks one
level of one tree for a whole batch at a time.  Features in ``MONOTONE`` can
only lower the score as they grow.

Base rule: a document fails with fewer than 10 words, or with more than a fifth
of its words in repeated 5-word windows.  Case and spelling count as they are.

Cases: a null or empty text has no words and fails; rows without a label teach
nothing; without labelled rows of both classes every base-passing document is
kept (score 1); a document with several labels teaches with each; labelled rows
with equal id hashes are taken by id, then label; repeated rows are judged alike;
a very long text is one piece of some fifty bytes of memory for each of its own;
an empty table gives an empty one; only the id, text and label columns are read,
so columns of any other name may stand beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import saved, tidy

#: At most so many labelled rows reach the driver to fit the trees.
SAMPLE = 20_000
KEEP_FROM = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "line_words", "pipe_share", "closing_share")
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1, "pipe_share": -1}

_flag = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_SYMBOL, _UPPER, _DIGIT, _MARK, _PIPE, _STOP = map(_flag, (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?", b"|", b".!?"))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the keys, and for each sorted place whether the same key stands just before it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    return order, again


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and the feature matrix of every row of a piece."""
    rows = len(off) - 1
    starts, ends, first = bt.word_spans(buf, off)
    n_words = np.diff(first)
    per_row = lambda flags: np.diff(bt.prefix_count(flags)[off])
    row_of = np.repeat(np.arange(rows), n_words)
    words = bt.hash_spans(buf, starts, ends)
    lead = (buf & 0xC0) != 0x80
    word_chars = per_row(lead & ~bt._IS_SEP[buf])
    ls, le = bt.spans(buf != 10, off)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[has], le[has]
    line_row = np.searchsorted(off, ls, "right") - 1
    order, again = _repeats(bt.combine(bt.hash_spans(buf, ls, le), line_row))
    n_dup_lines = np.bincount(line_row[order[again]], minlength=rows)
    n_lines = np.bincount(line_row, minlength=rows)
    h, at = bt.window_hashes(words, first, 5)
    order, again = _repeats(bt.combine(h, row_of[at]) if len(at) else h)
    twice = again.copy()
    twice[:-1] |= again[1:]
    cover = np.zeros(len(words) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    n_repeat_words = np.bincount(row_of[np.cumsum(cover)[:-1] > 0], minlength=rows) if len(words) else np.zeros(rows, np.int64)
    order, again = _repeats(bt.combine(words.copy(), row_of)) if len(words) else (np.zeros(0, int), np.zeros(0, bool))
    distinct = n_words - np.bincount(row_of[order[again]], minlength=rows)
    closing = np.bincount(row_of[_STOP[buf[ends - 1]]], minlength=rows) if len(words) else np.zeros(rows)
    n_symbols = per_row(_SYMBOL[buf])
    base = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
    nw, nc = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    x = np.column_stack([
        np.log1p(n_words), word_chars / nw, n_symbols / nc, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / nw, per_row(_UPPER[buf]) / nc,
        per_row(_DIGIT[buf]) / nc, per_row(_MARK[buf]) / nw, distinct / nw, n_words / np.maximum(n_lines, 1), per_row(_PIPE[buf]) / nw, closing / nw,
    ])
    return base, x


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, off, _ in bt.text_chunks(b.column(1)):
            base, x = statistics(buf, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(base[k].astype(np.int64)) for k in BASE), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["id", *BASE, *FEATURES])


@dataclass(frozen=True)
class FlatTrees:
    """Boosted trees as arrays of shape (trees, nodes): node i has children 2i+1 and 2i+2; a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> FlatTrees:
    """Histogram boosting of the logistic loss.

    ``monotone`` has -1, 0 or 1 for each feature.  A split on a constrained
    feature has to order its two values so, and the subtrees below inherit the
    middle of the two as a bound, which keeps whole trees monotone.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    nodes = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, nodes), np.int64)
    threshold = np.full((trees, nodes), np.inf)
    value = np.zeros((trees, nodes))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        held = {0: (np.arange(len(y)), -np.inf, np.inf)}
        for node in range(nodes):
            if node not in held:
                continue
            rows, lo, hi = held.pop(node)
            own = np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi)
            best = None
            if node < 2**depth - 1 and h[rows].sum() >= 2 * least:
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    wl, wr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                    gain = -(gl * wl + (hl + ridge) * wl**2 / 2 + gr * wr + (hr + ridge) * wr**2 / 2)
                    gain[(hl < least) | (hr < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if best is None or gain[k] > best[0]:
                        best = gain[k], f, k, wl[k], wr[k]
                stay = -(g[rows].sum() * own + (h[rows].sum() + ridge) * own**2 / 2)
                if best is not None and not best[0] > stay + 1e-6:
                    best = None
            if node >= 2**depth - 1:
                value[t, node] = own * rate
                total[rows] += own * rate
                continue
            if best is None:  # an unsplit node hands all rows to its left child
                held[2 * node + 1] = rows, lo, hi
                continue
            _, f, k, wl, wr = best
            feature[t, node], threshold[t, node] = f, edges[f][k]
            right = binned[rows, f] > k
            middle = (wl + wr) / 2
            left_bound, right_bound = ((lo, hi), (lo, hi)) if not monotone[f] else ((lo, middle), (middle, hi)) if monotone[f] > 0 else ((middle, hi), (lo, middle))
            held[2 * node + 1] = rows[~right], *left_bound
            held[2 * node + 2] = rows[right], *right_bound
    return FlatTrees(feature, threshold, value, depth, start)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base counts and features of every row, written once to the shared folder."""
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kind = picked.schema["id"].dataType.simpleString()
    stats = picked.mapInArrow(tidy(_stats), f"id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES))
    return saved(stats, "statistics")


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> FlatTrees | None:
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
    rows = stats.join(known, "id").select("id", "y", *FEATURES).orderBy(F.xxhash64("id"), "id", "y").limit(sample).toArrow()
    y = rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = np.column_stack([rows[c].to_numpy() for c in FEATURES])
    return fit_trees(x, (y > 0).astype(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(stats: DataFrame, trees: FlatTrees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """id, base counts, base_failed, kept and the quality score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(1 + len(BASE) + i).to_numpy() for i in range(len(FEATURES))])
            score = trees.score(x) if trees else np.ones(len(b))
            n, repeat = b.column(1).to_numpy(), b.column(5).to_numpy()
            failed = (n < 10) | (100 * repeat > 20 * n)
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(BASE)], pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")
