"""An Elias-Fano n-gram trie: one level of a smoothed n-gram model, compact and memory-mapped.

A level lists the n-grams that occur, by context: the contexts as sorted 40-bit
hashes, monotone pointers that give each context the range of its successors,
and the successors as word numbers, made monotone over the level by adding the
context's number times the number of words.  Contexts, pointers, words and
successors are Elias-Fano sequences.  A query finds its context and its word,
then searches the successors relative to that context, within its range only.

An n-gram has its smoothed probability, a context the weight of what it doesn't
list, both quantised to ``LEVELS`` even levels between the least and the largest.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow.fs as pafs

U64 = np.uint64


class EliasFano:
    """A non-decreasing sequence of integers below 2**64: low bits packed, high bits unary."""

    PARTS = ("head", "low", "high")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.head, self.low, self.high = head, low, high
        self.n, self.bits = int(head[0]), int(head[1])
        self.starts: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, U64)
        n = len(v)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits and n:
            part = v & U64(2**bits - 1)
            pos = np.arange(n, dtype=U64) * U64(bits)
            word, off = (pos >> U64(6)).astype(np.int64), pos & U64(63)
            # equal words are neighbours, so each one's parts are or-ed as a run
            at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low[word[at]] = np.bitwise_or.reduceat(part << off, at)
            over = np.flatnonzero(off + U64(bits) > U64(64))  # at most one for each word
            low[word[over] + 1] |= part[over] >> (U64(64) - off[over])
        at = (v >> U64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(at[-1]) if n else 0) // 64 + 1) * 64, bool)
        flags[at] = True
        return cls(np.array([n, bits], np.int64), low, np.packbits(flags, bitorder="little").view(U64))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the values at the given places."""
        if not self.bits:
            return np.zeros(len(i), U64)
        pos = i.astype(U64) * U64(self.bits)
        w, off = (pos >> U64(6)).astype(np.int64), pos & U64(63)
        low = self.low[w] >> off
        over = np.flatnonzero(off + U64(self.bits) > U64(64))
        low[over] |= self.low[w[over] + 1] << (U64(64) - off[over])
        return low & U64(2**self.bits - 1)

    def _flags(self) -> np.ndarray:
        """The high bits in unary: the i-th value's flag lies at its high part plus i."""
        return np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little").view(bool)

    def _highs(self) -> np.ndarray:
        return np.flatnonzero(self._flags())[: self.n] - np.arange(self.n)

    def all(self) -> np.ndarray:
        """Every value in turn."""
        return self._highs().astype(U64) << U64(self.bits) | self._lows(np.arange(self.n))

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each x, in the range [lo, hi) if given, or -1."""
        x = np.asarray(x, U64)
        if self.starts is None:  # where the values of each high part begin: the h-th gap follows all whose high part is h at most
            gaps = np.flatnonzero(~self._flags())
            self.starts = np.concatenate(([0], gaps - np.arange(len(gaps)), [self.n]))
        top = (x >> U64(self.bits)).astype(np.int64)
        inside = top < len(self.starts) - 1
        top[~inside] = 0
        first, end = self.starts[top], self.starts[top + 1]
        if lo is not None:
            first, end = np.maximum(first, lo), np.minimum(end, hi)
        # for many questions all low bits are unpacked once, else those that are met
        lows = self._lows if 4 * len(x) < self.n else self._lows(np.arange(self.n)).__getitem__
        found = np.full(len(x), -1)
        open_ = np.flatnonzero(inside & (first < end))
        first, end, low = first[open_], end[open_], x[open_] & U64(2**self.bits - 1)
        while len(open_):
            mid = (first + end) >> 1
            met = lows(mid)
            same = np.flatnonzero(met == low)
            found[open_[same]] = mid[same]  # an equal value before it, if any, is met later
            less = met < low
            first, end = np.where(less, mid + 1, first), np.where(less, end, mid)
            on = np.flatnonzero(first < end)
            open_, first, end, low = open_[on], first[on], end[on], low[on]
        return found


LEVELS = 1 << 16


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least value and distance of the ``LEVELS`` levels, the values' levels)."""
    if not len(x):
        return np.zeros(2), np.zeros(0, np.uint16)
    least, step = x.min(), (x.max() - x.min()) / (LEVELS - 1)
    return np.array([least, step]), np.rint((x - least) / (step or 1)).astype(np.uint16)


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class Trie:
    """An opened level."""

    SEQUENCES = ("words", "contexts", "pointers", "successors")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.words, self.contexts, self.pointers, self.successors = (EliasFano(*(parts[f"{s}.{p}"] for p in EliasFano.PARTS)) for s in self.SEQUENCES)

    @classmethod
    def build(cls, contexts: np.ndarray, words: np.ndarray, context_no: np.ndarray, word_no: np.ndarray, logp: np.ndarray, logw: np.ndarray) -> Trie:
        """contexts, words: sorted 40-bit hashes; context_no, word_no, logp: of the n-grams, in that order; logw: of the contexts."""
        n = len(context_no)
        values = {
            "words": (words, 2**40), "contexts": (contexts, 2**40), "pointers": (np.searchsorted(context_no, np.arange(len(contexts) + 1)), n + 1),
            "successors": (context_no.astype(U64) * U64(len(words)) + word_no.astype(U64), max(len(contexts) * len(words), 1)),
        }
        parts = {}
        for name, (v, universe) in values.items():
            ef = EliasFano.build(v, universe)
            parts |= {f"{name}.{p}": getattr(ef, p) for p in EliasFano.PARTS}
        for name, v in (("p", logp), ("w", logw)):
            parts[f"{name}.scale"], parts[f"{name}.code"] = quantised(v)
        return cls(parts)

    def save(self, file: str) -> None:
        """One file: a line of JSON that says where each part lies, then the parts."""
        fs, path = place(file)
        head, at = {}, 0
        for name, x in self.parts.items():
            head[name] = (x.dtype.str, len(x), at)
            at += -(-x.nbytes // 64) * 64
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 64) + b"\n"
        with fs.open_output_stream(path, compression=None) as out:
            out.write(line)
            for x in self.parts.values():
                out.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 64))

    @classmethod
    def open(cls, file: str) -> Trie:
        """Memory-map the file; from a store without paths it is read."""
        fs, path = place(file)
        if isinstance(fs, pafs.LocalFileSystem):
            data = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_stream(path, compression=None) as src:
                data = np.frombuffer(src.read(), np.uint8)
        size = 64
        while data[size - 1] != 10:
            size += 64
        head = json.loads(bytes(data[:size]))
        return cls({name: data[size + at : size + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in head.items()})

    def find(self, contexts: np.ndarray, words: np.ndarray, context_of: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 (probability, NaN where the n-gram isn't listed; weight of its context, NaN where that isn't) of each n-gram (contexts[context_of], words[word_of])."""
        c, w = self.contexts.find(contexts), self.words.find(words)
        pointers = self.pointers.all().astype(np.int64)
        at, word = c[context_of], w[word_of]
        known = np.flatnonzero((at >= 0) & (word >= 0))
        at, word = at[known], word[known]
        found = self.successors.find(at.astype(U64) * U64(self.words.n) + word.astype(U64), pointers[at], pointers[at + 1])
        p, weight = np.full(len(context_of), np.nan), np.full(len(contexts), np.nan)
        hit = np.flatnonzero(found >= 0)
        p[known[hit]] = self._value("p", found[hit])
        weight[c >= 0] = self._value("w", c[c >= 0])
        return p, weight[context_of]

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        least, step = self.parts[f"{name}.scale"]
        return least + step * self.parts[f"{name}.code"][at]
