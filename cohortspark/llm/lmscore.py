"""Language-model scores of whole texts, by a trigram model learned from the corpus.

Every word, pair and triple of the training rows is in the model, from a count
of one on, whatever the size of the corpus.  Smoothing is hierarchical: an
n-gram has (count + MU * p) / (count of its context + MU), where MU hangs on its
length and p is the probability by the shorter context and, at the end, the additive unigram
(c + 0.5) / (N + 0.5 * (V + 1)).  So an n-gram needs nothing of its context but
a count that is known before, and the successors of a hot context can lie apart.

Texts are tokenised once, into piece files in the shared folder.  Then, level by
level, every piece sends each of its distinct n-grams once (with its training
count in the piece, its context's count and its shorter probability) to the
n-gram's shard.  A shard adds the counts up, builds an Elias-Fano level
(``lmtrie``) of the n-grams that occur, memory-maps it and answers from it, with
probabilities of 16 bits.  A piece notes which tokens its questions were about,
so that the answers find their way without the questions being put together
again, and writes the answers beside its file; those of the pairs go into the
questions about the triples.  N-grams with the same
context share a shard, unless the context has more than a quarter of a shard's
tokens: then they are dealt by word, too.  The number of shards grows with the
corpus, a level is worked on in ``RANGES`` ranges of shards, so that only that
share of it is in shuffle files at a time, and a shard's level goes once it has
answered, unless ``levels`` names a folder to keep them in.

base_score adds up log10 of the unigram probabilities, score is the model's
log10 probability, which comes to the same where a context never occurred.

Cases: a null text is empty and has one token, the end; a null id is in the
training part; repeated rows count and score each; without training rows N and
V are 0; an empty table gives an empty result; a very long text is a piece of
its own, about a hundred bytes of memory for each of its words; other columns
are never read.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import fold_of, saved, temporary, tidy, work_dir
from .lmtrie import Trie, place

U64 = np.uint64
#: Weight of the shorter context's probability, for pairs and for triples.  On held-out rows of the test tables (0.3 and 3 million tokens) 512 and 4
#: come within 0.03 decades a token of the best of a grid from 8 to 1024 by 2 to 32, and are 0.30 and 0.36 better than 8 for both.
MU = {2: 512.0, 3: 4.0}
#: Bytes of text in a piece; training tokens of a shard, about.
PIECE = 4 << 20
SHARD_TOKENS = 1_000_000
MIN_SHARDS = 16
#: Contexts with fewer tokens are never hot.
HOT_LEAST = 1000
RANGES = {2: 3, 3: 3}
#: The token that ends every document; words have hashes of their bytes, and this is none of an actual word's.
END = U64(0xE0D0E0D0_5EED_0001)
#: Answers are -log10 p in steps of 1 / STEPS.
STEPS = 4096
_LOW40 = U64(2**40 - 1)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' tokens, each row's end included, and where each row begins."""
    starts, ends, first = bt.word_spans(buf, off)
    words = bt.hash_spans(buf, starts, ends, lower=True)
    n = np.diff(first) + 1
    begin = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(begin[-1]), U64)
    inner = np.ones(len(out), bool)
    inner[begin[1:] - 1] = False
    out[inner] = words
    out[~inner] = END
    return out, begin


def _ordered(keys: np.ndarray) -> np.ndarray:
    """An order by the keys' leading bits, then by place: all bits but the few that a place takes."""
    bits = U64(max(len(keys) - 1, 1).bit_length())
    packed = keys >> bits << bits | np.arange(len(keys), dtype=U64)
    packed.sort()
    return (packed & U64(2 ** int(bits) - 1)).astype(np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sorted(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of whole numbers below 2**top, and them in it."""
    bits = U64(max(len(values) - 1, 1).bit_length())
    if top + int(bits) > 64:
        order = np.argsort(values, kind="stable")
        return order, values[order]
    packed = values << bits | np.arange(len(values), dtype=U64)
    packed.sort()
    return (packed & U64(2 ** int(bits) - 1)).astype(np.int64), packed >> bits


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values below 2**40 and each value's place among them."""
    order, s = _sorted(values, 40)
    at = _runs(s)
    back = np.empty(len(values), np.int64)
    back[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(s))))
    return s[at], back


def _renumbered(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n that occur, and each one's place among them."""
    flags = np.zeros(n, bool)
    flags[numbers] = True
    return np.flatnonzero(flags), (np.cumsum(flags) - 1)[numbers]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the fewest bytes that hold its largest."""
    parts = []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
        parts.append(np.asarray(x).astype(kind))
    head = np.array([len(arrays), *(v for x in parts for v in (x.itemsize, len(x)))], np.uint32)
    return head.tobytes() + b"".join(x.tobytes() for x in parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    head = np.frombuffer(data, np.uint32, 2 * n, 4)
    out, at = [], 4 + 8 * n
    for size, length in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, f"<u{size}", length, at))
        at += size * length
    return out


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 byte by byte, in as few bytes as hold the largest."""
    n = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T[:n]).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    """The n numbers that ``_planes`` wrote."""
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(np.frombuffer(data, np.uint8).reshape(-1, n) if n else ()):
        out |= plane.astype(np.uint32) << np.uint32(8 * k)
    return out


def _split40(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & U64(0xFFFFFFFF)).astype(np.uint32), (x >> U64(32)).astype(np.uint8)


def _join40(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.astype(U64) << U64(32) | low


def _store(fs: pafs.FileSystem, path: str, *columns: bytes) -> None:
    """Write one file at once; a repeated task writes the same again."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array([c], pa.large_binary()) for c in columns], [str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(sink.getvalue())
    fs.move(own, path)


def _load(fs: pafs.FileSystem, path: str) -> list[bytes]:
    with fs.open_input_stream(path, compression=None) as src:
        batch = pa.ipc.open_stream(src.read()).read_next_batch()
    return [c[0].as_buffer() for c in batch.columns]


# -- pieces


PIECES = "piece string, docs long, train long"


def _cut_pieces(folder: str):
    """Tokenise rows (id, held_out, text) and write a file for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        for b in batches:
            for lo, hi, buf, off, _ in bt.text_chunks(b.column(2), PIECE):
                h, begin = tokens(buf, off)
                order = _ordered(h)
                at = _runs(h[order])
                number = np.empty(len(h), np.uint32)
                number[order] = np.repeat(np.arange(len(at), dtype=np.uint32), np.diff(np.append(at, len(h))))
                ids = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)], ["id", "held_out"])
                held = ids.column(1).to_numpy(zero_copy_only=False)
                n = np.diff(begin)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as w:
                    w.write_batch(ids)
                name = uuid.uuid4().hex
                _store(fs, f"{path}/{name}", sink.getvalue().to_pybytes(), n.astype(np.int64).tobytes(), held.tobytes(), h[order[at]].tobytes(), _planes(number))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([hi - lo]), pa.array([int(n[~held].sum())])], ["piece", "docs", "train"])

    return run


class _Piece:
    """A piece's tokens, and what was answered about them so far."""

    def __init__(self, folder: str, name: str):
        self.fs, self.path = place(folder)
        self.name = name
        self.ids, n, held, words, planes = _load(self.fs, f"{self.path}/{name}")
        self.n, self.words = np.frombuffer(n, np.int64), np.frombuffer(words, U64)
        self.row_train = ~np.frombuffer(held, bool)
        self.begin = np.concatenate(([0], np.cumsum(self.n)))
        self.number = _from_planes(planes, int(self.begin[-1]))

    @functools.cached_property
    def h(self) -> np.ndarray:
        return self.words[self.number]

    @functools.cached_property
    def train(self) -> np.ndarray:
        return np.repeat(self.row_train, self.n)

    @functools.cached_property
    def row(self) -> np.ndarray:
        """Each token's row."""
        return np.repeat(np.arange(len(self.n), dtype=np.uint32), self.n)

    def file(self, kind: str) -> str:
        return f"{self.path}/{self.name}.{kind}"

    def full(self, level: int) -> np.ndarray:
        """Whether each token has level - 1 tokens before it in its row."""
        out = np.ones(len(self.number), bool)
        for k in range(level - 1):
            out[self.begin[:-1][self.n > k] + k] = False
        return out

    @functools.cached_property
    def counts(self) -> np.ndarray:
        """Training counts of the tokens' words."""
        return _unpack(_load(self.fs, self.file("1"))[0])[0].astype(np.int64)[self.number]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token the count of the pair that it ends and its probability's code; 0 for a row's first token."""
        size = len(self.number)
        count, code = np.zeros(size, np.uint32), np.zeros(size, np.uint16)
        left = int(np.maximum(self.n - 1, 0).sum())
        for i in range(RANGES[2]):
            if self.fs.get_file_info(self.file(f"2-{i}")).type == pafs.FileType.File:  # else no pair lies there
                bits, data = _load(self.fs, self.file(f"2-{i}"))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=size).view(bool))
                some = _unpack(data)
                if some[0].itemsize > count.itemsize:
                    count = count.astype(U64)
                count[at], code[at] = some
                left -= len(at)
        if left:
            raise RuntimeError(f"{left} pairs of piece {self.name} have no answer")
        return count, code

    def context(self, level: int) -> np.ndarray:
        """Hash of each token's context (of what stands before, where the row has less)."""
        out = np.empty_like(self.h)
        out[:1] = 0
        out[1:] = self.h[:-1]
        if level == 3:
            out[2:] = bt.avalanche(self.h[:-2] * bt._MIX[33] + self.h[1:-1] * bt._MIX[34])
        return out


class _Model:
    """Sizes that all parts of a run share."""

    def __init__(self, n: int, shards: int):
        self.n, self.shards, self.bits = n, shards, U64(64 - (shards.bit_length() - 1))
        self.hot = max(n / shards / 4, HOT_LEAST)
        self.total = 0.0

    def inside(self, route: np.ndarray, level: int, i: int) -> np.ndarray:
        """Whether the shard that the leading bits tell is in the i-th range."""
        first, end = (self.shards * k // RANGES[level] << int(self.bits) for k in (i, i + 1))
        return route - U64(first) <= U64(end - first - 1)

    def edges(self, route: np.ndarray) -> np.ndarray:
        """Where each shard begins in sorted routes, and the end."""
        return np.append(np.searchsorted(route >> self.bits, np.arange(self.shards, dtype=U64)), len(route))


# -- questions, answers


CELLS = "part int, piece string, cell binary"


def _cells(part: list[int], piece: list[str], cell: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(piece, pa.string()), pa.array(cell, pa.binary())], ["part", "piece", "cell"])


def _pieces(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    for b in batches:
        for name in b.column(0).to_pylist():
            yield _Piece(folder, name)


def _ask_words(folder: str, model: _Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pieces(folder, batches):
            count = np.bincount(p.number[p.train], minlength=len(p.words))
            e = model.edges(p.words)
            some = np.flatnonzero(np.diff(e)).tolist()
            yield _cells(some, [p.name] * len(some), [_pack(p.words[e[i] : e[i + 1]], count[e[i] : e[i + 1]]) for i in some])

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[list[np.ndarray]]]]:
    """The cells of each shard, whose rows come together."""
    now, names, cells = None, [], []
    for b in batches:
        for part, name, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if part != now:
                if names:
                    yield now, names, cells
                now, names, cells = part, [], []
            names.append(name)
            cells.append(_unpack(cell.as_buffer()))
    if names:
        yield now, names, cells


#: The row of this name in a shard's answers about words says how many of its words occur.
SHARD = ""


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, names, cells in _shards(batches):
        h, count = (np.concatenate([c[k] for c in cells]).astype(U64) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        at = _runs(h[order])
        sums = np.add.reduceat(count[order], at)
        out = np.empty(len(h), U64)
        out[order] = np.repeat(sums, np.diff(np.append(at, len(h))))
        sizes = np.cumsum([len(c[0]) for c in cells])[:-1]
        yield _cells([part] * (len(names) + 1), [*names, SHARD], [*map(_pack, np.split(out, sizes)), _pack(np.array([(sums > 0).sum()]))])


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[np.ndarray]]]]:
    """The answers to each piece, in the order of the shards."""
    now, held = None, []
    for b in batches:
        for part, name, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if name != now:
                if held:
                    yield now, held
                now, held = name, []
            held.append(_unpack(cell.as_buffer()))
    if held:
        yield now, held


def _finish_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        for name, held in _by_piece(batches):
            every = np.concatenate([x[0] for x in held])
            if name != SHARD:
                _store(fs, f"{path}/{name}.1", _pack(every))
            yield pa.RecordBatch.from_arrays([pa.array([int(every.sum()) if name == SHARD else 0])], ["v"])

    return run


def _questions(p: _Piece, level: int, i: int, model: _Model):
    """(tokens asked about, order of them, where a new question begins in that order); in that order their routes, contexts, words, contexts' counts and shorter probabilities."""
    context = p.context(level)
    if level == 2:
        count, lower = p.counts, lambda at: np.log10((p.counts[at] + 0.5) / model.total) * -STEPS
    else:
        count, code = p.pairs()
        lower = lambda at: code[at]
    route = context
    hot = np.flatnonzero(count[:-1] > model.hot) + 1
    if len(hot):
        route = context.copy()
        route[hot] = bt.avalanche(context[hot] ^ bt.avalanche(p.h[hot] + U64(level)))
    at = np.flatnonzero(model.inside(route, level, i) & p.full(level))
    route, context, words = route[at], context[at] & _LOW40, p.h[at]
    order = _ordered(route & U64(0xFFFFFFFF_00000000) | words >> U64(32))
    route, context, words, at = route[order], context[order], words[order] & _LOW40, at[order]
    return at, _runs(context, words), route, context, words, count[at - 1], lower(at)


def _asked(path: str, level: int, i: int) -> str:
    """The folder of the pieces' notes about the questions of a range."""
    return f"{path}/asked-{level}-{i}"


def _ask(folder: str, level: int, i: int, model: _Model):
    """Put a piece's questions, and note in their order which tokens (of triples: tokens of which rows) they are about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pieces(folder, batches):
            at, new, route, context, words, before, lower = _questions(p, level, i, model)
            if not len(new):
                continue
            begins = np.zeros(len(at), bool)
            begins[new] = True
            sizes = np.array([len(p.number), len(p.n), len(at)])
            _store(p.fs, f"{_asked(p.path, level, i)}/{p.name}", sizes.tobytes(), np.packbits(begins).tobytes(), _planes(at if level == 2 else p.row[at]))
            count = np.add.reduceat(p.train[at], new, dtype=np.int64)
            code = np.minimum(np.rint(lower[new]), 65535).astype(np.uint16)
            context, words, before = context[new], words[new], before[new]
            e = model.edges(route[new])
            some = np.flatnonzero(np.diff(e)).tolist()
            cells = []
            for k in some:
                a, z = e[k], e[k + 1]
                run_at = _runs(context[a:z])
                cells.append(_pack(*_split40(context[a:z][run_at]), np.diff(np.append(run_at, z - a)), before[a:z][run_at], *_split40(words[a:z]), count[a:z], code[a:z]))
            yield _cells(some, [p.name] * len(some), cells)

    return run


def _answer(folder: str, level: int, keep: bool):
    """Add up, build, save and open a shard's level, and answer the questions from it."""
    mu = MU[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names, cells in _shards(batches):
            sizes = np.array([len(c[4]) for c in cells])
            c_low, c_high, length, before, w_low, w_high, count, code = (np.concatenate([c[k] for c in cells]) for k in range(8))
            contexts, run_no = _numbered(_join40(c_low, c_high))
            words, word_no = _numbered(_join40(w_low, w_high))
            of_context = np.zeros(len(contexts), np.int64)
            of_context[run_no] = before
            context_no = np.repeat(run_no, length.astype(np.int64))
            order, key = _sorted(context_no.astype(U64) * U64(len(words)) + word_no.astype(U64), max(len(contexts) * len(words), 1).bit_length())
            at = _runs(key)
            sums = np.add.reduceat(count[order].astype(np.int64), at)
            first = order[at]
            context_no, word_no = context_no[first], word_no[first]
            of = of_context[context_no]
            code = code[first]
            there = np.flatnonzero(sums)
            p = np.full(len(at), np.nan)
            weight = p.copy()
            if len(there):
                used, used_no = _renumbered(context_no[there], len(contexts))
                some, some_no = _renumbered(word_no[there], len(words))
                logp = np.log10((sums[there] + mu * 10.0 ** (code[there] / -STEPS)) / (of[there] + mu))
                file = f"{folder}/{level}-{part}.{uuid.uuid4().hex}"
                Trie.build(contexts[used], words[some], used_no, some_no, logp, np.log10(mu / (of_context[used] + mu))).save(file)
                p, weight = Trie.open(file).find(contexts, words, context_no, word_no)
                fs, path = place(file)
                if keep:
                    fs.move(path, f"{path.rpartition('.')[0]}.ef")
                else:
                    fs.delete_file(path)
            # a context that occurs with none of this shard's words is only in other shards
            apart = np.flatnonzero(np.isnan(weight))
            weight[apart] = np.log10(mu / (of[apart] + mu))
            answer = np.where(np.isnan(p), weight * -STEPS + code, p * -STEPS)
            answer = np.minimum(np.rint(answer), 65535).astype(np.uint16)
            group = np.empty(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
            ends = np.cumsum(sizes)[:-1]
            answers = [_pack(x) if level == 3 else _pack(x, c) for x, c in zip(np.split(answer[group], ends), np.split(sums[group], ends))]
            yield _cells([part] * len(names), names, answers)

    return run


def _finish(folder: str, level: int, i: int):
    """Write the answers beside the piece: of pairs by token, of triples added up by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        for name, held in _by_piece(batches):
            sizes, begins, planes = _load(fs, f"{_asked(path, level, i)}/{name}")
            tokens, rows, n = np.frombuffer(sizes, np.int64).tolist()
            question = np.cumsum(np.unpackbits(np.frombuffer(begins, np.uint8), count=n), dtype=np.int64) - 1
            about = _from_planes(planes, n)
            code, *count = (np.concatenate([c[k] for c in held]) for k in range(len(held[0])))
            if question[-1] + 1 != len(code):
                raise RuntimeError(f"{len(code)} answers to {question[-1] + 1} questions of piece {name}")
            if level == 2:
                of_token = np.full(tokens, -1)
                of_token[about] = question
                asked = of_token >= 0
                question = of_token[np.flatnonzero(asked)]
                _store(fs, f"{path}/{name}.2-{i}", np.packbits(asked).tobytes(), _pack(count[0][question], code[question]))
            else:
                _store(fs, f"{path}/{name}.3-{i}", np.bincount(about, code[question], rows).tobytes(), np.int64(n).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["v"])

    return run


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _scored(folder: str, model: _Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pieces(folder, batches):
            known = p.counts
            row = p.row
            lone = np.log10((known + 0.5) / model.total)
            short = np.where(p.full(2), p.pairs()[1] / -STEPS, lone) * ~p.full(3)
            base, score, seen = (np.bincount(row, x, len(p.n)) for x in (lone, short, known > 0))
            left = int(p.full(3).sum())
            for i in range(RANGES[3]):
                if p.fs.get_file_info(p.file(f"3-{i}")).type == pafs.FileType.File:  # else no triple lies there
                    sums, n = _load(p.fs, p.file(f"3-{i}"))
                    score -= np.frombuffer(sums, np.float64) / STEPS
                    left -= int(np.frombuffer(n, np.int64)[0])
            if left:
                raise RuntimeError(f"{left} triples of piece {p.name} have no answer")
            docs = pa.ipc.open_stream(p.ids).read_next_batch()
            yield pa.RecordBatch.from_arrays([*docs.columns, pa.array(p.n), pa.array(seen.astype(np.int64)), pa.array(np.full(len(p.n), model.n)), pa.array(base), pa.array(score)], RESULT)

    return run


@contextlib.contextmanager
def _no_shuffles_left(spark):
    """Have every query's shuffle files removed at its end; for queries that aren't read a second time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, levels: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    ``levels``: a folder, shared and existing, in which the shards' levels stay.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), (fold_of(F.col(doc_id), folds) == held_out).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    folder = work_dir(spark, "pieces")
    fs, path = place(folder)
    fs.create_dir(path, recursive=True)
    temporary(spark, folder)
    pieces = saved(rows.mapInArrow(tidy(_cut_pieces(folder)), PIECES), "piece-names")
    n_pieces, n = pieces.agg(F.count("*"), F.coalesce(F.sum("train"), F.lit(0))).first()
    model = _Model(n, 1 << (max(MIN_SHARDS, -(-n // SHARD_TOKENS)) - 1).bit_length())
    # names are tiny and their pieces aren't: a task for every four of them, which it works on in turn, as every task costs
    names = pieces.select("piece").repartition(max(1, n_pieces // 4), "piece")
    # twice as many partitions as shards, as two shards can fall together
    to_shards = lambda asked, shards: asked.repartition(2 * shards, "part").sortWithinPartitions("part", "piece")
    to_pieces = lambda answered: answered.repartition(max(1, n_pieces // 3), "piece").sortWithinPartitions("piece", "part")
    with _no_shuffles_left(spark):
        answered = to_shards(names.mapInArrow(tidy(_ask_words(folder, model)), CELLS), model.shards).mapInArrow(tidy(_answer_words), CELLS)
        v = to_pieces(answered).mapInArrow(tidy(_finish_words(folder)), "v long").agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
        model.total = n + 0.5 * (v + 1)
        for level, ranges in RANGES.items():
            for i in range(ranges):
                fs.create_dir(_asked(path, level, i))
                asked = to_shards(names.mapInArrow(tidy(_ask(folder, level, i, model)), CELLS), max(1, model.shards // ranges))
                answered = asked.mapInArrow(tidy(_answer(levels or folder, level, levels is not None)), CELLS)
                to_pieces(answered).mapInArrow(tidy(_finish(folder, level, i)), "v long").agg(F.sum("v")).collect()
                fs.delete_dir(_asked(path, level, i))
        fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        done = saved(names.mapInArrow(tidy(_scored(folder, model)), fields), "scored")
    fs.delete_dir(path)
    return done
