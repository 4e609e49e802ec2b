import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import bytetext as bt
from cohortspark.llm.lmtrie import LEVELS, EliasFano, Trie
from cohortspark.llm.neardup import shingles, superminhash

from helpers import WORDS, lower_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b漢.\r#", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    seen, owner = {}, []
    for lo, hi, buf, off, null in bt.text_chunks(pa.array(texts, pa.string()), 32):
        starts, ends, first = bt.word_spans(buf, off)
        h = bt.hash_spans(buf, starts, ends, lower=True)
        for i in range(hi - lo):
            found = [bytes(buf[starts[k] : ends[k]]).decode() for k in range(first[i], first[i + 1])]
            assert found == WORDS(texts[lo + i] or "") and bool(null[i]) == (texts[lo + i] is None)
            for w, x in zip(lower_words(texts[lo + i]), h[first[i] : first[i + 1]]):
                assert seen.setdefault(w, x) == x
            owner.append(lo + i)
    assert owner == list(range(len(texts)))
    assert len(set(map(int, seen.values()))) == len(seen)


def test_hashes_don_t_hang_on_blocks(monkeypatch):
    text = " ".join(f"w{i}" * (1 + i % 7) for i in range(500)).encode()
    buf = np.frombuffer(text, np.uint8)
    s, e, _ = bt.word_spans(buf, np.array([0, len(buf)]))
    whole = bt.hash_spans(buf, s, e)
    monkeypatch.setattr(bt, "BLOCK", 13)
    assert np.array_equal(bt.hash_spans(buf, s, e), whole)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for n in (1, 3, 20, 400):
        for _ in range(30):
            pool = rng.integers(1, 2**62, 2 * n).astype(np.uint64)
            share = int(rng.integers(0, n + 1))
            a, b = pool[:n], np.concatenate((pool[:share], pool[n : 2 * n - share]))
            sig = superminhash(np.concatenate((a, b)), np.array([0, n, n + len(b)]), 128)
            assert (sig < np.uint64(128) << np.uint64(56)).all()
            errors.append((sig[0] == sig[1]).mean() - share / (2 * n - share))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_short_rows_are_one_shingle():
    words = np.arange(1, 9, dtype=np.uint64)
    h, begin = shingles(words, np.array([0, 0, 1, 3, 8]))
    assert np.diff(begin).tolist() == [0, 1, 1, 1] and len(set(h.tolist())) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.sampled_from([2**64, 2**40, 1000]))
def test_elias_fano(values, universe):
    values = np.sort(np.array([v % universe for v in values], np.uint64))
    ef = EliasFano.build(values, universe)
    assert np.array_equal(ef.all(), values)
    if len(values):
        assert np.array_equal(values[ef.find(values)], values)
        other = np.array([v for v in (5, universe - 1, int(values[0]) ^ 1) if v not in set(values.tolist())], np.uint64)
        assert (ef.find(other) == -1).all()
        half = len(values) // 2
        found = ef.find(values, np.full(len(values), half), np.full(len(values), len(values)))
        assert all(f == -1 if v < values[half] else values[f] == v for f, v in zip(found, values))


def test_many_questions_unpack_a_sequence_once(monkeypatch):
    """Many questions unpack all low bits once, few only those that they meet; both find the first place of a value."""
    values = np.sort(np.random.default_rng(3).integers(0, 2**40, 5000).astype(np.uint64))
    values[1000:1004] = values[1000]
    ef, unpacked, lows = EliasFano.build(values, 2**40), [], EliasFano._lows
    monkeypatch.setattr(EliasFano, "_lows", lambda self, i: unpacked.append(len(i)) or lows(self, i))
    want = np.searchsorted(values, values)
    assert np.array_equal(ef.find(values), want) and unpacked == [5000]
    unpacked.clear()
    few = np.arange(0, 5000, 500)
    assert np.array_equal(ef.find(values[few]), want[few]) and sum(unpacked) < 100


def test_level_round_trip(tmp_path):
    """A saved level is memory-mapped and gives every listed n-gram's probability, and its context's weight for the others."""
    rng = np.random.default_rng(7)
    contexts, words = (np.unique(rng.integers(0, 2**40, n)).astype(np.uint64) for n in (400, 90))
    listed = np.unique(np.concatenate((np.arange(len(contexts)) * len(words), rng.integers(0, len(contexts) * len(words), 12_000))))
    no = np.divmod(listed, len(words))
    logp, logw = -rng.random(len(listed)) * 4, -rng.random(len(contexts))
    file = str(tmp_path / "level")
    Trie.build(contexts, words, *no, logp, logw).save(file)
    t = Trie.open(file)
    assert isinstance(t.parts["successors.high"], np.memmap)
    every = np.divmod(np.arange(len(contexts) * len(words)), len(words))
    p, w = t.find(contexts, words, *every)
    there = np.isin(np.arange(len(contexts) * len(words)), listed)
    assert np.isnan(p[~there]).all() and np.abs(p[there] - logp).max() <= 4 / (LEVELS - 1) / 2 + 1e-12 and np.allclose(w, logw[every[0]], atol=1e-4)
    p, w = t.find(np.append(contexts[:2], contexts[-1] + 1), np.append(words, words[-1] + 1), np.array([2, 0]), np.array([0, len(words)]))
    assert np.isnan(p).all() and np.isnan(w[0]) and w[1] == pytest.approx(logw[0], abs=1e-4)
    assert sum(x.nbytes for name, x in t.parts.items() if "scale" not in name) < 6 * len(listed)
