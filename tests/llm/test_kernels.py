"""Kernels against plain Python."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import passages, quality
from assayer.llm.eliasfano import EliasFano
from assayer.llm.fmindex import FmIndex
from assayer.llm.ngram import dequantise, quantise
from assayer.llm.packing import Quotas
from assayer.llm.tokens import WordCoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "é🎉 a\xa0b", "a\x1cb", "x" * 5000, "Hello WORLD's don't <|endoftext|> 12,5 ŉ İ Σ ß ­", "你好 ½", "x\x00y\n\n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\n\té", max_size=80), min_size=1, max_size=6))
def test_quality_measures(texts):
    for column in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array(texts, pa.large_string())):
        got = []
        for block in quality._blocks(column):
            m = quality.Measures(block)
            got += list(zip(m.n_words.tolist(), m.word_chars.tolist(), m.n_symbols.tolist(), m.n_dup_lines.tolist(), m.n_repeat_words.tolist()))
        want = []
        for t in texts:
            w = re.findall("[^\x20\x09-\x0d]+", t)
            lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            at: dict = {}
            for i in range(len(w) - 7):
                at.setdefault(tuple(w[i : i + 8]), []).append(i)
            hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
            want.append((len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit)))
        assert got == want


def test_cascade_order_changes_no_verdict():
    texts = ["one two " * 30, "word " * 3, "", " ".join(f"w{i}" for i in range(40)), "a # $ % & " * 9]
    block = next(quality._blocks(pa.array(texts)))
    want = quality.verdicts(block, quality.RULES).tolist()
    assert quality.verdicts(block, quality.RULES[::-1]).tolist() == want
    assert want == [all(not r.rejects(quality.Measures(block))[i] for r in quality.RULES) for i in range(len(texts))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.integers(1, 4))
def test_fm_index(symbols, width):
    index = FmIndex(np.array(symbols), sample=4)
    patterns = np.array(sorted({tuple(symbols[i : i + width]) for i in range(len(symbols) - width + 1)} | {(9,) * width}))
    patterns = patterns[(patterns > 0).all(axis=1)]
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns.tolist(), lo, hi):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(symbols) - width + 1) if symbols[i : i + width] == p]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=80), st.integers(5001, 10**9))
def test_elias_fano(values, universe):
    v = np.array(sorted(values), np.int64)
    e = EliasFano.build(v, universe)
    assert e.get(np.arange(len(v))).tolist() == v.tolist()
    at = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(np.arange(5001)).tolist() == [at.get(x, -1) for x in range(5001)]


def test_quantised_counts():
    c = np.arange(1, 100000)
    back = dequantise(quantise(c))
    assert (back[:127] == c[:127]).all() and np.abs(back / c - 1).max() < 4e-4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=90), st.integers(2, 9))
def test_compact_windows(values, length):
    h = np.array(values, np.uint64) << np.uint64(20)
    l, c, r = passages.compact_windows(h, length)
    v, want = list(zip(h.tolist(), range(len(h)))), set()
    for m in range(len(v)):
        a = b = m
        while a > 0 and v[a - 1] > v[m]:
            a -= 1
        while b < len(v) - 1 and v[b + 1] > v[m]:
            b += 1
        if b - a + 1 >= length:
            want.add((max(a, m - length + 1), m, min(b, m + length - 1)))
    assert set(zip(l.tolist(), c.tolist(), r.tolist())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(16, 400), min_size=1, max_size=5))
def test_quotas_fill_every_window(totals):
    length = 16
    keep = [t for t in totals if t * length >= sum(totals)]
    q = Quotas(keep, length)
    seen = {}
    for s, n in enumerate(keep):
        for a, b, w, o in [p for x in range(0, n, 7) for p in q.cut(s, x, min(n, x + 7))]:
            for i in range(b - a):
                assert seen.setdefault((w, o + i), (s, a + i)) == (s, a + i)
    sizes: dict[int, int] = {}
    for w, _ in seen:
        sizes[w] = sizes.get(w, 0) + 1
    assert len(seen) == sum(keep)
    assert all(n == length or n & (n - 1) == 0 for n in sizes.values())
    assert all((w, o) in seen for w, n in sizes.items() for o in range(n))


@pytest.mark.parametrize("text", ODD)
def test_token_ids(text):
    c = WordCoder.load(TOKENIZER)
    for t in (text, *text.split(" ")):
        assert np.frombuffer(c.encode(t), c.dtype).tolist() == c.full.encode(t, add_special_tokens=False).ids


def test_words_of_letters_are_encoded_once():
    c = WordCoder(TOKENIZER)
    for text in ("été Été, ÉTÉ! été.", "ñesíque ñesíque; Ñesíque", "Word word, word:", "ªº µ ß, ŉx ǅ, ȡ.", "x\u00ad, e\u0301té, İx, a.b, ,x ,, <|x|>"):
        assert np.frombuffer(c.encode(text), c.dtype).tolist() == c.full.encode(text, add_special_tokens=False).ids, text
    assert {"été", "ñesíque", "word"} <= set(c.chunks)  # the other forms refer to these


def test_windows_of_a_queue_are_no_copies():
    q = Quotas([5000, 7000, 11000], 64)
    given, others = q.after(3, 9)
    assert np.shares_memory(given, q.after(0, 5)[0]) and given.sum(axis=1).tolist() == [64 * w for w in range(3, 10)]
    assert others[:, 0].tolist() == [0] * 7 and others[:, 2].tolist() == (given[:, 0] + given[:, 1]).tolist()
