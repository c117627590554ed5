"""Vectorised words and hashes against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _text as T
from tessera.llm.op3_substring_dedup import earlier, runs, window_minimum

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab AB\t\n\x0b\x0c\r.é漢🙂 \x1f")), max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_words_and_hashes(texts):
    raw, offsets = T.buffers(pa.array(texts, pa.string()))
    words = T.Words(raw, offsets)
    want = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    got = [raw[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
    assert got == [w for d in want for w in d]
    assert words.counts.tolist() == [len(d) for d in want]
    for lower in (False, True):
        h = words.hashes(lower)
        fold = [re.sub("[A-Z]", lambda m: m.group().lower(), w) if lower else w for w in got]
        assert len(set(h.tolist())) == len(set(fold))
        assert {w: x for w, x in zip(fold, h.tolist())} == dict(zip(fold, h.tolist()))
        assert all(h[i] == h[j] for i in range(len(h)) for j in range(i) if fold[i] == fold[j])


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_grams(items, k):
    h = T.mix(np.array(items, dtype=np.uint64) + np.uint64(5))
    g = T.grams(h, k)
    want = [tuple(items[i : i + k]) for i in range(len(items) - k + 1)]
    assert len(g) == len(want)
    assert all((g[i] == g[j]) == (want[i] == want[j]) for i in range(len(g)) for j in range(i))


@given(st.lists(st.integers(0, 99), min_size=15, max_size=60), st.integers(1, 15))
def test_window_minimum(values, width):
    got = window_minimum(np.array(values), width)
    assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@given(st.lists(st.integers(0, 4), max_size=40))
def test_earlier(keys):
    """The place before with an equal key; windows of one place are one."""
    n = np.arange(len(keys))
    ref, fresh = earlier(n, n * 0, n, np.array(keys, dtype=np.uint64))
    assert ref.tolist() == [max((j for j in range(k) if keys[j] == x), default=-1) for k, x in enumerate(keys)] and fresh.all()
    doc, key = np.repeat(n, 2), np.repeat(np.array(keys, dtype=np.uint64), 2)
    twice, fresh = earlier(doc, doc * 0, doc, key)
    assert (np.where(twice < 0, -1, twice // 2)).tolist() == np.repeat(ref, 2).tolist() and fresh.sum() == len(keys)


def test_runs():
    doc, start, same = np.array([1, 1, 1, 2, 2]), np.array([4, 5, 7, 8, 9]), np.array([0, 0, 0, 1, 2])
    i, n = runs(doc, start, same)
    assert i.tolist() == [0, 2, 3, 4] and n.tolist() == [2, 1, 1, 1]


def test_long_texts_stand_alone():
    texts = ["a" * 10, "b " * (T.CHUNK_BYTES), "c"]
    got = list(T.text_chunks(pa.array(texts)))
    assert [(i, j) for i, j, _ in got] == [(0, 1), (1, 2), (2, 3)] and len(got[1][2]) == T.CHUNK_BYTES
