import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import wordcore as wc

TEXT = st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85é日A", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 30))
def test_words_equal_a_plain_split(texts, size):
    got = []
    for w in wc.word_batches(pa.array(texts, pa.string()), size=size):
        for i in range(w.rows):
            got.append([w.text(j, j + 1) for j in range(w.ptr[i], w.ptr[i + 1])])
    assert got == [(t or "").encode().split() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 4))
def test_grams_depend_on_words_alone(texts, k):
    seen = {}
    for size in (8, 10_000):
        for w in wc.word_batches(pa.array(texts, pa.string()), size=size):
            g = wc.Grams(w.hashes()).of(k)
            ok = wc.inside(w.ptr, len(w), k)
            row = w.row_of()
            for i in range(len(w) - k + 1):
                assert ok[i] == (row[i] == row[i + k - 1])
                if ok[i]:
                    words = tuple(w.text(j, j + 1) for j in range(i, i + k))
                    assert seen.setdefault(words, g[i]) == g[i]
    assert len(set(seen.values())) == len(seen)


def test_sliding():
    x = np.array([3, 1, 2, 5, 4, 0, 7])
    for w in range(1, 8):
        assert wc.sliding(x, w, np.minimum).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
    assert len(wc.sliding(x, 9, np.minimum)) == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = ["ab cd  ", "x" * 50 + " y é日A tail", "", "one two three four five six"]
    whole = [w.hashes().tolist() for w in wc.word_batches(pa.array(texts))]
    for part in (1, 4, 7, 30):
        monkeypatch.setattr(wc, "PART", part)
        assert [w.hashes().tolist() for w in wc.word_batches(pa.array(texts))] == whole


def test_leftmost_least():
    x = np.array([3, 1, 2, 1, 4, 0, 0, 7])
    for w in range(1, 9):
        assert wc.leftmost_least(x, w).tolist() == [i + int(x[i : i + w].argmin()) for i in range(len(x) - w + 1)]
    assert len(wc.leftmost_least(x, 9)) == 0
