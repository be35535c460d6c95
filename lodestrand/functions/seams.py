"""Places where models plug in, each with a deterministic default that needs none."""

from __future__ import annotations

import difflib
import functools
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.stemming import mixed_tokens


def hashed_embedding(text: str | None, width: int = 64) -> list[float]:
    """Signed feature hashing of tokens, of length 1; all zeros without tokens."""
    v = np.zeros(width)
    for t in mixed_tokens(text, distinct=False):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % width] += 1.0 if h >> 63 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).round(7).tolist()


def embedder(embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 16):
    """A column function from text to a vector; embed gets at most `batch` texts at a time, sorted by length."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(text: pd.Series) -> pd.Series:
        values = text.fillna("").tolist()
        if embed is None:
            return pd.Series([hashed_embedding(t) for t in values])
        order = sorted(range(len(values)), key=lambda i: len(values[i]))
        out: list = [None] * len(values)
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            for i, v in zip(part, embed([values[i] for i in part])):
                out[i] = v
        return pd.Series(out)

    return run


class _Text:
    """A chunk's side of a comparison, which serves all evidence that comes for it in a row: words, and where its letters stand.

    Of a text of 200 letters or more difflib leaves out the places of frequent letters, so few are left to
    begin a match; of a shorter one every letter counts, and all places are bits of one number.
    """

    def __init__(self, b: str):
        self.b, self.words = b, set(b.split())
        self.places = difflib.SequenceMatcher(None, "", b).b2j
        self.dense = len(b) < 200
        self.width = len(b) // 8 + 1  # bytes of a row of places, with a bit to spare at its end
        if self.dense:
            self.rows = {c: sum(1 << j for j in js).to_bytes(self.width, "little") for c, js in self.places.items()}

    def shared(self, a: str, at: dict[str, list[int]]) -> int:
        """Letters in difflib's matching blocks of a, whose letters stand at these places, with this text."""
        return self._dense(a) if self.dense else self._sparse(a, at)

    def _grown(self, a: str, alo: int, ahi: int, blo: int, bhi: int, i: int, j: int, k: int) -> tuple[int, int, int]:
        """A run of k letters with all equal letters before and after it."""
        b = self.b
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return i, j, k

    def _sparse(self, a: str, at: dict[str, list[int]]) -> int:
        """By the places (row * i + j) where letters agree; they are few, and so are those that follow one another."""
        row, places = len(self.b) + 1, self.places
        same = sorted([i * row + j for c in at.keys() & places.keys() for i in at[c] for j in places[c]])
        runs = not set(same).isdisjoint([p + row + 1 for p in same])
        total, todo = 0, [(0, len(a), 0, len(self.b), same)]
        while todo:
            alo, ahi, blo, bhi, same = todo.pop()
            i, j, k = alo, blo, 0
            if same and not runs:
                (i, j), k = divmod(same[0], row), 1
            elif same:  # the longest run, the first of a in case of ties, then of b
                length: dict[int, int] = {}
                for p in same:
                    length[p] = n = length.get(p - row - 1, 0) + 1
                    if n > k:
                        k, end = n, p
                i, j = divmod(end - (k - 1) * (row + 1), row)
            i, j, k = self._grown(a, alo, ahi, blo, bhi, i, j, k)
            total += k
            if same and alo < i and blo < j:
                todo.append((alo, i, blo, j, [p for p in same[: bisect_left(same, i * row)] if p % row < j]))
            if same and i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi, [p for p in same[bisect_left(same, (i + k) * row) :] if p % row >= j + k]))
        return total

    def _dense(self, a: str) -> int:
        none = bytes(self.width)
        found = int.from_bytes(b"".join([self.rows.get(c, none) for c in a]), "little")
        total, todo = 0, [(0, len(a), 0, len(self.b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, k = self._longest_dense(found, alo, ahi, blo, bhi)
            total += k
            if k and alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if k and i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi))
        return total

    def _longest_dense(self, found: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The longest run, by places as bits, a row for each letter of a: runs grow by a row and a bit at a time."""
        row = 8 * self.width
        at = (found >> alo * row) & int.from_bytes(((1 << bhi) - (1 << blo)).to_bytes(self.width, "little") * (ahi - alo), "little")
        if not at:
            return alo, blo, 0
        runs, k = at, 1
        while longer := at & (runs >> k * (row + 1)):
            at, k = longer, k + 1
        i, j = divmod((at & -at).bit_length() - 1, row)
        return alo + i, j, k


_chunk = functools.lru_cache(64)(_Text)


@functools.lru_cache(1024)
def _evidence(a: str) -> tuple[set[str], dict[str, list[int]]]:
    """Words of a text, and where each letter stands."""
    at: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        at.setdefault(c, []).append(i)
    return set(a.split()), at


def _scores(a: str, bs: list[str], least: float) -> list[float]:
    """Of a normalised text with each of a list: the greater of the words' F1 and the share of matching letters.

    The share is left out where the lengths show that it is below the F1 of the best, or below least.
    """
    chunks, (words, at) = [_chunk(b) for b in bs], _evidence(a)
    f1 = [2.0 * both / (len(words) + len(c.words)) if (both := len(words & c.words)) else 0.0 for c in chunks]
    floor = max([least, *f1])
    out = []
    for score, c in zip(f1, chunks):
        n = len(a) + len(c.b)
        if a and c.b and 2.0 * min(len(a), len(c.b)) / n >= floor:
            score = max(score, 2.0 * c.shared(a, at) / n)
        out.append(score)
    return out


@F.pandas_udf(T.DoubleType())
def match_score(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    """The greater of F1 and the share of matching characters of two normalised texts; the share is spared where it is surely below the row's floor."""
    return pd.Series([_scores(x, [y], f)[0] for x, y, f in zip(a, b, floor)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def match_scores(a: pd.Series, bs: pd.Series, floor: pd.Series) -> pd.Series:
    """match_score() of a text with each of a list; the share is spared where it is surely below the best F1 of the list too."""
    return pd.Series([None if y is None else _scores(x, y, f) for x, y, f in zip(a, bs, floor)], dtype=object)


@F.pandas_udf(T.StringType())
def evidence_text(text: pd.Series) -> pd.Series:
    """Letters and digits of a text under compatibility forms and case folding, runs joined by one space."""
    return text.map(lambda t: " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").casefold())))


def caption_description(path: str, caption: str) -> str:
    """What can be said of a figure without a model: its caption, in one line of 200 characters at most."""
    line = " ".join(caption.split())
    if not line:
        raise ValueError("nothing is known of the figure")
    return f"Figure: {line}"[:200]


def describer(describe: Callable[[str, str], str] = caption_description):
    """A column function from an image's path and caption to struct(text, error); one figure's failure leaves the others alone.

    error is `no_image` without a path, `empty` for a description without text, or the kind of error that
    describe raised.
    """

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
    def run(path: pd.Series, caption: pd.Series) -> pd.DataFrame:
        out: list[tuple[str | None, str | None]] = []
        for p, c in zip(path, caption):
            if not p:
                out.append((None, "no_image"))
                continue
            try:
                text = (describe(p, c or "") or "").strip()
                out.append((text, None) if text else (None, "empty"))
            except Exception as e:  # whatever a model raises is told of its figure alone
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["text", "error"])

    return run


def keyword_router(question):
    """Intent by keywords, where no router model is at hand."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.when(q.rlike("(hello|thanks|hi\\b)"), "direct_answer").when(q.rlike("(compare|versus|why|across)"), "agentic_rag").otherwise("simple_rag")
