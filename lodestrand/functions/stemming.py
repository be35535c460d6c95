"""The full tokenizer: NFKC, words, English stems, CJK bigrams. It needs Unicode tables, so it runs as an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.segment import Segmenter
from lodestrand.functions.text import CJK_PATTERN, WORD_PATTERN

# Fixed values of the published English stemmer: exceptional forms, doubles, suffix lists.
SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
LI_BEFORE = frozenset("cdeghkmnrt")
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
_VOWELS = frozenset("aeiouy")


def _regions(w: str) -> tuple[int, int]:
    """Starts of the two regions after a vowel and a consonant."""
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else _after(w, 0)
    return r1, _after(w, r1)


def _after(w: str, at: int) -> int:
    for i in range(at + 1, len(w)):
        if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """English stem of a lower-case ASCII word, by the published second-generation suffix stripper."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # past forms
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                base = w[: -len(s)]
                if any(c in _VOWELS for c in base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in DOUBLES:
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # derivational endings
    for s, by in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + by
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in LI_BEFORE:
            w = w[:-2]
    for s, by in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + by
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD, _CJK = re.compile(WORD_PATTERN), re.compile(CJK_PATTERN)


def mixed_tokens(text: str | None, distinct: bool = True, segmenter: Segmenter | None = None) -> list[str]:
    """Words with their stems, then CJK runs as a segmenter's words, or as bigrams without one; first occurrences only if distinct."""
    t = unicodedata.normalize("NFKC", text or "")
    out: list[str] = []
    for w in _WORD.findall(t):
        w = w.casefold()
        out.append(w)
        if w.isalpha() and len(w) > 3 and (s := stem(w)) != w:
            out.append(s)
    for run in _CJK.findall(t) if segmenter is None else ():
        out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
    if segmenter is not None:
        out += segmenter.words(t)
    return list(dict.fromkeys(out)) if distinct else out


def tokens_by(spark: SparkSession, words: dict[str, int] | None, distinct: bool = False):
    """A column function from text to its tokens, with CJK runs cut by a vocabulary (functions/segment.py), if given."""
    value = spark.sparkContext.broadcast(words) if words else None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        segmenter = Segmenter(value.value) if value is not None else None
        return text.map(lambda x: mixed_tokens(x, distinct, segmenter))

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def mixed_tokens_udf(text: pd.Series) -> pd.Series:
    return text.map(mixed_tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_tokens(text: pd.Series) -> pd.Series:
    """Every token of a text, repeats kept: what an index counts."""
    return text.map(lambda x: mixed_tokens(x, distinct=False))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
