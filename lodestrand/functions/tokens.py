"""Counting tokens by a vocabulary file, or by white space where none is given."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts whose counts a worker remembers, and the longest of them; and as much for the pieces of texts.
REMEMBERED, LONGEST = 20_000, 2_000
PIECES, LONGEST_PIECE = 200_000, 40
#: Unicode's white space, as the byte-level pre-tokenizer has it; it never joins a word with what is behind the word, nor white space with a word but for one space before it.
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_W}]+(?![^{_W}])| ?[^{_W}]+|[{_W}]")


def _byte_level(tokenizer) -> bool:
    """Whether a tokenizer's parts are those of the byte-level pattern, so that pieces of white space and words have tokens of their own."""
    config = json.loads(tokenizer.to_str())
    pre, model, post = config["pre_tokenizer"] or {}, config["model"], config["post_processor"] or {"type": "ByteLevel"}
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return split and config["normalizer"] is None and config["truncation"] is None and config["padding"] is None and model["type"] == "BPE" and not model.get("dropout") and post["type"] == "ByteLevel"


@lru_cache(maxsize=4)
def counter(path: str | None) -> Callable[[str], int]:
    """How many tokens a text has by the tokenizers file at path, special tokens not added; counts of short texts, and of a byte-level vocabulary's short pieces, are remembered up to a bound."""
    if path is None:
        return lambda text: len(text.split())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encode = tokenizer.encode
    whole = lambda text: len(encode(text, add_special_tokens=False).ids)
    count = whole
    if _byte_level(tokenizer):
        # Added tokens are cut out of a text first, which ends the white space before them.
        added = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        piece = lru_cache(maxsize=PIECES)(whole)

        def count(text: str) -> int:
            pieces = _PIECE.findall(text)
            return whole(text) if max(map(len, pieces), default=0) > LONGEST_PIECE or added.search(text) else sum(map(piece, pieces))

    kept = lru_cache(maxsize=REMEMBERED)(count)
    return lambda text: kept(text) if len(text) <= LONGEST else count(text)


def model_tokens(path: str | None):
    """A column function from text to its number of tokens; null has none."""

    @F.pandas_udf(T.LongType())
    def run(text: pd.Series) -> pd.Series:
        count = counter(path)
        return text.map(lambda t: count(t) if t else 0)

    return run
