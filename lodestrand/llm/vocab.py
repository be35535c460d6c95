"""Public tokenizer vocabularies read where the tokenizers package keeps them; never copied here."""

from __future__ import annotations

import json
import re
from functools import lru_cache

# White space as Unicode defines the property (control separators 1C-1F are not in it).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(added: list[str]) -> re.Pattern | None:
    """Pattern that cuts a text at the special strings of a tokenizer."""
    return re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    """Ranks of merges, vocabulary and special strings of a byte-pair tokenizer file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {
        "vocab": model["vocab"],
        "merges": merges,
        "suffix": model.get("end_of_word_suffix") or "",
        "added": {a["content"]: a["id"] for a in data.get("added_tokens", [])},
    }


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]
