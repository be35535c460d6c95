"""Chunkers: sentences packed by characters, and blocks packed by tokens within sections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import SENTENCE_PATTERN
from lodestrand.operators.folds import by_group

# Abbreviations that do not end a sentence, and where prose is cut after a terminator.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "et al.", "fig.", "eq.", "sec.", "no.", "ref.", "tab.", "cf.")
PROSE_CUT = r"(?<=[.!?])(?=\s+)|(?<=[。！？])(?=[^\s])"
_SENTENCE = re.compile(SENTENCE_PATTERN)


def _pieces(text: str, size: int, overlap: int) -> Iterator[str]:
    """Sentences; a longer one as windows of `size` that share `overlap` characters."""
    found = [m.group().strip() for m in _SENTENCE.finditer(text)]
    for sentence in filter(None, found or [text]):
        starts = range(0, max(1, len(sentence) - overlap), max(1, size - overlap)) if len(sentence) > size else (0,)
        for at in starts:
            yield sentence[at : at + size]
            if at + size >= len(sentence):
                break


def char_chunks(text: str | None, size: int = 900, overlap: int = 120) -> list[str]:
    """Whole sentences in chunks of at most `size` characters, the last sentences of a chunk carried over up to `overlap`.

    A longer sentence is cut in windows of `size` that overlap alike. A chunk is a range of
    pieces, found by their places in the joined text.
    """
    pieces = list(_pieces(" ".join((text or "").split()), size, overlap))
    end = list(accumulate((len(p) + 1 for p in pieces), initial=0))  # where each piece would begin
    chunks, first, done = [], 0, 0
    while done < len(pieces):
        stop = max(bisect_right(end, end[first] + size + 1) - 1, done + 1)
        chunks.append(" ".join(pieces[first:stop]))
        carried = max(bisect_left(end, end[stop] - overlap - 1), first) if overlap > 0 else stop
        fits = stop < len(pieces) and end[stop + 1] - 1 - end[min(carried, stop)] <= size
        first, done = (min(carried, stop) if fits else stop), stop
    return chunks


def chunk_documents(docs: DataFrame, size: int = 900, overlap: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_index, content; documents without text give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, c) for d, t in zip(pdf["id"], pdf["text"]) for i, c in enumerate(char_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "doc_id long, chunk_index long, content string")


def split_prose(text: str) -> list[str]:
    """Sentences by terminators before white space (or, in CJK text, before anything).

    A part that is an abbreviation as a whole goes on with the next one; longer parts that
    end in one do not.
    """
    sentences, carried = [], ""
    for part in filter(None, map(str.strip, re.split(PROSE_CUT, text.strip()))):
        sentence = carried + part
        if sentence.casefold() in ABBREVIATIONS:
            carried = sentence + " "
        else:
            sentences.append(sentence)
            carried = ""
    return [*sentences, carried.strip()] if carried else sentences


def block_chunks(blocks: list[tuple[str, str]], target: int = 350, least: int = 100, most: int = 800, overlap: float = 0.12) -> list[tuple[str, str]]:
    """(section, text) chunks of (section, text) blocks in order, by white-space tokens.

    Blocks of one section are packed up to target; a chunk begins with the last sentences of
    the one before, up to the overlap's share; a longer block is cut by sentences, a longer
    sentence by words. A rest under the least joins the chunk before it if both fit.
    """
    count = lambda s: len(s.split())
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(blocks):
        section = blocks[at][0]
        units: list[str] = []
        while at < len(blocks) and blocks[at][0] == section:
            text = blocks[at][1].strip()
            if count(text) <= most:
                units += [text] if text else []
            else:
                for s in split_prose(text):
                    words = s.split()
                    units += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
            at += 1
        made: list[str] = []
        now: list[str] = []
        for u in units:
            if now and count(" ".join(now)) + count(u) > target:
                made.append(" ".join(now))
                tail: list[str] = []
                for s in reversed(split_prose(made[-1])):
                    if count(s) + count(" ".join(tail)) > overlap * target:
                        break
                    tail.insert(0, s)
                now = tail if count(" ".join(tail)) + count(u) <= most else []
            now.append(u)
        if now:
            rest = " ".join(now)
            if made and count(rest) < least and count(made[-1]) + count(rest) <= most:
                made[-1] += " " + rest
            else:
                made.append(rest)
        out += [(section, c) for c in made]
    return out


def chunk_blocks(blocks: DataFrame, key: str = "doc_id", **sizes) -> DataFrame:
    """doc_id, chunk_index, section, content, tokens from blocks (key, ord, section, text), a document at a step."""

    def step(at: tuple, rows: list[dict]) -> list[tuple]:
        made = block_chunks([(r["section"] or "", r["text"] or "") for r in sorted(rows, key=lambda r: r["ord"])], **sizes)
        return [(*at, i, s, c, len(c.split())) for i, (s, c) in enumerate(made)]

    slim = blocks.select(F.col(key).cast("long").alias("id"), "ord", "section", "text")
    return by_group(slim, ("id",), step, "doc_id long, chunk_index long, section string, content string, tokens long")
