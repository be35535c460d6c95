"""Chunks of a document's blocks by tokens of a vocabulary: sections and references apart, sentences carried over, what they came from kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.functions.tokens import counter
from lodestrand.operators.chunking import split_prose
from lodestrand.operators.folds import by_group

#: Kinds of blocks that are prose; others are chunks of their own elsewhere.
PROSE = ("paragraph", "list", "abstract", "reference", "unknown")
SCHEMA = (
    "doc_id long, chunk_uid string, section_uid string, section string, subsection string, content string, tokens long, block_uids array<string>, "
    "page_start long, page_end long, page_boxes map<long,array<double>>, embedding_text string"
)


@dataclass
class Sizes:
    target: int = 350
    least: int = 100
    most: int = 800
    overlap: float = 0.12

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most or not 0 <= self.overlap < 0.5:
            raise ValueError("sizes have to be least <= target <= most, and an overlap below a half")


def _fitting(parts: list[str], start: int, most: int, count: Callable[[str], int]) -> int:
    """Where parts from start on, joined by spaces, grow over `most` tokens; one part at least. More parts never have fewer tokens."""
    last = len(parts) - start
    fits = lambda n: count(" ".join(parts[start : start + n])) <= most
    n = total = 0  # a guess, from what each part has by itself
    while n < last and (total := total + count(" " + parts[start + n] if n else parts[start])) <= most:
        n += 1
    lo, hi, step = max(n, 1), max(n, 1), 1
    if fits(lo):
        while hi < last and fits(hi := min(hi + step, last)):
            lo, step = hi, 2 * step
    else:
        while lo > 1 and not fits(lo := max(lo - step, 1)):
            hi, step = lo, 2 * step
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return start + lo


def _last_sentences(sentences: list[str], limit: int, count: Callable[[str], int]) -> int:
    """How many of the last sentences fit a limit of tokens, the last one in any case."""
    n = total = 0
    for s in reversed(sentences):
        total += count(s)
        if n and total > limit:
            break
        n += 1
    return n


def _cut(text: str, sizes: Sizes, count: Callable[[str], int]) -> list[str]:
    """A block that is too long, by sentences, or by words if it is one sentence; pieces overlap."""
    sentences, out, at = split_prose(text), [], 0
    if len(sentences) > 1:
        while at < len(sentences):
            end = _fitting(sentences, at, sizes.most, count)
            out.append(" ".join(sentences[at:end]))
            if end == len(sentences):
                break
            at = max(end - _last_sentences(sentences[at:end], max(1, int(sizes.most * sizes.overlap)), count), at + 1)
        return out
    words = text.split()
    while at < len(words):
        end = _fitting(words, at, sizes.most, count)
        if end < len(words):
            stop = next((i for i in range(end - 1, at, -1) if words[i].endswith((".", "!", "?"))), at)
            end = stop + 1 if stop > at + sizes.least // 2 else end
        out.append(" ".join(words[at:end]))
        if end >= len(words):
            break
        at = max(end - max(1, int((end - at) * sizes.overlap)), at + 1)
    return out


def section_chunks(texts: list[str], sizes: Sizes, count: Callable[[str], int]) -> list[list[tuple[int, str]]]:
    """Chunks of one section's blocks, each as (block, text) parts.

    Blocks are gathered up to target tokens. The next chunk begins with the last sentences of
    the one before, up to the overlap's share of target, unless the next block would not fit
    with them. A block of more than `most` tokens is cut and stands alone.
    """
    out: list[list[tuple[int, str]]] = []
    now: list[tuple[int, str]] = []
    held, carried = 0, False
    for i, text in enumerate(texts):
        n = count(text)
        if n > sizes.most:
            out += [now] if now else []
            out += [[(i, piece)] for piece in _cut(text, sizes, count)]
            now, held, carried = [], 0, False
            continue
        if now and held + n > sizes.target:
            out.append(now)
            block, last = now[-1]
            sentences = split_prose(last) if sizes.overlap > 0 else []
            k = _last_sentences(sentences, max(1, int(sizes.target * sizes.overlap)), count)
            now = [(block, " ".join(sentences[-k:]))] if k else []
            held, carried = sum(count(x) for _, x in now), bool(now)
        if carried and held + n > sizes.most:
            now, held = [], 0
        now.append((i, text))
        held, carried = held + n, False
    return [*out, now] if now else out


def _groups(rows: list) -> list[list]:
    """Runs of blocks of one section; a reference is a run of its own."""
    out: list[list] = []
    for r in rows:
        key = lambda b: (b.section_uid, b.section, b.subsection)
        if out and key(out[-1][-1]) == key(r) and "reference" not in (r.kind, out[-1][-1].kind):
            out[-1].append(r)
        else:
            out.append([r])
    return out


def chunk_by_tokens(blocks: DataFrame, tokenizer_path: str | None, sizes: Sizes = Sizes(), title: str | None = None, drop: DataFrame | None = None) -> DataFrame:
    """Chunks of documents by a vocabulary's tokens, with the blocks, pages and boxes that they came from.

    blocks: doc_id, ord, uid, kind, section_uid, section, subsection, page, text, x0, y0, x1, y1, and
    the column named by title, if any. Only prose kinds are taken, less the blocks of drop (doc_id,
    uid), such as those that an equation has taken. Lines are joined as printed text is. A document's
    blocks are one step; counts come from a bounded table. chunk_uid is text-<run>-<place in it>;
    embedding_text is title, section, subsection and content, those that there are, a line each.
    """
    b = blocks.where(F.col("kind").isin(*PROSE) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    if drop is not None:
        b = b.join(drop.select("doc_id", "uid").distinct(), ["doc_id", "uid"], "left_anti")
    slim = b.select(
        F.col("doc_id").cast("long"), F.col("ord").cast("long"), "uid", "kind", "section_uid", "section", "subsection", F.col("page").cast("long"), tx.join_lines(F.col("text")).alias("text"),
        *(F.col(s).cast("double") for s in ("x0", "y0", "x1", "y1")), (F.col(title) if title else F.lit(None)).cast("string").alias("title"),
    )

    def run(key: tuple, found: list[dict]) -> list[tuple]:
        count = counter(tokenizer_path)
        given = [SimpleNamespace(**{k: None if v != v else v for k, v in r.items()}) for r in found]
        last = lambda v: (v is None, 0 if v is None else v)
        out = []
        for g, group in enumerate(_groups(sorted(given, key=lambda r: (last(r.ord), (r.uid is None, r.uid or "")))), 1):
            for c, parts in enumerate(section_chunks([r.text for r in group], sizes, count)):
                own, content = [group[i] for i, _ in parts], "\n\n".join(x for _, x in parts)
                pages = [r.page for r in own if r.page is not None]
                boxes: dict[int, list[float]] = {}
                for r in own:
                    if r.page is not None and r.x0 is not None:
                        old = boxes.get(r.page, [r.x0, r.y0, r.x1, r.y1])
                        boxes[r.page] = [min(old[0], r.x0), min(old[1], r.y0), max(old[2], r.x1), max(old[3], r.y1)]
                first = group[0]
                lines = [x for x in (first.title, first.section, first.subsection, content) if x]
                out.append((*key, f"text-{g}-{c}", first.section_uid, first.section, first.subsection, content, count(content), [r.uid for r in own], min(pages, default=None), max(pages, default=None), list(boxes.items()), "\n".join(lines)))
        return out

    return by_group(slim, ("doc_id",), run, SCHEMA)
