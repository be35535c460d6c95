"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three
letters, with word borders). A document's own list is compared with each profile by
out-of-place distance: the sum over its n-grams of how far their ranks differ, or of the
profile's length where the profile lacks them. The nearest profile names the language.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import wordcore
from lodestrand.llm.folds import drawn, held_out, threshold
from lodestrand.llm.rows import own, private
from lodestrand.operators.numbering import numbered
from lodestrand.runtime import materialize, release, ship

PROFILE = 300
#: Bits of a letter in a chunk-local n-gram code (two bits of order, then three letters): for many texts, and for one text of very many letters.
LETTER_BITS, WIDE_BITS = 14, 20
#: Languages whose profiles are held together; more go in blocks.
LANGS = 5_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _index() -> np.ndarray:
    """A table from code point to a chunk's letter index; zero between uses."""
    return np.zeros(0x110000, np.int32)


def chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """First row and lower-cased texts of row ranges of about size bytes."""
    texts = wordcore.binary(column)
    _, offs = wordcore.raw(texts)
    for lo, hi in wordcore.pieces(offs, size):
        yield lo, [v.as_py().decode().lower() for v in texts.slice(lo, hi - lo)]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, codes and counts of the n-grams of each text, the letters by index (0: word border), and the bits of a letter.

    Codes order n-grams by length, then by code points, in every chunk. Should a chunk have
    more letters than an index holds, 0 bits tell the caller to split it; one text alone has
    room for all letters there are.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[: len(points)]
    letter = letter_table()[points]
    keep = letter.copy()
    if len(points):
        keep[1:] |= letter[:-1]  # of the others, one after each word
    points, row, letter = points[keep], row[keep], letter[keep]
    alphabet = np.flatnonzero(np.bincount(points[letter], minlength=1)) if letter.any() else np.empty(0, np.int64)
    many = len(alphabet) >= 1 << LETTER_BITS
    if many and len(texts) > 1:
        return row, row, row, alphabet, 0
    pad = WIDE_BITS if many else LETTER_BITS
    bits = 3 * pad + 2
    index = _index()
    index[alphabet] = np.arange(1, len(alphabet) + 1)
    s = np.where(letter, index[points], 0).astype(np.int64)
    index[alphabet] = 0
    s = np.concatenate([[0], s, [0]])
    r = np.concatenate([row[:1], row, row[-1:]])
    a, b, c = s[:-2], s[1:-1], s[2:]
    at = r[1:-1]
    # One letter; two with at least one letter (borders included); three around a letter.
    one = b > 0
    two = (b > 0) | (c > 0)
    codes = np.concatenate(
        [
            (at[one] << bits) | b[one],
            (np.where(one, at, r[2:])[two] << bits) | (1 << 3 * pad) | (b[two] << pad) | c[two],
            (at[one] << bits) | (2 << 3 * pad) | (a[one] << 2 * pad) | (b[one] << pad) | c[one],
        ]
    )
    if len(s) > 2 and s[1] > 0:  # the border before the first word
        codes = np.append(codes, (r[1] << bits) | (1 << 3 * pad) | s[1])
    codes.sort()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    counts = np.diff(np.append(first, len(codes)))
    codes = codes[first]
    return codes >> bits, codes & ((1 << bits) - 1), counts, alphabet, pad


def top(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, codes and ranks of each row's k most frequent n-grams; ties by code."""
    most = (1 << 22) - 1
    order = np.argsort((rows << 22) | (most - np.minimum(counts, most)), kind="stable")
    rows, codes = rows[order], codes[order]
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    keep = rank < k
    return rows[keep], codes[keep], rank[keep]


def spelled(codes: np.ndarray, alphabet: np.ndarray, pad: int = LETTER_BITS) -> np.ndarray:
    """Chunk-local codes as code points: order, then three of 20 bits (a border is 0) in 62 bits."""
    points = np.concatenate([[0], alphabet]).astype(np.int64)
    mask = (1 << pad) - 1
    order = codes >> 3 * pad
    p = [points[(codes >> i * pad) & mask] for i in (2, 1, 0)]
    return (order << 60) | (p[0] << 40) | (p[1] << 20) | p[2]


def local(grams: np.ndarray, alphabet: np.ndarray, pad: int = LETTER_BITS) -> np.ndarray:
    """Inverse of spelled for a chunk; -1 for an n-gram with a letter that the chunk lacks."""
    out = (grams >> 60) << 3 * pad
    ok = np.ones(len(grams), bool)
    for i in (2, 1, 0):
        p = (grams >> (20 * i)) & 0xFFFFF
        at = np.searchsorted(alphabet, p)
        found = (p == 0) | ((at < len(alphabet)) & (alphabet[np.minimum(at, max(len(alphabet) - 1, 0))] == p) if len(alphabet) else p == 0)
        ok &= found
        out |= np.where(p == 0, 0, at + 1) << i * pad
    return np.where(ok, out, -1)


@dataclass
class Profiles:
    """Languages in order; sorted n-grams with their rank in each profile (its length: absent)."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    length: int

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each profile, and the n-grams compared."""
        rows, codes, counts, alphabet, pad = ngrams(texts)
        if not pad:
            half = len(texts) // 2
            a, b = self.distances(texts[:half]), self.distances(texts[half:])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        rows, codes, rank = top(rows, codes, counts, self.length)
        mine = local(self.grams, alphabet, pad)
        order = np.argsort(mine)
        mine = mine[order]
        at = np.searchsorted(mine, codes)
        at[at == len(mine)] = 0
        hit = mine[at] == codes if len(mine) else np.zeros(len(codes), bool)
        out = np.empty((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            d = np.full(len(codes), float(self.length))
            theirs = self.ranks[order[at[hit]], i]
            d[hit] = np.where(theirs < self.length, np.abs(theirs - rank[hit]), self.length)
            out[:, i] = np.bincount(rows, d, len(texts))
        return out, np.bincount(rows, minlength=len(texts))

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's nearest language (ties: the first by name), its distance, that of the next (infinite if none), and n-grams compared."""
        d, n = self.distances(texts)
        best = d.argmin(1)
        every = np.arange(len(d))
        near = d[every, best]
        d[every, best] = np.inf
        return np.array(self.langs, object)[best], near, d.min(1), n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Nearest language (ties: the first by name) and a score: how much nearer it is than the next."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        lang, near, other, n = self.nearest(texts)
        other = np.minimum(other, n * float(self.length))
        score = np.where((n > 0) & (other > 0), 1 - near / np.maximum(other, 1e-9), 0.0)
        return [x if m else UNKNOWN for x, m in zip(lang, n)], np.clip(score, 0.0, 1.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, at = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
        for lo, texts in chunks(b.column(1)):
            todo = [(lo, texts)]
            while todo:
                lo_, part = todo.pop()
                rows, codes, counts, alphabet, pad = ngrams(part)
                if not pad:
                    half = len(part) // 2
                    todo += [(lo_, part[:half]), (lo_ + half, part[half:])]
                    continue
                of = at[lo_ + rows]
                order = np.lexsort((codes, of))
                of, codes, counts = of[order], codes[order], counts[order]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (codes[1:] != codes[:-1]))) if len(of) else np.empty(0, np.int64)
                total = np.add.reduceat(counts, first) if len(first) else counts
                yield pa.RecordBatch.from_arrays([pa.array(langs[of[first]], pa.string()), pa.array(spelled(codes[first], alphabet, pad)), pa.array(total.astype(np.int64))], names=["lang", "gram", "n"])


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 2000, length: int = PROFILE, block: int = LANGS
) -> Iterator[Profiles]:
    """Profiles from labelled rows outside the held-out fold, in blocks of languages by name.

    About rows_per_lang rows of each language are drawn by a hash of the id (all, where a
    language has fewer): the bound on the fitted sample. Ties in frequency go by code. The
    driver and a task hold a block of languages at a time.
    """
    ship(docs.sparkSession)
    lang = F.col(lang_col).cast("string")
    usable = docs.where(lang.isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = usable.groupBy("lang").count()
    known = {r[0]: r[1] for r in sizes.limit(block + 1).collect()}
    if not known:
        return
    if len(known) <= block:
        limits = F.create_map(*(F.lit(x) for name, n in known.items() for x in (name, threshold(min(1.0, rows_per_lang / n)))))
        sample = usable.where(drawn(F.col("id"), limits[F.col("lang")], 11)).select("lang", "text")
    else:
        share = F.least(F.lit(1.0), rows_per_lang / F.col("count"))
        limit = F.when(share == 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("bigint"))
        limits = sizes.select(F.col("lang").alias("of"), limit.alias("limit"))
        sample = usable.join(limits, F.col("lang") == F.col("of")).where(drawn(F.col("id"), F.col("limit"), 11)).select("lang", "text")
    counted = sample.mapInArrow(wordcore.tidy(_count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The best of each share of a language's n-grams, then of those: no task sorts all that a language has.
    best = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram"))
    few = counted.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("rank", best).where(F.col("rank") <= length)
    ranked = few.groupBy("lang").agg(F.expr(f"slice(sort_array(collect_list(struct(-n AS m, gram))), 1, {length})").alias("best"))
    if len(known) <= block:
        yield _profiles(ranked.collect(), length)
        return
    ranked = materialize(numbered(ranked, "lang", name="place", start=0), "profiles")
    for lo in range(0, ranked.count(), block):
        yield _profiles(ranked.where((F.col("place") >= lo) & (F.col("place") < lo + block)).collect(), length)


def _profiles(ranked: list[Row], length: int) -> Profiles:
    by = {r["lang"]: [x["gram"] for x in r["best"]] for r in ranked}
    langs = sorted(by)
    grams = np.array(sorted({g for x in by.values() for g in x}), np.int64)
    ranks = np.full((len(grams), len(langs)), length, np.int16 if length < 1 << 15 else np.int32)
    for i, lang in enumerate(langs):
        ranks[np.searchsorted(grams, np.array(by[lang], np.int64)), i] = np.arange(len(by[lang]))
    return Profiles(langs, grams, ranks, length)


def predict(docs: DataFrame, blocks: Iterable[Profiles], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The input's columns with lang_pred and score; `und` with score 0 where a text is null or has no letter.

    blocks come by language name, as train() gives them: one is applied where the rows lie;
    of several, each is applied in a pass of its own, which writes the rows with the nearest
    language so far. Without any, all rows are `und`. Input columns with the names of the two,
    in any case, are an error: choose other names.
    """
    if {c.lower() for c in docs.columns} & {pred_col.lower(), score_col.lower()}:
        raise ValueError(f"the input has a column {pred_col} or {score_col}")
    ship(docs.sparkSession)
    found = iter(blocks)
    first, second = next(found, None) or Profiles([], np.empty(0, np.int64), np.empty((0, 0)), PROFILE), next(found, None)
    if second is None:
        return _scored(docs, first, text_col, pred_col, score_col)
    names = private(docs, "near", "other", "grams")
    state = docs.select(*own(docs), F.lit(None).cast("string").alias(pred_col), *[F.lit(math.inf).alias(n) for n in names[:2]], F.lit(0).cast("bigint").alias(names[2]))
    before = None
    for p in chain((first, second), found):
        state = materialize(_nearer(state, p, text_col), "nearest")
        if before is not None:
            release(before)
        before = state
    near, other, grams = map(F.col, names)
    limit = F.least(other, grams * float(first.length))
    score = F.when((grams > 0) & (limit > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - near / F.greatest(limit, F.lit(1e-9))))).otherwise(0.0)
    return state.select(*own(docs), F.when(grams > 0, F.col(pred_col)).otherwise(UNKNOWN).alias(pred_col), score.alias(score_col))


def _scored(docs: DataFrame, profiles: Profiles, text_col: str, pred_col: str, score_col: str) -> DataFrame:
    value = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = value.value
        for b in batches:
            langs, scores = [], []
            for _, texts in chunks(b.column(at)):
                a, s = p.predict(texts)
                langs += a
                scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*b.schema.names, pred_col, score_col]
            )

    out = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(wordcore.tidy(run), out)


def _nearer(state: DataFrame, profiles: Profiles, text_col: str) -> DataFrame:
    """Rows whose last columns are the nearest language so far, its distance, that of the next, and n-grams: after one more block."""
    value = state.sparkSession.sparkContext.broadcast(profiles)
    at = state.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = value.value
        for b in batches:
            lang, near, other = np.array(b.columns[-4].to_pylist(), object), np.array(b.columns[-3]), np.array(b.columns[-2])
            grams = np.zeros(b.num_rows, np.int64)
            for lo, texts in chunks(b.column(at)):
                x, d, e, n = p.nearest(texts)
                part = slice(lo, lo + len(texts))
                closer = d < near[part]
                other[part] = np.where(closer, np.minimum(near[part], e), np.minimum(other[part], d))
                lang[part] = np.where(closer, x, lang[part])
                near[part] = np.minimum(near[part], d)
                grams[part] = n
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(lang.tolist(), pa.string()), pa.array(near), pa.array(other), pa.array(grams)], names=b.schema.names)

    return state.mapInArrow(wordcore.tidy(run), state.schema)


def known_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that have a language: text that is not null and holds a letter.

    All columns of the input are returned as they are, whatever their names; repeated rows
    are judged each, and an empty table gives none. Where there is no label to learn from,
    rows can't be told apart and all with a letter stay.
    """
    pred, score = private(docs, "pred", "score")
    blocks = train(docs, id_col, text_col, lang_col)
    first = next(blocks, None)
    if first is None:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    found = predict(docs, chain((first,), blocks), text_col, pred, score)
    return found.where(F.col(pred) != UNKNOWN).select(*own(docs))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 2000, block: int = LANGS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Text decides alone; an empty or letterless one, or null, is `und`. Repeated rows give
    repeated rows, an empty table none. With nothing to learn from, all rows are `und`.
    """
    blocks = train(docs, id_col, text_col, lang_col, rows_per_lang, block=block)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return predict(slim, blocks).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
