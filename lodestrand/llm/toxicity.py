"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of lower-cased words given the two before them. The longest history
counts occurrences; the shorter ones count in how many different histories a word was
seen, as Kneser and Ney do, and each passes the mass that discounting frees to the next
shorter. The word alone is spelled by its prefixes: at each step the next longer prefix, at
last the whole word, is drawn given the shorter one. There the class backs off to counts
that both classes share, the numbers of different words of the whole corpus that go on from
a prefix; so expressions that neither class has seen say nothing, and rare ones little, and
a text that fills the corpus with copies weighs no more than one. A document is scored by
the difference of its toxic and ordinary log-likelihoods, per word over the document and
per word over its worst window, turned into a probability by a logistic fit on rows that the
counts had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import wordcore
from lodestrand.llm.folds import drawn, held_out, threshold
from lodestrand.llm.wordcore import U, settle
from lodestrand.runtime import ship

#: Prefix lengths in UTF-8 bytes.
LEVELS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12)
#: Windows in words; a document's worst window of each size is normalised by its size.
WINDOWS = (1, 4, 12, 96)
#: The length, and for either score its mean, its sum over the root of the length, and its worst windows.
FEATURES = 1 + 2 * (2 + len(WINDOWS))
DISCOUNT = 0.75
ROOT = 0
#: The word before a document's first.
START = U(1)
#: Bytes of text that are looked at at a time.
PIECE = 2 << 20
#: Words whose scores a task remembers.
REMEMBERED = 1_000_000


def chains(w: wordcore.Words, which: np.ndarray) -> list[np.ndarray]:
    """For the words chosen: node of each level (0 where the word is shorter), then that of the whole word."""
    s, e = w.starts[which], w.ends[which]
    *levels, whole = w.slices([*((s, np.minimum(s + level, e), U(level)) for level in LEVELS), (s, e, U(977))])
    for level, h in zip(LEVELS, levels):
        h |= U(1)
        h[e - s < level] = 0
    return [*levels, whole & ~U(1) | U(2)]


def distinct(w: wordcore.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words, the first position of each, and the distinct word of each word."""
    return np.unique(w.hashes(), return_index=True, return_inverse=True)


def edges(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Parents and nodes of all chains, flat, with 0 as node where there is none."""
    parents, nodes = [], []
    last = np.full(len(levels[0]), ROOT, np.uint64)
    for h in levels:
        parents.append(last)
        nodes.append(h)
        last = np.where(h == 0, last, h)
    return np.concatenate(parents), np.concatenate(nodes)


def rolled_up(up: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What ends at each node or below it; up is the parent's index or -1."""
    depth = np.zeros(len(up), np.int8)
    step = up.copy()
    while (on := np.flatnonzero(step >= 0)).size:  # as many rounds as there are levels
        depth[on] += 1
        step[on] = up[step[on]]
    total = own.copy()
    for d in range(int(depth.max(initial=0)), 0, -1):
        on = np.flatnonzero(depth == d)
        total += np.bincount(up[on], total[on], len(total)).astype(total.dtype)
    return total


class Index:
    """Positions of values in sorted 64-bit keys; a bit table spares most searches for absent ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, min(25, len(keys).bit_length() + 2))
        self.shift = U(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[keys >> self.shift] = True

    def __getstate__(self) -> np.ndarray:
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, or -1."""
        out = np.full(len(x), -1, np.int64)
        maybe = np.flatnonzero(self.table[x >> self.shift])
        if len(maybe):
            maybe = maybe[np.argsort(x[maybe])]  # sorted needles stay in the processor's cache
            y = x[maybe]
            at = np.searchsorted(self.keys, y)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == y
            out[maybe[hit]] = at[hit]
        return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of (history, word) pairs."""
    return wordcore.mix(before * U(0x9E3779B97F4A7C15) + wordcore.mix(word))


def last_nodes(nodes: Index, levels: list[np.ndarray]) -> np.ndarray:
    """Index of the last node of each chain that the tree has; the number of nodes stands for the root."""
    last = np.full(len(levels[0]), len(nodes.keys))
    live = np.arange(len(last))
    for h in levels:
        there = h[live] != 0
        on = live[there]
        at = nodes.find(h[on])
        last[on[at >= 0]] = at[at >= 0]
        there[there] = at < 0
        live = live[~there]
    return last


@dataclass
class Sample:
    """The distinct prefixes, pairs and triples of words of the sample's tokens, and each token's."""

    nodes: Index
    up: np.ndarray  # parent's index of each node, or -1
    pairs: np.ndarray
    triples: np.ndarray
    leaf_of_pair: np.ndarray  # node of the pair's second word
    leaf_before: np.ndarray  # node of its first, or the number of nodes at a start
    pair_of_triple: np.ndarray  # its last two words
    pair_before: np.ndarray  # its first two, or the number of pairs at a start
    triple: np.ndarray  # of each token
    row: np.ndarray  # of each token

    @classmethod
    def of(cls, column: pa.Array) -> Sample:
        tokens, rows, parents, nodes = [], [], [], []
        for w in wordcore.lower_batches(column, size=1 << 20):
            if not len(w):
                continue
            _, first, inverse = distinct(w)
            levels = chains(w, first)
            tokens.append(levels[-1][inverse])
            rows.append((w.first_row + w.row_of()).astype(np.int32))
            p, n = edges(levels)
            n, at = np.unique(n, return_index=True)
            parents.append(p[at])
            nodes.append(n)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        words, row = join(tokens, np.uint64), join(rows, np.int32)
        del tokens, rows
        every, at = np.unique(join(nodes, np.uint64), return_index=True)
        del nodes
        parent = join(parents, np.uint64)[at]
        del parents, at
        settle()
        tree = Index(every[every != 0])
        up = tree.find(parent[every != 0]).astype(np.int32)
        del every, parent
        new = np.append(True, row[1:] != row[:-1])[: len(row)]
        before = np.where(new, START, np.roll(words, 1))
        key = pair_keys(before, words)
        pairs, at, of2 = ranked(key)
        leaf_of_pair, leaf_before = tree.find(words[at]).astype(np.int32), np.where(new[at], len(tree.keys), tree.find(before[at])).astype(np.int32)
        del before
        settle()
        key = pair_keys(np.where(new, START, np.roll(key, 1)), words)
        del words
        triples, at, of3 = ranked(key)
        pair_before = np.where(new[at], len(pairs), of2[at - 1]).astype(np.int32)
        return cls(tree, up, pairs, triples, leaf_of_pair, leaf_before, of2[at], pair_before, of3, row)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each occurs, and the rank of each key among them."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    keys = keys[new]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys, order[new], rank


def discounted(n: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Discounted relative counts within their contexts, and the mass that each context frees (1 where it was not seen)."""
    total = np.maximum(np.bincount(context, n, contexts + 1), 1).astype(np.float32)
    kinds = np.bincount(context[n > 0], minlength=contexts + 1).astype(np.float32)
    kept = n.astype(np.float32)
    kept -= np.float32(DISCOUNT)
    np.maximum(kept, 0, out=kept)
    kept /= total[context]
    kinds *= np.float32(DISCOUNT)
    kinds /= total
    kinds[kinds == 0] = 1
    return kept, kinds


def shares(up: np.ndarray, types: np.ndarray, all_types: float) -> np.ndarray:
    """The shared probability of each node given its parent, by different words of the corpus."""
    above = np.append(types, all_types)[np.where(up < 0, len(up), up)]
    return np.maximum(types, 1) / np.maximum(above, 1)


def class_model(s: Sample, tokens: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kneser-Ney model of the tokens of one class.

    Logarithms: of the probability to reach each node, of what the node frees (the root's is
    last), of what each word frees as a history (by node), of what each pair frees, and of the
    probabilities of the pairs and the triples.
    """
    small = lambda x: np.log(np.maximum(x, np.float32(1e-37), out=x), out=x)
    n3 = np.bincount(s.triple[tokens], minlength=len(s.triples)).astype(np.int32)
    n2 = np.bincount(s.pair_of_triple[n3 > 0], minlength=len(s.pairs)).astype(np.int32)  # histories of a pair
    n1 = np.bincount(s.leaf_of_pair[n2 > 0], minlength=len(s.up))  # histories of a word
    at = np.where(s.up < 0, len(s.up), s.up)
    kept, freed = discounted(rolled_up(s.up, n1), at, len(s.up))
    step_log = np.log(kept.astype(float) + freed[at] * shared)
    reach, step = step_log.copy(), s.up.copy()
    while (on := np.flatnonzero(step >= 0)).size:  # as many rounds as there are levels
        reach[on] += step_log[step[on]]
        step[on] = s.up[step[on]]
    del kept, step_log, step
    p2, freed2 = discounted(n2, s.leaf_before, len(s.up))
    reach = reach.astype(np.float32)
    low = np.exp(reach[s.leaf_of_pair])
    low *= freed2[s.leaf_before]
    p2 += low
    del low
    p3, freed3 = discounted(n3, s.pair_before, len(s.pairs))
    del n1, n2, n3, at
    low = p2[s.pair_of_triple]
    low *= freed3[s.pair_before]
    p3 += low
    del low
    settle()
    return reach, small(freed), small(freed2), small(freed3), small(p2), small(p3)


@dataclass
class Model:
    """Log-likelihood ratios: of words by the last node of their chain, of histories, of pairs and of triples."""

    nodes: Index
    reach: np.ndarray  # of a word that ends at the node
    leave: np.ndarray  # of a word that leaves the tree there; the root's is last
    history: np.ndarray  # of a pair that is absent, by its first word's node; a start's is last
    pairs: Index
    pair: np.ndarray
    pair_history: np.ndarray  # of a triple that is absent, by its first two words; a start's is last
    triples: Index
    triple: np.ndarray

    @classmethod
    def fit(cls, s: Sample, toxic: np.ndarray, plain: np.ndarray, shared: np.ndarray) -> Model:
        """From the tokens of either class."""
        parts = class_model(s, toxic, shared)
        for x, y in zip(parts, class_model(s, plain, shared)):
            x -= y
        reach, freed, freed2, freed3, pair, triple = parts
        return cls(s.nodes, reach, np.append(reach, np.float32(0)) + freed, freed2, Index(s.pairs), pair, freed3, Index(s.triples), triple)

    def words(self, w: wordcore.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words chosen: the ratio of each alone, that of what it frees as a history, and its name."""
        levels = chains(w, which)
        last = last_nodes(self.nodes, levels)
        ends = last < len(self.nodes.keys)
        ends[ends] = self.nodes.keys[last[ends]] == levels[-1][ends]
        alone = self.leave[last]
        alone[ends] = self.reach[last[ends]]
        frees = np.zeros(len(which), np.float32)
        frees[ends] = self.history[last[ends]]
        return alone, frees, levels[-1]

    def features(self, w: wordcore.Words, memory: Memory) -> np.ndarray:
        """Per row: log of 1 + words; then of the words alone, and of the words in their histories: mean
        over words, over the root of words, and means over the worst windows."""
        n = np.diff(w.ptr)
        out = np.zeros((w.rows, FEATURES))
        out[:, 0] = np.log1p(n)
        if not len(w):
            return out
        alone, frees, name = memory.of(self, w)
        new = np.zeros(len(w), bool)
        new[w.ptr[:-1][n > 0]] = True
        back = lambda x, start: np.where(new, start, np.roll(x, 1))
        key2 = pair_keys(back(name, START), name)
        pair = self.pairs.find(key2)
        s = (back(frees, self.history[-1]) + alone).astype(np.float64)
        s[pair >= 0] = self.pair[pair[pair >= 0]]
        before = back(pair, len(self.pair))
        s[before >= 0] += self.pair_history[before[before >= 0]]
        on = np.flatnonzero((before >= 0) & (pair >= 0))
        at = self.triples.find(pair_keys(back(key2, START)[on], name[on]))
        s[on[at >= 0]] = self.triple[at[at >= 0]]
        there = n > 0
        end, i = np.repeat(w.ptr[1:], n), np.arange(len(w))
        for at, x in ((1, alone), (3 + len(WINDOWS), s)):
            total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            whole = (total[w.ptr[1:]] - total[w.ptr[:-1]])[there]
            out[there, at] = whole / n[there]
            out[there, at + 1] = whole / np.sqrt(n[there])
            for k, size in enumerate(WINDOWS):
                window = (total[np.minimum(i + size, end)] - total[i]) / size
                out[there, at + 2 + k] = np.maximum.reduceat(window, w.ptr[:-1][there])
        return out


class Memory:
    """What a task knows of the words that it has met, up to REMEMBERED of them."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.known: tuple[np.ndarray, ...] = ()

    def of(self, model: Model, w: wordcore.Words) -> tuple[np.ndarray, ...]:
        """Model.words of every word."""
        keys, first, inverse = distinct(w)
        if not len(self.keys):
            found = model.words(w, first)
        else:
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == keys
            found = tuple(x[at] for x in self.known)
            for x, y in zip(found, model.words(w, first[~known])):
                x[~known] = y
            if len(self.keys) < REMEMBERED:
                order = np.argsort(merged := np.concatenate([self.keys, keys[~known]]), kind="stable")
                self.keys, self.known = merged[order], tuple(np.concatenate([x, y[~known]])[order] for x, y in zip(self.known, found))
        if not len(self.keys):
            self.keys, self.known = keys, found
        return tuple(x[inverse] for x in found)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (last: bias) on standardised inputs, folded back; Newton's method over weighted rows."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def shape(f: np.ndarray) -> np.ndarray:
    """Inputs of the logistic fit."""
    return np.column_stack([f, f[:, 0] * f[:, 1], f[:, 0] * f[:, 3]])


def _corpus_words(nodes_value):
    """The different words of a task, each with the last node of the tree that its chain has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = nodes_value.value
        seen = np.empty(0, np.uint64)
        for b in batches:
            for w in wordcore.lower_batches(b.column(0), size=PIECE):
                keys, first, _ = distinct(w)
                if len(seen):
                    at = np.searchsorted(seen, keys)
                    at[at == len(seen)] = 0
                    new = seen[at] != keys
                    keys, first = keys[new], first[new]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(last_nodes(nodes, chains(w, first)).astype(np.int32))], names=["word", "at"])
                    seen = np.sort(np.concatenate([seen, keys])) if len(seen) < REMEMBERED else keys

    return run


@dataclass
class Scorer:
    model: Model
    weights: np.ndarray

    def probability(self, f: np.ndarray) -> np.ndarray:
        x = shape(f)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int, size: int) -> tuple[pa.Table, dict[int, float]]:
    """text, toxic, fold of labelled rows outside the held-out fold, drawn by a hash of the id, and each class's share.

    About `rows` rows and `size` bytes of either class at most, so it is bounded whatever the input.
    """
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    lengths = text.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    sizes = {r[0]: (r[1], r[2]) for r in lengths.join(marked, "id").groupBy("toxic").agg(F.count(F.lit(1)), F.sum("n")).collect() if r[0] in (0, 1)}
    share = {c: min(1.0, rows / n, size / max(1, b)) for c, (n, b) in sizes.items()}
    limit = F.lit(None).cast("bigint")
    for c, p in share.items():
        limit = F.when(F.col("toxic") == c, F.lit(threshold(p))).otherwise(limit)
    few = marked.where(drawn(F.col("id"), limit, 3)).select("id", "toxic", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    return text.join(F.broadcast(few), "id").select("text", "toxic", "fold").toArrow(), share


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = 3_000, bytes_per_class: int = 16 << 20) -> Scorer:
    """Fit on about rows_per_class labelled rows of either class outside the held-out fold (and bytes_per_class of text).

    Those bounds hold for all that comes to the driver: the sample's text, and the counts
    of its prefixes, pairs and triples, none of which is dropped. The shared counts are
    taken over all documents: each task sends its different words, once each.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, share = sample_of(docs, labels, id_col, text_col, rows_per_class, bytes_per_class)
    text = rows["text"].combine_chunks()
    toxic, fold = rows["toxic"].to_numpy(), rows["fold"].to_numpy()
    del rows
    sample = Sample.of(text)
    settle()
    own = np.zeros(len(sample.up) + 1, np.int64)
    if len(sample.up):
        value = spark.sparkContext.broadcast(sample.nodes)
        words = docs.select(F.col(text_col).cast("string")).mapInArrow(wordcore.tidy(_corpus_words(value)), "word bigint, at int")
        sums = words.groupBy("word").agg(F.min("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).toArrow()
        own[sums["at"].to_numpy()] = sums["n"].to_numpy()
        value.destroy()
    shared = shares(sample.up, rolled_up(sample.up, own[:-1]), float(own.sum()))
    settle()

    def fitted(inside: np.ndarray) -> Model:
        model = Model.fit(sample, *(np.flatnonzero((inside & (toxic == c))[sample.row]) for c in (1, 0)), shared)
        settle()
        return model

    def crossed(k: int) -> np.ndarray:
        """Features of a fold's rows by the model of the other."""
        model, memory = fitted(fold != k), Memory()
        parts = [model.features(w, memory) for w in wordcore.lower_batches(text.take(pa.array(np.flatnonzero(fold == k))), size=1 << 20)]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    f = np.zeros((len(toxic), FEATURES))
    for k in (0, 1):
        f[fold == k] = crossed(k)
        settle()
    if len(toxic) == 0 or toxic.min() == toxic.max():
        weights = np.append(np.zeros(shape(f).shape[1]), 30.0 if len(toxic) and toxic.max() else -30.0)
    else:
        # Classes are drawn with different shares; weights give them their own sizes again.
        weights = logistic(shape(f), toxic.astype(float), np.where(toxic == 1, 1 / share.get(1, 1), 1 / share.get(0, 1)))
    return Scorer(fitted(np.ones(len(toxic), bool)), weights)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null text is scored as the empty one.

    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    settle()  # of what training held
    value = spark.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, memory = value.value, Memory()
        for b in batches:
            f = [s.model.features(w, memory) for w in wordcore.lower_batches(b.column(1), size=PIECE)]
            p = s.probability(np.concatenate(f)) if f else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], schema=schema)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = slim.mapInArrow(wordcore.tidy(run), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = 3_000) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and score every document.

    Ties at 0.5 are toxic. Labels of ids without a document, null labels and null ids are
    not learned from; of contradicting labels of an id the toxic one holds. Without labels
    of both classes every score is 0 or 1 alike.
    """
    return score(docs, train(docs, labels, id_col, text_col, rows_per_class), id_col, text_col)
