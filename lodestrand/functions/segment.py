"""Words of CJK runs: a unigram lattice over a vocabulary that is counted from the corpus, and its best path."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The characters of a run, and terms that are words whatever the corpus says.
RUN_PATTERN = "[一-鿿]+"
DOMAIN_TERMS = ("谱聚类", "深度聚类", "最优传输")
#: Longest word, least occurrences of one, how much more often its parts stand together than by chance, and words that are kept at most.
LONGEST, LEAST, COHESION, WORDS = 4, 3, 8.0, 100_000


def counted(texts: DataFrame, column: str = "text") -> DataFrame:
    """gram, n of the runs' character grams up to LONGEST, counted over all texts."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"({RUN_PATTERN})"), F.lit(1))).alias("run"))
    of = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = runs.select(F.explode(F.concat(*[of(n) for n in range(1, LONGEST + 1)])).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(texts: DataFrame, column: str = "text", least: int = LEAST, cohesion: float = COHESION, words: int = WORDS) -> dict[str, int]:
    """Words and their counts: every character that occurs, and the grams that hold together.

    A gram of two or more characters is a word if it occurs `least` times and, however it is
    cut in two, at least `cohesion` times as often as its parts would meet by chance. Of those the `words` most
    frequent (ties by text) are kept: the bound of what every task holds. Characters are as many as the script has.
    """
    grams = counted(texts, column)
    total = grams.where(F.length("gram") == 1).agg(F.sum("n")).first()[0]
    if not total:
        return {}
    cuts = grams.where((F.length("gram") > 1) & (F.col("n") >= least)).select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("at"))
    parts = cuts.select("gram", "n", F.substring(F.col("gram"), F.lit(1), F.col("at")).alias("a"), F.substring(F.col("gram"), F.col("at") + 1, F.length("gram") - F.col("at")).alias("b"))
    side = lambda name: grams.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}"))
    bound = parts.join(side("a"), "a").join(side("b"), "b").groupBy("gram", "n").agg(F.min(F.col("n") * float(total) / (F.col("n_a") * F.col("n_b"))).alias("c"))
    kept = bound.where(F.col("c") >= cohesion).orderBy(F.desc("n"), "gram").limit(words).select("gram", "n")
    found = {r["gram"]: r["n"] for r in kept.unionByName(grams.where(F.length("gram") == 1)).collect()}
    return found | {t: max(found.get(t, 0), least) for t in DOMAIN_TERMS}


class Segmenter:
    """The best path of a run through its words: the greatest product of their shares; a tie goes to the longer last word."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) or 1
        self.log = {w: math.log(n / self.total) for w, n in counts.items() if n > 0}
        self.rest = math.log(0.5 / self.total)  # of a character that the corpus lacks
        self.longest = max(map(len, counts), default=1)
        self.find = re.compile(RUN_PATTERN).findall

    def cut(self, run: str) -> list[str]:
        best, last = [0.0], [0]
        for end in range(1, len(run) + 1):
            top, at = -math.inf, end - 1
            for begin in range(max(0, end - self.longest), end):
                p = self.log.get(run[begin:end], self.rest if end - begin == 1 else None)
                if p is not None and best[begin] + p > top + 1e-12:
                    top, at = best[begin] + p, begin
            best.append(top)
            last.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[last[end] : end])
            end = last[end]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        return [w for run in self.find(text) for w in self.cut(run)]
