"""Measures of rankings, answers and routers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import numeric as nm
from lodestrand.operators.bm25 import small
from lodestrand.runtime import materialize

KS = (3, 5, 10, 20)


def _mean(c: Column) -> Column:
    """Mean to six digits, 0 for no rows."""
    return F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))


def ranking_by_case(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """case_id, k, recall, hit, reciprocal_rank, average_precision, ndcg for each case with gold.

    ranked: case_id, key, rank; gold: case_id, key, grade. Average precision is divided by
    min(relevant, k); gain is 2**grade - 1 over log2(rank + 1).
    """
    cuts = F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")
    # Gold may be a share of all pairs: it is counted by grade and met by the few ranked rows, never sorted.
    grades = gold.groupBy("case_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    size = grades.groupBy("case_id").agg(F.sum("n").alias("relevant"))
    hits = gold.join(small(materialize(ranked.select("case_id", "key", "rank"), "ranked")), ["case_id", "key"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")))
    found = hits.select("case_id", "rank", "nth", "grade", cuts).where(F.col("rank") <= F.col("k"))
    got = found.groupBy("case_id", "k").agg(
        F.count(F.lit(1)).alias("found"),
        F.min("rank").alias("first"),
        F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
        F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    upto = F.sum("n").over(Window.partitionBy("case_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0))
    ideal = grades.withColumn("upto", upto).where(F.col("upto") - F.col("n") < max(ks))
    ideal = ideal.select("case_id", "grade", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.least("upto", F.lit(max(ks))))).alias("place"))
    ideal = ideal.select("case_id", "place", "grade", cuts).where(F.col("place") <= F.col("k"))
    ideal = ideal.groupBy("case_id", "k").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)).alias("idcg"))
    every = size.select("case_id", "relevant", cuts)
    joined = every.join(got, ["case_id", "k"], "left").join(ideal, ["case_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "case_id",
        "k",
        zero(F.col("found") / F.col("relevant")).alias("recall"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        zero(1.0 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("precisions") / F.least("relevant", "k")).alias("average_precision"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
    )


def ranking_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k and the means over cases; cases without gold don't count."""
    names = ("recall", "hit", "reciprocal_rank", "average_precision", "ndcg")
    return ranking_by_case(ranked, gold, ks).groupBy("k").agg(*(_mean(F.col(n)).alias(n) for n in names))


def document_recall(ranked: DataFrame, required: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, all_found (share of cases with every required key by k) and share_found (mean share of them).

    ranked: case_id, key, rank; required: case_id, key.
    """
    cuts = F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")
    need = required.distinct()
    first = ranked.groupBy("case_id", "key").agg(F.min("rank").alias("rank"))
    joined = need.join(first, ["case_id", "key"], "left").select("case_id", "rank", cuts)
    by = joined.groupBy("case_id", "k").agg(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("share"))
    return by.groupBy("k").agg(_mean(F.when(F.col("share") == 1, 1.0).otherwise(0.0)).alias("all_found"), _mean(F.col("share")).alias("share_found"))


def smallest_k(metrics: DataFrame, *gates: Column) -> DataFrame:
    """One row: the smallest k whose row meets every gate, null if none does."""
    ok = gates[0]
    for g in gates[1:]:
        ok = ok & g
    return metrics.agg(F.min(F.when(ok, F.col("k"))).alias("k"))


def paired_outcomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """outcome and cases: improved, regressed, both or neither, from (case_id, hit) of two arms."""
    joined = a.select("case_id", F.col("hit").alias("x")).join(b.select("case_id", F.col("hit").alias("y")), "case_id")
    name = F.when((F.col("x") == 0) & (F.col("y") > 0), "improved").when((F.col("x") > 0) & (F.col("y") == 0), "regressed").when(F.col("x") > 0, "both").otherwise("neither")
    return joined.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("cases"))


def confusion(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """expected and a column of counts for each predicted label and `invalid`; labels never seen are rows of zeros."""
    spark = rows.sparkSession
    counted = rows.withColumn("column", F.when(F.col("predicted").isin(*labels), F.col("predicted")).otherwise("invalid"))
    counted = counted.groupBy("expected").pivot("column", [*labels, "invalid"]).count()
    every = spark.createDataFrame([(x,) for x in labels], "expected string")
    return every.join(counted, "expected", "left").na.fill(0)


def per_class(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """label, precision, recall, f1, support."""
    spark = rows.sparkSession
    every = F.broadcast(spark.createDataFrame([(x,) for x in labels], "label string"))
    # Counts for each pair of labels first: one small row set, whatever the input.
    pairs = rows.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    counted = every.join(pairs).groupBy("label").agg(
        F.sum(F.when((F.col("expected") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("expected") != F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("expected") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    p, r = nm.ratio(F.col("tp"), F.col("tp") + F.col("fp")), nm.ratio(F.col("tp"), F.col("support"))
    return counted.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(nm.f1(p, r), 6).alias("f1"), "support")


def slices(rows: DataFrame, *keys: str) -> DataFrame:
    """slice, value, support, accuracy for each value of each key alone, by grouping sets."""
    view = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col("correct").cast("int").alias("correct"))
    sets = ", ".join(f"({k})" for k in keys)
    name = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys) + " END"
    return rows.sparkSession.sql(
        f"SELECT {name} AS slice, coalesce({', '.join(keys)}) AS value, count(*) AS support, round(avg(correct), 6) AS accuracy FROM {{rows}} GROUP BY GROUPING SETS ({sets})",
        rows=view,
    )


def pair_accuracy(rows: DataFrame) -> DataFrame:
    """Share of pairs (pair_id) with every member correct."""
    by = rows.where("pair_id is not null").groupBy("pair_id").agg(F.min(F.col("correct").cast("int")).alias("right"))
    return by.agg(F.count(F.lit(1)).alias("pairs"), _mean(F.col("right")).alias("pair_accuracy"))


def latency(rows: DataFrame, value: str, *keys: str, nearest: bool = False) -> DataFrame:
    """n, mean, p50, p95, p99, max; percentiles are interpolated, or by nearest rank."""
    v = f"`{value}`"
    q = (lambda p: f"percentile_disc({p}) WITHIN GROUP (ORDER BY {v})") if nearest else (lambda p: f"percentile({v}, {p})")
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), *(F.round(F.expr(q(p / 100)), 6).alias(f"p{p}") for p in (50, 95, 99)), F.max(value).alias("max")
    )


def failures(rows: DataFrame, keep: int = 3) -> DataFrame:
    """code, n and the first `keep` case ids of each failure code: bounded state, not whole groups."""
    ranked = rows.where("code is not null").withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("case_id")))
    counts = rows.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    first = ranked.where(F.col("nth") <= keep).groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("case_id")), ",").alias("examples"))
    return counts.join(first, "code")


def context_precision(ranked: DataFrame) -> DataFrame:
    """case_id, precision: average precision over the relevant found, from (case_id, rank, relevant)."""
    w = Window.partitionBy("case_id").orderBy("rank")
    hits = ranked.withColumn("hits", F.sum(F.col("relevant").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = hits.groupBy("case_id").agg(F.sum(F.when(F.col("relevant"), F.col("hits") / F.col("rank"))).alias("s"), F.sum(F.col("relevant").cast("int")).alias("n"))
    return total.select("case_id", F.round(nm.ratio(F.coalesce("s", F.lit(0.0)), F.col("n")), 6).alias("precision"))
