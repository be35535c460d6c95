"""Contracts of a gold data set: of each case, and of all cases and papers together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ANSWER, SINGLE, CROSS = "insufficient_evidence", "single_paper", ("cross_paper_comparison", "cross_paper_similarity")
#: What a whole set has to hold. Fixed values.
PAPERS, CASES, EACH_SINGLE, LEAST_CROSS = 20, 100, 3, 3
LANGUAGES, TASKS, BREADTHS = {"zh": 60, "en": 40}, {"single": 60, "cross": 30, "none": 10}, {"2-3": 18, "4": 8, "5-6": 4}


def case_faults(cases: DataFrame) -> DataFrame:
    """id (a case), fault: every contract that a case breaks.

    cases: case_id, question, language, task_type, scoring_mode, insufficient, reason, status, answer_points,
    keywords, required (documents), gold (doc, pages) and evidence (doc, page); null lists are empty.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    docs = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.transform(c, lambda x: x["doc"]), F.array().cast("array<string>"))))
    required = F.array_sort(F.array_distinct(F.coalesce("required", F.array().cast("array<string>"))))
    none, kind = F.coalesce("insufficient", F.lit(False)), F.coalesce("task_type", F.lit(""))
    mode, n = F.coalesce("scoring_mode", F.lit("")), F.size(required)
    pairs = F.coalesce(F.flatten(F.transform("gold", lambda g: F.transform(g["pages"], lambda p: F.concat_ws("|", g["doc"], p)))), F.array().cast("array<string>"))
    stray = F.coalesce(F.exists("evidence", lambda e: ~F.array_contains(pairs, F.concat_ws("|", e["doc"], e["page"]))), F.lit(False))
    rules: list[tuple[Column, str]] = [
        (F.coalesce("status", F.lit("")) != "verified", "not_verified"),
        ((size("answer_points") == 0) | F.coalesce(F.exists("answer_points", lambda p: text(p) == ""), F.lit(False)), "empty_answer_point"),
        (size("required") != n, "required_repeated"),
        (none & (kind != NO_ANSWER), "no_answer_task"),
        (none & (mode != "no_evidence"), "no_answer_scoring"),
        (none & (size("gold") > 0), "no_answer_with_gold"),
        (none & ((size("evidence") > 0) | (n > 0)), "no_answer_with_evidence"),
        (none & (text(F.col("reason")) == ""), "no_answer_without_reason"),
        (~none & (kind == NO_ANSWER), "answerable_task"),
        (~none & F.col("reason").isNotNull(), "answerable_with_reason"),
        (~none & (size("gold") == 0), "gold_missing"),
        (~none & (size("evidence") == 0), "evidence_missing"),
        (~none & (size("keywords") == 0), "keywords_missing"),
        (~none & (docs(F.col("gold")) != required), "gold_documents_differ"),
        (~none & (docs(F.col("evidence")) != required), "evidence_documents_differ"),
        (~none & stray, "evidence_page_not_gold"),
        (~none & (kind == SINGLE) & ((n != 1) | (mode != "any_evidence")), "single_shape"),
        (~none & ~kind.isin(SINGLE, NO_ANSWER) & ~n.between(2, 6), "cross_breadth"),
        (~none & ~kind.isin(SINGLE, NO_ANSWER) & (mode != "all_documents"), "cross_scoring"),
    ]
    found = F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))
    return cases.select(F.col("case_id").cast("string").alias("id"), F.explode(found).alias("fault"))


def _repeated(rows: DataFrame, value: Column, fault: str) -> DataFrame:
    return rows.groupBy(value.alias("id")).count().where("count > 1").select("id", F.lit(fault).alias("fault"))


def _counted(found: DataFrame, wanted: dict[str, int], fault: str) -> DataFrame:
    """A fault with the group for each count (kind, n) that is not the wanted one; kinds that are not wanted have to be absent."""
    spark = found.sparkSession
    want = spark.createDataFrame(list(wanted.items()), "kind string, wanted long")
    j = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(want), "kind", "full_outer")
    return j.where(F.coalesce("n", F.lit(0)) != F.coalesce("wanted", F.lit(0))).select(F.col("kind").alias("id"), F.lit(fault).alias("fault"))


def dataset_faults(corpus: DataFrame, cases: DataFrame) -> DataFrame:
    """id, fault of a whole set: corpus (key, file_prefix) and cases as in case_faults().

    Keys, prefixes, case ids and questions are each there once; documents are known; there are PAPERS
    papers and CASES cases, of languages, tasks and breadths as wanted; every paper has EACH_SINGLE cases of
    its own and LEAST_CROSS shared ones.
    """
    kind = F.when(F.col("task_type") == SINGLE, "single").when(F.col("task_type").isin(*CROSS), "cross").when(F.col("task_type") == NO_ANSWER, "none").otherwise("other")
    c = cases.withColumn("kind", kind).withColumn("required", F.coalesce("required", F.array().cast("array<string>")))
    size = lambda rows, n, fault: rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n).select(F.col("n").cast("string").alias("id"), F.lit(fault).alias("fault"))
    listed = lambda col: F.coalesce(F.transform(col, lambda x: x["doc"]), F.array().cast("array<string>"))
    named = c.select("case_id", F.explode(F.array_distinct(F.concat("required", listed(F.col("gold")), listed(F.col("evidence"))))).alias("key"))
    unknown = named.join(corpus.select("key"), "key", "left_anti").select(F.col("key").alias("id"), F.lit("unknown_document").alias("fault")).distinct()
    cross = c.where("kind = 'cross'")
    width = F.size("required")
    breadth = cross.select(F.when(width.between(2, 3), "2-3").when(width == 4, "4").when(width.between(5, 6), "5-6").otherwise("other").alias("kind"))
    own = c.where("kind = 'single'").groupBy(F.element_at("required", 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    shared = cross.select(F.explode("required").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    per_paper = lambda n, test, fault: corpus.select("key").distinct().join(n, "key", "left").where(test(F.coalesce("n", F.lit(0)))).select(F.col("key").alias("id"), F.lit(fault).alias("fault"))
    parts = [
        _repeated(corpus, F.col("key"), "key_repeated"), _repeated(corpus, F.lower("file_prefix"), "prefix_repeated"), size(corpus, PAPERS, "corpus_size"), size(c, CASES, "case_count"),
        _repeated(c, F.col("case_id").cast("string"), "case_repeated"), _repeated(c, F.lower(F.trim("question")), "question_repeated"), unknown,
        _counted(c.select(F.col("language").alias("kind")), LANGUAGES, "language_count"), _counted(c.select("kind"), TASKS, "task_count"), _counted(breadth, BREADTHS, "breadth_count"),
        per_paper(own, lambda n: n != EACH_SINGLE, "single_cases_of_paper"), per_paper(shared, lambda n: n < LEAST_CROSS, "cross_cases_of_paper"),
    ]
    return reduce(DataFrame.unionByName, parts)
