"""Evaluation runs: gold grades, judgement measures, sweeps, gates, rankings of candidates, reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import numeric as nm
from lodestrand.functions import seams
from lodestrand.functions import text as tx

# Gates of a generation run and the failure codes that reports may use.
LEAST_FAITHFUL, LEAST_RELEVANT, LEAST_F1 = 0.90, 0.80, 0.80
GATE_CASES, GATE_PASSES, GATE_ABSTENTIONS = 10, 8, 2


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the different words of two normalised texts; 1 where one holds the other whole, 0 without words."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    overlap = F.when(both > 0, 2.0 * both / (F.size(x) + F.size(y))).otherwise(0.0)
    return F.when((F.length(a) > 0) & F.contains(b, a), 1.0).otherwise(overlap)


def gold_grades(evidence: DataFrame, chunks: DataFrame, keywords: DataFrame, least: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """By words alone, which SQL expresses; evidence_map() takes the characters too. Grades (case_id, chunk_id, grade) and unmapped evidence (case_id, idx).

    evidence: case_id, idx, doc, page, text; chunks: doc, page, chunk_id, chunk_index,
    content; keywords: case_id, keyword. Evidence meets the chunks of its page only, by
    equality. The best match of at least `least` has grade 3, other chunks of the page that
    hold a keyword 1; without such a match every chunk with a keyword has 1; without those
    the evidence is unmapped. Of several grades the highest holds.
    """
    key = keywords.select("case_id", tx.evidence_text(F.col("keyword")).alias("k")).where("k <> ''").groupBy("case_id").agg(F.collect_set("k").alias("ks"))
    e = evidence.select("case_id", "idx", "doc", "page", tx.evidence_text(F.col("text")).alias("e")).join(key, "case_id", "left")
    c = chunks.select("doc", "page", "chunk_id", "chunk_index", tx.evidence_text(F.col("content")).alias("c"))
    j = e.join(c, ["doc", "page"]).select("case_id", "idx", "chunk_id", "chunk_index", F.round(token_f1(F.col("e"), F.col("c")), 9).alias("score"), F.exists(F.coalesce("ks", F.array().cast("array<string>")), lambda k: F.contains(F.col("c"), k)).alias("named"))
    w = Window.partitionBy("case_id", "idx")
    j = j.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "chunk_index", "chunk_id")))
    grade = F.when((F.col("n") == 1) & (F.col("score") >= least), 3).when(F.col("named"), 1)
    graded = j.withColumn("grade", grade).where("grade IS NOT NULL")
    mapped = graded.select("case_id", "idx").distinct()
    unmapped = evidence.select("case_id", "idx").join(mapped, ["case_id", "idx"], "left_anti")
    return graded.groupBy("case_id", "chunk_id").agg(F.max("grade").alias("grade")), unmapped


def page_matches(evidence: DataFrame, chunks: DataFrame, floor: Column | None = None) -> DataFrame:
    """Every pair of an evidence (case_id, idx, doc, page, text) and a chunk of its page (doc, page, chunk_id, chunk_index, content).

    The score is the greater of the words' F1 and the share of matching characters. The
    share is worked out only where the texts' lengths let it reach the F1, or
    floor if that is greater; elsewhere the score is the F1, which then is the greater one (or
    both are below the floor). Pairs come by equality of document and page alone.
    """
    e = evidence.select("case_id", "idx", "doc", "page", seams.evidence_text(F.col("text")).alias("e"))
    c = chunks.select("doc", "page", "chunk_id", "chunk_index", seams.evidence_text(F.col("content")).alias("c"))
    return e.join(c, ["doc", "page"]).withColumn("score", seams.match_score("e", "c", F.lit(0.0) if floor is None else floor))


def evidence_map(evidence: DataFrame, chunks: DataFrame, keywords: DataFrame, least: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Each evidence with its best chunk (case_id, idx, chunk_id, score, by), and grades (case_id, chunk_id, grade).

    by tells how an evidence is bound: `text` to the best chunk of its page, if the score is
    at least `least` (ties: lower chunk_index, then chunk_id); `keyword` to the page's chunks that hold
    a keyword of the case, with no chunk of its own; null where neither is there, and for
    evidence whose page has no chunk. The best chunk has grade 3, other chunks with a keyword 1;
    of several grades of a chunk the highest holds. An evidence's best F1 bounds the ratios that are
    worked out: no chunk below it can be best. An evidence meets its page's chunks as one list, so pairs
    with their texts are never shuffled or sorted.
    """
    key = keywords.select("case_id", seams.evidence_text(F.col("keyword")).alias("k")).where("k <> ''").groupBy("case_id").agg(F.collect_set("k").alias("ks"))
    e = evidence.select("case_id", "idx", "doc", "page", seams.evidence_text(F.col("text")).alias("e")).join(key, "case_id", "left")
    c = chunks.select("doc", "page", "chunk_id", "chunk_index", seams.evidence_text(F.col("content")).alias("c"))
    pages = c.groupBy("doc", "page").agg(F.collect_list(F.struct("chunk_index", "chunk_id", "c")).alias("cs"))
    holds = lambda x: F.exists(F.coalesce("ks", F.array().cast("array<string>")), lambda k: F.contains(x["c"], k))
    j = e.join(pages, ["doc", "page"], "left").withColumn("score", seams.match_scores("e", F.transform("cs", lambda x: x["c"]), F.lit(least)))
    ranked = F.transform("cs", lambda x, i: F.struct((-F.get("score", i)).alias("minus"), x["chunk_index"].alias("chunk_index"), x["chunk_id"].alias("chunk_id"), holds(x).alias("named")))
    j = j.select("case_id", "idx", F.sort_array(ranked).alias("xs"))
    # Not posexplode(): its filter on the array's size would go below the scores, and work them all out a second time.
    each = j.select("case_id", F.posexplode_outer("xs").alias("n", "x"))
    grade = F.when((F.col("n") == 0) & (F.col("x.minus") <= -least), 3).when(F.col("x.named"), 1)
    grades = each.select("case_id", "x.chunk_id", grade.alias("grade")).where("grade IS NOT NULL").groupBy("case_id", "chunk_id").agg(F.max("grade").alias("grade"))
    top = F.get("xs", F.lit(0))
    best = F.coalesce(top["minus"] <= -least, F.lit(False))
    by = F.when(best, "text").when(F.exists("xs", lambda x: x["named"]), "keyword")
    return j.select("case_id", "idx", F.when(best, top["chunk_id"]).alias("chunk_id"), F.when(best, -top["minus"]).alias("score"), by.alias("by")), grades


def judgement_measures(marks: DataFrame) -> DataFrame:
    """case_id with context precision and recall, faithfulness, factual precision, recall and F1.

    marks: case_id, kind, ord, a, b. A `context` has a: relevant; an answer's `claim` has a:
    supported by context, b: by the reference; a `reference` claim has a: covered by the
    answer, b: supported by context. A ratio over nothing is 0.
    """
    w = Window.partitionBy("case_id", "kind").orderBy("ord")
    m = marks.withColumn("hits", F.sum(F.col("a").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    of = lambda kind, flag: F.count_if((F.col("kind") == kind) & F.col(flag))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    gain = F.sum(F.when((F.col("kind") == "context") & F.col("a"), F.col("hits") / F.col("rank")).otherwise(0.0))
    g = m.groupBy("case_id").agg(
        nm.ratio(gain, of("context", "a")).alias("context_precision"), nm.ratio(of("reference", "b"), n("reference")).alias("context_recall"), nm.ratio(of("claim", "a"), n("claim")).alias("faithfulness"),
        nm.ratio(of("claim", "b"), n("claim")).alias("factual_precision"), nm.ratio(of("reference", "a"), n("reference")).alias("factual_recall"),
    )
    return g.withColumn("factual_f1", nm.f1(F.col("factual_precision"), F.col("factual_recall")))


def generation_gate(rows: DataFrame) -> DataFrame:
    """run_id, cases, effective, abstained, passed, failures of small runs before a large one.

    rows: run_id, case_id, error, faithfulness, relevancy, f1, citations_valid, fabricated,
    no_answer (the case has none), abstention_right.
    """
    good = F.col("error").isNull() & (F.col("faithfulness") >= LEAST_FAITHFUL) & (F.col("relevancy") >= LEAST_RELEVANT) & (F.col("f1") >= LEAST_F1) & F.col("citations_valid") & ~F.col("fabricated")
    good = F.coalesce(good & (~F.col("no_answer") | F.col("abstention_right")), F.lit(False))
    g = rows.withColumn("good", good).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("good").alias("effective"), F.count_if(F.col("no_answer")).alias("expected"), F.count_if(F.col("no_answer") & F.col("good")).alias("abstained"),
        F.sort_array(F.collect_list(F.when(~F.col("good"), F.col("case_id")))).alias("failures"),
    )
    passed = (F.col("cases") == GATE_CASES) & (F.col("effective") >= GATE_PASSES) & (F.col("expected") == GATE_ABSTENTIONS) & (F.col("abstained") == GATE_ABSTENTIONS)
    return g.select("run_id", "cases", "effective", "abstained", passed.alias("passed"), "failures")


def sweep(cases: DataFrame, results: DataFrame, modes: tuple[str, ...] = ("bm25", "vector", "hybrid")) -> DataFrame:
    """mode, case_id, hits, error: a row for each mode and case, with an error where a retriever gave no row.

    results: mode, case_id, hits, error. Modes are a handful, so each case is repeated by them.
    """
    wanted = cases.select("case_id", F.explode(F.array(*(F.lit(m) for m in dict.fromkeys(modes)))).alias("mode"))
    j = wanted.join(results.select("mode", "case_id", "hits", "error", F.lit(True).alias("there")), ["mode", "case_id"], "left")
    return j.select("mode", "case_id", F.when(F.col("there") & F.col("error").isNull(), F.col("hits")).otherwise(0).alias("hits"), F.when(F.col("there"), F.col("error")).otherwise("no_result").alias("error"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """candidate_id, place: eligible ones first, then by latency (p95, mean), throughput, memory and configuration; a missing figure is the worst."""
    worst = F.lit(float("inf"))
    figure = lambda c: F.coalesce(F.col(c).cast("double"), worst)
    order = [F.desc("eligible"), figure("p95_ms"), figure("mean_ms"), F.coalesce(F.col("tps").cast("double"), -worst).desc(), figure("rss_mb"), F.col("config")]
    return candidates.select("group_id", "candidate_id", F.row_number().over(Window.partitionBy("group_id").orderBy(*order, "candidate_id")).alias("place"))


def complete_lineage(runs: DataFrame, *texts: str) -> DataFrame:
    """run_id, complete: status is complete and every named text is there and not empty."""
    ok = F.col("status") == "complete"
    for c in texts:
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return runs.select("run_id", F.coalesce(ok, F.lit(False)).alias("complete"))


def may_skip(lineage: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """run_id, skip: a run is not made again if its lineage is complete and its predictions are the expected cases, each once."""
    f = found.groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    e = expected.select("run_id", "case_id").distinct().withColumn("e", F.lit(True))
    j = f.join(e, ["run_id", "case_id"], "full_outer").groupBy("run_id").agg(F.bool_and((F.coalesce("n", F.lit(0)) == 1) & F.col("e").isNotNull()).alias("same"))
    return lineage.join(j, "run_id", "left").select("run_id", (F.col("complete") & F.coalesce("same", F.lit(False))).alias("skip"))


def report_cases(reports: DataFrame, json_col: str = "report") -> DataFrame:
    """report_id, case_no, case_id, rank, chunk_id, score from the JSON of retrieval reports; malformed reports give none."""
    schema = "struct<hybrid:struct<cases:array<struct<case_id:string,ranked_chunks:array<struct<chunk_id:bigint,score:double>>>>>>"
    cases = reports.select("report_id", F.posexplode(F.from_json(json_col, schema)["hybrid"]["cases"]).alias("case_no", "c"))
    each = cases.select("report_id", "case_no", F.col("c.case_id").alias("case_id"), F.posexplode("c.ranked_chunks").alias("i", "x"))
    return each.select("report_id", "case_no", "case_id", (F.col("i") + 1).alias("rank"), "x.chunk_id", "x.score")


def metric_at(metrics: Column, k: int) -> Column:
    """A measure at k from a map by the number as text; 0 where it is absent."""
    return F.coalesce(F.try_element_at(metrics, F.lit(str(k))), F.lit(0.0))


def merged_manifest(old: Column, new: Column) -> Column:
    """Entries of two maps of text, those of the new one over the old one's, as pairs in order of names."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.array_sort(F.map_entries(F.map_concat(kept, new)))


def scorecard_lines(scores: DataFrame) -> DataFrame:
    """metric, line: a row of a report's table with the change between two arms (metric, before, after)."""
    number = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(c)))
    change = F.when(F.col("before").isNull() | F.col("after").isNull(), "n/a").otherwise(F.format_string("%+.4f", F.col("after") - F.col("before")))
    return scores.select("metric", F.concat_ws(" | ", F.lit("|"), F.col("metric"), number("before"), number("after"), change, F.lit("|")).alias("line"))


def failure_rows(predictions: DataFrame, *codes: str) -> DataFrame:
    """model_id, case_id, failure_code, stable of wrong predictions; stable tells whether the code is one that reports may use."""
    return predictions.where("NOT correct").select("model_id", "case_id", "failure_code", F.coalesce(F.col("failure_code").isin(*codes), F.lit(False)).alias("stable"))


def recommendation(model: Column) -> Column:
    """What to train next, by the model that was selected; null is none."""
    low = F.lower(model)
    return (
        F.when(model.isNull(), "audit_contract_prompt_and_labels")
        .when(F.contains(low, F.lit("4b")), "train_smaller_keep_as_baseline")
        .when(F.contains(low, F.lit("1.7b")), "prioritize_this_keep_smaller_as_control")
        .otherwise("include_both_small_candidates")
    )


def smoke_faults(cases: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """set_id, fault: a smoke set has one case of each label, none paired, and no input twice when squeezed."""
    g = cases.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pair_id").isNotNull()).alias("paired"), F.count_distinct(tx.squeeze(F.col("input"))).alias("inputs"),
        *(F.count_if(F.col("label") == name).alias(f"of_{i}") for i, name in enumerate(labels)),
    )
    even = F.lit(True)
    for i in range(len(labels)):
        even = even & (F.col(f"of_{i}") == 1)
    faults = F.array(F.when(F.col("n") != len(labels), "case_count"), F.when(~even, "label_counts"), F.when(F.col("paired") > 0, "paired_case"), F.when(F.col("inputs") != F.col("n"), "repeated_input"))
    return g.select("set_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def zipped(cases: DataFrame, results: DataFrame, case_order: str, result_order: str) -> DataFrame:
    """Cases and results of a run joined by their place in it, the longer list cut, ties by id: run_id, place, case_id, result_id."""
    at = lambda df, order, tie: df.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(order, tie)))
    return at(cases, case_order, "case_id").join(at(results, result_order, "result_id"), ["run_id", "place"]).select("run_id", "place", "case_id", "result_id")


def case_slice(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cases of an explicit list (slice_id, ids) in its order; ids that no case has are skipped."""
    each = wanted.select("slice_id", F.posexplode("ids").alias("place", "case_id"))
    return each.join(cases, "case_id").select("slice_id", "place", "case_id", *(c for c in cases.columns if c != "case_id"))


def records(runs: DataFrame, hits: DataFrame) -> DataFrame:
    """run_id, record: each run with its ranked hits as one JSON text (hits: run_id, rank, chunk_id, score)."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score")))
    j = runs.join(hits.groupBy("run_id").agg(listed.alias("hits")), "run_id", "left")
    empty = F.array().cast("array<struct<rank:int,chunk_id:bigint,score:double>>")
    return j.select("run_id", F.to_json(F.struct("run_id", "status", F.coalesce("hits", empty).alias("hits"))).alias("record"))
