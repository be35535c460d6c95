"""Lexical ranking: postings, corpus statistics and BM25 over batches of queries.

Postings are rows of term and document, kept in order of terms as a stored index, so that a
question reads what its terms need and not the collection. Statistics are always those of
the whole collection; a query's scope only limits which rows are ranked.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.runtime import materialize, release, shared_dir
from lodestrand.sources import versions

K1, B = 1.2, 0.75
TITLE_WEIGHT, BODY_WEIGHT = 5.0, 1.0
LEAST_IDF = 1e-6
#: Goes up when what an index holds, or how texts become tokens, changes.
FORMAT = 3
#: Rows up to which the query side of a join may be broadcast.
BROADCAST_ROWS = 100_000
#: Distinct query terms up to which they are a filter of the scan, which then skips row groups of other terms.
PUSHED_TERMS = 1_000
#: Rows that a task of a shuffle is given to sort or to add up, at most about.
TASK_ROWS = 2_000_000


def tokens(docs: DataFrame, id_col: str = "doc_id", title_col: str | None = "source", text_col: str = "text", mixed: bool = False, words: dict[str, int] | None = None) -> DataFrame:
    """doc_id, title and body token arrays: plain words, or with mixed the full tokenizer (NFKC, stems, CJK by a vocabulary if given)."""
    if mixed:
        from lodestrand.functions.stemming import tokens_by

        by = tokens_by(docs.sparkSession, words)
        split = lambda name: by(F.col(name))
    else:
        split = lambda name: tx.word_tokens(F.col(name))
    title = split(title_col) if title_col else F.array().cast("array<string>")
    return docs.select(F.col(id_col).alias("doc_id"), title.alias("title"), split(text_col).alias("body"))


def _fields():
    """The tokens of both fields as structs of term and one mark for its field."""
    mark = lambda name, t: F.transform(name, lambda x: F.struct(x.alias("term"), F.lit(t).alias("t"), F.lit(1 - t).alias("b")))
    return F.concat(mark("title", 1), mark("body", 0))


_TERMS = "terms array<struct<term: string, tf_title: bigint, tf_body: bigint>>"


def _runs(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, value and number of each run of equal values in sorted lists."""
    values, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    code = values.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    return row[first], values.take(pa.array(first)), np.diff(first, append=len(code))


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, length and terms of rows with sorted tokens: runs of both fields, equal terms of a row as one."""
    for batch in batches:
        (rt, vt, nt), (rb, vb, nb) = (_runs(batch.column(name)) for name in ("title", "body"))
        found = pa.chunked_array([vt, vb]).combine_chunks().dictionary_encode()
        many = max(len(found.dictionary), 1)
        key, place = np.unique(np.concatenate([rt, rb]) * many + found.indices.to_numpy(), return_inverse=True)
        title, body = (np.bincount(place, np.concatenate(n), len(key)).astype("int64") for n in ((nt, 0 * nb), (0 * nt, nb)))
        structs = pa.StructArray.from_arrays([found.dictionary.take(pa.array(key % many)), pa.array(title), pa.array(body)], ["term", "tf_title", "tf_body"])
        ends = np.searchsorted(key // many, np.arange(batch.num_rows + 1)).astype("int32")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("length"), pa.ListArray.from_arrays(pa.array(ends), structs)], ["doc_id", "length", "terms"])


def _counted(read: DataFrame) -> DataFrame:
    """doc_id, length and what a row has of each term, counted within the row: no table of a task's terms and documents."""
    ordered = read.select("doc_id", F.col("length").cast("int").alias("length"), F.sort_array("title").alias("title"), F.sort_array("body").alias("body"))
    return ordered.mapInArrow(_row_counts, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, length int, {_TERMS}")


def counted(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, length and terms of documents, a row for each."""
    return _counted(tokens(docs, **columns).withColumn("length", F.size("title") + F.size("body")))


def spread(df: DataFrame, rows: int, by_range: bool, *keys: str) -> DataFrame:
    """The frame dealt by its keys: as Spark does for few rows, else to so many partitions that each gets about TASK_ROWS."""
    deal = df.repartitionByRange if by_range else df.repartition
    return deal(*keys) if rows <= df.sparkSession.sparkContext.defaultParallelism * TASK_ROWS else deal(-(-rows // TASK_ROWS), *keys)


def postings(docs: DataFrame, **columns) -> DataFrame:
    """term, doc_id, tf_title, tf_body: one row for each term of a document."""
    each = tokens(docs, **columns).select("doc_id", F.explode(_fields()).alias("x"))
    return each.groupBy(F.col("x.term").alias("term"), "doc_id").agg(F.sum("x.t").alias("tf_title"), F.sum("x.b").alias("tf_body"))


def lengths(docs: DataFrame, **columns) -> DataFrame:
    """doc_id and its unweighted number of tokens in both fields."""
    return tokens(docs, **columns).select("doc_id", (F.size("title") + F.size("body")).alias("length"))


def collection_stats(docs: DataFrame, **columns) -> DataFrame:
    """One row: documents, tokens, mean length."""
    return lengths(docs, **columns).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("n_tokens"), F.avg("length").alias("avgdl"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass
class Index:
    """A collection ready for ranking: postings with lengths, each term's documents, and the collection's size."""

    postings: DataFrame  # term, doc_id, length, tf_title, tf_body
    terms: DataFrame  # term, df
    stats: DataFrame  # n_docs, avgdl: one row
    words: dict[str, int] | None = None  # what CJK runs were cut by
    counted: DataFrame | None = None  # doc_id, length, terms of documents that are not stored yet

    @classmethod
    def of(cls, docs: DataFrame, segment: bool = False, **columns) -> Index:
        """Of documents as they are; nothing is stored. With segment, CJK runs are cut by a vocabulary that the documents' texts give."""
        words = None
        if segment:
            from lodestrand.functions.segment import vocabulary
            from lodestrand.functions.stemming import nfkc

            words = vocabulary(docs.select(nfkc(F.col(columns.get("text_col", "text"))).alias("text")))
            columns = {**columns, "mixed": True, "words": words}
        return cls._over(counted(docs, **columns), words)

    @classmethod
    def _over(cls, counted: DataFrame, words: dict[str, int] | None) -> Index:
        found = _added(_each(counted))
        stats = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))
        return cls(found, found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats, words, counted)

    def save(self, path: str) -> Index:
        """Write the index and read it back; postings lie in order of terms, so a scan for a few terms skips the rest."""
        spark = self.postings.sparkSession
        found, counted, stats = self.postings, None, self.stats
        if self.counted is not None:  # the texts are read once; the order of terms and the statistics come from what was counted
            counted = materialize(self.counted, "counted")
            found, stats = _each(counted), Index._over(counted, None).stats
        rows = found.count() if counted is None else counted.agg(F.sum(F.size("terms"))).first()[0] or 0
        dealt = spread(found, rows, True, "term", "doc_id")
        if counted is not None and _repeated(counted):
            dealt = _added(dealt)
        dealt.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        if self.words is not None:
            spark.createDataFrame(list(self.words.items()), "word string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/words")
        stats.write.mode("overwrite").parquet(f"{path}/stats")  # last: an index with statistics is whole
        if counted is not None:
            release(counted)
        return Index.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        words = None
        if "words" in versions.listed(spark, path):  # at most segment.WORDS and the script's characters
            words = {r[0]: r[1] for r in spark.read.schema("word string, n long").parquet(f"{path}/words").collect()}
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "stats")), words)

    @classmethod
    def stored(cls, docs: DataFrame, **columns) -> Index:
        """The index of a frame over files, built where the shared folder has none for its plan, its present files and these columns.

        A frame whose files or whose filters and columns differ has an index of its own; one
        that reads no files is indexed as it is, without being stored. An index is written
        aside and renamed, so that of two builders the second takes what the first has made.
        """
        files = sorted(docs.inputFiles())
        if not files:
            return cls.of(docs, **columns)
        spark = docs.sparkSession
        plan = docs._jdf.queryExecution().analyzed().canonicalized().toString()
        name = hashlib.sha256(repr((FORMAT, _facts(spark, files), plan, docs.semanticHash(), sorted(columns.items()))).encode()).hexdigest()[:24]
        path = f"{shared_dir(spark)}/lexical-index-{name}"
        if not versions.listed(spark, path):
            aside = f"{path}-{uuid.uuid4().hex}"
            cls.of(docs, **columns).save(aside)
            if not versions.move(spark, aside, path):
                versions.remove(spark, aside)
        return cls.load(spark, path)


def _each(counted: DataFrame) -> DataFrame:
    """term, doc_id, length, tf_title, tf_body: a row for each term of a row."""
    # Not explode(): its filter on the array's size would go below the sort, and sort a text again for each of its words.
    each = counted.select("doc_id", "length", F.explode_outer("terms").alias("x")).where("x IS NOT NULL")
    return each.select("x.term", "doc_id", "length", "x.tf_title", "x.tf_body")


def _repeated(counted: DataFrame) -> bool:
    """Whether an id has several rows; else each of its terms has one, as a row's terms are one each."""
    return not counted.groupBy("doc_id").count().where("count > 1").isEmpty()


def each_term(counted: DataFrame) -> DataFrame:
    """term, doc_id, length, tf_title, tf_body: a row for each term of an id and length."""
    return _added(_each(counted)) if _repeated(counted) else _each(counted)


def _added(each: DataFrame) -> DataFrame:
    return each.groupBy("term", "doc_id", "length").agg(F.sum("tf_title").alias("tf_title"), F.sum("tf_body").alias("tf_body"))


def _facts(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """Name, size and time of each file, by one listing of each folder that holds some."""
    sc = spark.sparkContext
    conf, path_of = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    wanted, facts = {path_of(f).toUri().getPath() for f in files}, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        at = path_of(folder)
        facts += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in at.getFileSystem(conf).listStatus(at) if s.getPath().toUri().getPath() in wanted]
    return sorted(facts)


def bm25(source: DataFrame | Index, terms: DataFrame, top_k: int = 20, scope: DataFrame | None = None, **columns) -> DataFrame:
    """query_id, set_id, doc_id, score, rank of the best documents of each query's term set.

    source: an index, or documents. terms: query_id, set_id, term. scope (query_id, doc_id)
    limits what is ranked. Scores are negative, lower is better, as full-text engines give
    them; ties go by doc_id.
    """
    index = source if isinstance(source, Index) else Index.of(source, **columns)
    wanted = terms.select("query_id", "set_id", "term").where("term IS NOT NULL").distinct()
    # One check of the query side decides for its terms and their statistics, which are no more rows.
    asked = wanted.limit(BROADCAST_ROWS + 1).collect()
    named = len(asked) <= BROADCAST_ROWS
    side = F.broadcast if named else (lambda df: df)
    there, known, words = index.postings, index.terms, {r["term"] for r in asked}
    if named and len(words) <= PUSHED_TERMS:
        there, known = there.where(F.col("term").isin(*words)), known.where(F.col("term").isin(*words))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # stats is one row.
    known = known.join(side(wanted.select("term").distinct()), "term", "left_semi")
    idf = known.crossJoin(F.broadcast(index.stats)).select("term", "avgdl", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    tf = TITLE_WEIGHT * F.col("tf_title") + BODY_WEIGHT * F.col("tf_body")
    weighed = there.join(side(idf), "term").select("term", "doc_id", (F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))).alias("part"))
    # A term's postings are shuffled once, by document, and not again for each question that has the term.
    if named and scope is None:
        scored = _best(spread(weighed, known.agg(F.sum("df")).first()[0] or 0, False, "doc_id"), asked, wanted, top_k)
    else:
        pairs = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(known.select("term", "df"), "term").agg(F.sum(F.col("n") * F.col("df"))).first()[0] or 0
        scored = spread(weighed, pairs, False, "doc_id").join(side(wanted), "term")
        if scope is not None:
            scored = scored.join(scope.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
        scored = scored.groupBy("query_id", "set_id", "doc_id").agg(F.round(-F.sum("part"), 9).alias("score"))
    order = Window.partitionBy("query_id", "set_id").orderBy("score", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nine places as round() of Spark gives them: the half of a number's shortest digits goes away from 0."""
    y = x * 1e9
    out = np.rint(y) / 1e9
    for i in np.flatnonzero(np.abs(np.abs(y - np.floor(y)) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _best(weighed: DataFrame, asked: list, wanted: DataFrame, top_k: int) -> DataFrame:
    """query_id, set_id, doc_id, score: what can be among a set's best, of weighed postings (term, doc_id, part) dealt by document.

    A part holds all postings of its documents, so it adds up their scores and sends on its
    own best ones of each set; no row is made for a question and a document.
    """
    sets: dict[tuple, list[str]] = {}
    for r in sorted(asked, key=lambda r: r["term"]):
        sets.setdefault((r["query_id"], r["set_id"]), []).append(r["term"])
    names, lists = list(sets), list(sets.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        postings = pa.Table.from_batches(held)
        term, doc = (postings.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "doc_id"))
        by_id = pc.sort_indices(doc.dictionary, null_placement="at_start").to_numpy()
        ids, place = doc.dictionary.take(pa.array(by_id)), np.empty(len(by_id), "int64")
        place[by_id] = np.arange(len(by_id))
        code = term.indices.to_numpy()
        by_term = np.argsort(code, kind="stable")
        at, part = place[doc.indices.to_numpy()[by_term]], postings.column("part").to_numpy()[by_term]
        starts = np.searchsorted(code[by_term], np.arange(len(term.dictionary) + 1))
        slices = {t: slice(*starts[i : i + 2]) for i, t in enumerate(term.dictionary.to_pylist())}
        found: list[tuple] = []
        for n, words in enumerate(lists):
            if own := [slices[w] for w in words if w in slices]:
                score = np.bincount(np.concatenate([at[s] for s in own]), np.concatenate([part[s] for s in own]), len(ids))
                docs = np.flatnonzero(score)
                if len(docs) > top_k:  # what rounding may bring level with the last of the best stays until it is rounded
                    docs = docs[score[docs] >= np.partition(score[docs], -top_k)[-top_k] - 2e-9]
                score = _rounded(-score[docs])
                first = np.lexsort((docs, score))[:top_k]
                found.append((np.full(len(first), n), docs[first], score[first]))
        if found:
            n, docs, score = map(np.concatenate, zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), ids.take(pa.array(docs)), pa.array(score)], ["__set", "doc_id", "score"])

    best = weighed.mapInArrow(run, f"__set int, doc_id {weighed.schema['doc_id'].dataType.simpleString()}, score double")
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("query_id", "set_id"))
    named = wanted.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(names)], f"__set int, {kinds}")
    return best.join(F.broadcast(named), "__set").select("query_id", "set_id", "doc_id", "score")


def term_sets(queries: DataFrame, n: int = 8, id_col: str = "item_id", text_col: str = "text", mixed: bool = False, words: dict[str, int] | None = None) -> DataFrame:
    """query_id, set_id 1, term: the first n distinct tokens of each query; words are those of the index, if it has any."""
    if mixed:
        from lodestrand.functions.stemming import tokens_by

        terms = F.slice(tokens_by(queries.sparkSession, words, True)(F.col(text_col)), 1, n)
    else:
        terms = tx.query_terms(F.col(text_col), n)
    return queries.select(F.col(id_col).alias("query_id"), F.lit(1).alias("set_id"), F.explode(terms).alias("term"))


def synonym_sets(plans: DataFrame) -> DataFrame:
    """Two sets for each plan (query_id, lexical, synonyms): lexical terms, then those with the synonyms that add to them."""
    key = lambda c: F.transform(c, lambda x: F.lower(x))
    return plans.select(
        "query_id", F.posexplode(F.array(F.array_distinct(key("lexical")), F.array_union(key("lexical"), key("synonyms")))).alias("set_id", "terms")
    ).select("query_id", (F.col("set_id") + 1).alias("set_id"), F.explode("terms").alias("term"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, n: documents where a phrase (query_id, words) stands with its words adjacent.

    Joined on the first word only by equality, then confirmed on the following positions,
    so the work is that of the first word's places.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), tx.word_tokens(F.col(text_col)).alias("body"))
    at = body.select("doc_id", "body", F.posexplode("body").alias("pos", "term"))
    firsts = phrases.select("query_id", "words", F.col("words")[0].alias("term"))
    joined = at.join(small(firsts), "term").where(F.slice("body", F.col("pos") + 1, F.size("words")) == F.col("words"))
    return joined.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
