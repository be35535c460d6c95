"""Scans with the checks that go with them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("input", T.StructType([T.StructField("session_context", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))), T.StructField("current_question", T.StringType())])),
        T.StructField("expected", T.StructType([T.StructField("intent", T.StringType())])),
        T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("language", "difficulty", "scenario", "pair_id", "rationale")])),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strict_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file; a malformed line or a repeated id is an error."""
    rows = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    bad = rows.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"case id repeated or missing: {bad[0]['id']}")
    return rows


def lenient_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with missing metadata as `unknown`; malformed lines are skipped."""
    rows = spark.read.schema(CASE).option("mode", "DROPMALFORMED").json(path)
    get = lambda n: F.coalesce(F.col(f"metadata.{n}"), F.lit("unknown")).alias(n)
    return rows.select("id", "input", F.col("expected.intent").alias("expected"), get("language"), get("difficulty"), get("scenario"), F.col("metadata.pair_id").alias("pair_id"))


def case_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line; blank lines are skipped, none left or one repeated is an error."""
    ids = spark.read.text(path).select(F.trim("value").alias("case_id")).where("case_id <> ''")
    n = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("d")).first()
    if not n["n"] or n["n"] != n["d"]:
        raise ValueError("case ids must be there, and once each")
    return ids


def leaking_fixtures(rows: DataFrame) -> DataFrame:
    """Fixtures (id, question, expected) whose question holds the expected label."""
    return rows.where(F.contains(F.lower("question"), F.lower("expected")))


def primary_with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "doc_id") -> DataFrame:
    """The primary parser's documents whole, and the fallback's for the others."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def is_pdf(name, content):
    """Whether an upload is named and begins as a PDF file."""
    return F.lower(name).endswith(".pdf") & (F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary"))


def safe_name(column):
    """A file name of letters, digits, dot, dash and underscore, without leading dots."""
    last = F.regexp_extract(column, r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", "")
    return F.when(clean == "", "document").otherwise(clean)


def title_of(column):
    """A title from a file name: no extension, dashes and underscores as spaces."""
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(F.regexp_extract(column, r"([^/\\]*)$", 1), r"\.[^.]*$", ""), "_-", "  "), " +", " "))


class _Tables(HTMLParser):
    """Cells of each outermost table, with their spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth and tag == "tr":
            self.tables[-1].append([])
        elif self.depth and tag in ("td", "th"):
            span = dict(attrs)
            number = lambda k: max(1, min(1000, int(span[k]))) if str(span.get(k, "")).isdigit() else 1
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = [[], number("colspan"), number("rowspan")]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
            self.cell = None
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0].append(data)


def html_tables(html: str | None) -> list[tuple[list[str], list[list[str]]]]:
    """(columns, rows) of each table: spans filled in, blank rows dropped, repeated headers numbered from _2."""
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for rows in parser.tables:
        grid: dict[tuple[int, int], str] = {}
        for i, row in enumerate(rows):
            j = 0
            for text, wide, high in row:
                while (i, j) in grid:
                    j += 1
                value = " ".join("".join(text).split())
                for a in range(i, min(i + high, len(rows))):
                    for b in range(j, j + wide):
                        grid[a, b] = value
                j += wide
        width = 1 + max((b for _, b in grid), default=-1)
        full = [[grid.get((i, j), "") for j in range(width)] for i in range(len(rows))]
        full = [r for r in full if any(r)]
        if not full:
            continue
        seen: dict[str, int] = {}
        names = []
        for n in full[0]:
            seen[n] = seen.get(n, 0) + 1
            names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
        out.append((names, full[1:]))
    return out


def scan_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, table_no, columns, rows of every table of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, c, r) for p, h in zip(pdf["id"], pdf["html"]) for i, (c, r) in enumerate(html_tables(h))]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "columns", "rows"])

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return slim.mapInPandas(run, "page_id long, table_no long, columns array<string>, rows array<array<string>>")
