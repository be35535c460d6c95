"""The training-data pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of documents. Between stages the rows are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm import exact as copies
from lodestrand.llm import langid, minhash
from lodestrand.llm.decontaminate import clean
from lodestrand.llm.packing import pack
from lodestrand.runtime import lifetime, materialize, release

#: Packing has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those with null or empty text, or no letter, go.

    Learns from the labelled rows of its input. Repeated rows are judged each; other columns
    stay as they are, whatever their names; an empty table gives no rows.
    """
    return langid.known_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document: that with the largest id.

    Null and empty texts are equal. A null id is less than any other; of rows that repeat id
    and text one stays. Other columns stay as they are, whatever their names; an empty table
    gives no rows.
    """
    return copies.unlike_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), one document: that with the least id.

    Rows are told apart by id and text, so unlike texts with one id are judged each. A null
    id is greater than any other; ties go by shingle set and text, and of rows that repeat
    id and text one stays. Null and empty texts are like no other and stay. Other columns
    stay as they are, whatever their names; an empty table gives no rows.
    """
    return minhash.unlike_rows(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, exact or edited, of a benchmark item.

    Null and empty texts hold nothing and stay; repeated rows are judged each by their text.
    Other columns stay as they are, whatever their names; an empty table gives no rows.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of at most 1024 tokens.

    Every row gives a piece at least, null and empty texts that of their end token, and
    repeated rows each their own. Other columns are not read; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; of what they write, the rows that packing reads stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with lifetime(spark) as keep:
            kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(kept)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
