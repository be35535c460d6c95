"""Queries over the driver's tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.suffixes import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.substring import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.exact import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.bpe_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.huffman import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestrand.llm.merkle import audited

    docs = _table(spark, sf_dir, "documents")
    sevenths = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    return audited(docs, sevenths, ("n_chars", (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array, op2_substring_dedup, op3_exact_dedup, op4_toxicity, op5_packing, op6_token_counts, op7_minhash, op8_html_text, op9_language_id, op10_decontamination, op11_huffman, op12_merkle, op13_resampling, pipeline)}


def oracle_sql() -> dict[str, str]:
    from lodestrand.llm import sql

    return {"op3_exact_dedup": sql.EXACT, "op12_merkle": sql.MERKLE, "op13_resampling": sql.RESAMPLING}
