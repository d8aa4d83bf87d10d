"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import credentials, function_docs, handwritten, leakage, near_duplicates, packing, similar_vectors, splitting, template_residue
from sparkloom.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(credentials.find_credentials(load(spark, d, "code_chunks")))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(load(spark, d, "code_chunks"))


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(load(spark, d, "code_files"), load(spark, d, "code_chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(p2_kinds(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = similar_vectors.similar_vectors(
        {
            "code_files": (load(spark, d, "code_files"), "id", "summary_embedding"),
            "code_chunks": (load(spark, d, "code_chunks"), "id", "embedding"),
            "code_symbols": (load(spark, d, "code_symbols"), "id", "embedding"),
        },
        is_query="id % 40 = 0",
        exact=True,
    )
    return out.select("tbl", "id", "neighbor_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(load(spark, d, "code_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(p4_pieces(spark, d))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    table = function_docs.chunk_symbols(load(spark, d, "code_chunks")).unionByName(function_docs.stored_symbols(load(spark, d, "code_symbols")))
    return function_docs.function_docs(table)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("tbl", "record_id", "function_name")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "code_chunks").select(F.lit("code_chunks").alias("tbl"), "id", F.col("chunk_content").alias("text"))
    symbols = load(spark, d, "code_symbols").select(F.lit("code_symbols").alias("tbl"), "id", F.col("definition").alias("text"))
    return chunks.unionByName(symbols)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(*near_duplicates.near_duplicates(_texts(spark, d)))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_groups(*near_duplicates.near_duplicates(_texts(spark, d)))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(load(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(load(spark, d, "documents").select("doc_id", "kind", "source"), _leaks(spark, d))


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return template_residue.template_residue(load(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue.found_documents(_residue(spark, d))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return template_residue.without_residue(load(spark, d, "documents").select("doc_id", "kind", "source"), _residue(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_redacted": p1_redacted,
        "p2_found": p2_found,
        "p2_kinds": p2_kinds,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p5_found": p5_found,
        "p5_pairs": p5_pairs,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p7_packing": p7_packing,
        "p8_found": p8_found,
        "p8_clean": p8_clean,
        "p9_found": p9_found,
        "p9_clean": p9_clean,
    }
