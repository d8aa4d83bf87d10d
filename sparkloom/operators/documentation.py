"""Documentation chunks: vector search with tags and ids, lists of documents, removal with counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.retrieval import vector_topk

DOC_COLUMNS = ("doc_id", "file_path", "chunk_type", "tags")


def documentation_search(
    chunks: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.5, tags: Sequence[str] | None = None, doc_ids: Sequence[str] | None = None, code_blocks: bool = True
) -> DataFrame:
    """``(chunk_id, doc_id, file_path, chunk_type, tags, similarity)``: the best documentation chunks over ``threshold``.

    ``tags`` keeps chunks that share one of them, ``doc_ids`` those of the documents; empty lists restrict nothing. Without ``code_blocks`` only
    sections count. Null tags share none; chunks without a usable vector are never found.
    """
    if tags:
        chunks = chunks.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if doc_ids:
        chunks = chunks.where(F.col("doc_id").isin(list(doc_ids)))
    if not code_blocks:
        chunks = chunks.where("chunk_type = 'section'")
    return vector_topk(chunks, "chunk_id", "embedding", query, k, threshold, keep=DOC_COLUMNS)


def document_list(files: DataFrame, tags: Sequence[str] | None = None, fan_out: bool = False) -> DataFrame:
    """``(doc_id, file_paths, tags, section_count, code_block_count, indexed_at)`` of every document.

    ``files(doc_id, file_path, tags, section_count, code_block_count, indexed_at)``. Each side is aggregated by itself. ``fan_out`` gives the sums of a plain
    unnesting of tags instead: a file counts once for each of its tags, and files without tags are left out.
    """
    if tags:
        files = files.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    times = F.size("tags") if fan_out else F.lit(1)
    rows = files.where("size(tags) > 0") if fan_out else files
    each = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("file_path")).alias("file_paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.sum(F.col("section_count") * times).alias("section_count"), F.sum(F.col("code_block_count") * times).alias("code_block_count"), F.max("indexed_at").alias("indexed_at"),
    )
    return each


def remove_documents(tables: dict[str, DataFrame], doc_ids: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the documents, and ``(table_name, removed)``: rows removed from each."""
    gone = F.col("doc_id").isin(list(doc_ids)) if doc_ids else F.lit(False)
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.when(gone, 1)).alias("removed")).select(F.lit(name).alias("table_name"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    return {n: df.where(~gone | F.col("doc_id").isNull()) for n, df in tables.items()}, counts


def replace_file(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` with all rows of the files in ``fresh`` replaced by its rows (by doc_id and file_path)."""
    files = fresh.select("doc_id", "file_path").distinct()
    return chunks.join(files, ["doc_id", "file_path"], "left_anti").unionByName(fresh.select(chunks.columns))
