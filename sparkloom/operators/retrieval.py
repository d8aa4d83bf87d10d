"""Vector, full-text and hybrid retrieval over file, chunk, symbol and document tables.

Every top-k is one filter, one score expression and ``orderBy(...).limit(k)``, which Spark runs as a bounded heap per partition
(TakeOrderedAndProject): no shuffle of the table. The query vector is a literal of the plan. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.functions.vector import cosine_to, dot_to, l2_to

VECTOR_WEIGHT, KEYWORD_WEIGHT, KEYWORD_LEAST = 0.7, 0.3, 0.01


def scope(df: DataFrame, **ids: Sequence[str] | None) -> DataFrame:
    """Keep rows whose columns are among the given ids (all given columns must match); None means no restriction, an empty list nothing."""
    for col, values in ids.items():
        if values is not None:
            df = df.where(F.col(col).isin(list(values)) if values else F.lit(False))
    return df


def exclude_types(df: DataFrame, column: str, types: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Drop rows of the given types. Null types drop out with ``!= ALL`` semantics, and stay with ``keep_null``."""
    cond = ~F.col(column).isin(list(types))
    return df.where(cond | F.col(column).isNull() if keep_null else cond)


def vector_topk(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, threshold: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows of highest cosine, ``(key, *keep, similarity)``; strictly above ``threshold`` if one is given."""
    out = df.select(key, *keep, cosine_to(vector, query).alias("similarity")).where(F.col("similarity").isNotNull())
    if threshold is not None:
        out = out.where(F.col("similarity") > threshold)
    return out.orderBy(F.desc("similarity"), key).limit(k)


def l2_topk(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    out = df.select(key, l2_to(vector, query).alias("distance")).where(F.col("distance").isNotNull())
    return out.orderBy("distance", key).limit(k)


def inner_product_topk(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    n = len(query)
    out = df.where(F.size(vector) == n).select(key, dot_to(vector, query).alias("product")).where(F.col("product").isNotNull())
    return out.orderBy(F.desc("product"), key).limit(k)


def hybrid_topk(
    df: DataFrame, key: str, vector: str, text: str, query: Sequence[float], query_text: str, k: int, threshold: float = 0.3, parity: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, *keep, similarity, keyword, score)``: 0.7 cosine + 0.3 keyword rank, kept if the cosine exceeds ``threshold`` or the rank 0.01.

    A row without a usable vector scores by its keyword part; with ``parity`` its score is null and nulls come first.
    """
    terms = fts.query_terms(query_text)
    sim = cosine_to(vector, query)
    out = df.select(key, *keep, sim.alias("similarity"), fts.cover_density(F.col(text), terms).alias("keyword"))
    out = out.where((F.col("similarity") > threshold) | (F.col("keyword") > KEYWORD_LEAST))
    base = F.col("similarity") if parity else F.coalesce("similarity", F.lit(0.0))
    out = out.withColumn("score", VECTOR_WEIGHT * base + KEYWORD_WEIGHT * F.col("keyword"))
    return out.orderBy(F.col("score").desc_nulls_first() if parity else F.desc("score"), key).limit(k)


def two_stage_topk(files: DataFrame, chunks: DataFrame, file_vector: str, chunk_vector: str, query: Sequence[float], k_files: int, k_chunks: int, chunk_threshold: float = 0.2) -> DataFrame:
    """Best files first, then the best chunks within them, file summaries left out. The file list is at most ``k_files`` rows."""
    best = vector_topk(files, "id", file_vector, query, k_files, keep=("repo_path", "file_path"))
    inside = chunks.where("chunk_type <> 'file_summary'").join(F.broadcast(best.select("repo_path", "file_path").distinct()), ["repo_path", "file_path"], "left_semi")
    return vector_topk(inside, "id", chunk_vector, query, k_chunks, chunk_threshold, keep=("repo_path", "file_path"))


def two_phase_rerank(df: DataFrame, key: str, vector: str, query: Sequence[float], coarse_dim: int, coarse_k: int, k: int) -> DataFrame:
    """Coarse top by the first ``coarse_dim`` elements, exact order of those."""
    part = cosine_to(F.slice(vector, 1, coarse_dim), query[:coarse_dim])
    coarse = df.where(F.size(vector) == len(query)).select(key, vector, part.alias("__part")).where(F.col("__part").isNotNull()).orderBy(F.desc("__part"), key).limit(coarse_k)
    return vector_topk(coarse, key, vector, query, k)


def rrf_fusion(a: DataFrame, b: DataFrame, key: str, score_a: str, score_b: str, top: int = 20, constant: int = 60, missing: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of two rankings; each is cut to its ``top`` best before it is numbered."""

    def ranked(df: DataFrame, score: str, name: str) -> DataFrame:
        cut = df.select(key, score).orderBy(F.desc(score), key).limit(top)  # at most ``top`` rows reach the window
        return cut.select(key, F.row_number().over(Window.orderBy(F.desc(score), key)).alias(name))

    both = ranked(a, score_a, "rank_a").join(ranked(b, score_b, "rank_b"), key, "full_outer")
    score = 1.0 / (constant + F.coalesce("rank_a", F.lit(missing))) + 1.0 / (constant + F.coalesce("rank_b", F.lit(missing)))
    return both.select(key, score.alias("rrf_score")).orderBy(F.desc("rrf_score"), key)


def topn_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per group; Spark cuts each partition to n rows a group before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)


def reference_search(docs: DataFrame, chunks: DataFrame, repositories: DataFrame, query: Sequence[float], k: int, threshold: float = 0.3) -> DataFrame:
    """Half of the hits from documentation rows, half from code of reference repositories, in one table with a kind column."""
    half = -(-k // 2)
    refs = repositories.where("repo_type = 'reference'").select("repo_id")
    code = vector_topk(chunks.join(refs, "repo_id", "left_semi"), "id", "embedding", query, half, threshold).select(F.lit("code").alias("kind"), "id", "similarity")
    return vector_topk(docs, "id", "embedding", query, half, threshold).select(F.lit("documentation").alias("kind"), "id", "similarity").unionByName(code)
