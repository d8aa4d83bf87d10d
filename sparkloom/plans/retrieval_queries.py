"""Retrieval queries: vector, full-text, hybrid, scoped, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.functions.vector import cosine, cosine_to, l2_to, literal_vector
from sparkloom.operators import retrieval as R
from sparkloom.session import load

_OK = "{v} IS NOT NULL AND len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def _ok(v: str) -> str:
    return _OK.format(v=v)


def _query(df: DataFrame, key: str, vector: str) -> list[float]:
    """The vector of the smallest key with a usable one: the stand-in for a query's embedding."""
    return list(df.where(l2_to(vector, [0.0] * 64) > 0).orderBy(key).select(vector).first()[0])


def _q(table: str, key: str, vector: str) -> str:
    return f"(SELECT {vector}::DOUBLE[] FROM {table} WHERE {_ok(vector)} ORDER BY {key} LIMIT 1)"


def _sim(table: str, key: str, vector: str) -> str:
    return f"CASE WHEN {_ok(vector)} THEN list_cosine_similarity({vector}::DOUBLE[], {_q(table, key, vector)}) END"


def _tf(text: str, term: str) -> str:
    return f"coalesce(len(list_filter(string_split_regex(lower({text}), '[^a-z0-9_]+'), lambda x: x = '{term}')), 0)"


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    top = R.vector_topk(e, "vec_id", "embedding", _query(e, "vec_id", "embedding"), 20, keep=("label",))
    docs = load(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return top.join(docs, "vec_id", "left").select("vec_id", "label", "source", F.round("similarity", 6).alias("similarity"))


def vector_threshold(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    return R.vector_topk(c, "id", "embedding", _query(c, "id", "embedding"), 50, threshold=0.3).select("id", F.round("similarity", 6).alias("similarity"))


def chunk_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    q = _query(c, "id", "embedding")
    inside = R.scope(c.where("chunk_type <> 'file_summary'"), language=["typescript", "python"])
    return R.vector_topk(inside, "id", "embedding", q, 25, threshold=0.2, keep=("file_path",)).select("id", "file_path", F.round("similarity", 6).alias("similarity"))


def scoped_topk(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    q = _query(f, "id", "summary_embedding")
    kinds = R.exclude_types(load(s, d, "repositories").select("repo_id", "repo_type"), "repo_type", ["reference", "documentation"])
    inside = f.join(kinds, "repo_id", "left_semi")
    return R.vector_topk(inside, "id", "summary_embedding", q, 15, threshold=0.1, keep=("repo_id",)).select("id", "repo_id", F.round("similarity", 6).alias("similarity"))


def hybrid_topk(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    out = R.hybrid_topk(c, "id", "embedding", "chunk_content", _query(c, "id", "embedding"), "token", 25)
    return out.select("id", F.round("keyword", 6).alias("keyword"), F.round("score", 6).alias("score"))


def hybrid_null_embedding(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    out = R.hybrid_topk(c, "id", "embedding", "chunk_content", _query(c, "id", "embedding"), "token", 40, parity=True)
    return out.select("id", F.round("keyword", 6).alias("keyword"), F.round("score", 6).alias("score"))


def two_stage_topk(s: SparkSession, d: str) -> DataFrame:
    f, c = load(s, d, "code_files"), load(s, d, "code_chunks")
    out = R.two_stage_topk(f, c, "summary_embedding", "embedding", _query(f, "id", "summary_embedding"), 10, 25, 0.0)
    return out.select("id", "repo_path", "file_path", F.round("similarity", 6).alias("similarity"))


def fts_single_term(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").select("doc_id", F.round(fts.cover_density(F.col("text"), ["channel"]), 6).alias("rank"))
    return x.where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(50)


def fts_and_terms(s: SparkSession, d: str) -> DataFrame:
    terms = fts.query_terms("the channel & parser")
    t = F.col("text")
    x = load(s, d, "documents").where(fts.contains_all(t, terms))
    return x.select("doc_id", sum((fts.term_frequency(t, w) for w in terms[1:]), fts.term_frequency(t, terms[0])).cast("bigint").alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(50)


def fts_cover_density(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").select("doc_id", F.round(fts.cover_density(F.col("text"), ["channel", "parser"]), 6).alias("rank"))
    return x.where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(50)


def l2_topk(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    return R.l2_topk(e, "vec_id", "embedding", _query(e, "vec_id", "embedding"), 20).select("vec_id", F.round("distance", 6).alias("distance"))


def inner_product_topk(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    return R.inner_product_topk(e, "vec_id", "embedding", _query(e, "vec_id", "embedding"), 20).select("vec_id", F.round("product", 6).alias("product"))


def two_phase_rerank(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    out = R.two_phase_rerank(e, "vec_id", "embedding", _query(e, "vec_id", "embedding"), 32, 100, 10)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    q = _query(c, "id", "embedding")
    vec = c.select("id", cosine_to("embedding", q).alias("sim")).where("sim is not null")
    kw = c.select("id", fts.cover_density(F.col("chunk_content"), ["token"]).alias("kw")).where("kw > 0")
    return R.rrf_fusion(kw, vec, "id", "kw", "sim").select("id", F.round("rrf_score", 8).alias("rrf_score"))


def topn_per_repo(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    q = _query(f, "id", "summary_embedding")
    x = f.where("repo_id is not null").select("repo_id", "id", cosine(F.col("summary_embedding"), literal_vector(q)).alias("sim")).where("sim is not null")
    return R.topn_per_group(x, "repo_id", [F.desc("sim"), F.col("id")], 3).select("repo_id", "id", F.col("rank").cast("bigint").alias("rank"))


def metadata_filtered_topk(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    q = _query(c, "id", "embedding")
    deep = F.try_variant_get(F.try_parse_json("metadata"), "$.complexity", "int")
    return R.vector_topk(c.where(deep >= 5), "id", "embedding", q, 20).select("id", F.round("similarity", 6).alias("similarity"))


def primary_first(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    q = _query(f, "id", "summary_embedding")
    x = f.select("id", "repo_id", cosine(F.col("summary_embedding"), literal_vector(q)).alias("sim")).where("sim is not null")
    return x.orderBy(F.when(F.col("repo_id") == "hibjol-root", 0).otherwise(1), F.desc("sim"), "id").limit(30).select("id", "repo_id", F.round("sim", 6).alias("similarity"))


def reference_search(s: SparkSession, d: str) -> DataFrame:
    c, r = load(s, d, "code_chunks"), load(s, d, "repositories")
    q = _query(c, "id", "embedding")
    docs = c.where("language = 'markdown'").select("id", "embedding")
    return R.reference_search(docs, c, r, q, 15, 0.0).select("kind", "id", F.round("similarity", 6).alias("similarity"))


def global_search_names(s: SparkSession, d: str) -> DataFrame:
    f, r = load(s, d, "code_files"), load(s, d, "repositories")
    top = R.vector_topk(f, "id", "summary_embedding", _query(f, "id", "summary_embedding"), 20, keep=("repo_id",))
    return top.join(r.select("repo_id", "repo_name"), "repo_id").select("id", "repo_name", F.round("similarity", 6).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_threshold, chunk_topk_filtered, scoped_topk, hybrid_topk, hybrid_null_embedding, two_stage_topk, fts_single_term, fts_and_terms, fts_cover_density, l2_topk, inner_product_topk,
        two_phase_rerank, rrf_fusion, topn_per_repo, metadata_filtered_topk, primary_first, reference_search, global_search_names,
    )
}

_E = _sim("embeddings", "vec_id", "embedding")
_C = _sim("code_chunks", "id", "embedding")
_FS = _sim("code_files", "id", "summary_embedding")
_HYBRID = f"WITH x AS (SELECT id, {_C} AS sim, 0.1::DOUBLE * {_tf('chunk_content', 'token')} AS kw FROM code_chunks), y AS (SELECT * FROM x WHERE sim > 0.3 OR kw > 0.01)"

SQL = {
    "vector_topk": f"WITH t AS (SELECT vec_id, label, {_E} AS sim FROM embeddings) SELECT vec_id, label, source, round(sim, 6) AS similarity FROM (SELECT * FROM t WHERE sim IS NOT NULL ORDER BY sim DESC, vec_id LIMIT 20) LEFT JOIN documents ON doc_id = vec_id",
    "vector_threshold": f"WITH t AS (SELECT id, {_C} AS sim FROM code_chunks) SELECT id, round(sim, 6) AS similarity FROM t WHERE sim > 0.3 ORDER BY sim DESC, id LIMIT 50",
    "chunk_topk_filtered": f"WITH t AS (SELECT id, file_path, {_C} AS sim FROM code_chunks WHERE chunk_type <> 'file_summary' AND language IN ('typescript', 'python')) SELECT id, file_path, round(sim, 6) AS similarity FROM t WHERE sim > 0.2 ORDER BY sim DESC, id LIMIT 25",
    "scoped_topk": f"WITH t AS (SELECT id, repo_id, {_FS} AS sim FROM code_files WHERE repo_id IN (SELECT repo_id FROM repositories WHERE repo_type NOT IN ('reference', 'documentation'))) SELECT id, repo_id, round(sim, 6) AS similarity FROM t WHERE sim > 0.1 ORDER BY sim DESC, id LIMIT 15",
    "hybrid_topk": _HYBRID + " SELECT id, round(kw, 6) AS keyword, round(0.7::DOUBLE * coalesce(sim, 0) + 0.3::DOUBLE * kw, 6) AS score FROM y ORDER BY 0.7::DOUBLE * coalesce(sim, 0) + 0.3::DOUBLE * kw DESC, id LIMIT 25",
    "hybrid_null_embedding": _HYBRID + " SELECT id, round(kw, 6) AS keyword, round(0.7::DOUBLE * sim + 0.3::DOUBLE * kw, 6) AS score FROM y ORDER BY 0.7::DOUBLE * sim + 0.3::DOUBLE * kw DESC NULLS FIRST, id LIMIT 40",
    "two_stage_topk": f"WITH f AS (SELECT id, repo_path, file_path, {_FS} AS sim FROM code_files), b AS (SELECT DISTINCT repo_path, file_path FROM (SELECT * FROM f WHERE sim IS NOT NULL ORDER BY sim DESC, id LIMIT 10)), c AS (SELECT id, repo_path, file_path, CASE WHEN {_ok('embedding')} THEN list_cosine_similarity(embedding::DOUBLE[], {_q('code_files', 'id', 'summary_embedding')}) END AS sim FROM code_chunks WHERE chunk_type <> 'file_summary' AND (repo_path, file_path) IN (SELECT (repo_path, file_path) FROM b)) SELECT id, repo_path, file_path, round(sim, 6) AS similarity FROM c WHERE sim > 0 ORDER BY sim DESC, id LIMIT 25",
    "fts_single_term": f"WITH t AS (SELECT doc_id, round(0.1::DOUBLE * {_tf('text', 'channel')}, 6) AS rank FROM documents) SELECT * FROM t WHERE rank > 0 ORDER BY rank DESC, doc_id LIMIT 50",
    "fts_and_terms": f"WITH t AS (SELECT doc_id, {_tf('text', 'channel')} AS a, {_tf('text', 'parser')} AS b FROM documents) SELECT doc_id, a + b AS hits FROM t WHERE a > 0 AND b > 0 ORDER BY hits DESC, doc_id LIMIT 50",
    "l2_topk": f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}), 6) AS distance FROM embeddings WHERE {_ok('embedding')} ORDER BY list_distance(embedding::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}), vec_id LIMIT 20",
    "inner_product_topk": f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}), 6) AS product FROM embeddings WHERE {_ok('embedding')} ORDER BY list_inner_product(embedding::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}) DESC, vec_id LIMIT 20",
    "two_phase_rerank": f"WITH c AS (SELECT vec_id, embedding, list_cosine_similarity(embedding[1:32]::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}[1:32]) AS part FROM embeddings WHERE {_ok('embedding')} ORDER BY part DESC, vec_id LIMIT 100) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}), 6) AS similarity FROM c ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_q('embeddings', 'vec_id', 'embedding')}) DESC, vec_id LIMIT 10",
    "rrf_fusion": f"WITH t AS (SELECT id, {_C} AS sim, 0.1::DOUBLE * {_tf('chunk_content', 'token')} AS kw FROM code_chunks), a AS (SELECT id, row_number() OVER (ORDER BY kw DESC, id) AS r FROM t WHERE kw > 0 QUALIFY r <= 20), b AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM t WHERE sim IS NOT NULL QUALIFY r <= 20) SELECT id, round(1.0::DOUBLE / (60 + coalesce(a.r, 1000)) + 1.0::DOUBLE / (60 + coalesce(b.r, 1000)), 8) AS rrf_score FROM a FULL OUTER JOIN b USING (id)",
    "topn_per_repo": f"WITH t AS (SELECT repo_id, id, {_FS} AS sim FROM code_files WHERE repo_id IS NOT NULL) SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY sim DESC, id) AS rank FROM t WHERE sim IS NOT NULL QUALIFY rank <= 3",
    "metadata_filtered_topk": f"WITH t AS (SELECT id, {_C} AS sim FROM code_chunks WHERE try_cast(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.complexity') END AS INT) >= 5) SELECT id, round(sim, 6) AS similarity FROM t WHERE sim IS NOT NULL ORDER BY sim DESC, id LIMIT 20",
    "primary_first": f"WITH t AS (SELECT id, repo_id, {_FS} AS sim FROM code_files) SELECT id, repo_id, round(sim, 6) AS similarity FROM t WHERE sim IS NOT NULL ORDER BY CASE WHEN repo_id = 'hibjol-root' THEN 0 ELSE 1 END, sim DESC, id LIMIT 30",
    "reference_search": f"WITH t AS (SELECT id, repo_id, language, {_C} AS sim FROM code_chunks) SELECT * FROM (SELECT 'documentation' AS kind, id, round(sim, 6) AS similarity FROM t WHERE language = 'markdown' AND sim > 0 ORDER BY sim DESC, id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'code' AS kind, id, round(sim, 6) AS similarity FROM t WHERE repo_id IN (SELECT repo_id FROM repositories WHERE repo_type = 'reference') AND sim > 0 ORDER BY sim DESC, id LIMIT 8)",
    "global_search_names": f"WITH t AS (SELECT id, repo_id, {_FS} AS sim FROM code_files) SELECT x.id AS id, repo_name, round(sim, 6) AS similarity FROM (SELECT * FROM t WHERE sim IS NOT NULL ORDER BY sim DESC, id LIMIT 20) x JOIN repositories USING (repo_id)",
}
