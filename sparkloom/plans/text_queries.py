"""Scalar text functions and text decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.functions import text as T
from sparkloom.operators import decompose as D
from sparkloom.session import load
from sparkloom.streaming.watch import windowed_counts


def file_hash(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", T.sha256(F.col("text")).alias("file_hash"), T.cache_key(F.col("text")).alias("cache_key"))


def line_stats(s: SparkSession, d: str) -> DataFrame:
    t = F.col("chunk_content")
    return load(s, d, "code_chunks").groupBy("chunk_type").agg(F.sum(T.line_count(t)).alias("lines"), F.max(T.line_count(t)).alias("longest"), F.count("*").alias("n"))


def token_estimate(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    est = T.token_estimate(F.col("chunk_content"))
    return c.select("id", est.alias("tokens"), F.coalesce(est != F.col("token_count"), F.lit(True)).alias("stale"))


def path_parts(s: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return load(s, d, "code_files").select("id", T.basename(p).alias("basename"), T.dirname(p).alias("dirname"), T.extension(p).alias("ext"), T.stem(p).alias("stem"), T.language(p).alias("lang"))


def complexity(s: SparkSession, d: str) -> DataFrame:
    t = F.col("chunk_content")
    return load(s, d, "code_chunks").select("id", T.complexity(t).alias("complexity"), T.has_loops(t).alias("loops"), T.has_async(t).alias("is_async"))


def minified_chunks(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_chunks").select("id", T.is_minified(F.col("chunk_content")).alias("minified")).where("minified")


def size_categories(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_files").groupBy(T.size_category(F.col("total_lines")).alias("category")).agg(F.count("*").alias("n"))


def url_paths(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "repositories").where("git_remote_url is not null").select("repo_id", T.url_path(F.col("git_remote_url")).alias("path"))


def query_type(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(s, d, "eval_items").select("item_id", T.query_type(t).alias("query_type"), F.char_length(T.normalize_query(t)).cast("bigint").alias("length"))


def sanitized_queries(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "eval_items").select("item_id", fts.sanitize(F.col("text")).alias("query"))


def call_detect(s: SparkSession, d: str) -> DataFrame:
    """Calls in chunks, each with three calls by its id at the end (the stored chunks hold none)."""
    calls = F.concat(F.coalesce("chunk_content", F.lit("")), F.lit("\nawait fetch('/chunks/"), F.col("id"), F.lit("')\nr = requests.get('https://api.example/chunks/"), F.col("id"), F.lit("')\nconn := grpc.Dial(\"node-1:50051\")"))
    out = D.api_calls(load(s, d, "code_chunks").select("id", calls.alias("text")), "id", "text")
    return out.groupBy("style", T.call_confidence(F.col("target")).alias("confidence")).agg(F.count("*").alias("calls"))


def heading_sections(s: SparkSession, d: str) -> DataFrame:
    return D.markdown_sections(load(s, d, "documents"), "doc_id", "text").groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("sections"), F.min("level").cast("bigint").alias("top_level"), F.max("level").cast("bigint").alias("deepest"))


def code_block_languages(s: SparkSession, d: str) -> DataFrame:
    return D.markdown_code(load(s, d, "documents"), "doc_id", "text").groupBy("language").agg(F.count("*").alias("blocks"))


def parsed_nodes(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks").select("id", "chunk_content", T.language(F.col("file_path")).alias("lang"))
    return D.file_nodes(c, "id", "chunk_content", "lang").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


def parsed_imports(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks").select("id", "chunk_content", T.language(F.col("file_path")).alias("lang"))
    return D.file_imports(c, "id", "chunk_content", "lang").groupBy("import_type").agg(F.count("*").alias("n"))


def rechunked_listings(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").select("doc_id", "text", T.language(F.col("file_path")).alias("lang"))
    return D.file_chunks(x, "doc_id", "text", "lang").groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def sliding_window_chunks(s: SparkSession, d: str) -> DataFrame:
    return D.sliding_windows(load(s, d, "documents"), "doc_id", "text", 20, 5).select("doc_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.char_length("content").cast("bigint").alias("chars"))


def truncated_texts(s: SparkSession, d: str) -> DataFrame:
    return D.truncated(load(s, d, "documents"), "doc_id", "text", 10, 10).select("doc_id", F.char_length("content").cast("bigint").alias("chars"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return windowed_counts(load(s, d, "events"), "ts", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        file_hash, line_stats, token_estimate, path_parts, complexity, minified_chunks, size_categories, url_paths, query_type, sanitized_queries, call_detect, heading_sections, code_block_languages, parsed_nodes, parsed_imports,
        rechunked_listings, sliding_window_chunks, truncated_texts, event_windows,
    )
}

_N = "len(string_split(chunk_content, chr(10)))"
_CNT = lambda rx: f"len(regexp_extract_all(chunk_content, '{rx}'))"
_LANG = "CASE " + " ".join(f"WHEN e = '{e}' THEN '{v}'" for e, v in T.LANGUAGES.items()) + " ELSE 'unknown' END"
_W = "('function', 'const', 'let', 'var', 'class', 'interface', 'type', 'import', 'export', 'return', 'async', 'await', 'def', 'public', 'private', 'static')"

SQL = {
    "file_hash": "SELECT doc_id, sha256(text) AS file_hash, sha256(text)[1:16] AS cache_key FROM documents",
    "line_stats": f"SELECT chunk_type, sum(CASE WHEN length(chunk_content) = 0 THEN 0 ELSE {_N} END)::BIGINT AS lines, max(CASE WHEN length(chunk_content) = 0 THEN 0 ELSE {_N} END)::BIGINT AS longest, count(*) AS n FROM code_chunks GROUP BY 1",
    "token_estimate": "SELECT id, ceil(length(chunk_content) / 4.0)::BIGINT AS tokens, coalesce(ceil(length(chunk_content) / 4.0)::BIGINT <> token_count, true) AS stale FROM code_chunks",
    "path_parts": f"SELECT id, basename, regexp_replace(file_path, '/?[^/]*$', '') AS dirname, e AS ext, regexp_replace(basename, '\\.[^.]+$', '') AS stem, {_LANG} AS lang FROM (SELECT id, file_path, string_split(file_path, '/')[-1] AS basename, lower(regexp_extract(string_split(file_path, '/')[-1], '(\\.[^.]+)$', 1)) AS e FROM code_files)",
    "complexity": "SELECT id, (1 + coalesce(" + " + ".join(_CNT(x) for x in (r"\bif\s*\(", r"\belse\b", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bcase\s+", r"\bcatch\s*\(", "&&", r"\|\|", r"\?")) + ", 0))::BIGINT AS complexity, regexp_matches(chunk_content, '\\b(for|while)\\s*\\(|\\bdo\\s*\\{|\\.(forEach|map|filter|reduce)\\(') AS loops, contains(chunk_content, 'async') AS is_async FROM code_chunks",
    "minified_chunks": "WITH l AS (SELECT id, chunk_content AS t, list_transform(string_split(chunk_content, chr(10)), lambda x: length(x)::DOUBLE) AS v FROM code_chunks) SELECT id, true AS minified FROM l WHERE len(v) >= 10 AND (len(list_filter(v, lambda x: x > 500)) > 5 OR list_sum(list_transform(v, lambda x: x * x)) / len(v) - (list_sum(v) / len(v)) ^ 2 < 10 OR len(regexp_extract_all(t, ' ')) / greatest(length(t), 1) < 0.05)",
    "size_categories": "SELECT CASE WHEN total_lines < 1000 THEN 'small' WHEN total_lines < 5000 THEN 'large' ELSE 'very-large' END AS category, count(*) AS n FROM code_files GROUP BY 1",
    "url_paths": "SELECT repo_id, CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS path FROM (SELECT repo_id, regexp_replace(regexp_replace(git_remote_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS p FROM repositories WHERE git_remote_url IS NOT NULL)",
    "query_type": f"WITH q AS (SELECT item_id, text, (SELECT count(*) FROM unnest({_W.replace('(', '[').replace(')', ']')}) u(w) WHERE contains(lower(text), w)) AS hits FROM eval_items), k AS (SELECT item_id, text, CASE WHEN hits >= 2 OR regexp_matches(text, '=>|===|!==|\\+\\+|--|&&|\\|\\||::') OR len(regexp_extract_all(text, '[{{}}()\\[\\]=<>]')) / length(text) > 0.1 THEN 'code_snippet' ELSE 'natural_language' END AS query_type FROM q) SELECT item_id, query_type, length(CASE WHEN query_type = 'natural_language' THEN regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?]+$', '') ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END) AS length FROM k",
    "sanitized_queries": "SELECT item_id, trim(regexp_replace(regexp_replace(text, '[&|!():*<>]', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM eval_items",
    "call_detect": "WITH n AS (SELECT count(*) AS n FROM code_chunks) SELECT 'fetch' AS style, 0.75::DOUBLE AS confidence, n AS calls FROM n UNION ALL SELECT 'requests', 0.95, n FROM n UNION ALL SELECT 'grpc_dial', 0.9, n FROM n",
    "heading_sections": "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x FROM documents), h AS (SELECT doc_id, length(regexp_extract(x, '^(#{1,6})[ \\t]+\\S', 1)) AS lv FROM l WHERE regexp_matches(x, '^#{1,6}[ \\t]+\\S')) SELECT doc_id, count(*) AS sections, min(lv) AS top_level, max(lv) AS deepest FROM h GROUP BY 1",
    "sliding_window_chunks": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, v, unnest(range(1, greatest(len(v) - 5, 1) + 1, 15)) AS start_line FROM l) SELECT doc_id, start_line, least(start_line + 19, len(v)) AS end_line, length(array_to_string(v[start_line:start_line + 19], chr(10))) AS chars FROM w",
    "truncated_texts": "WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS v FROM documents) SELECT doc_id, CASE WHEN len(v) > 20 THEN length(array_to_string(list_concat(v[1:10], ['... truncated ...'], v[-10:]), chr(10))) ELSE length(text) END AS chars FROM l",
    "event_windows": "SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
