"""Lookups, counts, graphs, deduplication, assembly, incremental maintenance and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import assembly as A
from sparkloom.operators import graph as G
from sparkloom.operators import incremental as I
from sparkloom.operators import lookups as L
from sparkloom.operators import metrics as M
from sparkloom.operators import retrieval as R
from sparkloom.plans.retrieval_queries import _query, _sim
from sparkloom.session import load


def repo_counts_distinct(s: SparkSession, d: str) -> DataFrame:
    t = [load(s, d, x) for x in ("repositories", "code_files", "workspaces", "services")]
    return L.repository_counts(*t).select("repo_id", "branch", "file_count", "workspace_count", "service_count")


def list_workspaces(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "workspaces").select("repo_id", "workspace_id", "package_name", "version").orderBy("repo_id", "package_name")


def list_services(s: SparkSession, d: str) -> DataFrame:
    return L.service_list(load(s, d, "services"), ["rest", "graphql", "grpc"])


def ilike_symbols(s: SparkSession, d: str) -> DataFrame:
    return L.symbol_search(load(s, d, "code_symbols"), "token", 50)


def exported_first_sort(s: SparkSession, d: str) -> DataFrame:
    return L.symbol_search(load(s, d, "code_symbols"), "a_e", 80).select("id", "symbol_name", "scope")


def ilike_parts(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").where(F.col("p_name").ilike("%e%")).select("p_partkey", "p_name").orderBy(F.desc("p_partkey")).limit(100)


def suffix_match(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    return L.find_file(f, "package-lock.json").unionByName(L.find_file(f, f.where("file_path like '%/%'").orderBy("id").select("file_path").first()[0].rsplit("/", 1)[-1]))


def callers(s: SparkSession, d: str) -> DataFrame:
    return L.callers(load(s, d, "code_files"), "vault").unionByName(L.callers(load(s, d, "code_files"), "kiln"))


def import_types(s: SparkSession, d: str) -> DataFrame:
    i = L.parsed_imports(load(s, d, "code_files"), "id")
    return i.groupBy("import_type", T.is_internal_import(F.col("import_path")).alias("internal")).agg(F.count("*").alias("n"))


def cross_workspace_usage(s: SparkSession, d: str) -> DataFrame:
    return L.package_usage(load(s, d, "code_files"))


def workspace_usage_of_package(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    package = L.parsed_imports(f, "id").where("import_type = 'workspace'").agg(F.min("import_path")).first()[0]
    return L.usages_of_package(f, package)


def semi_join_chunks(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files").select("repo_path", "file_path").distinct()
    c = load(s, d, "code_chunks").where("chunk_type <> 'file_summary'")
    return c.join(f, ["repo_path", "file_path"], "left_semi").groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.sum(T.token_estimate(F.col("chunk_content"))).alias("tokens"))


def symbols_by_name(s: SparkSession, d: str) -> DataFrame:
    names = L.symbols_of_chunks(load(s, d, "code_chunks"))
    return L.resolve_symbols(load(s, d, "code_symbols"), names).select("symbol_name", "repo_path", "symbol_type").distinct()


def service_of_path(s: SparkSession, d: str) -> DataFrame:
    return L.path_prefix_service(load(s, d, "code_files"), load(s, d, "services")).groupBy("service_id").agg(F.count("*").alias("files"))


def service_call_counts(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("target")).join(load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source")), "l_orderkey")
    sup = load(s, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("target_nation"))
    cus = load(s, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("source_nation"))
    return L.call_counts(o.join(sup, "target").join(cus, "source"), "source_nation", "target_nation")


def event_json_counts(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).cast("bigint").alias("k_sum"), F.sum(F.when(F.col("props").rlike('"k": [0-4]'), 1).otherwise(0)).alias("low"))


def docs_list(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("fetched_at").alias("last_fetched"))
    return x.select("source", F.concat_ws(",", "kinds").alias("kinds"), "documents", "chars", "last_fetched")


def latest_files(s: SparkSession, d: str) -> DataFrame:
    return L.latest(load(s, d, "code_files"), ["repo_path", "file_path"], "indexed_at", "id").groupBy("repo_path").agg(F.count("*").alias("files"), F.sum("total_lines").alias("lines"))


def latest_orders(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    return o.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


def symbol_types(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "code_symbols")
    return x.groupBy("symbol_type", "scope").agg(F.count("*").alias("n"), F.sum(L.is_bound(F.col("workspace_id"), F.col("service_id")).cast("int")).cast("bigint").alias("bound"))


def null_type_filters(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "repositories")
    a = R.exclude_types(r, "repo_type", ["reference"]).agg(F.count("*").alias("n")).select(F.lit("not_all").alias("rule"), "n")
    return a.unionByName(R.exclude_types(r, "repo_type", ["reference"], keep_null=True).agg(F.count("*").alias("n")).select(F.lit("or_null").alias("rule"), "n"))


def signature_dedup(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "code_symbols").where("definition is not null").select(F.sha2(F.concat_ws("|", "symbol_name", F.split("definition", " - ")[0]), 256).alias("signature_hash"), "id")
    return x.groupBy("signature_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("copies > 1")


# --- graphs
def _nation_edges(s: SparkSession, d: str) -> DataFrame:
    """Sparse directed graph over nations: who buys from whom more than the average."""
    c = service_call_counts(s, d)
    avg = c.agg(F.avg("call_count")).first()[0]
    return c.where(F.col("call_count") > 1.15 * avg).select(F.col("source_nation").cast("bigint").alias("source"), F.col("target_nation").cast("bigint").alias("target"))


_EDGES = """calls AS (
  SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL
), edges AS (SELECT s::BIGINT AS source, t::BIGINT AS target FROM calls WHERE n > 1.15 * (SELECT avg(n) FROM calls))"""


def dep_bfs(s: SparkSession, d: str) -> DataFrame:
    starts = s.range(1).select(F.col("id").alias("node"))
    return G.bfs(_nation_edges(s, d), starts, 2).select("node", F.col("depth").cast("bigint").alias("depth"))


def dep_bfs_blocked(s: SparkSession, d: str) -> DataFrame:
    starts = s.range(2).select(F.col("id").alias("node"))
    blocked = load(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return G.bfs(_nation_edges(s, d), starts, 3, blocked).select("node", F.col("depth").cast("bigint").alias("depth"))


def boundary_scope_depth(s: SparkSession, d: str) -> DataFrame:
    reach = G.bfs(_nation_edges(s, d), s.range(1).select(F.col("id").alias("node")), 2)
    cust = load(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), "c_acctbal")
    return G.depth_scoped(cust, reach, "nation", [F.desc("c_acctbal"), F.col("c_custkey")], 100).select("c_custkey", "nation", F.col("dependency_depth").cast("bigint").alias("depth"))


def _import_edges(s: SparkSession, d: str) -> DataFrame:
    """Stored imports, and each file importing the next one of its repository by a relative path (hardly any stored import leads to a stored file)."""
    f = load(s, d, "code_files")
    names = f.where("file_path is not null").select("repo_path", "file_path").distinct()
    after = F.lead("file_path").over(Window.partitionBy("repo_path").orderBy("file_path"))
    up = F.repeat(F.lit("../"), F.size(F.split("file_path", "/")) - 1)
    siblings = names.withColumn("next", after).where("next is not null").select("repo_path", "file_path", F.concat(F.lit("./"), up, F.regexp_replace("next", r"\.[^./]*$", "")).alias("import_path"), F.lit(1).alias("import_line"))
    return G.normalised_imports(f, L.parsed_imports(f, "repo_path", "file_path").select(siblings.columns).unionByName(siblings))


def import_edges(s: SparkSession, d: str) -> DataFrame:
    return _import_edges(s, d).groupBy("repo_path").agg(F.count("*").alias("edges"))


def import_chain(s: SparkSession, d: str) -> DataFrame:
    # an arithmetic graph over parts: circles and several paths to one node
    p = load(s, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    n = p.count()
    e = p.select(F.col("k").alias("source"), F.explode(F.array(F.col("k") * 2 % n, (F.col("k") * 3 + 1) % n)).alias("target"))
    out = G.import_chain(e, p.where("k <= 10").select(F.col("k").alias("node")), 3)
    return out.select("from_file", "to_file", F.col("depth").cast("bigint").alias("depth"), "truncated")


def workspace_graph(s: SparkSession, d: str) -> DataFrame:
    """Stored dependencies, and each workspace depending on the next one of its repository (no stored one leads to a workspace)."""
    w = load(s, d, "workspaces")
    after = F.lead("package_name").over(Window.partitionBy("repo_id").orderBy("package_name", "workspace_id"))
    none = F.create_map().cast("map<string,string>")
    w = w.withColumn("next", after).withColumn("dependencies", F.to_json(F.map_concat(F.coalesce(F.from_json("dependencies", "map<string,string>"), none), F.when(F.col("next").isNotNull(), F.create_map("next", F.lit("workspace:*"))).otherwise(none))))
    return L.workspace_edges(w)


def components(s: SparkSession, d: str) -> DataFrame:
    """Chunks linked to the chunk before them in their file: a component is a file."""
    from sparkloom.operators.components import connected_components

    c = load(s, d, "code_chunks").where("repo_path is not null and file_path is not null").select("id", F.lag("id").over(Window.partitionBy("repo_path", "file_path").orderBy("id")).alias("before"))
    return connected_components(c.select(F.col("id").alias("u"), F.col("before").alias("v")))


# --- deduplication, priorities, assembly
def _candidates(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    return R.vector_topk(e, "vec_id", "embedding", _query(e, "vec_id", "embedding"), 60, keep=("embedding",))


def greedy_dedup(s: SparkSession, d: str) -> DataFrame:
    return A.greedy_dedup(_candidates(s, d), "vec_id", "embedding", "similarity", 0.3).select("vec_id", "duplicate_of")


_GREEDY = f"""WITH RECURSIVE t AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_sim("embeddings", "vec_id", "embedding")} AS sim FROM embeddings),
c AS (SELECT row_number() OVER (ORDER BY sim DESC, vec_id) AS r, vec_id, e FROM t WHERE sim IS NOT NULL ORDER BY sim DESC, vec_id LIMIT 60),
f AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id, NULL::BIGINT AS duplicate_of
  UNION ALL
  SELECT x.r, CASE WHEN x.dup IS NULL THEN list_append(x.kept, x.r) ELSE x.kept END, x.vec_id, x.dup FROM (
    SELECT c.r AS r, f.kept AS kept, c.vec_id AS vec_id,
      (SELECT k.vec_id FROM c k WHERE list_contains(f.kept, k.r) AND list_cosine_similarity(k.e, c.e) > 0.3 ORDER BY k.r LIMIT 1) AS dup
    FROM f JOIN c ON c.r = f.r + 1) x
)
SELECT vec_id, duplicate_of FROM f WHERE r > 0"""


def priority_rank(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    top = R.vector_topk(f, "id", "summary_embedding", _query(f, "id", "summary_embedding"), 60, keep=("repo_id",))
    return A.prioritise(top, load(s, d, "repositories"), "similarity").select("id", "bucket", F.round("weighted", 6).alias("weighted"))


def repo_bucket_caps(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    top = R.vector_topk(f, "id", "summary_embedding", _query(f, "id", "summary_embedding"), 60, keep=("repo_id",))
    return A.cap_buckets(A.prioritise(top, load(s, d, "repositories"), "similarity"), "id").select("id", "bucket")


def group_by_repo(s: SparkSession, d: str) -> DataFrame:
    return A.group_counts(load(s, d, "code_files"), load(s, d, "code_chunks"), "repo_id")


def context_tokens(s: SparkSession, d: str) -> DataFrame:
    c, y, f = (load(s, d, x) for x in ("code_chunks", "code_symbols", "code_files"))
    return A.context_tokens(c, y, L.parsed_imports(f, "id"), T.token_estimate(F.col("chunk_content")))


def search_warnings(s: SparkSession, d: str) -> DataFrame:
    f, c = load(s, d, "code_files"), load(s, d, "code_chunks")
    return A.search_warnings(f, c, T.token_estimate(F.col("chunk_content"))).select(F.col("ordinal").cast("bigint").alias("ordinal"), "type", "severity")


# --- incremental
def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = load(s, d, "documents").select("doc_id", "kind", F.sha2("text", 256).alias("file_hash"))
    # two states of one folder: reviews have come, issues have gone, guides have changed
    old = x.where("kind <> 'review'").withColumn("file_hash", F.when(F.col("kind") == "guide", F.sha2("file_hash", 256)).otherwise(F.col("file_hash")))
    return x.where("kind <> 'issue'").drop("kind"), old.drop("kind")


def change_detection(s: SparkSession, d: str) -> DataFrame:
    return I.detect_changes(*_versions(s, d), ["doc_id"], "file_hash")


def change_stats(s: SparkSession, d: str) -> DataFrame:
    return I.change_stats(change_detection(s, d)).select("new", "modified", "unchanged", "deleted", F.round("skip_rate", 6).alias("skip_rate"))


def upsert_rows(s: SparkSession, d: str) -> DataFrame:
    new, old = _versions(s, d)
    return I.upsert(old, new, ["doc_id"])


def insert_ignore_rows(s: SparkSession, d: str) -> DataFrame:
    new, old = _versions(s, d)
    return I.insert_ignore(old, new, ["doc_id"])


def delete_repository(s: SparkSession, d: str) -> DataFrame:
    return I.delete_repository({t: load(s, d, t) for t in ("code_files", "code_chunks", "code_symbols", "workspaces", "services")}, "hibjol-root")[1]


_NEW = "new AS (SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE kind <> 'issue'), old AS (SELECT doc_id, CASE WHEN kind = 'guide' THEN sha256(sha256(text)) ELSE sha256(text) END AS file_hash FROM documents WHERE kind <> 'review')"
_CHANGES = f"WITH {_NEW} SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN n.file_hash IS NOT DISTINCT FROM o.file_hash THEN 'unchanged' ELSE 'modified' END AS status FROM new n FULL OUTER JOIN old o USING (doc_id)"


# --- metrics
def precision_recall(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    q = _query(e, "vec_id", "embedding")
    want = e.orderBy("vec_id").select("label").first()[0]
    top = R.vector_topk(e, "vec_id", "embedding", q, 20, keep=("label",)).select(F.lit(0).cast("bigint").alias("query_id"), F.col("vec_id").alias("item"), "similarity")
    expected = e.where(F.col("label") == want).select(F.lit(0).cast("bigint").alias("query_id"), F.col("vec_id").alias("item"))
    return M.retrieval_quality(top, expected, "query_id", "item", "similarity").select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return M.floor_percentiles(load(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


QUERIES = {
    f.__name__: f
    for f in (
        repo_counts_distinct, list_workspaces, list_services, ilike_symbols, exported_first_sort, ilike_parts, suffix_match, callers, import_types, cross_workspace_usage, workspace_usage_of_package, semi_join_chunks,
        symbols_by_name, service_of_path, service_call_counts, event_json_counts, docs_list, latest_files, latest_orders, symbol_types, null_type_filters, signature_dedup, dep_bfs, dep_bfs_blocked, boundary_scope_depth,
        import_edges, import_chain, workspace_graph, components, greedy_dedup, priority_rank, repo_bucket_caps, group_by_repo, context_tokens, search_warnings, change_detection, change_stats, upsert_rows,
        insert_ignore_rows, delete_repository, precision_recall, latency_percentiles,
    )
}

_IMP = "imp AS (SELECT id, repo_path, file_path, workspace_id, package_name, unnest(from_json(json_extract(imports, '$.imports'), '[{\"path\":\"VARCHAR\",\"line\":\"INTEGER\",\"symbols\":[\"VARCHAR\"],\"type\":\"VARCHAR\"}]')) AS i FROM code_files WHERE imports IS NOT NULL AND json_valid(imports))"
_TOK = "ceil(length(chunk_content) / 4.0)::BIGINT"
_TOP = f"WITH t AS (SELECT id, repo_id, {_sim('code_files', 'id', 'summary_embedding')} AS sim FROM code_files), top AS (SELECT * FROM t WHERE sim IS NOT NULL ORDER BY sim DESC, id LIMIT 60), p AS (SELECT top.id AS id, CASE coalesce(repo_type, CASE WHEN top.repo_id IS NULL THEN 'none' ELSE 'monolithic' END) WHEN 'library' THEN 'libraries' WHEN 'reference' THEN 'references' WHEN 'documentation' THEN 'documentation' ELSE 'primary_code' END AS bucket, sim * CASE coalesce(repo_type, 'monolithic') WHEN 'library' THEN 0.9 WHEN 'reference' THEN 0.6 WHEN 'documentation' THEN 0.5 ELSE 1.0 END AS weighted FROM top LEFT JOIN repositories USING (repo_id))"

SQL = {
    "repo_counts_distinct": "SELECT r.repo_id AS repo_id, json_extract_string(r.metadata, '$.branch') AS branch, count(DISTINCT f.id) AS file_count, count(DISTINCT w.id) AS workspace_count, count(DISTINCT s.id) AS service_count FROM repositories r LEFT JOIN code_files f ON f.repo_id = r.repo_id LEFT JOIN workspaces w ON w.repo_id = r.repo_id LEFT JOIN services s ON s.repo_id = r.repo_id GROUP BY 1, 2",
    "list_workspaces": "SELECT repo_id, workspace_id, package_name, version FROM workspaces",
    "list_services": "SELECT service_id, service_name, repo_id, service_type FROM services WHERE service_type IN ('rest', 'graphql', 'grpc')",
    "ilike_symbols": "SELECT id, symbol_name, symbol_type, scope, file_path, line_number FROM code_symbols WHERE symbol_name ILIKE '%token%' ORDER BY CASE WHEN scope = 'exported' THEN 0 ELSE 1 END, symbol_name, id LIMIT 50",
    "exported_first_sort": "SELECT id, symbol_name, scope FROM code_symbols WHERE symbol_name ILIKE '%a_e%' ORDER BY CASE WHEN scope = 'exported' THEN 0 ELSE 1 END, symbol_name, id LIMIT 80",
    "ilike_parts": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%' ORDER BY p_partkey DESC LIMIT 100",
    "suffix_match": "WITH p AS (SELECT 'package-lock.json' AS p UNION ALL SELECT string_split((SELECT file_path FROM code_files WHERE file_path LIKE '%/%' ORDER BY id LIMIT 1), '/')[-1]) SELECT id, repo_path, file_path FROM p JOIN code_files f ON f.file_path = p OR f.file_path LIKE '%/' || p QUALIFY row_number() OVER (PARTITION BY p ORDER BY CASE WHEN f.file_path = p THEN 0 ELSE 1 END, length(f.file_path), f.file_path, id) = 1",
    "callers": f"WITH {_IMP} SELECT DISTINCT repo_path, file_path FROM imp WHERE i.path LIKE '%vault' UNION ALL SELECT DISTINCT repo_path, file_path FROM imp WHERE i.path LIKE '%kiln'",
    "import_types": f"WITH {_IMP} SELECT i.type AS import_type, CASE WHEN i.path LIKE 'node:%' OR i.path LIKE 'http://%' OR i.path LIKE 'https://%' THEN false ELSE i.path LIKE './%' OR i.path LIKE '../%' OR i.path LIKE '@%' END AS internal, count(*) AS n FROM imp GROUP BY ALL",
    "cross_workspace_usage": f"WITH {_IMP} SELECT i.path AS import_path, count(DISTINCT id) AS file_count, count(*) AS total_imports, sum(len(i.symbols))::BIGINT AS symbol_count FROM imp WHERE i.type = 'workspace' GROUP BY 1",
    "workspace_usage_of_package": f"WITH {_IMP} SELECT workspace_id, package_name, count(DISTINCT id) AS file_count, count(*) AS total_imports FROM imp WHERE i.path = (SELECT min(i.path) FROM imp WHERE i.type = 'workspace') GROUP BY ALL",
    "semi_join_chunks": f"SELECT chunk_type, count(*) AS chunks, sum({_TOK})::BIGINT AS tokens FROM code_chunks c WHERE chunk_type <> 'file_summary' AND EXISTS (SELECT 1 FROM code_files f WHERE f.repo_path = c.repo_path AND f.file_path = c.file_path) GROUP BY 1",
    "symbols_by_name": "WITH m AS (SELECT repo_path, unnest(list_concat(coalesce(from_json(json_extract(metadata, '$.function_names'), '[\"VARCHAR\"]'), []), coalesce(from_json(json_extract(metadata, '$.class_names'), '[\"VARCHAR\"]'), []))) AS n FROM code_chunks WHERE json_valid(metadata)) SELECT DISTINCT symbol_name, s.repo_path AS repo_path, symbol_type FROM code_symbols s WHERE scope = 'exported' AND EXISTS (SELECT 1 FROM m WHERE m.repo_path = s.repo_path AND trim(n) = symbol_name)",
    "service_of_path": "WITH h AS (SELECT f.id, s.service_id, row_number() OVER (PARTITION BY f.id ORDER BY length(s.service_path) DESC, s.service_id DESC) AS r FROM code_files f JOIN services s ON s.repo_id = f.repo_id AND starts_with(f.file_path, rtrim(s.service_path, '/') || '/')) SELECT service_id, count(*) AS files FROM h WHERE r = 1 GROUP BY 1",
    "service_call_counts": "SELECT c_nationkey AS source_nation, s_nationkey AS target_nation, count(*) AS call_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
    "event_json_counts": "SELECT event_type, count(*) AS events, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS k_sum, sum(CASE WHEN regexp_matches(props, '\"k\": [0-4]') THEN 1 ELSE 0 END)::BIGINT AS low FROM events GROUP BY 1",
    "docs_list": "SELECT source, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(fetched_at) AS last_fetched FROM documents GROUP BY 1",
    "latest_files": "WITH l AS (SELECT * FROM code_files QUALIFY row_number() OVER (PARTITION BY repo_path, file_path ORDER BY indexed_at DESC NULLS LAST, id DESC) = 1) SELECT repo_path, count(*) AS files, sum(total_lines)::BIGINT AS lines FROM l GROUP BY 1",
    "latest_orders": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "symbol_types": "SELECT symbol_type, scope, count(*) AS n, sum(CASE WHEN workspace_id IS NOT NULL OR service_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS bound FROM code_symbols GROUP BY ALL",
    "null_type_filters": "SELECT 'not_all' AS rule, count(*) AS n FROM repositories WHERE repo_type <> ALL (['reference']) UNION ALL SELECT 'or_null', count(*) FROM repositories WHERE repo_type NOT IN ('reference') OR repo_type IS NULL",
    "signature_dedup": "SELECT sha256(concat_ws('|', symbol_name, string_split(definition, ' - ')[1])) AS signature_hash, min(id) AS id, count(*) AS copies FROM code_symbols WHERE definition IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dep_bfs": f"WITH RECURSIVE {_EDGES}, w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS depth UNION SELECT target, depth + 1 FROM w JOIN edges ON source = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY 1",
    "dep_bfs_blocked": f"WITH RECURSIVE {_EDGES}, w AS (SELECT unnest([0, 1])::BIGINT AS node, 0::BIGINT AS depth UNION SELECT target, depth + 1 FROM w JOIN edges ON source = node WHERE depth < 3 AND target NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) SELECT node, min(depth) AS depth FROM w GROUP BY 1",
    "boundary_scope_depth": f"WITH RECURSIVE {_EDGES}, w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS depth UNION SELECT target, depth + 1 FROM w JOIN edges ON source = node WHERE depth < 2), r AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT c_custkey, node AS nation, depth FROM customer JOIN r ON node = c_nationkey ORDER BY depth, c_acctbal DESC, c_custkey LIMIT 100",
    "import_chain": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT DISTINCT p_partkey AS source, unnest([p_partkey * 2 % n, (p_partkey * 3 + 1) % n]) AS target FROM part, n), w AS (SELECT p_partkey AS node, 0::BIGINT AS depth FROM part WHERE p_partkey <= 10 UNION SELECT target, depth + 1 FROM w JOIN e ON source = node WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT source AS from_file, target AS to_file, a.depth + 1 AS depth, b.depth <= a.depth AS truncated FROM m a JOIN e ON source = a.node JOIN m b ON b.node = target WHERE a.depth < 3",
    "workspace_graph": "WITH d AS (SELECT repo_id, workspace_id AS source, unnest(map_entries(from_json(dependencies, '\"MAP(VARCHAR, VARCHAR)\"')::MAP(VARCHAR, VARCHAR))) AS e FROM workspaces WHERE dependencies IS NOT NULL AND json_valid(dependencies)) SELECT d.repo_id AS repo_id, source, w.workspace_id AS target, e.value AS version_specifier FROM d JOIN workspaces w ON w.repo_id = d.repo_id AND w.package_name = e.key UNION ALL SELECT n.repo_id, n.workspace_id, w.workspace_id, 'workspace:*' FROM (SELECT repo_id, workspace_id, lead(package_name) OVER (PARTITION BY repo_id ORDER BY package_name, workspace_id) AS nxt FROM workspaces) n JOIN workspaces w ON w.repo_id = n.repo_id AND w.package_name = n.nxt",
    "components": "SELECT id AS node, first AS component FROM (SELECT id, min(id) OVER (PARTITION BY repo_path, file_path) AS first, count(*) OVER (PARTITION BY repo_path, file_path) AS n FROM code_chunks WHERE repo_path IS NOT NULL AND file_path IS NOT NULL) WHERE n > 1",
    "import_edges": "WITH f AS (SELECT DISTINCT repo_path, file_path, file_path AS x FROM code_files WHERE file_path IS NOT NULL), n AS (SELECT repo_path, file_path, lead(file_path) OVER (PARTITION BY repo_path ORDER BY file_path) AS nxt FROM f), b AS (SELECT repo_path, file_path, regexp_replace(nxt, '\\.[^./]*$', '') AS base FROM n WHERE nxt IS NOT NULL), t AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.py', '.go', '.java', '.rs', '.rb', '.php', '.mjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/__init__.py']) AS ext), h AS (SELECT DISTINCT b.repo_path, b.file_path FROM b, t WHERE EXISTS (SELECT 1 FROM f WHERE f.repo_path = b.repo_path AND f.file_path = b.base || t.ext)) SELECT repo_path, count(*) AS edges FROM h GROUP BY 1",
    "greedy_dedup": _GREEDY,
    "priority_rank": _TOP + " SELECT id, bucket, round(weighted, 6) AS weighted FROM p",
    "repo_bucket_caps": _TOP + " SELECT id, bucket FROM p QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY weighted DESC, id) <= CASE bucket WHEN 'references' THEN 5 WHEN 'documentation' THEN 3 ELSE 2147483647 END",
    "group_by_repo": "WITH a AS (SELECT repo_id, count(*) AS file_count FROM code_files WHERE repo_id IS NOT NULL GROUP BY 1), b AS (SELECT repo_id, count(*) AS chunk_count FROM code_chunks WHERE repo_id IS NOT NULL GROUP BY 1) SELECT repo_id, coalesce(file_count, 0) AS file_count, coalesce(chunk_count, 0) AS chunk_count FROM a FULL OUTER JOIN b USING (repo_id)",
    "context_tokens": f"WITH {_IMP} SELECT (SELECT coalesce(sum({_TOK}), 0) FROM code_chunks)::BIGINT + 50 * (SELECT count(*) FROM code_symbols) + 30 * (SELECT count(*) FROM imp) AS total_tokens",
    "search_warnings": f"WITH c AS (SELECT sum({_TOK}) AS tokens, count(*) AS chunks, count(DISTINCT workspace_id) AS ws, count(DISTINCT service_id) AS svc, (SELECT count(*) FROM code_files) AS files FROM code_chunks), w AS (SELECT 0::BIGINT AS ordinal, 'context_size' AS type, 'warning' AS severity, tokens > 100000 AS hit FROM c UNION ALL SELECT 1, 'no_files', 'warning', files = 0 FROM c UNION ALL SELECT 2, 'no_chunks', 'warning', files > 0 AND chunks = 0 FROM c UNION ALL SELECT 3, 'cross_workspace', 'info', ws > 1 FROM c UNION ALL SELECT 4, 'cross_service', 'warning', svc > 1 FROM c) SELECT ordinal, type, severity FROM w WHERE hit",
    "change_detection": _CHANGES,
    "change_stats": f"WITH c AS ({_CHANGES}), n AS (SELECT count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM c) SELECT new, modified, unchanged, deleted, round(unchanged * 100.0 / (new + modified + unchanged), 6) AS skip_rate FROM n",
    "upsert_rows": f"WITH {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)",
    "insert_ignore_rows": f"WITH {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)",
    "delete_repository": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS deleted FROM {t} WHERE repo_id = 'hibjol-root'" for t in ("code_files", "code_chunks", "code_symbols", "workspaces", "services")),
    "precision_recall": f"WITH t AS (SELECT vec_id, label, {_sim('embeddings', 'vec_id', 'embedding')} AS sim FROM embeddings), x AS (SELECT vec_id, label, row_number() OVER (ORDER BY sim DESC, vec_id) AS r FROM t WHERE sim IS NOT NULL ORDER BY sim DESC, vec_id LIMIT 20), l AS (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT r FROM x WHERE label = (SELECT label FROM l)) SELECT 0::BIGINT AS query_id, round((SELECT count(*) FROM h) / (SELECT count(*) FROM x), 6) AS precision, round((SELECT count(*) FROM h) / (SELECT count(*) FROM embeddings WHERE label = (SELECT label FROM l)), 6) AS recall, round(coalesce(1.0 / (SELECT min(r) FROM h), 0), 6) AS reciprocal_rank",
    "latency_percentiles": "WITH t AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM t",
}
