"""Context assembly, boundaries, documentation, detection, maintenance and scalar texts, with their SQL twins.

Endpoints stand for service interfaces and are made of the symbols that belong to a service. Hardly any stored import leads to a stored file, so file links are made of imports whose last part is
another file's stem, and of each file's neighbours in the order of its repository's paths: one and three on, two back, with circles and several ways to a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import api
from sparkloom.functions import text as T
from sparkloom.operators import context as C
from sparkloom.operators import contracts as K
from sparkloom.operators import decompose as D
from sparkloom.operators import detect
from sparkloom.operators import documentation as Doc
from sparkloom.operators import graph as G
from sparkloom.operators import incremental as I
from sparkloom.operators import lookups as L
from sparkloom.operators import metrics as M
from sparkloom.operators import retrieval as R
from sparkloom.plans.retrieval_queries import _query, _sim
from sparkloom.runtime import endpoint_violation
from sparkloom.session import load, materialise


def _parts(s: SparkSession, d: str) -> dict[str, DataFrame]:
    files = load(s, d, "code_files")
    return {"files": files, "chunks": load(s, d, "code_chunks"), "symbols": load(s, d, "code_symbols"), "imports": L.parsed_imports(files, "id", "file_path", "workspace_id", "service_id")}


_IDS = {"files": "id", "chunks": "id", "symbols": "id", "imports": "import_path"}


def _endpoints(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_symbols").where("service_id is not null").select("id", "service_id", F.when(F.col("symbol_type") == "method", "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "symbol_name").alias("path"), F.col("id").alias("implementation_chunk_id"), F.col("definition").alias("description"))


# --- groups and metadata
def group_by_workspace(s: SparkSession, d: str) -> DataFrame:
    return C.group_summary(C.group_rows(_parts(s, d), "workspace_id", _IDS))


def group_by_service(s: SparkSession, d: str) -> DataFrame:
    return C.group_summary(C.group_rows(_parts(s, d), "service_id", _IDS))


def group_by_repository(s: SparkSession, d: str) -> DataFrame:
    return C.group_summary(C.group_rows_by_repository(_parts(s, d), _IDS))


def grouped_context(s: SparkSession, d: str) -> DataFrame:
    groups = C.auto_groups(_parts(s, d), _IDS, by=["workspace", "service"])
    out = [g.groupBy("part").agg(F.count("*").alias("members"), F.count_distinct("group_id").alias("group_count")).select(F.lit(k).alias("grouping"), "part", "members", "group_count") for k, g in groups.items()]
    return out[0].unionByName(out[1])


def search_metadata(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    kept = p["chunks"].dropDuplicates(["repo_path", "file_path", "chunk_type", "chunk_content"])
    tokens = T.token_estimate(F.col("chunk_content"))
    out = C.search_metadata(p["files"], p["chunks"], kept, p["symbols"], p["imports"].withColumn("depth", F.lit(1)), _endpoints(s, d), tokens)
    return out.where("metric not in ('workspaces_searched', 'services_searched', 'repos_searched', 'chunk_tokens', 'total_tokens')")


def import_counts(s: SparkSession, d: str) -> DataFrame:
    return C.part_counts(_parts(s, d)["imports"], "import_type")


def chunks_by_file(s: SparkSession, d: str) -> DataFrame:
    return C.part_counts(load(s, d, "code_chunks"), "repo_path", "file_path")


def display_forms(s: SparkSession, d: str) -> DataFrame:
    return C.display_rows(load(s, d, "code_files").select("id", "total_lines"), [F.desc_nulls_last("total_lines"), F.col("id")], 5, 15)


def overhead_tokens(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_chunks").select("id", C.with_overhead(T.token_estimate(F.col("chunk_content"))).alias("tokens"))


# --- endpoints
def service_ids(s: SparkSession, d: str) -> DataFrame:
    return C.service_ids(load(s, d, "code_files"), load(s, d, "code_chunks"))


def endpoints_by_service(s: SparkSession, d: str) -> DataFrame:
    return C.endpoints_by_service(_endpoints(s, d), load(s, d, "services")).select("service_id", "ordinal", "id", "path")


def endpoints_by_chunk(s: SparkSession, d: str) -> DataFrame:
    return C.endpoints_by_chunk(_endpoints(s, d), load(s, d, "code_chunks"))


def implementation_match(s: SparkSession, d: str) -> DataFrame:
    return C.implemented_in(_endpoints(s, d), load(s, d, "code_chunks").where("service_id is not null")).select("id", "service_id", "path")


def enriched_endpoints(s: SparkSession, d: str) -> DataFrame:
    e = C.enrich(load(s, d, "code_files"), load(s, d, "code_chunks"), _endpoints(s, d))
    return e["endpoints"].join(e["unlinked"].select("id", F.lit(True).alias("unlinked")), "id", "left").groupBy("service_id").agg(F.count("*").alias("endpoints"), F.count("unlinked").alias("unlinked"))


def repository_filter(s: SparkSession, d: str) -> DataFrame:
    kept = C.restrict_to_repositories(_parts(s, d), [r.repo_id for r in load(s, d, "repositories").where("repo_type = 'library'").select("repo_id").orderBy("repo_id").collect()])
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in kept.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def endpoint_checks(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "services").select("service_id", "service_type").join(_endpoints(s, d).select("service_id", "method").distinct(), "service_id", "left")
    return e.select("service_id", "method", endpoint_violation(F.col("service_type"), F.col("method")).alias("violation"))


def endpoint_methods(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "code_symbols")
    return x.select("id", T.method_of(F.when(F.col("symbol_type") == "method", "POST"), F.when(F.col("scope") == "exported", F.col("symbol_name"))).alias("method"), F.coalesce("definition", "symbol_name").alias("description"))


def endpoint_service_names(s: SparkSession, d: str) -> DataFrame:
    names = load(s, d, "services").groupBy("service_id").agg(F.min("service_name").alias("service_name"))
    return _endpoints(s, d).join(names, "service_id", "left").groupBy("service_id", "service_name").agg(F.count("*").alias("endpoints"))


def call_usage(s: SparkSession, d: str) -> DataFrame:
    calls = L.parsed_imports(load(s, d, "code_files"), "service_id").select(F.col("service_id").alias("source_service"), F.col("import_type").alias("target_service"), F.col("import_path").alias("target_endpoint"))
    return C.call_usage(calls)


def target_services(s: SparkSession, d: str) -> DataFrame:
    e = _endpoints(s, d).join(load(s, d, "services").select("service_id", F.col("id").alias("ordinal")), "service_id").select("service_id", "ordinal", "path")
    calls = load(s, d, "code_symbols").where("service_id is null").select(F.concat(F.lit("/"), "symbol_name").alias("path")).distinct().withColumn("call_id", F.col("path"))
    return C.target_services(calls, e).select("path", "target_service")


def first_elements(s: SparkSession, d: str) -> DataFrame:
    i = F.from_json("imports", L.IMPORTS)["imports"]
    return load(s, d, "code_files").select("id", F.to_json(F.get(i, F.lit(0))["symbols"]).alias("first_symbols"), F.get(i, F.lit(0))["path"].alias("first_path")).where("first_path is not null")


# --- contracts, aliases, boundaries
def _calls(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "code_symbols").where("symbol_name is not null")
    return x.select(F.col("id").alias("call_id"), F.when(F.col("symbol_type") == "method", "post").alias("method"), F.concat(F.lit("https://api.example/"), "symbol_name", F.lit("?page=2")).alias("target"))


def matched_calls(s: SparkSession, d: str) -> DataFrame:
    return K.match_calls(_calls(s, d), _endpoints(s, d)).select("call_id", "endpoint_id", "service_id")


def implementation_links(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks").select("id", "repo_id", "file_path", F.col("chunk_content").alias("content"))
    e = load(s, d, "code_symbols").where("service_id is not null").select("id", "repo_id", F.lit("GET").alias("method"), F.concat(F.lit("/"), "symbol_name").alias("path"), F.col("symbol_name").alias("operation_id"))
    return K.link_implementations(e, c).groupBy("strategy").agg(F.count("*").alias("n"))


def contract_warnings(s: SparkSession, d: str) -> DataFrame:
    e = _endpoints(s, d).withColumn("deprecated", F.col("method") == "POST")
    links = C.endpoints_by_chunk(e, load(s, d, "code_chunks"))
    return K.contract_warnings(K.match_calls(_calls(s, d), e), e, links)


def contract_links(s: SparkSession, d: str) -> DataFrame:
    e = _endpoints(s, d)
    return K.contract_links(e, C.endpoints_by_chunk(e, load(s, d, "code_chunks")), load(s, d, "services"))


def resolved_aliases(s: SparkSession, d: str) -> DataFrame:
    i = L.parsed_imports(load(s, d, "code_files").where("repo_id is not null"), "repo_id").select("repo_id", "import_path")
    rules = s.createDataFrame([("/*", "src/*", 0), ("@*", "packages/*", 1), ("../*", "up/*", 2)], "alias_pattern string, resolved_path string, ordinal int")
    aliases = F.broadcast(rules.withColumn("one", F.lit(1)))  # three rows
    a = load(s, d, "repositories").select("repo_id", F.lit(1).alias("one")).join(aliases, "one").drop("one")
    return K.resolve_aliases(i, a).groupBy("import_path", "resolved_path").agg(F.count("*").alias("n"))


def imported_packages(s: SparkSession, d: str) -> DataFrame:
    return L.parsed_imports(load(s, d, "code_files"), "id").where("import_type = 'workspace' or import_type = 'external'").groupBy(K.package_of_import(F.col("import_path")).alias("package")).agg(F.count("*").alias("n"))


def boundary_edges(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files").where("file_path is not null and repo_path is not null")
    after = F.lead("file_path").over(Window.partitionBy("repo_path").orderBy("file_path"))
    e = f.select("repo_path", "file_path").distinct().select("repo_path", F.col("file_path").alias("source"), after.alias("target")).where("target is not null")
    one = f.groupBy("repo_path", "file_path").agg(F.min("workspace_id").alias("workspace_id"), F.min("service_id").alias("service_id"))
    return K.within_boundary(e, one, same_service=True).groupBy("crosses_workspace", "crosses_service").agg(F.count("*").alias("n"))


def merged_metadata(s: SparkSession, d: str) -> DataFrame:
    m = K.merge_metadata(F.col("metadata"), F.lit('{"version": "2", "last_indexed": "now"}'))
    return load(s, d, "repositories").select("repo_id", F.get_json_object(m, "$.version").alias("version"), F.get_json_object(m, "$.branch").alias("branch"))


def reindex_decisions(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "repositories").withColumn("last_version", F.try_variant_get(F.try_parse_json("metadata"), "$.branch", "string"))
    return I.reindex_decision(r, "main").select("repo_id", "decision")


def stale_removed(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files")
    state = f.groupBy("repo_path", "file_path").agg(F.min("language").alias("language")).select("repo_path", "file_path", F.when(F.col("language") == "go", "modified").when(F.col("language") == "rust", "deleted").otherwise("unchanged").alias("status"))
    (chunks, symbols), todo = I.apply_changes(state, load(s, d, "code_chunks"), load(s, d, "code_symbols"), keys=("repo_path", "file_path"))
    return _counted({"code_chunks": chunks, "code_symbols": symbols, "to_index": todo})


def contract_search(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "code_symbols")
    e = x.where("service_id is not null").select("id", "service_id", "embedding", F.lit("GET").alias("method"), F.col("symbol_name").alias("path"), (F.col("scope") == "internal").alias("deprecated"))
    return api.search_api_contracts(e, "q", 25, 0.05, embed=lambda _: _query(x, "id", "embedding")).select("id", "service_id", F.round("similarity", 6).alias("similarity"))


# --- dedup
def _top_chunks(s: SparkSession, d: str, n: int = 60) -> DataFrame:
    c = load(s, d, "code_chunks")
    return R.vector_topk(c, "id", "embedding", _query(c, "id", "embedding"), n, keep=("repo_id", "file_path", "embedding"))


def cross_repo_dedup(s: SparkSession, d: str) -> DataFrame:
    top = materialise(_top_chunks(s, d), "top").withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))  # at most 60 rows
    return C.cross_repository_dedup(top, load(s, d, "repositories"), "id", "embedding", "ordinal", 0.6)


# --- documentation
def _docs(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks")
    return c.select(F.col("id").alias("chunk_id"), F.col("repo_id").alias("doc_id"), "file_path", F.when(F.col("chunk_type").isin("function", "class"), "code_block").otherwise("section").alias("chunk_type"), F.array_compact(F.array("language", F.col("chunk_type"))).alias("tags"), "embedding", "indexed_at")


def documentation_search(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return Doc.documentation_search(docs, _query(docs, "chunk_id", "embedding"), 25, 0.1, tags=["go", "python", "class"], code_blocks=False).select("chunk_id", "doc_id", "chunk_type", F.round("similarity", 6).alias("similarity"))


def _doc_files(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents")
    return x.where("repo_id is not null").select(F.col("repo_id").alias("doc_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.array_compact(F.array("kind", "lang")).alias("tags"), F.lit(2).alias("section_count"), F.lit(1).alias("code_block_count"), F.col("fetched_at").alias("indexed_at"))


def documentation_list(s: SparkSession, d: str) -> DataFrame:
    return Doc.document_list(_doc_files(s, d)).select("doc_id", F.size("file_paths").cast("bigint").alias("files"), F.array_join("tags", ",").alias("tags"), "section_count", "code_block_count", "indexed_at")


def documentation_list_fan_out(s: SparkSession, d: str) -> DataFrame:
    return Doc.document_list(_doc_files(s, d), fan_out=True).select("doc_id", F.size("file_paths").cast("bigint").alias("files"), "section_count", "code_block_count")


def documentation_removed(s: SparkSession, d: str) -> DataFrame:
    first = [r.repo_id for r in load(s, d, "repositories").where("repo_type = 'documentation'").select("repo_id").orderBy("repo_id").collect()]
    return Doc.remove_documents({"documentation_files": _doc_files(s, d), "documentation_chunks": _docs(s, d)}, first)[1]


# --- graphs
def _links(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files").where("file_path is not null")
    i = L.parsed_imports(f, "file_path").select(F.col("file_path").alias("source"), F.regexp_extract("import_path", r"([^/.]+)$", 1).alias("stem"))
    t = f.select(F.col("file_path").alias("target"), F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]+$", "").alias("stem")).distinct()
    w = Window.partitionBy("repo_path").orderBy("file_path")
    near = f.where("repo_path is not null").select("repo_path", "file_path").distinct()
    near = near.withColumn("t", F.array(F.lead("file_path", 1).over(w), F.lead("file_path", 3).over(w), F.lag("file_path", 2).over(w))).select(F.col("file_path").alias("source"), F.explode(F.array_compact("t")).alias("target"))
    return i.join(t, "stem").select("source", "target").unionByName(near).where("source <> target").distinct()


def file_links(s: SparkSession, d: str) -> DataFrame:
    return _links(s, d)


def _linked_start(links: DataFrame) -> DataFrame:
    return links.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10).select(F.col("source").alias("node"))


def file_chain(s: SparkSession, d: str) -> DataFrame:
    links = materialise(_links(s, d), "links")
    return G.import_chain(links, _linked_start(links)).groupBy("depth", "truncated").agg(F.count("*").alias("n"))


def boundary_chain(s: SparkSession, d: str) -> DataFrame:
    links = materialise(_links(s, d), "links")
    return G.boundary_chain(links, load(s, d, "code_files"), _linked_start(links)).groupBy("depth", "circular", "truncated", "reason", "cross_workspace", "cross_service").agg(F.count("*").alias("n"))


def file_context(s: SparkSession, d: str) -> DataFrame:
    links = materialise(_links(s, d), "links")
    return G.file_context_chain(links, load(s, d, "code_files"), _linked_start(links).orderBy("node").first()[0], 3).select("file_path", "depth")


def scope_walk(s: SparkSession, d: str) -> DataFrame:
    links = materialise(_links(s, d), "links")
    return G.expand_scope(links, _linked_start(links), 1)


def import_paths(s: SparkSession, d: str) -> DataFrame:
    links = materialise(_links(s, d), "links")
    return G.paths_without_cycles(links, _linked_start(links), 3).groupBy("depth", "cyclic").agg(F.count("*").alias("n"))


def workspace_dependents(s: SparkSession, d: str) -> DataFrame:
    w = load(s, d, "workspaces")
    deps = w.select("repo_id", F.col("workspace_id").alias("source"), F.explode(F.from_json("dependencies", "map<string,string>")).alias("package_name", "version"))
    return deps.groupBy("package_name").agg(F.count_distinct("source").alias("dependents"))


def dependency_contracts(s: SparkSession, d: str) -> DataFrame:
    v = load(s, d, "services")
    used = L.parsed_imports(load(s, d, "code_files"), "repo_id").where("import_type = 'workspace'").select("repo_id", F.col("import_path").alias("package_name")).distinct()
    return used.join(v.select("repo_id", "service_id", "service_type"), "repo_id").select("repo_id", "package_name", "service_id", "service_type")


def files_with_config(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "repositories").select("repo_id", "workspace_config")
    return load(s, d, "code_files").select("id", "repo_id").join(F.broadcast(r), "repo_id", "left").groupBy("repo_id", "workspace_config").agg(F.count("*").alias("files"))  # the registry is one row a repository


# --- detection
def _tree(s: SparkSession, d: str) -> DataFrame:
    w, r = load(s, d, "workspaces"), load(s, d, "repositories")
    packages = w.select("repo_id", F.concat("workspace_path", F.lit("/package.json")).alias("file_path"), F.to_json(F.struct(F.col("package_name").alias("name"), "version", F.from_json("dependencies", "map<string,string>").alias("dependencies"))).alias("content"))
    root = r.where("size(workspace_patterns) > 0").select("repo_id", F.lit("package.json").alias("file_path"), F.to_json(F.struct(F.lit("root").alias("name"), F.col("workspace_patterns").alias("workspaces"))).alias("content"))
    return packages.unionByName(root)


def detected_workspaces(s: SparkSession, d: str) -> DataFrame:
    return detect.workspaces(_tree(s, d)).select("repo_id", "tool", "workspace_path", "package_name", "version")


def detected_dependencies(s: SparkSession, d: str) -> DataFrame:
    return detect.workspace_dependencies(detect.workspaces(_tree(s, d))).select("repo_id", "source", "target", "kind")


def detected_services(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "code_files").select("repo_id", "file_path", F.lit("").alias("content"))
    return detect.services(f).select("repo_id", "service_name", "service_path", "service_type")


# --- maintenance
def stored_tables(s: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("repositories", "code_files", "code_chunks", "code_symbols", "workspaces", "services"):
        df = load(s, d, t)
        one = I.store(t, df, df).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def cleared_repository(s: SparkSession, d: str) -> DataFrame:
    tables = {t: load(s, d, t) for t in ("code_files", "code_chunks", "code_symbols", "workspaces", "services")}
    tables["cross_repo_dependencies"] = load(s, d, "code_files").select(F.col("repo_id").alias("source_repo_id"), F.col("package_name").alias("target_repo_id"))
    which = load(s, d, "repositories").agg(F.min("repo_id")).first()[0]
    return _counted(I.clear_repository(tables, which))


def deleted_path(s: SparkSession, d: str) -> DataFrame:
    which = load(s, d, "repositories").agg(F.min("repo_path")).first()[0]
    return _counted(I.delete_by_path({t: load(s, d, t) for t in ("code_files", "code_chunks", "code_symbols")}, which))


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for t, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def repository_five_counts(s: SparkSession, d: str) -> DataFrame:
    out = load(s, d, "repositories").select("repo_id")
    for t, name in (("code_files", "files"), ("code_chunks", "chunks"), ("code_symbols", "symbols"), ("workspaces", "workspaces"), ("services", "services")):
        out = out.join(load(s, d, t).groupBy("repo_id").agg(F.count("*").alias(name)), "repo_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def partitioned_topk(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks").where("language is not null")
    lists = materialise(c.select("id", "embedding", "language"), "by-language", by="language")
    return R.vector_topk(lists.where("language = 'go'"), "id", "embedding", _query(c, "id", "embedding"), 20).select("id", F.round("similarity", 6).alias("similarity"))


# --- metrics
def stage_statistics(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), F.lit(1.0).alias("memory_mb"), F.lit(2.0).alias("throughput"))
    return M.stage_statistics(e).select("stage", "operations", "min_ms", "max_ms", "p50", "p90", "p95", "p99", "bottleneck")


def mean_quality(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "lineitem")
    results = x.select(F.col("l_orderkey").alias("query_id"), F.lit("all").alias("category"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("item"))
    out = M.mean_quality(results, x.where("l_quantity > 25").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item")), 5)
    return out.select("category", "queries", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "mrr", "noise", "mean_rank")])


# --- scalar texts
def indexing_strategies(s: SparkSession, d: str) -> DataFrame:
    p, n = F.col("file_path"), F.col("total_lines")
    st = T.indexing_strategy(p.rlike(r"\.(png|zip|pdf)$"), p.rlike(r"\.min\.js$|lock"), F.lit(False), n)
    return load(s, d, "code_files").where("total_lines is not null").select("id", st.alias("s")).select("id", "s.category", "s.file_type", "s.should_index", "s.structure_only", "s.reason")


def structure_summaries(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_chunks").where("language is not null").select("id", T.structure_summary(F.col("chunk_content"), F.col("language")).alias("summary"))


def docstring_heads(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_chunks").select("id", T.docstring_head(F.col("chunk_content"), F.col("language")).alias("doc"))


def embedding_texts(s: SparkSession, d: str) -> DataFrame:
    n = F.array_sort(F.array_distinct(F.split("symbol_name", "_")))
    return load(s, d, "code_symbols").select("id", T.embedding_text(F.col("scope"), F.col("definition"), n).alias("text"))


def definition_texts(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return load(s, d, "code_symbols").select("id", T.definition_text(c("symbol_type"), c("symbol_name"), F.lit("a: b"), F.lit(None).cast("string"), F.lit(""), c("definition"), F.coalesce("definition", F.lit(""))).alias("text"))


def endpoint_texts(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _endpoints(s, d).select("id", T.endpoint_text(c("method"), c("path"), c("description"), c("service_id"), F.array(c("method")), c("path"), c("service_id")).alias("text"))


def doc_embedding_texts(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", F.sha2(T.doc_embedding_text(F.when(F.col("kind") == "guide", "section").otherwise("code_block"), F.col("source"), F.col("text"), F.col("lang")), 256).alias("text_hash"))


def call_confidences(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "repositories").select(F.col("git_remote_url").alias("target"))
    i = L.parsed_imports(load(s, d, "code_files"), "id").select(F.col("import_path").alias("target"))
    p = load(s, d, "repositories").select(F.col("repo_path").alias("target"))
    return r.unionByName(i).unionByName(p).groupBy(T.call_confidence(F.col("target")).alias("confidence")).agg(F.count("*").alias("n"))


def line_ranges(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "code_chunks").select("id", T.line_range(F.col("start_line"), F.col("end_line")).alias("lines"))


def node_symbols(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks").where("chunk_content is not null").select("id", "chunk_content", T.language(F.col("file_path")).alias("lang"))
    return D.symbols_of_nodes(D.file_nodes(c, "id", "chunk_content", "lang")).groupBy("symbol_type", "scope").agg(F.count("*").alias("n"))


def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "code_chunks").where("chunk_content is not null").select("id", "chunk_content", T.language(F.col("file_path")).alias("lang"))
    m = D.chunk_metadata(c, D.file_nodes(c, "id", "chunk_content", "lang"), D.file_imports(c, "id", "chunk_content", "lang"), "id", "chunk_content")
    return m.select(F.col("key").alias("id"), "complexity", "has_async", "has_loops", "has_conditionals", F.size("function_names").alias("functions"), F.size("class_names").alias("classes"), F.size("imports").alias("imports"))


QUERIES = {
    f.__name__: f
    for f in (
        group_by_workspace, group_by_service, group_by_repository, grouped_context, search_metadata, import_counts, chunks_by_file, display_forms, overhead_tokens, service_ids, endpoints_by_service, endpoints_by_chunk, implementation_match, enriched_endpoints, repository_filter, endpoint_checks, endpoint_methods,
        endpoint_service_names, call_usage, target_services, first_elements, cross_repo_dedup, documentation_search, documentation_list, documentation_list_fan_out, documentation_removed, file_links, file_chain, boundary_chain, file_context, scope_walk, import_paths, workspace_dependents, dependency_contracts,
        files_with_config, detected_workspaces, detected_dependencies, detected_services, stored_tables, cleared_repository, deleted_path, repository_five_counts, partitioned_topk, stage_statistics, mean_quality, indexing_strategies, structure_summaries, docstring_heads, embedding_texts, definition_texts,
        endpoint_texts, doc_embedding_texts, call_confidences, line_ranges, node_symbols, chunk_metadata, matched_calls, implementation_links, contract_warnings, contract_links, resolved_aliases, imported_packages, boundary_edges, merged_metadata, reindex_decisions, stale_removed, contract_search,
    )
}

_I = "imp AS (SELECT id, repo_path, file_path, workspace_id, service_id, unnest(from_json(json_extract(imports, '$.imports'), '[{\"path\":\"VARCHAR\",\"line\":\"INTEGER\",\"symbols\":[\"VARCHAR\"],\"type\":\"VARCHAR\"}]')) AS i FROM code_files WHERE imports IS NOT NULL AND json_valid(imports))"
_E = "e AS (SELECT id, service_id, CASE WHEN symbol_type = 'method' THEN 'POST' ELSE 'GET' END AS method, '/' || symbol_name AS path, id AS implementation_chunk_id, definition AS description FROM code_symbols WHERE service_id IS NOT NULL)"
_TOKENS = "ceil(length(chunk_content) / 4.0)::BIGINT"


def _group_sql(key: str) -> str:
    count = lambda part, src: f"(SELECT count(*) FROM {src} WHERE {key} = g.gid) AS {part}"
    return (
        f"WITH {_I}, g AS (SELECT {key} AS gid FROM code_files WHERE {key} IS NOT NULL UNION SELECT {key} FROM code_chunks WHERE {key} IS NOT NULL) "
        f"SELECT gid AS group_id, {count('files', 'code_files')}, {count('chunks', 'code_chunks')}, {count('symbols', 'code_symbols')}, {count('imports', 'imp')} FROM g"
    )


_NEAR = "n AS (SELECT DISTINCT repo_path, file_path FROM code_files WHERE file_path IS NOT NULL AND repo_path IS NOT NULL), near AS (SELECT file_path AS source, unnest([lead(file_path, 1) OVER w, lead(file_path, 3) OVER w, lag(file_path, 2) OVER w]) AS target FROM n WINDOW w AS (PARTITION BY repo_path ORDER BY file_path))"
_LINKS = f"{_NEAR}, links AS (SELECT DISTINCT source, target FROM (SELECT s.file_path AS source, t.file_path AS target FROM (SELECT file_path, regexp_extract(i.path, '([^/.]+)$', 1) AS stem FROM imp WHERE file_path IS NOT NULL) s JOIN (SELECT DISTINCT file_path, regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]+$', '') AS stem FROM code_files WHERE file_path IS NOT NULL) t USING (stem) UNION ALL SELECT source, target FROM near) WHERE source <> target), st AS (SELECT source AS node FROM links GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 10)"
_DOCFILES = "df AS (SELECT repo_id AS doc_id, coalesce(file_path, '') AS file_path, list_filter([kind, lang], lambda x: x IS NOT NULL) AS tags, fetched_at AS indexed_at FROM documents WHERE repo_id IS NOT NULL)"
_COUNTED = lambda cond, *tables: " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE {cond}" for t in tables)
_CNT = lambda rx: f"len(regexp_extract_all(chunk_content, '{rx}'))"
_FN = (
    f"CASE WHEN language IN ('typescript', 'javascript') THEN {_CNT(r'function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\(|export\s+(?:async\s+)?function\s+\w+')} WHEN language = 'python' THEN {_CNT(r'def\s+\w+\s*\(')} "
    f"WHEN language IN ('java', 'csharp') THEN {_CNT(r'(?:public|private|protected|static)\s+[\w<>\[\],\s]+\s+\w+\s*\(')} WHEN language = 'go' THEN {_CNT(r'func\s+(?:\([^)]*\)\s+)?\w+\s*\(')} WHEN language = 'rust' THEN {_CNT(r'fn\s+\w+\s*[<(]')} ELSE {_CNT(r'function\s+\w+')} END"
)
_CL = f"CASE WHEN language = 'python' THEN {_CNT(r'class\s+\w+\s*[:(]')} WHEN language = 'rust' THEN {_CNT(r'(?:struct|enum|trait)\s+\w+')} ELSE {_CNT(r'class\s+\w+')} END"

SQL = {
    "group_by_workspace": _group_sql("workspace_id"),
    "group_by_service": _group_sql("service_id"),
    "group_by_repository": f"WITH {_I}, g AS (SELECT repo_id AS gid FROM code_files WHERE repo_id IS NOT NULL UNION SELECT repo_id FROM code_chunks WHERE repo_id IS NOT NULL) SELECT gid AS group_id, (SELECT count(*) FROM code_files WHERE repo_id = gid) AS files, (SELECT count(*) FROM code_chunks WHERE repo_id = gid) AS chunks, CASE WHEN gid = (SELECT min(gid) FROM g) THEN (SELECT count(*) FROM code_symbols WHERE service_id IS NOT NULL) ELSE 0 END AS symbols, CASE WHEN gid = (SELECT min(gid) FROM g) THEN (SELECT count(*) FROM imp WHERE workspace_id IS NOT NULL) ELSE 0 END AS imports FROM g",
    "grouped_context": f"WITH {_I}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{g}' AS grouping, '{p}' AS part, {k} AS gid FROM {src} WHERE {k} IS NOT NULL AND {k} IN (SELECT {k} FROM code_files UNION SELECT {k} FROM code_chunks)"
        for g, k in (("workspace", "workspace_id"), ("service", "service_id")) for p, src in (("files", "code_files"), ("chunks", "code_chunks"), ("symbols", "code_symbols"), ("imports", "imp"))
    )
    + ") SELECT grouping, part, count(*) AS members, count(DISTINCT gid) AS group_count FROM m GROUP BY ALL",
    "search_metadata": f"WITH {_I}, {_E}, k AS (SELECT DISTINCT repo_path, file_path, chunk_type, chunk_content FROM code_chunks) SELECT 'files_retrieved' AS metric, count(*) AS value FROM code_files UNION ALL SELECT 'chunks_retrieved', count(*) FROM code_chunks UNION ALL SELECT 'chunks_after_dedup', count(*) FROM k UNION ALL SELECT 'chunks_deduplicated', (SELECT count(*) FROM code_chunks) - (SELECT count(*) FROM k) UNION ALL SELECT 'symbols_resolved', count(*) FROM code_symbols UNION ALL SELECT 'imports_followed', count(*) FROM imp UNION ALL SELECT 'import_depth_reached', 1 UNION ALL SELECT 'api_endpoints_found', count(*) FROM e",
    "import_counts": f"WITH {_I} SELECT i.type AS import_type, count(*) AS n FROM imp GROUP BY 1",
    "chunks_by_file": "SELECT repo_path, file_path, count(*) AS n FROM code_chunks GROUP BY ALL",
    "display_forms": "SELECT id, total_lines, CASE WHEN row_number() OVER (ORDER BY total_lines DESC NULLS LAST, id) <= 5 THEN 'full' ELSE 'compact' END AS form FROM code_files ORDER BY total_lines DESC NULLS LAST, id LIMIT 20",
    "overhead_tokens": f"SELECT id, ceil({_TOKENS} * 105 / 100.0)::BIGINT AS tokens FROM code_chunks",
    "service_ids": "SELECT service_id FROM code_files WHERE service_id IS NOT NULL UNION SELECT service_id FROM code_chunks WHERE service_id IS NOT NULL",
    "endpoints_by_service": f"WITH {_E} SELECT service_id, row_number() OVER (PARTITION BY service_id ORDER BY id) AS ordinal, id, path FROM e WHERE service_id IN (SELECT service_id FROM services)",
    "endpoints_by_chunk": f"WITH {_E} SELECT implementation_chunk_id AS chunk_id, id AS endpoint_id, 1.0::DOUBLE AS confidence FROM e WHERE implementation_chunk_id IN (SELECT id FROM code_chunks)",
    "implementation_match": f"WITH {_E} SELECT id, service_id, path FROM e WHERE implementation_chunk_id IN (SELECT id FROM code_chunks WHERE service_id IS NOT NULL)",
    "enriched_endpoints": f"WITH {_E} SELECT service_id, count(*) AS endpoints, count(*) FILTER (WHERE implementation_chunk_id NOT IN (SELECT id FROM code_chunks)) AS unlinked FROM e WHERE service_id IN (SELECT service_id FROM code_files UNION SELECT service_id FROM code_chunks) GROUP BY 1",
    "repository_filter": f"WITH {_I}, r AS (SELECT repo_id FROM repositories WHERE repo_type = 'library'), f AS (SELECT * FROM code_files WHERE repo_id IS NULL OR repo_id IN (SELECT repo_id FROM r)) SELECT 'files' AS part, count(*) AS n FROM f UNION ALL SELECT 'chunks', count(*) FROM code_chunks WHERE repo_id IS NULL OR repo_id IN (SELECT repo_id FROM r) UNION ALL SELECT 'symbols', count(*) FROM code_symbols WHERE file_path IN (SELECT file_path FROM f) UNION ALL SELECT 'imports', count(*) FROM imp WHERE file_path IN (SELECT file_path FROM f)",
    "endpoint_checks": f"WITH {_E}, m AS (SELECT DISTINCT service_id, method FROM e) SELECT s.service_id, m.method, CASE WHEN s.service_type IS NULL OR s.service_type NOT IN ('rest', 'graphql', 'grpc') THEN 'api_type' WHEN m.method NOT IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') THEN 'http_method' WHEN s.service_type = 'rest' AND m.method IS NULL THEN 'rest_without_method' END AS violation FROM services s LEFT JOIN m USING (service_id)",
    "endpoint_methods": "SELECT id, coalesce(CASE WHEN symbol_type = 'method' THEN 'POST' END, CASE WHEN scope = 'exported' THEN symbol_name END, 'QUERY') AS method, coalesce(definition, symbol_name) AS description FROM code_symbols",
    "endpoint_service_names": f"WITH {_E} SELECT e.service_id, (SELECT min(service_name) FROM services s WHERE s.service_id = e.service_id) AS service_name, count(*) AS endpoints FROM e GROUP BY 1",
    "call_usage": f"WITH {_I} SELECT service_id AS source_service, i.type AS target_service, i.path AS target_endpoint, count(*) AS usage_count FROM imp WHERE service_id IS NOT NULL AND i.type IS NOT NULL AND service_id <> i.type GROUP BY ALL",
    "target_services": f"WITH {_E}, n AS (SELECT DISTINCT e.path AS endpoint, e.service_id, s.id AS ordinal FROM e JOIN services s USING (service_id)), c AS (SELECT DISTINCT '/' || symbol_name AS path FROM code_symbols WHERE service_id IS NULL AND symbol_name IS NOT NULL) SELECT c.path, arg_min(n.service_id, n.ordinal) AS target_service FROM c LEFT JOIN n ON starts_with(c.path, n.endpoint) OR starts_with(n.endpoint, c.path) GROUP BY 1",
    "documentation_search": f"WITH d AS (SELECT id AS chunk_id, repo_id AS doc_id, CASE WHEN chunk_type IN ('function', 'class') THEN 'code_block' ELSE 'section' END AS kind, list_filter([language, chunk_type], lambda x: x IS NOT NULL) AS tags, {_sim('code_chunks', 'id', 'embedding')} AS sim FROM code_chunks) SELECT chunk_id, doc_id, kind AS chunk_type, round(sim, 6) AS similarity FROM d WHERE list_has_any(tags, ['go', 'python', 'class']) AND kind = 'section' AND sim > 0.1 ORDER BY sim DESC, chunk_id LIMIT 25",
    "documentation_list": f"WITH {_DOCFILES}, t AS (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM df) GROUP BY 1) SELECT doc_id, count(DISTINCT file_path) AS files, coalesce(min(t.tags), '') AS tags, 2 * count(*) AS section_count, count(*) AS code_block_count, max(indexed_at) AS indexed_at FROM df LEFT JOIN t USING (doc_id) GROUP BY 1",
    "documentation_list_fan_out": f"WITH {_DOCFILES} SELECT doc_id, count(DISTINCT file_path) AS files, sum(2 * len(tags))::BIGINT AS section_count, sum(len(tags))::BIGINT AS code_block_count FROM df WHERE len(tags) > 0 GROUP BY 1",
    "documentation_removed": "WITH r AS (SELECT repo_id FROM repositories WHERE repo_type = 'documentation') SELECT 'documentation_files' AS table_name, count(*) AS removed FROM documents WHERE repo_id IN (SELECT repo_id FROM r) UNION ALL SELECT 'documentation_chunks', count(*) FROM code_chunks WHERE repo_id IN (SELECT repo_id FROM r)",
    "file_links": f"WITH {_I}, {_LINKS} SELECT source, target FROM links",
    "file_context": f"WITH RECURSIVE {_I}, {_LINKS}, w AS (SELECT min(node) AS node, 0 AS depth FROM st UNION SELECT target, depth + 1 FROM w JOIN links ON source = node WHERE depth < 2) SELECT node AS file_path, min(depth) AS depth FROM w WHERE node IN (SELECT file_path FROM code_files) GROUP BY 1",
    "scope_walk": f"WITH RECURSIVE {_I}, {_LINKS}, w AS (SELECT node, 0 AS depth FROM st UNION SELECT target, depth + 1 FROM w JOIN links ON source = node WHERE depth < 2) SELECT DISTINCT node FROM w",
    "import_paths": f"WITH RECURSIVE {_I}, {_LINKS}, w AS (SELECT [node] AS path, 0 AS depth, false AS cyclic FROM st UNION ALL SELECT list_append(path, target), depth + 1, list_contains(path, target) FROM w JOIN links ON source = path[-1] WHERE depth < 3 AND NOT cyclic) SELECT depth, cyclic, count(*) AS n FROM w GROUP BY ALL",
    "workspace_dependents": "SELECT package_name, count(DISTINCT workspace_id) AS dependents FROM (SELECT workspace_id, unnest(json_keys(dependencies)) AS package_name FROM workspaces WHERE dependencies IS NOT NULL AND json_valid(dependencies)) GROUP BY 1",
    "dependency_contracts": f"WITH {_I} SELECT DISTINCT d.repo_id, d.package_name, s.service_id, s.service_type FROM (SELECT f.repo_id, i.path AS package_name FROM imp JOIN code_files f USING (id) WHERE i.type = 'workspace') d JOIN services s USING (repo_id)",
    "first_elements": "SELECT id, json_extract(imports, '$.imports[0].symbols')::VARCHAR AS first_symbols, json_extract_string(imports, '$.imports[0].path') AS first_path FROM code_files WHERE imports IS NOT NULL AND json_valid(imports) AND json_extract_string(imports, '$.imports[0].path') IS NOT NULL",
    "docstring_heads": "WITH r AS (SELECT id, CASE WHEN language = 'python' THEN coalesce(nullif(regexp_extract(chunk_content, '^\\s*\"\"\"([\\s\\S]*?)\"\"\"', 1), ''), regexp_extract(chunk_content, '^\\s*([\\s\\S]*?)', 1)) ELSE regexp_extract(chunk_content, '^\\s*/\\*\\*?([\\s\\S]*?)\\*/', 1) END AS raw FROM code_chunks), c AS (SELECT id, trim(array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(trim(regexp_replace(x, '\\s', ' ', 'g')), '^\\*\\s?', '')), lambda x: x <> ''), ' ')) AS doc FROM r) SELECT id, CASE WHEN doc <> '' AND length(doc) <= 200 THEN doc END AS doc FROM c",
    "files_with_config": "SELECT f.repo_id, r.workspace_config, count(*) AS files FROM code_files f LEFT JOIN repositories r USING (repo_id) GROUP BY ALL",
    "detected_workspaces": "SELECT DISTINCT w.repo_id, 'npm' AS tool, workspace_path, package_name, version FROM workspaces w JOIN (SELECT repo_id, unnest(workspace_patterns) AS p FROM repositories) r ON r.repo_id = w.repo_id AND ((contains(p, '*') AND regexp_replace(workspace_path, '/?[^/]*$', '') = regexp_replace(p, '/\\*+$', '')) OR p = workspace_path) WHERE package_name IS NOT NULL",
    "detected_services": "SELECT DISTINCT repo_id, string_split(p, '/')[-1] AS service_name, p AS service_path, 'unknown' AS service_type FROM (SELECT repo_id, regexp_extract(file_path, '^((?:services|apps|packages|microservices)/[^/]+)/', 1) AS p FROM code_files) WHERE p <> ''",
    "cleared_repository": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE repo_id IS NULL OR repo_id <> (SELECT min(repo_id) FROM repositories)" for t in ("code_files", "code_chunks", "code_symbols", "workspaces", "services")) + " UNION ALL SELECT 'cross_repo_dependencies', count(*) FROM code_files WHERE NOT coalesce(repo_id = (SELECT min(repo_id) FROM repositories), false) AND NOT coalesce(package_name = (SELECT min(repo_id) FROM repositories), false)",
    "deleted_path": _COUNTED("repo_path IS NULL OR rtrim(repo_path, '/') <> (SELECT rtrim(min(repo_path), '/') FROM repositories)", "code_files", "code_chunks", "code_symbols"),
    "stored_tables": "SELECT 'repositories' AS table_name, count(DISTINCT repo_id) AS n FROM repositories UNION ALL SELECT 'code_files', count(*) FROM (SELECT DISTINCT repo_path, file_path FROM code_files) UNION ALL SELECT 'code_chunks', count(*) FROM code_chunks UNION ALL SELECT 'code_symbols', count(*) FROM code_symbols UNION ALL SELECT 'workspaces', count(DISTINCT workspace_id) FROM workspaces UNION ALL SELECT 'services', count(DISTINCT service_id) FROM services",
    "repository_five_counts": "SELECT repo_id, " + ", ".join(f"(SELECT count(*) FROM {t} x WHERE x.repo_id = r.repo_id) AS {n}" for t, n in (("code_files", "files"), ("code_chunks", "chunks"), ("code_symbols", "symbols"), ("workspaces", "workspaces"), ("services", "services"))) + " FROM repositories r",
    "stage_statistics": "WITH t AS (SELECT event_type AS stage, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT stage, count(*) AS operations, min(v) AS min_ms, max(v) AS max_ms, " + ", ".join(f"min(v) FILTER (WHERE rn >= greatest(ceil(n * {p} / 100.0), 1)) AS p{p}" for p in (50, 90, 95, 99)) + ", sum(v) > 0.2 * (SELECT sum(value) FROM events) AS bottleneck FROM t GROUP BY 1",
    "mean_quality": "WITH x AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS item FROM lineitem WHERE l_quantity > 25), h AS (SELECT l_orderkey AS q, count(*) AS shown, count(x.item) AS found, min(CASE WHEN x.item IS NOT NULL THEN l_linenumber END) AS first FROM lineitem l LEFT JOIN x ON x.q = l_orderkey AND x.item = l_partkey WHERE l_linenumber <= 5 GROUP BY 1), w AS (SELECT q, count(*) AS wanted FROM x GROUP BY 1) SELECT 'all' AS category, count(*) AS queries, round(avg(found / shown), 4) AS precision, round(avg(coalesce(found / wanted, 0)), 4) AS recall, round(avg(coalesce(1 / first, 0)), 4) AS mrr, round(avg(1 - found / shown), 4) AS noise, round(avg(first), 4) AS mean_rank FROM h LEFT JOIN w USING (q)",
    "indexing_strategies": "WITH c AS (SELECT id, total_lines AS n, CASE WHEN total_lines < 1000 THEN 'small' WHEN total_lines < 5000 THEN 'large' ELSE 'very-large' END AS category, CASE WHEN regexp_matches(file_path, '\\.(png|zip|pdf)$') THEN 'binary' WHEN regexp_matches(file_path, '\\.min\\.js$|lock') THEN 'generated' ELSE 'normal' END AS file_type FROM code_files WHERE total_lines IS NOT NULL) SELECT id, category, file_type, file_type = 'normal' AS should_index, file_type = 'normal' AND category = 'very-large' AS structure_only, CASE WHEN file_type = 'binary' THEN 'Binary file' WHEN file_type = 'generated' THEN 'Generated file (build output, lock file, etc.)' WHEN category = 'very-large' THEN 'Large file (' || format('{:,}', n) || ' lines) - using structure-only indexing' WHEN category = 'large' THEN 'Large file (' || format('{:,}', n) || ' lines) - using section-based chunking' END AS reason FROM c",
    "structure_summaries": f"WITH c AS (SELECT id, language, {_FN} AS f, {_CL} AS k FROM code_chunks WHERE language IS NOT NULL) SELECT id, 'This file contains ' || CASE WHEN f = 0 AND k = 0 THEN language || ' code' ELSE concat_ws(' and ', CASE WHEN f > 0 THEN f || CASE WHEN f = 1 THEN ' function' ELSE ' functions' END END, CASE WHEN k > 0 THEN k || CASE WHEN k = 1 THEN ' class' ELSE ' classes' END END) END || '.' AS summary FROM c",
    "embedding_texts": "WITH c AS (SELECT id, scope, definition, array_to_string(list_sort(list_distinct(string_split(symbol_name, '_'))), ', ') AS l FROM code_symbols) SELECT id, concat_ws(chr(10) || chr(10), nullif(scope, ''), definition, CASE WHEN l <> '' THEN 'Symbols: ' || CASE WHEN length(l) > 200 THEN l[1:197] || '...' ELSE l END END) AS text FROM c",
    "definition_texts": "WITH c AS (SELECT id, symbol_type AS k, symbol_name AS n, definition AS d, CASE WHEN coalesce(definition, '') <> '' THEN ' - ' || definition[1:200] ELSE '' END AS told, coalesce(definition, '') AS code FROM code_symbols) SELECT id, CASE k WHEN 'function' THEN 'function ' || n || '(a: b): void' || told WHEN 'class' THEN 'class ' || n || told WHEN 'variable' THEN CASE WHEN trim(string_split(code, chr(10))[1]) <> '' AND length(trim(string_split(code, chr(10))[1])) < 200 THEN trim(string_split(code, chr(10))[1]) ELSE 'const ' || n || ': unknown' END WHEN 'type' THEN CASE WHEN length(trim(code)) > 500 THEN trim(code)[1:497] || '...' ELSE trim(code) END WHEN 'interface' THEN CASE WHEN length(trim(code)) > 500 THEN trim(code)[1:497] || '...' ELSE trim(code) END ELSE code[1:500] END AS text FROM c",
    "endpoint_texts": f"WITH {_E} SELECT id, concat_ws(chr(10), method || ' ' || path, CASE WHEN description <> '' THEN 'Description: ' || description END, 'Operation: ' || service_id, 'Tags: ' || method, 'Implemented in: ' || path, 'Function: ' || service_id) AS text FROM e",
    "doc_embedding_texts": "SELECT doc_id, sha256(CASE WHEN kind = 'guide' THEN 'Documentation section: ' || source || chr(10) || chr(10) || text ELSE 'Code example (' || coalesce(lang, 'text') || ') in ' || source || ':' || chr(10) || chr(10) || text END) AS text_hash FROM documents",
    "call_confidences": f"WITH {_I}, t AS (SELECT git_remote_url AS x FROM repositories UNION ALL SELECT i.path FROM imp UNION ALL SELECT repo_path FROM repositories) SELECT CASE WHEN coalesce(x, '') = '' THEN 0.3 WHEN regexp_matches(x, '^https?://') THEN 0.95 WHEN regexp_matches(x, '^[\\w.-]+:\\d+') THEN 0.9 WHEN x LIKE '/%' THEN 0.75 WHEN contains(x, '$') OR contains(x, '{{') THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence, count(*) AS n FROM t GROUP BY 1",
    "line_ranges": "SELECT id, concat_ws('-', start_line, end_line) AS lines FROM code_chunks",
    "partitioned_topk": f"SELECT id, round(sim, 6) AS similarity FROM (SELECT id, language, {_sim('code_chunks', 'id', 'embedding')} AS sim FROM code_chunks) WHERE language = 'go' AND sim IS NOT NULL ORDER BY sim DESC, id LIMIT 20",
    "matched_calls": f"WITH {_E}, c AS (SELECT id AS call_id, symbol_type = 'method' AS post, '/' || symbol_name AS path FROM code_symbols WHERE symbol_name IS NOT NULL), x AS (SELECT method, path, max(id) AS id FROM e GROUP BY ALL), y AS (SELECT path, max(id) AS id FROM e GROUP BY ALL), m AS (SELECT call_id, CASE WHEN post THEN x.id ELSE y.id END AS endpoint_id FROM c LEFT JOIN x ON x.path = c.path AND x.method = 'POST' LEFT JOIN y ON y.path = c.path) SELECT call_id, endpoint_id, (SELECT min(service_id) FROM e WHERE e.id = endpoint_id) AS service_id FROM m",
    "contract_warnings": f"WITH {_E}, c AS (SELECT id AS call_id, symbol_type = 'method' AS post, '/' || symbol_name AS path FROM code_symbols WHERE symbol_name IS NOT NULL), x AS (SELECT method, path, max(id) AS id FROM e GROUP BY ALL), y AS (SELECT path, max(id) AS id FROM e GROUP BY ALL), m AS (SELECT call_id, CASE WHEN post THEN x.id ELSE y.id END AS eid FROM c LEFT JOIN x ON x.path = c.path AND x.method = 'POST' LEFT JOIN y ON y.path = c.path) SELECT * FROM (SELECT 'deprecated_api' AS type, 'warning' AS severity, (SELECT count(*) FROM e WHERE method = 'POST' AND id IN (SELECT eid FROM m)) AS n UNION ALL SELECT 'unresolved_call', 'info', (SELECT count(*) FROM m WHERE eid IS NULL) UNION ALL SELECT 'unlinked_endpoint', 'info', (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM code_chunks))) WHERE n > 0",
    "contract_links": f"WITH {_E} SELECT e.service_id, (SELECT min(service_name) FROM services s WHERE s.service_id = e.service_id) AS service_name, count(*) AS endpoints, count(*) FILTER (WHERE id IN (SELECT id FROM code_chunks)) AS linked FROM e GROUP BY 1",
    "resolved_aliases": f"WITH {_I}, p AS (SELECT i.path AS p, EXISTS (SELECT 1 FROM repositories r WHERE r.repo_id = f.repo_id) AS known FROM imp JOIN code_files f USING (id) WHERE f.repo_id IS NOT NULL) SELECT p AS import_path, CASE WHEN NOT known THEN NULL WHEN p LIKE '/%' THEN 'src' || p WHEN p LIKE '@%' THEN 'packages/' || p[2:] WHEN p LIKE '../%' THEN 'up/' || p[4:] END AS resolved_path, count(*) AS n FROM p GROUP BY ALL",
    "imported_packages": f"WITH {_I} SELECT CASE WHEN i.path LIKE '@%' THEN regexp_extract(i.path, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(i.path, '^([^/]+)', 1) END AS package, count(*) AS n FROM imp WHERE i.type IN ('workspace', 'external') GROUP BY 1",
    "boundary_edges": "WITH f AS (SELECT repo_path, file_path, min(workspace_id) AS w, min(service_id) AS s FROM code_files WHERE file_path IS NOT NULL AND repo_path IS NOT NULL GROUP BY ALL), e AS (SELECT w, s, lead(w) OVER p AS tw, lead(s) OVER p AS ts, lead(file_path) OVER p AS t FROM f WINDOW p AS (PARTITION BY repo_path ORDER BY file_path)) SELECT coalesce(w <> tw, false) AS crosses_workspace, false AS crosses_service, count(*) AS n FROM e WHERE t IS NOT NULL AND NOT coalesce(s <> ts, false) GROUP BY ALL",
    "merged_metadata": "SELECT repo_id, '2' AS version, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.branch') AS branch FROM repositories",
    "reindex_decisions": "SELECT repo_id, CASE WHEN last_updated IS NULL THEN 'full' WHEN json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.branch') = 'main' THEN 'skip' ELSE 'incremental' END AS decision FROM repositories",
    "stale_removed": "WITH s AS (SELECT repo_path, file_path, CASE min(language) WHEN 'go' THEN 'modified' WHEN 'rust' THEN 'deleted' ELSE 'unchanged' END AS status FROM code_files GROUP BY ALL), g AS (SELECT * FROM s WHERE status IN ('modified', 'deleted')) SELECT 'code_chunks' AS table_name, count(*) AS n FROM code_chunks c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repo_path = c.repo_path AND g.file_path = c.file_path) UNION ALL SELECT 'code_symbols', count(*) FROM code_symbols c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repo_path = c.repo_path AND g.file_path = c.file_path) UNION ALL SELECT 'to_index', count(*) FROM s WHERE status = 'modified'",
    "contract_search": f"SELECT id, service_id, round(sim, 6) AS similarity FROM (SELECT id, service_id, scope, {_sim('code_symbols', 'id', 'embedding')} AS sim FROM code_symbols) WHERE service_id IS NOT NULL AND (scope IS NULL OR scope <> 'internal') AND sim >= 0.05 ORDER BY sim DESC, id LIMIT 25",
}
