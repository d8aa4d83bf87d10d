"""The tool surface: seventeen functions over a catalogue of tables, each returning DataFrames.

A catalogue is a mapping from table name to DataFrame (see ``open_catalog``). Query texts become vectors by an ``embed``
function; the default hashes words into 64 dimensions, so everything runs without a model server.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fts
from sparkloom.functions import text as T
from sparkloom.operators import assembly, graph, incremental, lookups, retrieval
from sparkloom.session import load_or_none, materialise
from sparkloom.sources import files as source_files

TABLES = "repositories workspaces services code_files code_chunks code_symbols documents api_endpoints documentation_chunks documentation_files".split()
Catalog = dict[str, DataFrame]


def open_catalog(spark: SparkSession, root: str) -> Catalog:
    return {t: df for t in TABLES if (df := load_or_none(spark, root, t)) is not None}


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """Signed feature hashing of words, normalised; the zero vector for a text without words."""
    v = [0.0] * dim
    for w in fts.query_terms(text):
        h = xxhash.xxh64_intdigest(w)
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


@dataclass(frozen=True)
class SearchOptions:
    repo_ids: Sequence[str] | None = None
    workspace_ids: Sequence[str] | None = None
    service_ids: Sequence[str] | None = None
    exclude_types: Sequence[str] = ()
    max_files: int = 15
    max_snippets: int = 25
    file_threshold: float = 0.3
    chunk_threshold: float = 0.2
    dedup_threshold: float = 0.92
    import_depth: int = 3
    hybrid: bool = True

    def __post_init__(self) -> None:
        if not (0 < self.max_files <= 1000 and 0 < self.max_snippets * 4 <= assembly.MAX_CANDIDATES):
            raise ValueError("max_files must lie in 1..1000 and max_snippets in 1..250")
        if not (0 <= self.file_threshold <= 1 and 0 <= self.chunk_threshold <= 1 and 0 <= self.import_depth <= 10):
            raise ValueError("thresholds must lie in 0..1 and import_depth in 0..10")


@dataclass(frozen=True)
class SearchResult:
    files: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    imports: DataFrame
    warnings: DataFrame
    endpoints: DataFrame | None = None

    def groups(self, by: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """Members of the result by workspace, service and repository (``by``, or wherever an id occurs)."""
        from sparkloom.operators import context

        parts = {"files": self.files, "chunks": self.chunks, "symbols": self.symbols}
        return context.auto_groups(parts, {"files": "id", "chunks": "id", "symbols": "id"}, by)

    def within(self, repos: Sequence[str]) -> SearchResult:
        """The result without files and chunks of other repositories, and without symbols of other files. No ids give an empty result."""
        from sparkloom.operators import context

        p = context.restrict_to_repositories({"files": self.files, "chunks": self.chunks, "symbols": self.symbols}, repos)
        return SearchResult(p["files"], p["chunks"], p["symbols"], self.imports.join(p["files"].select("repo_path").distinct(), "repo_path", "left_semi"), self.warnings, self.endpoints)


def search_codebase(cat: Catalog, query: str, options: SearchOptions | None = None, embed: Callable[[str], list[float]] = hash_embedding) -> SearchResult:
    """Scope, best files, best chunks within them, near-duplicate removal, symbols, imports and warnings."""
    o = options or SearchOptions()
    if len(query.strip()) < 2:
        raise ValueError("the query is too short")
    q = embed(query)
    f = retrieval.scope(cat["code_files"], repo_id=o.repo_ids, workspace_id=o.workspace_ids, service_id=o.service_ids)
    if o.exclude_types:
        f = f.join(cat["repositories"].where(F.col("repo_type").isin(list(o.exclude_types))).select("repo_id"), "repo_id", "left_anti")
    keep = ("repo_id", "repo_path", "file_path", "workspace_id", "service_id")
    if o.hybrid:
        files = retrieval.hybrid_topk(f, "id", "summary_embedding", "file_summary", q, query, o.max_files, o.file_threshold, keep=keep)
    else:
        files = retrieval.vector_topk(f, "id", "summary_embedding", q, o.max_files, o.file_threshold, keep=keep).withColumn("score", F.col("similarity"))
    files = materialise(files, "files")  # both lists are short, and every later part reads them
    inside = cat["code_chunks"].where("chunk_type <> 'file_summary'").join(F.broadcast(files.select("repo_path", "file_path").distinct()), ["repo_path", "file_path"], "left_semi")
    kept = (*keep, "chunk_type", "start_line", "end_line", "chunk_content", "metadata", "embedding")
    found = retrieval.hybrid_topk(inside, "id", "embedding", "chunk_content", q, query, o.max_snippets * 4, o.chunk_threshold, keep=kept)
    found = materialise(found, "found")
    unique = assembly.greedy_dedup(found, "id", "embedding", "score", o.dedup_threshold).where("duplicate_of is null").select("id")
    chunks = found.drop("embedding").join(unique, "id", "left_semi")
    chunks = assembly.prioritise(chunks, cat["repositories"], "score").orderBy(F.desc("weighted"), "id").limit(o.max_snippets)
    symbols = lookups.resolve_symbols(cat["code_symbols"], lookups.symbols_of_chunks(chunks))
    chunks = materialise(chunks, "chunks")
    starts = files.orderBy(F.desc("score"), "id").limit(10).select("repo_path", F.col("file_path").alias("node"))
    imports = graph.expand_imports(cat["code_files"], starts, o.import_depth)
    endpoints = None
    if "api_endpoints" in cat:
        from sparkloom.operators import context

        endpoints = context.enrich(files, chunks, cat["api_endpoints"])["endpoints"]
    return SearchResult(files, chunks, symbols, imports, assembly.search_warnings(files, chunks, T.token_estimate(F.col("chunk_content"))), endpoints)


def search_references(cat: Catalog, query: str, k: int = 10, embed: Callable[[str], list[float]] = hash_embedding) -> DataFrame:
    docs = cat["code_chunks"].where("language = 'markdown'").select("id", "embedding")
    return retrieval.reference_search(docs, cat["code_chunks"], cat["repositories"], embed(query), k)


def search_api_contracts(endpoints: DataFrame, query: str, k: int = 20, threshold: float = 0.75, deprecated: bool = False, embed: Callable[[str], list[float]] = hash_embedding) -> DataFrame:
    """Endpoints of at least ``threshold``; deprecated ones only if asked for (a null flag counts as current)."""
    e = endpoints if deprecated else endpoints.where("deprecated is null or not deprecated")
    return retrieval.vector_topk(e, "id", "embedding", embed(query), k, keep=("service_id", "method", "path")).where(F.col("similarity") >= threshold)


def find_symbol_definition(cat: Catalog, name: str, scope: str | None = None, limit: int = 50) -> DataFrame:
    return lookups.symbol_search(cat["code_symbols"], name, limit, scope)


def symbol_usages(cat: Catalog, name: str, per_file: int = 5) -> DataFrame:
    """Files that import the symbol by name, with the lines: ``(repo_path, file_path, import_line, rank)``, at most ``per_file`` a file."""
    from pyspark.sql import Window

    i = lookups.parsed_imports(cat["code_files"], "repo_path", "file_path").where(F.array_contains("import_symbols", name))
    return i.select("repo_path", "file_path", "import_line", F.row_number().over(Window.partitionBy("repo_path", "file_path").orderBy("import_line", "import_path")).alias("rank")).where(F.col("rank") <= per_file)


def get_file_context(cat: Catalog, path: str) -> dict[str, DataFrame]:
    file = lookups.find_file(cat["code_files"], path)
    hit = file.first()
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    mine = (F.col("repo_path") == hit.repo_path) & (F.col("file_path") == hit.file_path) if hit else F.lit(False)
    return {
        "file": file, "chunks": cat["code_chunks"].where(mine).orderBy("start_line", "id"), "symbols": cat["code_symbols"].where(mine).orderBy("line_number", "id"),
        "imports": lookups.parsed_imports(cat["code_files"].where(mine), "id"), "callers": lookups.callers(cat["code_files"], stem),
    }


def get_workspace_context(cat: Catalog, workspace_id: str) -> dict[str, DataFrame]:
    e = lookups.workspace_edges(cat["workspaces"])
    return {
        "workspace": cat["workspaces"].where(F.col("workspace_id") == workspace_id), "files": cat["code_files"].where(F.col("workspace_id") == workspace_id).select("id", "repo_path", "file_path").orderBy("file_path"),
        "dependencies": graph.neighbours(e, workspace_id), "dependents": graph.neighbours(e, workspace_id, reverse=True),
    }


def service_edges(cat: Catalog) -> DataFrame:
    return cat["services"].select(F.col("service_id").alias("source"), F.explode(F.map_keys(F.from_json("dependencies", "map<string,string>"))).alias("target"))


def get_service_context(cat: Catalog, service_id: str) -> dict[str, DataFrame]:
    e = service_edges(cat)
    endpoints = {"endpoints": cat["api_endpoints"].where(F.col("service_id") == service_id).orderBy("path", "id")} if "api_endpoints" in cat else {}
    return endpoints | {"service": cat["services"].where(F.col("service_id") == service_id), "dependencies": graph.neighbours(e, service_id), "dependents": graph.neighbours(e, service_id, reverse=True)}


def index_repository(spark: SparkSession, root: str, stored: DataFrame | None = None, ignore: Sequence[str] | None = None, repo_id: str | None = None) -> dict[str, DataFrame]:
    """Files below ``root`` with chunks, nodes, symbols, imports, summaries, workspaces, services and aliases; with ``stored`` only new and modified files are parsed.

    ``ignore`` defaults to the ignore file at the root, ``repo_id`` to the root's name.
    """
    from sparkloom.operators import decompose, detect

    files = source_files.discover(spark, root, ignore).withColumn("id", F.xxhash64("file_path"))
    changes = incremental.detect_changes(files, stored if stored is not None else files.limit(0), ["file_path"], "file_hash")
    todo = files.join(changes.where("status in ('new', 'modified')").select("file_path"), "file_path", "left_semi")
    nodes = decompose.file_nodes(todo, "id", "content", "language")
    head = F.coalesce(T.docstring_head(F.col("content"), F.col("language")), T.structure_summary(F.col("content"), F.col("language")))
    name = F.lit(repo_id or root.rstrip("/").rsplit("/", 1)[-1]).alias("repo_id")
    listed = source_files.listing(spark, root)
    p = F.col("file_path")
    told = listed.where(p.rlike(r"(^|/)(package\.json|tsconfig\.json|app\.json|template\.yaml|pubspec\.yaml|(docker-)?compose\.ya?ml)$") | p.isin(*detect.TOOLS))
    manifests = source_files.read_content(told.where(~p.rlike("(^|/)node_modules/"))).select("file_path", F.col("content").cast("string").alias("content"))
    tree = listed.select("file_path").join(manifests, "file_path", "left").select(name, "file_path", F.coalesce("content", F.lit("")).alias("content"))
    return {
        "changes": changes, "files": files, "chunks": decompose.file_chunks(todo, "id", "content", "language"), "nodes": nodes, "symbols": decompose.symbols_of_nodes(nodes), "imports": decompose.file_imports(todo, "id", "content", "language"),
        "summaries": todo.select("id", "file_path", T.clean_summary(head).alias("file_summary")), "workspaces": detect.workspaces(tree), "services": detect.services(tree), "aliases": detect.path_aliases(tree),
    }


def index_documentation(docs: DataFrame, stored: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """Sections and code blocks of the documents whose hash is not stored yet."""
    from sparkloom.operators import decompose

    d = docs.withColumn("file_hash", T.sha256(F.col(text)))
    fresh = d if stored is None else d.join(stored.select(key, "file_hash"), [key, "file_hash"], "left_anti")
    return {"documents": fresh, "sections": decompose.markdown_sections(fresh, key, text), "code_blocks": decompose.markdown_code(fresh, key, text)}


def list_indexed_repos(cat: Catalog) -> DataFrame:
    return lookups.repository_counts(cat["repositories"], cat["code_files"], cat["workspaces"], cat["services"]).orderBy(F.desc("indexed_at"), "repo_id")


def list_workspaces(cat: Catalog, repo_id: str | None = None) -> DataFrame:
    w = cat["workspaces"]
    return (w if repo_id is None else w.where(F.col("repo_id") == repo_id)).orderBy("repo_id", "package_name")


def list_services(cat: Catalog, types: Sequence[str] | None = None) -> DataFrame:
    return lookups.service_list(cat["services"], types)


def list_documentation(cat: Catalog) -> DataFrame:
    return cat["documents"].groupBy("source").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("documents"), F.max("fetched_at").alias("last_fetched")).orderBy("source")


def find_cross_workspace_usages(cat: Catalog, package: str) -> DataFrame:
    """Files using a package, counted by workspace; ``cross_workspace_imports`` has a row an import."""
    return lookups.usages_of_package(cat["code_files"], package).orderBy(F.desc("total_imports"), "workspace_id")


def cross_workspace_imports(cat: Catalog, package: str, symbol: str | None = None) -> DataFrame:
    """``(workspace_id, repo_path, file_path, import_line, symbol, depth)``: one row an import of the package; ``symbol`` only names the rows."""
    i = lookups.parsed_imports(cat["code_files"], "workspace_id", "repo_path", "file_path").where(F.col("import_path") == package)
    return i.select("workspace_id", "repo_path", "file_path", "import_line", F.coalesce(F.lit(symbol), F.array_join("import_symbols", ", ")).alias("symbol"), F.lit(1).alias("depth")).orderBy("repo_path", "file_path", "import_line")


def find_cross_service_calls(calls: DataFrame, service_id: str, both_ways: bool = True) -> DataFrame:
    """Calls of a service by endpoint, those it makes and (``both_ways``) those made to it."""
    out = lookups.call_counts(calls.where(F.col("source_service") == service_id), "source_service", "target_service", "endpoint")
    if both_ways:
        out = out.unionByName(lookups.call_counts(calls.where(F.col("target_service") == service_id), "source_service", "target_service", "endpoint"))
    return out.orderBy(F.desc("call_count"), "source_service", "target_service", "endpoint")


def delete_repository(cat: Catalog, repo_id: str) -> tuple[Catalog, DataFrame]:
    keyed = {n: t for n, t in cat.items() if "repo_id" in t.columns}
    left, counts = incremental.delete_repository(keyed, repo_id)
    return {**cat, **left}, counts


def delete_documentation(cat: Catalog, doc_ids: Sequence) -> tuple[Catalog, DataFrame]:
    """The catalogue without the documents, and how many rows each documentation table loses."""
    from sparkloom.operators import documentation

    kept, counts = documentation.remove_documents({n: t for n, t in cat.items() if "doc_id" in t.columns}, doc_ids)
    return {**cat, **kept}, counts
