"""Relational lookups of the catalogue: repositories, workspaces, services, symbols, imports and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMPORTS = "struct<imports:array<struct<path:string,line:int,symbols:array<string>,type:string>>>"


def latest(df: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """One row per key: the latest by ``order``, then the largest ``tie`` (rows stored again under a new id)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.desc(tie))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def parsed_imports(files: DataFrame, *keep: str) -> DataFrame:
    """One row per import: ``(*keep, import_path, import_line, import_symbols, import_type)``; unreadable JSON gives none."""
    i = F.explode(F.from_json("imports", IMPORTS)["imports"]).alias("i")
    return files.select(*keep, i).select(*keep, F.col("i.path").alias("import_path"), F.col("i.line").alias("import_line"), F.col("i.symbols").alias("import_symbols"), F.col("i.type").alias("import_type"))


def repository_counts(repositories: DataFrame, files: DataFrame, workspaces: DataFrame, services: DataFrame) -> DataFrame:
    """Files, workspaces and services per repository. Each side is counted before the join, so nothing fans out."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("repo_id").agg(F.count("*").alias(name))

    out = repositories.select("repo_id", "repo_name", "repo_type", F.try_variant_get(F.try_parse_json("metadata"), "$.branch", "string").alias("branch"), "indexed_at")
    for df, name in ((files, "file_count"), (workspaces, "workspace_count"), (services, "service_count")):
        out = out.join(count(df, name), "repo_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def symbol_search(symbols: DataFrame, pattern: str, limit: int = 50, scope: str | None = None) -> DataFrame:
    """Case-insensitive substring search (``%`` and ``_`` are wildcards), exported symbols first, then by name and id."""
    out = symbols.where(F.col("symbol_name").ilike(f"%{pattern}%"))
    if scope in ("exported", "internal"):
        out = out.where(F.col("scope") == scope)
    first = F.when(F.col("scope") == "exported", 0).otherwise(1)
    return out.select("id", "symbol_name", "symbol_type", "scope", "file_path", "line_number").orderBy(first, "symbol_name", "id").limit(limit)


def find_file(files: DataFrame, path: str) -> DataFrame:
    """The file of exactly this path, else (a relative path) the shortest path that ends with it."""
    exact = F.col("file_path") == path
    suffix = F.col("file_path").endswith("/" + path) if not path.startswith("/") else F.lit(False)
    return files.where(exact | suffix).select("id", "repo_path", "file_path").orderBy(F.when(exact, 0).otherwise(1), F.char_length("file_path"), "file_path", "id").limit(1)


def callers(files: DataFrame, stem: str) -> DataFrame:
    """Files with an import that ends with the given stem."""
    return parsed_imports(files, "repo_path", "file_path").where(F.col("import_path").endswith(stem)).select("repo_path", "file_path").distinct()


def usages_of_package(files: DataFrame, package: str) -> DataFrame:
    """Use of a package by workspace: ``(workspace_id, package_name, file_count, total_imports)``."""
    used = parsed_imports(files, "id", "workspace_id", "package_name").where(F.col("import_path") == package)
    return used.groupBy("workspace_id", "package_name").agg(F.countDistinct("id").alias("file_count"), F.count("*").alias("total_imports"))


def package_usage(files: DataFrame) -> DataFrame:
    """The same for every workspace package at once: ``(import_path, file_count, total_imports, symbols)``."""
    used = parsed_imports(files, "id").where("import_type = 'workspace'")
    return used.groupBy("import_path").agg(F.countDistinct("id").alias("file_count"), F.count("*").alias("total_imports"), F.sum(F.size("import_symbols")).alias("symbol_count"))


def workspace_edges(workspaces: DataFrame) -> DataFrame:
    """Dependencies between workspaces of one repository: ``(repo_id, source, target, version_specifier)``."""
    deps = workspaces.select("repo_id", F.col("workspace_id").alias("source"), F.explode(F.from_json("dependencies", "map<string,string>")).alias("package_name", "version_specifier"))
    target = workspaces.select("repo_id", "package_name", F.col("workspace_id").alias("target"))
    return deps.join(target, ["repo_id", "package_name"]).select("repo_id", "source", "target", "version_specifier")


def service_list(services: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    out = services if types is None else services.where(F.col("service_type").isin(list(types)))
    return out.select("service_id", "service_name", "repo_id", "service_type").orderBy("repo_id", "service_name")


def path_prefix_service(files: DataFrame, services: DataFrame) -> DataFrame:
    """The service a file lies in: ``(id, service_id)``, the longest service path that is a prefix of its path, in its repository."""
    s = services.select("repo_id", "service_id", F.concat(F.regexp_replace("service_path", r"/+$", ""), F.lit("/")).alias("prefix"))
    hit = files.select("id", "repo_id", "file_path").join(s, "repo_id").where(F.col("file_path").startswith(F.col("prefix")))
    return hit.groupBy("id").agg(F.max_by("service_id", F.struct(F.char_length("prefix"), F.col("service_id"))).alias("service_id"))


def call_counts(calls: DataFrame, *by: str, name: str = "call_count") -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias(name))


def symbols_of_chunks(chunks: DataFrame) -> DataFrame:
    """Distinct symbol names stated in chunk metadata (four list fields, trimmed); unreadable metadata gives none."""
    m = F.from_json("metadata", "struct<function_names:array<string>,class_names:array<string>,symbols:array<string>,exports:array<string>>")
    none = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(m[c], none) for c in ("function_names", "class_names", "symbols", "exports")])
    return chunks.select("repo_path", F.explode(names).alias("n")).select("repo_path", F.trim("n").alias("symbol_name")).where("symbol_name <> ''").distinct()


def resolve_symbols(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Exported symbols whose name is asked for in their repository."""
    return symbols.where("scope = 'exported'").join(names.select("repo_path", "symbol_name").distinct(), ["repo_path", "symbol_name"], "left_semi")


def is_bound(workspace: Column, service: Column) -> Column:
    return workspace.isNotNull() | service.isNotNull()
