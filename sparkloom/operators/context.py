"""From hits to one context: groups, maps, metadata, scopes and filters over the parts of a search result.

All of these work on the parts of one search as DataFrames (files, chunks, symbols, imports, endpoints). Nothing is collected: groups are rows,
and a group's members are counted or listed as bounded arrays of keys only where the caller asks for lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("files", "chunks", "symbols", "imports")


def group_rows(parts: dict[str, DataFrame], key: str, ids: dict[str, str]) -> DataFrame:
    """``(group_id, part, ordinal, id)``: the members of each group, by the column ``key`` of every part.

    ``ids`` names each part's id column. A group exists if a file or a chunk has its id; symbols and imports of other ids belong to none, null ids
    to none. One row a member, so a group of any size stays distributed.
    """
    known = reduce(DataFrame.unionByName, [parts[p].where(F.col(key).isNotNull()).select(F.col(key).alias("group_id")) for p in ("files", "chunks")]).distinct()
    rows = [parts[p].where(F.col(key).isNotNull()).select(F.col(key).alias("group_id"), F.lit(p).alias("part"), F.lit(i).alias("ordinal"), F.col(ids[p]).cast("string").alias("id")) for i, p in enumerate(PARTS) if p in parts]
    return reduce(DataFrame.unionByName, rows).join(known, "group_id", "left_semi")


def group_rows_by_repository(parts: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """The same by repository. Symbols of a service and imports of a workspace carry no repository: all of them go to the first one by id."""
    base = group_rows({p: parts[p] for p in ("files", "chunks")}, "repo_id", ids)
    first = base.agg(F.min("group_id").alias("group_id")).where("group_id is not null")
    rest = [
        parts[p].where(F.col(owner).isNotNull()).select(F.lit(p).alias("part"), F.lit(PARTS.index(p)).alias("ordinal"), F.col(ids[p]).cast("string").alias("id"))
        for p, owner in (("symbols", "service_id"), ("imports", "workspace_id")) if p in parts
    ]
    one = F.broadcast(first.withColumn("__one", F.lit(1)))  # one row
    return reduce(DataFrame.unionByName, [base, *(r.withColumn("__one", F.lit(1)).join(one, "__one").select(base.columns) for r in rest)])


def group_summary(rows: DataFrame) -> DataFrame:
    """``(group_id, files, chunks, symbols, imports)``: members of each group, counted."""
    return rows.groupBy("group_id").agg(*[F.count(F.when(F.col("part") == p, 1)).alias(p) for p in PARTS])


def auto_groups(parts: dict[str, DataFrame], ids: dict[str, str], by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The groupings of a result: by workspace, service and repository as asked, or wherever some file or chunk has such an id."""
    keys = {"workspace": "workspace_id", "service": "service_id", "repo": "repo_id"}
    if by is None:
        any_id = parts["files"].select(*keys.values()).unionByName(parts["chunks"].select(*keys.values())).agg(*[F.max(F.col(c).isNotNull()).alias(k) for k, c in keys.items()]).first()
        by = [k for k in keys if any_id[k]]
    return {k: group_rows_by_repository(parts, ids) if k == "repo" else group_rows(parts, keys[k], ids) for k in by}


def search_metadata(files: DataFrame, chunks: DataFrame, kept: DataFrame, symbols: DataFrame, imports: DataFrame, endpoints: DataFrame, tokens: Column) -> DataFrame:
    """``(metric, value)``: counts about a result: parts found, duplicates dropped, tokens, deepest import, workspaces, services and repositories touched."""
    touched = files.select("workspace_id", "service_id", "repo_id").unionByName(kept.select("workspace_id", "service_id", "repo_id"))
    n = F.count("*")
    counts = [
        (files, {"files_retrieved": n}), (chunks, {"chunks_retrieved": n}), (kept, {"chunks_after_dedup": n, "chunk_tokens": F.coalesce(F.sum(tokens), F.lit(0))}), (symbols, {"symbols_resolved": n}),
        (imports, {"imports_followed": n, "import_depth_reached": F.coalesce(F.max("depth"), F.lit(0))}), (endpoints, {"api_endpoints_found": n}),
        (touched, {"workspaces_searched": F.count_distinct("workspace_id"), "services_searched": F.count_distinct("service_id"), "repos_searched": F.count_distinct("repo_id")}),
    ]
    rows = [df.agg(F.map_from_arrays(F.array(*map(F.lit, aggs)), F.array(*[a.cast("bigint") for a in aggs.values()])).alias("m")).select(F.explode("m").alias("metric", "value")) for df, aggs in counts]
    out = reduce(DataFrame.unionByName, rows)
    sum_of = lambda **w: F.sum(sum((F.when(F.col("metric") == k, F.col("value") * v).otherwise(0) for k, v in w.items()), F.lit(0)))
    derived = [
        out.agg(sum_of(chunks_retrieved=1, chunks_after_dedup=-1).cast("bigint").alias("value")).select(F.lit("chunks_deduplicated").alias("metric"), "value"),
        out.agg(sum_of(chunk_tokens=1, symbols_resolved=50, imports_followed=30).cast("bigint").alias("value")).select(F.lit("total_tokens").alias("metric"), "value"),
    ]
    return reduce(DataFrame.unionByName, [out, *derived])


def part_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a part by something: chunks by file, imports by depth or by reason, symbols by type."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def service_ids(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(service_id)``: services of the files and chunks found."""
    return files.select("service_id").unionByName(chunks.select("service_id")).where("service_id is not null").distinct()


def endpoints_by_service(endpoints: DataFrame, services: DataFrame) -> DataFrame:
    """Endpoints of the given services, numbered within each: ``(service_id, ordinal, ...)``."""
    mine = endpoints.join(services.select("service_id").distinct(), "service_id", "left_semi")
    return mine.withColumn("ordinal", F.row_number().over(Window.partitionBy("service_id").orderBy("id")))


def endpoints_by_chunk(endpoints: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk_id, endpoint_id, confidence)``: endpoints whose implementation is one of the chunks found; confidence is 1."""
    e = endpoints.select(F.col("id").alias("endpoint_id"), F.col("implementation_chunk_id").alias("chunk_id"))
    return e.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id").select("chunk_id", "endpoint_id", F.lit(1.0).alias("confidence"))


def flattened_endpoints(services: DataFrame) -> DataFrame:
    """Endpoints kept as JSON in the services table, one row each: ``(service_id, method, path, description)``. Unreadable JSON gives none."""
    e = F.explode(F.from_json("api_endpoints", "array<struct<method:string,path:string,description:string>>")).alias("e")
    return services.select("service_id", e).select("service_id", "e.method", "e.path", "e.description")


def enrich(files: DataFrame, chunks: DataFrame, endpoints: DataFrame, match: bool = False, max_endpoints: int | None = None) -> dict[str, DataFrame]:
    """API context of a result: ``endpoints`` of its services, ``links`` to the chunks found, and ``unlinked`` ones.

    ``match`` keeps only endpoints implemented in a chunk found; ``max_endpoints`` keeps the best by ``similarity``, ties by id.
    """
    mine = endpoints.join(service_ids(files, chunks), "service_id", "left_semi")
    if match:
        mine = implemented_in(mine, chunks)
    if max_endpoints is not None:
        mine = mine.orderBy(F.desc("similarity"), "id").limit(max_endpoints)
    links = endpoints_by_chunk(mine, chunks)
    return {"endpoints": mine, "links": links, "unlinked": mine.join(links.select(F.col("endpoint_id").alias("id")), "id", "left_anti")}


def implemented_in(endpoints: DataFrame, chunks: DataFrame) -> DataFrame:
    """Endpoints whose implementation is among the chunks."""
    return endpoints.join(chunks.select(F.col("id").alias("implementation_chunk_id")).distinct(), "implementation_chunk_id", "left_semi")


def restrict_to_repositories(parts: dict[str, DataFrame], repos: Sequence[str]) -> dict[str, DataFrame]:
    """Files and chunks of the given repositories or of none; symbols and imports whose file is one of those files. An empty list gives an empty result."""
    inside = (F.col("repo_id").isNull() | F.col("repo_id").isin(list(repos))) if repos else F.lit(False)
    files, chunks = parts["files"].where(inside), parts["chunks"].where(inside)
    paths = files.select("file_path").distinct()
    return {"files": files, "chunks": chunks, **{p: parts[p].join(paths, "file_path", "left_semi") for p in ("symbols", "imports") if p in parts}}


def cross_repository_dedup(candidates: DataFrame, repositories: DataFrame, key: str, vector: str, order: str, threshold: float = 0.92) -> DataFrame:
    """``(key, kept, similar_file)``: near-duplicates across repositories, in the order of ``order``.

    A row like a kept one is dropped in the same repository; a reference row like a main row is kept with ``similar_file`` naming it; a main row
    replaces a reference row it is like, in its place. Other rows stay. Null repositories and types count as monolithic; rows without a vector are like none.
    The input is one search's candidates: the fold over them is sequential, in one task, as its rule is.
    """
    kinds = repositories.select("repo_id", F.col("repo_type").alias("__type")).dropDuplicates(["repo_id"])
    rows = candidates.select(key, "repo_id", "file_path", vector, order).join(kinds, "repo_id", "left").withColumn("__ref", F.coalesce(F.col("__type") == "reference", F.lit(False))).withColumn("__one", F.lit(1))
    kind = dict(candidates.dtypes)[key]

    def fold(pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values([order, key], kind="stable")
        kept: list[list] = []  # key, repository, is a reference, file, unit vector, similar file
        for k, repo, path, v, ref in zip(pdf[key], pdf["repo_id"], pdf["file_path"], pdf[vector], pdf["__ref"], strict=True):
            u = None if v is None else np.asarray(v, float)
            u = u / np.linalg.norm(u) if u is not None and np.isfinite(u).all() and np.linalg.norm(u) > 0 else None
            new, drop = [k, repo, bool(ref), path, u, None], False
            for i, old in enumerate(kept):
                if u is None or old[4] is None or len(u) != len(old[4]) or float(u @ old[4]) <= threshold:
                    continue
                if repo == old[1] or (repo is None and old[1] is None):
                    drop = True
                    break
                if new[2] and not old[2]:
                    new[5] = old[3]
                elif old[2] and not new[2]:
                    kept[i], drop = new, True
                    break
            if not drop:
                kept.append(new)
        similar = {x[0]: x[5] for x in kept}
        return pd.DataFrame({key: pdf[key], "kept": [k in similar for k in pdf[key]], "similar_file": [similar.get(k) for k in pdf[key]]})

    return rows.groupBy("__one").applyInPandas(fold, f"{key} {kind}, kept boolean, similar_file string")


def similar_files(dedup: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``(key, similar_to)``: for every kept row the files of the rows dropped for it, sorted. ``dedup(key, duplicate_of)``."""
    dropped = dedup.where("duplicate_of is not null").select(key, F.col("duplicate_of").alias("__kept")).join(rows.select(key, "file_path"), key)
    return dropped.groupBy(F.col("__kept").alias(key)).agg(F.array_sort(F.collect_set("file_path")).alias("similar_to"))


def display_rows(df: DataFrame, order: Sequence[Column | str], full: int, compact: int) -> DataFrame:
    """The rows a result page shows: the first ``full`` in full, the next ``compact`` shortened (``form``)."""
    best = df.orderBy(*order).limit(full + compact)
    at = F.row_number().over(Window.orderBy(*order))  # of at most ``full + compact`` rows
    return best.withColumn("form", F.when(at <= full, "full").otherwise("compact"))


def with_overhead(tokens: Column) -> Column:
    """Tokens of a context with its formatting: five percent more, rounded up."""
    return F.ceil(tokens * 105 / 100).cast("bigint")


def call_usage(calls: DataFrame) -> DataFrame:
    """Dependency edges from detected calls: ``(source_service, target_service, target_endpoint, usage_count)``; calls without a target or within a service are none."""
    return calls.where("target_service is not null and source_service is not null and source_service <> target_service").groupBy("source_service", "target_service", "target_endpoint").agg(F.count("*").alias("usage_count"))


def target_services(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``calls(call_id, path)`` with ``target_service``: the first service (by ``ordinal``) with an endpoint path that begins with the call's, or the other way round.

    Both are cut into path prefixes, so the join is an equality on prefixes, not a test of every pair.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda n: F.substring(c, F.lit(1), n))
    c = calls.select("call_id", "path").where("path is not null")
    e = endpoints.select("service_id", "ordinal", F.col("path").alias("endpoint")).where("endpoint is not null and endpoint <> ''").distinct()
    longer = c.select("call_id", F.explode(prefixes(F.col("path"))).alias("endpoint")).join(e, "endpoint")
    shorter = e.select("service_id", "ordinal", F.explode(prefixes(F.col("endpoint"))).alias("path")).join(c, "path")
    first = longer.select("call_id", "service_id", "ordinal").unionByName(shorter.select("call_id", "service_id", "ordinal")).groupBy("call_id").agg(F.min_by("service_id", "ordinal").alias("target_service"))
    return calls.join(first, "call_id", "left")
