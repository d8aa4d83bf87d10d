"""Bounded graph traversal as frontier joins: one small shuffle per level, no path enumeration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """``edges(source, target)``, ``starts(node)`` -> ``(node, depth)``: least number of hops, at most ``max_depth``.

    Nodes of ``blocked(node)`` are neither returned nor passed through, unless they are starts. Cycles and self-loops end by the
    visited set. Each level is written to the shared folder, so the plan does not grow with the depth.
    """
    edges = materialise(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")  # read by every level
    frontier = materialise(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "bfs")
    visited = frontier
    for d in range(1, max_depth + 1):
        step = frontier.join(edges.select(F.col("source").alias("node"), F.col("target")), "node").select(F.col("target").alias("node")).where("node is not null").distinct()
        if blocked is not None:
            step = step.join(blocked.select("node"), "node", "left_anti")
        frontier = materialise(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        visited = visited.unionByName(frontier)
        if d < max_depth and frontier.isEmpty():
            break
    return visited


def normalised_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Import edges between files of one repository: ``(repo_path, source, target, line)``, relative paths resolved and extensions inferred.

    ``imports`` has ``(repo_path, file_path, import_path, import_line)``. Candidates are tried in the order plain path, then the usual
    extensions, then index files; the first that is a file wins.
    """
    tries = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".rs", ".rb", ".php", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
    rel = imports.where(F.col("import_path").rlike(r"^\.{1,2}/") | F.col("import_path").rlike(r"^\.[A-Za-z_]"))
    slashed = F.when(F.col("import_path").rlike(r"^\.[A-Za-z_]"), F.concat(F.lit("./"), F.regexp_replace(F.expr("substring(import_path, 2)"), r"\.", "/"))).otherwise(F.col("import_path"))
    parts = F.split(F.concat_ws("/", F.regexp_replace("file_path", r"/?[^/]*$", ""), slashed), "/")
    # fold '.' and '..' over the path parts
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    cand = rel.select("repo_path", F.col("file_path").alias("source"), F.col("import_line").alias("line"), F.concat_ws("/", folded).alias("base"))
    cand = cand.select("repo_path", "source", "line", "base", F.posexplode(F.array(*[F.lit(t) for t in tries])).alias("ord", "ext")).withColumn("target", F.concat("base", "ext"))
    known = files.select("repo_path", F.col("file_path").alias("target")).distinct()
    hit = cand.join(known, ["repo_path", "target"])
    return hit.groupBy("repo_path", "source", "line", "base").agg(F.min_by("target", "ord").alias("target")).select("repo_path", "source", "target", "line")


def import_chain(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """Edges met when expanding ``starts(node)``: ``(from_file, to_file, depth, truncated)``.

    depth counts levels from 1; truncated marks an edge to a file met at the same or an earlier level (a circle or a second path), which is not
    expanded again. Levels are breadth first. The edges are written once and read by every level.
    """
    edges = materialise(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")
    seen = materialise(starts.select("node").distinct().withColumn("depth", F.lit(0)), "chain")
    frontier, out = seen, []
    for d in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("source")).join(edges, "source")
        flagged = step.join(seen.select(F.col("node").alias("target"), F.lit(True).alias("old")), "target", "left")
        level = materialise(flagged.select(F.col("source").alias("from_file"), F.col("target").alias("to_file"), F.lit(d).alias("depth"), F.coalesce("old", F.lit(False)).alias("truncated")), "chain")
        out.append(level)
        frontier = level.where("not truncated").select(F.col("to_file").alias("node")).distinct().withColumn("depth", F.lit(d))
        seen = materialise(seen.unionByName(frontier), "chain")
    return reduce(DataFrame.unionByName, out)


def expand_imports(files: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """``(repo_path, from_file, to_file, depth, truncated)``: the import chain of ``starts(repo_path, node)``, resolved level by level.

    Only the imports of the files on the frontier are parsed and resolved, so the work grows with the chain and not with the collection. Otherwise as ``import_chain``.
    """
    from sparkloom.operators.lookups import parsed_imports

    seen = materialise(starts.select("repo_path", "node").where("node is not null").distinct(), "chain")
    frontier, empty = seen, files.sparkSession.createDataFrame([], "repo_path string, from_file string, to_file string, depth int, truncated boolean")
    out = [empty]
    for d in range(1, max_depth + 1):
        mine = files.join(frontier.withColumnRenamed("node", "file_path"), ["repo_path", "file_path"], "left_semi")
        edges = normalised_imports(files, parsed_imports(mine, "repo_path", "file_path")).select("repo_path", F.col("source").alias("from_file"), F.col("target").alias("to_file")).distinct()
        old = seen.select("repo_path", F.col("node").alias("to_file"), F.lit(True).alias("old"))
        level = materialise(edges.join(old, ["repo_path", "to_file"], "left").select("repo_path", "from_file", "to_file", F.lit(d).alias("depth"), F.coalesce("old", F.lit(False)).alias("truncated")), "chain")
        out.append(level)
        frontier = level.where("not truncated").select("repo_path", F.col("to_file").alias("node")).distinct()
        if frontier.isEmpty():
            break
        seen = materialise(seen.unionByName(frontier), "chain")
    return reduce(DataFrame.unionByName, out)


def boundary_chain(
    edges: DataFrame, files: DataFrame, starts: DataFrame, max_depth: int = 3, workspace_depth: int = 1, respect_workspace: bool = True, respect_service: bool = True
) -> DataFrame:
    """Files met when expanding ``starts(node)`` within boundaries: ``(file_path, imported_from, depth, circular, truncated, reason, cross_workspace, cross_service)``.

    ``edges(source, target)`` are resolved imports, ``files(file_path, workspace_id, service_id)`` the known files. A path once past another service
    may go no deeper than the levels it has spent in it; one past another workspace no deeper than ``workspace_depth``. Rows over the limit have the reason ``boundary_crossed`` or
    ``depth_limit``, files met before ``depth_limit`` with circular, unknown ones ``external_dependency``. Of several paths that reach a file on one level the
    one from the smallest file is expanded, the others are circular. Null ids are no boundary.
    """
    edges = materialise(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")
    known = materialise(files.select("file_path", F.col("workspace_id").alias("ws"), F.col("service_id").alias("svc")).where("file_path is not null").dropDuplicates(["file_path"]), "known")
    at = starts.select(F.col("node").alias("file_path")).where("file_path is not null").distinct()
    no, zero, none = F.lit(False), F.lit(0), F.lit(None).cast("string")
    frontier = at.select("file_path", none.alias("imported_from"), none.alias("pws"), none.alias("psvc"), no.alias("cw"), no.alias("cs"), zero.alias("dw"), zero.alias("ds"))
    seen, out = None, []
    for d in range(max_depth + 2):
        old = seen if seen is not None else known.limit(0).select("file_path")
        x = frontier.join(known.withColumn("known", F.lit(True)), "file_path", "left").join(old.select("file_path", F.lit(True).alias("old")), "file_path", "left")
        first = F.row_number().over(Window.partitionBy("file_path").orderBy(F.col("imported_from").asc_nulls_first())) == 1
        limit = F.when(F.lit(respect_service) & F.col("cs"), F.least(F.lit(max_depth), F.col("ds"))).when(F.lit(respect_workspace) & F.col("cw"), F.least(F.lit(max_depth), F.lit(workspace_depth))).otherwise(F.lit(max_depth))
        x = x.withColumn("circular", F.coalesce("old", no)).withColumn("over", ~F.col("circular") & (F.lit(d) > limit))
        x = x.withColumn("late", ~F.col("circular") & ~F.col("over") & ~first & F.col("known").isNotNull()).withColumn("circular", F.col("circular") | F.col("late"))
        live = ~F.col("circular") & ~F.col("over") & F.col("known").isNotNull()
        moved_w, moved_s = (F.coalesce(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(p)), no) for c, p in (("ws", "pws"), ("svc", "psvc")))
        state = {"cw": F.col("cw"), "cs": F.col("cs"), "dw": zero, "ds": zero}
        if d:
            state = {"cw": F.col("cw") | moved_w, "cs": F.col("cs") | moved_s, "dw": F.when(moved_w, 0).otherwise(F.col("dw") + 1), "ds": F.when(moved_s, 0).otherwise(F.col("ds") + 1)}
        reason = F.when(F.col("circular"), "depth_limit").when(F.col("over"), F.when(F.col("cw") | F.col("cs"), "boundary_crossed").otherwise("depth_limit")).when(F.col("known").isNull(), "external_dependency")
        level = materialise(
            x.select("file_path", "imported_from", F.lit(d).alias("depth"), "circular", (~live).alias("truncated"), reason.alias("reason"), *[F.when(live, v).otherwise(F.col(k)).alias(k) for k, v in state.items()], "ws", "svc"), "boundary"
        )
        out.append(level.select("file_path", "imported_from", "depth", "circular", "truncated", "reason", F.col("cw").alias("cross_workspace"), F.col("cs").alias("cross_service")))
        mine = level.where("not truncated")
        seen = mine.select("file_path") if seen is None else seen.unionByName(mine.select("file_path"))
        frontier = mine.select(F.col("file_path").alias("source"), F.col("ws").alias("pws"), F.col("svc").alias("psvc"), "cw", "cs", "dw", "ds").join(edges, "source").select(F.col("target").alias("file_path"), F.col("source").alias("imported_from"), "pws", "psvc", "cw", "cs", "dw", "ds")
        if d <= max_depth and mine.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def file_context_chain(edges: DataFrame, files: DataFrame, start: str, max_levels: int) -> DataFrame:
    """``(file_path, depth, file_summary, exports)`` of the known files within ``max_levels`` levels of imports, the start being level 0."""
    one = files.sparkSession.createDataFrame([(start,)], "node string")
    reach = bfs(edges, one, max_levels - 1) if max_levels > 1 else one.select("node", F.lit(0).alias("depth"))
    f = files.select(F.col("file_path").alias("node"), F.coalesce("file_summary", F.lit("")).alias("file_summary"), F.coalesce("exports", F.array().cast("array<string>")).alias("exports")).dropDuplicates(["node"])
    return reach.where(F.lit(max_levels > 0)).join(f, "node").select(F.col("node").alias("file_path"), "depth", "file_summary", "exports")


def paths_without_cycles(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Every path of at most ``max_depth`` edges from ``starts(node)``: ``(path, depth, cyclic)``; one that meets a node of its own again ends there and is cyclic."""
    edges = materialise(edges.select("source", "target").distinct(), "edges")
    level = starts.select(F.array("node").alias("path"), F.lit(False).alias("cyclic"))
    out = [level.withColumn("depth", F.lit(0))]
    for d in range(1, max_depth + 1):
        step = level.where("not cyclic").withColumn("source", F.element_at("path", -1)).join(edges, "source")
        level = materialise(step.select(F.concat("path", F.array("target")).alias("path"), F.array_contains(F.col("path"), F.col("target")).alias("cyclic")), "paths")
        out.append(level.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, out).select("path", "depth", "cyclic")


def expand_scope(edges: DataFrame, starts: DataFrame, max_depth: int, excluded: DataFrame | None = None) -> DataFrame:
    """``(node)``: the scope walk that adds neighbours before it looks at the depth, so one hop more than ``max_depth``; excluded nodes are neither added nor passed."""
    return bfs(edges, starts, max_depth + 1, excluded).select("node").distinct()


def neighbours(edges: DataFrame, node: str, reverse: bool = False) -> DataFrame:
    a, b = ("target", "source") if reverse else ("source", "target")
    return edges.where(F.col(a) == node).select(F.col(b).alias("node")).distinct()


def depth_scoped(rows: DataFrame, depths: DataFrame, key: str, order: Sequence, limit: int) -> DataFrame:
    """Rows of the reached nodes, nearer nodes first, then by ``order``; ``depths`` is the reach of a bounded walk."""
    near = depths.groupBy("node").agg(F.min("depth").alias("dependency_depth")).withColumnRenamed("node", key)
    return rows.join(near, key).orderBy("dependency_depth", *order).limit(limit)
