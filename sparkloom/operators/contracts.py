"""Service contracts: calls matched to endpoints, endpoints to code, aliases to packages, and what is left unmatched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import stem, url_path

#: Confidence of each way to link an endpoint to its code, in the order tried.
LINK_CONFIDENCE = {"operation_id": 0.95, "decorator": 0.85, "route": 0.8, "file_path": 0.7, "function_name": 0.6}


def normal_path(p: Column) -> Column:
    """Path with parameters alike: ``:id``, ``{id}``, ``<id>``, ``${id}`` and numbers become ``{}``; no slash at the end."""
    x = F.regexp_replace(url_path(p), r"\$?\{[^}/]*\}|:[A-Za-z_]\w*|<[^>/]*>|(?<=/)\d+(?=/|$)", "{}")
    return F.when(F.char_length(x) > 1, F.regexp_replace(x, r"/+$", "")).otherwise(x)


def match_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``calls(call_id, method, target)`` with the ``endpoint_id`` and ``service_id`` of the endpoint of the same method and path, else nulls.

    Of several endpoints with one method and path the largest id is taken. A null method matches any.
    """
    e = endpoints.select(F.upper("method").alias("m"), normal_path(F.col("path")).alias("p"), F.col("id").alias("endpoint_id"), "service_id")
    exact = e.groupBy("m", "p").agg(F.max(F.struct("endpoint_id", "service_id")).alias("e1"))
    any_method = e.groupBy("p").agg(F.max(F.struct("endpoint_id", "service_id")).alias("e2"))
    c = calls.select("call_id", "target", F.upper("method").alias("m"), normal_path(F.col("target")).alias("p"))
    out = c.join(exact, ["m", "p"], "left").join(any_method, "p", "left")
    hit = F.when(F.col("m").isNull(), F.col("e2")).otherwise(F.col("e1"))
    return out.select("call_id", "target", hit["endpoint_id"].alias("endpoint_id"), hit["service_id"].alias("service_id"))


def contract_warnings(matched: DataFrame, endpoints: DataFrame, linked: DataFrame) -> DataFrame:
    """One row each of (type, severity, n) where n > 0: deprecated endpoints called, calls without an endpoint, endpoints without code."""
    called = endpoints.join(matched.where("endpoint_id is not null").select(F.col("endpoint_id").alias("id")).distinct(), "id", "left_semi")
    rows = [
        (called.where("deprecated"), "deprecated_api", "warning"), (matched.where("endpoint_id is null"), "unresolved_call", "info"),
        (endpoints.join(linked.select(F.col("endpoint_id").alias("id")).distinct(), "id", "left_anti"), "unlinked_endpoint", "info"),
    ]
    out = None
    for df, kind, severity in rows:
        r = df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "n")
        out = r if out is None else out.unionByName(r)
    return out


def _names(text: Column) -> Column:
    """Lower-cased names and their beginnings at each capital or underscore: ``getUserById`` gives getuserbyid, getuserby and getuser."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w{2,})"), F.lit(1)))
    heads = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.transform(F.sequence(F.lit(3), F.greatest(F.char_length(w) - 1, F.lit(3))), lambda n: F.when(F.substring(w, n + 1, F.lit(1)).rlike("[A-Z_]"), F.substring(w, F.lit(1), n))), lambda x: x.isNotNull()))))
    return F.array_distinct(F.transform(heads, lambda x: F.regexp_replace(F.lower(x), "_", "")))


def link_implementations(endpoints: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """``(endpoint_id, chunk_id, strategy, confidence)``: the best code chunk of each endpoint of a repository.

    ``endpoints(id, repo_id, method, path, operation_id)``, ``chunks(id, repo_id, file_path, content)``. The ways are tried in the order of
    LINK_CONFIDENCE; of equal ones the smaller chunk id wins. Null and empty operation ids name nothing. What a chunk defines, the routes it quotes, the parts of its
    path and its names are extracted once, and endpoints meet them by equality: no endpoint is tested against every chunk of its repository.

    operation_id: a definition of that name. decorator, route: the quoted path, beside ``@verb`` or ``.route(``, or ``.verb(``. file_path: a part of the path is the
    resource (the path's last constant part), and the verb occurs. function_name: a name begins with verb and resource.
    """
    last = F.regexp_extract(F.regexp_replace("path", r"/[:{<][^/]*", ""), r"([^/]+)/?$", 1)
    e = endpoints.select(F.col("id").alias("endpoint_id"), "repo_id", F.lower("method").alias("verb"), "path", F.nullif("operation_id", F.lit("")).alias("operation_id"), F.lower(last).alias("resource"))
    c = chunks.select(F.col("id").alias("chunk_id"), "repo_id", F.lower("file_path").alias("file"), "content", F.lower("content").alias("low"))
    one = lambda col: F.explode(F.array_distinct(col))
    defined = c.select("repo_id", "chunk_id", one(F.regexp_extract_all("content", F.lit(r"\b(?:async\s+)?(?:function|def|func|fn|async)\s+(\w+)"), F.lit(1))).alias("operation_id"))
    verbs = F.filter(F.array(*[F.lit(v) for v in ("get", "post", "put", "patch", "delete", "head", "options", "query", "mutation")]), lambda v: F.col("low").contains(v))
    routed = c.select("repo_id", "chunk_id", F.col("low").contains(".route(").alias("any_verb"), F.filter(verbs, lambda v: F.col("low").contains(F.concat(F.lit("@"), v))).alias("marked"), F.filter(verbs, lambda v: F.col("low").contains(F.concat(F.lit("."), v, F.lit("(")))).alias("called"), one(F.regexp_extract_all("content", F.lit(r"['\"](/[^'\"\n]*)['\"]"), F.lit(1))).alias("path"))
    placed = c.select("repo_id", "chunk_id", verbs.alias("verbs"), one(F.split("file", r"[/._-]+")).alias("resource"))
    named = c.select("repo_id", "chunk_id", F.explode(_names(F.col("content"))).alias("name"))
    by_route = e.join(routed, ["repo_id", "path"])
    own = F.concat("verb", F.regexp_replace("resource", "[^a-z0-9]", ""))
    ways = {
        "operation_id": e.join(defined, ["repo_id", "operation_id"]), "decorator": by_route.where(F.col("any_verb") | F.expr("array_contains(marked, verb)")), "route": by_route.where(F.expr("array_contains(called, verb)")),
        "file_path": e.where("resource <> ''").join(placed, ["repo_id", "resource"]).where(F.expr("array_contains(verbs, verb)")), "function_name": e.where("resource <> ''").withColumn("name", own).join(named, ["repo_id", "name"]),
    }
    found = reduce(DataFrame.unionByName, [df.select("endpoint_id", "chunk_id", F.lit(n).alias("strategy"), F.lit(LINK_CONFIDENCE[n]).alias("confidence")) for n, df in ways.items()])
    best = found.where(F.col("confidence") >= least).groupBy("endpoint_id").agg(F.min_by(F.struct("chunk_id", "strategy", "confidence"), F.struct(-F.col("confidence"), F.col("chunk_id"))).alias("b"))
    return best.select("endpoint_id", "b.chunk_id", "b.strategy", "b.confidence")


def contract_links(endpoints: DataFrame, links: DataFrame, services: DataFrame) -> DataFrame:
    """Endpoints per service with the code they are linked to: ``(service_id, service_name, endpoints, linked)``."""
    e = endpoints.select(F.col("id").alias("endpoint_id"), "service_id").join(links.select("endpoint_id", "chunk_id"), "endpoint_id", "left")
    n = e.groupBy("service_id").agg(F.count("*").alias("endpoints"), F.count("chunk_id").alias("linked"))
    return n.join(services.select("service_id", "service_name"), "service_id", "left")


def resolve_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """``imports(repo_id, import_path)`` with ``resolved_path``: the first alias pattern (by ``ordinal``) that fits, ``*`` standing for the rest.

    ``aliases(repo_id, alias_pattern, resolved_path, ordinal)``. A pattern is split into what stands before and behind its star, so the
    join is one on the repository with two string tests, not one on regular expressions. Without a fitting alias resolved_path is null.
    """
    i = imports.select("repo_id", "import_path").distinct()
    a = aliases.select("repo_id", "ordinal", F.regexp_extract("alias_pattern", r"^([^*]*)", 1).alias("head"), F.regexp_extract("alias_pattern", r"\*(.*)$", 1).alias("tail"), F.col("alias_pattern").contains("*").alias("star"), F.col("resolved_path").alias("to"))
    x = i.join(a, "repo_id").where(F.when(F.col("star"), F.col("import_path").startswith(F.col("head")) & F.col("import_path").endswith(F.col("tail")) & (F.char_length("import_path") >= F.char_length("head") + F.char_length("tail"))).otherwise(F.col("import_path") == F.col("head")))
    rest = F.expr("substring(import_path, char_length(head) + 1, char_length(import_path) - char_length(head) - char_length(tail))")
    hit = x.select("repo_id", "import_path", "ordinal", F.when(F.col("star"), F.replace(F.col("to"), F.lit("*"), rest)).otherwise(F.col("to")).alias("resolved"))
    first = hit.groupBy("repo_id", "import_path").agg(F.min_by("resolved", "ordinal").alias("resolved_path"))
    return imports.join(first, ["repo_id", "import_path"], "left")


def package_of_import(path: Column) -> Column:
    """The package of an import specifier: two parts for scoped names, else the first."""
    return F.when(path.startswith("@"), F.regexp_extract(path, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(path, r"^([^/]+)", 1))


def within_boundary(edges: DataFrame, files: DataFrame, same_workspace: bool = False, same_service: bool = False, only_cross: bool = False) -> DataFrame:
    """Import edges ``(repo_path, source, target)`` kept by boundary rules; edges to files that are not known are always kept.

    ``same_workspace`` / ``same_service`` drop edges between two known, different ids (a null id is no boundary);
    ``only_cross`` keeps just those that cross one.
    """
    f = files.select("repo_path", "file_path", "workspace_id", "service_id").dropDuplicates(["repo_path", "file_path"])
    x = edges.join(f.select("repo_path", F.col("file_path").alias("source"), F.col("workspace_id").alias("sw"), F.col("service_id").alias("ss")), ["repo_path", "source"], "left")
    x = x.join(f.select("repo_path", F.col("file_path").alias("target"), F.col("workspace_id").alias("tw"), F.col("service_id").alias("ts"), F.lit(True).alias("known")), ["repo_path", "target"], "left")
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    w, s = differ("sw", "tw"), differ("ss", "ts")
    keep = F.lit(True)
    if same_workspace:
        keep = keep & ~w
    if same_service:
        keep = keep & ~s
    if only_cross:
        keep = keep & (w | s)
    return x.where(F.col("known").isNull() | keep).select("repo_path", "source", "target", w.alias("crosses_workspace"), s.alias("crosses_service"))


def merge_metadata(old: Column, new: Column) -> Column:
    """JSON objects merged key by key, the new value winning; unreadable or null ones count as empty."""
    m = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(m(old), lambda k, _: ~F.map_contains_key(m(new), k))
    return F.to_json(F.map_concat(kept, m(new)))


def update_endpoints(services: DataFrame, fresh: DataFrame) -> DataFrame:
    """``services`` with ``api_endpoints`` replaced where ``fresh(service_id, api_endpoints)`` has a value."""
    f = fresh.select("service_id", F.col("api_endpoints").alias("__new")).dropDuplicates(["service_id"])
    return services.join(f, "service_id", "left").withColumn("api_endpoints", F.coalesce("__new", "api_endpoints")).drop("__new")


def is_test_file(path: Column) -> Column:
    """Whether a path is that of a test."""
    return path.rlike(r"(^|/)(tests?|spec|__tests__)/") | stem(path).rlike(r"(_test|\.test|\.spec|^test_.*)$")
