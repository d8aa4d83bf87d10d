"""Workspaces and services of repositories, found from a table of their files: ``(repo_id, file_path, content)``.

A monorepo has thousands of manifests and a collection has many monorepos, so this is a query over all of them at once: manifests are selected by path,
parsed with built-in JSON functions, and joined to the patterns their repository's tool declares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Manifest at the root and the tool it belongs to, in the order of precedence.
TOOLS = {"pnpm-workspace.yaml": "pnpm", "package.json": "npm", "nx.json": "nx", "lerna.json": "lerna", "turbo.json": "turbo", "rush.json": "rush"}
#: Folders whose subfolders are services.
SERVICE_DIRS = ("services", "apps", "packages", "microservices")
DEFAULT_PATTERNS = {"nx": ["packages/*", "apps/*", "libs/*"], "lerna": ["packages/*"]}


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def manifests(files: DataFrame) -> DataFrame:
    """``(repo_id, folder, package_name, version, private, dependencies, dev_dependencies)`` of every package.json with a name."""
    m = F.from_json("content", "struct<name:string,version:string,private:boolean,dependencies:map<string,string>,devDependencies:map<string,string>>")
    p = files.where(_name(F.col("file_path")) == "package.json").select("repo_id", _folder(F.col("file_path")).alias("folder"), m.alias("m"))
    return p.where("m.name is not null and m.name <> ''").select("repo_id", "folder", F.col("m.name").alias("package_name"), "m.version", F.col("m.private").alias("private"), F.col("m.dependencies").alias("dependencies"), F.col("m.devDependencies").alias("dev_dependencies"))


def workspace_tools(files: DataFrame) -> DataFrame:
    """``(repo_id, tool, patterns)``: the workspace tool of each repository that has one, and its folder patterns; the first of TOOLS that declares any.

    pnpm lists patterns in YAML, npm as ``workspaces`` (an array, or an object with ``packages``), lerna as ``packages``, rush as project folders; nx has fixed folders; turbo takes those of npm.
    """
    root = files.where(~F.col("file_path").contains("/") & F.col("file_path").isin(*TOOLS)).select("repo_id", "file_path", "content")
    strings, c = "array<string>", F.col("content")
    listed = F.regexp_extract(c, r"packages:\s*\n((?:\s+-\s+.+(?:\n|$))+)", 1)
    yaml = F.filter(F.transform(F.split(listed, "\n"), lambda x: F.regexp_extract(x, r"""^\s*-\s*['"]?([^'"]+?)['"]?\s*$""", 1)), lambda x: x != "")
    npm = F.coalesce(F.from_json(F.get_json_object(c, "$.workspaces"), strings), F.from_json(F.get_json_object(c, "$.workspaces.packages"), strings))
    lerna = F.coalesce(F.from_json(F.get_json_object(c, "$.packages"), strings), F.array(*map(F.lit, DEFAULT_PATTERNS["lerna"])))
    rush = F.transform(F.from_json(F.regexp_replace(c, r"(?m)(^|\s)//.*$|/\*[\s\S]*?\*/", ""), "struct<projects:array<struct<projectFolder:string>>>")["projects"], lambda x: x["projectFolder"])
    file = F.col("file_path")
    patterns = F.when(file == "pnpm-workspace.yaml", yaml).when(file == "package.json", npm).when(file == "nx.json", F.array(*map(F.lit, DEFAULT_PATTERNS["nx"]))).when(file == "lerna.json", lerna).when(file == "rush.json", rush)
    npm_of = root.where("file_path = 'package.json'").select("repo_id", npm.alias("npm")).dropDuplicates(["repo_id"])
    found = root.select("repo_id", "file_path", patterns.alias("patterns")).join(npm_of, "repo_id", "left").withColumn("patterns", F.when(file == "turbo.json", F.col("npm")).otherwise(F.col("patterns")))
    order = F.lit(99)
    for i, f in reversed(list(enumerate(TOOLS))):
        order = F.when(file == f, i).otherwise(order)
    best = F.row_number().over(Window.partitionBy("repo_id").orderBy(order))
    tool = reduce(lambda out, kv: F.when(file == kv[0], kv[1]).otherwise(out), TOOLS.items(), F.lit(None).cast("string"))
    return found.where("size(patterns) > 0").withColumn("rn", best).where("rn = 1").select("repo_id", tool.alias("tool"), "patterns")


def workspaces(files: DataFrame) -> DataFrame:
    """``(repo_id, tool, workspace_path, package_name, version, private, dependencies, dev_dependencies)``: packages that a pattern of the repository's tool covers.

    ``dir/*`` covers the folders right below, a plain pattern the folder itself. A package covered twice is one row. Both sides meet on the folder's name, by equality.
    """
    rule = workspace_tools(files).select("repo_id", "tool", F.explode("patterns").alias("p")).select("repo_id", "tool", F.regexp_replace("p", r"^\./|/\*+$|/$", "").alias("base"), F.col("p").contains("*").alias("star"))
    m = manifests(files).withColumn("parent", _folder(F.col("folder")))
    a = m.withColumn("base", F.col("parent")).where("folder <> ''").join(rule.where("star"), ["repo_id", "base"])
    b = m.withColumn("base", F.col("folder")).join(rule.where("not star"), ["repo_id", "base"])
    out = a.unionByName(b.select(a.columns)).select("repo_id", "tool", F.col("folder").alias("workspace_path"), "package_name", "version", "private", "dependencies", "dev_dependencies")
    return out.dropDuplicates(["repo_id", "workspace_path"])


def workspace_dependencies(spaces: DataFrame) -> DataFrame:
    """``(repo_id, source, target, kind, ordinal)``: dependencies, then development dependencies, on other workspaces of the repository; one in both is two rows."""
    kinds = [("dependencies", 0), ("dev_dependencies", 1)]
    deps = reduce(DataFrame.unionByName, [spaces.select("repo_id", F.col("package_name").alias("source"), F.lit(k).alias("kind"), F.lit(i).alias("ordinal"), F.explode(F.map_keys(k)).alias("target")) for k, i in kinds])
    return deps.join(spaces.select("repo_id", F.col("package_name").alias("target")).distinct(), ["repo_id", "target"], "left_semi").select("repo_id", "source", "target", "kind", "ordinal")


def path_aliases(files: DataFrame) -> DataFrame:
    """``(repo_id, alias_pattern, resolved_path, ordinal)`` of the path aliases in each repository's tsconfig.json (comments removed), the first target of each."""
    c = F.regexp_replace("content", r"(?m)(^|\s)//.*$|/\*[\s\S]*?\*/(?!\*)", "")
    paths = F.from_json(F.get_json_object(c, "$.compilerOptions.paths"), "map<string,array<string>>")
    rows = files.where("file_path = 'tsconfig.json'").select("repo_id", F.posexplode(F.map_entries(paths)).alias("ordinal", "e"))
    return rows.select("repo_id", F.col("e.key").alias("alias_pattern"), F.try_element_at("e.value", F.lit(1)).alias("resolved_path"), "ordinal").where("resolved_path is not null")


def compose_services(files: DataFrame) -> DataFrame:
    """``(repo_id, service_name, depends_on)`` of the services in each repository's compose file (two-space YAML, lists or maps of dependencies)."""
    from sparkloom.operators.decompose import explode_texts

    def parse(text: str | None):  # noqa: ANN202
        inside, name, deps, in_deps = False, None, [], False
        for raw in (text or "").split("\n"):
            line = raw.split(" #")[0].rstrip()
            if not line.strip():
                continue
            ind = len(line) - len(line.lstrip())
            if ind == 0:
                if name:
                    yield name, ",".join(deps)
                inside, name, deps, in_deps = line.startswith("services:"), None, [], False
            elif inside and ind == 2 and line.endswith(":"):
                if name:
                    yield name, ",".join(deps)
                name, deps, in_deps = line.strip()[:-1], [], False
            elif inside and ind == 4:
                in_deps = line.strip() == "depends_on:"
                if line.strip().startswith("depends_on: ["):
                    deps += [x.strip(" '\"") for x in line.split("[", 1)[1].rstrip("] ").split(",") if x.strip()]
            elif in_deps and ind == 6:
                deps.append(line.strip().lstrip("- ").rstrip(":").strip("'\""))
        if name:
            yield name, ",".join(deps)

    compose = files.where(F.col("file_path").isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"))
    keyed = compose.select("repo_id", "content")
    out = explode_texts(keyed, ["repo_id", "content"], parse, "repo_id string, service_name string, depends_on string")
    return out.select("repo_id", "service_name", F.filter(F.split("depends_on", ","), lambda x: x != "").alias("depends_on"))


def services(files: DataFrame) -> DataFrame:
    """``(repo_id, service_name, service_path, service_type, depends_on)``: the folders right below SERVICE_DIRS, each with a type.

    The type comes from the first of: a compose service of that name (docker), a serverless or mobile manifest, an API description, the dependencies of its
    package.json (a web, GraphQL or gRPC framework, else library), unknown.
    """
    from sparkloom.sources.files import api_spec_files

    folder = F.regexp_extract("file_path", rf"^((?:{'|'.join(SERVICE_DIRS)})/[^/]+)/", 1)
    inside = files.select("repo_id", "file_path", "content", folder.alias("service_path")).where("service_path <> ''")
    rest = F.expr("substring(file_path, char_length(service_path) + 2)")
    one = inside.withColumn("rest", rest)
    spec = api_spec_files(one.select("repo_id", "service_path", "rest", F.col("file_path"))).withColumn("low", F.lower("file_path"))
    by_spec = spec.groupBy("repo_id", "service_path").agg(F.min(F.when(F.col("low").rlike(r"\.(graphql|gql)$"), F.lit("graphql")).when(F.col("low").endswith(".proto"), F.lit("grpc")).otherwise(F.lit("rest"))).alias("spec_type"))
    has = lambda *names: F.max(F.col("rest").isin(*names))
    content = lambda name, cond: F.max((F.col("rest") == name) & F.coalesce(cond, F.lit(False)))
    c = F.col("content")
    signs = one.groupBy("repo_id", "service_path").agg(
        (has("serverless.yml", "vercel.json", "netlify.toml", "cdk.json") | content("template.yaml", c.contains("AWSTemplateFormatVersion"))).alias("serverless"),
        (content("app.json", F.get_json_object(c, "$.expo").isNotNull() | F.get_json_object(c, "$.displayName").isNotNull()) | content("pubspec.yaml", c.rlike("(?m)^flutter:")) | has("capacitor.config.ts", "capacitor.config.json", "ionic.config.json")).alias("mobile"),
    )
    m = manifests(files).select("repo_id", F.col("folder").alias("service_path"), F.map_keys(F.map_concat(F.coalesce("dependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("dev_dependencies", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce("dependencies", F.create_map().cast("map<string,string>")), k), F.lit(False))))).alias("deps")).dropDuplicates(["repo_id", "service_path"])
    any_of = lambda *names: F.arrays_overlap("deps", F.array(*map(F.lit, names)))
    by_deps = F.when(any_of("express", "fastify", "koa"), "rest").when(any_of("@apollo/server", "graphql", "@nestjs/graphql"), "graphql").when(any_of("@grpc/grpc-js", "grpc"), "grpc").when(F.col("deps").isNotNull(), "library")
    docker = compose_services(files).withColumnRenamed("service_name", "name").withColumn("docker", F.lit(True)).dropDuplicates(["repo_id", "name"])
    x = signs.join(by_spec, ["repo_id", "service_path"], "left").join(m, ["repo_id", "service_path"], "left").withColumn("name", _name(F.col("service_path"))).join(docker, ["repo_id", "name"], "left")
    kind = F.when(F.col("docker"), "docker").when(F.col("serverless"), "serverless").when(F.col("mobile"), "mobile").otherwise(F.coalesce("spec_type", by_deps, F.lit("unknown")))
    return x.select("repo_id", F.col("name").alias("service_name"), "service_path", kind.alias("service_type"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
