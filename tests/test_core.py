"""Core operators on small cases, and every SQL twin on the smallest test tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import api
from sparkloom.functions import fts, parse
from sparkloom.functions import text as T
from sparkloom.functions.vector import cosine, l2, literal_vector
from sparkloom.functions.wordhash import distinct_per_text, shingles, word_hashes
from sparkloom.operators import assembly, contracts, decompose, graph, incremental, metrics, retrieval
from sparkloom.operators.components import connected_components
from sparkloom.plans import catalog
from sparkloom.sources import files
from sparkloom.operators.versioned import Store
from sparkloom.streaming.watch import watch_parquet

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def plain(rows):
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".") if v == v else None
        return None if v is None else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0])], "id int, v array<float>")
    q = literal_vector([2.0, 0.0])
    got = {r.id: r.c for r in df.select("id", cosine(F.col("v"), q).alias("c")).collect()}
    assert got[1] == 1 and abs(got[2] - 0.5**0.5) < 1e-9 and [got[i] for i in (3, 4, 5, 6)] == [None] * 4
    assert {r.id: r.d for r in df.select("id", l2(F.col("v"), q).alias("d")).where("id < 3").collect()} == {1: 1.0, 2: 2**0.5}
    assert [r.id for r in retrieval.vector_topk(df, "id", "v", [1.0, 0.2], 5).collect()] == [1, 2]
    assert retrieval.scope(df, id=[]).count() == 0 and retrieval.scope(df, id=None).count() == 6


def test_word_hashes_find_words_and_shingles():
    texts = ["Über a_B 12, x!", "", None, "a a a a", "a a a"]
    h, off = word_hashes(texts)
    assert np.diff(off).tolist() == [4, 0, 0, 4, 3] and len(set(h[off[3] :].tolist())) == 1
    s, so = distinct_per_text(*shingles(h, off, 3))
    assert np.diff(so).tolist() == [2, 0, 0, 1, 1] and s[so[3]] == s[so[4]]


def test_cover_density():
    assert fts.covers("a quick parser of the channel", {"parser", "channel"}) == pytest.approx(0.1)
    assert fts.covers("parser x y channel parser", {"parser", "channel"}) == pytest.approx(0.1 + 0.1 / 3)  # two minimal covers
    assert fts.covers("parser only", {"parser", "channel"}) == 0 and fts.covers(None, {"a", "b"}) == 0
    assert fts.query_terms("the Channel & (parser)") == ["channel", "parser"]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5), (6, 7), (1, None)], "source bigint, target bigint")
    start = spark.createDataFrame([(1,)], "node bigint")
    assert {tuple(r) for r in graph.bfs(e, start, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {tuple(r) for r in graph.bfs(e, start, 9, spark.createDataFrame([(4,), (1,)], "node bigint")).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graph.bfs(e, start, 0).count() == 1
    chain = {(r.from_file, r.to_file, r.depth, r.truncated) for r in graph.import_chain(e.where("target is not null"), start, 4).collect()}
    assert (3, 1, 3, True) in chain and (4, 4, 4, True) in chain and (4, 5, 4, False) in chain
    cc = {r.node: r.component for r in connected_components(e.select(F.col("source").alias("u"), F.col("target").alias("v"))).collect()}
    assert cc == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    long = connected_components(spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert long.select("component").distinct().count() == 1 and long.count() == 301


def test_import_resolution(spark):
    f = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/util/b.ts"), ("r", "src/util/index.ts"), ("r", "pkg/m.py")], "repo_path string, file_path string")
    i = spark.createDataFrame([("r", "src/a.ts", "./util/b", 1), ("r", "src/a.ts", "./util", 2), ("r", "src/util/b.ts", "../a", 3), ("r", "src/a.ts", "lodash", 4), ("r", "pkg/x.py", ".m", 5)], "repo_path string, file_path string, import_path string, import_line int")
    got = {(r.source, r.target) for r in graph.normalised_imports(f, i).collect()}
    assert got == {("src/a.ts", "src/util/b.ts"), ("src/a.ts", "src/util/index.ts"), ("src/util/b.ts", "src/a.ts"), ("pkg/x.py", "pkg/m.py")}


def test_greedy_dedup(spark):
    rows = [(1, [1.0, 0.0], 0.9), (2, [1.0, 0.01], 0.8), (3, [0.0, 1.0], 0.7), (4, None, 0.6), (5, [0.0, 0.0], 0.5), (6, [0.0, 2.0], 0.4)]
    out = {r.id: r.duplicate_of for r in assembly.greedy_dedup(spark.createDataFrame(rows, "id bigint, v array<double>, s double"), "id", "v", "s").collect()}
    assert {k: (None if v is None or v != v else int(v)) for k, v in out.items()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 3}


def test_changes_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k bigint, h string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d"), (4, "d")], "k bigint, h string")
    got = {(r.k, r.status) for r in incremental.detect_changes(new, old, ["k"], "h").collect()}
    assert got == {(1, "deleted"), (2, "modified"), (3, "unchanged"), (4, "new")}
    assert {tuple(r) for r in incremental.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    assert {tuple(r) for r in incremental.insert_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, None), (4, "d")}
    path = str(tmp_path / "t")
    incremental.replace_table(old, path)
    incremental.replace_table(incremental.upsert(spark.read.parquet(path), new, ["k"]), path)
    assert spark.read.parquet(path).count() == 4


def test_stream_upserts(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, h string").write.parquet(src)
    watch_parquet(spark, src, "k bigint, h string", dst, ["k"], cp).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "k bigint, h string").write.mode("append").parquet(src)
    watch_parquet(spark, src, "k bigint, h string", dst, ["k"], cp).awaitTermination()
    assert {tuple(r) for r in Store(spark, dst).read("rows").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_versioned_store(spark, tmp_path):
    st = Store(spark, "file://" + str(tmp_path / "s"), buckets=4)
    a = spark.createDataFrame([(k, str(k)) for k in range(20)], "k bigint, v string")
    st.replace({"a": (a, ["k"]), "b": (a.limit(0), ["k"])})
    before = st.read("a")
    st.merge({"a": spark.createDataFrame([(1, "x"), (50, "y")], "k bigint, v string"), "b": a.limit(2)})
    assert before.count() == 20 and {r.v for r in st.read("a").where("k in (1, 50)").collect()} == {"x", "y"} and st.read("a").count() == 21 and st.read("b").count() == 2
    st.merge({"a": spark.createDataFrame([(1, "z"), (60, "w")], "k bigint, v string")}, ignore_known=True)
    st.remove({"a": spark.createDataFrame([(2,)], "k bigint")})
    assert {r.k: r.v for r in st.read("a").where("k in (1, 2, 60)").collect()} == {1: "x", 60: "w"} and st.tables() == ["a", "b"]
    assert st.vacuum() >= 0 and st.read("a").count() == 21 and st.vacuum() == 0


def test_metrics(spark):
    res = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7)], "q int, i int, s double")
    exp = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "q int, i int")
    got = {r.q: (round(r.precision, 3), r.recall, r.reciprocal_rank) for r in metrics.retrieval_quality(res, exp, "q", "i", "s").collect()}
    assert got == {1: (0.333, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}
    v = spark.range(100).selectExpr("'g' g", "cast(id as double) v").unionByName(spark.createDataFrame([("h", 5.0), ("h", None)], "g string, v double"))
    assert {r.g: (r.p50, r.p99) for r in metrics.floor_percentiles(v, "g", "v", {"p50": 0.5, "p99": 0.99}).collect()} == {"g": (50.0, 99.0), "h": (5.0, 5.0)}


SOURCES = {
    "typescript": ("import { a, b } from './x';\nimport './side';\nexport class K {\n  run(a: string): void {\n  }\n}\nexport const f = (x) => {\n};\ninterface I {}\n", {("class", "K"), ("function", "run"), ("function", "f"), ("interface", "I")}, ["./x", "./side"]),
    "python": ("import os, re\nfrom .m import x\nclass A:\n    def go(self):\n        pass\nasync def top():\n    pass\n", {("class", "A"), ("function", "go"), ("function", "top")}, ["os", ".m"]),
    "java": ("import java.util.List;\npublic class A {\n  public int go(int a) {\n    return 1;\n  }\n}\n", {("class", "A"), ("function", "go")}, ["java.util.List"]),
    "go": ('import (\n\t"fmt"\n\tx "net/http"\n)\ntype S struct {\n}\nfunc (s *S) Go() {\n}\n', {("class", "S"), ("function", "Go")}, ["fmt", "net/http"]),
    "rust": ("use std::io::{Read, Write};\npub struct P {\n}\nimpl P {\n    pub fn go(&self) {\n    }\n}\n", {("class", "P"), ("function", "go")}, ["std::io"]),
    "ruby": ("require 'set'\nclass A\n  def go\n  end\nend\n", {("class", "A"), ("function", "go")}, ["set"]),
    "cobol": ("function foo()\nclass Bar\n", {("function", "foo"), ("class", "Bar")}, []),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_parse(lang):
    text, want, imports = SOURCES[lang]
    assert {(n.kind, n.name) for n in parse.nodes(text, lang)} == want
    assert [i.path for i in parse.imports(text.split("\n"), lang)] == imports


def test_chunks_cover_the_kinds():
    body = "\n".join(f"    x{i} = {i}" for i in range(12))
    text = "import a\nimport b\nimport c\n\ndef f():\n" + body + "\n\n" + "\n".join(f"V{i} = {i}" for i in range(60)) + "\n"
    kinds = [c[0] for c in parse.chunk_file(text, "python")]
    assert kinds == ["file_summary", "import_block", "function", "block"] and parse.chunk_file("", "python") == []
    assert [c[0] for c in parse.chunk_file("x = 1\n" * 6000, "python")] == ["file_summary"]


def test_markdown_and_specs():
    md = '---\ntitle: T\ndraft: true\ntags: ["a", "b"]\n---\n# One\ntext\n### Deep\n```py\nx\n```\n## Two\n```\nopen'
    assert parse.front_matter(md) == ({"title": "T", "draft": True, "tags": ["a", "b"]}, 5)
    assert [(s[0], s[2]) for s in parse.sections(md)] == [(1, "One"), (3, "One > Deep"), (2, "One > Two")]
    assert [(b[0], b[3]) for b in parse.code_blocks(md)] == [("py", "x")]
    assert parse.api_spec("a.json", '{"openapi": "3", "paths": {"/u": {"get": {}, "post": {"deprecated": true}}}}') == [("rest", "GET", "/u", False), ("rest", "POST", "/u", True)]
    assert parse.api_spec("a.graphql", "type Query {\n  user(id: ID!): User\n}") == [("graphql", "QUERY", "user", False)]
    assert parse.api_spec("a.proto", "service S {\n  rpc Get(A) returns (B);\n}\n") == [("grpc", "RPC", "S/Get", False)] and parse.api_spec("a.json", "{") == []
    assert parse.endpoints("app.get('/a', h)\n@Post('b')\n") == [("express", "GET", "/a", 1), ("nest", "POST", "b", 2)]


def test_decompose(spark):
    df = spark.createDataFrame([(1, "x\nfetch('/api/a')\naxios.get(`/b`)"), (2, None), (3, "")], "id bigint, t string")
    assert {(r.line, r.style, r.target) for r in decompose.api_calls(df, "id", "t").collect()} == {(2, "fetch", "/api/a"), (3, "axios", "/b")}
    w = spark.createDataFrame([(1, "\n".join(map(str, range(50))))], "id bigint, t string")
    assert [(r.start_line, r.end_line) for r in decompose.sliding_windows(w, "id", "t", 20, 5).collect()] == [(1, 20), (16, 35), (31, 50)]
    assert decompose.truncated(w, "id", "t", 2, 1).first().content == "0\n1\n... truncated ...\n49"


def test_discovery(spark, tmp_path):
    for p, b in {"src/a.py": b"x = 1\n", "src/b.py": "ä".encode("latin-1"), "src/skip.py": b"y", "node_modules/m.js": b"z", "img.png": b"\x89PNG", ".env": b"K=1", "README.md": b"# R", "docs/x.md": b"# X", "src/z.bin.py": b"\x00\x00\x00\x01" * 9, "src/t.min.js": b"1"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    got = {r.file_path: (r.encoding, r.language) for r in files.discover(spark, str(tmp_path), ["skip.py", "# note"]).collect()}
    assert got == {"src/a.py": ("utf-8", "python"), "src/b.py": ("latin-1", "python"), "README.md": ("utf-8", "markdown")}
    out = api.index_repository(spark, str(tmp_path))
    assert out["chunks"].where("chunk_type = 'file_summary'").count() == out["files"].count()
    assert api.index_repository(spark, str(tmp_path), out["files"])["chunks"].count() == 0
    (tmp_path / "package.json").write_text('{"name": "root", "workspaces": ["packages/*"]}')
    (tmp_path / "packages/one").mkdir(parents=True)
    (tmp_path / "packages/one/package.json").write_text('{"name": "@x/one"}')
    (tmp_path / ".gitignore").write_text("src/b.py\n")
    (tmp_path / "docs/openapi.yaml").write_text("openapi: 3\n")
    again = api.index_repository(spark, str(tmp_path), repo_id="r")
    assert [r.package_name for r in again["workspaces"].collect()] == ["@x/one"] and {r.service_path for r in again["services"].collect()} == {"packages/one"}
    assert "src/b.py" not in {r.file_path for r in again["files"].collect()} and again["summaries"].where("file_summary like 'This file%.'").count() == again["files"].count()
    listed = files.listing(spark, str(tmp_path))
    assert [r.file_path for r in files.api_spec_files(listed).collect()] == ["docs/openapi.yaml"] and {r.file_path for r in files.markdown_files(listed).collect()} == {"README.md", "docs/x.md"}
    assert [p.rsplit("/", 1)[-1] for p in files.resolve_paths(spark, [str(tmp_path / "docs"), str(tmp_path / "gone.md")])] == ["x.md", "gone.md"]
    assert files.detect(b"\xff\xfea\x00")[0] == "utf-16-le" and files.detect(b"\xef\xbb\xbfx") == ("utf-8", 1.0, "x")


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/x.log",), ("keep/x.log",), ("build/y.py",), ("src/build.py",)], "p string")
    got = [r.p for r in df.where(~files.ignored(F.col("p"), ["*.log", "!keep/x.log", "build/"])).collect()]
    assert got == ["keep/x.log", "src/build.py"]


def test_contracts(spark):
    e = spark.createDataFrame([(1, "s1", "r", "GET", "/users/{id}", "getUser", None), (2, "s1", "r", "POST", "/users", None, True), (3, "s2", "r", "GET", "/gone", "", False)], "id bigint, service_id string, repo_id string, method string, path string, operation_id string, deprecated boolean")
    calls = spark.createDataFrame([(1, "get", "https://h.example/users/42?x=1"), (2, "POST", "/users/"), (3, None, "/users/:id"), (4, "GET", "/none"), (5, None, None)], "call_id bigint, method string, target string")
    m = contracts.match_calls(calls, e)
    assert {r.call_id: r.endpoint_id for r in m.collect()} == {1: 1, 2: 2, 3: 1, 4: None, 5: None}
    c = spark.createDataFrame([(10, "r", "src/a.ts", "async function getUser(id) {}"), (11, "r", "src/b.ts", "app.post('/users', save)"), (12, "q", "src/gone.ts", "get gone")], "id bigint, repo_id string, file_path string, content string")
    links = contracts.link_implementations(e, c)
    assert {(r.endpoint_id, r.chunk_id, r.strategy) for r in links.collect()} == {(1, 10, "operation_id"), (2, 11, "route")}
    assert {(r.type, r.n) for r in contracts.contract_warnings(m, e, links).collect()} == {("deprecated_api", 1), ("unresolved_call", 2), ("unlinked_endpoint", 1)}
    s = spark.createDataFrame([("s1", "users"), ("s2", None)], "service_id string, service_name string")
    assert {(r.service_id, r.endpoints, r.linked) for r in contracts.contract_links(e, links, s).collect()} == {("s1", 2, 2), ("s2", 1, 0)}


def test_aliases_and_boundaries(spark):
    i = spark.createDataFrame([("r", "@/util/a"), ("r", "@lib"), ("r", "x"), ("q", "@/util/a")], "repo_id string, import_path string")
    a = spark.createDataFrame([("r", "@/*", "src/*", 2), ("r", "@/util/*", "shared/*", 1), ("r", "@lib", "lib/index", 3)], "repo_id string, alias_pattern string, resolved_path string, ordinal int")
    assert {(r.repo_id, r.import_path, r.resolved_path) for r in contracts.resolve_aliases(i, a).collect()} == {("r", "@/util/a", "shared/a"), ("r", "@lib", "lib/index"), ("r", "x", None), ("q", "@/util/a", None)}
    f = spark.createDataFrame([("p", "a", "w1", None), ("p", "b", "w2", None), ("p", "c", None, None)], "repo_path string, file_path string, workspace_id string, service_id string")
    e = spark.createDataFrame([("p", "a", "b"), ("p", "a", "c"), ("p", "a", "zz")], "repo_path string, source string, target string")
    assert {r.target for r in contracts.within_boundary(e, f, same_workspace=True).collect()} == {"c", "zz"}
    assert {r.target for r in contracts.within_boundary(e, f, only_cross=True).collect()} == {"b", "zz"}
    m = spark.createDataFrame([('{"a": "1", "b": "2"}', '{"b": "3"}'), (None, '{"c": "4"}'), ("{bad", None)], "o string, n string")
    assert [r[0] for r in m.select(contracts.merge_metadata(F.col("o"), F.col("n"))).collect()] == ['{"a":"1","b":"3"}', '{"c":"4"}', "{}"]
    p = spark.createDataFrame([("@a/b/c",), ("lodash/x",)], "p string")
    assert [r[0] for r in p.select(contracts.package_of_import(F.col("p"))).collect()] == ["@a/b", "lodash"]


def test_text_functions(spark):
    df = spark.createDataFrame([("src/App.test.TS", "https://h.example/a/b?q=1", "")], "p string, u string, e string")
    r = df.select(T.extension(F.col("p")).alias("x"), T.stem(F.col("p")).alias("s"), T.language(F.col("p")).alias("l"), T.url_path(F.col("u")).alias("u"), T.line_count(F.col("e")).alias("n"), T.clean_summary(F.lit("Parses   the input")).alias("c")).first()
    assert (r.x, r.s, r.l, r.u, r.n) == (".ts", "App.test", "typescript", "/a/b", 0) and r.c == "This file Parses the input for code organization for code organization."


@needs_data
def test_tools(spark):
    cat = api.open_catalog(spark, SF)
    res = api.search_codebase(cat, "token channel parser", api.SearchOptions(max_files=5, max_snippets=4, file_threshold=0.0, chunk_threshold=0.0, import_depth=1))
    assert res.files.count() <= 5 and res.chunks.count() <= 4 and res.symbols.columns and res.imports.columns and res.warnings.columns
    assert api.list_indexed_repos(cat).count() == 48 and api.list_services(cat, ["rest"]).count() >= 1
    path = cat["code_files"].select("file_path").first()[0]
    assert api.get_file_context(cat, path)["file"].count() == 1 and api.get_file_context(cat, "no/such")["chunks"].count() == 0
    left, counts = api.delete_repository(cat, "hibjol-root")
    assert left["code_files"].where("repo_id = 'hibjol-root'").count() == 0 and counts.count() == 7
    assert api.find_symbol_definition(cat, "a").count() > 0 and api.index_documentation(cat["documents"])["sections"].count() > 0
    with pytest.raises(ValueError, match="short"):
        api.search_codebase(cat, " ")


def test_api_calls_of_every_style(spark):
    want = {
        "axios({ method: 'get', url: '/a' })": ("axios_config", "/a"), "axios.head('/h')": ("axios", "/h"), "got('/b')": ("got", "/b"), "superagent('/s')": ("got", "/s"), "https.get('https://c')": ("node_http", "https://c"),
        "httpx.post('/d')": ("httpx", "/d"), "await session.get('/e')": ("session", "/e"), 'http.NewRequest("GET", "/f", nil)': ("http_new_request", "/f"), 'http.Put("/p")': ("http_get", "/p"), 'restTemplate.delete("/g")': ("java_client", "/g"),
        'reqwest::get("/h2")': ("reqwest", "/h2"), "new UserClient('host:50051')": ("grpc", "host:50051"), "new OrderClient(x)": ("grpc", ""), "a_pb2_grpc.AStub(grpc.insecure_channel('h:1'))": ("grpc_stub", "h:1"), 'grpc.Dial("h:2")': ("grpc_dial", "h:2"),
        "query: gql`query Items { id }`": ("graphql", "Items"), "useQuery(x)": ("graphql", ""), "requests.options('/o')": ("requests", "/o"), "budget('/no')": None,
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(want)], "id int, t string")
    got = {r.id: (r.style, r.target) for r in decompose.api_calls(df, "id", "t").collect()}
    assert [got.get(k) for k in range(len(want))] == list(want.values()) and decompose.api_calls(df, "id", "t").count() == len(want) - 1


def test_greedy_dedup_in_rounds_equals_the_fold(spark):
    import numpy as np

    from sparkloom.operators import assembly

    r = np.random.default_rng(4)
    base = r.standard_normal((12, 8))
    rows = [(i, [float(x) for x in base[r.integers(0, 12)] + 0.35 * r.standard_normal(8)], float(r.integers(0, 9))) for i in range(150)] + [(900, None, 5.0), (901, [0.0] * 8, 5.0), (902, [1.0] * 5, 5.0)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, score double")
    one = {tuple(x) for x in assembly.greedy_dedup(df, "id", "v", "score", 0.9).collect()}
    many = {tuple(x) for x in assembly.greedy_dedup(df, "id", "v", "score", 0.9, at_once=10, block=32).collect()}
    assert one == many and any(x[2] is not None for x in one)


def test_boundary_chain_follows_its_limits(spark):
    from sparkloom.operators import graph

    files = spark.createDataFrame([("a", "w1", "s1"), ("b", "w1", "s1"), ("c", "w2", "s1"), ("d", "w2", "s2"), ("e", "w2", "s2"), ("f", None, None)], "file_path string, workspace_id string, service_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("a", "x"), ("b", "f")], "source string, target string")
    starts = spark.createDataFrame([("a",)], "node string")
    got = {(r.file_path, r.imported_from): (r.depth, r.circular, r.truncated, r.reason, r.cross_workspace, r.cross_service) for r in graph.boundary_chain(edges, files, starts, max_depth=3, workspace_depth=2).collect()}
    assert got == {
        ("a", None): (0, False, False, None, False, False), ("b", "a"): (1, False, False, None, False, False), ("c", "a"): (1, False, False, None, True, False), ("x", "a"): (1, False, True, "external_dependency", False, False),
        ("a", "b"): (2, True, True, "depth_limit", False, False), ("f", "b"): (2, False, False, None, False, False), ("d", "c"): (2, False, False, None, True, True), ("e", "d"): (3, False, True, "boundary_crossed", True, True),
    }
    free = {r.file_path for r in graph.boundary_chain(edges, files, starts, 3, respect_workspace=False, respect_service=False).where("not truncated").collect()}
    assert free == {"a", "b", "c", "d", "e", "f"}


def test_cross_repository_dedup_rules(spark):
    from sparkloom.operators import context

    rows = [(1, "ref", "r.py", [1.0, 0.0], 1), (2, "main", "m.py", [1.0, 0.01], 2), (3, "main", "m2.py", [1.0, 0.02], 3), (4, "ref", "r2.py", [1.0, 0.03], 4), (5, "lib", "l.py", [1.0, 0.0], 5), (6, None, "n.py", None, 6)]
    df = spark.createDataFrame(rows, "id bigint, repo_id string, file_path string, v array<double>, ordinal int")
    repos = spark.createDataFrame([("ref", "reference"), ("main", "monolithic"), ("lib", "library")], "repo_id string, repo_type string")
    got = {r.id: (r.kept, r.similar_file) for r in context.cross_repository_dedup(df, repos, "id", "v", "ordinal").collect()}
    assert got == {1: (False, None), 2: (True, None), 3: (False, None), 4: (False, None), 5: (True, None), 6: (True, None)}


def test_detection_from_manifests(spark):
    from sparkloom.operators import detect

    pnpm = "packages:\n  - 'packages/*'\n  - tools\n"
    files = [
        ("r", "pnpm-workspace.yaml", pnpm), ("r", "package.json", '{"name": "root", "workspaces": ["apps/*"]}'), ("r", "packages/auth/package.json", '{"name": "@x/auth", "dependencies": {"@x/db": "workspace:*", "left": "1"}}'), ("r", "packages/db/package.json", '{"name": "@x/db"}'),
        ("r", "tools/package.json", '{"name": "tools", "devDependencies": {"@x/db": "1", "@x/auth": "1"}}'), ("r", "packages/a/b/package.json", '{"name": "deep"}'), ("r", "packages/bad/package.json", "{"),
        ("r", "tsconfig.json", '{\n // c\n "compilerOptions": {"paths": {"@app/*": ["src/app/*"], "~": []}}}'),
        ("m", "docker-compose.yml", "services:\n  users:\n    image: x\n    depends_on:\n      - db\n      - mail\n  db:\n    image: y\n"), ("m", "services/users/main.go", ""), ("m", "services/pay/serverless.yml", ""), ("m", "services/mail/api/openapi.yaml", ""), ("m", "apps/web/package.json", '{"name": "web", "dependencies": {"express": "4"}}'),
        ("m", "apps/lib/package.json", '{"name": "lib", "dependencies": {"x": "4"}}'), ("m", "apps/phone/app.json", '{"expo": {}}'), ("m", "packages/q/x.py", ""), ("n", "turbo.json", "{}"), ("n", "package.json", '{"workspaces": {"packages": ["libs/*"]}, "name": "n"}'), ("n", "libs/z/package.json", '{"name": "z"}'),
    ]
    df = spark.createDataFrame(files, "repo_id string, file_path string, content string")
    assert {(r.repo_id, r.tool, r.workspace_path, r.package_name) for r in detect.workspaces(df).collect()} == {("r", "pnpm", "packages/auth", "@x/auth"), ("r", "pnpm", "packages/db", "@x/db"), ("r", "pnpm", "tools", "tools"), ("n", "npm", "libs/z", "z")}
    assert {(r.source, r.target, r.kind) for r in detect.workspace_dependencies(detect.workspaces(df)).collect()} == {("@x/auth", "@x/db", "dependencies"), ("tools", "@x/db", "dev_dependencies"), ("tools", "@x/auth", "dev_dependencies")}
    assert [(r.alias_pattern, r.resolved_path) for r in detect.path_aliases(df).collect()] == [("@app/*", "src/app/*")]
    got = {(r.service_path, r.service_type, tuple(r.depends_on)) for r in detect.services(df.where("repo_id = 'm'")).collect()}
    assert got == {("services/users", "docker", ("db", "mail")), ("services/pay", "serverless", ()), ("services/mail", "rest", ()), ("apps/web", "rest", ()), ("apps/lib", "library", ()), ("apps/phone", "mobile", ()), ("packages/q", "unknown", ())}


def test_runtime_services(spark):
    from sparkloom import runtime

    now = [0.0]
    c = runtime.Cache(2, 10, clock=lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("d", 3)
    assert (c.get("a"), c.get("b"), c.get("d")) == (1, None, 3) and c.evicted == 1
    now[0] = 11
    assert c.get("a") is None and c.stats()["hits"] == 3
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise ConnectionError("no")

    with pytest.raises(ConnectionError):
        runtime.retry(fail, 2, 1.0, waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0]
    with pytest.raises(runtime.ValidationError):
        runtime.retry(lambda: runtime.checked({"k": 0}, {"k": {"type": int, "least": 1}}), 2, 1.0, waits.append)
    assert runtime.Settings.load({"SPARKLOOM_MAX_FILES": "7"}).max_files == 7
    with pytest.raises(runtime.ConfigurationError):
        runtime.Settings.load({"SPARKLOOM_MAX_FILES": "700"})
    with pytest.raises(runtime.AccessError):
        runtime.guarded_sql(spark, "select 1; DROP  DATABASE x")
    assert runtime.check_sql("select a.x from other.t a") == ["a", "other"] and runtime.guarded_sql(spark, "select 1 as x")[0].count() == 1
    t = runtime.Timings()
    with t.stage("s", 10):
        pass
    assert t.table(spark).count() == 1 and runtime.health(spark, {"t": spark.range(1)}) == {"session": True, "t": True}
    seen = []
    runtime.Progress(4, lambda *a: seen.append(a[:3]), clock=lambda: now[0]).step()
    assert seen == [(1, 4, 0.25)]


def test_query_expansion_and_ids():
    from sparkloom.functions import text as T

    concepts = {"auth": ["login", "token"], "token": ["Token", "session"]}
    assert T.expand_query("auth token", concepts).endswith("Code context: login, token, session, function, const") and T.expand_query("x", {}).endswith("function, const, export, import, return")
    assert (T.doc_id_of(["/a/b/guide.md"]), T.doc_id_of(["/a/b/x.md", "/a/b/y.md"])) == ("guide", "b")


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from sparkloom import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())
