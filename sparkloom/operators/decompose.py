"""Text decomposition as table operators: every text of a table becomes its parts, one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import parse

_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def explode_texts(df: DataFrame, columns: list[str], fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``fn(*values)`` for every row of ``df[columns]``; the first column is carried as ``key`` in front."""
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r[0], *x) for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in fn(*r[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return df.select(*columns).mapInArrow(run, schema)


def file_nodes(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    return explode_texts(
        df, [key, text, language], lambda t, lang: ((n.kind, n.name, n.start, n.end, n.parent, n.exported, n.is_async) for n in parse.nodes(t, lang)) if t else (),
        "key bigint, kind string, name string, start_line int, end_line int, parent string, exported boolean, is_async boolean",
    )


def file_imports(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    return explode_texts(df, [key, text, language], lambda t, lang: ((i.path, i.line, ",".join(i.symbols), i.kind) for i in parse.imports(t.split("\n"), lang)) if t else (), "key bigint, import_path string, line int, symbols string, import_type string")


def file_chunks(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """Chunks of whole files with deterministic ids."""
    out = explode_texts(df, [key, text, language], lambda t, lang: parse.chunk_file(t or "", lang), "key bigint, chunk_type string, start_line int, end_line int, content string")
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("|", "key", "chunk_type", "start_line", "end_line"), 256)).withColumn("token_count", F.ceil(F.char_length("content") / 4).cast("bigint"))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    return explode_texts(df, [key, text], lambda t: parse.sections(t) if t else (), "key bigint, level int, heading string, heading_path string, start_line int, end_line int, content string")


def markdown_code(df: DataFrame, key: str, text: str) -> DataFrame:
    return explode_texts(df, [key, text], lambda t: parse.code_blocks(t) if t else (), "key bigint, language string, start_line int, end_line int, code string")


def route_endpoints(df: DataFrame, key: str, text: str) -> DataFrame:
    return explode_texts(df, [key, text], lambda t: parse.endpoints(t) if t else (), "key bigint, framework string, method string, path string, line int")


def spec_endpoints(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    return explode_texts(df, [key, path, text], lambda p, t: parse.api_spec(p or "", t) if t else (), "key bigint, api_type string, method string, path string, deprecated boolean")


#: Forms of outgoing calls, by client style.
_VERBS = "(?:get|post|put|patch|delete|head|options)"
CALLS = {
    "fetch": r"""\bfetch\(\s*['"`]([^'"`]+)""", "axios": r"""(?i)\baxios\.""" + _VERBS + r"""\(\s*['"`]([^'"`]+)""", "axios_config": r"""(?i)\baxios\(\s*\{[^}]*\burl:\s*['"`]([^'"`]+)""",
    "got": r"""\b(?:got|superagent|request)\(\s*['"`]([^'"`]+)""", "node_http": r"""\bhttps?\.(?:get|request)\(\s*['"`]([^'"`]+)""",
    "requests": r"""(?i)\brequests\.""" + _VERBS + r"""\(\s*['"`]([^'"`]+)""", "httpx": r"""(?i)\bhttpx\.""" + _VERBS + r"""\(\s*['"`]([^'"`]+)""", "session": r"""(?i)\bsession\.""" + _VERBS + r"""\(\s*['"`]([^'"`]+)""",
    "http_get": r"""\bhttp\.(?:Get|Post|Put|Patch|Delete|Head)\(\s*"([^"]+)""", "http_new_request": r"""\bhttp\.NewRequest\(\s*"[^"]+",\s*"([^"]+)""",
    "java_client": r"""(?i)\b(?:httpClient|restTemplate)\.(?:get|post|put|patch|delete)\(\s*['"`]([^'"`]+)""", "reqwest": r"""\breqwest::(?:get|post|put|patch|delete)\(\s*"([^"]+)""",
    "graphql": r"""\b(?:useQuery|useMutation|gql)\b(?:.*?\b(?:query|mutation)\s+(\w+))?""", "grpc": r"""\bnew\s+\w+Client\((?:\s*['"`]([^'"`]+:\d+)['"`])?""",
    "grpc_stub": r"""\w_pb2_grpc\.\w+Stub\((?:\s*grpc\.insecure_channel\(\s*['"`]([^'"`]+))?""", "grpc_dial": r"""\bgrpc\.Dial\(\s*"([^"]+)""",
}


def api_calls(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line, style, target)`` by line and style, with built-in expressions only."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line_text"))
    hits = F.array(*[F.when(F.col("line_text").rlike(rx), F.struct(F.lit(n).alias("style"), F.regexp_extract("line_text", rx, 1 if "(" in rx.replace("(?:", "").replace(r"\(", "") else 0).alias("target"))) for n, rx in CALLS.items()])
    return lines.select(key, (F.col("pos") + 1).alias("line"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select(key, "line", "h.style", "h.target")


def sliding_windows(df: DataFrame, key: str, text: str, size: int = 200, overlap: int = 20) -> DataFrame:
    """Line windows ``(key, start_line, end_line, content)``; empty texts give none."""
    step = size - overlap
    lines = df.where(F.char_length(text) > 0).select(key, F.split(text, "\n").alias("l"))
    starts = lines.select(key, "l", F.explode(F.sequence(F.lit(1), F.greatest(F.size("l") - overlap, F.lit(1)), F.lit(step))).alias("start_line"))
    return starts.select(key, "start_line", F.least(F.col("start_line") + size - 1, F.size("l")).alias("end_line"), F.concat_ws("\n", F.slice("l", F.col("start_line"), F.lit(size))).alias("content"))


def truncated(df: DataFrame, key: str, text: str, head: int = 50, tail: int = 50, marker: str = "... truncated ...") -> DataFrame:
    """First and last lines of long texts with a marker between."""
    lines = F.split(text, "\n")
    cut = F.concat_ws("\n", F.slice(lines, 1, head), F.lit(marker), F.slice(lines, -tail, tail))
    return df.select(key, F.when(F.size(lines) > head + tail, cut).otherwise(F.col(text)).alias("content"))


def symbols_of_nodes(nodes: DataFrame) -> DataFrame:
    """``(key, symbol_name, symbol_type, scope, parent, line_number)`` of parsed nodes that define something; exported ones have the scope exported, others internal."""
    kinds = F.when(F.col("kind") == "method", "function").otherwise(F.col("kind"))
    return nodes.where("name is not null and name <> '' and kind in ('function', 'method', 'class', 'variable', 'interface', 'type')").select(
        "key", F.col("name").alias("symbol_name"), kinds.alias("symbol_type"), F.when(F.col("exported"), "exported").otherwise("internal").alias("scope"), "parent", F.col("start_line").alias("line_number")
    )


def chunk_metadata(df: DataFrame, nodes: DataFrame, imports: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, function_names, class_names, imports, exports, complexity, has_async, has_loops, has_conditionals)``: what is stored about each text beside it.

    Names come from its parsed nodes, in the order of lines, import paths once each; a text without any has empty lists.
    """
    from sparkloom.functions import text as T

    named = lambda cond: F.transform(F.array_sort(F.collect_set(F.when(cond, F.struct("start_line", "name")))), lambda x: x["name"])  # noqa: E731  # the nodes of one text
    n = nodes.groupBy("key").agg(named(F.col("kind").isin("function", "method")).alias("function_names"), named(F.col("kind") == "class").alias("class_names"), named(F.col("exported")).alias("exports"))
    i = imports.groupBy("key").agg(F.array_sort(F.collect_set("import_path")).alias("imports"))
    none, c = F.array().cast("array<string>"), F.col(text)
    base = df.select(F.col(key).alias("key"), T.complexity(c).alias("complexity"), T.has_async(c).alias("has_async"), T.has_loops(c).alias("has_loops"), T.has_conditionals(c).alias("has_conditionals"))
    out = base.join(n, "key", "left").join(i, "key", "left")
    return out.select("key", *[F.coalesce(x, none).alias(x) for x in ("function_names", "class_names", "imports", "exports")], "complexity", "has_async", "has_loops", "has_conditionals")
