"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".md": "markdown",
}


def token_estimate(t: Column) -> Column:
    return F.ceil(F.char_length(t) / 4).cast("bigint")


def line_count(t: Column) -> Column:
    return F.when(F.char_length(t) == 0, 0).otherwise(F.size(F.split(t, "\n"))).cast("bigint")


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def dirname(p: Column) -> Column:
    return F.regexp_replace(p, r"/?[^/]*$", "")


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(basename(p), r"(\.[^.]+)$", 1))


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"\.[^.]+$", "")


def language(p: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, extension(p)), F.lit("unknown"))


def url_path(u: Column) -> Column:
    """Path of an address: scheme, host, query and fragment dropped, with a leading slash."""
    p = F.regexp_replace(F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def import_type(p: Column) -> Column:
    """workspace (its own scope, any scoped package, path aliases), relative, absolute or external."""
    return (
        F.when(p.rlike(r"^@workspace/|^@[a-z0-9-]+/|^@/|^~/"), "workspace").when(p.startswith("./") | p.startswith("../"), "relative").when(p.startswith("/"), "absolute").otherwise("external")
    )


def is_internal_import(p: Column) -> Column:
    return F.when(p.rlike(r"^(node:|https?://)"), False).otherwise(p.startswith("./") | p.startswith("../") | p.startswith("@"))


def sha256(t: Column) -> Column:
    return F.sha2(t, 256)


def cache_key(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 16)


#: What counts as a branch, a loop and a condition.
BRANCHES = (r"\bif\s*\(", r"\belse\b", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bcase\s+", "&&", r"\|\|", r"\?", r"\bcatch\s*\(")
LOOPS = r"\bfor\s*\(|\bwhile\s*\(|\bdo\s*\{|\.forEach\(|\.map\(|\.filter\(|\.reduce\("
CONDITIONS = r"\bif\s*\(|\belse\b|\bswitch\s*\(|\?\s*.*\s*:"


def complexity(t: Column) -> Column:
    """One plus the number of branching words and signs in a text."""
    out = F.lit(1)
    for rx in BRANCHES:
        out = out + F.regexp_count(t, F.lit(rx))
    return F.coalesce(out, F.lit(1)).cast("bigint")


def has_loops(t: Column) -> Column:
    return t.rlike(LOOPS)


def has_conditionals(t: Column) -> Column:
    return t.rlike(CONDITIONS)


def has_async(t: Column) -> Column:
    return t.contains("async")


def clean_summary(s: Column, least: int = 50, most: int = 200) -> Column:
    """Collapse white space, lead in with ``This file``, end with a period, cut to ``most`` characters, fill up to ``least``."""
    tail = " for code organization."
    x = F.trim(F.regexp_replace(s, r"\s+", " "))
    x = _let(x, lambda v: F.when(v.startswith("This file"), v).when(F.lower(v).startswith("this file"), F.concat(F.lit("T"), F.substring(v, 2, 1_000_000))).otherwise(F.concat(F.lit("This file "), v)))
    x = _let(x, lambda v: F.when(v.endswith("."), v).otherwise(F.concat(v, F.lit("."))))
    x = _let(x, lambda v: F.when(F.char_length(v) > most, F.concat(F.substring(v, 1, most - 3), F.lit("..."))).otherwise(v))
    for _ in range(-(-least // (len(tail) - 1))):  # each filling replaces the last character
        x = _let(x, lambda v: F.when(F.char_length(v) < least, F.concat(F.regexp_replace(v, r"(?s).$", ""), F.lit(tail))).otherwise(v))
    return x


def _let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with x evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def is_minified(t: Column) -> Column:
    """More than 10 lines, and: over 5 lines longer than 500 characters, or line lengths alike (variance below 10), or under 5 % blanks."""
    lens = F.transform(F.split(t, "\n"), lambda x: F.char_length(x).cast("double"))
    n = F.size(lens)
    mean = F.aggregate(lens, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(lens, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    blanks = F.regexp_count(t, F.lit(" ")) / F.greatest(F.char_length(t), F.lit(1))
    return F.when(n < 10, False).otherwise((F.size(F.filter(lens, lambda x: x > 500)) > 5) | (var < 10) | (blanks < 0.05))


def size_category(lines: Column) -> Column:
    return F.when(lines < 1000, "small").when(lines < 5000, "large").otherwise("very-large")


def indexing_strategy(binary: Column, generated: Column, minified: Column, lines: Column) -> Column:
    """Struct of category, file_type, should_index, structure_only and reason: what to do with a file of that form and length."""
    category = size_category(lines)
    kind = F.when(binary, "binary").when(generated, "generated").when(minified, "minified").otherwise("normal")
    count = F.format_number(lines, 0)
    reason = (
        F.when(kind == "binary", "Binary file").when(kind == "generated", "Generated file (build output, lock file, etc.)").when(kind == "minified", "Minified code")
        .when(category == "very-large", F.concat(F.lit("Large file ("), count, F.lit(" lines) - using structure-only indexing"))).when(category == "large", F.concat(F.lit("Large file ("), count, F.lit(" lines) - using section-based chunking")))
    )
    return F.struct(category.alias("category"), kind.alias("file_type"), (kind == "normal").alias("should_index"), ((kind == "normal") & (category == "very-large")).alias("structure_only"), reason.alias("reason"))


#: Words and signs of code.
CODE_WORDS = "function const let var class interface type import export return async await def public private static".split()
CODE_SIGNS = "=> === !== ++ -- && || ::".split()


def query_type(q: Column) -> Column:
    """code_snippet for two code words, one code sign or over a tenth of brackets and the like; else natural_language."""
    low, hits = F.lower(q), F.lit(0)
    for w in CODE_WORDS:
        hits = hits + low.contains(w).cast("int")
    sign = F.lit(False)
    for x in CODE_SIGNS:
        sign = sign | q.contains(x)
    density = F.try_divide(F.regexp_count(q, F.lit(r"[{}()\[\]=<>]")), F.char_length(q))
    return F.when((hits >= 2) | sign | (density > 0.1), "code_snippet").otherwise("natural_language")


def normalize_query(q: Column) -> Column:
    x = F.trim(F.regexp_replace(q, r"\s+", " "))
    return F.when(query_type(q) == "natural_language", F.regexp_replace(x, r"[.!?]+$", "")).otherwise(x)


#: Structure words added to a query with few terms of its own.
STRUCTURE_HINTS = "function const export import return async class interface type".split()


def expand_query(q: str, concepts: dict[str, list[str]]) -> str:
    """The query with the terms of every concept it mentions, then structure words up to five terms.

    ``concepts`` maps a substring to the terms of code about it, in order of precedence; terms alike but for case are added once.
    """
    low, added, terms = q.lower(), set(), []
    for concept, words in concepts.items():
        for w in words if concept in low else ():
            if w.lower() not in added:
                added.add(w.lower())
                terms.append(w)
    terms += [h for h in STRUCTURE_HINTS[: max(0, 5 - len(terms))] if h not in added]
    return f"{q}\n\nCode context: {', '.join(terms)}" if terms else q


def line_range(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start, end)


def method_of(http_method: Column, operation_id: Column) -> Column:
    return F.coalesce(http_method, operation_id, F.lit("QUERY"))


def docstring_head(t: Column, lang: Column) -> Column:
    """The comment a text starts with, marks removed and lines joined; null if it is none, empty or over 200 characters."""
    py = F.coalesce(F.nullif(F.regexp_extract(t, r'^\s*"""([\s\S]*?)"""', 1), F.lit("")), F.regexp_extract(t, r"^\s*\'\'\'([\s\S]*?)\'\'\'", 1))
    raw = F.when(lang == "python", py).otherwise(F.regexp_extract(t, r"^\s*/\*\*?([\s\S]*?)\*/", 1))
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s", " ")), r"^\*\s?", ""))
    out = F.trim(F.array_join(F.filter(lines, lambda x: x != ""), " "))
    return F.when((out != "") & (F.char_length(out) <= 200), out)


#: What counts as a function and as a class, by language.
FUNCTION_FORMS = {
    ("typescript", "javascript"): r"function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\(|export\s+(?:async\s+)?function\s+\w+", ("python",): r"def\s+\w+\s*\(",
    ("java", "csharp"): r"(?:public|private|protected|static)\s+[\w<>\[\],\s]+\s+\w+\s*\(", ("go",): r"func\s+(?:\([^)]*\)\s+)?\w+\s*\(", ("rust",): r"fn\s+\w+\s*[<(]",
}
CLASS_FORMS = {("python",): r"class\s+\w+\s*[:(]", ("rust",): r"(?:struct|enum|trait)\s+\w+"}


def structure_summary(t: Column, lang: Column) -> Column:
    """How many functions and classes a text defines, as a sentence."""

    def count(forms: dict, default: str) -> Column:
        out = F.regexp_count(t, F.lit(default))
        for names, rx in forms.items():
            out = F.when(lang.isin(*names), F.regexp_count(t, F.lit(rx))).otherwise(out)
        return out

    def told(n: Column, one: str, many: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " " + one).otherwise(" " + many)))

    parts = F.concat_ws(" and ", told(count(FUNCTION_FORMS, r"function\s+\w+"), "function", "functions"), told(count(CLASS_FORMS, r"class\s+\w+"), "class", "classes"))
    return F.concat(F.lit("This file contains "), F.when(parts == "", F.concat(lang, F.lit(" code"))).otherwise(parts), F.lit("."))


def _cut(x: Column, most: int) -> Column:
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def embedding_text(summary: Column, content: Column, symbols: Column) -> Column:
    """Summary, code and the list of symbols (cut to 200 characters), as one text to embed."""
    listed = F.array_join(symbols, ", ")
    return F.concat_ws("\n\n", F.nullif(summary, F.lit("")), content, F.when(listed != "", F.concat(F.lit("Symbols: "), _cut(listed, 200))))


def definition_text(kind: Column, name: Column, params: Column, returns: Column, methods: Column, doc: Column, code: Column) -> Column:
    """The definition stored for a symbol: signature, class with its methods, first line of a variable, or the type itself."""
    told = F.when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit("- "), F.substring(doc, 1, 200)))
    function = F.concat_ws(" ", F.concat(F.lit("function "), name, F.lit("("), F.coalesce(params, F.lit("")), F.lit("): "), F.coalesce(returns, F.lit("void"))), told)
    klass = F.concat_ws(" ", F.concat(F.lit("class "), name), F.when(F.coalesce(methods, F.lit("")) != "", F.concat(F.lit("{ methods: "), methods, F.lit(" }"))), told)
    line = F.trim(F.substring_index(code, "\n", 1))
    variable = F.when((line != "") & (F.char_length(line) < 200), line).otherwise(F.concat(F.lit("const "), name, F.lit(": "), F.coalesce(returns, F.lit("unknown"))))
    return F.when(kind == "function", function).when(kind == "class", klass).when(kind == "variable", variable).when(kind.isin("type", "interface"), _cut(F.trim(code), 500)).otherwise(F.substring(code, 1, 500))


def endpoint_text(method: Column, path: Column, description: Column, operation: Column, tags: Column, file_path: Column, function: Column) -> Column:
    """What is embedded of an endpoint: one line for each thing known of it."""
    line = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    return F.concat_ws(
        "\n", F.concat_ws(" ", method, path), line("Description: ", description), line("Operation: ", operation), line("Tags: ", F.array_join(tags, ", ")), line("Implemented in: ", file_path), F.when(file_path.isNotNull(), line("Function: ", function))
    )


def doc_embedding_text(chunk_type: Column, heading: Column, content: Column, lang: Column) -> Column:
    section = F.concat(F.lit("Documentation section: "), heading, F.lit("\n\n"), content)
    return F.when(chunk_type == "section", section).otherwise(F.concat(F.lit("Code example ("), F.coalesce(lang, F.lit("text")), F.lit(") in "), heading, F.lit(":\n\n"), content))


def call_confidence(target: Column) -> Column:
    """How sure a detected call's target is: full address, host and port, absolute path, template, anything else, nothing."""
    return (
        F.when(F.coalesce(target, F.lit("")) == "", 0.3).when(target.rlike("^https?://"), 0.95).when(target.rlike(r"^[\w.-]+:\d+"), 0.9).when(target.startswith("/"), 0.75)
        .when(target.contains("$") | target.contains("{"), 0.5).otherwise(0.6)
    )


def doc_id_of(paths: list[str]) -> str:
    """The id of a documentation set: the file's stem, or the folder's name for several files."""
    parts = paths[0].rstrip("/").split("/")
    if len(paths) > 1:
        return parts[-2] if len(parts) > 1 else ""
    return parts[-1].rsplit(".", 1)[0] if "." in parts[-1][1:] else parts[-1]
