"""Structure of source files by line rules: declarations with their extent, imports and exports, for ten languages.

Python files that parse are read with the standard library's syntax tree; anything else, and broken Python, by the line rules.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

MAX_FALLBACK = {"function": 50, "class": 100}


@dataclass
class Node:
    kind: str
    name: str
    start: int
    end: int
    parent: str | None = None
    params: list[str] = field(default_factory=list)
    exported: bool = False
    is_async: bool = False
    doc: str | None = None


@dataclass
class Import:
    path: str
    line: int
    symbols: list[str]
    kind: str


_VIS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|declare|override|virtual|sealed|open|suspend|inline|const|unsafe|synchronized|native|readonly|partial|extern)\s+)*"
_RULES: dict[str, list[tuple[str, re.Pattern]]] = {
    "typescript": [
        ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\(")),
        ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)[^=]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")),
        ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)")),
        ("interface", re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|type)\s+([\w$]+)")),
        ("method", re.compile(r"^\s+" + _VIS + r"(?:get\s+|set\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b)([\w$#]+)\s*(?:<[^(]*>)?\([^;]*\)\s*(?::[^;{]+)?\{\s*$")),
        ("variable", re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)")),
    ],
    "python": [("function", re.compile(r"^\s*(?:async\s+)?def\s+(\w+)")), ("class", re.compile(r"^\s*class\s+(\w+)"))],
    "java": [
        ("class", re.compile(r"^\s*" + _VIS + r"(?:class|record)\s+(\w+)")), ("interface", re.compile(r"^\s*" + _VIS + r"(?:interface|@interface)\s+(\w+)")), ("enum", re.compile(r"^\s*" + _VIS + r"enum\s+(\w+)")),
        ("method", re.compile(r"^\s+" + _VIS + r"(?:<[^>]+>\s+)?(?:[\w<>\[\],.?]+\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|else\b)(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w,.\s]+)?\{\s*$")),
    ],
    "go": [("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)")), ("class", re.compile(r"^type\s+(\w+)\s+struct")), ("interface", re.compile(r"^type\s+(\w+)\s+interface")), ("type", re.compile(r"^type\s+(\w+)\s+(?!struct|interface)"))],
    "rust": [
        ("function", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?fn\s+(\w+)")), ("class", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)")), ("enum", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)")),
        ("interface", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")), ("class", re.compile(r"^impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)")),
    ],
    "cpp": [("class", re.compile(r"^\s*(?:class|struct)\s+(\w+)[^;]*$")), ("enum", re.compile(r"^\s*enum\s+(?:class\s+)?(\w+)")), ("interface", re.compile(r"^\s*namespace\s+(\w+)")), ("function", re.compile(r"^[\w:<>*&\s]+?[\s*&]+(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{\s*$"))],
    "ruby": [("function", re.compile(r"^\s*def\s+(?:self\.)?(\w+[?!=]?)")), ("class", re.compile(r"^\s*class\s+([\w:]+)")), ("module", re.compile(r"^\s*module\s+([\w:]+)"))],
    "php": [("class", re.compile(r"^\s*(?:final\s+|abstract\s+)?class\s+(\w+)")), ("interface", re.compile(r"^\s*(?:interface|trait)\s+(\w+)")), ("function", re.compile(r"^\s*" + _VIS + r"function\s+&?(\w+)"))],
    "csharp": [("class", re.compile(r"^\s*" + _VIS + r"(?:class|struct|record)\s+(\w+)")), ("interface", re.compile(r"^\s*" + _VIS + r"(?:interface|enum)\s+(\w+)")), ("method", re.compile(r"^\s+" + _VIS + r"[\w<>\[\],.?]+\s+(\w+)\s*\([^;]*\)\s*\{?\s*$"))],
    "kotlin": [("class", re.compile(r"^\s*" + _VIS + r"(?:data\s+)?(?:class|object)\s+(\w+)")), ("interface", re.compile(r"^\s*" + _VIS + r"interface\s+(\w+)")), ("function", re.compile(r"^\s*" + _VIS + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"))],
    "fallback": [("function", re.compile(r"\bfunction\s+(\w+)")), ("class", re.compile(r"\bclass\s+(\w+)"))],
}
_RULES["javascript"] = [r for r in _RULES["typescript"] if r[0] != "interface"]
_RULES["c"] = _RULES["cpp"]

_IMPORT: dict[str, list[re.Pattern]] = {
    "typescript": [re.compile(r"""^\s*import\s+(?:type\s+)?(?P<what>.*?)\s*from\s*['"](?P<path>[^'"]+)['"]"""), re.compile(r"""^\s*import\s*['"](?P<path>[^'"]+)['"]"""), re.compile(r"""(?P<what>[\w{},\s]+)=\s*require\(\s*['"](?P<path>[^'"]+)['"]\s*\)""")],
    "java": [re.compile(r"^\s*import\s+(?:static\s+)?(?P<path>[\w.*]+)\s*;")],
    "go": [re.compile(r'^\s*import\s+(?:(?P<what>[\w.]+)\s+)?"(?P<path>[^"]+)"'), re.compile(r'^\s+(?:(?P<what>[\w.]+)\s+)?"(?P<path>[^"]+)"\s*$')],
    "rust": [re.compile(r"^\s*(?:pub\s+)?use\s+(?P<path>[\w:]+?)(?:::\{(?P<what>[^}]*)\})?\s*;")],
    "cpp": [re.compile(r'^\s*#\s*include\s*[<"](?P<path>[^>"]+)[>"]'), re.compile(r"^\s*using\s+(?:namespace\s+)?(?P<path>[\w:]+)\s*;")],
    "ruby": [re.compile(r"""^\s*require(?:_relative)?\s+['"](?P<path>[^'"]+)['"]""")],
    "php": [re.compile(r"^\s*use\s+(?P<path>[\w\\]+)(?:\s+as\s+\w+)?\s*;")],
    "csharp": [re.compile(r"^\s*using\s+(?:static\s+)?(?P<path>[\w.]+)\s*;")],
    "kotlin": [re.compile(r"^\s*import\s+(?P<path>[\w.*]+)")],
    "python": [re.compile(r"^\s*from\s+(?P<path>[\w.]+)\s+import\s+(?P<what>.+)$"), re.compile(r"^\s*import\s+(?P<path>[\w.]+)")],
}
_IMPORT["javascript"] = _IMPORT["typescript"]
_IMPORT["c"] = _IMPORT["cpp"]


def import_kind(path: str) -> str:
    if re.match(r"\.{1,2}(/|$)|\.[A-Za-z_]", path):
        return "relative"
    if re.match(r"@[\w-]+/|workspace:|~/|@/", path):
        return "workspace"
    return "absolute" if path.startswith("/") else "external"


def _names(what: str | None) -> list[str]:
    if not what:
        return []
    return [x.strip() for x in re.split(r"[,{}]", what.replace("* as ", "")) if x.strip()]


def imports(lines: list[str], language: str) -> list[Import]:
    out = []
    grouped = False
    for no, x in enumerate(lines, 1):
        if language == "go":
            if re.match(r"^\s*import\s*\(", x):
                grouped = True
                continue
            if grouped and x.strip() == ")":
                grouped = False
            if not grouped and not x.lstrip().startswith("import"):
                continue
        for rx in _IMPORT.get(language, []):
            m = rx.search(x)
            if m:
                g = m.groupdict()
                out.append(Import(g["path"], no, _names(g.get("what")), import_kind(g["path"])))
                break
    return out


def _end_of_block(lines: list[str], start: int, language: str) -> int:
    """Last line (from 0) of the block that line ``start`` opens: by indentation or by braces, a Ruby block by its end."""
    ind = len(lines[start]) - len(lines[start].lstrip())
    if language in ("python", "ruby"):
        last = start
        for i in range(start + 1, len(lines)):
            x = lines[i]
            if not x.strip():
                continue
            here = len(x) - len(x.lstrip())
            if here <= ind:
                return i if language == "ruby" and x.strip() == "end" and here == ind else last
            last = i
        return last
    depth, opened = 0, False
    for i in range(start, len(lines)):
        code = re.sub(r"//.*$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[i])
        depth += code.count("{") - code.count("}")
        opened = opened or "{" in code
        if opened and depth <= 0:
            return i
        if not opened and (code.rstrip().endswith(";") or i - start > 12):
            return i
    return len(lines) - 1


def _exported(name: str, kind: str, line: str, language: str) -> bool:
    if language in ("typescript", "javascript"):
        return bool(re.match(r"\s*export\b", line))
    if language == "go":
        return name[:1].isupper()
    if language == "rust":
        return bool(re.match(r"\s*pub\b", line)) and kind != "impl"
    if language in ("java", "csharp"):
        return kind in ("class", "interface", "enum") and bool(re.search(r"\bpublic\b", line)) and "record" not in line
    return False


def _doc(lines: list[str], at: int) -> str | None:
    i = at - 1
    if i < 0 or not lines[i].strip():
        return None
    s = lines[i].strip()
    if s.endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        return "\n".join(lines[max(j, 0) : i + 1]).strip()
    if re.match(r"//|#(?!\[)", s):
        j = i
        while j - 1 >= 0 and re.match(r"\s*(?://|#(?!\[))", lines[j - 1]):
            j -= 1
        return "\n".join(x.strip() for x in lines[j : i + 1])
    return None


def nodes(text: str, language: str) -> list[Node]:
    """Declarations of a file in order of their lines (from 1)."""
    lines = text.replace("\r\n", "\n").split("\n")
    if language == "python":
        try:
            return _python(ast.parse(text), lines)
        except (SyntaxError, ValueError):
            pass
    rules = _RULES.get(language)
    if rules is None:
        out = []
        for i, x in enumerate(lines):
            for kind, rx in _RULES["fallback"]:
                m = rx.search(x)
                if m:
                    out.append(Node(kind, m.group(1), i + 1, min(i + 1 + MAX_FALLBACK[kind], len(lines))))
        return out
    out: list[Node] = []
    for i, x in enumerate(lines):
        if re.match(r"\s*(?://|\*|/\*|#(?!\[|include))", x):
            continue
        for kind, rx in rules:
            m = rx.match(x)
            if m:
                end = _end_of_block(lines, i, language)
                parent = next((n.name for n in reversed(out) if n.kind in ("class", "interface", "enum", "module") and n.start <= i + 1 <= n.end), None)
                out.append(Node("function" if kind == "method" else kind, m.group(1), i + 1, end + 1, parent, [], _exported(m.group(1), kind, x, language), "async" in x, _doc(lines, i)))
                break
    return out


def _python(tree: ast.Module, lines: list[str]) -> list[Node]:
    out: list[Node] = []

    def walk(body: list[ast.stmt], parent: str | None) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(Node("function", n.name, n.lineno, n.end_lineno or n.lineno, parent, [a.arg for a in n.args.args], False, isinstance(n, ast.AsyncFunctionDef), ast.get_docstring(n) or _doc(lines, n.lineno - 1)))
                walk(n.body, parent)
            elif isinstance(n, ast.ClassDef):
                out.append(Node("class", n.name, n.lineno, n.end_lineno or n.lineno, parent, doc=ast.get_docstring(n)))
                walk(n.body, n.name)

    walk(tree.body, None)
    return out


def chunk_file(text: str, language: str, min_lines: int = 10, gap_lines: int = 50, large: int = 1000, huge: int = 5000) -> list[tuple[str, int, int, str]]:
    """``(type, first line, last line, content)``: summary (first 100 lines), imports, functions, classes, uncovered gaps.

    Files over ``huge`` lines give the summary and the exported declarations' lines only; files over ``large`` lines give no gaps.
    Empty texts give nothing.
    """
    if not text:
        return []
    lines = text.split("\n")
    part = lambda a, b: "\n".join(lines[a - 1 : b])
    out = [("file_summary", 1, min(100, len(lines)), part(1, min(100, len(lines))))]
    decls = nodes(text, language)
    if len(lines) > huge:
        exported = [lines[n.start - 1] for n in decls if n.exported]
        return out + ([("block", 1, len(lines), "\n".join(exported))] if exported else [])
    imp = imports(lines, language)
    covered: list[tuple[int, int]] = []
    if imp and imp[-1].line - imp[0].line + 1 >= 3:
        covered.append((imp[0].line, imp[-1].line))
        out.append(("import_block", imp[0].line, imp[-1].line, part(imp[0].line, imp[-1].line)))
    for kind in ("function", "class"):
        for n in decls:
            if n.kind == kind and n.end - n.start + 1 >= min_lines and not (kind == "function" and n.parent):
                covered.append((n.start, n.end))
                out.append((kind, n.start, n.end, part(n.start, n.end)))
    if len(lines) <= large:
        at = 1
        for a, b in [*sorted(covered), (len(lines) + 1, len(lines) + 1)]:
            if a - at >= gap_lines:
                out.append(("block", at, a - 1, part(at, a - 1)))
            at = max(at, b + 1)
    return out


# --- interface descriptions
def endpoints(text: str) -> list[tuple[str, str, str, int]]:
    """``(framework, method, path, line)`` of routes declared in code."""
    rules = [
        ("express", re.compile(r"""\b(?:app|router|server|api)\.(get|post|put|delete|patch|options|head)\(\s*['"`]([^'"`]+)""")), ("nest", re.compile(r"""@(Get|Post|Put|Delete|Patch)\(\s*(?:['"`]([^'"`]*)['"`])?\s*\)""")),
        ("flask", re.compile(r"""@\w+\.(?:route|get|post|put|delete|patch)\(\s*['"]([^'"]+)['"](?:.*methods=\[['"](\w+))?""")), ("graphql", re.compile(r"@(Query|Mutation|Subscription)\(\s*(?:\(\)\s*=>\s*(\w+))?")), ("grpc", re.compile(r"""@(GrpcMethod)\(\s*['"]([^'"]+)""")),
    ]
    out = []
    for no, x in enumerate(text.split("\n"), 1):
        for name, rx in rules:
            m = rx.search(x)
            if m:
                a, b = m.group(1), m.group(2) or ""
                out.append((name, (b or "GET").upper(), a, no) if name == "flask" else (name, a.upper(), b, no))
                break
    return out


def api_spec(path: str, text: str) -> list[tuple[str, str, str, bool]]:
    """``(type, method, path or name, deprecated)`` of an OpenAPI JSON file, a GraphQL schema or a proto file; else nothing."""
    import json

    low = path.lower()
    if low.endswith(".json"):
        try:
            spec = json.loads(text)
        except ValueError:
            return []
        if not isinstance(spec, dict) or not ({"openapi", "swagger"} & set(spec)):
            return []
        verbs = ("get", "post", "put", "delete", "patch", "options", "head")
        return [("rest", v.upper(), p, bool(ops[v].get("deprecated", False))) for p, ops in (spec.get("paths") or {}).items() if isinstance(ops, dict) for v in verbs if isinstance(ops.get(v), dict)]
    if low.endswith((".graphql", ".gql")):
        out = []
        for m in re.finditer(r"type\s+(Query|Mutation|Subscription)\s*\{([^}]*)\}", text):
            out += [("graphql", m.group(1).upper(), f.group(1), "@deprecated" in f.group(0)) for f in re.finditer(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:[^\n]*", m.group(2), re.M)]
        return out
    if low.endswith(".proto"):
        out = []
        for m in re.finditer(r"service\s+(\w+)\s*\{", text):
            body = text[m.end() : text.find("\n}", m.end())]
            out += [("grpc", "RPC", f"{m.group(1)}/{f.group(1)}", "deprecated = true" in body[f.end() : f.end() + 120].split("rpc ")[0]) for f in re.finditer(r"rpc\s+(\w+)", body)]
        return out
    return []


# --- markdown
def front_matter(text: str) -> tuple[dict[str, object], int]:
    """Leading ``---`` block as key: value (booleans and JSON arrays read), and the number of its lines."""
    import json

    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if end is None:
        return {}, 0
    out: dict[str, object] = {}
    for x in lines[1:end]:
        k, sep, v = x.partition(":")
        if not sep or not k.strip():
            continue
        v = v.strip()
        if v in ("true", "false"):
            out[k.strip()] = v == "true"
        elif v.startswith("["):
            try:
                out[k.strip()] = json.loads(v)
            except ValueError:
                out[k.strip()] = v
        else:
            out[k.strip()] = v.strip("\"'")
    return out, end + 1


def sections(text: str) -> list[tuple[int, str, str, int, int, str]]:
    """``(level, heading, breadcrumb, first line, last line, content)`` by ATX headings (those inside fences count too)."""
    _, skip = front_matter(text)
    lines = text.replace("\r\n", "\n").split("\n")
    heads = [(i, len(m.group(1)), m.group(2).strip()) for i, x in enumerate(lines) if i >= skip and (m := re.match(r"^(#{1,6})[ \t]+(.+?)\s*#*\s*$", x))]
    out, stack = [], []
    for k, (i, level, title) in enumerate(heads):
        stack = [s for s in stack if s[0] < level] + [(level, title)]
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        out.append((level, title, " > ".join(s[1] for s in stack), i + 1, end, "\n".join(lines[i + 1 : end]).strip()))
    return out


def code_blocks(text: str) -> list[tuple[str, int, int, str]]:
    """``(language, first line, last line, code)`` of fenced blocks; without a language ``text``; an unclosed fence is dropped."""
    out, at, lang = [], None, ""
    lines = text.replace("\r\n", "\n").split("\n")
    for i, x in enumerate(lines):
        m = re.match(r"^```(\w*)\s*$", x)
        if not m:
            continue
        if at is None:
            at, lang = i, m.group(1) or "text"
        else:
            out.append((lang, at + 1, i + 1, "\n".join(lines[at + 1 : i])))
            at = None
    return out
