"""Functions paired with their documentation.

Every text is read once into symbol rows: qualified name (enclosing types, function name), normalised signature, the documentation
around it and whether it has a body. The signature holds the parameter types where the language resolves overloads by them (C, C++, Java, C#,
Kotlin), without names, defaults and white space, and the parameter names elsewhere. The table over all files is then
joined with itself: every definition meets the documented declaration elsewhere in the same repository that has
the same qualified name and signature, or the one in a type that its own type names as its base (a trait, an interface). A definition
whose own text says nothing takes the declaration's. Only then are pairs whose documentation is missing or says nothing dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise, widen

EXT = {
    "py": "py", "pyi": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js", "java": "java", "cs": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c",
    "go": "go", "rs": "rs", "rb": "rb", "php": "php", "kt": "kt", "swift": "kt", "scala": "kt",
}
LANG = {"python": "py", "javascript": "js", "typescript": "js", "ts": "js", "js": "js", "java": "java", "go": "go", "golang": "go", "rust": "rs", "ruby": "rb", "php": "php", "kotlin": "kt", "swift": "kt", "c": "c", "c++": "c", "cpp": "c", "c#": "java", "csharp": "java", "scala": "kt", "py": "py", "rb": "rb", "rs": "rs"}

_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|export|default|readonly|declare|synchronized|native|sealed|partial|extern|inline|const|constexpr|unsafe|open|suspend|operator|tailrec|mutating|strictfp|transient)\s+)*"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|new|throw|else|do|try|match|with|using|lock|foreach|synchronized|typeof|await|delete|in|of|case|super|this|assert|yield)\b)"
_ANGLE = r"(?:<(?:[^<>(){};]|<(?:[^<>(){};]|<[^<>(){};]*>)*>)*>)?"
_CWORD = r"(?:::)?" + _NOT + r"[A-Za-z_]\w*" + _ANGLE + r"(?:::[A-Za-z_]\w*" + _ANGLE + r")*"
FUNC = {
    "py": re.compile(r"^(?P<ind>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?\("),
    "js": re.compile(
        r"^(?P<ind>[ \t]*)(?:(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^(]*>)?\("
        r"|(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[ \t]*(?::[^=]+)?=[ \t]*(?:async[ \t]*)?(?:function\b[^(]*|<[^(]*>)?\(?"
        r"|" + _MOD + r"(?:get[ \t]+|set[ \t]+)?\*?[ \t]*" + _NOT + r"(?P<method>#?[\w$]+)[ \t]*(?:<[^(]*>)?\()"
    ),
    "java": re.compile(r"^(?P<ind>[ \t]*)(?:@\w+(?:\([^)]*\))?[ \t]+)*" + _MOD + r"(?:<[^(]*?>[ \t]+)?" + _NOT + r"(?:[\w.]+(?:<[^(=;]*>)?(?:\[\])*[ \t*&]+)?" + _NOT + r"(?P<name>~?[A-Za-z_]\w*)[ \t]*\("),
    "c": re.compile(
        r"^(?P<ind>[ \t]*)(?:template[ \t]*<[^(){};]*>[ \t]*)?(?:\[\[[^\]]*\]\][ \t]*)?(?:extern[ \t]+\"C\"[ \t]+)?(?P<type>(?:" + _CWORD + r"[ \t*&]+)*)" + _NOT
        + r"(?P<qual>(?:[A-Za-z_]\w*" + _ANGLE + r"::)*)(?P<name>operator[ \t]*(?:\(\)|\[\]|[^\s\w(]+|[\w:]+[ *&]*)|~?[A-Za-z_]\w*)[ \t]*\("
    ),
    "go": re.compile(r"^(?P<ind>[ \t]*)func[ \t]*(?:\((?P<recv>[^)]*)\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?\("),
    "rs": re.compile(r"^(?P<ind>[ \t]*)(?:pub(?:\([^)]*\))?[ \t]+)?(?:default[ \t]+)?(?:const[ \t]+)?(?:async[ \t]+)?(?:unsafe[ \t]+)?(?:extern[ \t]+(?:\"[^\"]*\"[ \t]+)?)?fn[ \t]+(?P<name>\w+)[ \t]*(?:<[^(]*>)?\("),
    "rb": re.compile(r"^(?P<ind>[ \t]*)(?:(?:private|public|protected|memoize)[ \t]+)?def[ \t]+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?)"),
    "php": re.compile(r"^(?P<ind>[ \t]*)" + _MOD + r"function[ \t]*&?[ \t]*(?P<name>\w+)[ \t]*\("),
    "kt": re.compile(r"^(?P<ind>[ \t]*)" + _MOD + r"(?:fun|func|def)[ \t]+(?:<[^(]*>[ \t]*)?(?:[\w.]+\.)?(?P<name>\w+)[ \t]*(?:<[^(]*>|\[[^\]]*\])?\("),
}
TYPE = re.compile(r"^(?P<ind>[ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:pub(?:\([^)]*\))?[ \t]+)?" + _MOD + r"(?:(?:class|interface|trait|struct|enum|module|object|record)[ \t]+(?P<name>[\w:$]+)|impl(?:<[^>]*>)?[ \t]+(?:(?P<trait>[\w:]+)(?:<[\w:<>, ]*>)?[ \t]+for[ \t]+)?(?P<impl>\w+)|type[ \t]+(?P<gotype>\w+)[ \t]+(?:struct|interface))")
_BASE = re.compile(r"\b(?:implements|extends)[ \t]+([\w.]+)|^[^(){]*\)?[ \t]*:(?!:)[ \t]*(?:(?:public|protected|private|virtual)[ \t]+)*([\w.:]+)")
_PRIMITIVE = {"int", "char", "long", "short", "double", "float", "bool", "unsigned", "signed", "void", "auto"}
_CTYPE_LINE = re.compile(r"^\s*(?:template\s*<[^(){};]*>|\[\[[^\]]*\]\])?\s*(?:" + _CWORD + r"[ \t*&]*)*$")
_CTAIL = re.compile(r"const\b|volatile\b|noexcept\b|override\b|final\b|try\b|throw\b|requires\b|&|->|:(?!:)|=\s*(?:0|default|delete)\b|\[\[|__\w+|[A-Z_]{3,}\b")
_BRACKET = re.compile(r"[()\[\]{}]")
_DECORATOR = re.compile(r"^\s*(?:@(?!param|return|throws|internal|deprecated)[\w.]+|#\[|\[\w+[\](]|#!\[)")

#: Names of tools whose directives stand in comments.
DIRECTIVE = re.compile(
    r"^\W*(?:eslint\b|eslint-|tslint|jshint|jslint|prettier-ignore|@ts-|ts-(?:ignore|expect|nocheck)|istanbul|c8 ignore|v8 ignore|webpack|@vite|noqa|type:\s*ignore|pylint|flake8|mypy|pragma|fmt:\s*(?:on|off|skip)|isort|yapf|nosec|bandit|black|ruff|pyright|nolint|golint|go:\w+|\+build|lint:|staticcheck|"
    r"rustfmt|clippy|allow\(|rubocop|steep|sorbet|typed:|frozen_string_literal|encoding:|-\*-|vim?:|@?phpcs|phpstan|@phpstan|psalm|@psalm|@codingstandards|checkstyle|nosonar|@suppress|suppress|noinspection|region\b|endregion|@formatter|cspell|spell-?checker|sourcemappingurl|# ?sourcemapping|biome-ignore|deno-lint|skipcq|codeql|lgtm|coverage:|nocov|pylance|ktlint|detekt|swiftlint|clang-format|clang-tidy|cppcheck)",
    re.IGNORECASE,
)
TODO = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip|bug|note to self|optimi[sz]e)\b", re.IGNORECASE)
STAND_IN = re.compile(
    r"^\W*(?:(?:no|missing|empty|without) (?:description|documentation|docs?|comment|docstring)\b.*|(?:description|documentation|docs?|summary|comment|placeholder|undocumented|n/?a|none|internal|helpers?)\W*|auto-?generated (?:method|function|constructor|catch)?\s*(?:stub|block|comment|javadoc).*"
    r"|(?:write|add|insert|put|fill in|enter|provide) (?:a |the |some )?(?:description|documentation|docs?|docstring|comment|text)\b.*|(?:description|documentation|docs) (?:goes here|to follow|pending|to be (?:added|written)).*|to be (?:documented|described|written|done|added|completed)\b.*"
    r"|see (?:above|below|parent|base(?: class)?|super(?:class)?|interface|overridden|implementation)\b.{0,40}|(?:inherited|same) (?:from|as) .{0,40}|(?:this|the) (?:method|function|procedure|constructor)(?: does (?:what (?:its|the) name (?:says|suggests)|something|stuff|things))?\W*|(?:this|the|a|an) [\w ]{1,60} (?:function|method|procedure|constructor)\W*|(?:getter|setter|constructor|destructor)(?: for| of)?\W*\w*\W*|lorem ipsum.*)$",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?i)^\W*(?:copyright\b|\(c\)|licen[sc]ed?\b|spdx-|all rights reserved|<?/?auto-?generated|@generated|autogenerated|code generated by|generated by|this (?:file|code) was|do not (?:edit|modify)|vendored|bundled third|any manual change|[\w-]+ output, source|#?!/)|-----(?:BEGIN|END) ")
CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|^\s*[\w.$@\[\]\"'>-]+(?:\s*:\s*[\w<>\[\]]+)?\s*(?:[-+*/|&]?=|:=|<<)\s*\S|^\s*(?:[\w$]+(?:\.|->|::))*[\w$]+!?\(.*\)\s*[;{:?]*\s*$"
    r"|^\s*(?:if|for|while|return|raise|throw|assert|try|except|catch|switch|case|import|from|const|let|var|def|fn|func|function|class|public|private|else|elif|end|use|package|defer|match|foreach|unless|async|await|with|pub|static|new|print|yield|break|continue|go|select|type|struct)\b.*[(){}\[\];=<>\"'$_]|=>|->\s*\w+\(|\bself\.\w+|\bthis\.\w+|\w+\.\w+\([^)]*\)|^\s*(?:except|try|else|finally|case)\b[^.]*:\s*$|\$\w+\s*->|^\s*(?:if|elif|while|for|with|unless)\b.*:\s*$"
)
_DIVIDER = re.compile(r"^[\W_]*$|^[-=*#~_+.]{3,}.*[-=*#~_+.]{3,}$")
_TAG = re.compile(r"^\s*(?:@|\\)(\w+)|^\s*:(\w+)[^:]*:")
_FLAGS = {"internal", "public", "private", "protected", "override", "inheritdoc", "async", "static", "readonly", "abstract", "final", "api", "ignore", "hidden", "beta", "alpha", "experimental", "deprecated", "summary", "description", "desc", "brief", "details", "remarks", "virtual", "sealed", "function", "method", "memberof", "kind", "export", "exports"}
_TEXT_TAGS = {"summary", "description", "desc", "brief", "details", "remarks"}
_SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args?|arguments|param(?:eter)?s?|returns?|yields?|raises|throws|exceptions?|attributes|keyword args|other parameters|examples?|usage|see also|panics|errors|safety)\s*:?\s*$", re.IGNORECASE)
_INLINE_TAG = re.compile(r"\s(?:@|\\)(?:param|returns?|throws|exception|raise|see|since|version|author|type|arg|tparam|yields?|example|template|var|property)\b.*|\s(?:Args|Arguments|Parameters|Returns|Raises|Yields)\s*:.*|\s:(?:param|returns?|rtype|type|raises)\b.*", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@lru_cache(maxsize=100_000)
def _parts(name: str) -> frozenset[str]:
    return frozenset(p.lower() for p in _SPLIT.findall(name)) | {name.lower()}


def description(lines: list[str], name: str, params: list[str]) -> str:
    """The describing text of comment lines (marks already stripped), without tags, notes, directives, dividers and code."""
    out, tags = [], False
    for raw in lines:
        x = raw.strip()
        x = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", x)
        if not x or _DIVIDER.match(x):
            continue
        m = _TAG.match(x)
        if m:
            word = (m.group(1) or m.group(2)).lower()
            if word in _TEXT_TAGS:
                x, tags = x[m.end() :].strip(), False
            elif word in _FLAGS:
                continue
            else:
                tags = True
                continue
        elif _SECTION.match(x):
            tags = True
            continue
        if tags:
            continue
        if DIRECTIVE.match(x) or TODO.match(x) or STAND_IN.match(x) or HEADER.search(x) or CODE.search(x):
            continue
        out.append(_INLINE_TAG.sub("", " " + x).strip())
    return " ".join(x for x in out if x)


def says_something(text: str, name: str, params: list[str], least: int = 5) -> bool:
    """Whether ``least`` words of description remain beyond the function's name and parameters."""
    known = set(_parts(name))
    for p in params:
        known |= {p.lower()}
        if len(p) > 2:
            known |= _parts(p)
    n = 0
    for token in re.findall(r"[\w$.'’]+", text):
        t = token.strip(".'’")
        if re.search(r"[a-z][A-Z]|_|\d|\w\.\w|\$", t):
            continue  # an identifier or a number, not a word
        for w in _WORD.findall(t):
            n += w.lower() not in known
    return n + len(_CJK.findall(text)) // 2 >= least or len(_CJK.findall(text)) >= 8


def _strip_line(x: str, lang: str) -> str | None:
    """The text of a whole-line comment, None if the line is none."""
    s = x.strip()
    if lang in ("py", "rb"):
        return re.sub(r"^#+[!:]?\s?", "", s) if s.startswith("#") and not s.startswith("#!") else None
    if s.startswith("//"):
        return re.sub(r"^/{2,}[!<]*\s?", "", s)
    if lang == "php" and s.startswith("#") and not s.startswith("#["):
        return s.lstrip("#").strip()
    return None


class Scans:
    """Bracket pairs and block comments of a text, each found in one pass over it when first asked for."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines

    @cached_property
    def _brackets(self) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, int]]:
        close, back, stack = {}, {}, []
        for i, x in enumerate(self.lines):
            for m in _BRACKET.finditer(x):
                if m.group(0) in "([{":
                    stack.append((i, m.start()))
                elif stack:
                    at = stack.pop()
                    close[at] = (i, m.start())
                    back[i] = min(at[0], back.get(i, i))
        return close, back

    def close(self, line: int, column: int) -> tuple[int, int] | None:
        """Where the bracket at this place is closed."""
        return self._brackets[0].get((line, column))

    def bracket_start(self, line: int) -> int:
        """The line on which the outermost of the brackets closed on ``line`` opens."""
        return self._brackets[1].get(line, line)

    @cached_property
    def _comments(self) -> dict[int, int]:
        out, opened = {}, None
        for i, x in enumerate(self.lines):
            if "*/" in x:
                if opened is not None:
                    out[i] = opened
                opened = None
            elif "/*" in x:
                opened = i
        return out

    def comment_start(self, end: int) -> int | None:
        """First line of the block comment that ends on line ``end``."""
        return end if "/*" in self.lines[end] else self._comments.get(end)


def _unmark(lines: list[str]) -> list[str]:
    out = []
    for x in lines:
        s = re.sub(r"^\s*/\*+!?", "", x.rstrip())
        s = re.sub(r"\*+/\s*$", "", s)
        out.append(re.sub(r"^\s*\*+(?!\*)\s?", "", s))
    return out


def doc_above(lines: list[str], at: int, lang: str, scans: Scans) -> list[str]:
    """Text lines of the comments right above line ``at``, above its decorators too; a blank line ends them."""
    found: list[list[str]] = []
    i = at - 1
    while i >= 0:
        s = lines[i].strip()
        if not s:
            break
        if lang == "rb" and s == "=end":
            j = next((k for k in range(i, -1, -1) if lines[k].startswith("=begin")), None)
            if j is None:
                break
            found.append([re.sub(r"^=begin\s?", "", lines[j]), *lines[j + 1 : i]])
            i = j - 1
            continue
        text = _strip_line(lines[i], lang)
        if text is not None:
            found.append([text])
            i -= 1
            continue
        if lang not in ("py", "rb") and s.endswith("*/") and (s.startswith(("/*", "*")) or "/*" not in s):
            j = scans.comment_start(i)
            if j is None or not lines[j].strip().startswith("/*"):
                break
            found.append(_unmark(lines[j : i + 1]))
            i = j - 1
            continue
        m = re.match(r'#\[doc\s*=\s*r?#*"(.*)"#*\]\s*$', s)
        if m:
            found.append([m.group(1)])
            i -= 1
            continue
        if _DECORATOR.match(lines[i]):
            i -= 1
            continue
        if s[-1] in ")]" and s.count("(") + s.count("[") < s.count(")") + s.count("]"):  # the end of a decorator over several lines
            j = scans.bracket_start(i)
            if j < i and _DECORATOR.match(lines[j]):
                i = j - 1
                continue
        break
    return [x for part in reversed(found) for x in part]


def docstring(lines: list[str], after: int) -> list[str]:
    """The documentation string that starts the body behind line ``after`` (Python)."""
    i = after + 1
    while i < len(lines) and not lines[i].strip():
        i += 1
    if i >= len(lines):
        return []
    m = re.match(r"""\s*[rRuUbB]{0,2}(\"\"\"|'''|"|')""", lines[i])
    if not m:
        return []
    q, rest = m.group(1), lines[i][m.end() :]
    out = []
    for j in range(i, len(lines)):
        x = rest if j == i else lines[j]
        k = x.find(q)
        if k >= 0:
            return [*out, x[:k]]
        if len(q) == 1:
            return []
        out.append(x)
    return out


def _signature(lines: list[str], at: int, start: int, scans: Scans) -> tuple[str, str, int]:
    """Text between the parentheses that open at ``start`` of line ``at``, the rest behind them, and the last line."""
    opened = lines[at].find("(", start)
    end = scans.close(at, opened) if opened >= 0 else None
    if end is None:
        return lines[at][opened + 1 :], "", at
    i, k = end
    if i == at:
        return lines[at][opened + 1 : k], lines[at][k + 1 :], at
    return " ".join([lines[at][opened + 1 :], *lines[at + 1 : i], lines[i][:k]]), lines[i][k + 1 :], i


def _split_params(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in text:
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        if c == "," and depth <= 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [x.strip() for x in [*out, cur] if x.strip()]


def parameters(text: str, lang: str) -> list[str]:
    """Parameter names, without types, defaults, receivers and marks."""
    names = []
    for p in _split_params(text):
        p = re.sub(r"@\w+(?:\([^)]*\))?\s*", "", p.split("=")[0]).strip()
        if lang in ("py", "js", "rs", "kt"):
            p = p.split(":")[0]
            words = re.findall(r"[\w$]+", p)
            n = words[-1] if words else ""
        elif lang == "go":
            words = re.findall(r"\w+", p)
            n = words[0] if words else ""
        elif lang == "php":
            m = re.search(r"\$(\w+)", p)
            n = m.group(1) if m else ""
        elif lang == "c":
            m = re.search(r"\(\s*[*&]+\s*(\w+)\s*\)", p)  # a pointer to a function
            words = [m.group(1)] if m else re.findall(r"\w+", re.sub(r"\[[^\]]*\]", "", p))
            n = words[-1] if words and words != ["void"] else ""
        else:
            words = re.findall(r"[\w$]+", p)
            n = words[-1] if words else ""
        if n and n not in ("self", "cls", "this", "mut"):
            names.append(n)
    return names


def signature_of(text: str, lang: str, params: list[str]) -> str:
    """The normalised signature: types where overloads are told apart by them, else the parameter names."""
    if lang not in ("c", "java", "kt"):
        return ",".join(p.lower() for p in params)
    out = []
    for p in _split_params(text):
        p = re.sub(r"@\w+(?:\([^)]*\))?\s*|\b(?:final|struct|class|enum|typename|vararg|noinline|crossinline|ref|out|params)\s+", "", p).split("=")[0].strip()
        if lang == "kt":
            p = p.partition(":")[2] or p
        else:
            p = re.sub(r"\(\s*([*&]+)\s*\w*\s*\)", r"(\1)", p)  # a pointer to a function has its name inside
            m = re.match(r"(.*[\s*&>\]])([A-Za-z_]\w*)((?:\[[^\]]*\])*)$", p, re.DOTALL)
            if m and m.group(2) not in _PRIMITIVE and m.group(1).strip() not in ("const", "volatile"):
                p = m.group(1) + "[]" * m.group(3).count("[")
        p = re.sub(r"\s*([^\w\s])\s*", r"\1", re.sub(r"\s+", " ", p.replace("std::", "")).strip())
        if p and p != "void":
            out.append(p)
    return ",".join(out)


def c_body(lines: list[str], last: int, rest: str) -> bool | None:
    """Whether a body (True) or a semicolon (False) follows a C declarator; None if it is neither."""
    text, j = rest.strip(), last
    while not text:
        j += 1
        if j >= len(lines):
            return None
        text = lines[j].strip()
    if text[0] not in "{;" and not _CTAIL.match(text):
        return None
    while True:
        m = re.search(r"[{;]", text)
        if m:
            return m.group(0) == "{"
        j += 1
        if j >= len(lines) or not lines[j].strip():
            return None
        text = lines[j]


def c_owner(qualifier: str, namespaces: set[str]) -> str:
    """The class that a qualifier such as ``ns::Q<T>::`` names, without the namespaces the text opens or uses."""
    while "<" in qualifier:
        qualifier, n = re.subn(r"<[^<>]*>", "", qualifier)
        if not n:
            break
    parts = [p for p in qualifier.split("::") if p]
    while parts and parts[0] in namespaces:
        parts = parts[1:]
    return ".".join(parts)


def language_of(path: str | None, language: str | None) -> str | None:
    base = (path or "").rsplit("/", 1)[-1]
    ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    return EXT.get(ext) or (LANG.get((language or "").strip().lower()) if not ext or ext not in _OTHER else None)


_OTHER = {"md", "json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "xml", "sql", "sh", "tf", "lock", "css", "html", "txt", "properties", "pem", "key"}


_LONG = re.compile(r"""[rRbBuUfF]{0,2}(\"\"\"|''')""")


_AFTER = {k: re.compile(v.pattern[1:]) for k, v in FUNC.items()}  # the same behind other code of the line
_TYPE_AFTER = re.compile(TYPE.pattern[1:])
_NOTES = re.compile(r"\s*(?:/\*(?:[^*]|\*(?!/))*\*/\s*)*")
_MORE = re.compile(r"[{};,/]\s*[^\s{};,]")
_QUOTED = r'"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|//.*|/\*(?:[^*]|\*(?!/))*\*/|[{}()\[\];,]'
_TOKENS = {True: re.compile(r"'(?:\\.|[^'\\])*'|" + _QUOTED), False: re.compile(r"'(?:\\[^']*|[^'\\])'|" + _QUOTED)}  # else a quote may be a lifetime
_OPENS_LONG = re.compile(r"""^[^#"']*(?:[=(\[{,:+%]|\b(?:return|yield|in|and|or))\s*[rRbBuUfF]{0,2}(\"\"\"|''')""")
_GENERATOR = re.compile(r"\*[\w$]+\(")


def one_a_line(lines: list[str], lang: str) -> list[str]:
    """The lines, broken before every further function or type on a line and behind a comment that stands before one. New lines are indented by the braces that are open."""
    rx, tokens, out, inside = _AFTER[lang], _TOKENS[lang in ("js", "php")], [], False
    for line in lines:
        lead = len(line) - len(line.lstrip())
        start = lead
        if inside:
            if "*/" not in line:
                out.append(line)
                continue
            inside, start = False, line.index("*/") + 2
        elif line.startswith("/*", lead) and "*/" not in line:
            inside = True
            out.append(line)
            continue
        if line.startswith("//", lead) or not (_MORE.search(line) if start == lead else line[start:].strip()):
            out.append(line)
            continue
        cuts: list[tuple[int, int]] = []  # position, open braces

        def begins(at: int, depth: int, line: str = line, lead: int = lead, cuts: list[tuple[int, int]] = cuts) -> None:
            code = _NOTES.match(line, at).end()
            if rx.match(line, code) or _TYPE_AFTER.match(line, code):
                if at > lead:
                    cuts.append((at, depth))
                if line[at:code].strip():
                    cuts.append((code, depth))

        stack: list[str] = []
        begins(start, 0)
        for m in tokens.finditer(line, start):
            x = m.group(0)
            if x in "([{":
                stack.append(x)
            elif x in ")]}" and stack:
                stack.pop()
            if (x in "{};" or (x == "," and lang == "js")) and stack[-1:] in ([], ["{"]):
                begins(m.end(), stack.count("{"))
        ends = [*(a for a, _ in cuts), len(line)]
        out.append(line[: ends[0]])
        out += [" " * (lead + depth) + line[a:b].strip() for (a, depth), b in zip(cuts, ends[1:], strict=True)]
    return out


def functions(text: str, lang: str) -> Iterator[tuple[str, str, str | None, str, bool, str, bool]]:
    """(name, qualified name, the same in the base type, normalised signature, has a body, description, says something) of every function in a text."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lang == "rb":
        lines = [y for x in lines for y in re.split(r";[ \t]*(?=def[ \t])", x)] if ";" in text else lines
    elif lang != "py":
        lines = one_a_line(lines, lang)
    rx, scans = FUNC[lang], Scans(lines)
    types: list[tuple[int, str, str | None]] = []
    inside: str | None = None  # of a block comment or a long string
    skip_to = -1
    namespaces = {x for n in re.findall(r"\bnamespace[ \t]+([\w:]+)", text) for x in n.split("::")} if lang == "c" else set()
    for i, line in enumerate(lines):
        s = line.strip()
        if inside:
            if inside in line:
                inside = None
            continue
        if not s or i <= skip_to:
            continue
        quote = _LONG.match(s) if lang == "py" else None
        if quote and s.count(quote.group(1)) == 1:
            inside = quote.group(1)
            continue
        opens = _OPENS_LONG.match(line) if lang == "py" and not quote else None
        if opens and line.count(opens.group(1)) == 1:
            inside = opens.group(1)  # from the next line on
        if lang == "rb" and s == "=begin":
            inside = "=end"
            continue
        if lang not in ("py", "rb") and s.startswith("/*") and "*/" not in s:
            inside = "*/"
            continue
        if _strip_line(line, lang) is not None or (s.startswith(("*", "/*")) and not (lang == "js" and _GENERATOR.match(s))):
            continue
        t = TYPE.match(line)
        if t:
            ind = len(t.group("ind"))
            base = _BASE.search(line[t.end() :])
            base = t.group("trait") or (base and (base.group(1) or base.group(2)))
            types = [x for x in types if x[0] < ind] + [(ind, t.group("name") or t.group("impl") or t.group("gotype"), base)]
        m = rx.match(line)
        if not m:
            continue
        g = m.groupdict()
        name = g.get("name") or g.get("arrow") or g.get("method")
        if not name or name in ("if", "for", "while", "switch", "catch", "return", "function", "def"):
            continue
        opened, top = line.find("(", m.end() - 1), i
        if lang == "rb":
            opened = m.end() if line[m.end() :].lstrip().startswith("(") else -1
            inner = _signature(lines, i, line.find("(", m.end()), scans)[0] if opened >= 0 else line[m.end() :]
            params = parameters(inner, "rb")
            body, last = True, i
        elif g.get("arrow"):
            tail = line[m.end() - 1 :] if line[m.end() - 1 : m.end()] == "(" else line[m.end() :]
            if line[m.end() - 1 : m.end()] == "(":
                inner, rest, last = _signature(lines, i, m.end() - 1, scans)
                if not (re.match(r"\s*(?::.*)?=>", rest) or "function" in m.group(0)):
                    continue
                params = parameters(inner, lang)
            else:
                a = re.match(r"\s*([\w$]+)\s*=>", tail)
                if not a:
                    continue
                inner, params, last = a.group(1), [a.group(1)], i
            body = True
        else:
            if opened < 0:
                continue
            inner, rest, last = _signature(lines, i, opened, scans)
            follow = rest.strip() or (lines[last + 1].strip() if last + 1 < len(lines) else "")
            if lang == "java":
                if s.startswith(("return", "new ", "else", "throw", "=", ".")) or "=" in line[: m.end()] or not (re.match(r"(?:throws\s[\w., ]+|const|noexcept|override|final|where\b.*|:\s*\w+.*)?\s*\{", follow) or (follow.startswith(";") and re.match(r"^\s*(?:\w[\w.<>\[\], ]*\s+)+[*&]*\w+\s*\(", line))):
                    continue
                if re.match(r"^\s*" + re.escape(name) + r"\s*\(", line) and not name[0].isupper():
                    continue
            if lang == "c":
                name = re.sub(r"\s+", " ", name).strip()
                body = c_body(lines, last, rest)
                while top and lines[top - 1].strip() and _CTYPE_LINE.match(lines[top - 1]) and (not g["type"] or lines[top - 1].lstrip().startswith(("template", "[["))):
                    top -= 1
                own = [x[1] for x in types if x[0] < len(m.group("ind"))][-1:] == [name.lstrip("~")]
                # without a type: a constructor, a definition whose type stands on the line above, or a capitalised macro
                if body is None or ("=" in line[: m.end()] and not name.startswith("operator")) or not (g["type"] or g["qual"] or own or top < i or (body and name[0].isupper())):
                    continue
            if g.get("method") is not None and not re.match(r"(?::\s*[^;]*?)?\{|:\s*[^=;{]*;", follow):
                continue
            params = parameters(inner, lang)
            if lang != "c":
                body = True if lang == "py" else ("{" in rest or follow.startswith("{") or (lang == "kt" and "=" in rest) or (not rest.strip().endswith(";") and g.get("method") is None and lang != "java"))
        around = [x for x in types if x[0] < len(m.group("ind")) or lang == "go"]
        owner = ".".join(x[1] for x in around)
        base = around[-1][2] if around else None
        if g.get("qual"):
            owner, base = c_owner(g["qual"], namespaces), None
        if g.get("recv"):
            r = re.findall(r"\w+", g["recv"])
            owner, base = r[-1] if r else "", None
        name = name.lstrip("#")
        doc = description(doc_above(lines, top, lang, scans), name, params)
        ok = says_something(doc, name, params)
        if lang == "py":
            end = last
            beside = rest.partition(":")[2].strip() if rest.lstrip().startswith((":", "->")) else ""  # a body on the same line
            own = description(docstring([beside, *lines[end + 1 :]], -1) if beside.lstrip("rRuUbB").startswith(('"', "'")) else docstring(lines, end), name, params)
            if own and (not ok or says_something(own, name, params)):
                doc, ok = (own, True) if says_something(own, name, params) else (doc or own, ok)
        skip_to = last if last > i else -1
        base = re.sub(r".*(?:::|\.)", "", base) if base else None
        yield name, f"{owner}.{name}" if owner else name, f"{base}.{name}" if base else None, signature_of(inner, lang, params), body, doc, ok


_TAG_WORDS = {"param", "return", "returns", "throws", "see", "since", "raises", "internal", "deprecated"}


def definition_doc(definition: str, name: str) -> tuple[str, str, bool]:
    """(normalised signature, description, says something) of a stored definition ``signature - documentation``."""
    sig, dash, doc = definition.partition(" - ")
    m = re.search(r"\(", sig)
    params = parameters(_signature([sig], 0, m.start(), Scans([sig]))[0], "php" if "$" in sig else "js") if m else []
    types = [w for w in re.findall(r"[A-Za-z_]\w*", sig) if w != name]
    doc = re.sub(r'#\[doc\s*=\s*r?#*"((?:[^"\\]|\\.)*)(?:"#*\])?', r" \1 ", doc)
    if doc.lstrip().startswith("/*"):
        doc = doc.split("*/")[0]
    doc = re.sub(r"(?:\s+(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\)?)?|#!?\[[^\]]*\]?))+\s*$", lambda m: m.group(0) if _TAG.match(m.group(0).strip()) and _TAG.match(m.group(0).strip()).group(1) in _TAG_WORDS else "", doc)
    lines = re.split(r"\r?\n|(?<=\S)\s+\*\s+(?=\S)|\s+///?\s+|\s+#\s+", doc)
    text = description(_unmark([re.sub(r"^\s*(?://[/!]*|#+|\"\"\"|''')\s*|\s*(?:\"\"\"|''')\s*$", "", x) for x in lines]), name, params) if dash else ""
    return ",".join(p.lower() for p in params), text, says_something(text, name, [*params, *[t for t in types if re.search(r"[a-z][A-Z]|_", t)]])


SYMBOLS = "tbl string, record_id bigint, repo string, function_name string, qualified_name string, base_name string, signature string, has_body boolean, description string, says boolean"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SYMBOLS.split(", ")])


def chunk_symbols(chunks: DataFrame, kinds: tuple[str, ...] = ("function", "class", "block", "fallback")) -> DataFrame:
    """Symbol rows of code chunks of the given types. Null texts and unknown languages give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, repo, path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lang = language_of(path, language)
                if lang:
                    rows += [("code_chunks", i, repo, *f) for f in functions(text, lang)]
                if len(rows) >= 5000:
                    yield _emit(rows)
                    rows = []
            if rows:
                yield _emit(rows)

    src = chunks.where(F.col("chunk_type").isin(*kinds) & F.col("chunk_content").isNotNull() & F.col("id").isNotNull())
    return widen(src.select(F.col("id").cast("bigint").alias("i"), F.rtrim(F.col("repo_path"), F.lit("/")).alias("r"), F.col("file_path").alias("p"), F.col("language").alias("l"), F.col("chunk_content").alias("t"))).mapInArrow(run, SYMBOLS)


def stored_symbols(symbols: DataFrame) -> DataFrame:
    """Symbol rows of stored function and method definitions. Null names or definitions give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, repo, name, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sig, text, ok = definition_doc(d, name)
                rows.append(("code_symbols", i, repo, name, name, None, sig, True, text, ok))
            if rows:
                yield _emit(rows)

    src = symbols.where(F.col("symbol_type").isin("function", "method") & F.col("definition").isNotNull() & F.col("symbol_name").isNotNull() & F.col("id").isNotNull())
    return widen(src.select(F.col("id").cast("bigint").alias("i"), F.rtrim(F.col("repo_path"), F.lit("/")).alias("r"), F.col("symbol_name").alias("n"), F.col("definition").alias("d"))).mapInArrow(run, SYMBOLS)


def function_docs(table: DataFrame, salts: int = 8) -> DataFrame:
    """``(tbl, record_id, function_name, qualified_name, signature, description, source)``: definitions that have a documentation which says something.

    ``table`` is a union of symbol rows. source is ``own``, or ``declaration`` where the text stands at a declaration of the same
    qualified name and signature in the same repository, or else at that of the base type; of several the first in order of the text is taken.
    Declarations without a body are no pairs of their own. Functions of one name in one record give a row each. Definitions are dealt to ``salts``
    parts of a key, so a name that half of all files define (``main``) is no single task; declarations are one row a key.
    """
    table = materialise(table, "symbols")
    defs = table.where("has_body").withColumn("salt", F.pmod(F.xxhash64("record_id", "function_name"), F.lit(salts)).cast("int"))
    keys = ["repo", "qualified_name", "signature"]
    decl = table.where("not has_body and says").groupBy(*keys).agg(F.min("description").alias("declared")).withColumn("salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    inherited = decl.withColumnRenamed("qualified_name", "base_key").withColumnRenamed("declared", "inherited")
    lone = F.concat(F.lit("\x00"), F.col("record_id").cast("string"))  # no base: such rows stay spread over all tasks
    joined = (
        defs.join(decl, [*keys, "salt"], "left")
        .withColumn("base_key", F.coalesce("base_name", lone)).join(inherited, ["repo", "base_key", "signature", "salt"], "left")
    )
    other = F.coalesce("declared", "inherited")
    return joined.where(F.col("says") | other.isNotNull()).select(
        "tbl", "record_id", "function_name", "qualified_name", "signature",
        F.when(F.col("says"), F.col("description")).otherwise(other).alias("description"), F.when(F.col("says"), "own").otherwise("declaration").alias("source"),
    )
