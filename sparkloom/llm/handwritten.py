"""Generated, minified, vendored and data files among source files.

Every chunk is read once: marker comments, line forms, and fingerprints of the normalised token stream. Tokens are
words and single signs, lower-cased, numbers alike; the hashes of all runs of ``GRAM`` tokens are winnowed with windows of
``WINDOW``, so any shared passage of ``GRAM + WINDOW - 1`` tokens has a fingerprint in common. A fingerprint that occurs in many
repositories is common property; a file most of whose fingerprints are common property is a vendored copy. Repositories
are counted after pairs (fingerprint, repository) have been made distinct, so a passage that stands in a third of all files
is one row per repository; the test of a file's own fingerprints is a join salted by file, so that no fingerprint, however common, is one task.

The fingerprints are asked first, of every file with at least one. Paths, markers and forms decide the other kinds, and the vendored files that recur nowhere in the collection. Markers count only in comments: a string that holds one belongs to a program that writes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.wordhash import U64, byte_batches, mix, range_hashes, shingles
from sparkloom.session import materialise, widen

GRAM, WINDOW = 12, 16

_LEAD = r"^\s*(?://+!?|/\*+!?|\*+|#+|--+|;+|<!--|%+|\"\"\"|''')\s*"
GENERATED = re.compile(
    _LEAD + r"(?:<auto-?generated\b|@generated\b|autogenerated\b|automatically generated\b|auto-?generated (?:by|from|file|code|using|with|on)\b|(?:this|the) (?:file|code|source|class|module) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|created|produced|written by|built)\b.*"
    r"|(?:code |file )?generated (?:by|from|with|using) (?:the )?[\w@./-]+.*(?:do not (?:edit|modify|change|touch)|v?\d+\.\d+|from\b)|.*\bgenerated by\b.*\bdo not edit\b|.*\boutput, source: \S+|do not (?:edit|modify|change)\b.*(?:by hand|manually|directly|generated|overwritten|file)|.*\bedits (?:are|will be) lost\b|(?:source|mapped) from:? \S+\.(?:proto|idl|graphql|thrift|avsc|wsdl|xsd|yaml)\b.*)",
    re.IGNORECASE,
)
VENDORED = re.compile(
    _LEAD + r"(?:vendored\b|bundled (?:third[- ]party|source|copy)|third[- ]party (?:source|code)\b|imported from https?://|copied (?:unchanged |verbatim )?from\b|taken (?:unchanged |verbatim )?from https?://|.*\bcopied (?:unchanged|verbatim)\b|.*\|\s*\(c\) .*\|\s*(?:released|licensed|license)|[\w.@/ -]{2,40} v?\d+\.\d+(?:\.\d+)?\b.*(?:license|licence|\(c\)|copyright)|mirrored from\b|upstream:? https?://|.*\b(?:upstream|vendor(?:ed)?|third[- ]party) copy\b)",
    re.IGNORECASE,
)
_MARK = re.compile(r"(?i)generat|creat|produc|output|do not|edits|from|vendor|upstream|bundled|third|copied|\(c\)|licen[sc]e")
_TABLE = re.compile(
    r"""^\s*(?:["'`][A-Za-z0-9+/=]{40,}["'`]\s*[+.\\,;)]*\s*$|[\[({]?\s*(?:-?\d[\d.eE+-]*|0x[0-9a-fA-F]+)(?:\s*,\s*(?:-?\d[\d.eE+-]*|0x[0-9a-fA-F]+)){3,}|\{\s*"[^"]{1,40}"\s*:.*\}\s*,?\s*$|(?:new \w+\[\] ?\{|\[\]\w*(?:\{\})?\{|vec!\[|array\(|[\[({])\s*(?:"[^"]*"|'[^']*'|-?[\d.]+)(?:\s*,\s*(?:"[^"]*"|'[^']*'|-?[\d.]+)){2,}\s*[\])}]\s*[,;]?\s*$|["'`]?(?:\\x[0-9a-fA-F]{2}|\\\d{3}){8,}|[A-Za-z0-9+/=]{60,}\s*$)"""
)
_ESCAPES = re.compile(r"(?:\\x[0-9a-fA-F]{2}){24,}|[A-Za-z0-9+/=]{200,}")

#: Path rules (regular expressions of the JVM).
PATH_GENERATED = r"(?i)(^|/)(generated|__generated__|auto[-_]?generated|codegen-output|generated[-_]sources?)/|[._-](generated|autogenerated)\.[a-z]+$|[_-]gen\.(go|ts|js|py|rs)$|_pb2(_grpc)?\.pyi?$|\.pb(\.gw|\.validate)?\.(go|cc|h|rb|ts|js)$|\.(g|freezed)\.dart$|\.designer\.(cs|vb)$|_grpc\.pb\.go$|_pb\.(js|rb|d\.ts)$|zz_generated[^/]*$"
PATH_VENDORED = r"(?i)(^|/)(node_modules|bower_components|jspm_packages|vendor|vendored|third[-_]?party|externals?|pods|site-packages)/"
PATH_MINIFIED = r"(?i)[.-](min|bundle|bundled|chunk|packed)\.(m?js|cjs|css)(\.map)?$|(^|/)(dist|build|out|public|static)/(.*/)?[^/]*[.-][0-9a-f]{8,}\.(m?js|css)$|\.(js|css|ts)\.map$"
PATH_LOCK = r"(?i)(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|go\.sum|[^/]+\.lock|packages\.lock\.json|gradle\.lockfile|[^/]+\.lockb|flake\.lock|Package\.resolved|conda-lock\.ya?ml|pubspec\.lock)$"
PATH_PROSE = r"(?i)\.(md|mdx|markdown|rst|adoc|txt)$"

PARSED = "repo bigint, file bigint, generated boolean, vendored boolean, chars bigint, dense bigint, code_lines int, table_lines int, prints array<bigint>"


def _h(x: str) -> int:
    import xxhash

    v = xxhash.xxh64_intdigest(x)
    return v - (1 << 64) if v >= 1 << 63 else v


def file_key(repo: str | None, path: str | None) -> tuple[int, int]:
    r = (repo or "").rstrip("/")
    return _h(r), _h(r + "\x00" + (path or ""))


def winnow(h: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct window minima of each text's hashes; a text with fewer hashes than a window keeps its minimum."""
    out, cuts = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        x = h[a:b]
        if len(x) > window:
            x = np.lib.stride_tricks.sliding_window_view(x, window).min(axis=1)
            x = np.unique(x)
        elif len(x):
            x = x.min(keepdims=True)
        out.append(x)
        cuts.append(cuts[-1] + len(x))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.array(cuts, np.int64)


_ALPHA = np.zeros(256, dtype=bool)
_SPACE = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz_" + bytes(range(128, 256)):
    _ALPHA[_c] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
for _c in b" \t\r\n\x00\x0b\x0c":
    _SPACE[_c] = True


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised tokens of all texts: words, numbers (all alike) and single signs, without white space."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    word = _ALPHA[buf] | _DIGIT[buf]
    prev = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero((word & ~prev) | (~word & ~_SPACE[buf]))
    nextw = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero((word & ~nextw) | (~word & ~_SPACE[buf])) + 1
    h = range_hashes(buf, starts, ends)
    h[_DIGIT[buf[starts]]] = U64(0x51ED270B7A1F3C55)
    return h, np.searchsorted(starts, cuts)


_SIGNS = frozenset("/*#-;<%\"'")
_COMMENT = re.compile(_LEAD)
_LONG_STRING = re.compile(r"\"\"\"|\'\'\'|`")


def _notices(lines: list[str]) -> tuple[bool, bool]:
    """Whether comments of a text say that the file is generated or vendored.

    A notice about the file stands in the comments on top, or in a comment at the left margin anywhere; indented comments
    further down (stubs of methods) and lines within long strings speak of something else.
    """
    gen = ven = block = False
    leading = True
    for k, x in enumerate(lines):
        s = x.lstrip()
        if not s:
            continue
        if block:
            block = "*/" not in s and "-->" not in s
        elif s[0] in _SIGNS and _COMMENT.match(s):
            if not leading and len(s) < len(x):
                continue
            block = s.startswith("/*") and "*/" not in s or s.startswith("<!--") and "-->" not in s
        else:
            leading = leading and s.startswith("<?")
            continue
        if s.startswith("/*"):
            s = s.split("*/", 1)[0]
        if not _MARK.search(s):
            continue
        g, v = GENERATED.match(s) is not None, VENDORED.match(s) is not None
        if (g or v) and not leading:
            marks = [m for y in lines[:k] if not _COMMENT.match(y) or y.lstrip()[0] in "\"'" for m in _LONG_STRING.findall(y)]
            if any(marks.count(q) % 2 for q in set(marks)):
                continue
        gen, ven = gen or g, ven or v
        if gen and ven:
            break
    return gen, ven


def _forms(text: str) -> tuple[bool, bool, int, int, int, int]:
    """Marker comments of a text, and its line forms."""
    lines = text.split("\n")
    gen, ven = _notices(lines)
    dense = tables = full = 0
    for x in lines:
        n = len(x)
        if not n or x.isspace():
            continue
        full += 1
        if n > 300:
            if x.count(" ") + x.count("\t") < 0.08 * n:
                dense += n
            if _ESCAPES.search(x):
                tables += 1
                continue
        if _TABLE.match(x):
            tables += 1
    return gen, ven, len(text), dense, full, 0 if "-----BEGIN" in text else tables


def parse_chunks(chunks: DataFrame, repo: str, path: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for b in batches:
            r, p, t = (c.to_pylist() for c in b.columns)
            for lo, hi in byte_batches(t):
                h, off = token_hashes(t[lo:hi])
                prints, po = winnow(*shingles(h, off, GRAM), WINDOW)
                keys = [file_key(*x) for x in zip(r[lo:hi], p[lo:hi], strict=True)]
                forms = list(zip(*map(_forms, t[lo:hi]), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(forms[0], pa.bool_()), pa.array(forms[1], pa.bool_()),
                        pa.array(forms[2], pa.int64()), pa.array(forms[3], pa.int64()), pa.array(forms[4], pa.int32()), pa.array(forms[5], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(po.astype(np.int32)), pa.array(mix(prints).view(np.int64))),
                    ],
                    names=names,
                )

    return widen(chunks.select(F.col(repo).alias("r"), F.col(path).alias("p"), F.col(text).alias("t")).where("t is not null and p is not null")).mapInArrow(run, PARSED)


def classify_files(
    files: DataFrame,
    chunks: DataFrame,
    file_id: str = "id",
    repo: str = "repo_path",
    path: str = "file_path",
    text: str = "chunk_content",
    min_repos: int = 4,
    min_share: float = 0.8,
    salts: int = 8,
) -> DataFrame:
    """``(file_id, kind, evidence)`` for every row of ``files``; kind is generated, minified, vendored, data, lock or null (hand-written).

    evidence says what showed it first: fingerprints, marker, path or form (null for hand-written files).

    A file's content is all chunks of its (repository, path), slashes at the end of the repository aside; each row of a
    file stored repeatedly gets the same kind. A file without chunks is judged by its path alone. A file is a vendored copy
    if ``min_share`` of its fingerprints occur in ``min_repos`` repositories, unless a marker, path or form gives it another kind
    besides. Prose files are hand-written whatever they hold. Null paths give null kinds; empty texts have no forms.
    """
    parsed = materialise(parse_chunks(chunks, repo, path, text), "files-parsed")
    each = parsed.select("repo", "file", F.explode("prints").alias("p")).distinct()
    common = each.groupBy("p", "repo").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count("*").alias("repos")).where(F.col("repos") >= min_repos)
    common = common.select("p", F.explode(F.expr(f"sequence(0, {salts - 1})")).alias("salt"), F.lit(1).alias("shared"))
    salted = each.select("file", "p", F.pmod(F.xxhash64("file"), F.lit(salts)).cast("int").alias("salt"))
    share = salted.join(common, ["p", "salt"], "left").groupBy("file").agg(F.count("*").alias("prints"), F.count("shared").alias("shared"))
    content = parsed.groupBy("file").agg(
        F.max("generated").alias("generated"), F.max("vendored").alias("vendored"), F.sum("chars").alias("chars"), F.sum("dense").alias("dense"),
        F.sum("code_lines").alias("code_lines"), F.sum("table_lines").alias("table_lines"),
    )
    keyed = keyed_files(files, file_id, repo, path)
    path_is = lambda rx: F.col("path").rlike(rx)
    yes = lambda c: F.coalesce(c, F.lit(False))
    prose = F.col("path").isNull() | path_is(PATH_PROSE)
    recurs = yes((F.col("prints") > 0) & (F.col("shared") >= min_share * F.col("prints")))
    form: Column = (
        F.when(yes(F.col("dense") >= 0.5 * F.col("chars")), "minified")
        .when(yes((F.col("table_lines") >= 0.6 * F.col("code_lines")) & (F.col("code_lines") > 0)) & ~path_is(r"(?i)\.(json|ya?ml|toml|ini|cfg|conf|env|properties|xml|tf|sql|csv|npmrc|pem|key|crt)$|(^|/)\.env"), "data")
    )
    by_path = F.when(path_is(PATH_LOCK), "lock").when(path_is(PATH_GENERATED), "generated").when(path_is(PATH_VENDORED), "vendored").when(path_is(PATH_MINIFIED), "minified")
    marker = F.when(yes(F.col("generated")), "generated").when(yes(F.col("vendored")), "vendored")
    special = F.when(by_path == "lock", "lock").otherwise(F.coalesce(F.when(marker == "generated", marker), F.when(by_path == "generated", by_path), F.when(by_path == "vendored", by_path), marker, by_path, form))
    evidence = F.when(recurs, "fingerprints").when(by_path == "lock", "path").when(marker.isNotNull(), "marker").when(by_path.isNotNull(), "path").when(form.isNotNull(), "form")
    joined = keyed.join(content, "file", "left").join(share, "file", "left")
    return joined.select(
        "file_id", F.when(~prose, F.coalesce(special, F.when(recurs, "vendored"))).alias("kind"), F.when(~prose, evidence).alias("evidence")
    )


def keyed_files(files: DataFrame, file_id: str, repo: str, path: str) -> DataFrame:
    """``(file_id, path, file)``: the same key hash the parse uses, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [file_key(*x)[1] for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.int64())], names=["file_id", "path", "file"])

    return files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(repo).alias("r"), F.col(path).alias("p")).mapInArrow(run, "file_id bigint, path string, file bigint")


def not_handwritten(kinds: DataFrame) -> DataFrame:
    return kinds.where("kind is not null and file_id is not null").select("file_id")
