"""File discovery with ``binaryFile``: ignore rules, exclusions, encodings and content checks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Directories, extensions and parts of names that are never indexed.
EXCLUDED_DIRS = (
    "node_modules .git .svn .hg dist build out coverage .next .nuxt .cache .parcel-cache .turbo __pycache__ .pytest_cache .mypy_cache venv env .venv .env target bin obj vendor .gradle .mvn bower_components"
).split()
BINARY_EXTENSIONS = (
    "png jpg jpeg gif bmp ico svg webp tiff tif raw heic heif avif psd mp4 avi mov mkv webm wmv flv m4v 3gp mpeg mpg ogv mp3 wav flac aac ogg wma m4a opus mid midi ttf otf woff woff2 eot "
    "zip tar gz bz2 7z rar dmg iso exe dll so dylib wasm deb rpm apk obj fbx blend max stl dae db sqlite sqlite3 mdb accdb doc docx xls xlsx ppt pptx pdf"
).split()
GENERATED_PARTS = "package-lock.json yarn.lock pnpm-lock.yaml bun.lockb Cargo.lock Gemfile.lock poetry.lock composer.lock .min.js .bundle.js .min.css .map -min.js -bundle.js".split()
SPEC_DIRS = "node_modules .git dist build .next coverage".split()
SERVICE_DIRS = "node_modules .git dist build".split()
SERVICE_EXTENSIONS = "ts js tsx jsx py go java rs".split()
SECRET_PATHS = r"(?i)(^|/)(\.env(\..*)?|.*\.(pem|key|p12|pfx|keystore)|id_(rsa|dsa|ecdsa|ed25519)|credentials(\.json)?|secrets?\.(json|ya?ml|toml)|\.npmrc|\.netrc|\.pypirc)$"
MAX_LINES, MAX_CONTROL, MAX_LINE_CHARS = 10_000, 10, 10_000


def gitignore_regex(patterns: Sequence[str]) -> list[tuple[bool, str]]:
    """(negated, regular expression on the relative path) for each line of an ignore file."""
    out = []
    for raw in patterns:
        p = raw.rstrip("\n").strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p.lstrip("!")
        anchored = "/" in p.rstrip("/")
        only_dir = p.endswith("/")
        p = p.strip("/")
        rx, i = "", 0
        while i < len(p):
            if p[i : i + 3] == "**/":
                rx, i = rx + r"(?:.*/)?", i + 3
            elif p[i : i + 2] == "**":
                rx, i = rx + ".*", i + 2
            elif p[i] == "*":
                rx, i = rx + "[^/]*", i + 1
            elif p[i] == "?":
                rx, i = rx + "[^/]", i + 1
            else:
                rx, i = rx + re.escape(p[i]), i + 1
        out.append((negated, ("^" if anchored else r"(?:^|/)") + rx + ("/" if only_dir else r"(?:/|$)")))
    return out


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """The last matching rule decides."""
    out = F.lit(False)
    for negated, rx in gitignore_regex(patterns):
        out = F.when(path.rlike(rx), F.lit(not negated)).otherwise(out)
    return out


def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect(bytes(c)) if c is not None else (None, 0.0, None) for c in content], columns=["encoding", "confidence", "text"])


def decode(content: Column) -> Column:
    """Struct of encoding, confidence and text of a binary column."""
    return F.pandas_udf(_decoded, "struct<encoding string, confidence double, text string>")(content)


def detect(b: bytes) -> tuple[str, float, str | None]:
    """Byte-order mark, then zero bytes, then UTF-8, then Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if b.startswith(mark):
            return name, 1.0, b[len(mark) :].decode(name, "replace")
    if b"\x00" in b[:4096]:
        even, odd = b[0:4096:2].count(0), b[1:4096:2].count(0)
        half = max(1, len(b[:4096]) // 2)
        if odd > 0.3 * half and even < 0.1 * half:
            return "utf-16-le", 0.8, b.decode("utf-16-le", "replace")
        if even > 0.3 * half and odd < 0.1 * half:
            return "utf-16-be", 0.8, b.decode("utf-16-be", "replace")
        return "binary", 0.9, None
    try:
        return "utf-8", 0.95, b.decode("utf-8")
    except UnicodeDecodeError:
        return "latin-1", 0.5, b.decode("latin-1")


def repair(text: Column) -> Column:
    """Control characters but tab, line feed and carriage return removed."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def is_valid(text: Column) -> Column:
    return (F.size(F.split(text, "\n")) <= MAX_LINES) & (F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) <= MAX_CONTROL) & ~F.exists(F.split(text, "\n"), lambda x: F.char_length(x) > MAX_LINE_CHARS)


def _base(root: str) -> str:
    return "file:" + root.rstrip("/") + "/" if "://" not in root and not root.startswith("file:") else root.rstrip("/") + "/"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, file_path, size, last_modified)`` of everything below ``root``; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.regexp_replace("path", "^" + re.escape(_base(root)), "").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def _outside(p: Column, dirs: Sequence[str]) -> Column:
    parts = F.split(p, "/")
    return ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in dirs]))


def read_content(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``) and their ``content``; only these files are opened, one after the other in each task. An unreadable one has null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    system, at = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(at) as src:
                        data = src.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([data], pa.binary())], names=[*b.schema.names, "content"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def root_ignore(spark: SparkSession, root: str) -> list[str]:
    """The lines of the ignore file at the root (one file, read by the driver); none if there is none."""
    # a name that starts with a dot is hidden from the readers of tables
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.gitignore")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    src = fs.open(path)
    try:
        return bytes(src.readAllBytes()).decode("utf-8", "replace").splitlines()
    finally:
        src.close()


def wanted_paths(files: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows whose path is worth indexing: not ignored or excluded, no binary, generated or secret file, no prose but the root README, a known language."""
    from sparkloom.functions.text import extension, language

    p = F.col("file_path")
    f = files.where(~ignored(p, ignore)).where(_outside(p, EXCLUDED_DIRS)).where(~F.substring(extension(p), 2, 20).isin(BINARY_EXTENSIONS)).where(~p.rlike(SECRET_PATHS))
    for x in GENERATED_PARTS:
        f = f.where(~F.element_at(F.split(p, "/"), -1).contains(x))
    return f.withColumn("language", language(p)).where((F.col("language") != "unknown") & ((F.col("language") != "markdown") | F.lower(p).isin("readme.md", "readme.markdown")))


def markdown_files(files: DataFrame) -> DataFrame:
    """Markdown below a root, folders that start with a dot and installed packages left out."""
    p = F.col("file_path")
    return files.where(F.lower(p).rlike(r"\.(md|markdown)$") & ~p.rlike(r"(^|/)(\.[^/]+|node_modules)/"))


def api_spec_files(files: DataFrame) -> DataFrame:
    """API descriptions by name: OpenAPI or Swagger, GraphQL schemas, protocol buffers."""
    p, name = F.col("file_path"), F.lower(F.element_at(F.split("file_path", "/"), -1))
    named = name.contains("openapi") | name.contains("swagger") | name.isin("api.yaml", "api.yml", "api.json") | name.rlike(r"\.(graphql|gql|proto)$")
    return files.where(_outside(p, SPEC_DIRS) & named)


def service_code_files(files: DataFrame, service_path: str) -> DataFrame:
    p = F.col("file_path")
    return files.where(p.startswith(service_path.rstrip("/") + "/") & _outside(p, SERVICE_DIRS) & p.rlike(r"\.(" + "|".join(SERVICE_EXTENSIONS) + ")$"))


def resolve_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Files as given, the Markdown files below each folder, and paths that do not exist (reported by whoever reads them)."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            out += sorted(p.rstrip("/") + "/" + r.file_path for r in markdown_files(listing(spark, p)).select("file_path").collect())
        else:
            out.append(p)
    return out


def discover(spark: SparkSession, root: str, ignore: Sequence[str] | None = None, max_lines: int = 5000) -> DataFrame:
    """``(file_path, language, content, encoding, total_lines, file_hash, size, last_modified, valid)`` of the files worth indexing below ``root``.

    Paths are listed and filtered first; only the files that pass are opened. ``ignore`` defaults to the root's ignore file. Left out are also files over
    ``max_lines`` lines and undecodable ones. Control characters are removed from the content; ``valid`` says whether it was fit to index as it stood.
    """
    from sparkloom.functions.text import line_count

    f = read_content(wanted_paths(listing(spark, root), root_ignore(spark, root) if ignore is None else ignore))
    f = f.withColumn("d", decode(F.col("content"))).where(F.col("d.text").isNotNull())
    text = F.col("d.text")
    f = f.where(line_count(text) <= max_lines)
    return f.select(
        "file_path", "language", repair(text).alias("content"), F.col("d.encoding").alias("encoding"), line_count(text).alias("total_lines"), F.sha2("content", 256).alias("file_hash"), "size", "last_modified", is_valid(text).alias("valid")
    )
