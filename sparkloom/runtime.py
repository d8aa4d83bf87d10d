"""What a long-running service around the engine needs: settings, errors, retries, a cache, timings, a guard for raw SQL and row checks."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# --- errors
class EngineError(Exception):
    """Base of all errors; ``retriable`` says whether the same call may succeed later."""

    retriable = False


class ConfigurationError(EngineError): ...


class ValidationError(EngineError): ...


class NotFoundError(EngineError): ...


class AccessError(EngineError): ...


class ParseError(EngineError): ...


class EncodingError(ParseError): ...


class FileTooLargeError(ParseError): ...


class EmbeddingError(EngineError): ...


class DimensionError(EmbeddingError): ...


class WriteError(EngineError): ...


class QueryError(EngineError): ...


class ServiceUnavailableError(EngineError):
    retriable = True


class RequestTimeoutError(EngineError):
    retriable = True


class ResourceError(EngineError):
    retriable = True


#: Codes in a message that make any error worth another attempt.
RETRIABLE_CODES = ("ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN")


def is_retriable(error: BaseException) -> bool:
    return getattr(error, "retriable", False) or isinstance(error, (ConnectionError, TimeoutError)) or any(c.lower() in str(error).lower() for c in RETRIABLE_CODES)


def retry(fn: Callable, most: int = 3, base_seconds: float = 0.5, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """``fn()``, tried again up to ``most`` times after a retriable error, waiting twice as long each time."""
    for attempt in range(most + 1):
        try:
            return fn()
        except Exception as e:  # noqa: BLE001
            if attempt == most or not is_retriable(e):
                raise
            sleep(base_seconds * 2**attempt)
    raise AssertionError("unreachable")


# --- cache
class Cache:
    """The ``size`` entries used last, each for at most ``ttl`` seconds."""

    def __init__(self, size: int, ttl: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self.rows: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = self.evicted = 0

    def get(self, key: str, make: Callable[[], object] | None = None) -> object | None:
        row = self.rows.get(key)
        if row is not None and self.clock() - row[0] <= self.ttl:
            self.hits += 1
            self.rows.move_to_end(key)
            return row[1]
        self.misses += 1
        self.rows.pop(key, None)
        return self.put(key, make()) if make else None

    def put(self, key: str, value: object) -> object:
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)
            self.evicted += 1
        return value

    def clear(self) -> None:
        self.rows.clear()

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self.rows), "hits": self.hits, "misses": self.misses, "evicted": self.evicted, "hit_rate": self.hits / asked if asked else 0.0}


def caches() -> dict[str, Cache]:
    """The three caches with their usual sizes and times."""
    return {"embeddings": Cache(500, 1800), "results": Cache(200, 300), "endpoints": Cache(100, 600)}


def cache_key(*parts: object) -> str:
    return hashlib.sha256("\x00".join(map(str, parts)).encode()).hexdigest()[:16]


# --- settings
@dataclass(frozen=True)
class Settings:
    """Read from the environment (``SPARKLOOM_`` and the field's name in capitals) and checked against RANGES."""

    max_files: int = 10
    max_chunks: int = 25
    file_threshold: float = 0.3
    chunk_threshold: float = 0.2
    dedup_threshold: float = 0.92
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    import_depth: int = 3
    max_tokens: int = 100_000
    chunk_lines_min: int = 50
    chunk_lines_max: int = 500
    max_file_lines: int = 5000
    embedding_dimensions: int = 1024

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env, values = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get("SPARKLOOM_" + f.name.upper())
            if raw is None:
                continue
            try:
                values[f.name] = type(f.default)(raw)
            except ValueError as e:
                raise ConfigurationError(f"{f.name}: {raw!r} is no {type(f.default).__name__}") from e
        out = cls(**values)
        for name, (lo, hi) in RANGES.items():
            if not lo <= getattr(out, name) <= hi:
                raise ConfigurationError(f"{name}: {getattr(out, name)} lies outside {lo} to {hi}")
        if out.chunk_lines_min > out.chunk_lines_max:
            raise ConfigurationError("chunk_lines_min exceeds chunk_lines_max")
        return out


RANGES = {
    "max_files": (1, 100), "max_chunks": (1, 200), "file_threshold": (0, 1), "chunk_threshold": (0, 1), "dedup_threshold": (0, 1), "vector_weight": (0, 1), "keyword_weight": (0, 1), "import_depth": (0, 10), "max_tokens": (1000, 1_000_000), "chunk_lines_min": (1, 10_000), "chunk_lines_max": (1, 10_000),
    "max_file_lines": (100, 1_000_000), "embedding_dimensions": (1, 65_536),
}


# --- guard and row checks
#: Statements no query may hold.
FORBIDDEN = (r"\bdrop\s+database\b", r"\bcreate\s+database\b", r"\balter\s+database\b", r"\bpg_terminate_backend\b", r"\bpg_cancel_backend\b")


def guarded_sql(spark: SparkSession, sql: str, schema: str = "default") -> tuple[DataFrame, list[str]]:
    """The result of ``sql`` and the names of other schemas it refers to; a forbidden statement is an AccessError and is not run."""
    foreign = check_sql(sql, schema)
    return spark.sql(sql), foreign


def check_sql(sql: str, schema: str = "default") -> list[str]:
    low = sql.lower().strip()
    for rx in FORBIDDEN:
        if re.search(rx, low):
            raise AccessError(f"the query holds a forbidden statement: {rx}")
    if not re.search("from|into|update", low):
        return []
    return sorted(set(re.findall(r"\b([a-z_]\w*)\.\w+", low)) - {schema, "information_schema"})


#: What the columns of endpoints and documentation chunks may hold.
API_TYPES = ("rest", "graphql", "grpc")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
DOC_CHUNK_TYPES = ("section", "code_block")


def endpoint_violation(api_type: Column, method: Column) -> Column:
    """What is wrong with an endpoint row, null if nothing: its type, its method, or a REST endpoint without one."""
    return (
        F.when(api_type.isNull() | ~api_type.isin(*API_TYPES), "api_type").when(method.isNotNull() & ~method.isin(*HTTP_METHODS), "http_method").when((api_type == "rest") & method.isNull(), "rest_without_method")
    )


def doc_chunk_violation(chunk_type: Column) -> Column:
    return F.when(chunk_type.isNull() | ~chunk_type.isin(*DOC_CHUNK_TYPES), "chunk_type")


def checked(options: Mapping[str, object], rules: Mapping[str, Mapping[str, object]]) -> dict[str, object]:
    """Options after their rules (type, least, most, one_of, least_length, default, required); the first violated one is a ValidationError."""
    out: dict[str, object] = {}
    for unknown in set(options) - set(rules):
        raise ValidationError(f"unknown option {unknown}")
    for name, rule in rules.items():
        value = options.get(name, rule.get("default"))
        if value is None:
            if rule.get("required"):
                raise ValidationError(f"{name} is required")
            continue
        kind = rule.get("type")
        if kind and (not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool)):
            raise ValidationError(f"{name} has the wrong type")
        if "least" in rule and value < rule["least"] or "most" in rule and value > rule["most"]:
            raise ValidationError(f"{name} lies outside {rule.get('least')} to {rule.get('most')}")
        if "one_of" in rule and value not in rule["one_of"]:
            raise ValidationError(f"{name} is none of {', '.join(map(str, rule['one_of']))}")
        if "least_length" in rule and len(value.strip() if isinstance(value, str) else value) < rule["least_length"]:
            raise ValidationError(f"{name} is too short")
        out[name] = value
    return out


# --- timings, health, progress
class Timings:
    """Durations of named stages, as rows for ``operators.metrics.stage_statistics``."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, float, float | None]] = []

    @contextmanager
    def stage(self, name: str, items: int | None = None) -> Iterator[None]:
        import resource

        began, held = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.rows.append((name, took * 1000, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - held) / 1024, items / took if items and took else None))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, duration_ms double, memory_mb double, throughput double")


def health(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, object]:
    """Whether the session answers, and which tables can be read."""
    state: dict[str, object] = {"session": spark.range(1).count() == 1}
    for name, df in tables.items():
        try:
            df.limit(1).count()
            state[name] = True
        except Exception:  # noqa: BLE001
            state[name] = False
    return state


class Progress:
    """Share done and seconds left, told to ``listener(done, total, share, seconds_left)`` after each step."""

    def __init__(self, total: int, listener: Callable[[int, int, float, float | None], None], clock: Callable[[], float] = time.monotonic) -> None:
        self.total, self.done, self.listener, self.clock = total, 0, listener, clock
        self.began = clock()

    def step(self, n: int = 1) -> None:
        self.done = min(self.total, self.done + n)
        rate = self.done / max(self.clock() - self.began, 1e-9)
        self.listener(self.done, self.total, self.done / self.total if self.total else 1.0, (self.total - self.done) / rate if self.done else None)
