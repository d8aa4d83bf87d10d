"""From ranked candidates to context: near-duplicate removal, priorities, groups, totals and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise

#: Rank multiplier and bucket of each repository type.
PRIORITY = {"monolithic": 1.0, "microservice": 1.0, "monorepo": 1.0, "library": 0.9, "reference": 0.6, "documentation": 0.5}
BUCKET = {"monolithic": "primary_code", "microservice": "primary_code", "monorepo": "primary_code", "library": "libraries", "reference": "references", "documentation": "documentation"}
CAPS = {"references": 5, "documentation": 3}
SYMBOL_TOKENS, IMPORT_TOKENS = 50, 30
MAX_CANDIDATES = 1000


def _lookup(table: dict, col: Column, default) -> Column:  # noqa: ANN001
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def greedy_dedup(candidates: DataFrame, key: str, vector: str, score: str, threshold: float = 0.92, at_once: int = MAX_CANDIDATES, block: int = 512) -> DataFrame:
    """``(key, score, duplicate_of)``: in order of score a row is kept unless its cosine to a kept row exceeds ``threshold``.

    duplicate_of names the first such kept row, null for kept rows; rows without a vector are never duplicates, ties go to the smaller key, a repeated key is a
    row like any other. Up to ``at_once`` rows (the candidates of one search) are folded in one task; more are compared block against block, and decided
    in rounds over the pairs above the threshold: a row is kept once every better row like it is dropped, and dropped once one of them is kept. The result is the same.
    """
    rows = materialise(candidates.select(key, vector, F.col(score).cast("double").alias(score)), "candidates")
    if rows.limit(at_once + 1).count() > at_once:
        return _dedup_in_rounds(rows, key, vector, score, threshold, block)

    def fold(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values([score, key], ascending=[False, True], kind="stable")
        kept: list[tuple] = []
        dup = []
        for k, v in zip(pdf[key], pdf[vector], strict=True):
            u = _unit(v)
            hit = next((o for o, w in kept if u is not None and w is not None and len(w) == len(u) and float(u @ w) > threshold), None)
            dup.append(hit)
            if hit is None:
                kept.append((k, u))
        pdf["duplicate_of"] = dup
        return pdf[[key, score, "duplicate_of"]]

    kind = dict(candidates.dtypes)[key]
    return rows.withColumn("__one", F.lit("all")).groupBy("__one").applyInPandas(fold, f"{key} {kind}, {score} double, duplicate_of {kind}")


def _unit(v):  # noqa: ANN001, ANN202
    import numpy as np

    u = None if v is None else np.asarray(v, float)
    return u / np.linalg.norm(u) if u is not None and np.isfinite(u).all() and np.linalg.norm(u) > 0 else None


def _dedup_in_rounds(rows: DataFrame, key: str, vector: str, score: str, threshold: float, block: int) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    parts = max(1, -(-rows.count() // block))
    dealt = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(score).alias("s"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    left = dealt.withColumn("i", F.col("part")).withColumn("j", F.explode(F.expr(f"sequence(part, {parts - 1})"))).withColumn("side", F.lit(0))
    right = dealt.withColumn("j", F.col("part")).withColumn("i", F.explode(F.expr("sequence(0, part)"))).withColumn("side", F.lit(1))

    def compare(pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        sides = []
        for x in (0, 1):
            p = pdf[pdf["side"] == x]
            units = [_unit(v) for v in p["v"]]
            there = [n for n, u in enumerate(units) if u is not None]
            sides.append((p["k"].to_numpy()[there], p["s"].to_numpy()[there], [units[n] for n in there]))
        (ka, sa, ua), (kb, sb, ub) = sides
        out = []
        for dim in {len(u) for u in ua} & {len(u) for u in ub}:
            ia, ib = [n for n, u in enumerate(ua) if len(u) == dim], [n for n, u in enumerate(ub) if len(u) == dim]
            hit = np.stack([ua[n] for n in ia]) @ np.stack([ub[n] for n in ib]).T > threshold
            for x, y in zip(*np.nonzero(hit), strict=True):
                a, b = (ka[ia[x]], sa[ia[x]]), (kb[ib[y]], sb[ib[y]])
                if a[0] != b[0] and ((a[1], b[0]) > (b[1], a[0])):
                    out.append((a[0], a[1], b[0]))
                elif a[0] != b[0] and pdf["i"].iloc[0] != pdf["j"].iloc[0]:
                    out.append((b[0], b[1], a[0]))
        return pd.DataFrame(out, columns=["better", "better_score", "worse"])

    pairs = materialise(left.unionByName(right).groupBy("i", "j").applyInPandas(compare, f"better {kind}, better_score double, worse {kind}").distinct(), "alike")
    state = materialise(dealt.select("k", F.when(F.lit(False), F.lit("")).alias("state")).join(pairs.select(F.col("worse").alias("k")).distinct().withColumn("behind", F.lit(True)), "k", "left").select("k", F.when(F.col("behind").isNull(), "kept").alias("state")).distinct(), "state")
    while not state.where("state is null").isEmpty():
        seen = pairs.join(state.select(F.col("k").alias("better"), F.col("state").alias("of")), "better").groupBy(F.col("worse").alias("k")).agg(F.max(F.col("of") == "kept").alias("hit"), F.max(F.col("of").isNull()).alias("open"))
        nxt = F.coalesce("state", F.when(F.col("hit"), "dropped").when(~F.col("open"), "kept"))
        state = materialise(state.join(seen, "k", "left").select("k", nxt.alias("state")), "state")
    first = pairs.join(state.where("state = 'kept'").select(F.col("k").alias("better")), "better").groupBy(F.col("worse").alias(key)).agg(F.min_by("better", F.struct(-F.col("better_score"), F.col("better"))).alias("duplicate_of"))
    return rows.select(key, score).join(first, key, "left")


def prioritise(rows: DataFrame, repositories: DataFrame, score: str) -> DataFrame:
    """Adds repo_type, priority, weighted and bucket. An unknown repository counts as monolithic, a null one has priority 1.0."""
    kinds = repositories.select("repo_id", "repo_type")
    out = rows.join(kinds, "repo_id", "left").withColumn("repo_type", F.when(F.col("repo_id").isNotNull(), F.coalesce("repo_type", F.lit("monolithic"))))
    out = out.withColumn("priority", F.when(F.col("repo_id").isNull(), 1.0).otherwise(_lookup(PRIORITY, F.col("repo_type"), 1.0)))
    return out.withColumn("weighted", F.col(score) * F.col("priority")).withColumn("bucket", F.coalesce(_lookup(BUCKET, F.col("repo_type"), None), F.lit("primary_code")))


def cap_buckets(rows: DataFrame, key: str, caps: dict[str, int] | None = None) -> DataFrame:
    """At most so many rows of the secondary buckets, best first (a display rule of the result page)."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weighted"), key))
    most = _lookup(CAPS if caps is None else caps, F.col("bucket"), 2**31 - 1)
    return rows.withColumn("bucket_rank", rank).where(F.col("bucket_rank") <= most)


def group_counts(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Files and chunks per ``key``, keys with neither dropped; null keys form no group."""
    a = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("file_count"))
    b = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("chunk_count"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def context_tokens(chunks: DataFrame, symbols: DataFrame, imports: DataFrame, tokens: Column) -> DataFrame:
    """One row: the context's size, 50 a symbol and 30 an import besides the chunks' tokens."""
    a = chunks.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("t"))
    b = symbols.agg((F.count("*") * SYMBOL_TOKENS).alias("s"))
    c = imports.agg((F.count("*") * IMPORT_TOKENS).alias("i"))
    return a.join(b).join(c).select((F.col("t") + F.col("s") + F.col("i")).alias("total_tokens"))


def token_level(tokens: Column) -> Column:
    return F.when(tokens < 50_000, "small").when(tokens <= 100_000, "medium").otherwise("large")


def search_warnings(files: DataFrame, chunks: DataFrame, tokens: Column, limit: int = 100_000) -> DataFrame:
    """``(ordinal, type, severity)``: size, no files, files without chunks, several workspaces, several services."""
    f = files.agg(F.count("*").alias("files"))
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.countDistinct("workspace_id").alias("ws"), F.countDistinct("service_id").alias("svc"))
    checks = [
        (F.col("tokens") > limit, "context_size", "warning"), (F.col("files") == 0, "no_files", "warning"), ((F.col("files") > 0) & (F.col("chunks") == 0), "no_chunks", "warning"),
        (F.col("ws") > 1, "cross_workspace", "info"), (F.col("svc") > 1, "cross_service", "warning"),
    ]
    rows = F.array(*[F.when(cond, F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("type"), F.lit(s).alias("severity"))) for i, (cond, t, s) in enumerate(checks)])
    return f.join(c).select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("w")).select("w.*")
