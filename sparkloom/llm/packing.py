"""Filling fixed-capacity containers by sum-of-squares packing.

Texts are sized in tokens of a public tokenizer. A text larger than a container gives full pieces and a rest. Items
are dealt to groups of about ``group_items`` by a hash; each group packs its items one by one: an item goes where
the sum, over all residual gaps, of the squared number of open bins with that gap becomes smallest (a new bin or an
existing one). Containers still emptier than ``tolerance`` are opened again and their items dealt anew to fewer groups,
round by round, until one group holds all that is left or a round needs as many containers as it opened: then no
dealing brings the rest into fewer containers. So the loss does not grow with the number of groups.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise, widen

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """``(doc_id, tokens)``; a null text has no tokens. The vocabulary file is read by the driver's machine and sent along."""
    docs.sparkSession.sparkContext.addFile(path)
    base = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = encoding(SparkFiles.get(base))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return widen(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))).mapInArrow(run, "doc_id bigint, tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each item (sizes 0..capacity), and the space used in each bin."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by gap; full bins are not counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), dtype=np.int64)
    used: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        if s == 0 and used:
            where[i] = 0  # nothing to place: it may join any bin
            continue
        best, gap = (2 * int(open_bins[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            cost = 2 * open_bins[: capacity - s] - 2 * open_bins[s:capacity] + 2  # gap g = s + index -> index
            cost[0] = 1 - 2 * open_bins[s]
            cost[open_bins[s:capacity] == 0] = 1 << 60
            at = int(cost.argmin())
            if cost[at] <= best:
                gap = s + at
        if gap == capacity:
            b = len(used)
            used.append(0)
        else:
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        where[i] = b
        used[b] += s
        if gap > s:
            open_bins[gap - s] += 1
            stacks[gap - s].append(b)
    return where, np.array(used, dtype=np.int64)


PLACED = "container_id string, doc_id bigint, piece_no int, token_start bigint, n_tokens int, copy bigint, used int"


def _pack_round(items: DataFrame, groups: int, capacity: int, rnd: int) -> DataFrame:
    tag = f"r{rnd}"

    def pack(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        order = np.lexsort((t.column("n_tokens").to_numpy(), t.column("piece_no").to_numpy(), t.column("doc_id").to_numpy(zero_copy_only=False)))
        order = order[np.argsort(_scatter(t.column("doc_id").to_numpy(zero_copy_only=False)[order]), kind="stable")]
        t = t.take(pa.array(order))
        where, used = sum_of_squares(t.column("n_tokens").to_numpy(), capacity)
        return pa.table(
            {
                "container_id": pa.array([f"{tag}-{g}-{b}" for b in where.tolist()], pa.string()),
                **{c: t.column(c) for c in ("doc_id", "piece_no", "token_start", "n_tokens", "copy")},
                "used": pa.array(used[where].astype(np.int32)),
            }
        )

    return items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no", "n_tokens", F.lit(rnd)) + F.col("copy"), F.lit(groups)).cast("int")).groupBy("g").applyInArrow(pack, PLACED)


def _scatter(ids: np.ndarray) -> np.ndarray:
    """A fixed order without relation to the ids, so that runs of alike documents do not stay together."""
    x = np.nan_to_num(ids.astype(np.float64), nan=-1).astype(np.int64).astype(np.uint64)
    return (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(7))


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    tokenizer: str = TOKENIZER,
    group_items: int = 50_000,
    tolerance: float = 0.005,
) -> DataFrame:
    """``(container_id, doc_id, piece_no, token_start, n_tokens, used)``: every row of ``docs`` in containers of ``capacity`` tokens.

    A document is divided only if it has more than ``capacity`` tokens: pieces 0, 1, ... cover its tokens without gap or
    overlap. Null and empty texts have size 0 and share the group's first container. Rows are placed one by one, repeated
    ids included. ``used`` is the container's total. Container names are the same in every run. Empty input gives an empty table.
    """
    sized = materialise(token_counts(docs, doc_id, text, tokenizer), "tokens")
    pieces = sized.select(
        "doc_id", F.posexplode(F.expr(f"transform(sequence(0, greatest(0, cast((tokens - 1) div {capacity} as int))), p -> named_struct('s', p * {capacity}L, 'n', cast(least({capacity}L, tokens - p * {capacity}L) as int)))")).alias("piece_no", "p")
    ).select("doc_id", "piece_no", F.col("p.s").alias("token_start"), F.col("p.n").alias("n_tokens"))
    # rows alike in id and size are told apart by a running number: they get the same containers in every run, and are dealt to all groups
    kinds = ["doc_id", "piece_no", "token_start", "n_tokens"]
    pieces = pieces.groupBy(*kinds).agg(F.count("*").alias("n")).select(*kinds, F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    done = pieces.where(F.col("n_tokens") == capacity).select(
        F.concat_ws("-", F.lit("full"), "doc_id", "piece_no", "copy").alias("container_id"), "doc_id", "piece_no", "token_start", "n_tokens", F.lit(capacity).alias("used")
    )
    left = materialise(pieces.where(F.col("n_tokens") < capacity), "loose")
    n, opened, rnd = left.count(), None, 0
    while n:
        groups = max(1, -(-n // group_items))
        placed = materialise(_pack_round(left, groups, capacity, rnd), "packed")
        out = placed.select("container_id", *kinds, "used")
        tight = F.col("used") >= int(capacity * (1 - tolerance))
        loose = placed.where(~tight)
        n, bins = loose.agg(F.count("*"), F.count_distinct("container_id")).first()
        if groups == 1 or (opened is not None and bins >= opened):
            return done.unionByName(out)
        done, opened, rnd = done.unionByName(out.where(tight)), bins, rnd + 1
        left = loose.select(*kinds, "copy")
    return done
