"""Evaluation passages in training documents, by suffix arrays over word sequences.

Each task builds suffix arrays of its documents, one per shard of at most ``shard_words`` words, by prefix
doubling on word ranks. Every suffix of every evaluation item is looked up by binary search; a hit shares at least ``min_words``
words, is kept where it cannot be extended to the left, and is extended to the right to its full length.

The evaluation set is hashed by the executors into a table in the shared folder. A task builds a shard's suffix array once and
streams that table past it in blocks of ``block_words`` words: one pass over the documents, no shuffle of them, nothing on the driver
but file names, and memory for one shard and one block whatever the size of either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.wordhash import U64, byte_batches, word_hashes
from sparkloom.session import materialise, widen

MATCH = "doc_id bigint, item_id bigint, matched_words int, doc_word int, item_word int"


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a rank sequence in the order of their first ``depth`` (or more) elements."""
    n, d = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while d < depth:
        key = rank * np.int64(n + 2)
        key[: n - d] += rank[d:] + 1 if d < n else 0
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[1:] = np.cumsum(s[1:] != s[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        d *= 2
    return order


def _bound(words: np.ndarray, sa: np.ndarray, q: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of q the first place in sa whose suffix is not smaller (upper: is larger) in its first words."""
    k = q.shape[1]
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    span = np.arange(k)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        t = words[sa[mid][:, None] + span]
        ne = t != q[live]
        at = ne.argmax(axis=1)
        row = np.arange(len(live))
        less = np.where(ne[row, at], t[row, at] < q[live][row, at], upper)
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]


class Shard:
    """The suffix array over the words of some documents."""

    def __init__(self, h: np.ndarray, off: np.ndarray, min_words: int) -> None:
        self.docs, self.total, self.min_words = len(off) - 1, len(h), min_words
        self.vocabulary, inv = np.unique(h, return_inverse=True)
        words = np.zeros(self.total + self.docs + min_words, dtype=np.int64)  # 0 between documents and behind the last
        words[np.arange(self.total) + np.repeat(np.arange(self.docs), np.diff(off))] = inv + 1
        self.first = off[:-1] + np.arange(self.docs)
        self.words, self.body = words, words[: self.total + self.docs]
        self.sa = suffix_array(self.body.copy(), min_words) if self.total else np.zeros(0, np.int64)

    def matches(self, items: np.ndarray, ioff: np.ndarray) -> np.ndarray:
        """Rows (doc index, item index, length, doc word, item word), the longest match of each pair."""
        none, min_words, body, first = np.zeros((0, 5), np.int64), self.min_words, self.body, self.first
        if not self.total or not len(items):
            return none
        place = np.searchsorted(self.vocabulary, items)
        known = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == items
        q = np.where(known, place + 1, -1)
        bad = np.concatenate([[0], np.cumsum(~known)])
        i0 = np.concatenate([np.arange(a, max(a, b - min_words + 1)) for a, b in zip(ioff[:-1], ioff[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        i0 = i0[bad[i0 + min_words] == bad[i0]]
        if not len(i0):
            return none
        win = q[i0[:, None] + np.arange(min_words)]
        a, b = _bound(self.words, self.sa, win, False), _bound(self.words, self.sa, win, True)
        hit = np.flatnonzero(b > a)
        item_of = np.repeat(np.arange(len(ioff) - 1), np.diff(ioff))
        out = []
        for group in np.array_split(hit, max(1, int((b - a)[hit].sum() // 2_000_000) + 1)):
            n = (b - a)[group]
            if not n.sum():
                continue
            run = np.concatenate([[0], np.cumsum(n)])
            p = self.sa[np.arange(run[-1]) + np.repeat(a[group] - run[:-1], n)]
            i = np.repeat(i0[group], n)
            left = (p > 0) & (i > ioff[item_of[i]])
            left[left] = body[p[left] - 1] == q[i[left] - 1]
            p, i = p[~left], i[~left]
            stop = ioff[item_of[i] + 1]
            length = np.full(len(p), min_words, np.int64)
            live = np.arange(len(p))
            while len(live):
                live = live[i[live] + length[live] < stop[live]]
                live = live[body[np.minimum(p[live] + length[live], len(body) - 1)] == q[i[live] + length[live]]]
                length[live] += 1
            d = np.searchsorted(first, p, side="right") - 1
            out.append(np.stack([d, item_of[i], length, p - first[d], i - ioff[item_of[i]]], axis=1))
        if not out:
            return none
        m = np.concatenate(out)
        m = m[np.lexsort((m[:, 4], m[:, 3], -m[:, 2], m[:, 1], m[:, 0]))]
        keep = np.ones(len(m), bool)
        keep[1:] = (m[1:, :2] != m[:-1, :2]).any(axis=1)
        return m[keep]


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(item_id, words)``: the word hashes of every item with an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in byte_batches(texts):
                h, off = word_hashes(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))], names=["item_id", "words"])

    return items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").mapInArrow(run, "item_id bigint, words array<bigint>")


def read_blocks(files: list[str], block_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item ids, word hashes, offsets) of the items in written files, in blocks of about ``block_words`` words."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    ids, parts, sizes, held = [], [], [], 0
    for f in files:
        system, path = fs.FileSystem.from_uri(f)
        with system.open_input_file(path) as src:
            for b in pq.ParquetFile(src).iter_batches(batch_size=256, columns=["item_id", "words"]):
                words = b.column(1)
                ids.append(b.column(0).to_numpy(zero_copy_only=False))
                parts.append(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                sizes.append(np.diff(np.asarray(words.offsets)))
                held += len(parts[-1])
                if held >= block_words:
                    yield np.concatenate(ids), np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                    ids, parts, sizes, held = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    shard_words: int = 2_000_000,
    block_words: int = 1_000_000,
) -> DataFrame:
    """``(doc_id, item_id, matched_words, doc_word, item_word)`` for each document sharing ``min_words`` consecutive words with an item.

    Words are maximal runs of ``[a-z0-9_]`` in the lower-cased text; the match given is the pair's longest, by word
    positions from 0. Rows without id or text take no part; items shorter than ``min_words`` words match nothing; a
    repeated document id or item id counts once with its longest match.
    """
    files = sorted(materialise(item_words(items, item_id, item_text), "items").inputFiles())
    src = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")

    def emit(doc_ids: list[np.ndarray], hs: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard, ids = Shard(np.concatenate(hs), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), min_words), np.concatenate(doc_ids)
        for item_ids, words, ioff in read_blocks(files, block_words):
            m = shard.matches(words, ioff)
            cols = [ids[m[:, 0]], item_ids[m[:, 1]], *(m[:, c].astype(np.int32) for c in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in MATCH.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, hs, sizes, held = [], [], [], 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in byte_batches(texts):
                h, off = word_hashes(texts[lo:hi])
                doc_ids.append(ids[lo:hi].astype(np.int64))
                hs.append(h.astype(U64))
                sizes.append(np.diff(off))
                held += len(h)
                if held >= shard_words:
                    yield from emit(doc_ids, hs, sizes)
                    doc_ids, hs, sizes, held = [], [], [], 0
        if doc_ids:
            yield from emit(doc_ids, hs, sizes)

    return widen(src).mapInArrow(run, MATCH).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    ).select("doc_id", "item_id", "m.matched_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which nothing was found; rows without an id stay."""
    return docs.join(leaks.select(F.col("doc_id").alias("__leaked")).distinct(), F.col(doc_id) == F.col("__leaked"), "left_anti")
