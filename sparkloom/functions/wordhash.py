"""Vectorised word hashing for word-sequence operators.

A word is a maximal run of ``[a-z0-9_]`` in the lower-cased text. All words of a batch of texts are found and
hashed with array operations on the UTF-8 bytes: prefix sums of a polynomial modulo 2^64 give the hash of
any byte range without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD[_c] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        arr = np.full(max(n, 1 << 16), base, dtype=U64)
        arr[0] = 1
        have = _powers[key] = np.cumprod(arr, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_batches(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near ``limit`` characters (one text may exceed it alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.zeros(len(buf) + 2, dtype=np.int8)
    w[1:-1] = is_word[buf]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buf)
    pre = np.zeros(n + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * _power(n, _P, "p"), dtype=U64, out=pre[1:])
    return mix((pre[ends] - pre[starts]) * _power(n + 1, _P_INV, "i")[starts] + (ends - starts).astype(U64))


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and offsets so that text i owns ``h[off[i]:off[i+1]]``."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    cuts = np.concatenate([[0], np.cumsum(lens)])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8) if parts else np.zeros(0, np.uint8)
    s, e = spans(buf, _WORD)
    return range_hashes(buf, s, e), np.searchsorted(s, cuts)


def shingles(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` consecutive words within each text, with offsets per text."""
    total = len(h) - n + 1
    counts = np.maximum(np.diff(off) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if total <= 0 or out[-1] == 0:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    acc = np.zeros(total, dtype=U64)
    for i in range(n):
        acc = acc * U64(0xD6E8FEB86659FD93) + h[i : i + total]
    first = np.repeat(off[:-1] - out[:-1], counts)
    return mix(acc)[np.arange(out[-1]) + first], out


def distinct_per_text(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text's slice, with new offsets."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    return s, np.searchsorted(owner, np.arange(len(off)))
