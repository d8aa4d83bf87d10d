"""Near-duplicate records: banded MinHash candidates, odd-sketch estimates, exact verification.

Every text becomes the set of its distinct runs of three words. Its MinHash values are used twice: groups of ``rows`` form the
``bands`` keys (texts sharing a key are candidates), and all of them are folded into a 256-bit parity bitmap, the odd
sketch. The XOR population count of two sketches estimates their similarity; a pair is dropped only when that
estimate lies ``margin`` (about five standard errors) below the threshold, or when the parities of the shingles themselves, a second
256-bit bitmap, differ in more bits than two such sets have shingles apart (this bound loses none). Every remaining pair is verified exactly on
the shingle sets.

Texts with the same shingle set form one class (a 64-bit key and the set's size, checked against a second, independent key).
Only class representatives are banded and compared, so a text copied a million times is one row here.

Keys shared by several classes carry size and sketch of each class, and pairs are compared where they meet: the join's condition is the
size bound, the sketch estimate and the parity bound, so what leaves it are likely pairs. Hot keys, those of about ``hot`` classes and more, are known
beforehand from a hashed sample of the classes and never meet in one task. Their classes get other keys in place of them: the rarest
shingles of each set, as many as a pair over the threshold must share one of. So unlike texts that share one boilerplate key
part, and no alike ones do; a class has the same keys however many of its own are hot. What is rare is told by counts on a bounded sample: any order that
all sets follow is right, a better one gives smaller buckets. What is still large after that is cut into blocks, and blocks meet each other.

Recall of the banding for a pair of similarity s is 1-(1-s^rows)^bands: 1-1.4e-6 at 0.7 with 32 bands of 3 rows. ``exact=True``
finds candidates by prefixes instead (the rarest shingles of each set, as many as a pair over the threshold must share
one of) and drops nothing by the sketch: no pair can be lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.wordhash import U64, byte_batches, distinct_per_text, mix, shingles, word_hashes
from sparkloom.operators.components import connected_components
from sparkloom.session import materialise, widen

BANDS, ROWS, SKETCH_BITS = 32, 3, 256
SIGNATURE = "tbl string, id bigint, cls bigint, chk bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, p0 bigint, p1 bigint, p2 bigint, p3 bigint, bands array<bigint>"
SIDE = ["n", "s0", "s1", "s2", "s3", "p0", "p1", "p2", "p3"]


def _constants(samples: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, samples + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    return base | U64(1), mix(base)


def min_hashes(s: np.ndarray, off: np.ndarray, samples: int) -> np.ndarray:
    mult, add = _constants(samples)
    mins = np.empty((len(off) - 1, samples), dtype=U64)
    for k in range(samples):
        mins[:, k] = np.minimum.reduceat(s * mult[k] + add[k], off[:-1])
    return mins


def sketch_sets(s: np.ndarray, off: np.ndarray, salt: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class hashes, check hashes, odd sketches (n x 4 words) and band keys (n x bands) of non-empty shingle sets."""
    n, samples = len(off) - 1, bands * rows
    mins = min_hashes(s, off, samples)
    size = np.diff(off).astype(U64)
    cls = mix(np.add.reduceat(mix(s ^ U64(0x5851F42D4C957F2D)), off[:-1]) ^ salt ^ size)
    chk = mix(np.bitwise_xor.reduceat(mix(s + U64(0x2545F4914F6CDD1D)), off[:-1]) + salt)
    pos = (mix(mins ^ _constants(samples)[0]) % U64(SKETCH_BITS)).astype(np.int64)
    bits = np.zeros((n, SKETCH_BITS), dtype=np.uint8)
    np.add.at(bits, (np.repeat(np.arange(n), samples), pos.ravel()), 1)
    sketch = np.packbits(bits & 1, axis=1, bitorder="little").view(U64)
    keys = np.zeros((n, bands), dtype=U64)
    for r in range(rows):
        keys = mix(keys * U64(0x9FB21C651E98DF25) + mins[:, r::rows] + U64(r))
    return cls, chk, sketch, mix(keys ^ salt[:, None] ^ (np.arange(bands, dtype=U64) << U64(40))[None, :])


def set_parities(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parity bitmaps (n x 4 words) of non-empty shingle sets: two of them differ in no more bits than the sets have shingles that are not shared."""
    pos = mix(s ^ U64(0x8EBC6AF09C88C6E3)) % U64(SKETCH_BITS)
    word, bit = pos >> U64(6), U64(1) << (pos & U64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(word == U64(w), bit, U64(0)), off[:-1]) for w in range(4)], axis=1)


def _sets(texts: list[str | None], shingle: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with at least ``min_words`` words, their distinct shingle hashes and offsets."""
    h, off = word_hashes(texts)
    s, so = distinct_per_text(*shingles(h, off, shingle))
    keep = np.flatnonzero((np.diff(off) >= min_words) & (np.diff(so) > 0))
    counts = np.diff(so)[keep]
    own = np.concatenate([[0], np.cumsum(counts)])
    return keep, s[np.repeat(so[:-1][keep] - own[:-1], counts) + np.arange(own[-1])], own


def signatures(df: DataFrame, shingle: int, min_words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``df(tbl, id, text)`` -> one signature row for each text with at least ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tbl, ids, texts = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for lo, hi in byte_batches(texts):
                keep, s, own = _sets(texts[lo:hi], shingle, min_words)
                if not len(keep):
                    continue
                names = [tbl[lo + i] or "" for i in keep]
                known = {t: xxhash.xxh64_intdigest(t) for t in set(names)}
                salt = mix(np.array([known[t] for t in names], dtype=U64))
                cls, chk, sketch, keys = sketch_sets(s, own, salt, bands, rows)
                parity = set_parities(s, own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names),
                        pa.array(ids[lo:hi][keep].astype(np.int64)),
                        pa.array(cls.view(np.int64)),
                        pa.array(chk.view(np.int64)),
                        pa.array(np.diff(own).astype(np.int32)),
                        *(pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(4)),
                        *(pa.array(np.ascontiguousarray(parity[:, i]).view(np.int64)) for i in range(4)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=[c.split()[0] for c in SIGNATURE.split(", ")],
                )

    return widen(df.where("id is not null and text is not null").select("tbl", "id", "text")).mapInArrow(run, SIGNATURE)


def rarest(s: np.ndarray, off: np.ndarray, known: np.ndarray, times: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the rarest shingles, one of which any set of that similarity has among its own rarest, and their offsets. ``known`` (sorted) have counts, others count as none."""
    n = np.diff(off)
    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
    often = np.where(known[at] == s, times[at], 0) if len(known) else np.zeros(len(s), np.int64)
    order = np.lexsort((s, often, np.repeat(np.arange(len(n)), n)))
    most = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
    first = np.arange(len(s)) - np.repeat(off[:-1], n) < np.repeat(most, n)
    return s[order][first], np.concatenate([[0], np.cumsum(np.minimum(most, n))])


def _rarest_shingles(df: DataFrame, shingle: int, threshold: float, sample_rows: int = 16_384, most: int = 100_000) -> DataFrame:
    """``df(tbl, cls, text)`` -> ``(cls, band)``: keys of the rarest shingles. At most ``most`` counts, of the shingles of about ``sample_rows`` texts, travel with the function."""
    rate = max(1, df.count() // sample_rows)
    few = shingle_sets(df.where(F.pmod(F.xxhash64("cls"), F.lit(rate)) == 0), shingle).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    counts = few.where("n > 1").orderBy(F.desc("n"), "h").limit(most).toArrow()
    known, times = counts.column("h").to_numpy().view(U64), counts.column("n").to_numpy()
    known, times = known[np.argsort(known)], times[np.argsort(known)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tbl, cls, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            for lo, hi in byte_batches(texts):
                keep, s, own = _sets(texts[lo:hi], shingle, 0)
                if not len(keep):
                    continue
                h, off = rarest(s, own, known, times, threshold)
                flat = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo).take(pa.array(keep)) for c in (tbl, cls)), flat], names=["tbl", "cls", "hashes"])

    rare = df.select("tbl", "cls", "text").mapInArrow(run, "tbl string, cls bigint, hashes array<bigint>")
    return rare.select("tbl", "cls", F.explode("hashes").alias("h")).select("cls", F.xxhash64("tbl", "h").alias("band"))


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """``df(cls, text)`` -> ``(cls, hashes array<bigint>)``, distinct per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in byte_batches(texts):
                h, off = word_hashes(texts[lo:hi])
                s, so = distinct_per_text(*shingles(h, off, shingle))
                sets = pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([cls.slice(lo, hi - lo), sets], names=["cls", "hashes"])

    return df.select("cls", "text").mapInArrow(run, "cls bigint, hashes array<bigint>")


def _hot_keys(reps: DataFrame, hot: int) -> DataFrame:
    """``(band)``: keys that about ``hot`` classes or more share, counted on a hashed sample in which such a key is expected 64 times."""
    rate = max(1, hot // 64)
    few = reps.where(F.pmod(F.xxhash64("cls"), F.lit(rate)) == 0).select(F.explode("bands").alias("band"))
    return few.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, hot // rate // 2)).select("band")


def _shared(keys: DataFrame, spread: bool) -> DataFrame:
    """``keys(band, cls)`` -> the rows whose band has several classes, with its ``size``.

    Without hot keys one exchange serves the count and the join. With ``spread`` counts are combined before their shuffle, and the
    join's large side arrives by an exchange of its own, which adaptive execution splits where a key is hot.
    """
    keys = keys if spread else keys.repartition("band")
    return keys.join(keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band")


def _pairs_in_buckets(shared: DataFrame, block: int, alike: Column) -> DataFrame:
    """``shared(band, cls, size, n, s0..s3)`` -> distinct ``(a, b, na, nb)``, a < b, that share a band and are ``alike``; buckets of more than ``block`` are cut into blocks."""
    side = lambda x: [F.col("cls").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in SIDE)]
    small = shared.where(F.col("size") <= block).repartition("band")
    pairs = small.select("band", *side("x")).join(small.select("band", *side("y")), "band").where("x < y").where(alike)
    cut = shared.where(F.col("size") > block).withColumn("parts", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    left = cut.select("band", *side("x"), F.col("part").alias("i"), F.explode(F.expr("sequence(part, parts - 1)")).alias("j"))
    right = cut.select("band", *side("y"), F.explode(F.expr("sequence(0, part)")).alias("i"), F.col("part").alias("j"))
    across = left.join(right, ["band", "i", "j"]).where("(i < j and x <> y) or (i = j and x < y)").where(alike)
    pick = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.expr("if(x < y, x_n, y_n)").alias("na"), F.expr("if(x < y, y_n, x_n)").alias("nb")]
    return pairs.select(*pick).unionByName(across.select(*pick)).distinct()


def _prefix_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """``sets(tbl, cls, n, hashes)`` -> ``(band, cls)``: of each set the rarest shingles, one of which any pair of that similarity must share."""
    each = sets.select("tbl", "cls", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("tbl", "h").agg(F.count("*").alias("often"))
    ranked = each.join(often, ["tbl", "h"]).withColumn("at", F.row_number().over(Window.partitionBy("cls").orderBy("often", "h")))
    return ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select(F.xxhash64("tbl", "h").alias("band"), "cls")


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.7,
    shingle: int = 3,
    min_words: int = 20,
    margin: float = 0.3,
    block: int = 512,
    hot: int = 4096,
    bands: int = BANDS,
    rows: int = ROWS,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Find texts whose shingle sets have a Jaccard similarity of at least ``threshold``.

    ``df`` needs ``tbl`` (texts are compared within one tbl), ``id`` and ``text``; other columns are ignored.
    Returns ``(links, members)``: ``links(tbl, a, b, similarity)`` between different classes, a < b, and
    ``members(tbl, id, cls, rep)`` with one row per eligible row; rows with equal shingle sets share ``cls``, and
    ``rep`` is the smallest id of the class. Null ids and texts, and texts under ``min_words`` words, are never
    members. Repeated rows are members of one class. Empty input gives two empty tables. With ``exact`` no pair is lost by chance,
    at the cost of a shuffle of all shingles.
    """
    df = df.select("tbl", "id", "text")
    sig = materialise(signatures(df, shingle, min_words, bands, rows), "signatures")
    reps = materialise(sig.groupBy("cls").agg(
        F.min("tbl").alias("tbl"), F.min("id").alias("rep"), F.min("n").alias("n"), F.min("chk").alias("lo"), F.max("chk").alias("hi"),
        *(F.min(c).alias(c) for c in SIDE[1:]), F.first("bands").alias("bands"),
    ).withColumn("n", F.expr("if(lo <> hi, raise_error('two shingle sets have one class key'), n)")).drop("lo", "hi"), "classes")
    text_of = lambda wanted: df.join(wanted.select("tbl", "cls", F.col("rep").alias("id")), ["tbl", "id"]).dropDuplicates(["cls"])
    apart = sum((F.expr(f"bit_count(x_p{i} ^ y_p{i})") for i in range(1, 4)), F.expr("bit_count(x_p0 ^ y_p0)"))
    alike: Column = (F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n")) & (apart <= (1 - threshold) / (1 + threshold) * (F.col("x_n") + F.col("y_n")) + 1e-6)
    if exact:
        full = materialise(shingle_sets(text_of(reps), shingle), "all-sets")
        keys = _prefix_keys(full.join(reps.select("tbl", "cls", "n"), "cls"), threshold)
    else:
        odd = sum((F.expr(f"bit_count(x_s{i} ^ y_s{i})") for i in range(1, 4)), F.expr("bit_count(x_s0 ^ y_s0)"))
        alike = alike & (odd <= SKETCH_BITS / 2 * (1 - math.exp(-4 * bands * rows * (1 - max(0.0, threshold - margin)) / SKETCH_BITS)))
        keys = reps.select("cls", F.explode("bands").alias("band"))
    side = reps.select("cls", *SIDE)
    if exact:
        shared = _shared(keys, True)
    else:
        often = materialise(_hot_keys(reps, hot), "hot-keys")
        some = often.count()
        if some:
            often = F.broadcast(often) if some <= 100_000 else often  # the size is known; beyond it the join is shuffled
            mine = reps.join(keys.join(often, "band", "left_semi").select("cls").distinct(), "cls", "left_semi")
            finer = _rarest_shingles(materialise(text_of(mine), "hot-texts"), shingle, threshold)
            shared = _shared(keys.join(often, "band", "left_anti"), False).unionByName(_shared(finer, True))
        else:
            shared = _shared(keys, False)
    shared = materialise(shared.join(side, "cls"), "buckets")
    likely = materialise(_pairs_in_buckets(shared, block, alike), "likely")
    wanted = reps.join(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls")
    sets = materialise(shingle_sets(text_of(wanted), shingle).join(reps.select("cls", "tbl"), "cls"), "sets")
    links = (
        likely.join(sets.select(F.col("cls").alias("a"), "tbl", F.col("hashes").alias("ha")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
        .withColumn("both", F.size(F.array_intersect("ha", "hb")))
        .withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
        .where(F.col("similarity") >= threshold)
        .select("tbl", "a", "b", "similarity")
    )
    members = sig.select("tbl", "id", "cls").join(reps.select("cls", "rep"), "cls").select("tbl", "id", "cls", "rep")
    return links, members


def duplicate_pairs(links: DataFrame, members: DataFrame, block: int = 512) -> DataFrame:
    """Every pair of rows: ``(tbl, id_a, id_b)``, id_a < id_b, links between classes and copies within a class.

    This expands copies into pairs, as a list of all cases must; ``duplicate_groups`` is the form that stays small. A class with many
    rows is cut into blocks of about ``block``, on either side of a link and within itself. Repeated ids count once.
    """
    m = members.select("cls", "tbl", "id").distinct()
    parts = m.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    linked = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    cut = m.join(parts, "cls").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    side = cut.join(linked, "cls", "left_semi")
    grid = links.select("a", "b").join(parts.select(F.col("cls").alias("a"), F.col("parts").alias("pa")), "a").join(parts.select(F.col("cls").alias("b"), F.col("parts").alias("pb")), "b")
    grid = grid.select("a", "b", F.explode(F.expr("sequence(0, pa - 1)")).alias("i"), "pb").select("a", "b", "i", F.explode(F.expr("sequence(0, pb - 1)")).alias("j"))
    across = (
        grid.join(side.select(F.col("cls").alias("a"), F.col("part").alias("i"), "tbl", F.col("id").alias("x")), ["a", "i"])
        .join(side.select(F.col("cls").alias("b"), F.col("part").alias("j"), F.col("id").alias("y")), ["b", "j"])
    )
    copies = cut.join(m.groupBy("cls").agg(F.count("*").alias("size")).where("size > 1").select("cls"), "cls", "left_semi")
    left = copies.select("cls", "tbl", F.col("id").alias("x"), F.col("part").alias("i"), F.explode(F.expr("sequence(part, parts - 1)")).alias("j"))
    right = copies.select("cls", F.col("id").alias("y"), F.explode(F.expr("sequence(0, part)")).alias("i"), F.col("part").alias("j"))
    inside = left.join(right, ["cls", "i", "j"]).where("(i < j and x <> y) or (i = j and x < y)")
    both = across.select("tbl", "x", "y").unionByName(inside.select("tbl", "x", "y")).where("x <> y")
    return both.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per eligible row: ``(tbl, id, class_id, group_id, links)``.

    class_id is the smallest id with the same shingle set, group_id the smallest class_id connected by links, and
    links the number of other classes that the row's class is similar to.
    """
    rep = members.where("id = rep").select("cls", "tbl", "rep").distinct()
    nodes = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = nodes.join(rep.select(F.col("cls").alias("node"), "rep"), "node")
    low = named.groupBy("component").agg(F.min("rep").alias("group_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    groups = named.join(low, "component").select(F.col("node").alias("cls"), "group_id")
    return (
        members.join(groups, "cls", "left").join(degree, "cls", "left")
        .select("tbl", "id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
