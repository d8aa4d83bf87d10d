"""Splitting oversized items at natural boundaries, with a stated overlap between consecutive pieces.

Per item, the character offsets of line starts are prefix sums of line lengths. The sorted boundary array holds
line ends; a second one holds strong boundaries (before a line that follows a blank line or returns to
the outermost indentation). A piece ends at the last strong boundary under the limit when that keeps at least half
the limit, else at the last line end under it (binary search), else the line itself is cut hard. The next piece
starts ``overlap`` lines before the cut where that still makes progress and the lines fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
PIECE = (
    "item_id bigint, piece_no int, char_start int, char_end int, first_line int, last_line int, start_line int, "
    "end_line int, line_range_ok boolean, tokens int, overlap_lines int, cut string, piece string"
)


def cut_item(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, bool]]:
    """Pieces of ``text`` of at most ``limit`` characters: (char start, char end, first line, last line, overlap lines, hard).

    Lines count from 1 and end at ``\\n``. ``hard`` says the piece ends inside a line. A piece leaves its last
    ``\\n`` out only when it would not fit.
    """
    lines = text.split("\n")
    n = len(lines)
    lens = np.fromiter((len(x) for x in lines), dtype=np.int64, count=n)
    start = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=start[1:])
    end = start[:-1] + lens  # without the line break
    size = len(text)
    blank = np.fromiter((not x.strip() for x in lines), dtype=bool, count=n)
    outer = np.fromiter((bool(x.strip()) and x[0] not in " \t})]" for x in lines), dtype=bool, count=n)
    strong = np.flatnonzero((blank[:-1] & ~blank[1:]) | (outer[1:] & ~outer[:-1])) if n > 1 else np.zeros(0, np.int64)
    out, at, again = [], 0, 0
    while at < size:
        first = int(np.searchsorted(start, at, side="right")) - 1
        room = at + limit
        if room >= size:
            out.append((at, size, first + 1, n if lens[-1] or n == 1 else n - 1, again, False))
            break
        last = int(np.searchsorted(end, room, side="right")) - 1  # last line that fits whole
        if last < first or end[last] < at or start[last + 1] <= at:
            stop = room
            out.append((at, stop, first + 1, first + 1, again, True))
            at, again = stop, 0
            continue
        k = int(np.searchsorted(strong, last, side="right")) - 1
        if k >= 0 and strong[k] >= first and end[strong[k]] - at >= limit // 2:
            last = int(strong[k])
        stop = int(min(start[last + 1], room))
        out.append((at, stop, first + 1, last + 1, again, False))
        back, again = last + 1, 0
        # the lines taken again must not be the whole piece, and the first new line must still fit behind them
        while again < overlap and back - 1 > first and back < n and (end[back] - start[back - 1] <= limit or lens[back] > limit):
            back, again = back - 1, again + 1
        at = int(start[back]) if again else max(stop, int(start[last + 1]))
    return out


def split_oversized(
    df: DataFrame,
    item_id: str = "id",
    text: str = "chunk_content",
    start_line: str = "start_line",
    end_line: str = "end_line",
    max_tokens: int = 800,
    overlap: int = 2,
) -> DataFrame:
    """Cut each text of more than ``max_tokens`` tokens (four code points each, rounded up) into pieces under the limit.

    Sizes are taken from the text; stored counts are not read. ``first_line``/``last_line`` count within the text;
    ``start_line``/``end_line`` are file lines: the stored start plus the offset. A reversed stored range is turned
    round; ``line_range_ok`` says whether the stored range has as many lines as the text; without a stored start
    the file lines are null. ``cut`` is ``inside_line`` for a piece that ends inside a line, else ``line_ends``.
    Null and empty texts and texts within the limit give no rows; repeated ids are cut each for itself.
    """
    limit = max_tokens * CHARS_PER_TOKEN
    big = df.select(
        F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"),
        F.col(start_line).cast("int").alias("lo"), F.col(end_line).cast("int").alias("hi"),
    ).where(F.ceil(F.char_length("text") / CHARS_PER_TOKEN) > max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECE.split(", ")]
        schema = pa.schema(list(zip(names, (pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)))
        for b in batches:
            rows: list[tuple] = []
            for i, t, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base = min(x for x in (lo, hi) if x is not None) if lo is not None else None
                count = t.count("\n") + (not t.endswith("\n"))
                ok = lo is not None and hi is not None and abs(hi - lo) + 1 in (count, t.count("\n") + 1)
                for k, (s, e, f, l, again, hard) in enumerate(cut_item(t, limit, overlap)):
                    rows.append((i, k, s, e, f, l, None if base is None else base + f - 1, None if base is None else base + l - 1, ok, -(-(e - s) // CHARS_PER_TOKEN), again, "inside_line" if hard else "line_ends", t[s:e]))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return big.mapInArrow(run, PIECE)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """``(chunk_id, cut)`` per split item: inside_line if any of its pieces ends inside a line."""
    return pieces.groupBy("item_id").agg(F.min("cut").alias("cut")).select(F.col("item_id").alias("chunk_id"), "cut")
