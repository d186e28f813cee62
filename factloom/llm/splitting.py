"""Problem 7: oversized texts cut into pieces under a limit, at natural boundaries, with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import spread

PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD = 5, 4, 3, 2, 1
TILE = 1 << 16


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..n: end of paragraph, sentence, line, clause, word, or none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    space = np.isin(c, [9, 10, 11, 12, 13, 32, 0xA0, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000])
    line = c == 10
    # the last character before the run of spaces that ends at each position, and the line feeds in that run
    at = np.where(~space, np.arange(n), -1)
    last = np.maximum.accumulate(at) if n else at
    feeds = np.cumsum(line)
    in_run = feeds - np.where(last >= 0, feeds[last], 0)
    before = np.where(last >= 0, c[last], 0)
    closing = np.isin(before, [ord(x) for x in "\"')]}”’»"])
    inner = np.where(closing & (last > 0), c[np.maximum(last - 1, 0)], before)
    ends = np.isin(inner, [ord(x) for x in ".!?…。！？"])
    clause = np.isin(before, [ord(x) for x in ",;:—–"])
    s = np.zeros(n + 1, np.int8)
    cut = space & np.append(~space[1:], True)  # before the first character after a run of spaces
    s[1:] = np.select([~cut, in_run >= 2, ends, in_run == 1, clause], [0, PARAGRAPH, SENTENCE, LINE, CLAUSE], WORD)
    return s


class RangeMax:
    """Sparse table over boundary strengths: the strongest position of a range in constant time, ties to the right.

    Levels go up to the longest range asked for; the table is built tile by tile, so memory doesn't grow with the text.
    """

    def __init__(self, s: np.ndarray, longest: int):
        self.s, self.longest, self.begin, self.levels = s.astype(np.int64), max(1, longest), 0, None

    def _build(self, begin: int) -> None:
        self.begin = begin
        part = self.s[begin : begin + TILE + 2 * self.longest]
        level = part * (1 << 32) + np.arange(begin, begin + len(part))
        self.levels = [level]
        width = 1
        while 2 * width <= self.longest and 2 * width <= len(part):
            level = np.maximum(level[: len(level) - width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, low: int, high: int) -> int:
        """Strongest, rightmost position in low..high (both included)."""
        if self.levels is None or low < self.begin or high >= self.begin + len(self.levels[0]):
            self._build(low)
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low - self.begin], level[high - (1 << k) + 1 - self.begin]) & 0xFFFFFFFF)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most `limit` code points that cover the text; each starts `overlap` before the last end."""
    n, limit = len(text), max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n)]
    table, out, start = RangeMax(strengths(text), limit), [], 0
    least = max(overlap + 1, limit // 2)  # pieces are at least half full, so their number is bounded
    while n - start > limit:
        end = table.best(start + least, start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def split(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """(*keys, piece_no, start_pos, end_pos, piece_text, n_pieces) of every text; limit and overlap are columns.

    A text within its limit is one piece. Empty text: one empty piece. Null text, limit or overlap: no row. Cuts
    count code points and fall after the spaces that follow a boundary; the strongest boundary in the second half of
    the window wins, ties to the right; with no boundary the piece is full. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, begin, end, piece, count = [], [], [], [], [], []
            for k, (t, most, over) in enumerate(zip(*[batch.column(len(keys) + i).to_pylist() for i in range(3)])):
                found = cuts(t, most, over)
                for i, (a, b) in enumerate(found):
                    at.append(k), no.append(i), begin.append(a), end.append(b), piece.append(t[a:b]), count.append(len(found))
            own = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(keys))]
            rest = [pa.array(x, pa.int32()) for x in (no, begin, end)] + [pa.array(piece, pa.string()), pa.array(count, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *rest], [*[f"k{i}" for i in range(len(keys))], "piece_no", "start_pos", "end_pos", "piece_text", "n_pieces"])

    narrow = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(text).alias("t"), F.col(limit).cast("int").alias("m"), F.col(overlap).cast("int").alias("o")).dropna(subset=["t", "m", "o"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keys)])
    out = spread(narrow, "k0").mapInArrow(run, f"{kinds}, piece_no int, start_pos int, end_pos int, piece_text string, n_pieces int")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


def pages(raw_documents: DataFrame, limits: DataFrame) -> DataFrame:
    """A row per page of `raw_documents` with the limit of its file's standard: DEFAULT if the standard is null.

    A standard without a row in `limits` takes DEFAULT, too. Files without pages (null or empty) have no row.
    """
    own = limits.select(F.col("standard").alias("limit_of"), "max_chars", "overlap_chars")
    default = own.filter("limit_of = 'DEFAULT'").first()  # a small fixed table
    d_max, d_over = (default.max_chars, default.overlap_chars) if default else (None, None)
    page = raw_documents.select("raw_id", "standard", F.explode("pages").alias("p")).select("raw_id", "standard", F.col("p.page").alias("page_no"), F.col("p.text").alias("text"))
    page = page.join(own, F.col("standard") == F.col("limit_of"), "left")
    return page.select("raw_id", "page_no", "text", F.coalesce("max_chars", F.lit(d_max).cast("int")).alias("max_chars"), F.coalesce("overlap_chars", F.lit(d_over).cast("int")).alias("overlap_chars"))
