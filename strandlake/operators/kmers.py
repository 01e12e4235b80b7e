"""Words of reads: packed in Arrow batches, sampled, counted, and their spectrum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
#: Windows that are packed at once.
PIECE = 1 << 18


def base_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings end to end, and where each string begins (and the last one ends); null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def roll(codes: np.ndarray, k: int) -> np.ndarray:
    """Two-bit packed words of ``k`` codes from each place on, by doubling."""
    out, have, size, block = None, 0, 1, codes
    while size <= k:
        if k & size:
            out = block if out is None else (out[: len(block) - have] << 2 * size) | block[have:]
            have += size
        if 2 * size <= k:
            block = (block[:-size] << 2 * size) | block[size:]
        size *= 2
    return out


def roll_back(codes: np.ndarray, k: int) -> np.ndarray:
    """The same words' reverse complements."""
    out, have, size, block = None, 0, 1, 3 - codes
    while size <= k:
        if k & size:
            out = block if out is None else out[: len(block) - have] | (block[have:] << 2 * have)
            have += size
        if 2 * size <= k:
            block = block[:-size] | (block[size:] << 2 * size)
        size *= 2
    return out


class Piece:
    """Windows of ``k`` bases of a stretch of reads: the read (row of the batch) and place (from 1) of each, its words, and whether it is one."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, low: int, high: int, k: int) -> None:
        code = _CODE[raw[low:high]]
        n = len(code) - k + 1
        a, b = np.searchsorted(starts, low, side="right") - 1, np.searchsorted(starts, high, side="left")
        lengths = np.diff(np.clip(starts[a : b + 1], low, high))
        read = np.repeat(np.arange(a, b), lengths)
        bad = np.concatenate([[0], np.cumsum(code == 4, dtype=np.int32)])
        self.ok = (bad[k:] == bad[:-k]) & (read[k - 1 :] == read[:n])
        self.k, self.read, self.codes = k, read[:n], (code & 3).astype(np.int64)
        self.pos = np.arange(low + 1, low + 1 + n) - starts[self.read]
        self.word = roll(self.codes, k)

    def canonical(self) -> np.ndarray:
        return np.minimum(self.word, roll_back(self.codes, self.k))


def pieces(column: pa.Array, k: int) -> Iterator[Piece]:
    """All windows of a column of reads, about ``PIECE`` at once, in order; a read may go on in the next piece."""
    raw, starts = base_codes(column)
    for low in range(0, len(raw) - k + 1, PIECE):
        yield Piece(raw, starts, low, min(low + PIECE + k - 1, len(raw)), k)


def check_k(k: int) -> None:
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")


def pack_words(seq: bytes, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (from 1), packed words, and whether the word as read was kept, of windows that hold bases only."""
    if len(seq) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    raw = np.frombuffer(seq, np.uint8)
    p = Piece(raw, np.array([0, len(raw)]), 0, len(raw), k)
    word = p.canonical() if canonical else p.word
    return p.pos[p.ok], word[p.ok], word[p.ok] == p.word[p.ok]


def kmers(reads: DataFrame, k: int, canonical: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, pos, kmer, fwd): every word of k <= 31 bases of reads (key, seq); windows with another letter are skipped."""
    check_k(k)
    kind = reads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for p in pieces(batch.column(1), k):
                word = p.canonical()[p.ok] if canonical else p.word[p.ok]
                yield pa.record_batch([keys.take(pa.array(p.read[p.ok])), pa.array(p.pos[p.ok]), pa.array(word), pa.array(word == p.word[p.ok])], [key, "pos", "kmer", "fwd"])

    return reads.select(key, "seq").mapInArrow(run, f"{key} {kind}, pos long, kmer long, fwd boolean")


def sorted_words(read: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Reads and words by read, then word."""
    if 2 * k + int(read.max(initial=0)).bit_length() <= 63:
        both = np.sort((read << 2 * k) | word)
        return both >> 2 * k, both & ((1 << 2 * k) - 1)
    order = np.lexsort((word, read))
    return read[order], word[order]


def per_read(reads: DataFrame, k: int, summary: Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]], schema: str, key: str = "doc_id", keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, schema): ``summary(read, word, n)`` of each batch of reads (key, seq), from the canonical words of its ``n`` reads, sorted by read and word.

    Each row is a read; nothing is shuffled.  ``keep`` may pick words before they are sorted.
    """
    check_k(k)
    kind = reads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches):
            read, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for p in pieces(part.column(1), k):
                w, r = p.canonical()[p.ok], p.read[p.ok]
                if keep is not None:
                    picked = keep(w)
                    w, r = w[picked], r[picked]
                read.append(r)
                word.append(w)
            r, w = sorted_words(np.concatenate(read), np.concatenate(word), k)
            out = summary(r, w, len(part))
            yield pa.record_batch([part.column(0), *map(pa.array, out.values())], [key, *out])

    return reads.select(key, "seq").mapInArrow(run, f"{key} {kind}, {schema}")


def tallies(read: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and different words, of each of ``n`` reads, from words sorted by read and word."""
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (read[1:] != read[:-1])
    return np.bincount(read, minlength=n), np.bincount(read[new], minlength=n)


def bounded(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cuts batches (key, seq) where their reads come to about ``limit`` bases; a longer read is a batch of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = done = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(sizes[to - 1])


def sliding_minimum(rows: DataFrame, value: str, width: int, key: str = "doc_id") -> DataFrame:
    """Adds ``low`` (minimum over ``width`` rows from this one on, by pos) and ``last`` (the last of them); null where any is missing."""
    w = Window.partitionBy(key).orderBy("pos")
    ahead = w.rowsBetween(0, width - 1)
    full = F.count(value).over(ahead) == width
    return rows.select("*", F.when(full, F.min(value).over(ahead)).alias("low"), F.when(full, F.lead(value, width - 1).over(w)).alias("last"))


def solid_threshold(spectrum: DataFrame, min_count: int, fraction: float, top: int = 4097) -> DataFrame:
    """One row: valley, peak and threshold of a spectrum (n, kmers) of reads per word, clipped at ``top``.

    The valley is the first count from 3 that is no higher than the one before and lower than the next (3 if none); the peak is
    the last highest from there on.  The histogram has at most ``top`` rows.
    """
    hist = spectrum.groupBy(F.least("n", F.lit(top)).alias("c")).agg(F.sum("kmers").alias("n"))
    every = spectrum.sparkSession.range(1, top + 1).withColumnRenamed("id", "c").join(F.broadcast(hist), "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("c")
    shape = every.select("c", "n", F.lag("n").over(w).alias("p"), F.lead("n").over(w).alias("x"))
    valley = shape.where("c between 3 and 4096 and n <= p and n < x").agg(F.coalesce(F.min("c"), F.lit(3)).alias("valley"))
    peak = every.crossJoin(F.broadcast(valley)).where("c >= valley").groupBy("valley").agg(F.max_by("c", F.struct("n", "c")).alias("peak"))
    return peak.withColumn("threshold", F.greatest(F.lit(min_count).cast("long"), F.floor(F.col("peak") * F.lit(fraction))))


def blocks(hits: DataFrame, k: int, gap: int, keys: list[str]) -> DataFrame:
    """(keys, hits, cover, longest): hit positions joined into blocks where a gap of at most ``gap`` bases lies between."""
    w = Window.partitionBy(*keys).orderBy("pos")
    # all words are of one length, so the running end is the last hit's
    marked = hits.withColumn("new", F.when(F.col("pos") > F.lag("pos").over(w) + (k + gap), 1).otherwise(0))
    numbered = marked.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy(*keys, "block").agg(F.count("*").alias("n"), (F.max("pos") + k - F.min("pos")).alias("len"))
    return each.groupBy(*keys).agg(F.sum("n").alias("hits"), F.sum("len").alias("cover"), F.max("len").alias("longest"))


