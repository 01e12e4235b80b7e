"""Removal of repeated passages by a blockwise suffix sort over a cover sample.

A suffix matters here by its first LENGTH bytes, its window.  Sorting all of a corpus' suffixes at once would move many times the
corpus, so suffixes are dealt into buckets and one bucket is sorted at a time.

The cover sample: of the starts of K-byte strings within a window, the one with the least hash is the window's anchor.  As
this depends on the window's bytes alone, two equal windows have equal anchors at the same place: what a difference cover
gives with residues, a fixed share of all positions, this gives with about 1 in 70.  A bucket is the set of suffixes whose windows
have the same anchor string.  Suffixes that follow each other and share an anchor are a run; equal runs are one class, so that
copies, however many, are sorted once.

Buckets with a single run hold nothing repeated, and those whose runs are all equal need no sorting.  In every other bucket, the
texts of its classes are laid out with their anchors one under the other; blocks at every 32 bytes from the anchor get ranks
(of 32 bytes, and by doubling of 64 and 128), and suffixes are sorted by these precomputed ranks, by which long ties cost no more
than short ones; the few bytes before the first and after the last block settle the rest exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, free_name, materialize, slices

LENGTH = 200
K = 64  # bytes of an anchor
W = LENGTH - K + 1  # anchors that a window chooses from
PIECE = 1 << 20  # window starts handled at once, of one document
BLOCK = 32
_COLUMN = 160  # of the anchor in a bucket's layout
_STRIDE = 384
#: Classes of a bucket that are laid out at once, about.
ROWS = 4096
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _constants() -> tuple[np.ndarray, list[np.uint64]]:
    rng = np.random.default_rng(20)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(256), list(draw(8))


_BYTE, _STEP = _constants()


def runs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts in ``data``, which holds texts with windows from ``first`` to ``last`` (inclusive).

    Gives the number of the text, the first start, the number of starts, the anchor's distance from the first start,
    the anchor's hash and the run's.
    """
    n = len(data)
    h = _BYTE[data]
    kept = {}
    for i, size in enumerate((1, 2, 4, 8, 16, 32, 64)):  # hashes of 2, 4, ... 128 bytes
        h = _mix(h[: len(h) - size] * _STEP[i] + h[size:])
        if size * 2 in (8, K, 128):
            kept[size * 2] = h
    m = n - LENGTH + 1
    whole = _mix(_mix(kept[128][:m] * _STEP[0] + kept[64][128 : 128 + m]) * _STEP[1] + kept[8][192 : 192 + m])
    at = np.arange(len(kept[K]), dtype=np.uint64)
    low = (kept[K] & np.uint64(0xFFFFFFFFFF000000)) | (at & np.uint64(0xFFFFFF))
    for size in (1, 2, 4, 8, 16, 32, 64):
        low = np.minimum(low[: len(low) - size], low[size:])
    low = np.minimum(low[:m], low[W - 128 : W - 128 + m])  # the least of W, with its place in the low bits
    spans = last - first + 1
    text = np.repeat(np.arange(len(first)), spans)
    start = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(first, spans)
    anchor = (low[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(start)])
    s1, a = start[begin], anchor[begin]
    ahead = a - s1
    run = _mix(_mix(whole[s1] * _STEP[2] + whole[s1 + count - 1]) * _STEP[3] + (count * 1000 + ahead).astype(np.uint64))
    return text[begin], s1, count, ahead, kept[K][a], run


def anchors(docs: DataFrame) -> DataFrame:
    """The runs of every document (key, text): key, anchor, run, start, count, ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=PIECE):
            keys = batch.column(0).to_numpy()
            raw = [t.encode() for t in texts]
            parts = [(i, at) for i, b in enumerate(raw) for at in range(0, len(b) - LENGTH + 1, PIECE)]
            group: list[tuple[int, int]] = []
            size = 0
            for p in [*parts, None]:
                if p is None or size > PIECE:
                    if group:
                        yield from emit(keys, raw, group)
                    group, size = [], 0
                if p is not None:
                    group.append(p)
                    size += min(PIECE + LENGTH - 1, len(raw[p[0]]) - p[1])

    def emit(keys: np.ndarray, raw: list[bytes], group: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        cut = [raw[i][at : at + PIECE + LENGTH - 1] for i, at in group]
        sizes = np.array([len(c) for c in cut])
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(cut), np.uint8)
        text, s1, count, ahead, anchor, run = runs(data, begin, begin + sizes - LENGTH)
        doc = np.array([i for i, _ in group])[text]
        start = s1 - begin[text] + np.array([at for _, at in group])[text]
        cols = [keys[doc], anchor.view(np.int64), run.view(np.int64), start, count.astype(np.int32), ahead.astype(np.int32)]
        yield pa.record_batch([pa.array(c) for c in cols], ["key", "anchor", "run", "start", "count", "ahead"])

    return docs.select("key", "text").mapInArrow(run, "key long, anchor long, run long, start long, count int, ahead int")


def _rank(rows: np.ndarray) -> np.ndarray:
    """Ranks of rows (a matrix of integers or bytes) in sorted order; equal rows have equal ranks."""
    rows = np.ascontiguousarray(rows)
    return np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)[1]


def sort_buckets(bucket: np.ndarray, ahead: np.ndarray, count: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which suffixes of which row have a window that another row of the same bucket has too: rows x offsets before the anchor."""
    n = len(texts)
    layout = np.zeros((n, _STRIDE), np.uint8)
    for i, (t, a) in enumerate(zip(texts, ahead.tolist(), strict=True)):
        layout[i, _COLUMN - a : _COLUMN - a + len(t)] = np.frombuffer(t, np.uint8)
    blocks = _STRIDE // BLOCK
    r32 = _rank(layout.reshape(n * blocks, BLOCK).view(np.uint64)).reshape(n, blocks)
    pair = lambda r, step: _rank(np.stack([r[:, :-step].ravel(), r[:, step:].ravel()], 1)).reshape(n, -1)
    r64 = pair(r32, 1)
    r128 = pair(r64, 2)
    out = np.zeros((n, W), bool)
    for offset in range(W):
        rows = np.flatnonzero((offset <= ahead) & (offset > ahead - count))
        if len(rows) < 2:
            continue
        start, head = _COLUMN - offset, offset % BLOCK
        at = (start + head) // BLOCK
        full = (LENGTH - head) // BLOCK
        ranks = [bucket[rows], r128[rows, at], *(r32[rows, at + 4 + j] for j in range(full - 4))]
        # suffixes that differ in a rank are apart; the rest is settled by the bytes outside of the blocks
        key = ranks[0].astype(np.uint64)
        for r in ranks[1:]:
            key = _mix(key * _STEP[4] + r.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        tied = order[np.r_[same, False] | np.r_[False, same]]
        if not len(tied):
            continue
        r = rows[tied]
        edge = np.zeros((len(r), 2 * BLOCK), np.uint8)
        edge[:, :head] = layout[r, start : start + head]
        tail = start + head + full * BLOCK
        edge[:, BLOCK : BLOCK + start + LENGTH - tail] = layout[r, tail : start + LENGTH]
        exact = np.concatenate([np.stack([x[tied].astype(np.int64) for x in ranks], 1).view(np.uint8), edge], 1)
        group = _rank(exact.view(np.uint64))
        out[r, offset] = np.bincount(group)[group] > 1
    return out


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: bucket, run, ahead, count, bytes.  Gives the repeated suffixes of each row, as ranges from its first."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        bucket, run = rows["anchor"].to_numpy(), rows["run"].to_numpy()
        ahead, count = rows["ahead"].to_numpy().astype(np.int64), rows["count"].to_numpy().astype(np.int64)
        found = sort_buckets(bucket, ahead, count, rows["bytes"].to_pylist())
        anchors_, runs_, lows, highs = [], [], [], []
        for i in np.flatnonzero(found.any(1)).tolist():
            # suffix j of the run stands ahead - j before the anchor
            x = np.r_[False, found[i, ahead[i] - np.arange(count[i])], False].astype(np.int8)
            lows.append(np.flatnonzero(np.diff(x) == 1))
            highs.append(np.flatnonzero(np.diff(x) == -1))
            anchors_.append(bucket[i])
            runs_.append(run[i])
        ranges = [[{"low": int(a), "high": int(b)} for a, b in zip(lo, hi, strict=True)] for lo, hi in zip(lows, highs, strict=True)]
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        return pa.record_batch([pa.array(anchors_, pa.int64()), pa.array(runs_, pa.int64()), pa.array(ranges, kind)], ["anchor", "run", "ranges"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        rows = pa.Table.from_batches(held)
        a = rows["anchor"].to_numpy()
        new = np.flatnonzero(a[1:] != a[:-1])
        if len(new):
            cut = int(new[-1]) + 1
            yield settle(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield settle(rows)


def repeated_spans(base: DataFrame) -> DataFrame:
    """key, spans (of repeated bytes, unordered, may overlap) for each key of ``base`` (key, text) that has any."""
    found = materialize(anchors(base), "suffix-anchors")
    # runs are counted before anchors, so that a run of many copies is one row here
    counted = found.groupBy("anchor", "run").agg(F.count("*").alias("n"))
    often = counted.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("runs"), F.max(F.struct("n", "run")).alias("top"))
    often = often.where("all > 1").select("anchor", (F.col("runs") > 1).alias("several"), F.when(F.col("top.n") > 1, F.col("top.run")).alias("top"))
    # written, so that the join reads two plain shuffles, of which the optimiser can split a hot anchor's
    often = materialize(often, "suffix-often")
    occurs = found.join(often, "anchor").withColumn("whole", F.coalesce(F.col("run") == F.col("top"), F.lit(False))).drop("top")
    occurs = materialize(occurs, "suffix-occurrences")
    drop_materialized(found)
    drop_materialized(often)
    mixed = occurs.where("several")
    classes = mixed.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "count", "ahead")).alias("at"))
    wanted = classes.select("at.*", "anchor", "run").groupBy("key").agg(F.collect_list(F.struct("anchor", "run", "start", "count", "ahead")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for w in want:
                    values = (w["anchor"], w["run"], w["ahead"], w["count"], raw[w["start"] : w["start"] + w["count"] - 1 + LENGTH])
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["anchor", "run", "ahead", "count", "bytes"])

    texts = base.select("key", "text").dropDuplicates(["key"]).join(wanted, "key").select("text", "wanted")
    texts = texts.mapInArrow(cut, "anchor long, run long, ahead int, count int, bytes binary")
    settled = texts.repartition("anchor").sortWithinPartitions("anchor", "run")
    settled = settled.mapInArrow(_verdicts, "anchor long, run long, ranges array<struct<low: int, high: int>>")
    all_of = F.array(F.struct(F.lit(0).alias("low"), F.col("count").alias("high")))
    # an anchor's most frequent run, if it has copies, is settled; only the others look up their verdict
    several = mixed.where("not whole").join(classes.select("anchor", "run", "n").join(settled, ["anchor", "run"], "left"), ["anchor", "run"])
    span = lambda low, high: F.struct((F.col("start") + low).alias("low"), (F.col("start") + high + (LENGTH - 1)).alias("high")).alias("span")
    several = several.select("key", "start", F.explode(F.when(F.col("n") > 1, all_of).otherwise(F.col("ranges"))).alias("r"))
    single = occurs.where("whole or not several").select("key", span(F.lit(0), F.col("count")))
    return single.unionByName(several.select("key", span(F.col("r.low"), F.col("r.high")))).groupBy("key").agg(F.collect_set("span").alias("spans"))


def _kept(raw: bytes, spans: Iterable[dict]) -> tuple[list[bytes], int, int]:
    """What is left of a text, the bytes removed, and the maximal runs of them."""
    left, gone, runs_, end = [], 0, 0, 0
    for i, (low, high) in enumerate(sorted((s["low"], s["high"]) for s in spans)):
        if not i or low > end:
            left.append(raw[end:low])
            runs_ += 1
            gone += high - low
        elif high > end:
            gone += high - end
        end = max(end, high)
    left.append(raw[end:])
    return left, gone, runs_


def remove_repeats(docs: DataFrame, text_out: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``text_out`` also kept, the text that is left.

    Every byte is removed that a string of LENGTH bytes covers which starts anywhere else too, in the same document or another,
    the first occurrence included.  A null text counts as empty.  Null ids stay null; repeated rows are documents of
    their own, so they remove each other; other columns are left aside.  Where a cut falls within a character, its other bytes
    don't come into ``kept``.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("doc_id", F.lit("/"), "text"))
    spans = repeated_spans(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, many, shas, kept = [], [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                left, gone, runs_ = _kept(raw, found or ())
                rest = b"".join(left)
                n.append(len(raw))
                removed.append(gone)
                many.append(runs_)
                shas.append(hashlib.sha256(rest).hexdigest())
                if text_out:
                    kept.append("".join(p.decode("utf-8", "ignore") for p in left))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch(cols + [pa.array(kept, pa.string())] * text_out, names + ["kept"] * text_out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * text_out
    return base.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of text, and all other columns; a text that is all repeats becomes empty, a null stays null."""
    own, found_in = free_name(docs, "key"), free_name(docs, "spans")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", F.lit("/"), F.coalesce("text", F.lit(""))))
    spans = repeated_spans(keyed.select(F.col(own).alias("key"), F.coalesce("text", F.lit("")).alias("text")))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else b"".join(_kept(t.encode(), s)[0]).decode("utf-8", "ignore") for t, s in zip(texts, found, strict=True)])

    joined = keyed.join(spans.select(F.col("key").alias(own), F.col("spans").alias(found_in)), own, "left")
    return joined.withColumn("text", kept("text", found_in)).select(docs.columns)
