"""Packing of tokenised documents into windows by non-negative least squares over a length histogram.

Whole windows are cut off the front of long documents.  The rests' lengths, rounded up to a grid, make a histogram of bounded
size.  All ways to fill a window exactly with up to three grid lengths are enumerated; non-negative least squares
finds how often to repeat each so that the histogram is used up; the counts are rounded to what the histogram holds.  The
lengths that are left over are packed greedily: laid end to end and cut where a window is full.

Every document finds its place by its rank among the rests of its length, counted in two levels (within a salt, then over
salts), so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import ByteMerger, spread
from .common import map_texts, materialize

#: Rows of one salt, about: the unit in which ranks are counted and left-over rests are laid end to end.
SALT_ROWS = 2_000


class Codes(dict):
    """Numbers words by first occurrence; ``fresh`` has those that were new."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordTokenizer:
    """ids of whole texts by a lower-casing, white-space dropping BPE vocabulary with word ends.

    Words between white space are encoded once and remembered, with their pieces, until there are too many.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split() only
    MEMO = 1_000_000

    def __init__(self, path: str) -> None:
        self.merger = ByteMerger(path)
        special = sorted(self.merger.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.library = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.codes = Codes()
        #: By code: where a word's ids begin in the pool, and how many there are.
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower() alone would look at what follows a capital sigma
        return text.replace("Σ", "σ").lower()

    def _learn(self) -> None:
        """Puts the ids of all fresh words into the pool.

        A word of one piece is merged; others are put together from their pieces.  What the two Unicode tables may class
        differently, as one lacks it, is left to the library.
        """
        fresh, known = self.codes.fresh, len(self.begin)
        plain, given, cut = [], [], []
        at = 0
        while at < len(fresh):  # pieces are words too, so the list grows
            w = fresh[at]
            if w[0] == " ":  # a special token
                given.append((at, [self.merger.special[w[1:]]]))
            elif w.isalpha():
                plain.append(at)
            elif not w.isascii() and "Cn" in map(unicodedata.category, w):
                given.append((at, self.library.encode(w, add_special_tokens=False).ids))
            elif (pieces := self.PATTERN.findall(w)) == [w]:
                plain.append(at)
            else:
                cut.append((at, [self.codes[p] for p in pieces]))
            at += 1
        begin, size = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        merged, counts = self.merger.merge_in_order([fresh[i].encode() for i in plain])
        begin[plain], size[plain] = np.cumsum(counts) - counts + len(self.pool), counts
        pool = np.concatenate([self.pool, merged, *(np.array(ids, np.uint32) for _, ids in given)])
        end = len(self.pool) + len(merged)
        for at, ids in given:
            begin[at], size[at] = end, len(ids)
            end += len(ids)
        self.begin, self.size = np.append(self.begin, begin), np.append(self.size, size)
        if cut:
            codes = np.array([c for _, cs in cut for c in cs])
            owner = np.repeat([at for at, _ in cut], [len(cs) for _, cs in cut])
            size = np.bincount(owner, self.size[codes], minlength=len(fresh)).astype(np.int64)
            places = np.array([at for at, _ in cut])
            self.begin[known + places] = np.cumsum(size[places]) - size[places] + len(pool)
            self.size[known + places] = size[places]
            pool = np.append(pool, pool[spread(self.begin[codes], self.size[codes])])
        self.pool = pool
        fresh.clear()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.codes) > self.MEMO:
            self.forget()
        code = self.codes.__getitem__
        parts, ends = [np.zeros(0, np.int32)], [0]
        for text in texts:
            upto = ends[-1]
            for t in self.special.split(text) if "<|" in text else [text]:
                if t in self.merger.special:
                    words = [" " + t]  # no word has a space
                else:
                    t = self.normalise(t)
                    words = self.PATTERN.findall(t) if self.ODD_SPACE.search(t) else t.split()
                parts.append(np.fromiter(map(code, words), np.int32, len(words)))
                upto += len(words)
            ends.append(upto)
        self._learn()
        codes = np.concatenate(parts)
        n = self.size[codes]
        raw = self.pool[spread(self.begin[codes], n)].astype("<u4").tobytes()
        cuts = (np.concatenate([[0], np.cumsum(n)])[ends] * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |A x - target|, by the active-set method of Lawson and Hanson.

    ``columns``: for each column of A, the rows that it counts (one more row each time; -1: none).
    """
    m, n = len(target), len(columns)
    used = columns >= 0
    safe = np.where(used, columns, 0)
    x = np.zeros(n)
    passive = np.zeros(0, np.int64)
    rows = np.zeros((0, m))  # the passive columns, each as a row
    gram, aim = np.zeros((0, 0)), np.zeros(0)  # their inner products, with each other and with the target
    tolerance = 1e-9 * max(1.0, float(target.max(initial=0)))
    for _ in range(rounds or 3 * m):
        rest = target - x[passive] @ rows
        gain = np.where(used, rest[safe], 0.0).sum(1)
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        row = np.bincount(columns[j][used[j]], minlength=m).astype(float)
        cross = rows @ row
        gram = np.block([[gram, cross[:, None]], [cross[None, :], np.array([[row @ row + 1e-9]])]])
        passive, rows, aim = np.append(passive, j), np.vstack([rows, row]), np.append(aim, row @ target)
        while len(passive):
            z = np.linalg.solve(gram, aim)
            if z.min() > 0:
                x[:] = 0
                x[passive] = z
                break
            bad = z <= 0
            held = x[passive]
            step = min(1.0, float((held[bad] / np.maximum(held[bad] - z[bad], 1e-300)).min()))
            held = held + step * (z - held)
            keep = held > 1e-12
            if keep.all():  # no progress but for rounding
                keep = ~bad
            x[:] = 0
            passive, rows, aim, gram = passive[keep], rows[keep], aim[keep], gram[np.ix_(keep, keep)]
            x[passive] = held[keep]
    return x


def combinations(units: int) -> np.ndarray:
    """All multisets of one to three lengths in 1..units that sum to ``units``, longest first; 0: none."""
    rows = [(units, 0, 0)]
    rows += [(units - b, b, 0) for b in range(1, units // 2 + 1)]
    rows += [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return np.array(rows, np.int64)


def repeat_counts(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often to repeat each, in whole numbers, never more than the histogram (by units, from 0) holds."""
    units = len(histogram) - 1
    combos = combinations(units)
    scale = max(1, int(histogram.max()))
    x = nnls(combos - 1, histogram[1:] / scale) * scale
    counts = np.rint(x).astype(np.int64)
    combos, counts = combos[counts > 0], counts[counts > 0]

    def used() -> np.ndarray:
        out = np.zeros(units + 1, np.int64)
        for k in range(3):
            np.add.at(out, combos[:, k], np.where(combos[:, k] > 0, counts, 0))
        return out

    over = used() - histogram
    for unit in np.flatnonzero(over > 0).tolist():
        times = (combos == unit).sum(1)
        for j in np.flatnonzero(times).tolist():
            if (most := used()[unit] - histogram[unit]) <= 0:
                break
            counts[j] -= min(counts[j], -(-most // times[j]))
    keep = counts > 0
    return combos[keep], counts[keep]


def tokenise(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], window: int, end_id: int) -> DataFrame:
    """A row for each document: its number, whole windows' checksums, and the rest with its ids."""

    def kernel():
        encode = encoder()
        task = TaskContext.get().partitionId()
        state = {"row": task << 33, "window": task << 33}
        end = np.array(end_id, "<u4").tobytes()

        def f(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            uid, tokens, first, crcs, rest, rest_crc, rest_ids = [], [], [], [], [], [], []
            for ids in encode(texts):
                ids += end
                n = len(ids) // 4
                full = n // window
                tokens.append(n)
                uid.append(state["row"])
                state["row"] += 1
                first.append(state["window"])
                state["window"] += full
                crcs.append([zlib.crc32(ids[i * 4 * window : (i + 1) * 4 * window]) for i in range(full)])
                tail = ids[full * 4 * window :]
                rest.append(len(tail) // 4)
                rest_crc.append(zlib.crc32(tail))
                rest_ids.append(tail)
            cols = [uid, batch.column(0), tokens, first, crcs, rest, rest_crc, rest_ids]
            kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
            names = ["uid", "doc_id", "doc_tokens", "first_window", "crcs", "rest", "rest_crc", "rest_ids"]
            return pa.record_batch([c if k is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        return f

    schema = "uid long, doc_id long, doc_tokens long, first_window long, crcs array<long>, rest int, rest_crc long, rest_ids binary"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], window: int = 2048, end_id: int = 1, unit: int = 8) -> DataFrame:
    """Packs ``docs`` (doc_id, text): a row for each piece.

    doc_id, start (of the piece in its document's ids), length, ids_crc32, doc_tokens, sequence_id, offset (in the
    sequence).  A null or empty text is the end id alone.  Null ids and repeated rows are packed as they are; an empty
    table gives no rows; other columns are left aside.  Sequence ids are unique, not consecutive.
    """
    units = window // unit
    tokens = materialize(tokenise(docs, encoder, window, end_id), "packing-tokens")
    narrow = tokens.where("rest > 0").select("uid", "doc_id", "doc_tokens", "rest", "rest_crc", F.ceil(F.col("rest") / unit).cast("int").alias("bin"))
    sizes = np.zeros(units + 1, np.int64)
    for r in narrow.groupBy("bin").count().collect():  # at most `units` rows
        sizes[r["bin"]] = r["count"]
    n_salts = max(1, int(sizes.sum()) // SALT_ROWS)
    combos, counts = repeat_counts(sizes)
    base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # places of a bin's ranks: from which rank, in which combination, at which position of it
    keys, where = [], []
    taken = np.zeros(units + 1, np.int64)
    for j, (combo, n) in enumerate(zip(combos.tolist(), counts.tolist(), strict=True)):
        for position, length in enumerate(combo):
            if length:
                keys.append((length << 44) + int(taken[length]))
                where.append((base[j], position))
                taken[length] += n
    order = np.argsort(keys) if keys else np.zeros(0, np.int64)
    keys, where = np.array(keys, np.int64)[order], np.array(where, np.int64).reshape(-1, 2)[order]

    @F.pandas_udf("struct<sequence: long, position: int>")
    def place(bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        b, r = bins.to_numpy(np.int64), ranks.to_numpy(np.int64)
        left = r >= taken[b]
        at = np.searchsorted(keys, (b << 44) + r, side="right") - 1
        if not len(keys):
            return pd.DataFrame({"sequence": np.full(len(b), -1), "position": np.zeros(len(b), np.int32)})
        start = keys[at] & ((1 << 44) - 1)
        return pd.DataFrame({"sequence": np.where(left, -1, where[at, 0] + r - start), "position": where[at, 1].astype(np.int32)})

    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(n_salts)))
    before = salted.groupBy("bin", "salt").count()
    before = before.select("bin", "salt", F.coalesce(F.sum("count").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("uid")) - 1)
    placed = ranked.join(before, ["bin", "salt"]).withColumn("at", place("bin", F.col("rank") + F.col("before")))
    placed = materialize(placed.select("uid", "doc_id", "doc_tokens", "rest", "rest_crc", "salt", "at.*"), "packing-places")
    start = F.col("doc_tokens") - F.col("rest")

    full = tokens.select("doc_id", "doc_tokens", "first_window", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        ((F.col("first_window") + F.col("i")) * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    in_sequence = Window.partitionBy("sequence").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    solved = placed.where("sequence >= 0").select(
        "doc_id", start.alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("sequence") * 4 + 1).alias("sequence_id"), F.coalesce(F.sum(F.col("rest").cast("long")).over(in_sequence), F.lit(0)).alias("offset"),
    )
    # what is left over, end to end within its salt
    line = Window.partitionBy("salt").orderBy("uid")
    laid = placed.where("sequence < 0").withColumn("end", F.sum(F.col("rest").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("begin", F.col("end") - F.col("rest"))
    window_of = lambda c: F.floor(c / window)
    # a salt's windows are numbered below twice its mean number of rows, or so many bits as salts leave
    salt_windows = 1 << (60 - n_salts.bit_length())
    cut = laid.withColumn("k", F.explode(F.sequence(window_of(F.col("begin")), window_of(F.col("end") - 1))))
    low, high = F.greatest("begin", F.col("k") * window), F.least("end", (F.col("k") + 1) * window)
    cut = cut.select(
        "uid", "doc_id", "doc_tokens", "rest", "rest_crc", (low - F.col("begin")).alias("from"), (high - low).alias("length"),
        (start + low - F.col("begin")).alias("start"), ((F.col("salt") * salt_windows + F.col("k")) * 4 + 2).alias("sequence_id"), (low - F.col("k") * window).alias("offset"),
    )
    whole = cut.where("length = rest").select("doc_id", "start", "length", F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    @F.pandas_udf("long")
    def part_crc(ids: pd.Series, begin: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(i[4 * b : 4 * (b + n)]) for i, b, n in zip(ids, begin, length, strict=True)], dtype="int64")

    partial = cut.where("length < rest").join(tokens.select("uid", "rest_ids"), "uid")
    partial = partial.select("doc_id", "start", "length", part_crc("rest_ids", "from", "length").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return full.unionByName(solved).unionByName(whole).unionByName(partial)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    return pack(docs, lambda: WordTokenizer(vocabulary).encode_batch, window, end_id)
