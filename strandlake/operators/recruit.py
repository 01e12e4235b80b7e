"""Recruitment of reads by bait words: target hits, block cover, calls, growth of the bait to a fixed point."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed
from .kmers import blocks, bounded, kmers, pieces
from .superwords import answered, asked, dealt, groups_of, packed, packets, shares_for, unpacked

#: Fixed defaults by read type: word length, gap that blocks bridge, least share of words that hit, least block of a candidate.
PRESETS = {"hifi": (21, 50, 0.2, 1000), "ont": (15, 200, 0.05, 2000), "sr": (21, 40, 0.2, None)}
MIN_COVER = 0.8
#: Rows up to which a bait is broadcast; beyond, the join is left to the optimiser.
BROADCAST_BAIT = 2_000_000


def bit(n: Column) -> Column:
    """The integer with bit ``n`` set."""
    return F.call_function("shiftleft", F.lit(1), n.cast("int"))


def bait_of(seeds: DataFrame, target: Column, k: int) -> DataFrame:
    """(kmer, mask): words of seeds (id, seq) with a bit for each target that has them."""
    words = kmers(seeds.select(target.alias("target"), "seq"), k, key="target")
    return words.groupBy("kmer").agg(F.bit_or(bit(F.col("target"))).alias("mask"))


def sized(bait: DataFrame) -> DataFrame:
    """The bait with a broadcast hint if it is small enough."""
    return F.broadcast(bait) if bait.limit(BROADCAST_BAIT + 1).count() <= BROADCAST_BAIT else bait


def hits(words: DataFrame, bait: DataFrame, targets: int) -> DataFrame:
    """(doc_id, target, pos): a row for each word of a read and target that has it."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(targets - 1)), lambda t: F.getbit(F.col("mask").cast("long"), t) == 1)
    return words.join(sized(bait), "kmer").select("doc_id", "pos", F.explode(bits).alias("target"))


def target_hits(words: DataFrame, bait: DataFrame, targets: int, k: int, gap: int) -> DataFrame:
    return blocks(hits(words, bait, targets), k, gap, ["doc_id", "target"])


def best_targets(per_target: DataFrame) -> DataFrame:
    """Each read's best by (cover, hits): all that tie as a bit mask."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("cover"), F.desc("hits"))
    best = per_target.withColumn("r", F.rank().over(w)).where("r = 1")
    mask = F.bit_or(bit(F.col("target"))).alias("mask")
    return best.groupBy("doc_id").agg(mask, F.min("target").alias("first"), F.max("cover").alias("cover"), F.max("hits").alias("hits"), F.max("longest").alias("longest"))


def calls(reads: DataFrame, totals: DataFrame, best: DataFrame, preset: str = "hifi", min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, call, mask, …): organelle for every tied target, candidate for the first, or other.

    ``totals`` (doc_id, kmers) counts each read's words.
    """
    _, _, share, block = PRESETS[preset]
    lengths = reads.select("doc_id", F.length("seq").alias("len")).join(totals, "doc_id", "left").join(best, "doc_id", "left")
    ok = (F.col("cover") >= F.col("len") * min_cover) & (F.col("hits") >= F.coalesce("kmers", F.lit(0)) * share)
    candidate = F.lit(False) if block is None else F.col("longest") >= block
    call = F.when(ok, "organelle").when(candidate, "candidate").otherwise("other")
    out = lengths.select("doc_id", call.alias("call"), "mask", "first", "len", F.coalesce("cover", F.lit(0)).alias("cover"), F.coalesce("hits", F.lit(0)).alias("hits"))
    picked = F.when(F.col("call") == "organelle", F.col("mask")).when(F.col("call") == "candidate", bit(F.col("first"))).otherwise(F.lit(0))
    return out.withColumn("mask", picked).drop("first")


def _filter_of(words: np.ndarray) -> tuple[np.ndarray, int]:
    """A table of flags, at least sixteen for each word; a word's flag is found by its product's high bits."""
    bits = max(10, (16 * len(words)).bit_length())
    flags = np.zeros(1 << bits, bool)
    flags[_slot(words, bits)] = True
    return flags, bits


def _slot(words: np.ndarray, bits: int) -> np.ndarray:
    return ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _by_target(read: np.ndarray, mask: np.ndarray, n: int, targets: int) -> np.ndarray:
    """Hits of each of n reads, target by target."""
    out = np.zeros((n, targets), np.int64)
    hit = np.flatnonzero(mask)
    read, mask = read[hit], mask[hit]
    for t in range(0, targets, 8):
        width = min(8, targets - t)
        seen = np.bincount(read << width | (mask >> t) & ((1 << width) - 1), minlength=n << width).reshape(n, -1)
        out[:, t : t + width] = seen @ ((np.arange(1 << width)[:, None] >> np.arange(width)) & 1)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def written_questions(reads: DataFrame, k: int, write: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, int]:
    shares = shares_for(reads)
    return write(asked(reads, k, shares), "questions"), shares


def target_counts(reads: DataFrame, bait: DataFrame, targets: int, k: int, questions: Callable[[], tuple[DataFrame, int]] | None = None, table: DataFrame | None = None) -> DataFrame:
    """(doc_id, target, hits) of reads (doc_id, seq) that hold words of the bait (kmer, mask).

    A bait of at most ``BROADCAST_BAIT`` words is sent to the reads; the words of a greater one are looked up by shares:
    ``questions()`` gives what the reads ask (``superwords.asked``, written) and the number of shares; without it they are written here.
    ``table`` is the bait as ``superwords.dealt`` has it, where that is at hand.
    """
    kind = reads.schema["doc_id"].dataType.simpleString()
    if bait.limit(BROADCAST_BAIT + 1).count() <= BROADCAST_BAIT:
        table = bait.orderBy("kmer").toArrow()
        words, masks = (table.column(c).to_numpy() for c in ("kmer", "mask"))
        held = reads.sparkSession.sparkContext.broadcast((words, masks, *_filter_of(words)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, masks, flags, bits = held.value
            for part in bounded(batches):
                out = np.zeros((len(part), targets), np.int64)
                for p in pieces(part.column(1), k):
                    at = np.flatnonzero(p.ok)
                    word = p.canonical()[at]
                    maybe = np.flatnonzero(flags[_slot(word, bits)])
                    i = np.minimum(np.searchsorted(words, word[maybe]), len(words) - 1)
                    mask = np.where(words[i] == word[maybe], masks[i], 0) if len(words) else np.zeros(0, np.int64)
                    out += _by_target(p.read[at[maybe]], mask, len(part), targets)
                yield pa.record_batch([part.column(0), _lists(out)], ["doc_id", "hits"])

        found = reads.select("doc_id", "seq").mapInArrow(run, f"doc_id {kind}, hits array<long>")
    else:
        sent, shares = (questions or partial(written_questions, reads, k, checkpointed))()
        if table is None:
            table = dealt(bait.select("kmer", F.col("mask").cast("long").alias("value")), k, shares)
        found = answered(sent, k, lambda read, mask, kinds: {"hits": _lists(_by_target(read, mask, len(kinds), targets))}, f"doc_id {kind}, hits array<long>", table=table)
    return found.select("doc_id", F.posexplode("hits").alias("target", "hits")).where("hits > 0")


def grown(held: DataFrame, reads: DataFrame, targets: int, k: int, min_reads: int, shares: int) -> DataFrame:
    """(share, words, body, held): a bait (share, held) with the words that ``min_reads`` of the reads (mask, seq) of a target hold.

    A word has a bit for each such target.  ``body`` has what the bait gains, ``words`` their number.
    """

    def run(bodies: pa.Table, old: pa.Table) -> pa.Table:
        groups = groups_of(bodies.column("body"), k)
        before, mask = unpacked(old.column("held"))
        word = np.concatenate([before, *(w for w, _ in groups.values())])
        n = np.concatenate([np.zeros(len(before), np.int64), *(x for _, x in groups.values())])
        group = np.repeat(np.array([0, *groups], np.int64), [len(before), *(len(w) for w, _ in groups.values())])
        order = np.argsort(word, kind="stable")  # the bait's own entry of a word is its first
        word, n, group = word[order], n[order], group[order]
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        was = np.append(mask, np.zeros(len(word) - len(mask), np.int64))[order][starts]
        now = np.zeros(len(starts), np.int64)
        for t in range(targets if len(starts) else 0):
            now |= (np.add.reduceat(n * ((group >> t) & 1), starts) >= min_reads).astype(np.int64) << t
        word, gain = word[starts], now & ~was
        new, kept = gain != 0, (was | now) != 0
        share = (bodies if len(bodies) else old).column("share")[0].as_py()
        row = (share, int(new.sum()), packed(word[new], gain[new]), packed(word[kept], (was | now)[kept]))
        return pa.table([pa.array([x], c) for x, c in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["share", "words", "body", "held"])

    sent = packets(reads, k, shares, group="mask", once=True)
    return sent.groupBy("share").cogroup(held.select("share", "held").groupBy("share")).applyInArrow(run, "share int, words long, body binary, held binary")


def _rows(table: DataFrame) -> DataFrame:
    """(kmer, mask) of a table (share, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                yield pa.record_batch(list(map(pa.array, unpacked([body]))), ["kmer", "mask"])

    return table.select("body").mapInArrow(run, "kmer long, mask long")


def fixpoint(reads: DataFrame, bait: DataFrame, targets: int, k: int, write, min_reads: int = 2, min_hits: int = 20, saturation: float = 0.05) -> DataFrame:
    """(doc_id, target, pass): reads taken in, pass by pass; words that ``min_reads`` of a pass' new reads share join the bait.

    A read is taken for a target when ``min_hits`` of its windows hold words of it.  Stops when nothing is taken or when a pass takes less
    than ``saturation`` of the one before.  Hits add up, so a pass looks up only what the bait has gained.  ``write`` cuts
    lineage after each pass (``write(df, name) -> df``).
    """
    reads = write(reads.select("doc_id", "seq"), "reads")
    questions = cache(partial(written_questions, reads, k, write))
    shares = shares_for(reads)
    bait = dealt(bait.select("kmer", F.col("mask").cast("long").alias("value")), k, shares)
    bait = write(bait.select("share", "body", F.col("body").alias("held")), "bait")
    hits = taken = None
    previous = 0
    for n in count(1):
        found = target_counts(reads, _rows(bait), targets, k, questions, bait)
        if hits is not None:
            found = found.unionByName(hits).groupBy("doc_id", "target").agg(F.sum("hits").alias("hits"))
        hits = write(found, f"hits-{n}")
        new = hits.where(F.col("hits") >= min_hits).select("doc_id", "target")
        new = write((new if taken is None else new.join(taken, ["doc_id", "target"], "left_anti")).withColumn("pass", F.lit(n)), f"pass-{n}")
        size = new.count()
        taken = new if taken is None else write(taken.unionByName(new), f"taken-{n}")
        if not size or size < saturation * previous:
            return taken
        previous = size
        masks = new.groupBy("doc_id").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("target"))).alias("mask"))
        bait = write(grown(bait, reads.join(masks, "doc_id").select("mask", "seq"), targets, k, min_reads, shares), f"bait-{n}")
