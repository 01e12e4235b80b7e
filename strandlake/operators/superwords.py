"""Counting the words of all reads, and looking up each read's words, with about a byte a base shuffled.

Consecutive windows that have the same minimizer (the least canonical ``m``-mer, by a hash) are one superword: at most 31 bases
in one integer.  A word and its reverse complement have the same minimizer, so its hash deals all copies of a word into
one share.  Superwords are summed up by batch before they are shuffled, so a word or passage that a third of all reads hold
comes once from each batch; what a share gets is bounded by ``SHARE_WORDS`` words on average.

``counted`` calls a function with each share's words and counts.  ``looked_up`` gives each share's answers back to the batch
that asked, and calls a function with the words' answers in each read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmers import Piece, bounded, check_k, pieces, roll, roll_back, sorted_words, tallies

#: Words of a share, about, and of a batch that is summed up before the shuffle.
SHARE_WORDS, BATCH_WORDS = 4_000_000, 4_000_000
#: Length of the minimizer.
MINIMIZER = 11
_MIX = 0x9E3779B97F4A7C15
SENT = (pa.int32(), pa.int64(), pa.int32(), pa.binary())


def superwords(p: Piece, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read, key and minimizer's hash of each superword of a piece.  A key is a one bit and the bases."""
    k, width, cap = p.k, p.k - m + 1, 32 - p.k
    mask = (1 << 2 * m) - 1
    low = (np.minimum(roll(p.codes, m), roll_back(p.codes, m)) * (_MIX & mask | 1)) & mask
    size, best = 1, low
    while 2 * size <= width:  # least of 1, 2, 4, … from each place on
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    at = np.flatnonzero(p.ok)
    least = best[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    starts = np.flatnonzero(begins)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    starts = np.flatnonzero(place % cap == 0)
    extra = np.diff(np.append(starts, len(at))) - 1
    first = at[starts]
    bits = 2 * extra
    key = (p.word[first] << bits) | (p.word[first + extra] & ((1 << bits) - 1)) | (np.int64(1) << (2 * k + bits))
    return p.read[first], key, least[starts]


def share_of(least: np.ndarray, shares: int) -> np.ndarray:
    mixed = least.astype(np.uint64) * np.uint64(_MIX)
    return ((mixed >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)


def reverse_complement(word: np.ndarray, k: int) -> np.ndarray:
    x = ~word.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def extra_words(keys: np.ndarray, k: int) -> np.ndarray:
    """How many words beyond the first each superword has."""
    return (np.frexp(keys.astype(float))[1] - 1) // 2 - k


def words_of(keys: np.ndarray, k: int) -> np.ndarray:
    """Canonical words of superwords, in order."""
    extra = extra_words(keys, k)
    owner = np.repeat(np.arange(len(keys)), extra + 1)
    back = np.repeat(np.cumsum(extra + 1) - 1, extra + 1) - np.arange(len(owner))
    word = (keys[owner] >> 2 * back) & ((1 << 2 * k) - 1)
    return np.minimum(word, reverse_complement(word, k))


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    """An integer array as byte planes, which compress better than the values."""
    return x.dtype.str, x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _values(x: tuple[str, bytes]) -> np.ndarray:
    kind = np.dtype(x[0])
    return np.frombuffer(x[1], np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def small(x: np.ndarray) -> np.ndarray:
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(np.min_scalar_type(high if low >= 0 else min(low, -high - 1)))


def dump(x: Any) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def load(x: bytes) -> Any:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def totals(value: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sum of each one's weights (or its count)."""
    if weight is None:
        value = np.sort(value)
    else:
        order = np.argsort(value)
        value, weight = value[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    sums = np.diff(np.append(starts, len(value))) if weight is None else np.add.reduceat(weight, starts) if len(value) else np.zeros(0, np.int64)
    return value[starts], sums


def shares_for(reads: DataFrame, seq: str = "seq") -> int:
    """How many shares the words of reads (…, seq) need; ``seq`` may be a longer text that the reads come from."""
    bases = reads.agg(F.sum(F.octet_length(seq))).first()[0] or 0
    return max(1, math.ceil(bases / SHARE_WORDS))


def _repeats(read: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read, word and n - 1 of words that a read holds n > 1 times."""
    r, w = sorted_words(read, word, k)
    again = np.flatnonzero((r[1:] == r[:-1]) & (w[1:] == w[:-1])) + 1
    r, w = r[again], w[again]
    starts = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])) if len(w) else again
    return r[starts], w[starts], np.diff(np.append(starts, len(w)))


def packets(reads: DataFrame, k: int, shares: int, group: str | None = None, once: bool = False, m: int = MINIMIZER) -> DataFrame:
    """(share, body): superwords of reads (group, seq), summed up by batch and group; ``once``: a read's repeats of a word are taken off again."""
    check_k(k)
    m = min(m, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[Any, int] = {} if group else {None: 0}
        held: list[tuple[np.ndarray, ...]] = []  # group's number, key, minimizer's hash, count
        size = 0

        def flush() -> pa.RecordBatch:
            names = list(number)
            code, keys, least, n = (np.concatenate(x) for x in zip(*held, strict=True))
            place = share_of(least, shares) * len(names) + code
            order = np.lexsort((keys, place))
            keys, place, n = keys[order], place[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])])) if len(keys) else np.zeros(0, np.int64)
            keys, place = keys[starts], place[starts]
            n = np.add.reduceat(n, starts) if len(starts) else n
            parts: dict[int, list] = {}
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])).tolist() if len(place) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                share, g = divmod(int(place[a]), len(names))
                parts.setdefault(share, []).append((names[g], _planes(np.diff(keys[a:b], prepend=0)), _planes(small(n[a:b]))))
            return pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([dump(x) for x in parts.values()], pa.binary())], ["share", "body"])

        for batch in batches:
            for part in bounded(iter([batch])):
                names = part.column(0).to_pylist() if group else [None] * len(part)
                codes = np.array([number.setdefault(x, len(number)) for x in names], np.int64)
                seen: list[tuple[np.ndarray, np.ndarray]] = []
                for p in pieces(part.column(1), k):
                    read, key, least = superwords(p, m)
                    size += int(p.ok.sum())
                    held.append((codes[read], key, least, np.ones(len(key), np.int64)))
                    if once:
                        seen.append((p.read[p.ok], p.canonical()[p.ok]))
                if seen:
                    read, word, n = _repeats(*(np.concatenate(x) for x in zip(*seen, strict=True)), k)
                    held.append((codes[read], word | (np.int64(1) << 2 * k), minimizer_of(word, k, m), -n))
                if size >= BATCH_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    columns = [F.col(group) if group else F.lit(None).cast("string").alias("group"), "seq"]
    return reads.select(*columns).mapInArrow(run, "share int, body binary")


def minimizer_of(words: np.ndarray, k: int, m: int) -> np.ndarray:
    """The hash of each packed word's minimizer, as ``superwords`` has it."""
    mask = (1 << 2 * m) - 1
    best = None
    for i in range(k - m + 1):
        x = (words >> 2 * i) & mask
        x = (np.minimum(x, reverse_complement(x, m)) * (_MIX & mask | 1)) & mask
        best = x if best is None else np.minimum(best, x)
    return best


def counted(sent: DataFrame, k: int, f: Callable[[dict[Any, tuple[np.ndarray, np.ndarray]]], dict[str, list]], schema: str) -> DataFrame:
    """``f`` of each share's words: by group, distinct words (ascending) and how often they occur."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({c: pa.array(v) for c, v in f(groups_of(table.column("body"), k)).items()})

    return sent.groupBy("share").applyInArrow(run, schema)


def groups_of(bodies: pa.ChunkedArray, k: int) -> dict[Any, tuple[np.ndarray, np.ndarray]]:
    """By group, distinct words (ascending) and how often they occur, of a share's ``packets``."""
    found: dict[Any, list] = {}
    for body in bodies:
        for name, keys, n in load(body.as_py()):
            found.setdefault(name, []).append((np.cumsum(_values(keys)), _values(n).astype(np.int64)))
    groups = {}
    for name, parts in found.items():
        # copies of a superword first, then copies of a word
        keys, n = totals(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
        word, n = totals(words_of(keys, k), np.repeat(n, extra_words(keys, k) + 1))
        groups[name] = (word[n > 0], n[n > 0])
    return groups


def shared(sent: DataFrame, k: int) -> DataFrame:
    """(a, b, n): words that groups a <= b both hold, by share; a group's own words where a = b."""

    def f(groups):
        names = sorted(groups)
        word = np.concatenate([groups[g][0] for g in names])
        group = np.repeat(np.arange(len(names)), [len(groups[g][0]) for g in names])
        order = np.argsort(word, kind="stable")  # a word's groups stay in order
        word, group = word[order], group[order]
        n = np.zeros((len(names), len(names)), np.int64)
        i, step = np.arange(len(word)), 0
        while len(i):
            n += np.bincount(group[i] * len(names) + group[i + step], minlength=n.size).reshape(n.shape)
            step += 1
            i = i[i + step < len(word)]
            i = i[word[i] == word[i + step]]
        a, b = np.nonzero(n)
        return {"a": [names[x] for x in a], "b": [names[x] for x in b], "n": n[a, b]}

    return counted(sent, k, f, "a string, b string, n long")


def spectrum(reads: DataFrame, k: int, shares: int, once: bool = False) -> DataFrame:
    """(n, kmers): how many words occur n times in all reads (…, seq); ``once``: how many words n reads hold."""

    def f(groups):
        n, words = totals(groups[None][1])
        return {"n": n, "kmers": words}

    each = counted(packets(reads, k, shares, once=once), k, f, "n long, kmers long")
    return each.groupBy("n").agg(F.sum("kmers").alias("kmers"))


def looked_up(reads: DataFrame, k: int, shares: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, key: str = "doc_id", m: int = MINIMIZER) -> DataFrame:
    """(key, schema): ``f(read, n, distinct)`` of each batch of reads (key, seq).

    ``read`` and ``n`` have an entry for each window: its read, and how often all reads hold its word.  A read's entries are together.
    ``distinct`` has the number of different words of each read.
    """
    return answered(asked(reads, k, shares, key, True, m), k, f, f"{key} {reads.schema[key].dataType.simpleString()}, {schema}")


def asked(reads: DataFrame, k: int, shares: int, key: str = "doc_id", tally: bool = False, m: int = MINIMIZER) -> DataFrame:
    """(share, batch, at, body): what batches of reads (key, seq) ask each share, and at -1 what a batch keeps; for ``answered``."""
    check_k(k)
    m = min(m, k)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        distinct: list[np.ndarray] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            read, keys, least = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]) for i in range(3))
            share = share_of(least, shares)
            order = np.lexsort((keys, share))
            s, x = share[order], keys[order]
            new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
            which = np.empty(len(x), np.int64)
            which[order] = np.cumsum(new) - 1
            n = np.bincount(which)
            s, x = s[new], x[new]
            # which superwords each read has; their order within a read doesn't matter
            by = np.lexsort((which, read))
            lengths = np.bincount(read, minlength=rows)
            own = (pa.concat_arrays(ids), _planes(small(lengths)), _planes(small(np.diff(which[by], prepend=0))), _planes(small(extra_words(x, k))), _planes(small(np.concatenate(distinct))))
            out = [(batch % shares, batch, -1, dump(own))]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])).tolist() if len(s) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                out.append((int(s[a]), batch, a, dump((_planes(np.diff(x[a:b], prepend=0)), _planes(small(n[a:b]))))))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SENT, strict=True)], ["share", "batch", "at", "body"])

        for sent_batch in batches:
            for part in bounded(iter([sent_batch])):
                read, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for p in pieces(part.column(1), k):
                    r, x, least = superwords(p, m)
                    held.append((r + rows, x, least))
                    size += int(p.ok.sum())
                    if tally:
                        read.append(p.read[p.ok])
                        word.append(p.canonical()[p.ok])
                distinct.append(tallies(*sorted_words(np.concatenate(read), np.concatenate(word), k), len(part))[1])
                ids.append(part.column(0))
                rows += len(part)
                if size >= BATCH_WORDS:
                    yield flush()
                    batch += 1
                    ids, held, distinct, rows, size = [], [], [], 0, 0
        if rows:
            yield flush()

    return reads.select(key, "seq").mapInArrow(ask, "share int, batch long, at int, body binary")


def answered(sent: DataFrame, k: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, table: DataFrame | None = None, m: int = MINIMIZER) -> DataFrame:
    """(schema): ``f(read, n, distinct)`` of each batch that ``asked``, as in ``looked_up``; the schema begins with the reads' key.

    With a ``table`` of distinct words (``dealt``), n is the word's value (0: none).  What was asked is read twice then, so it should be written.
    """

    def answer(packets: pa.Table, values: pa.Table | None = None) -> pa.Table:
        out, asked = [], []
        for batch, at, body in zip(*(packets.column(c).to_pylist() for c in ("batch", "at", "body")), strict=True):
            if at < 0:
                out.append((batch, at, body))
            else:
                keys, n = load(body)
                asked.append((batch, at, np.cumsum(_values(keys)), _values(n).astype(np.int64)))
        if asked:
            keys, n = totals(np.concatenate([x[2] for x in asked]), np.concatenate([x[3] for x in asked]))
            extra = extra_words(keys, k)
            word = words_of(keys, k)
            if values is None:
                order = np.argsort(word)
                total = np.empty(len(word), np.int64)
                sums, starts = np.repeat(n, extra + 1)[order], np.flatnonzero(np.concatenate([[True], np.diff(word[order]) != 0]))
                total[order] = np.repeat(np.add.reduceat(sums, starts), np.diff(np.append(starts, len(word))))
            else:
                known, value = unpacked(values.column("body"))
                by = np.argsort(known)
                known, value = np.append(known[by], -1), np.append(value[by], 0)
                i = np.searchsorted(known[:-1], word)
                total = np.where(known[i] == word, value[i], 0)
            begin = np.cumsum(extra + 1) - extra - 1
            for batch, at, own, _ in asked:
                i = np.searchsorted(keys, own)
                out.append((batch, at, dump(_planes(small(total[_spread(begin[i], extra[i])])))))
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(("batch", "at", "body"), SENT[1:], strict=True))})

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), table.column("body").to_pylist(), strict=True))
        ids, lengths, which, extra, distinct = load(rows[0][1])
        lengths, which, extra, distinct = (_values(x).astype(np.int64) for x in (lengths, which, extra, distinct))
        n = np.concatenate([np.zeros(0, np.int64), *(_values(load(b)) for _, b in rows[1:])])
        which = np.cumsum(which)
        begin = np.cumsum(extra + 1) - extra - 1
        read = np.repeat(np.repeat(np.arange(len(ids)), lengths), extra[which] + 1)
        out = f(read, n[_spread(begin[which], extra[which])], distinct)
        return pa.table([ids, *map(pa.array, out.values())], names)

    names = [x.split()[0] for x in schema.split(", ")]
    columns = "batch long, at int, body binary"
    if table is None:
        answers = sent.groupBy("share").applyInArrow(lambda x: answer(x), columns)
    else:
        mine, questions = sent.where("at < 0").select("batch", "at", "body"), sent.where("at >= 0")
        answers = questions.groupBy("share").cogroup(table.select("share", "body").groupBy("share")).applyInArrow(lambda x, y: answer(x, y), columns).unionByName(mine)
    return answers.groupBy("batch").applyInArrow(finish, schema)


def dealt(table: DataFrame, k: int, shares: int, m: int = MINIMIZER) -> DataFrame:
    """(share, body): words and values of a table (kmer, value), some rows for each share."""
    m = min(m, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            word, value = (np.concatenate(x) for x in zip(*held, strict=True))
            share = share_of(minimizer_of(word, k, m), shares)
            order = np.lexsort((word, share))
            share, word, value = share[order], word[order], value[order]
            cuts = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1], [True]])).tolist() if len(share) else []
            bodies = [packed(word[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.record_batch([pa.array(share[cuts[:-1]], pa.int32()), pa.array(bodies, pa.binary())], ["share", "body"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= BATCH_WORDS:
                yield flush()
                held = []
        if held:
            yield flush()

    return table.select("kmer", "value").mapInArrow(run, "share int, body binary")


def packed(word: np.ndarray, value: np.ndarray) -> bytes:
    """Ascending words and their values."""
    return dump((_planes(np.diff(word, prepend=0)), _planes(small(value))))


def unpacked(bodies: Iterable[pa.Scalar]) -> tuple[np.ndarray, np.ndarray]:
    """Words and values of all bodies, in each body's order."""
    parts = [load(b.as_py()) for b in bodies]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(np.cumsum(_values(w)) for w, _ in parts)]), np.concatenate([none, *(_values(v).astype(np.int64) for _, v in parts)])


def _spread(begin: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """begin, begin + 1, …, begin + extra of each, end to end."""
    ends = np.cumsum(extra + 1)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - extra - 1), extra + 1)
