"""A bigram language model in Elias-Fano tries, one for each share of the contexts.

Texts are lower-cased words between two boundary marks.  Every word (and the mark before the first) is the context of its
successor.  Contexts are dealt into shares by hash; one that makes up more than a share's part of all tokens is split by successor, so no
share grows with a frequent word.  Batches of texts send each share their distinct pairs with training counts; there the share's
trie is built and asked for all batches' pairs, and codes of one byte go back, to be summed up by text.

A share's trie has two levels.  The first holds the contexts' hashes, a monotone sequence of pointers to where their successors
begin, and their back-off weights; the second holds successors as numbers relative to their context (context's rank times the number
of words, plus the word's rank: monotone) and the pairs' probabilities.  Monotone sequences are Elias-Fano coded,
probabilities are codes of one byte into a codebook, and all of it lies in one memory-mapped file.

Smoothing is absolute discounting with back-off: p(w | v) = (c(v, w) - D) / c(v) for pairs seen in training, else
D * t(v) / c(v) * p(w), with t(v) successors of v and p(w) the add-one unigram; for contexts never seen, p(w).  (What unseen
words give up to seen ones isn't shared out again, so probabilities sum to at most one.)
"""

from __future__ import annotations

import math
import mmap
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, slices

DISCOUNT = 0.75
#: Characters of text for each share of the contexts, about; and of a batch whose pairs are packed together.
SHARE_CHARS, BATCH_CHARS = 8_000_000, 12_000_000
#: The boundary mark, as a word that no text can hold.
MARK = xxhash.xxh64_intdigest(b" ", 1) >> 1


class EliasFano:
    """A non-decreasing sequence of n integers below 2 ** 63: low bits packed, high bits in unary.

    ``access`` gives elements by place; ``find`` gives the place of the first element that equals a value, or -1.
    """

    FIELDS = ("head", "low", "high", "ones")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.head, self.low, self.high, self.ones = head, low, high, ones
        self.n, self.bits, self.top = (int(x) for x in head)
        zeros = np.arange(len(ones)) * 64 - ones  # before each word
        self.zeros = zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits) // 64 + 2, np.uint64)
        if bits and n:
            rest = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, rest << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - off[over]))
        up = (v >> np.uint64(bits)).astype(np.int64)
        top = int(up[-1]) if n else 0
        flags = np.zeros(((n + top + 1) // 64 + 1) * 64, np.uint8)
        flags[up + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(np.array([n, bits, top], np.int64), low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> off
        over = off + np.uint64(self.bits) > 64
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return (x & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero with ``flip``, of the unary part."""
        word = np.searchsorted(before, k, side="right") - 1
        x = self.high[word]
        x = ~x if flip else x.copy()
        left = k - before[word]
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # halve the word by the ones below
            below = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= below
            left = np.where(up, left - below, left)
            at += np.where(up, step, 0)
            x = np.where(up, x >> np.uint64(step), x)
        return word * 64 + at

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, False) - i) << self.bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Successor search: within the elements that share x's high bits, by halving."""
        out = np.full(len(x), -1)
        if not self.n:
            return out
        h = x >> self.bits
        ok = (x >= 0) & (h <= self.top)
        at = np.flatnonzero(ok)
        h, want = h[at], x[at] & ((1 << self.bits) - 1)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) + 1 - h, 0)
        hi = end = self._select(h, self.zeros, True) - h
        hi = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(at), bool)
            less[open_] = self._low(mid[open_]) < want[open_]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == want[hit]
        out[at[hit]] = lo[hit]
        return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 of one byte, and the codebook: the values themselves if they are few, else the mean in each of 255 equal steps."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    s = np.sort(x)
    values = s[np.concatenate([[True], s[1:] != s[:-1]])]
    if len(values) <= 255:
        return (np.searchsorted(values, x) + 1).astype(np.uint8), np.append(0.0, values)
    codes = 1 + np.minimum((x - s[0]) * (255 / (s[-1] - s[0])), 254).astype(np.int64)
    n = np.maximum(np.bincount(codes, minlength=256), 1)
    return codes.astype(np.uint8), np.bincount(codes, x, minlength=256) / n


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays again, lying in one memory-mapped file whose name is gone at once."""
    with tempfile.TemporaryFile() as f:
        places, at = {}, 0
        for k, a in arrays.items():
            places[k] = (a.dtype, len(a), at)
            at += f.write(np.ascontiguousarray(a).tobytes())
            at += f.write(b"\0" * (-at % 8))
        f.flush()
        held = mmap.mmap(f.fileno(), max(at, 1), access=mmap.ACCESS_READ) if at else b""
    return {k: np.frombuffer(held, kind, n, at) for k, (kind, n, at) in places.items()}


class Trie:
    """From training pairs: hashes of contexts and successors, and counts.

    ``heavy``: ascending contexts whose successors lie in several shares, and how often each occurs in training.
    """

    def __init__(self, v: np.ndarray, w: np.ndarray, n: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], discount: float = DISCOUNT) -> None:
        contexts, vi = numbered(v)
        words, wi = numbered(w)
        self.width = max(1, len(words))
        pairs, counts = summed(vi * self.width + wi, n)
        owner = pairs // self.width
        total = np.bincount(owner, counts, minlength=len(contexts)).astype(np.int64)
        at = np.minimum(np.searchsorted(heavy[0], contexts), max(len(heavy[0]) - 1, 0))
        if len(heavy[0]):
            total = np.where(heavy[0][at] == contexts, heavy[1][at], total)
        self.kinds = np.bincount(owner, minlength=len(contexts))
        codes, book = quantise(np.log10((counts - discount) / total[owner]))
        weights, weight_book = quantise(np.log10(discount * self.kinds / total))
        arrays = {"codes": codes, "book": book, "weights": weights, "weight_book": weight_book, "totals": total}
        sequences = {"contexts": contexts, "words": words, "pointers": np.concatenate([[0], np.cumsum(self.kinds)]), "successors": pairs}
        for name, values in sequences.items():
            ef = EliasFano.build(values)
            arrays |= {f"{name}.{f}": getattr(ef, f) for f in EliasFano.FIELDS}
        self.data = mapped(arrays)
        self.levels = {name: EliasFano(*(self.data[f"{name}.{f}"] for f in EliasFano.FIELDS)) for name in sequences}
        self.contexts = contexts

    def ask(self, v: np.ndarray, owner: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts v: their counts and codes of their back-off weights; of pairs (v[owner], w): codes of log10 of the probability; 0 where unknown."""
        d = self.data
        c = self.levels["contexts"].find(v)
        known = c >= 0
        count, weight = np.zeros(len(v), np.int64), np.zeros(len(v), np.uint8)
        count[known], weight[known] = d["totals"][c[known]], d["weights"][c[known]]
        rank = self.levels["words"].find(w)
        both = np.flatnonzero(known[owner] & (rank >= 0))
        mine = c[owner[both]]
        at = self.levels["successors"].find(mine * self.width + rank[both])
        # within the context's own range, as its pointers bound it
        low, high = self.levels["pointers"].access(mine), self.levels["pointers"].access(mine + 1)
        hit = (at >= low) & (at < high)
        codes = np.zeros(len(w), np.uint8)
        codes[both[hit]] = d["codes"][at[hit]]
        return count, weight, codes


def summed(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sum of each one's ``n``."""
    order = np.argsort(x)
    x, n = x[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    return x[starts], np.add.reduceat(n, starts) if len(x) else n


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each value among them."""
    s = np.sort(x)
    distinct = s[np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]]
    return distinct, np.searchsorted(distinct, x)


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    return x.dtype.str, x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _values(x: tuple[str, bytes]) -> np.ndarray:
    kind = np.dtype(x[0])
    return np.frombuffer(x[1], np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _pack(*x: object) -> bytes:
    """Arrays go as byte planes, of the least width that holds them; ascending hashes should come as differences."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([_planes(i) if isinstance(i, np.ndarray) else i for i in x], protocol=5))


def _unpack(b: bytes) -> list:
    return [_values(i) if isinstance(i, tuple) else i for i in pickle.loads(zstandard.ZstdDecompressor().decompress(b))]


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def share_of(v: np.ndarray, w: np.ndarray, shares: int, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The share of each pair: that of its context, or of one of so many parts of a heavy context (ascending, parts) by successor."""
    part = np.zeros(len(v), np.uint64)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], v), len(heavy[0]) - 1)
        split = np.where(heavy[0][at] == v, heavy[1][at], 1)
        part = w.astype(np.uint64) % split.astype(np.uint64)
    mixed = (v.astype(np.uint64) + part * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of about ``BATCH_CHARS`` of (doc_id, held, text): number, ids, held, tokens of each text, its words' hashes (ascending), and each token's place there.

    Every text's tokens are its words and the mark.
    """
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list[int | None] = []
    held: list[bool] = []
    lengths: list[int] = []
    code: dict[bytes | None, int] = {None: 0}  # words by first occurrence; None: the mark
    tokens: list[np.ndarray] = []
    size = 0

    def flush() -> tuple:
        hashes = np.fromiter((MARK if x is None else xxhash.xxh64_intdigest(x) >> 1 for x in code), np.int64, len(code))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return number, ids, np.array(held, bool), np.array(lengths), hashes[order], place[np.concatenate(tokens)]

    for batch, texts in slices(batches, limit=2_000_000):
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            words = words_of(t)
            for x in words:
                if x not in code:
                    code[x] = len(code)
            tokens.append(np.fromiter((*map(code.__getitem__, words), 0), np.int32, len(words) + 1))
            ids.append(i)
            held.append(h)
            lengths.append(len(words) + 1)
            size += len(t) + 8
            if size >= BATCH_CHARS:
                yield flush()
                number += 1
                ids, held, lengths, code, tokens, size = [], [], [], {None: 0}, [], 0
    if ids:
        yield flush()


def pairs_of(lengths: np.ndarray, tokens: np.ndarray, width: int, mark: int) -> np.ndarray:
    """Each token's pair with the one before it (the mark, before the first), as context * width + successor."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = mark
    return before * width + tokens


def by_share(keys: np.ndarray, hashes: np.ndarray, shares: int, heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct pairs in the order they are sent in: their order, contexts, and share."""
    v, w = np.divmod(keys, len(hashes))
    share = share_of(hashes[v], hashes[w], shares, heavy)
    order = np.argsort(share, kind="stable")
    return order, v[order], share[order]


def cuts_of(share: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1], [True]])).tolist() if len(share) else []
    return list(zip(at, at[1:], strict=False))


def word_counts(base: DataFrame, shares: int, most: int) -> tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Training tokens, distinct training words, and the heavy contexts: ascending hashes, parts, and training counts.

    A word is heavy if more than ``most`` of all tokens are it; so at most (all tokens / ``most``) words come to the driver.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held, lengths, hashes, tokens in token_batches(batches):
            n = np.bincount(tokens, minlength=len(hashes))
            train = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(hashes))
            share = share_of(hashes, hashes, shares, NO_HEAVY)
            order = np.argsort(share, kind="stable")
            rows = [(int(share[order[a]]), _pack(np.diff(hashes[own], prepend=0), _small(n[own]), _small(train[own]))) for a, b in cuts_of(share[order]) for own in [order[a:b]]]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["share", "body"])

    def add(table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()) for b in table.column("body")]
        hashes = np.concatenate([np.cumsum(p[0]) for p in parts])
        words, n = summed(hashes, np.concatenate([p[1].astype(np.int64) for p in parts]))
        _, train = summed(hashes, np.concatenate([p[2].astype(np.int64) for p in parts]))
        many = n > most
        # the share's sums come first, as word -1
        rows = np.append(-1, words[many]), np.append(0, n[many]), np.append(train.sum(), train[many]), np.append((train > 0).sum(), np.zeros(many.sum(), np.int64))
        return pa.table(dict(zip(("word", "n", "train", "kinds"), map(pa.array, rows), strict=True)))

    found = base.mapInArrow(send, "share int, body binary").groupBy("share").applyInArrow(add, "word long, n long, train long, kinds long")
    rows = found.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "train", "kinds"))).orderBy("word").collect()
    total = rows[0] if rows else None
    heavy = [r for r in rows if r["word"] >= 0]
    arrays = (np.array([r["word"] for r in heavy], np.int64), np.array([-(-2 * r["n"] // most) for r in heavy], np.int64), np.array([r["train"] for r in heavy], np.int64))
    return (total["train"], total["kinds"], arrays) if total else (0, 0, arrays)


NO_HEAVY = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row's whole text.

    Rows whose crc32 of doc_id leaves ``remainder`` are held out of training.  A null text is the empty one: its only token is its
    end.  A very long text is a batch of its own.  Null ids stay null (their fold is the empty text's); repeated rows train and are
    scored each; ties don't matter; an empty table gives no rows; other columns are left aside.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = max(1, math.ceil(chars / SHARE_CHARS))
    n_train, n_words, (heavy_words, heavy_parts, heavy_train) = word_counts(base, shares, max(1, SHARE_CHARS // 24))
    parts, trained = (heavy_words, heavy_parts), (heavy_words, heavy_train)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, held, lengths, hashes, tokens in token_batches(batches):
            train = np.repeat(~held, lengths)
            key = np.sort(pairs_of(lengths, tokens, len(hashes), int(np.searchsorted(hashes, MARK))) * 2 + train)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
            n = np.add.reduceat(key & 1, starts)
            key = key[starts] >> 1
            order, v, share = by_share(key, hashes, shares, parts)
            w, n = key[order] % len(hashes), n[order]
            out = [(number % shares, number, -1, _pack(ids, held, _small(lengths), np.diff(hashes, prepend=0), _small(tokens)))]
            for a, b in cuts_of(share):
                own = np.flatnonzero(np.concatenate([[True], v[a + 1 : b] != v[a : b - 1]]))
                successors, which = numbered(w[a:b])
                body = _pack(np.diff(hashes[v[a:b][own]], prepend=0), _small(np.diff(np.append(own, b - a))), np.diff(hashes[successors], prepend=0), _small(which), _small(n[a:b]))
                out.append((int(share[a]), number, int(share[a]), body))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["share", "batch", "at", "body"])

    def answer(table: pa.Table) -> pa.Table:
        """One share: builds its trie from the batches' training pairs and asks it for every batch's."""
        out: list[tuple[int, int, bytes | None, int, int]] = []
        asked = []
        for batch, at, body in zip(*(table.column(c).to_pylist() for c in ("batch", "at", "body")), strict=True):
            if at < 0:
                out.append((batch, at, body, 0, 0))
                continue
            contexts, many, successors, which, n = _unpack(body)
            asked.append((batch, at, np.cumsum(contexts), many.astype(np.int64), np.cumsum(successors)[which], n.astype(np.int64)))
        if asked:
            v = np.concatenate([np.repeat(c, m) for _, _, c, m, _, _ in asked])
            w, n = np.concatenate([x[4] for x in asked]), np.concatenate([x[5] for x in asked])
            known = n > 0
            trie = Trie(v[known], w[known], n[known], trained)
            del v, w, n
            for batch, at, contexts, many, successors, _ in asked:
                count, weight, codes = trie.ask(contexts, np.repeat(np.arange(len(contexts)), many), successors)
                books = []
                for book, used in ((trie.data["weight_book"], weight), (trie.data["book"], codes)):
                    flags = np.bincount(used, minlength=len(book)) > 0
                    books += [np.flatnonzero(flags).astype(np.uint8), book[flags]]
                out.append((batch, at, _pack(_small(count), weight, codes, *books), 0, 0))
            for x in np.flatnonzero(np.isin(trie.contexts, heavy_words)).tolist():
                out.append((-1, -1, None, int(trie.contexts[x]), int(trie.kinds[x])))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(("batch", "at", "body", "word", "kinds"), kinds, strict=True))})

    sent = base.mapInArrow(ask, "share int, batch long, at int, body binary")
    answered = materialize(sent.groupBy("share").applyInArrow(answer, "batch long, at int, body binary, word long, kinds long"), "lm-answers")
    # one row for each part of a heavy context, summed up before it comes to the driver
    kinds = {r["word"]: r["kinds"] for r in answered.where("batch < 0").groupBy("word").agg(F.sum("kinds").alias("kinds")).collect()}
    with np.errstate(divide="ignore"):
        heavy_weight = np.log10(DISCOUNT * np.array([kinds.get(x, 0) for x in heavy_words.tolist()], float) / np.maximum(heavy_train, 1))
    divisor = math.log10(n_train + n_words + 1)

    def finish(table: pa.Table) -> pa.Table:
        """One batch: every pair's and word's answers, summed up by text."""
        rows = sorted(zip(table.column("at").to_pylist(), table.column("body").to_pylist(), strict=True))
        ids, held, lengths, hashes, tokens = _unpack(rows[0][1])
        lengths, hashes, tokens = lengths.astype(np.int64), np.cumsum(hashes), tokens.astype(np.int64)
        mark = int(np.searchsorted(hashes, MARK))
        keys, which = numbered(pairs_of(lengths, tokens, len(hashes), mark))
        order, v, share = by_share(keys, hashes, shares, parts)
        count, weight, log = np.zeros(len(hashes), np.int64), np.zeros(len(hashes)), np.zeros(len(keys))
        seen = np.zeros(len(keys), bool)
        for (a, b), (_, body) in zip(cuts_of(share), rows[1:], strict=True):
            found, backing, codes, used, weights, used_codes, values = _unpack(body)
            contexts = v[a:b][np.concatenate([[True], v[a + 1 : b] != v[a : b - 1]])]
            book = np.zeros(256)
            book[used] = weights
            count[contexts], weight[contexts] = found, book[backing]
            book = np.zeros(256)
            book[used_codes] = values
            log[order[a:b]], seen[order[a:b]] = book[codes], codes > 0
        at = np.searchsorted(hashes, heavy_words)
        own = np.flatnonzero(at < len(hashes))
        own = own[hashes[at[own]] == heavy_words[own]]
        count[at[own]], weight[at[own]] = heavy_train[own], np.where(heavy_train[own] > 0, heavy_weight[own], 0.0)
        first, second = np.divmod(keys, len(hashes))
        unigram = np.log10(count + 1.0) - divisor
        log = np.where(seen, log, unigram[second] + np.where(count[first] > 0, weight[first], 0.0))
        doc = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, doc)
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64()), "held_out": held.astype(bool), "n_tokens": lengths, "n_known": add((count[tokens] > 0).astype(np.int64)),
             "train_tokens": pa.array([n_train] * len(ids), pa.int64()), "base_score": add(unigram[tokens]), "score": add(log[which])}
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.where("batch >= 0").select("batch", "at", "body").groupBy("batch").applyInArrow(finish, out)
