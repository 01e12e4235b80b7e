"""Exact byte-pair merging: one kernel for many short words at once, one with a heap for any length."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Sequence

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.int64(-1)


class IntTable:
    """Open addressing from non-negative 63-bit keys to 63-bit values; looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - (len(keys).bit_length() - 1))

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> IntTable:
        bits = max(4, int(len(keys) * 3).bit_length())
        table = cls(np.full(1 << bits, _EMPTY, np.int64), np.zeros(1 << bits, np.int64))
        left, at = np.arange(len(keys)), table._home(keys)
        while len(left):
            free = table.keys[at] == _EMPTY
            slot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            table.keys[slot], table.values[slot] = keys[won], values[won]
            stay = ~np.isin(left, won)
            left, at = left[stay], (at[stay] + 1) & (len(table.keys) - 1)
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], default)
        todo = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != _EMPTY)]
        return out


def heap_merge(symbols: Sequence, rank: Callable[[object, object], tuple[int, object] | None]) -> tuple[list, int]:
    """Repeatedly merges the lowest-ranked adjacent pair, leftmost first: a heap of candidates over a doubly linked list.

    ``rank(a, b)`` gives (rank, merged symbol) or None.  Returns the symbols that are left and the number of merges.
    """
    sym = list(symbols)
    n = len(sym)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple] = []
    for i in range(n - 1):
        if (r := rank(sym[i], sym[i + 1])) is not None:
            heap.append((r[0], i, sym[i], sym[i + 1], r[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = nxt[i]
        if j >= n or sym[i] != a or sym[j] != b:
            continue  # one of the two has been merged meanwhile
        merges += 1
        sym[i], sym[j] = new, None
        nxt[i] = k = nxt[j]
        if k < n:
            prev[k] = i
            if (r := rank(new, sym[k])) is not None:
                heapq.heappush(heap, (r[0], i, new, sym[k], r[1]))
        if (h := prev[i]) >= 0 and (r := rank(sym[h], new)) is not None:
            heapq.heappush(heap, (r[0], h, sym[h], new, r[1]))
    return [s for s in sym if s is not None], merges


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … (size of them) of each, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class ByteMerger:
    """Encodes pre-tokens (bytes) with a byte-level BPE vocabulary file of the tokenizers library."""

    LONGEST = 40  # bytes of a word in the array kernel; longer words go through the heap
    NONE = 1 << 40

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, ranks = (left << 20) | right, np.arange(len(pairs))
        self.table = IntTable.build(keys, (ranks << 20) | new)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab, self._pairs = vocab, None
        self._raw = (keys, ranks, new)

    def pair(self, a: int, b: int) -> tuple[int, int] | None:
        if self._pairs is None:
            self._pairs = {int(k): (int(r), int(n)) for k, r, n in zip(*self._raw, strict=True)}
        return self._pairs.get((a << 20) | b)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; special tokens as their text."""
        back = {c: b for b, c in enumerate(byte_chars())}
        out = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in self.vocab.items():
            out[i] = bytes(back[c] for c in s.removesuffix(self.suffix)) if self.suffix else bytes(back[c] for c in s)
        for s, i in self.special.items():
            out[i] = s.encode()
        return out

    def merge(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """ids of each distinct word, as little-endian unsigned 32-bit integers one after another."""
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        out: dict[bytes, bytes] = {}
        for n, group in by.items():
            if n == 0:
                out[b""] = b""
            elif n > self.LONGEST:
                for w in group:
                    sym = [*self.first[list(w[:-1])].tolist(), int(self.last[w[-1]])]
                    out[w] = np.array(heap_merge(sym, self.pair)[0], "<u4").tobytes()
            else:
                for at in range(0, len(group), 20_000):
                    part = group[at : at + 20_000]
                    ids, counts = self._merge_equal(part, n)
                    flat = ids[np.arange(n + 1) < counts[:, None]].astype("<u4").tobytes()
                    ends = (np.cumsum(counts) * 4).tolist()
                    out |= zip(part, map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=True)
        return out

    def merge_in_order(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, one after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(words), np.int64)
        parts = [np.zeros(0, np.uint32)]
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1)) if len(words) else np.zeros(1, np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            n = int(lengths[order[a]])
            for at in range(a, b if n else a, 20_000):
                own = order[at : min(at + 20_000, b)]
                part = [words[i] for i in own.tolist()]
                if n > self.LONGEST:
                    merged = [heap_merge([*self.first[list(w[:-1])].tolist(), int(self.last[w[-1]])], self.pair)[0] for w in part]
                    counts[own] = [len(m) for m in merged]
                    parts.append(np.concatenate(merged).astype(np.uint32))
                else:
                    ids, counts[own] = self._merge_equal(part, n)
                    parts.append(ids[np.arange(n + 1) < counts[own][:, None]].astype(np.uint32))
        flat = np.concatenate(parts)
        sizes = counts[order]
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes) - sizes
        return flat[spread(begin, counts)], counts

    def _merge_equal(self, group: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length as rows of a matrix: each round merges the lowest pair of every row that still has one."""
        raw = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), n)
        sym = np.empty((len(group), n + 1), np.int64)
        sym[:, :n] = self.first[raw]
        sym[:, n - 1] = self.last[raw[:, n - 1]]
        sym[:, n] = 0
        done = np.zeros((len(group), n + 1), np.int64)
        size, rows = np.full(len(group), n), np.arange(len(group))
        sizes = size.copy()
        if n == 1:
            return sym, sizes
        found = self.table.get(((sym[:, : n - 1] << 20) | sym[:, 1:n]).ravel(), self.NONE << 20).reshape(-1, n - 1)
        val = np.full((len(group), n), self.NONE << 20, np.int64)
        val[:, : n - 1] = found
        cols = np.arange(n)
        while len(rows):
            k = val.argmin(1)
            r = np.arange(len(rows))
            best = val[r, k]
            live = best < (self.NONE << 20)
            if not live.all():
                end = ~live
                done[rows[end]], sizes[rows[end]] = sym[end], size[end]
                sym, val, size, rows, k, best = sym[live], val[live], size[live], rows[live], k[live], best[live]
                r = np.arange(len(rows))
                if not len(rows):
                    break
            sym[r, k] = best & 0xFFFFF
            after = cols >= k[:, None]
            shifted = np.empty_like(val)
            shifted[:, :-1], shifted[:, -1] = val[:, 1:], self.NONE << 20
            val = np.where(after, shifted, val)
            moved = np.empty_like(sym)
            moved[:, :-1], moved[:, -1] = sym[:, 1:], 0
            sym = np.where(np.arange(n + 1) > k[:, None], moved, sym)
            size = size - 1
            right = k < size - 1
            val[r[~right], k[~right]] = self.NONE << 20
            a, c = r[right], k[right]
            val[a, c] = self.table.get((sym[a, c] << 20) | sym[a, c + 1], self.NONE << 20)
            left = k > 0
            a, c = r[left], k[left]
            val[a, c - 1] = self.table.get((sym[a, c - 1] << 20) | sym[a, c], self.NONE << 20)
        return done, sizes
