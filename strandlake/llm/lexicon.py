"""Byte-level BPE through a minimal acyclic transducer of frequent words, with exact merging of all other words.

The corpus' frequent words (a native frequent-items sketch over all texts) are encoded once on the driver and compiled, in
sorted order, into a minimal automaton that shares prefixes and suffixes.  Every transition carries how many words sort
before those behind it, so a walk sums up to the word's number, which points into one pool of ids: the transducer's
output.  Its arrays are packed into one file that each worker maps into memory.  Which words are in the lexicon changes
only the speed: a word that isn't found is merged exactly.
"""

from __future__ import annotations

import hashlib
import io
import json
import mmap
import re
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteMerger, IntTable
from .common import Memo, map_texts

#: The byte-level pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space that isn't a lone space or line end between words: such texts are cut by the pattern as a whole.
_UNUSUAL = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]| [ \n]|\n ")


class Lexicon:
    """A minimal acyclic automaton over bytes whose words carry id sequences."""

    PARTS = ("keys", "values", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.table = IntTable(arrays["keys"], arrays["values"])
        self.final, self.offsets, self.ids = arrays["final"], arrays["offsets"], arrays["ids"]

    @classmethod
    def compile(cls, entries: dict[bytes, bytes]) -> Lexicon:
        """From words to their ids (little-endian uint32).  States are frozen from the end of a word as soon as no later word can reach them."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple, int]] = []  # (accepting, ((byte, target), ...), words below)

        def freeze(node: list) -> int:
            signature = (node[0], tuple(node[1]))
            at = register.get(signature)
            if at is None:
                at = register[signature] = len(states)
                states.append((node[0], signature[1], node[0] + sum(states[t][2] for _, t in node[1])))
            return at

        path: list[list] = [[False, []]]  # the unfrozen nodes of the last word
        last = b""
        for w in words:
            n = 0
            while n < min(len(w), len(last)) and w[n] == last[n]:
                n += 1
            while len(path) > n + 1:
                child = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], child))
            path.extend([False, []] for _ in range(len(w) - n))
            path[-1][0] = True
            last = w
        while len(path) > 1:
            child = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        root = freeze(path[0])
        # the root becomes state 0
        number = {root: 0} | {s: i + (i < root) for i, s in enumerate(range(len(states))) if s != root}
        keys, values = [], []
        final = np.zeros(len(states), np.uint8)
        for s, (accept, out, _) in enumerate(states):
            final[number[s]] = accept
            before = int(accept)
            for byte, target in out:
                keys.append(number[s] << 8 | byte)
                values.append(before << 31 | number[target])
                before += states[target][2]
        table = IntTable.build(np.array(keys, np.int64), np.array(values, np.int64))
        ids = [np.frombuffer(entries[w], "<u4") for w in words]
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int64)
        pool = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return cls({"keys": table.keys, "values": table.values, "final": final, "offsets": offsets, "ids": pool.astype("<u4")})

    @property
    def n_states(self) -> int:
        return len(self.final)

    def to_bytes(self) -> bytes:
        arrays = dict(zip(self.PARTS, (self.table.keys, self.table.values, self.final, self.offsets, self.ids), strict=True))
        head, body, at = [], io.BytesIO(), 0
        for k, a in arrays.items():
            head.append([k, a.dtype.str, len(a), at])
            body.write(a.tobytes())
            at += a.nbytes
            at += body.write(b"\0" * (-at % 8))
        top = json.dumps(head).encode()
        top += b" " * (-(len(top) + 8) % 8)
        return len(top).to_bytes(8, "little") + top + body.getvalue()

    @classmethod
    def map(cls, blob: bytes) -> Lexicon:
        """Writes the arrays to a file of this process' own, maps it, and unlinks the name."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(held[:8], "little")
        return cls({k: np.frombuffer(held, kind, size, 8 + n + at) for k, kind, size, at in json.loads(held[8 : 8 + n])})

    def look_up(self, words: Iterable[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
        """ids of the words that the lexicon has, and the words that it doesn't have.  Words of one length walk together."""
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        found, missing = {}, []
        for n, group in by.items():
            if not n:
                missing += group
                continue
            raw = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), n)
            at, number, alive = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.arange(len(group))
            for i in range(n):
                step = self.table.get(at << 8 | raw[alive, i])
                ok = step >= 0
                alive, step = alive[ok], step[ok]
                at, number = step & 0x7FFFFFFF, number[ok] + (step >> 31)
                if not len(alive):
                    break
            ok = self.final[at].astype(bool) if len(alive) else np.zeros(0, bool)
            alive, number = alive[ok], number[ok]
            for i, a, b in zip(alive.tolist(), self.offsets[number].tolist(), self.offsets[number + 1].tolist(), strict=True):
                found[group[i]] = self.ids[a:b].tobytes()
            if len(alive) < len(group):
                gone = np.ones(len(group), bool)
                gone[alive] = False
                missing += [group[i] for i in np.flatnonzero(gone).tolist()]
        return found, missing


class LexiconCodec:
    """Encodes and decodes texts as the vocabulary file's tokenizer does, without special tokens added."""

    MEMO = 200_000

    def __init__(self, path: str, lexicon: Lexicon) -> None:
        self.merger, self.lexicon = ByteMerger(path), lexicon
        special = self.merger.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bytes_of = self.merger.token_bytes()
        self.memo = Memo(self.MEMO)  # of pre-tokens
        self.chunks = Memo(self.MEMO)  # of what stands between single spaces, with the space before it

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, missing = self.lexicon.look_up(words)
        return found | self.merger.merge(missing)

    def _cut(self, texts: list[str]) -> dict[str, bytes]:
        """ids of each text, cut by the pattern."""
        cut = {t: [t] if t[1:].isalpha() and t[0] == " " else PATTERN.findall(t) for t in texts}
        memo = self.memo.holding_all([w for ws in cut.values() for w in ws], lambda ws: {b.decode(): i for b, i in self._words([w.encode() for w in ws]).items()})
        return {t: memo[ws[0]] if len(ws) == 1 else b"".join(map(memo.__getitem__, ws)) for t, ws in cut.items()}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text.

        Special tokens are cut out first.  Where single spaces stand between other characters, each goes with what follows
        it; so such a text can be cut there, and pieces be remembered.  What all texts lack is encoded at once.
        """
        plans: list[list] = []
        chunks: set[str] = set()
        whole: set[str] = set()
        for text in texts:
            plans.append(plan := [])
            for t in self.special.split(text) if self.special is not None and self.special.search(text) else [text]:
                if t in self.merger.special:
                    plan.append(np.array(self.merger.special[t], "<u4").tobytes())
                elif t and (t[-1] == " " or _UNUSUAL.search(t)):
                    plan.append((t, []))
                    whole.add(t)
                elif t:
                    first, *rest = t.split(" ")
                    plan.append((first, rest))
                    whole.add(first)
                    chunks.update(rest)
        memo = self.chunks.holding_all(chunks, lambda ws: {t[1:]: i for t, i in self._cut([" " + w for w in ws]).items()})
        cut = self._cut([t for t in whole if t]) | {"": b""}
        join = lambda x: x if isinstance(x, bytes) else cut[x[0]] + b"".join(map(memo.__getitem__, x[1]))
        return [np.frombuffer(b"".join(map(join, plan)), "<u4") for plan in plans]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, size: int = 50_000, tracked: int = 150_000) -> list[str]:
    """About the ``size`` most frequent words that stand between spaces, from a frequent-items sketch of fixed size over all rows."""
    words = docs.select(F.explode(F.split(F.col("text"), " ")).alias("w")).where(F.col("w").rlike(r"^\p{L}{1,40}$"))
    row = words.agg(F.expr(f"approx_top_k(w, {size}, {tracked})").alias("top")).first()
    return sorted(r["item"] for r in row["top"] or [])


def build_lexicon(docs: DataFrame, path: str, size: int = 50_000) -> Lexicon:
    words = [(" " + w).encode() for w in frequent_words(docs, size)]
    return Lexicon.compile(ByteMerger(path).merge(words))


def encode_decode(docs: DataFrame, path: str, lexicon: Lexicon, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text; with ``texts`` also ids and decoded.

    A null text counts as empty (no ids, empty decoded text); null ids stay null; repeated rows are encoded each; other
    columns are left aside.  One scan, no shuffle; the lexicon's size is a parameter, so it is shipped with the job.
    """
    blob = docs.sparkSession.sparkContext.broadcast(lexicon.to_bytes())
    names = [str(i) for i in range(1 << 16)]

    def kernel():
        codec = LexiconCodec(path, Lexicon.map(blob.value))
        label = names if len(codec.bytes_of) <= len(names) else [str(i) for i in range(len(codec.bytes_of))]
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def f(batch: pa.RecordBatch, part: list[str]) -> pa.RecordBatch:
            n, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
            for got in codec.encode_batch(part):
                ids = got.tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(label.__getitem__, ids)).encode()))
                text_sha.append(sha((back := codec.decode(ids)).encode()))
                if texts:
                    all_ids.append(ids)
                    all_texts.append(back)
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}
            if texts:
                cols |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_texts, pa.string())}
            return pa.record_batch(list(cols.values()), list(cols))

        return f

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)
