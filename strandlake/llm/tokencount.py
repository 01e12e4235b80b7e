"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

The lowest-ranked (best scored) adjacent pair is popped from a heap over a linked list of symbols until none is left;
the count is the number of initial symbols less the merges, plus the further bytes of characters that fall back to bytes.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_texts

_SPACE = "▁"
_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class PieceCounter:
    """Counts a sentencepiece BPE model's tokens.

    White space is escaped and a dummy prefix added as the model says.  No piece of the vocabulary holds the escaped space
    after another character (checked on loading), so merges never cross such a place: a text is counted word by
    word, and words are remembered in a memo of bounded size.
    """

    MEMO = 300_000

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        spec.ParseFromString(sp.serialized_model_proto())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is, but for escaped spaces, can be counted")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback can be counted")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined symbols aren't supported")
        self.prefix = _SPACE if norm.add_dummy_prefix else ""
        ranked = sorted((-p.score, i) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL)
        order = {x: r for r, x in enumerate(sorted({score for score, _ in ranked}))}
        self.rank = {spec.pieces[i].piece: order[score] for score, i in ranked}
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.rank):
            raise ValueError("a piece reaches over a space")
        self.memo: Memo = Memo(self.MEMO)

    def segment(self, s: str) -> int:
        """Tokens of a piece of escaped text.

        A heap holds (rank, place of the left symbol) as one integer; ``now`` is the rank of the pair that starts at a place,
        so that entries of pairs that are gone are skipped.
        """
        n = len(s)
        rank, sym = self.rank.get, list(s)
        now = [rank(s[i : i + 2]) for i in range(n - 1)]
        heap = [r << 32 | i for i, r in enumerate(now) if r is not None]
        heapify(heap)
        now.append(None)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFF
            if now[i] != x >> 32:
                continue
            merges += 1
            j = nxt[i]
            new = sym[i] = sym[i] + sym[j]
            sym[j] = now[j] = None
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                r = now[i] = rank(new + sym[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            else:
                now[i] = None
            h = prev[i]
            if h >= 0:
                r = now[h] = rank(sym[h] + new)
                if r is not None:
                    heappush(heap, r << 32 | h)
        held = self.rank
        return n - merges + sum(len(c.encode()) - 1 for c in sym if c is not None and c not in held)

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = (self.prefix + text.replace(" ", _SPACE)).split(_SPACE)
        first, rest = words[0], words[1:]
        if "" in rest:  # runs of spaces, or one at the end
            rest = re.findall(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+", _SPACE.join(words))
            memo = self.memo.holding(rest, self.segment)
            return sum(map(memo.__getitem__, rest))
        # a word's key has no space before it, a run's key has one: the two never meet
        memo = self.memo.holding(rest, lambda w: self.segment(_SPACE + w))
        return (self.segment(first) if first else 0) + sum(map(memo.__getitem__, rest))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row's whole text.

    A null text counts as empty: no bytes, no tokens.  Null ids stay null; repeated rows are counted each; other columns
    are left aside.  One scan, no shuffle.
    """

    def kernel():
        counter = PieceCounter(model_path)

        def f(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            n_bytes = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            return pa.record_batch([batch.column(0), n_bytes, pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return f

    out = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, _SCHEMA)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
