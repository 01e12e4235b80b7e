"""Six-frame translation in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kmers import _CODE

# The standard genetic code with bases in the order T, C, A, G, and what the other tables change.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {1: {}, 2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 4: {"TGA": "W"}, 5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}}


def genetic_code(table: int) -> dict[str, str]:
    """Residue of each codon; * stops."""
    if table not in CHANGES:
        raise ValueError(f"no genetic code {table}")
    return {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")} | CHANGES[table]


def _table(table: int) -> np.ndarray:
    """Residues by packed codon; X where a letter isn't a base."""
    out = np.full(125, ord("X"), np.uint8)
    for codon, residue in genetic_code(table).items():
        a, b, c = _CODE[np.frombuffer(codon.encode(), np.uint8)].tolist()
        out[a * 25 + b * 5 + c] = ord(residue)
    return out


def frames(seq: bytes, table: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(strand, frame, residues)."""
    code = _CODE[np.frombuffer(seq, np.uint8)].astype(np.int64)
    for strand, c in ((1, code), (-1, np.where(code < 4, 3 - code, 4)[::-1])):
        for frame in range(3):
            n = (len(c) - frame) // 3
            if n > 0:
                x = c[frame : frame + 3 * n].reshape(n, 3)
                yield strand, frame, table[x @ np.array([25, 5, 1])].tobytes()


def stretches(reads: DataFrame, table: int = 1, shortest: int = 80, key: str = "doc_id") -> DataFrame:
    """(key, strand, frame, start, length, residues) of stretches without a stop; start counts residues from the frame's first."""
    kind = reads.schema[key].dataType.simpleString()
    code = _table(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = [[], [], [], [], [], []]
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for strand, frame, residues in frames((seq or "").encode("ascii", "replace"), code):
                    at = 0
                    for part in residues.split(b"*"):
                        if len(part) >= shortest:
                            for column, x in zip(rows, (i, strand, frame, at, len(part), part.decode()), strict=True):
                                column.append(x)
                        at += len(part) + 1
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [key, "strand", "frame", "start", "length", "residues"])

    return reads.select(key, "seq").mapInArrow(run, f"{key} {kind}, strand int, frame int, start int, length int, residues string")
