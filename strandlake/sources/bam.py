"""BAM files as a Python data source: ``spark.read.format("bam").option("path", path).load()``.

Primary records only, in their original orientation: name, flag, seq, qual, and the modification tags mm (text) and ml (array).
A file is one partition: records cross the container's blocks, so a block range alone can't be cut; write Parquet once.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: base codes, and the sizes of typed tags.
BASES = "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
REVERSE, SECONDARY, SUPPLEMENTARY = 0x10, 0x100, 0x800
_COMPLEMENT = str.maketrans("ACGTMRYKVHDB", "TGCAKYRMBDHV")


def inflate(f) -> Iterator[bytes]:
    """Blocks of a blocked gzip file."""
    while True:
        unpacker = zlib.decompressobj(31)
        head = f.read(18)
        if not head:
            return
        if head[:4] != b"\x1f\x8b\x08\x04" or len(head) < 18:
            raise ValueError("no blocked gzip file")
        extra, size = struct.unpack_from("<H", head, 10)[0], None
        fields = head[12:] + f.read(max(0, extra - 6))
        at = 0
        while at + 4 <= extra:
            n = struct.unpack_from("<H", fields, at + 2)[0]
            if fields[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", fields, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("a block without its size")
        body = head + fields[6:] + f.read(size - 12 - extra)
        yield unpacker.decompress(body)


def tags(raw: bytes) -> dict[str, object]:
    """Text tags, and arrays of bytes, by name; other values are passed over."""
    out: dict[str, object] = {}
    at = 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            part, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            if part in "cC":
                out[name] = list(raw[at + 5 : at + 5 + n])
            at += 5 + n * SIZES[part]
        else:
            at += SIZES[kind]
    return out


def records(path: str) -> Iterator[tuple]:
    """(name, flag, seq, qual, mm, ml) of primary records."""
    with open(path, "rb") as f:
        blocks, held = inflate(f), b""

        def take(n: int) -> bytes:
            nonlocal held
            parts, have = [held], len(held)
            while have < n:
                block = next(blocks, None)
                if block is None:
                    break
                parts.append(block)
                have += len(block)
            whole = b"".join(parts)
            held = whole[n:]
            return whole[:n]

        if take(4) != b"BAM\x01":
            raise ValueError(f"{path} is no BAM file")
        take(struct.unpack("<i", take(4))[0])
        for _ in range(struct.unpack("<i", take(4))[0]):
            take(struct.unpack("<i", take(4))[0] + 4)
        while len(head := take(4)) == 4:
            raw = take(struct.unpack("<i", head)[0])
            n_name, n_cigar, flag, n_seq = raw[8], *struct.unpack_from("<HHi", raw, 12)
            if flag & (SECONDARY | SUPPLEMENTARY):
                continue
            at = 32 + n_name + 4 * n_cigar
            packed = raw[at : at + (n_seq + 1) // 2]
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
            at += len(packed)
            quality = raw[at : at + n_seq]
            qual = None if not quality or quality[0] == 255 else "".join(chr(q + 33) for q in quality)
            if flag & REVERSE:
                seq, qual = seq[::-1].translate(_COMPLEMENT), qual[::-1] if qual else qual
            t = tags(raw[at + n_seq :])
            yield raw[32 : 32 + n_name - 1].decode(), flag, seq, qual, t.get("MM") or t.get("Mm"), t.get("ML") or t.get("Ml")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in sorted(glob.glob(os.path.join(self.path, "*.bam")) if os.path.isdir(self.path) else glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from records(partition.value)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "name string, flag int, seq string, qual string, mm string, ml array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(BamDataSource)
