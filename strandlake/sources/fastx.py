"""FASTA and FASTQ files, plain or gzip, as a Python data source: ``spark.read.format("fastx").load(path)``.

One partition a file, as gzip can't be split; write the rows to Parquet once and read that.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def records(path: str) -> Iterator[tuple[str, str, str | None]]:
    """(id, seq, qual) of each record; qual is null in FASTA."""
    with open(path, "rb") as probe:
        zipped = probe.read(2) == b"\x1f\x8b"
    with gzip.open(path, "rt") if zipped else open(path) as f:
        name, parts = None, []
        line = f.readline()
        while line:
            line = line.rstrip("\r\n")
            if line.startswith("@") and name is None:
                seq, plus, qual = f.readline().rstrip("\r\n"), f.readline(), f.readline().rstrip("\r\n")
                if not plus.startswith("+") or len(seq) != len(qual):
                    raise ValueError(f"broken record {line[1:]} in {path}")
                yield line[1:].split()[0] if line[1:].split() else "", seq, qual
            elif line.startswith(">"):
                if name is not None:
                    yield name, "".join(parts), None
                name, parts = line[1:].split()[0] if line[1:].split() else "", []
            elif name is not None:
                parts.append(line)
            elif line:
                raise ValueError(f"{path} is neither FASTA nor FASTQ")
            line = f.readline()
        if name is not None:
            yield name, "".join(parts), None


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from records(partition.value)


class FastxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "id string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(FastxDataSource)
