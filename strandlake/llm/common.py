"""Helpers shared by the training-data operators: shared storage, slicing of Arrow batches, checksums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every operator here: space and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Texts are handed to the Python kernels in slices of about so many characters, which bounds their memory.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark.conf.get("strandlake.local.dir", None)
        if not at:
            at = tempfile.mkdtemp(prefix="strandlake-")
            spark.conf.set("strandlake.local.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage is cut, and columns can be pruned on rereading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the decimal doc_id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts batches so that their texts sum to about ``limit`` characters; null texts become empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = [0]
        at = size = 0
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                ends.append(i)
                size = 0
            size += n
        ends.append(len(lengths))
        for at, to in zip(ends, ends[1:], strict=False):
            if to > at:
                part = batch.slice(at, to - at)
                yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]


def map_texts(df: DataFrame, kernel: Callable[[], Callable], schema: str) -> DataFrame:
    """Runs ``kernel()(batch, texts) -> RecordBatch`` over slices of ``df``; ``kernel`` is called once per task, so it may hold memos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for part, texts in slices(batches):
            yield f(part, texts)

    return df.mapInArrow(run, schema)


class Memo:
    """Remembers a function's values for recent keys in two generations of at most ``size`` entries and one text's keys."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def holding(self, keys: Iterable, f: Callable) -> dict:
        """A dict that has all of ``keys``."""
        return self.holding_all(keys, lambda missing: {k: f(k) for k in missing})

    def holding_all(self, keys: Iterable, f: Callable) -> dict:
        """The same; ``f`` gets all keys that are missing at once."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        missing = set(keys).difference(self.new)
        if missing and self.old:
            old = self.old
            self.new |= (known := {k: old[k] for k in missing if k in old})
            missing.difference_update(known)
        if missing:
            self.new |= f(missing)
        return self.new
