"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions of the SQL side.
READS = """reads AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g'),
  'abcdefghijklmnopqrstuvwxyz0123456789', 'ACGTACGTACGTACGTACGTACGTACNNNNNNNNNN') AS seq FROM documents)"""
PASSAGES = """passages AS (SELECT item_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g'),
  'abcdefghijklmnopqrstuvwxyz0123456789', 'ACGTACGTACGTACGTACGTACGTACNNNNNNNNNN') AS seq FROM benchmark)"""


def words_sql(name: str, source: str, key: str, k: int, canonical: bool = True) -> str:
    """A table expression of every word of ``source`` (key, seq): key, pos, w."""
    w = "least(x, reverse(translate(x, 'ACGT', 'TGCA')))" if canonical else "x"
    return f"""{name} AS (SELECT {key}, pos, {w} AS w, x FROM (SELECT {key}, pos, substr(seq, pos, {k}) AS x FROM (
  SELECT {key}, seq, unnest(range(1, length(seq) - {k} + 2)) AS pos FROM {source} WHERE length(seq) >= {k})) WHERE x NOT LIKE '%N%')"""


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where SQL can say it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


class Tables:
    """Readers of the supplied tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
