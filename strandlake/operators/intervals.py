"""Intervals: union, depth by sweep, islands, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): half-open intervals merged where they touch or overlap."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(end) > F.col(start)).withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def depth(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, depth): maximal stretches of equal depth above zero; events at one place are summed before the sweep."""
    ends = df.where(F.col(end) > F.col(start)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*keys).orderBy("at")
    out = steps.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return out.where("depth > 0")


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, start, end, n): runs of consecutive values."""
    w = Window.partitionBy(*keys).orderBy(at)
    g = df.select(*keys, at).distinct().withColumn("__g", F.col(at) - F.row_number().over(w))
    return g.groupBy(*keys, "__g").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__g")


def chains(df: DataFrame, keys: list[str], diagonal: str, tolerance: float) -> DataFrame:
    """(keys, chain, low, high, n): sorted diagonals, broken where neighbours differ by more than ``tolerance``."""
    w = Window.partitionBy(*keys).orderBy(diagonal)
    new = F.when(F.col(diagonal) - F.lag(diagonal).over(w) > tolerance, 1).otherwise(0)
    c = df.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*keys, "chain").agg(F.min(diagonal).alias("low"), F.max(diagonal).alias("high"), F.count("*").alias("n"))
