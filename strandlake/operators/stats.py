"""Order statistics with the exact ranks that the queries need: no interpolation anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, m, upto, total): counts by value, cumulative in its order; groups are pre-aggregated, so a window holds distinct values only."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return c.select("*", F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("m").over(w).alias("total"))


def at_rank(q: float):
    """Index round((n - 1) q) of n = total sorted values, as a column; halves round up."""
    return F.floor((F.col("total") - 1) * F.lit(q) + 0.5)


def nearest_rank(df: DataFrame, value: str, q: float, keys: list[str], name: str) -> DataFrame:
    """The value at index round((n - 1) q) of each group's sorted values."""
    return value_counts(df, value, keys).where(F.col("upto") > at_rank(q)).groupBy(*keys).agg(F.min(value).alias(name))


def upper_median(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """The value at index n // 2."""
    return value_counts(df, value, keys).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias(name))


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str], name: str, strict: bool = False) -> DataFrame:
    """The least value up to which the weights come to half of all (more than half if ``strict``)."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("m"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    c = c.select("*", F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("m").over(w).alias("total"))
    half = F.col("upto") * 2 > F.col("total") if strict else F.col("upto") * 2 >= F.col("total")
    return c.where(half).groupBy(*keys).agg(F.min(value).alias(name))


def n50(df: DataFrame, length: str, keys: list[str]) -> DataFrame:
    """(keys, pieces, total, longest, n50)."""
    c = df.groupBy(*keys, length).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bases = F.col("m") * F.col(length)
    c = c.select("*", F.sum(bases).over(w.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(bases).over(w).alias("total"))
    ok = F.col("upto") * 2 >= F.col("total")
    return c.groupBy(*keys).agg(F.sum("m").alias("pieces"), F.max("total").alias("total"), F.max(length).alias("longest"), F.max(F.when(ok, F.col(length))).alias("n50"))


def auc(df: DataFrame, value: str, positive: str, keys: list[str]) -> DataFrame:
    """(keys, auc): by mid-ranks, over counts of each value; null where a class is missing."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    c = c.withColumn("below", F.coalesce(F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    won = F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0)))
    pairs = F.sum("p").cast("double") * F.sum("n")
    return c.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def octave_peaks(bins: DataFrame, least: int) -> DataFrame:
    """Peaks of (bin, n): occupied bins whose three-bin sum is at least ``least``, no less than the lower neighbour's and more than the upper one's.

    Equal sums are told apart by the bins' own counts; an empty neighbour has a sum too.
    """
    w = Window.orderBy("bin")
    over = lambda low, high: F.coalesce(F.sum("n").over(w.rangeBetween(low, high)), F.lit(0))
    key = lambda at: F.struct(over(at - 1, at + 1).alias("s"), over(at, at).alias("n"))
    t = bins.select("bin", "n", key(0).alias("own"), key(-1).alias("lo"), key(1).alias("hi"))
    return t.where((F.col("own.s") >= least) & (F.col("own") >= F.col("lo")) & (F.col("own") > F.col("hi"))).select("bin", "n", F.col("own.s").alias("s"))


def merged_peaks(peaks: DataFrame, width: float = 0.25) -> DataFrame:
    """(centre) of peaks (bin), in log2 units: from the lowest on, one less than an octave above the last is drawn together with it to their mean."""
    centres = peaks.agg(F.sort_array(F.collect_list((F.col("bin") + 0.5) * F.lit(width))).alias("c"))  # one for each bin at most
    none = F.array().cast("array<double>")

    def step(held, x):
        last = F.element_at(held, -1)
        near = (F.size(held) > 0) & (x - last < 1.0)
        return F.when(near, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array((last + x) / 2))).otherwise(F.concat(held, F.array(x)))

    return centres.select(F.explode(F.aggregate("c", none, step)).alias("centre"))


def poisson_cdf(n, rate):
    """P(X <= n) by a fold over the terms, as a column."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * rate / i).alias("term"), (a["sum"] + a["term"] * rate / i).alias("sum"))
    terms = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, start, step, lambda a: F.least(a["sum"], F.lit(1.0)))
