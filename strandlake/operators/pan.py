"""Samples and sites: presence, genotypes, cohorts, relatives, modifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presence_call(relative: Column, own: Column) -> Column:
    """present, absent, or uncallable in between; without own words of the piece, none."""
    return F.when(own == 0, "none").when(relative >= 0.25, "present").when(relative < 0.02, "absent").otherwise("uncallable")


def genotypes(alleles: DataFrame, organelle: float, least: float = 0.2, minor: float = 0.1) -> DataFrame:
    """(sample, site, major, minors, call) from allele depths (sample, site, allele, depth).

    A site is called if its depths sum to at least ``least`` of the organelle's; the major allele is the deepest, the later one of
    equals; minors have at least ``minor`` of the depth.
    """
    total = F.sum("depth").over(Window.partitionBy("sample", "site"))
    a = alleles.withColumn("total", total)
    out = a.groupBy("sample", "site").agg(F.max("total").alias("total"), F.max_by("allele", F.struct("depth", "allele")).alias("major"), F.sort_array(F.collect_list(F.when(F.col("depth") >= F.col("total") * minor, F.col("allele")))).alias("kept"))
    ok = F.col("total") >= organelle * least
    minors = F.array_join(F.transform(F.array_remove("kept", F.col("major")), lambda x: x.cast("string")), ",")
    return out.select("sample", "site", F.when(ok, F.col("major")).alias("major"), F.when(ok, minors).otherwise("").alias("minors"), F.when(ok, "called").otherwise("uncallable").alias("call"))


def sample_distance(calls: DataFrame) -> DataFrame:
    """(a, b, differing, common) over sites that both samples call (sample, site, major), for a < b.

    Samples of a site are counted by allele, so a pair of samples meets once a site.
    """
    x, y = calls.alias("x"), calls.alias("y")
    j = x.join(y, (F.col("x.site") == F.col("y.site")) & (F.col("x.sample") < F.col("y.sample")))
    return j.groupBy(F.col("x.sample").alias("a"), F.col("y.sample").alias("b")).agg(F.count_if(F.col("x.major") != F.col("y.major")).alias("differing"), F.count("*").alias("common"))


def threshold_policy(base: Column, regime: Column) -> Column:
    """Share of modified sites above which a read counts as hypermethylated."""
    clamp = lambda add, low, high: F.least(F.greatest(base + F.lit(add), F.lit(low)), F.lit(high))
    plant = clamp(0.28, 0.38, 0.55)
    return F.when(regime == "plant", plant).when(regime == "vertebrate", clamp(0.22, 0.25, 0.45)).when(regime == "mosaic", clamp(0.26, 0.32, 0.50)).when(regime == "fungi", clamp(0.28, 0.35, 0.55)).otherwise(0.55)


def decode_mods(base: str, skips: list[int], seq: str) -> list[int]:
    """Positions (from 0) of the modified ones among a base's occurrences: each entry skips so many of them first."""
    at = [i for i, c in enumerate(seq) if c == base]
    out, k = [], -1
    for s in skips:
        k += s + 1
        if k < len(at):
            out.append(at[k])
    return out
