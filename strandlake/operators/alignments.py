"""Alignment tables (PAF-like) and small decisions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import union


def score(paf: DataFrame) -> DataFrame:
    """(query, covered, aligned, matches, identity): covered counts a base once however many alignments hold it.

    ``paf`` has query, start, end, matches, block.
    """
    covered = union(paf, ["query"]).groupBy("query").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    sums = paf.groupBy("query").agg(F.sum("block").alias("aligned"), F.sum("matches").alias("matches"))
    return sums.join(covered, "query").withColumn("identity", F.col("matches") / F.col("aligned"))


def compete(scores: DataFrame, margin: int) -> DataFrame:
    """(query, verdict) of the best score in each of two groups (query, grp in a/b, score)."""
    best = scores.groupBy("query").agg(F.max(F.when(F.col("grp") == "a", F.col("score"))).alias("a"), F.max(F.when(F.col("grp") == "b", F.col("score"))).alias("b"))
    verdict = F.when(F.col("b").isNull(), "a only").when(F.col("a").isNull(), "b only").when(F.col("a") >= F.col("b") + margin, "a").when(F.col("b") >= F.col("a") + margin, "b").otherwise("tie")
    return best.select("query", verdict.alias("verdict"))


def placements(queries: DataFrame, targets: DataFrame, width: int, mismatches: int) -> DataFrame:
    """(query, target, differing) of equal-length words (id, word) with at most ``mismatches`` differences.

    A word is cut into mismatches + 1 blocks; words within reach agree in one of them, so blocks are joined and then checked.
    """
    n = mismatches + 1
    cuts = [(i * width // n, (i + 1) * width // n) for i in range(n)]
    blocks = F.posexplode(F.array(*(F.substring("word", a + 1, b - a) for a, b in cuts)))
    x = queries.select(F.col("id").alias("query"), "word", blocks.alias("i", "part"))
    y = targets.select(F.col("id").alias("target"), "word", blocks.alias("i", "part")).withColumnRenamed("word", "other")
    pairs = x.join(y, ["i", "part"]).select("query", "target", "word", "other").distinct()
    d = F.size(F.filter(F.zip_with(F.split("word", ""), F.split("other", ""), lambda a, b: a != b), lambda z: z))
    return pairs.select("query", "target", d.alias("differing")).where(F.col("differing") <= mismatches)


def decide_components(stats: DataFrame, depth_factor: float = 2.0) -> DataFrame:
    """(component, keep, reason) against the component with most target genes (deeper, then earlier, of equals); the first reason that holds counts."""
    w = Window.orderBy(F.desc("genes"), F.desc("depth"), "component")
    ranked = stats.withColumn("r", F.row_number().over(w))
    ref = ranked.where("r = 1 and genes > 0").select(F.col("component").alias("ref"), F.col("depth").alias("ref_depth"))
    j = stats.join(F.broadcast(ref), F.lit(True), "left")
    reason = (
        F.when(F.col("ref").isNull(), "no reference").when(F.col("component") == F.col("ref"), "reference").when(F.col("depth").isNull(), "no depth")
        .when((F.col("genes") == 0) & (F.col("others") >= 5), "other only").when(F.col("depth") < F.col("ref_depth") / depth_factor, "depth below")
        .when(F.col("depth") > F.col("ref_depth") * depth_factor, "depth above").otherwise("keep")
    )
    return j.select("component", reason.isin("no reference", "reference", "no depth", "keep").alias("keep"), reason.alias("reason"))


def set_call(genes_a: str, density_a: str, genes_b: str, density_b: str, least: int = 5, density: float = 0.3):
    """plastid, mitochondrion, mixed or none by gene numbers and densities; a is tested first."""
    a = (F.col(genes_a) >= least) & (F.col(density_a) >= density)
    b = (F.col(genes_b) >= least) & (F.col(density_b) >= density)
    return F.when(a & (~b | (F.col(genes_a) >= 2 * F.col(genes_b))), "plastid").when(b & (~a | (F.col(genes_b) >= 2 * F.col(genes_a))), "mitochondrion").when(a & b, "mixed").otherwise("none")
