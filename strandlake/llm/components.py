"""Connected components of a table of links by alternating large and small stars; nothing is gathered on the driver but a checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


def _stars(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """``pairs`` (u, v): links each v to the least of u and its partners; partial minima meet first, then the pairs are joined with them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_self:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node of its component.

    Links in either direction, repeated links and links of a node with itself are fine; nulls are left aside.  No rows
    for no links.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "components")
    sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    for _ in range(rounds):
        if not sign[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: partners greater than u go to the least partner; small star: u and lesser partners do
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        new = materialize(_stars(large, keep_self=True), "components")
        drop_materialized(edges)
        edges, last = new, sign
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == last:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
