"""Graphs as tables of links between oriented segments: components, degrees, bubbles, unitigs, walks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Write = Callable[[DataFrame, str], DataFrame]


def both_strands(links: DataFrame) -> DataFrame:
    """Links (a, a_fwd, b, b_fwd) and their other readings, each once."""
    back = links.select(F.col("b").alias("a"), (~F.col("b_fwd")).alias("a_fwd"), F.col("a").alias("b"), (~F.col("a_fwd")).alias("b_fwd"))
    return links.select("a", "a_fwd", "b", "b_fwd").unionByName(back).distinct()


def canonical_link(a: str, a_fwd: str, b: str, b_fwd: str) -> Column:
    """The lesser of a link and its other reading."""
    one = F.struct(F.col(a).alias("a"), F.col(a_fwd).alias("a_fwd"), F.col(b).alias("b"), F.col(b_fwd).alias("b_fwd"))
    two = F.struct(F.col(b).alias("a"), (~F.col(b_fwd)).alias("a_fwd"), F.col(a).alias("b"), (~F.col(a_fwd)).alias("b_fwd"))
    return F.least(one, two)


def components(edges: DataFrame, write: Write, rounds: int = 40) -> DataFrame:
    """(node, root): least node of each component of edges (a, b), by least labels that also jump to their label's label."""
    both = write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = write(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    for i in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("root").alias("up"))
        moved = write(step.join(up, "new").select("node", F.least("new", "up").alias("now"), (F.least("new", "up") < F.col("root")).alias("moved")), f"labels-{i}")
        labels = moved.select("node", F.col("now").alias("root"))
        if not moved.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def reachable(edges: DataFrame, seeds: DataFrame, write: Write) -> DataFrame:
    """(node, round): nodes that directed edges (a, b) reach from seeds (node), with the round that reached each; until nothing is new."""
    seen = front = write(seeds.select("node").distinct().withColumn("round", F.lit(0)), "front")
    for i in count(1):
        new = front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = write(new.join(seen, "node", "left_anti").withColumn("round", F.lit(i)), f"front-{i}")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
        if i % 16 == 0:  # the plan must not grow with the rounds
            seen = write(seen, f"seen-{i}")


def degrees(links: DataFrame) -> DataFrame:
    """(seg, entries, exits): distinct neighbours at either end of each segment, as read forward."""
    out = both_strands(links).groupBy("a", "a_fwd").agg(F.countDistinct("b", "b_fwd").alias("n"))
    return out.groupBy(F.col("a").alias("seg")).agg(F.sum(F.when(~F.col("a_fwd"), F.col("n")).otherwise(0)).alias("entries"), F.sum(F.when(F.col("a_fwd"), F.col("n")).otherwise(0)).alias("exits"))


def bubbles(edges: DataFrame) -> DataFrame:
    """(left, right, alleles): pairs joined by two or more routes of at most one segment in between, not all empty."""
    two = edges.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("left"), F.col("x.b").alias("via"), F.col("y.b").alias("right"))
    two = two.where("left <> via and via <> right and left <> right")
    direct = edges.where("a <> b").select(F.col("a").alias("left"), F.lit(None).alias("via"), F.col("b").alias("right"))
    via = two.groupBy("left", "right").agg(F.countDistinct("via").alias("n"))
    both = via.join(direct.select("left", "right").distinct().withColumn("d", F.lit(1)), ["left", "right"], "left")
    return both.select("left", "right", (F.col("n") + F.coalesce("d", F.lit(0))).alias("alleles")).where("alleles >= 2")


def unitigs(edges: DataFrame, write: Write, rounds: int = 40) -> DataFrame:
    """(node, head, place, circular): runs of edges (a, b) whose ends have no other choice; by pointer doubling.

    u joins v when v is u's only successor, u is v's only predecessor, and they differ.  A run that returns to its start is
    circular; its head is its least node and places aren't counted.
    """
    e = edges.select("a", "b").distinct()
    one = e.withColumn("o", F.count("*").over(Window.partitionBy("a"))).withColumn("i", F.count("*").over(Window.partitionBy("b"))).where("o = 1 and i = 1 and a <> b")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    back = one.select(F.col("b").alias("node"), F.col("a").alias("up"))
    state = nodes.join(back, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"), F.least("node", F.coalesce("up", "node")).alias("least"))
    state = write(state, "unitigs")
    total = state.count()
    reach = 1
    while reach < 2 * total and rounds:
        top = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"), F.col("least").alias("least2"))
        new = write(state.join(top, "up").select("node", F.col("up2").alias("up"), (F.col("place") + F.col("place2")).alias("place"), F.least("least", "least2").alias("least")), f"unitigs-{reach}")
        still = new.join(state.select("node", F.col("up").alias("was")), "node").where("up <> was").limit(1).count()
        state, reach, rounds = new, reach * 2, rounds - 1
        if not still:
            break
    heads = state.where("node = up").select(F.col("node").alias("up"), F.lit(True).alias("open"))
    out = state.join(heads, "up", "left")
    # a circle never reaches a head: its places grow for ever, and the least node names it
    return out.select("node", F.when(F.col("open"), F.col("up")).otherwise(F.col("least")).alias("head"), F.when(F.col("open"), F.col("place")).alias("place"), F.col("open").isNull().alias("circular"))


def canonical_walks(steps: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(key, walk): labels in order, as the lesser of the walk and its reverse."""
    walks = steps.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, label))), lambda s: s[label]).alias("w"))
    joined = F.array_join("w", ">")
    return walks.select(key, F.least(joined, F.array_join(F.reverse("w"), ">")).alias("walk"))


def pick_winner(df: DataFrame, keys: list[str], item: str, score: str, least: int = 10) -> DataFrame:
    """(keys, winner): the best item, if its score is above the second's by max(least, a twentieth of it); else null."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    r = df.select(*keys, item, score, F.row_number().over(w).alias("r"), F.lead(score).over(w).alias("second")).where("r = 1")
    clear = F.col("second").isNull() | (F.col(score) >= F.col("second") + F.greatest(F.lit(least), F.floor(F.col("second") / 20)))
    return r.select(*keys, F.when(clear, F.col(item)).alias("winner"))
