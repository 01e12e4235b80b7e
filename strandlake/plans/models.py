"""Queries of models per group, and of panels, pairs and copy numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, models, stats
from .cohort import calls
from .graphs import order_edges, writer
from .registry import Tables, query


@query("pair_spans", "WITH p AS (SELECT a.l_orderkey AS f, abs(epoch(b.l_shipdate)::BIGINT // 86400 - epoch(a.l_shipdate)::BIGINT // 86400) AS span FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2), r AS (SELECT span, row_number() OVER (ORDER BY span) - 1 AS i, count(*) OVER () AS n FROM p) SELECT max(n) AS pairs, max(span) FILTER (i = n // 2) AS median FROM r")
def pair_spans(spark, sf_dir):
    """Fragments with both mates, and their median span."""
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    t = Tables(spark, sf_dir).lineitem.where("l_linenumber in (1, 2)").select("l_orderkey", "l_linenumber", day.alias("d"))
    one, two = (t.where(f"l_linenumber = {i}").select("l_orderkey", F.col("d").alias(f"d{i}")) for i in (1, 2))
    c = stats.value_counts(one.join(two, "l_orderkey").select(F.abs(F.col("d2") - F.col("d1")).alias("span")), "span", [])
    return c.agg(F.max("total").alias("pairs"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("span"))).alias("median"))


@query("copy_number_class", "WITH d AS (SELECT p_brand, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS m FROM d), s AS (SELECT p_brand, max(n) FILTER (i = m // 2) AS single FROM o GROUP BY 1) SELECT p_brand, p_type, round(n::DOUBLE / single, 9) AS copies, CASE WHEN n::DOUBLE / single < 0.75::DOUBLE THEN 'under' WHEN n::DOUBLE / single > 1.5::DOUBLE THEN 'over' ELSE 'agree' END AS class FROM d JOIN s USING (p_brand)")
def copy_number_class(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    r = F.col("n") / F.col("single")
    return d.join(stats.upper_median(d, "n", ["p_brand"], "single"), "p_brand").select("p_brand", "p_type", F.round(r, 9).alias("copies"), F.when(r < 0.75, "under").when(r > 1.5, "over").otherwise("agree").alias("class"))


@query("extension_fraction", "WITH d AS (SELECT o_custkey, count(*) AS reads, avg(o_totalprice) / 10000 AS depth FROM orders GROUP BY 1) SELECT o_custkey, round(CASE WHEN depth <= 15 THEN 1.0::DOUBLE ELSE least(1.0, greatest(15 / depth, 5.0 / reads)) END, 9) AS fraction FROM d")
def extension_fraction(spark, sf_dir):
    """Share of a target's reads that extend it: all up to a depth, then so many that depth or number stay."""
    d = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count("*").alias("reads"), (F.avg("o_totalprice") / 10000).alias("depth"))
    f = F.when(F.col("depth") <= 15, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(15 / F.col("depth"), F.lit(5.0) / F.col("reads"))))
    return d.select("o_custkey", F.round(f, 9).alias("fraction"))


WORDS6 = """l AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM documents), g AS (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM benchmark),
a AS (SELECT DISTINCT doc_id, substr(s, p, 6) AS w FROM (SELECT doc_id, s, unnest(range(1, length(s) - 4)) AS p FROM l WHERE length(s) >= 6)), b AS (SELECT DISTINCT item_id, substr(s, p, 6) AS w FROM (SELECT item_id, s, unnest(range(1, length(s) - 4)) AS p FROM g WHERE length(s) >= 6)),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM a JOIN b USING (w) GROUP BY ALL HAVING count(*) >= 5)"""


def words6(df, key):
    letters = F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "")
    at = F.when(F.size("c") >= 6, F.sequence(F.lit(0), F.size("c") - 6))
    word = lambda i: F.concat(*(F.get("c", i + k) for k in range(6)))
    return df.select(key, letters.alias("c")).select(key, F.explode(F.array_distinct(F.transform(at, word))).alias("w"))


def gene_hits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return words6(t.documents, "doc_id").join(words6(t.benchmark, "item_id"), "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits")).where("hits >= 5")


@query("gene_stretch_best", f"WITH {WORDS6} SELECT doc_id, first(item_id ORDER BY hits DESC, item_id) AS gene, max(hits) AS hits FROM h GROUP BY 1")
def gene_stretch_best(spark, sf_dir):
    """The panel's gene that shares most words of six with a stretch; the lesser of equals."""
    return gene_hits(spark, sf_dir).groupBy("doc_id").agg(F.max_by("item_id", F.struct("hits", (-F.col("item_id")).alias("i"))).alias("gene"), F.max("hits").alias("hits"))


@query("read_class", f"WITH {WORDS6}, c AS (SELECT doc_id, count(*) FILTER (item_id % 2 = 0) AS a, count(*) FILTER (item_id % 2 = 1) AS b FROM h GROUP BY 1) SELECT doc_id, CASE WHEN a >= 2 AND a > b THEN 'plastid' WHEN b >= 2 AND b > a THEN 'mitochondrion' ELSE 'none' END AS class FROM c")
def read_class(spark, sf_dir):
    """A read's class needs two genes of it, and more than of the other."""
    c = gene_hits(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("item_id") % 2 == 0).alias("a"), F.count_if(F.col("item_id") % 2 == 1).alias("b"))
    return c.select("doc_id", F.when((F.col("a") >= 2) & (F.col("a") > F.col("b")), "plastid").when((F.col("b") >= 2) & (F.col("b") > F.col("a")), "mitochondrion").otherwise("none").alias("class"))


@query("read_length_probe", "WITH p AS (SELECT length(text) AS n FROM documents ORDER BY doc_id LIMIT 10000), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM p) SELECT max(n) FILTER (i = m // 2) AS median, max(n) FILTER (i = m // 2) <= 1000 AS short_reads FROM o")
def read_length_probe(spark, sf_dir):
    """Median length of the first ten thousand reads (the probe is that many by definition), and the route it decides."""
    p = Tables(spark, sf_dir).documents.orderBy("doc_id").limit(10_000).select(F.length("text").cast("long").alias("n"))
    return stats.upper_median(p, "n", [], "median").withColumn("short_reads", F.col("median") <= 1000)


@query("bridge_paths", "WITH e AS (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL), p AS (SELECT a, b, 1 AS n FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a UNION ALL SELECT x.a, z.b, 3 FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a) SELECT a, b, min(n) AS shortest, count(*) AS routes FROM p WHERE a <> b GROUP BY ALL")
def bridge_paths(spark, sf_dir):
    """Routes of up to three links between nodes, summed up link by link so that counts, not paths, are carried."""
    e = order_edges(spark, sf_dir)
    step = e.select(F.col("a").alias("m"), F.col("b").alias("to"))
    at, out = e.select("a", "b", F.lit(1).cast("long").alias("r")), None
    for n in (1, 2, 3):
        here = at.select("a", "b", F.lit(n).alias("n"), "r")
        out = here if out is None else out.unionByName(here)
        at = at.join(step, F.col("b") == F.col("m")).groupBy("a", F.col("to").alias("b")).agg(F.sum("r").alias("r"))
    return out.where("a <> b").groupBy("a", "b").agg(F.min("n").alias("shortest"), F.sum("r").alias("routes"))


@query("strand_components")
def strand_components(spark, sf_dir):
    """Components of oriented nodes, and whether one holds a node in both readings."""
    e = order_edges(spark, sf_dir)
    both = e.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + F.col("a") % 2).alias("b")).unionByName(e.select((F.col("a") * 2 + 1).alias("a"), (F.col("b") * 2 + 1 - F.col("a") % 2).alias("b")))
    c = graph.components(both, writer(spark))
    n = c.groupBy("root", F.floor(F.col("node") / 2).alias("base")).agg(F.count("*").alias("strands"))
    return n.groupBy("root").agg(F.count("*").alias("nodes"), F.max(F.col("strands") > 1).alias("conflict"))


@query("viterbi_mosaic")
def viterbi_mosaic(spark, sf_dir):
    """How often each sample's path changes haplotype along the sites."""
    c = calls(spark, sf_dir).where("call = 'called'").select(F.col("sample").cast("long").alias("sample"), "site", (F.ascii("major") - 65).alias("allele"))
    return models.mosaic(c)


@query("em_lengths")
def em_lengths(spark, sf_dir):
    """Run lengths by hard EM, for each supplier's parts as runs and quantities as calls."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = sorted(pdf.groupby("run"))
        hist = [np.bincount(g["call"], g["n"], minlength=65) for _, g in groups]
        got = models.em_lengths(hist, [int(h.argmax()) for h in hist])
        return pd.DataFrame({"class": pdf["class"].iloc[0], "run": [r for r, _ in groups], "length": got})

    t = Tables(spark, sf_dir).lineitem
    h = t.groupBy((F.col("l_suppkey") % 10).alias("class"), (F.col("l_partkey") % 500).alias("run"), F.col("l_quantity").cast("int").alias("call")).agg(F.count("*").alias("n"))
    return h.groupBy("class").applyInPandas(run, "class long, run long, length long")


@query("matching_best")
def matching_best(spark, sf_dir):
    """For each nation, the heaviest pairing of market segments with order priorities."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = {(r.a, r.b): float(r.n) for r in pdf.itertuples()}
        total, pairs = models.best_matching(sorted({a for a, _ in w}), sorted({b for _, b in w}), w)
        return pd.DataFrame({"nation": [int(pdf["nation"].iloc[0])], "total": [total], "pairs": [len(pairs)]})

    t = Tables(spark, sf_dir)
    w = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("n"))
    return w.groupBy("nation").applyInPandas(run, "nation long, total double, pairs long")


@query("minority_share")
def minority_share(spark, sf_dir):
    """Share of the rarer phase at each brand, with a seeded bootstrap interval."""

    def run(batches):
        for pdf in batches:
            rows = [models.minority_interval(int(min(a, b)), int(max(a, b))) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[["brand"]].assign(**dict(zip(("share", "low", "high"), map(list, zip(*rows, strict=True)), strict=True))) if rows else pd.DataFrame({"brand": [], "share": [], "low": [], "high": []})

    t = Tables(spark, sf_dir)
    c = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(F.col("l_linestatus") == "O").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"))
    return c.mapInPandas(run, "brand string, share double, low double, high double")


@query("panel_cover")
def panel_cover(spark, sf_dir):
    """Suppliers that cover all part sizes, picked by most new ones."""
    t = Tables(spark, sf_dir)
    sets = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("set"), F.col("p_size").alias("item"))
    return spark.createDataFrame(models.greedy_cover(sets, writer(spark)), "picked long, gain long")


@query("posterior_votes")
def posterior_votes(spark, sf_dir):
    """Fixed point of how far relatives' votes, rather than frequencies, foretell each brand's major flag."""
    c = calls(spark, sf_dir).where("call = 'called'")
    # each vote is foretold by the others: it counts neither among its site's nor among its sample's
    n = c.groupBy("site", "major").agg(F.count("*").alias("n"))
    f = n.select("site", "major", ((F.col("n") - 0.5) / (F.sum("n").over(Window.partitionBy("site")) + 0.5)).alias("b"))
    near = c.groupBy("sample", "major").agg(F.count("*").alias("m"))
    a = near.select("sample", "major", ((F.col("m") - 0.5) / (F.sum("m").over(Window.partitionBy("sample")) + 0.5)).alias("a"))
    # equal votes are summed up first: as many rows as there are different ones come to the driver
    v = c.join(f, ["site", "major"]).join(a, ["sample", "major"]).groupBy("a", "b").count().orderBy("a", "b").collect()
    x = np.array([[r["a"], r["b"], r["count"]] for r in v]).reshape(-1, 3)
    return spark.createDataFrame([(int(x[:, 2].sum()), models.rho(*x.T))], "votes long, rho double")
