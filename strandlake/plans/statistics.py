"""Queries of order statistics, histograms and intervals, on events, orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, stats
from .registry import Tables, query

RANK = "row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n"


@query("nearest_rank_quantile", f"WITH o AS (SELECT event_type, value, {RANK.format(k='event_type', v='value')} FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = floor((n - 1) * 0.35::DOUBLE + 0.5)) AS q35, max(value) FILTER (i = floor((n - 1) * 0.9::DOUBLE + 0.5)) AS q90 FROM o GROUP BY 1")
def nearest_rank_quantile(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return stats.nearest_rank(e, "value", 0.35, ["event_type"], "q35").join(stats.nearest_rank(e, "value", 0.9, ["event_type"], "q90"), "event_type")


@query("upper_median", f"WITH o AS (SELECT l_returnflag, l_quantity, {RANK.format(k='l_returnflag', v='l_quantity')} FROM lineitem) SELECT l_returnflag, max(l_quantity) FILTER (i = n // 2) AS median FROM o GROUP BY 1")
def upper_median(spark, sf_dir):
    return stats.upper_median(Tables(spark, sf_dir).lineitem, "l_quantity", ["l_returnflag"], "median")


WEIGHTED = "WITH c AS (SELECT l_linestatus, l_quantity AS x, sum(l_suppkey)::BIGINT AS m FROM lineitem GROUP BY ALL), u AS (SELECT *, sum(m) OVER (PARTITION BY l_linestatus ORDER BY x) AS upto, sum(m) OVER (PARTITION BY l_linestatus) AS total FROM c) SELECT l_linestatus, min(x) AS median FROM u WHERE upto * 2 {op} total GROUP BY 1"


@query("weighted_median", WEIGHTED.format(op=">="))
def weighted_median(spark, sf_dir):
    return stats.weighted_median(Tables(spark, sf_dir).lineitem, "l_quantity", "l_suppkey", ["l_linestatus"], "median")


@query("weighted_median_strict", WEIGHTED.format(op=">"))
def weighted_median_strict(spark, sf_dir):
    return stats.weighted_median(Tables(spark, sf_dir).lineitem, "l_quantity", "l_suppkey", ["l_linestatus"], "median", strict=True)


@query("count_weighted_depth", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3), h AS (SELECT n, sum(n)::BIGINT AS m FROM c GROUP BY 1), u AS (SELECT n, sum(m) OVER (ORDER BY n) AS upto, sum(m) OVER () AS total FROM h) SELECT min(n) AS depth FROM u WHERE upto * 2 >= total")
def count_weighted_depth(spark, sf_dir):
    """Median count of nodes with three or more, each weighing its count."""
    c = Tables(spark, sf_dir).lineitem.groupBy("l_partkey").count().where("count >= 3").withColumnRenamed("count", "n")
    return stats.weighted_median(c.withColumn("w", F.col("n")), "n", "w", [], "depth")


@query("min_node_count", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3), h AS (SELECT n, sum(n)::BIGINT AS m FROM c GROUP BY 1), u AS (SELECT n, sum(m) OVER (ORDER BY n) AS upto, sum(m) OVER () AS total FROM h), d AS (SELECT min(n) AS depth FROM u WHERE upto * 2 >= total) SELECT depth, greatest(depth // 10, CASE WHEN depth < 6 THEN 1 WHEN depth < 8 THEN 2 ELSE 3 END) AS min_count FROM d")
def min_node_count(spark, sf_dir):
    d = count_weighted_depth(spark, sf_dir)
    return d.select("depth", F.greatest(F.floor(F.col("depth") / 10), F.when(F.col("depth") < 6, 1).when(F.col("depth") < 8, 2).otherwise(3)).alias("min_count"))


@query("n50_stats", "WITH p AS (SELECT lang, length(text) AS len FROM documents), u AS (SELECT *, sum(len) OVER (PARTITION BY lang ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY lang) AS total FROM p) SELECT lang, count(*) AS pieces, max(total)::BIGINT AS total, max(len) AS longest, max(len) FILTER (upto * 2 >= total) AS n50 FROM u GROUP BY 1")
def n50_stats(spark, sf_dir):
    return stats.n50(Tables(spark, sf_dir).documents.select("lang", F.length("text").cast("long").alias("len")), "len", ["lang"])


@query("auc_midrank", "WITH x AS (SELECT n_chars AS v, quality = 1 AS p FROM documents JOIN labels USING (doc_id)), r AS (SELECT p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x), s AS (SELECT sum(r) FILTER (p) AS rs, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn FROM r) SELECT round((rs - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn), 9) AS auc FROM s")
def auc_midrank(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = t.documents.join(t.labels, "doc_id").select(F.col("n_chars").alias("v"), (F.col("quality") == 1).alias("p"))
    return stats.auc(x, "v", "p", []).select(F.round("auc", 9).alias("auc"))


@query("poisson_cdf_table", "WITH t AS (SELECT n, l::DOUBLE AS l FROM range(0, 21) a(n), (VALUES (0.5), (2.0), (7.5)) b(l)), x AS (SELECT n, l, i, exp(i * ln(l) - l - lgamma(i + 1)) AS p FROM t, range(0, 21) c(i) WHERE i <= n) SELECT n::INT AS n, l AS rate, round(least(sum(p), 1.0), 9) AS cdf FROM x GROUP BY ALL")
def poisson_cdf_table(spark, sf_dir):
    t = spark.range(21).select(F.col("id").cast("int").alias("n"), F.explode(F.array(F.lit(0.5), F.lit(2.0), F.lit(7.5))).alias("rate"))
    return t.select("n", "rate", F.round(stats.poisson_cdf(F.col("n"), F.col("rate")), 9).alias("cdf"))


@query("missing_share_bound", "SELECT user_id, count(*) AS n, round(1 - power(0.05::DOUBLE, 1.0 / count(*)), 9) AS upper FROM events GROUP BY 1")
def missing_share_bound(spark, sf_dir):
    """Greatest share that could still be missing after n reads without it, at 95 per cent."""
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("upper", F.round(1 - F.pow(F.lit(0.05), 1 / F.col("n")), 9))


@query("hist_valley_peak", "WITH h AS (SELECT c AS c, count(*) AS n FROM (SELECT l_suppkey, l_quantity::INT AS q, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1), w AS (SELECT c, n, lag(n) OVER (ORDER BY c) AS p, lead(n) OVER (ORDER BY c) AS x FROM h), v AS (SELECT coalesce(min(c), 1) AS valley FROM w WHERE n <= p AND n < x) SELECT valley, arg_max(c, n * 100000 + c) AS peak FROM h, v WHERE c >= valley GROUP BY 1")
def hist_valley_peak(spark, sf_dir):
    counts = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("c"))
    h = counts.groupBy("c").agg(F.count("*").alias("n"))
    w = Window.orderBy("c")
    valley = h.select("c", "n", F.lag("n").over(w).alias("p"), F.lead("n").over(w).alias("x")).where("n <= p and n < x").agg(F.coalesce(F.min("c"), F.lit(1)).alias("valley"))
    # one row
    return h.join(F.broadcast(valley), F.col("c") >= F.col("valley")).groupBy("valley").agg(F.max_by("c", F.struct("n", "c")).alias("peak"))


@query("depth_histogram_peaks", """WITH b AS (SELECT floor(log2(o_totalprice) / 0.25::DOUBLE)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1),
g AS (SELECT unnest(range(min(bin) - 2, max(bin) + 3)) AS bin FROM b), f AS (SELECT g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (bin)),
s AS (SELECT bin, n, sum(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM f),
t AS (SELECT *, lag(s) OVER o AS ls, lag(n) OVER o AS ln, lead(s) OVER o AS hs, lead(n) OVER o AS hn FROM s WINDOW o AS (ORDER BY bin))
SELECT bin, n, s FROM t WHERE n > 0 AND s >= 10 AND (s > ls OR s = ls AND n >= ln) AND (s > hs OR s = hs AND n > hn)""")
def depth_histogram_peaks(spark, sf_dir):
    bins = Tables(spark, sf_dir).orders.where("o_totalprice > 0").groupBy(F.floor(F.log2("o_totalprice") / F.lit(0.25)).alias("bin")).agg(F.count("*").alias("n"))
    return stats.octave_peaks(bins, 10)


@query("depth_peaks_merged")
def depth_peaks_merged(spark, sf_dir):
    """Those peaks, less than an octave apart drawn together."""
    return stats.merged_peaks(depth_histogram_peaks(spark, sf_dir))


@query("nearest_peak", "WITH p AS (SELECT n_nationkey AS peak, n_nationkey * 400.0::DOUBLE AS centre FROM nation), x AS (SELECT c_custkey, peak, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - centre), peak) AS r FROM customer, p) SELECT c_custkey, peak FROM x WHERE r = 1")
def nearest_peak(spark, sf_dir):
    """Each value's nearest centre; the 25 centres are folded into one array."""
    t = Tables(spark, sf_dir)
    peaks = t.nation.agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("peak"), (F.col("n_nationkey") * F.lit(400.0)).alias("centre")))).alias("peaks"))
    near = F.array_min(F.transform("peaks", lambda p: F.struct(F.abs(F.col("c_acctbal") - p["centre"]).alias("d"), p["peak"].alias("peak"))))
    return t.customer.join(F.broadcast(peaks)).select("c_custkey", near["peak"].alias("peak"))


SPANS = "i AS (SELECT l_suppkey, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e FROM lineitem)"


def spans(spark, sf_dir):
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    return Tables(spark, sf_dir).lineitem.select("l_suppkey", day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))


@query("interval_union_cover", f"WITH {SPANS}, m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM i), n AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT l_suppkey, g, min(s) AS s, max(e) AS e FROM n GROUP BY ALL) SELECT l_suppkey, count(*) AS islands, sum(e - s)::BIGINT AS covered FROM u GROUP BY 1")
def interval_union_cover(spark, sf_dir):
    return intervals.union(spans(spark, sf_dir), ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("islands"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("interval_depth_sweep", f"WITH {SPANS}, v AS (SELECT l_suppkey, s AS p, 1 AS d FROM i UNION ALL SELECT l_suppkey, e, -1 FROM i), a AS (SELECT l_suppkey, p, sum(d) AS d FROM v GROUP BY ALL), w AS (SELECT l_suppkey, p, lead(p) OVER (PARTITION BY l_suppkey ORDER BY p) - p AS len, sum(d) OVER (PARTITION BY l_suppkey ORDER BY p) AS depth FROM a) SELECT l_suppkey, max(depth)::BIGINT AS deepest, sum(depth * len)::BIGINT AS bases FROM w WHERE depth > 0 GROUP BY 1")
def interval_depth_sweep(spark, sf_dir):
    d = intervals.depth(spans(spark, sf_dir), ["l_suppkey"])
    return d.groupBy("l_suppkey").agg(F.max("depth").alias("deepest"), F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("bases"))


@query("run_islands", f"WITH {SPANS}, d AS (SELECT DISTINCT l_suppkey, s FROM i), g AS (SELECT l_suppkey, s, s - row_number() OVER (PARTITION BY l_suppkey ORDER BY s) AS g FROM d), r AS (SELECT l_suppkey, g, count(*) AS n FROM g GROUP BY ALL) SELECT l_suppkey, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1")
def run_islands(spark, sf_dir):
    r = intervals.islands(spans(spark, sf_dir), ["l_suppkey"], "start")
    return r.groupBy("l_suppkey").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("diagonal_chains", "WITH d AS (SELECT l_partkey, l_suppkey - l_linenumber * 7 AS g FROM lineitem), n AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY l_partkey ORDER BY g) > 5 THEN 1 ELSE 0 END AS new FROM d), c AS (SELECT *, sum(new) OVER (PARTITION BY l_partkey ORDER BY g) AS chain FROM n) SELECT l_partkey, chain::BIGINT AS chain, min(g) AS low, max(g) AS high, count(*) AS n FROM c GROUP BY ALL")
def diagonal_chains(spark, sf_dir):
    d = Tables(spark, sf_dir).lineitem.select("l_partkey", (F.col("l_suppkey") - F.col("l_linenumber") * 7).alias("g"))
    return intervals.chains(d, ["l_partkey"], "g", 5)


@query("capped_output", "WITH r AS (SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM documents) SELECT source, count(*) AS reads, max(upto) AS bases FROM r WHERE upto <= 50000 GROUP BY 1")
def capped_output(spark, sf_dir):
    """Records in input order up to a base cap for each source (the cap is the operator)."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    r = Tables(spark, sf_dir).documents.select("source", F.sum(F.length("text")).over(w).alias("upto")).where("upto <= 50000")
    return r.groupBy("source").agg(F.count("*").alias("reads"), F.max("upto").alias("bases"))


@query("stable_sample_topn", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) SELECT lang, r AS rank, doc_id FROM r WHERE r <= 8")
def stable_sample_topn(spark, sf_dir):
    """Eight records of each cluster, by a hash of the record, whatever the input order."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    r = Tables(spark, sf_dir).documents.select("lang", F.row_number().over(w).cast("long").alias("rank"), "doc_id")
    return r.where("rank <= 8")


@query("ladder_choice", "SELECT l_returnflag, first(l_suppkey ORDER BY l_linenumber, l_quantity, l_extendedprice DESC, l_suppkey DESC) AS best FROM lineitem GROUP BY 1")
def ladder_choice(spark, sf_dir):
    """The best rung by several keys: fewest open ends, fewest unitigs, then longest, then largest k."""
    key = F.struct("l_linenumber", "l_quantity", (-F.col("l_extendedprice")).alias("p"), (-F.col("l_suppkey")).alias("k"))
    return Tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.min_by("l_suppkey", key).alias("best"))


@query("branch_posterior", "WITH c AS (SELECT o_orderpriority AS state, o_custkey % 7 AS run, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT state, run, n, sum(n) OVER (PARTITION BY state)::BIGINT - n AS rest, sum(n) OVER () - sum(n) OVER (PARTITION BY run) AS others, (SELECT count(DISTINCT state) FROM c) AS k FROM c) SELECT state, run, n, round((rest + 0.5::DOUBLE) / (others + 0.5::DOUBLE * k), 9) AS predicted FROM t")
def branch_posterior(spark, sf_dir):
    """A branch's share predicted from all other runs, with half a count for each state."""
    c = Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("state"), (F.col("o_custkey") % 7).alias("run")).agg(F.count("*").alias("n"))
    by_state = c.groupBy("state").agg(F.sum("n").alias("s"))
    by_run = c.groupBy("run").agg(F.sum("n").alias("r"))
    all_ = c.agg(F.sum("n").alias("t"), F.countDistinct("state").alias("k"))
    out = c.join(by_state, "state").join(by_run, "run").join(F.broadcast(all_))
    return out.select("state", "run", "n", F.round((F.col("s") - F.col("n") + 0.5) / (F.col("t") - F.col("r") + F.col("k") * 0.5), 9).alias("predicted"))
