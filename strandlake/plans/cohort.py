"""Queries of cohorts and base modifications: sources as samples, events as site calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pan, stats
from .registry import Tables, query

#: Sites are parts' brands, samples the suppliers' nations, alleles the return flags.
CALLS_SQL = "d AS (SELECT s_nationkey AS sample, p_brand AS site, l_returnflag AS allele, count(*) AS depth FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"
GENO_SQL = CALLS_SQL + """, t AS (SELECT *, sum(depth) OVER (PARTITION BY sample, site) AS total FROM d),
m AS (SELECT sample, site, max(total)::BIGINT AS total, first(allele ORDER BY depth DESC, allele DESC) AS major FROM t GROUP BY sample, site),
k AS (SELECT t.sample, t.site, string_agg(t.allele, ',' ORDER BY t.allele) AS minors FROM t JOIN m ON m.sample = t.sample AND m.site = t.site WHERE t.depth >= t.total * 0.1::DOUBLE AND t.allele <> m.major GROUP BY t.sample, t.site),
g AS (SELECT m.sample, m.site, CASE WHEN m.total >= 4.0 THEN m.major END AS major, CASE WHEN m.total >= 4.0 THEN coalesce(k.minors, '') ELSE '' END AS minors, CASE WHEN m.total >= 4.0 THEN 'called' ELSE 'uncallable' END AS call FROM m LEFT JOIN k ON m.sample = k.sample AND m.site = k.site)"""


def depths(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(F.col("s_nationkey").alias("sample"), F.col("p_brand").alias("site"), F.col("l_returnflag").alias("allele")).agg(F.count("*").alias("depth"))


def calls(spark, sf_dir):
    return pan.genotypes(depths(spark, sf_dir), 20.0)


@query("genotype_calls", f"WITH {GENO_SQL} SELECT * FROM g")
def genotype_calls(spark, sf_dir):
    return calls(spark, sf_dir)


@query("presence_calls", "WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT *, n::DOUBLE / max(n) OVER (PARTITION BY source) AS r FROM d) SELECT source, lang, n, CASE WHEN n = 0 THEN 'none' WHEN r >= 0.25::DOUBLE THEN 'present' WHEN r < 0.02::DOUBLE THEN 'absent' ELSE 'uncallable' END AS call FROM m")
def presence_calls(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    r = F.col("n") / F.max("n").over(Window.partitionBy("source"))
    return d.select("source", "lang", "n", pan.presence_call(r, F.col("n")).alias("call"))


@query("presence_matrix", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def presence_matrix(spark, sf_dir):
    p = Tables(spark, sf_dir).documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count()
    return p.na.fill(0)


@query("allele_freq", f"WITH {GENO_SQL}, n AS (SELECT site, major, count(*) AS n FROM g WHERE call = 'called' GROUP BY ALL) SELECT site, major, n, sum(n) OVER (PARTITION BY site)::BIGINT AS samples, round(n::DOUBLE / sum(n) OVER (PARTITION BY site), 9) AS frequency FROM n")
def allele_freq(spark, sf_dir):
    n = calls(spark, sf_dir).where("call = 'called'").groupBy("site", "major").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("site"))
    return n.select("site", "major", "n", total.alias("samples"), F.round(F.col("n") / total, 9).alias("frequency"))


PAIRS_SQL = GENO_SQL + ", p AS (SELECT x.sample AS a, y.sample AS b, count(*) FILTER (x.major <> y.major) AS differing, count(*) AS common FROM g x JOIN g y ON x.site = y.site AND x.sample < y.sample WHERE x.call = 'called' AND y.call = 'called' GROUP BY ALL)"


@query("sample_distance", f"WITH {PAIRS_SQL} SELECT a, b, differing, common, round(differing::DOUBLE / common, 9) AS distance FROM p")
def sample_distance(spark, sf_dir):
    d = pan.sample_distance(calls(spark, sf_dir).where("call = 'called'"))
    return d.withColumn("distance", F.round(F.col("differing") / F.col("common"), 9))


@query("nearest_sample", f"WITH {PAIRS_SQL}, u AS (SELECT a, b, differing::DOUBLE / common AS d, common FROM p UNION ALL SELECT b, a, differing::DOUBLE / common, common FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, common DESC, b) AS r FROM u) SELECT a AS sample, b AS nearest, round(d, 9) AS distance FROM r WHERE r = 1")
def nearest_sample(spark, sf_dir):
    d = pan.sample_distance(calls(spark, sf_dir).where("call = 'called'")).withColumn("d", F.col("differing") / F.col("common"))
    both = d.select("a", "b", "d", "common").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "common"))
    best = both.groupBy("a").agg(F.min(F.struct("d", (-F.col("common")).alias("c"), "b")).alias("m"))
    return best.select(F.col("a").alias("sample"), F.col("m.b").alias("nearest"), F.round("m.d", 9).alias("distance"))


@query("core_shell_stats", "WITH p AS (SELECT l_partkey, count(DISTINCT s_nationkey) AS samples FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), n AS (SELECT count(DISTINCT s_nationkey) AS n FROM supplier) SELECT samples, count(*) AS pieces, samples = n AS core FROM p, n GROUP BY samples, n")
def core_shell_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_partkey").agg(F.countDistinct("s_nationkey").alias("samples"))
    n = t.supplier.agg(F.countDistinct("s_nationkey").alias("n"))
    return p.groupBy("samples").agg(F.count("*").alias("pieces")).join(F.broadcast(n)).select("samples", "pieces", (F.col("samples") == F.col("n")).alias("core"))


@query("junction_freq", "WITH j AS (SELECT l_shipdate::DATE AS left_, l_linestatus AS source, l_suppkey % 10 AS sample FROM lineitem) SELECT left_ AS junction, count(DISTINCT sample) FILTER (source = 'O') AS by_reads, count(DISTINCT sample) FILTER (source = 'F') AS by_panel, string_agg(DISTINCT sample::VARCHAR, ',' ORDER BY sample::VARCHAR) AS samples FROM j GROUP BY 1")
def junction_freq(spark, sf_dir):
    j = Tables(spark, sf_dir).lineitem.select(F.to_date("l_shipdate").alias("junction"), F.col("l_linestatus").alias("source"), (F.col("l_suppkey") % 10).cast("string").alias("sample"))
    of = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("sample")))
    return j.groupBy("junction").agg(of("O").alias("by_reads"), of("F").alias("by_panel"), F.array_join(F.sort_array(F.collect_set("sample")), ",").alias("samples"))


@query("replicate_reproduction", "WITH r AS (SELECT DISTINCT l_suppkey % 5 AS replicate, l_partkey AS signature FROM lineitem), s AS (SELECT signature, count(*) AS n FROM r GROUP BY 1) SELECT n AS replicates, count(*) AS junctions, round(n / 5.0::DOUBLE, 9) AS share FROM s GROUP BY 1")
def replicate_reproduction(spark, sf_dir):
    r = Tables(spark, sf_dir).lineitem.select((F.col("l_suppkey") % 5).alias("replicate"), F.col("l_partkey").alias("signature")).distinct()
    s = r.groupBy("signature").agg(F.count("*").alias("replicates"))
    return s.groupBy("replicates").agg(F.count("*").alias("junctions")).withColumn("share", F.round(F.col("replicates") / F.lit(5.0), 9))


@query("relative_weights", f"WITH {PAIRS_SQL}, l AS (SELECT a, b, lgamma(common - differing + 0.5) + lgamma(differing + 0.5) - lgamma(common + 1.0) AS lw FROM p), lt AS (SELECT *, max(lw) OVER (PARTITION BY a) AS top FROM l) SELECT a, b, round(exp(lw - top) / sum(exp(lw - top)) OVER (PARTITION BY a), 9) AS weight FROM lt")
def relative_weights(spark, sf_dir):
    """Weights of relatives by matches and mismatches: the beta integral with Jeffreys' prior, as a sum of logs of half-integers."""
    d = pan.sample_distance(calls(spark, sf_dir).where("call = 'called'"))
    # ln gamma(n + 1/2) and ln gamma(n + 1), up to constants, by folding logs
    fold = lambda n, shift: F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log(i - F.lit(shift)))
    lw = fold(F.col("common") - F.col("differing"), 0.5) + fold(F.col("differing"), 0.5) - fold(F.col("common"), 0.0)
    w = Window.partitionBy("a")
    m = d.select("a", "b", lw.alias("lw")).withColumn("e", F.exp(F.col("lw") - F.max("lw").over(w)))
    return m.select("a", "b", F.round(F.col("e") / F.sum("e").over(w), 9).alias("weight"))


@query("new_segment_merge", "WITH s AS (SELECT c_custkey, least(c_mktsegment, reverse(c_mktsegment)) AS seq FROM customer) SELECT seq, dense_rank() OVER (ORDER BY seq) AS id, n FROM (SELECT seq, count(*) AS n FROM s GROUP BY 1)")
def new_segment_merge(spark, sf_dir):
    """Segments that are one in either orientation get one number."""
    s = Tables(spark, sf_dir).customer.groupBy(F.least("c_mktsegment", F.reverse("c_mktsegment")).alias("seq")).agg(F.count("*").alias("n"))
    return s.select("seq", F.dense_rank().over(Window.orderBy("seq")).cast("long").alias("id"), "n")


@query("mod_site_counts", "SELECT event_type AS context, user_id AS contig, (event_id % 2)::BIGINT AS strand, count(*) FILTER (value >= 50) AS modified, count(*) FILTER (NOT value >= 50) AS unmodified FROM events GROUP BY ALL")
def mod_site_counts(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy(F.col("event_type").alias("context"), F.col("user_id").alias("contig"), (F.col("event_id") % 2).alias("strand")).agg(F.count_if(F.col("value") >= 50).alias("modified"), F.count_if(~(F.col("value") >= 50)).alias("unmodified"))


@query("mod_context_summary", "SELECT coalesce(event_type, 'all') AS context, count(*) AS calls, count(*) FILTER (value >= 50) AS modified, round(count(*) FILTER (value >= 50)::DOUBLE / count(*), 9) AS share FROM events GROUP BY GROUPING SETS ((event_type), ())")
def mod_context_summary(spark, sf_dir):
    e = Tables(spark, sf_dir).events.rollup("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") >= 50).alias("modified"))
    return e.select(F.coalesce("event_type", F.lit("all")).alias("context"), "calls", "modified", F.round(F.col("modified") / F.col("calls"), 9).alias("share"))


READ_CLASS = "r AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS cg, count(*) FILTER (event_type = 'click' AND value >= 50) AS cgm, count(*) FILTER (event_type = 'view') AS chg, count(*) FILTER (event_type = 'view' AND value >= 50) AS chgm, max(event_id) % 97 AS overhang FROM events GROUP BY 1)"


@query("mod_read_class", f"WITH {READ_CLASS} SELECT user_id, CASE WHEN cg >= 3 AND cgm::DOUBLE / cg > 0.45::DOUBLE OR cg = 0 AND chg >= 10 AND chgm::DOUBLE / chg > 0.35::DOUBLE THEN 'hypermethylated' WHEN overhang >= 50 THEN 'chimeric' ELSE 'organelle' END AS class FROM r")
def mod_read_class(spark, sf_dir):
    click, view, high = F.col("event_type") == "click", F.col("event_type") == "view", F.col("value") >= 50
    r = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count_if(click).alias("cg"), F.count_if(click & high).alias("cgm"), F.count_if(view).alias("chg"), F.count_if(view & high).alias("chgm"), (F.max("event_id") % 97).alias("overhang"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    hyper = (F.col("cg") >= 3) & (share("cgm", "cg") > 0.45) | (F.col("cg") == 0) & (F.col("chg") >= 10) & (share("chgm", "chg") > 0.35)
    return r.select("user_id", F.when(hyper, "hypermethylated").when(F.col("overhang") >= 50, "chimeric").otherwise("organelle").alias("class"))


@query("mod_threshold_policy", "WITH o AS (SELECT event_type, value / 100 AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), b AS (SELECT event_type, max(v) FILTER (i = floor((n - 1) * 0.35::DOUBLE + 0.5)) AS b FROM o GROUP BY 1), r AS (SELECT * FROM (VALUES ('plant', 0.28::DOUBLE, 0.38::DOUBLE, 0.55::DOUBLE), ('vertebrate', 0.22, 0.25, 0.45), ('mosaic', 0.26, 0.32, 0.50), ('unmethylated', NULL, 0.55, 0.55), ('fungi', 0.28, 0.35, 0.55)) t(regime, a, lo, hi)) SELECT event_type, regime, round(CASE WHEN a IS NULL THEN 0.55 ELSE least(greatest(b + a, lo), hi) END, 9) AS threshold FROM b, r")
def mod_threshold_policy(spark, sf_dir):
    b = stats.nearest_rank(Tables(spark, sf_dir).events, "value", 0.35, ["event_type"], "b").withColumn("b", F.col("b") / 100)
    regimes = F.explode(F.array(*map(F.lit, ("plant", "vertebrate", "mosaic", "unmethylated", "fungi"))))
    r = b.select("event_type", "b", regimes.alias("regime"))
    return r.select("event_type", "regime", F.round(pan.threshold_policy(F.col("b"), F.col("regime")), 9).alias("threshold"))


@query("mod_decode", """WITH t AS (SELECT doc_id, translate(text, 'c', 'C') AS s FROM documents), p AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS pos FROM t) WHERE substr(s, pos, 1) = 'C')
SELECT doc_id, count(*) AS modified, sum(pos)::BIGINT AS place_sum FROM p WHERE k % 3 = 2 GROUP BY 1""")
def mod_decode(spark, sf_dir):
    """Delta-coded calls over a base's occurrences: every entry skips two."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.translate("text", "c", "C").alias("s"))
    at = F.filter(F.transform(F.split("s", ""), lambda c, i: F.when(c == "C", i + 1)), lambda p: p.isNotNull())
    taken = docs.select("doc_id", F.filter(at, lambda p, k: k % 3 == 2).alias("p")).where(F.size("p") > 0)
    return taken.select("doc_id", F.size("p").cast("long").alias("modified"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("place_sum"))
