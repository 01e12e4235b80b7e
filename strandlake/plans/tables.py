"""Queries of connectors, reports, alignments, components and event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seqs
from ..operators import alignments as A
from ..sources import gfa
from ..streaming import events as E
from .registry import Tables, query


def gfa_lines(spark, sf_dir):
    """Parts as segments, line items as links, conversations as paths."""
    t = Tables(spark, sf_dir)
    s = t.part.select(F.concat_ws("\t", F.lit("S"), F.col("p_partkey").cast("string"), F.lower("p_type"), F.concat(F.lit("LN:i:"), F.col("p_size").cast("string")), F.concat(F.lit("dp:f:"), F.col("p_retailprice").cast("string"))).alias("value"))
    e = t.lineitem.select(F.concat_ws("\t", F.lit("L"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), F.col("l_suppkey").cast("string"), F.lit("+"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"))).alias("value"))
    steps = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.when(x["turn"] % 2 == 0, "+").otherwise("-"))), ",")
    p = t.conversations.groupBy("conv_id").agg(steps.alias("s")).select(F.concat_ws("\t", F.lit("P"), F.col("conv_id").cast("string"), "s", F.lit("*")).alias("value"))
    return s.unionByName(e).unionByName(p)


@query("gfa_segments", "SELECT p_partkey::VARCHAR AS name, length(p_type) AS bases, p_size AS ln, round(p_retailprice, 6) AS depth FROM part")
def gfa_segments(spark, sf_dir):
    s = gfa.segments(gfa_lines(spark, sf_dir))
    return s.select("name", F.length("seq").cast("long").alias("bases"), gfa.tag(F.col("tags"), "LN", "int").alias("ln"), F.round(gfa.tag(F.col("tags"), "dp", "double"), 6).alias("depth"))


@query("gfa_links", "WITH l AS (SELECT l_partkey::VARCHAR AS a, l_linenumber % 2 = 0 AS af, l_suppkey::VARCHAR AS b, true AS bf, l_quantity::INT AS ov FROM lineitem), c AS (SELECT DISTINCT CASE WHEN (a, af, b, bf) <= (b, NOT bf, a, NOT af) THEN (a, af, b, bf) ELSE (b, NOT bf, a, NOT af) END AS k, ov FROM l) SELECT ov AS overlap, count(*) AS links FROM c GROUP BY 1")
def gfa_links(spark, sf_dir):
    return gfa.links(gfa_lines(spark, sf_dir)).groupBy("overlap").agg(F.count("*").alias("links"))


@query("gfa_walks", "SELECT conv_id::VARCHAR AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS ord, role AS seg, turn % 2 = 0 AS fwd FROM conversations")
def gfa_walks(spark, sf_dir):
    return gfa.walks(gfa_lines(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


@query("gfa_round_trip", "SELECT count(*) AS segments FROM part")
def gfa_round_trip(spark, sf_dir):
    lines = gfa_lines(spark, sf_dir)
    line = lambda df: df.select(F.concat_ws("\t", "name", "seq", F.array_join("tags", "\t")).alias("line"))
    back = gfa.segments(gfa.to_lines(gfa.segments(lines), gfa.links(lines)))
    return line(back).join(line(gfa.segments(lines)).distinct(), "line", "left_semi").agg(F.count("*").alias("segments"))


@query("sample_sheet_dups", "SELECT c_mktsegment AS sample, count(*) AS rows FROM customer GROUP BY 1 HAVING count(*) > 1")
def sample_sheet_dups(spark, sf_dir):
    return Tables(spark, sf_dir).customer.groupBy(F.col("c_mktsegment").alias("sample")).agg(F.count("*").alias("rows")).where("rows > 1")


@query("seed_library_missing", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def seed_library_missing(spark, sf_dir):
    """Keys without seeds of their own, which take the library's."""
    t = Tables(spark, sf_dir)
    have = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return t.nation.join(have, "n_nationkey", "left_anti").select("n_nationkey")


@query("json_report_fields", "SELECT event_type, count(json_extract(props, '$')) AS parsed, count(DISTINCT json_extract_string(props, '$.page')) AS pages FROM events GROUP BY 1")
def json_report_fields(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy("event_type").agg(F.count(F.try_parse_json("props")).alias("parsed"), F.countDistinct(F.get_json_object("props", "$.page")).alias("pages"))


@query("result_rollup", "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS runs, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def result_rollup(spark, sf_dir):
    r = Tables(spark, sf_dir).orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return r.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "runs", "total")


@query("admission_outcomes", "WITH r AS (SELECT doc_id, sha256(text) AS s, length(text) AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents), u AS (SELECT *, CASE WHEN k = 1 THEN sum(n) FILTER (k = 1) OVER (ORDER BY doc_id) END AS upto FROM r) SELECT CASE WHEN k > 1 THEN 'already recruited' WHEN upto > 200000 THEN 'base cap' ELSE 'admitted' END AS outcome, count(*) AS records FROM u GROUP BY 1")
def admission_outcomes(spark, sf_dir):
    """Records in order of id: repeats of one admitted, admitted, or beyond the base cap."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s"), F.length("text").alias("n"))
    r = d.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("doc_id")))
    first = r.where("k = 1")
    # running bases in two levels: within blocks of ids, then over blocks
    block = F.floor(F.col("doc_id") / 1000)
    w = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inner = first.withColumn("block", block).withColumn("here", F.sum("n").over(w))
    before = inner.groupBy("block").agg(F.sum("n").alias("m")).select("block", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = inner.join(before, "block").select(F.when(F.col("before") + F.col("here") > 200000, "base cap").otherwise("admitted").alias("outcome"))
    again = r.where("k > 1").select(F.lit("already recruited").alias("outcome"))
    return placed.unionByName(again).groupBy("outcome").agg(F.count("*").alias("records"))


PAF = "p AS (SELECT l_suppkey AS query, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e, (l_quantity::BIGINT - l_linenumber % 3) AS matches, l_quantity::BIGINT AS block, l_returnflag, l_extendedprice::BIGINT AS score FROM lineitem)"


def paf(spark, sf_dir):
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    q = F.col("l_quantity").cast("long")
    return Tables(spark, sf_dir).lineitem.select(F.col("l_suppkey").alias("query"), day.alias("start"), (day + q).alias("end"), (q - F.col("l_linenumber") % 3).alias("matches"), q.alias("block"))


@query("paf_score", f"WITH {PAF}, m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY query ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM p), n AS (SELECT *, sum(new) OVER (PARTITION BY query ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT query, sum(e - s)::BIGINT AS covered FROM (SELECT query, g, min(s) AS s, max(e) AS e FROM n GROUP BY ALL) GROUP BY 1) SELECT query, sum(block)::BIGINT AS aligned, sum(matches)::BIGINT AS matches, covered, round(sum(matches)::DOUBLE / sum(block), 9) AS identity FROM p JOIN u USING (query) GROUP BY query, covered")
def paf_score(spark, sf_dir):
    return A.score(paf(spark, sf_dir)).withColumn("identity", F.round("identity", 9))


@query("best_alignment_competition", "WITH b AS (SELECT l_orderkey AS query, max(l_extendedprice) FILTER (l_returnflag = 'A') AS a, max(l_extendedprice) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) SELECT query, CASE WHEN b IS NULL THEN 'a only' WHEN a IS NULL THEN 'b only' WHEN a >= b + 10 THEN 'a' WHEN b >= a + 10 THEN 'b' ELSE 'tie' END AS verdict FROM b")
def best_alignment_competition(spark, sf_dir):
    s = Tables(spark, sf_dir).lineitem.where("l_returnflag in ('A', 'R')").select(F.col("l_orderkey").alias("query"), F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("grp"), F.col("l_extendedprice").alias("score"))
    return A.compete(s, 10)


@query("missing_links", "WITH n AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem), e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem) SELECT a, b, count(*) AS reads FROM n WHERE b IS NOT NULL AND (a, b) NOT IN (SELECT (a, b) FROM e) GROUP BY ALL")
def missing_links(spark, sf_dir):
    """Adjacent alignments of a read whose link the graph lacks."""
    t = Tables(spark, sf_dir).lineitem
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    n = t.select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(w).alias("b")).where("b is not null")
    have = t.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).distinct()
    return n.groupBy("a", "b").agg(F.count("*").alias("reads")).join(have, ["a", "b"], "left_anti")


@query("gap_lengths", "WITH g AS (SELECT l_orderkey, epoch(l_shipdate)::BIGINT // 86400 - lag(epoch(l_shipdate)::BIGINT // 86400) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS gap FROM lineitem) SELECT gap, count(*) AS reads FROM g WHERE gap IS NOT NULL GROUP BY 1")
def gap_lengths(spark, sf_dir):
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    t = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_shipdate", "l_linenumber", day.alias("day"))
    return t.select((F.col("day") - F.lag("day").over(w)).alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("reads"))


@query("span_sufficiency", "SELECT p_size AS need, count(*) FILTER (n >= p_size * 1000) AS reads FROM (SELECT DISTINCT p_size FROM part), (SELECT length(text) AS n FROM documents) GROUP BY 1")
def span_sufficiency(spark, sf_dir):
    """Reads long enough for each route's length: a cumulative count over both, not a product."""
    t = Tables(spark, sf_dir)
    need = t.part.select((F.col("p_size") * 1000).cast("long").alias("at"), "p_size").distinct()
    have = t.documents.groupBy(F.length("text").cast("long").alias("at")).agg(F.count("*").alias("m"))
    both = need.select("at", "p_size", F.lit(0).cast("long").alias("m")).unionByName(have.select("at", F.lit(None).cast("int").alias("p_size"), "m"))
    upto = both.withColumn("reads", F.sum("m").over(Window.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)))
    return upto.where("p_size is not null").select(F.col("p_size").alias("need"), "reads")


@query("edit_distance_limit", "SELECT c_custkey, o_orderkey, levenshtein(c_name, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0'))::INT AS edits FROM orders JOIN customer ON o_custkey = c_custkey WHERE levenshtein(c_name, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')) <= 3")
def edit_distance_limit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    other = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", F.levenshtein("c_name", other, 3).alias("edits"))
    return j.where("edits >= 0")


PLACE = "d AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) = 12), q AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) = 12)"


@query("hash_placements", f"WITH {PLACE} SELECT q.w AS query, d.w AS target, hamming(q.w, d.w)::INT AS differing FROM q, d WHERE hamming(q.w, d.w) <= 2")
def hash_placements(spark, sf_dir):
    """Words of twelve letters of passages and documents that differ in at most two places, through blocks they must share."""
    t = Tables(spark, sf_dir)
    words = lambda df: df.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") == 12).distinct().withColumn("id", F.col("word"))
    return A.placements(words(t.benchmark), words(t.documents), 12, 2)


@query("component_decide", "WITH s AS (SELECT l_suppkey AS component, count(*) FILTER (l_returnflag = 'A') AS genes, count(*) FILTER (l_returnflag = 'R') AS others, avg(l_quantity) AS depth FROM lineitem GROUP BY 1), r AS (SELECT component AS ref, depth AS rd FROM s WHERE genes > 0 ORDER BY genes DESC, depth DESC, component LIMIT 1), j AS (SELECT *, CASE WHEN ref IS NULL THEN 'no reference' WHEN component = ref THEN 'reference' WHEN depth IS NULL THEN 'no depth' WHEN genes = 0 AND others >= 5 THEN 'other only' WHEN depth < rd / 2 THEN 'depth below' WHEN depth > rd * 2 THEN 'depth above' ELSE 'keep' END AS reason FROM s LEFT JOIN r ON true) SELECT component, reason IN ('no reference', 'reference', 'no depth', 'keep') AS keep, reason FROM j")
def component_decide(spark, sf_dir):
    s = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_suppkey").alias("component")).agg(F.count_if(F.col("l_returnflag") == "A").alias("genes"), F.count_if(F.col("l_returnflag") == "R").alias("others"), F.avg("l_quantity").alias("depth"))
    return A.decide_components(s)


@query("set_call", "WITH g AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN a >= 5 AND a / n >= 0.3::DOUBLE AND (NOT (b >= 5 AND b / n >= 0.3::DOUBLE) OR a >= 2 * b) THEN 'plastid' WHEN b >= 5 AND b / n >= 0.3::DOUBLE AND (NOT (a >= 5 AND a / n >= 0.3::DOUBLE) OR b >= 2 * a) THEN 'mitochondrion' WHEN a >= 5 AND b >= 5 AND a / n >= 0.3::DOUBLE AND b / n >= 0.3::DOUBLE THEN 'mixed' ELSE 'none' END AS call FROM g")
def set_call(spark, sf_dir):
    g = Tables(spark, sf_dir).lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"), F.count("*").alias("n"))
    g = g.withColumn("da", F.col("a") / F.col("n")).withColumn("db", F.col("b") / F.col("n"))
    return g.select("l_partkey", A.set_call("a", "da", "b", "db").alias("call"))


@query("retained_examples", "WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) SELECT source, lang, count(*) AS records, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 8) AS examples FROM r GROUP BY ALL")
def retained_examples(spark, sf_dir):
    """Counts by reason with up to eight examples, ranked before they are gathered."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    r = Tables(spark, sf_dir).documents.select("source", "lang", "doc_id", F.row_number().over(w).alias("k"))
    some = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= 8, F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return r.groupBy("source", "lang").agg(F.count("*").alias("records"), some.alias("examples"))


@query("multi_pattern_screen", "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, (CASE WHEN contains(t, 'licensed') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'token') THEN 2 ELSE 0 END + CASE WHEN contains(t, '@') THEN 4 ELSE 0 END)::INT AS mask FROM d WHERE contains(t, 'licensed') OR contains(t, 'token') OR contains(t, '@')")
def multi_pattern_screen(spark, sf_dir):
    patterns = ("licensed", "token", "@")
    t = F.lower("text")
    mask = sum((F.when(F.contains(t, F.lit(p)), 1 << i).otherwise(0) for i, p in enumerate(patterns)), F.lit(0))
    return Tables(spark, sf_dir).documents.select("doc_id", mask.alias("mask")).where("mask > 0")


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    return E.tumbling(Tables(spark, sf_dir).events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("window_sliding", "WITH w AS (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY 1")
def window_sliding(spark, sf_dir):
    return E.sliding(Tables(spark, sf_dir).events).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("window_session", "WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def window_session(spark, sf_dir):
    return E.sessions(Tables(spark, sf_dir).events).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("label_majority", "WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, CASE WHEN a + b < 3 THEN 'few' WHEN a > b THEN 'good' WHEN b > a THEN 'bad' ELSE 'tie' END AS label FROM c")
def label_majority(spark, sf_dir):
    """A group's label by majority, with a least number."""
    t = Tables(spark, sf_dir)
    c = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b"))
    return c.select("source", F.when(F.col("a") + F.col("b") < 3, "few").when(F.col("a") > F.col("b"), "good").when(F.col("b") > F.col("a"), "bad").otherwise("tie").alias("label"))


@query("url_crop", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, substr(html, greatest(1, strpos(html, '<title>') - 5), 40) AS crop FROM pages WHERE strpos(html, '<title>') > 0")
def url_crop(spark, sf_dir):
    """A span with flanks, cut out of its record."""
    p = Tables(spark, sf_dir).pages
    at = F.instr("html", "<title>")
    return p.where(at > 0).select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.substring("html", F.greatest(F.lit(1), at - 5), F.lit(40)).alias("crop"))


@query("unit_shares", "SELECT source, round(avg(('0x' || substr(md5(doc_id::VARCHAR || '!'), 1, 15))::BIGINT / 1152921504606846976.0), 9) AS mean FROM documents GROUP BY 1")
def unit_shares(spark, sf_dir):
    """Mean unit hash of each source: close to a half for any fair sample."""
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.round(F.avg(seqs.unit_hash(F.col("doc_id"), "!")), 9).alias("mean"))
