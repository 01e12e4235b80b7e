"""Queries of graph operators: customers, nations and parts as segments, conversations as walks, orders as links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seqs
from ..storage import checkpointed
from ..operators import graph as G
from ..operators import kmers as K
from .registry import READS, Tables, query, words_sql
from .sequences import reads_of


def writer(spark):
    return checkpointed


#: Oriented links between suppliers, read off line items.
LINKS = "l AS (SELECT DISTINCT l_suppkey AS a, l_linenumber % 2 = 0 AS af, l_partkey % 100 AS b, l_quantity::INT % 2 = 0 AS bf FROM lineitem)"
BOTH = LINKS + ", e AS (SELECT a, af, b, bf FROM l UNION SELECT b, NOT bf, a, NOT af FROM l)"


def links(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem
    return t.select(F.col("l_suppkey").alias("a"), (F.col("l_linenumber") % 2 == 0).alias("a_fwd"), (F.col("l_partkey") % 100).alias("b"), (F.col("l_quantity").cast("int") % 2 == 0).alias("b_fwd")).distinct()


@query("link_canonical", f"WITH {LINKS}, c AS (SELECT DISTINCT CASE WHEN (a, af, b, bf) <= (b, NOT bf, a, NOT af) THEN (a, af, b, bf) ELSE (b, NOT bf, a, NOT af) END AS k FROM l) SELECT count(*) AS links, (SELECT count(*) FROM l) AS lines FROM c")
def link_canonical(spark, sf_dir):
    """Links that are one in either reading."""
    e = links(spark, sf_dir)
    return e.agg(F.countDistinct(G.canonical_link("a", "a_fwd", "b", "b_fwd")).alias("links"), F.count("*").alias("lines"))


@query("degree_repeats", f"WITH {BOTH}, d AS (SELECT a, af, count(DISTINCT (b, bf)) AS n FROM e GROUP BY ALL) SELECT a AS seg, sum(CASE WHEN NOT af THEN n ELSE 0 END)::BIGINT AS entries, sum(CASE WHEN af THEN n ELSE 0 END)::BIGINT AS exits FROM d GROUP BY 1 HAVING sum(CASE WHEN NOT af THEN n ELSE 0 END) >= 2 OR sum(CASE WHEN af THEN n ELSE 0 END) >= 2")
def degree_repeats(spark, sf_dir):
    return G.degrees(links(spark, sf_dir)).where("entries >= 2 or exits >= 2")


#: Links from each order of a customer to the next.
ORDER_EDGES = "e AS (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)"
#: A small, dense graph of customers' and orders' classes.
DENSE_EDGES = "e AS (SELECT DISTINCT o_custkey % 300 AS a, (o_orderkey * 7) % 300 AS b FROM orders)"


def order_edges(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")


def dense_edges(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select((F.col("o_custkey") % 300).alias("a"), ((F.col("o_orderkey") * 7) % 300).alias("b")).distinct()


@query("bubble_sites", f"WITH {DENSE_EDGES}, t AS (SELECT DISTINCT x.a AS l, x.b AS v, y.b AS r FROM e x JOIN e y ON x.b = y.a WHERE x.a <> x.b AND x.b <> y.b AND x.a <> y.b), n AS (SELECT l, r, count(*) AS n FROM t GROUP BY ALL) SELECT l AS left, r AS right, n + (EXISTS (SELECT 1 FROM e WHERE a = l AND b = r))::INT AS alleles FROM n WHERE n + (EXISTS (SELECT 1 FROM e WHERE a = l AND b = r))::INT >= 2".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def bubble_sites(spark, sf_dir):
    return G.bubbles(dense_edges(spark, sf_dir))


@query("connected_components", f"WITH RECURSIVE {ORDER_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root <= u.b) SELECT node, min(root) AS root FROM r GROUP BY 1")
def connected_components(spark, sf_dir):
    return G.components(order_edges(spark, sf_dir), writer(spark))


@query("frontier_closure", f"WITH RECURSIVE {ORDER_EDGES}, r(node) AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r")
def frontier_closure(spark, sf_dir):
    """Nodes that directed links reach from the seeds."""
    seeds = Tables(spark, sf_dir).orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))
    return G.reachable(order_edges(spark, sf_dir), seeds, writer(spark)).select("node")


@query("unitig_compact")
def unitig_compact(spark, sf_dir):
    u = G.unitigs(order_edges(spark, sf_dir), writer(spark))
    return u.groupBy("head", "circular").agg(F.count("*").alias("nodes"))


@query("dbg_edges", f"WITH {READS}, {words_sql('k', 'reads', 'doc_id', 11, False)}, n AS (SELECT w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos AS d FROM k) SELECT c, count(*) AS edges FROM (SELECT a, b, count(*) AS c FROM n WHERE d = 1 GROUP BY ALL) GROUP BY 1")
def dbg_edges(spark, sf_dir):
    """De Bruijn links by how often adjacent words follow each other; packed words need no window: the next one is a word of k + 1."""
    words = K.kmers(reads_of(spark, sf_dir), 12, canonical=False)
    return words.groupBy("kmer").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("edges"))


@query("dbg_edge_filter", f"WITH {READS}, {words_sql('n', 'reads', 'doc_id', 9, False)}, {words_sql('m', 'reads', 'doc_id', 10, False)}, c AS (SELECT w, count(*) AS c FROM n GROUP BY 1), g AS (SELECT w, count(*) AS g FROM m GROUP BY 1), j AS (SELECT g, least(x.c, y.c) AS low FROM g JOIN c x ON x.w = left(g.w, 9) JOIN c y ON y.w = right(g.w, 9)) SELECT count(*) AS edges, count(*) FILTER (g >= 20 OR g >= 3 AND g >= 0.35::DOUBLE * low) AS kept FROM j")
def dbg_edge_filter(spark, sf_dir):
    """Links kept: often enough, or three times and a share of their rarer end."""
    reads = reads_of(spark, sf_dir)
    nodes = K.kmers(reads, 9, canonical=False).groupBy("kmer").agg(F.count("*").alias("c"))
    edges = K.kmers(reads, 10, canonical=False).groupBy("kmer").agg(F.count("*").alias("g")).select("g", F.shiftright("kmer", 2).alias("a"), F.col("kmer").bitwiseAND(F.lit((1 << 18) - 1)).alias("b"))
    j = edges.join(nodes.toDF("a", "ca"), "a").join(nodes.toDF("b", "cb"), "b")
    keep = (F.col("g") >= 20) | (F.col("g") >= 3) & (F.col("g") >= F.lit(0.35) * F.least("ca", "cb"))
    return j.agg(F.count("*").alias("edges"), F.count_if(keep).alias("kept"))


STEPS = "w AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS f, string_agg(role, '>' ORDER BY turn DESC, role DESC) AS b FROM conversations GROUP BY 1)"


@query("walk_canonical", f"WITH {STEPS} SELECT least(f, b) AS walk, count(*) AS molecules FROM w GROUP BY 1")
def walk_canonical(spark, sf_dir):
    w = G.canonical_walks(Tables(spark, sf_dir).conversations, "conv_id", "turn", "role")
    return w.groupBy("walk").agg(F.count("*").alias("molecules"))


@query("walk_rotation", "WITH w AS (SELECT conv_id, list(role ORDER BY turn, role) AS l FROM conversations GROUP BY 1), r AS (SELECT conv_id, array_to_string(l[i + 1:] || l[:i], '>') AS s FROM (SELECT conv_id, l, unnest(range(0, len(l))) AS i FROM w)), m AS (SELECT conv_id, min(s) AS walk FROM r GROUP BY 1) SELECT walk, count(*) AS circles FROM m GROUP BY 1")
def walk_rotation(spark, sf_dir):
    """Circles by their least rotation."""
    w = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("l"))
    turned = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.array_join(F.concat(F.slice("l", i + 1, F.size("l")), F.slice("l", F.lit(1), i)), ">"))
    return w.select(F.array_min(turned).alias("walk")).groupBy("walk").agg(F.count("*").alias("circles"))


@query("traversal_counts", "WITH t AS (SELECT conv_id, lag(role) OVER w AS a, role AS r, lead(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) SELECT r AS repeat, least(a, b) AS one, greatest(a, b) AS two, count(DISTINCT conv_id) AS reads FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL")
def traversal_counts(spark, sf_dir):
    """Ways through a segment, in either reading, each read once."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    t = Tables(spark, sf_dir).conversations.select("conv_id", F.lag("role").over(w).alias("a"), F.col("role").alias("repeat"), F.lead("role").over(w).alias("b")).where("a is not null and b is not null")
    return t.groupBy("repeat", F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two")).agg(F.countDistinct("conv_id").alias("reads"))


@query("circular_neighbours", "WITH t AS (SELECT conv_id, turn, role, coalesce(lead(role) OVER w, first_value(role) OVER w) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) SELECT role, next, count(*) AS steps FROM t GROUP BY ALL")
def circular_neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    t = Tables(spark, sf_dir).conversations.select("role", F.coalesce(F.lead("role").over(w), F.first("role").over(w)).alias("next"))
    return t.groupBy("role", "next").agg(F.count("*").alias("steps"))


@query("thread_evidence", "WITH w AS (SELECT conv_id, count(DISTINCT turn) AS steps, md5(string_agg(text, '|' ORDER BY turn, text)) AS record FROM conversations GROUP BY 1) SELECT steps, count(DISTINCT record) AS unique_records, count(*) - count(DISTINCT record) AS duplicates FROM w GROUP BY 1")
def thread_evidence(spark, sf_dir):
    """Walks that single records witness; repeated records count once."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "|")
    w = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.countDistinct("turn").alias("steps"), F.md5(joined.cast("binary")).alias("record"))
    return w.groupBy("steps").agg(F.countDistinct("record").alias("unique_records"), (F.count("*") - F.countDistinct("record")).alias("duplicates"))


@query("link_support", "SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS reads, count(*) - count(DISTINCT l_orderkey) AS again FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2")
def link_support(spark, sf_dir):
    g = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_orderkey").alias("reads"), F.count("*").alias("n"))
    return g.where("reads >= 2").select("l_suppkey", "l_partkey", "reads", (F.col("n") - F.col("reads")).alias("again"))


@query("competitive_assign", "WITH s AS (SELECT l_orderkey, l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey)) SELECT l_orderkey, CASE WHEN second IS NULL OR score >= second + greatest(10, second // 20) THEN l_suppkey END AS winner FROM r WHERE r = 1")
def competitive_assign(spark, sf_dir):
    s = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("score"))
    return G.pick_winner(s, ["l_orderkey"], "l_suppkey", "score")


@query("anchor_spans", "WITH s AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER w AS b, epoch(lead(l_shipdate) OVER w)::BIGINT // 86400 - epoch(l_shipdate)::BIGINT // 86400 AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey)) SELECT a, b, count(*) AS spans, min(d) AS shortest, max(d) AS longest FROM s WHERE b IS NOT NULL GROUP BY ALL")
def anchor_spans(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_suppkey")
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    t = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_shipdate", "l_linenumber", "l_suppkey", day.alias("day"))
    s = t.select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(w).alias("b"), (F.lead("day").over(w) - F.col("day")).alias("d")).where("b is not null")
    return s.groupBy("a", "b").agg(F.count("*").alias("spans"), F.min("d").alias("shortest"), F.max("d").alias("longest"))


@query("cut_pieces", "WITH c AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role) AS piece FROM conversations), p AS (SELECT conv_id, piece, string_agg(role, '>' ORDER BY turn, role) AS path FROM c GROUP BY ALL) SELECT path, count(*) AS pieces FROM p GROUP BY 1")
def cut_pieces(spark, sf_dir):
    """Walks cut before every undecided step, as paths."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    c = Tables(spark, sf_dir).conversations.withColumn("piece", F.sum((F.col("role") == "user").cast("int")).over(w))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return c.groupBy("conv_id", "piece").agg(path.alias("path")).groupBy("path").agg(F.count("*").alias("pieces"))


@query("phase_classes", "WITH p AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS entry, l_linenumber AS exit_ FROM lineitem), e AS (SELECT node, max(n) AS most, min(n) AS least FROM (SELECT node, entry, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), x AS (SELECT node, max(n) AS most FROM (SELECT node, exit_, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1) SELECT CASE WHEN e.most = 1 AND x.most = 1 THEN 'resolved' WHEN e.least = 1 THEN 'partial' ELSE 'mixed' END AS phase, count(*) AS nodes FROM e JOIN x USING (node) GROUP BY 1")
def phase_classes(spark, sf_dir):
    """Repeat nodes by how their entries and exits pair up."""
    p = Tables(spark, sf_dir).lineitem.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("entry"), F.col("l_linenumber").alias("exit")).distinct()
    e = p.groupBy("node", "entry").count().groupBy("node").agg(F.max("count").alias("most"), F.min("count").alias("least"))
    x = p.groupBy("node", "exit").count().groupBy("node").agg(F.max("count").alias("exits"))
    phase = F.when((F.col("most") == 1) & (F.col("exits") == 1), "resolved").when(F.col("least") == 1, "partial").otherwise("mixed")
    return e.join(x, "node").groupBy(phase.alias("phase")).agg(F.count("*").alias("nodes"))


@query("exit_scores", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT o_custkey, n::DOUBLE / sum(n) OVER (PARTITION BY o_custkey) AS f FROM c) SELECT o_custkey, round(sum(ln(greatest(f, 1e-9))), 6) AS score FROM f GROUP BY 1")
def exit_scores(spark, sf_dir):
    """Score of a path: summed logs of the exits' shares."""
    c = Tables(spark, sf_dir).orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    f = c.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("o_custkey")))
    return f.groupBy("o_custkey").agg(F.round(F.sum(F.log(F.greatest("f", F.lit(1e-9)))), 6).alias("score"))


@query("graph_fingerprint", f"WITH {LINKS} SELECT sha256(string_agg(a || ' ' || af || ' ' || b || ' ' || bf, ';' ORDER BY a, af, b, bf)) AS fingerprint FROM l")
def graph_fingerprint(spark, sf_dir):
    """Order-independent digest of a graph (its links come together in sorted order, once)."""
    rows = F.sort_array(F.collect_list(F.struct("a", "a_fwd", "b", "b_fwd")))
    line = F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", r["a"].cast("string"), r["a_fwd"].cast("string"), r["b"].cast("string"), r["b_fwd"].cast("string"))), ";")
    return links(spark, sf_dir).agg(F.sha2(line.cast("binary"), 256).alias("fingerprint"))


@query("junction_spans", f"WITH {READS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, right(a.seq, 100) || left(b.seq, 100) AS s FROM reads a JOIN reads b ON b.doc_id = a.doc_id + 1) SELECT a, b, md5(least(s, reverse(translate(s, 'ACGT', 'TGCA')))) AS signature FROM p")
def junction_spans(spark, sf_dir):
    """Flank, overlap, flank of a junction, by the lesser strand."""
    r = reads_of(spark, sf_dir)
    left = r.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.right("seq", F.lit(100)).alias("x"))
    right = r.select(F.col("doc_id").alias("b"), F.left("seq", F.lit(100)).alias("y"))
    return left.join(right, "b").select("a", "b", F.md5(seqs.canonical(F.concat("x", "y")).cast("binary")).alias("signature"))
