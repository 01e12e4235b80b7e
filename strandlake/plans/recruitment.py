"""Queries of recruitment: documents as reads, benchmark passages as seeds of eight targets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seqs
from ..functions.md5_words import stable_hash
from ..storage import checkpointed
from ..operators import kmers as K
from ..operators import recruit as R
from ..operators import superwords as S
from .registry import PASSAGES, READS, Tables, query, words_sql
from .sequences import MD5, reads_of, shares_of

TARGETS, WORD, GAP = 8, 21, 50
#: Words of all reads and of all seeds, with the target mask of each seed word.
BASE = f"WITH {READS}, {PASSAGES}, {words_sql('k', 'reads', 'doc_id', WORD)}, {words_sql('s', 'passages', 'item_id', WORD)}, bait AS (SELECT w, bit_or(1 << (item_id % 8)::INT) AS mask FROM s GROUP BY 1)"
HITS = BASE + ", h AS (SELECT doc_id, pos, t AS target FROM k JOIN bait USING (w), range(8) r(t) WHERE (mask >> t::INT) & 1 = 1)"
BLOCKS = HITS + f""", m AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id, target ORDER BY pos) + {WORD + GAP} THEN 1 ELSE 0 END AS new FROM h),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, target ORDER BY pos) AS block FROM m), e AS (SELECT doc_id, target, block, count(*) AS n, max(pos) + {WORD} - min(pos) AS len FROM n GROUP BY ALL),
b AS (SELECT doc_id, target, sum(n)::BIGINT AS hits, sum(len)::BIGINT AS cover, max(len) AS longest FROM e GROUP BY ALL)"""
CALLS = BLOCKS + """, best AS (SELECT doc_id, bit_or(1 << target::INT) AS mask, min(target) AS first, max(cover) AS cover, max(hits) AS hits, max(longest) AS longest FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY cover DESC, hits DESC) AS r FROM b) WHERE r = 1 GROUP BY 1),
t AS (SELECT doc_id, count(*) AS kmers FROM k GROUP BY 1), c AS (SELECT doc_id, length(seq) AS len, coalesce(cover, 0) AS cover, coalesce(hits, 0) AS hits, mask, first,
 CASE WHEN cover >= length(seq) * 0.8::DOUBLE AND hits >= coalesce(kmers, 0) * 0.2::DOUBLE THEN 'organelle' WHEN longest >= 1000 THEN 'candidate' ELSE 'other' END AS call FROM reads LEFT JOIN t USING (doc_id) LEFT JOIN best USING (doc_id)),
calls AS (SELECT doc_id, call, (CASE call WHEN 'organelle' THEN mask WHEN 'candidate' THEN 1 << first::INT ELSE 0 END)::INT AS mask, len, cover, hits FROM c)"""


def words_of(spark, sf_dir):
    return K.kmers(reads_of(spark, sf_dir), WORD).select("doc_id", "pos", "kmer")


def bait_of(spark, sf_dir):
    seeds = seqs.project_reads(Tables(spark, sf_dir).benchmark.withColumnRenamed("item_id", "doc_id"))
    return R.bait_of(seeds, F.col("doc_id") % TARGETS, WORD)


def blocks_of(spark, sf_dir):
    return R.target_hits(words_of(spark, sf_dir), bait_of(spark, sf_dir), TARGETS, WORD, GAP)


def calls_of(spark, sf_dir):
    words = words_of(spark, sf_dir)
    totals = words.groupBy("doc_id").agg(F.count("*").alias("kmers"))
    return R.calls(reads_of(spark, sf_dir), totals, R.best_targets(blocks_of(spark, sf_dir)))


@query("bait_mask_union", BASE + " SELECT mask::INT AS mask, count(*) AS kmers FROM bait GROUP BY 1")
def bait_mask_union(spark, sf_dir):
    return bait_of(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("kmers"))


@query("read_target_hits", HITS + " SELECT doc_id, target, count(*) AS hits FROM h GROUP BY ALL")
def read_target_hits(spark, sf_dir):
    return R.hits(words_of(spark, sf_dir), bait_of(spark, sf_dir), TARGETS).groupBy("doc_id", F.col("target").cast("long").alias("target")).agg(F.count("*").alias("hits"))


@query("block_cover", BLOCKS + " SELECT * FROM b")
def block_cover(spark, sf_dir):
    return blocks_of(spark, sf_dir).withColumn("target", F.col("target").cast("long"))


@query("read_multi_target", CALLS + " SELECT doc_id, mask::INT AS mask, bit_count(mask)::INT AS targets, cover, hits FROM best")
def read_multi_target(spark, sf_dir):
    return R.best_targets(blocks_of(spark, sf_dir)).select("doc_id", "mask", F.bit_count("mask").alias("targets"), "cover", "hits")


@query("read_call", CALLS + " SELECT * FROM calls")
def read_call(spark, sf_dir):
    return calls_of(spark, sf_dir).withColumn("len", F.col("len").cast("long"))


@query("recruit_pass1", CALLS + " SELECT call, mask, count(*) AS reads, sum(len)::BIGINT AS bases, sum(cover)::BIGINT AS cover, sum(hits)::BIGINT AS hits FROM calls GROUP BY ALL")
def recruit_pass1(spark, sf_dir):
    """One pass over all reads: calls by target mask."""
    return calls_of(spark, sf_dir).groupBy("call", "mask").agg(F.count("*").alias("reads"), *(F.sum(c).alias(a) for c, a in (("len", "bases"), ("cover", "cover"), ("hits", "hits"))))


@query("recruit_fixpoint")
def recruit_fixpoint(spark, sf_dir):
    """Passes until the bait takes in no more reads."""
    return R.fixpoint(reads_of(spark, sf_dir), bait_of(spark, sf_dir), TARGETS, WORD, checkpointed)


@query("bait_delta_semi", BASE + " SELECT doc_id, count(*) AS changed FROM k WHERE w IN (SELECT w FROM bait WHERE mask & 1 = 1) GROUP BY 1")
def bait_delta_semi(spark, sf_dir):
    """Reads that hold a word of one target's seeds."""
    delta = bait_of(spark, sf_dir).where("mask & 1 = 1")
    return words_of(spark, sf_dir).join(R.sized(delta), "kmer", "left_semi").groupBy("doc_id").agg(F.count("*").alias("changed"))


@query("bait_new_anti", BASE + ", hit AS (SELECT DISTINCT doc_id FROM k JOIN bait USING (w)) SELECT doc_id, count(DISTINCT w) AS new_kmers FROM k WHERE doc_id IN (SELECT doc_id FROM hit) AND w NOT IN (SELECT w FROM bait) GROUP BY 1")
def bait_new_anti(spark, sf_dir):
    """Words that the bait lacks, of reads that it hits."""
    words, bait = words_of(spark, sf_dir), R.sized(bait_of(spark, sf_dir))
    hit = words.join(bait, "kmer", "left_semi").select("doc_id").distinct()
    return words.join(hit, "doc_id", "left_semi").join(bait, "kmer", "left_anti").groupBy("doc_id").agg(F.countDistinct("kmer").alias("new_kmers"))


@query("kmer_distinct_share", BASE + f", e AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS d FROM k WHERE {MD5.format('w')} % 8 = 0 GROUP BY 1) SELECT doc_id, round(CASE WHEN coalesce(n, 0) < 20 THEN 1.0 ELSE d::DOUBLE / n END, 9) AS share FROM reads LEFT JOIN e USING (doc_id)")
def kmer_distinct_share(spark, sf_dir):
    """Share of distinct words in a hash-chosen eighth; 1 below twenty."""

    def summary(read, word, n):
        total, kinds = K.tallies(read, word, n)
        return {"n": total, "d": kinds}

    e = K.per_read(reads_of(spark, sf_dir), WORD, summary, "n long, d long", keep=lambda w: stable_hash(w, WORD) % 8 == 0)
    return e.select("doc_id", F.round(F.when(F.col("n") < 20, 1.0).otherwise(F.col("d") / F.col("n")), 9).alias("share"))


@query("kmer_solid", BASE + """, r AS (SELECT w, count(DISTINCT doc_id) AS n FROM k GROUP BY 1), hist AS (SELECT least(n, 4097) AS c, count(*) AS m FROM r GROUP BY 1),
x AS (SELECT c.c, coalesce(m, 0) AS m FROM range(1, 4098) c(c) LEFT JOIN hist h ON h.c = c.c), y AS (SELECT c, m, lag(m) OVER (ORDER BY c) AS p, lead(m) OVER (ORDER BY c) AS q FROM x),
v AS (SELECT coalesce(min(c), 3) AS valley FROM y WHERE c BETWEEN 3 AND 4096 AND m <= p AND m < q), z AS (SELECT c AS peak FROM x, v WHERE c >= valley ORDER BY m DESC, c DESC LIMIT 1),
t AS (SELECT greatest(2, floor(peak * 0.1::DOUBLE))::BIGINT AS threshold, valley, peak FROM z, v)
SELECT valley, peak, threshold, (SELECT count(*) FROM r, t WHERE n >= threshold) AS solid FROM t""")
def kmer_solid(spark, sf_dir):
    """Words that enough reads hold, each read counting once."""
    # a row for each number of reads that some word has
    per = checkpointed(S.spectrum(reads_of(spark, sf_dir), WORD, shares_of(spark, sf_dir), once=True), "solid")
    t = K.solid_threshold(per, 2, 0.1)
    # one row of thresholds
    return per.join(F.broadcast(t), F.col("n") >= F.col("threshold"), "right").groupBy("valley", "peak", "threshold").agg(F.coalesce(F.sum("kmers"), F.lit(0)).alias("solid"))


@query("containment_identity", BASE + f""", q AS (SELECT DISTINCT w FROM s), d AS (SELECT DISTINCT source, w FROM k JOIN documents USING (doc_id)), n AS (SELECT count(*) AS n FROM q),
f AS (SELECT source, count(*) AS found FROM d JOIN q USING (w) GROUP BY 1)
SELECT source, found, round(found::DOUBLE / n, 9) AS containment, round(power(found::DOUBLE / n, 1.0 / {WORD}), 9) AS identity, row_number() OVER (ORDER BY found DESC, source) AS rank FROM f, n""")
def containment_identity(spark, sf_dir):
    """Sources ranked by the share of the seeds' words that they hold, and the identity it stands for."""
    q = bait_of(spark, sf_dir).select("kmer")
    docs = Tables(spark, sf_dir).documents.select("doc_id", "source")
    found = words_of(spark, sf_dir).join(R.sized(q), "kmer", "left_semi").join(docs, "doc_id").select("source", "kmer").distinct().groupBy("source").agg(F.count("*").alias("found"))
    share = F.col("found") / F.col("n")
    out = found.join(F.broadcast(q.agg(F.count("*").alias("n"))), F.lit(True))
    rank = F.row_number().over(Window.orderBy(F.desc("found"), "source"))
    return out.select("source", "found", F.round(share, 9).alias("containment"), F.round(F.pow(share, F.lit(1.0 / WORD)), 9).alias("identity"), rank.alias("rank"))


@query("kmer_jaccard", BASE + """, d AS (SELECT DISTINCT lang, w FROM k JOIN documents USING (doc_id)), n AS (SELECT lang, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM d a JOIN d b ON a.w = b.w AND a.lang < b.lang GROUP BY ALL)
SELECT a, b, shared, round(shared::DOUBLE / (x.n + y.n - shared), 9) AS jaccard FROM p JOIN n x ON x.lang = a JOIN n y ON y.lang = b""")
def kmer_jaccard(spark, sf_dir):
    """Words shared between languages."""
    reads = seqs.project_reads(Tables(spark, sf_dir).documents, "lang").where("lang is not null")
    counts = checkpointed(S.shared(S.packets(reads, WORD, shares_of(spark, sf_dir), group="lang"), WORD), "jaccard").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # a row for each pair of languages, and one for each language with itself
    own = counts.where("a = b").select("a", "n")
    out = counts.where("a <> b").withColumnRenamed("n", "shared").join(own.toDF("a", "na"), "a").join(own.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 9).alias("jaccard"))


@query("kmer_multiset_agreement", BASE + """, c AS (SELECT w, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM k JOIN documents USING (doc_id) GROUP BY 1)
SELECT sum(least(a, b))::BIGINT AS shared, sum(a)::BIGINT AS first_total, sum(b)::BIGINT AS second_total FROM c""")
def kmer_multiset_agreement(spark, sf_dir):
    reads = seqs.project_reads(Tables(spark, sf_dir).documents.where("lang in ('en', 'fr')"), "lang")

    def f(groups):
        a, b = (groups.get(g, (np.zeros(0, np.int64),) * 2) for g in ("en", "fr"))
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        return {"shared": [int(np.minimum(a[1][i], b[1][j]).sum())], "first": [int(a[1].sum())], "second": [int(b[1].sum())]}

    c = S.counted(S.packets(reads, WORD, shares_of(spark, sf_dir), group="lang"), WORD, f, "shared long, first long, second long")
    return c.agg(F.sum("shared").alias("shared"), F.sum("first").alias("first_total"), F.sum("second").alias("second_total"))


@query("depth_features", BASE + """, sk AS (SELECT w, count(*) AS n FROM k GROUP BY 1), d AS (SELECT doc_id, w, n FROM k JOIN sk USING (w)),
a AS (SELECT doc_id, count(*) AS sampled, count(DISTINCT w) AS kinds, count(*) FILTER (n >= 2) AS deep FROM d GROUP BY 1),
o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM d WHERE n >= 2)
SELECT a.doc_id, sampled, round(kinds::DOUBLE / sampled, 9) AS distinct_share, max(n) FILTER (i = floor((deep - 1) * 0.5 + 0.5)) AS median,
 round((max(n) FILTER (i = floor((deep - 1) * 0.75 + 0.5)) - max(n) FILTER (i = floor((deep - 1) * 0.25 + 0.5)))::DOUBLE / max(n) FILTER (i = floor((deep - 1) * 0.5 + 0.5)), 9) AS spread
FROM a JOIN o USING (doc_id) GROUP BY ALL""")
def depth_features(spark, sf_dir):
    """Per read: words, distinct share, and nearest-rank median and spread of the counts that are two or more."""

    def f(read, n, distinct):
        size = len(distinct)
        sampled = np.bincount(read, minlength=size)
        deep = n >= 2
        r, c = read[deep], n[deep].astype(np.int64)
        bits = int(c.max(initial=0)).bit_length()
        c = np.sort((r << bits) | c) & ((1 << bits) - 1)
        m = np.bincount(r, minlength=size)
        begin = np.cumsum(m) - m
        rank = lambda q: c[(begin + np.floor((m - 1) * q + 0.5).astype(np.int64))[m > 0]]
        out = {name: np.zeros(size, np.int64) for name in ("q25", "q50", "q75")}
        for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            out[name][m > 0] = rank(q)
        return {"sampled": sampled, "kinds": distinct, **out}

    out = S.looked_up(reads_of(spark, sf_dir), WORD, shares_of(spark, sf_dir), f, "sampled long, kinds long, q25 long, q50 long, q75 long").where("q50 > 0")
    return out.select("doc_id", "sampled", F.round(F.col("kinds") / F.col("sampled"), 9).alias("distinct_share"), F.col("q50").alias("median"), F.round((F.col("q75") - F.col("q25")) / F.col("q50"), 9).alias("spread"))


@query("shared_kmer_blocks", BASE + f""", p AS (SELECT k.doc_id, s.item_id, k.pos, k.pos - s.pos AS diag FROM k JOIN s ON k.w = s.w AND (k.w = k.x) = (s.w = s.x)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY pos) AS g FROM p)
SELECT doc_id, item_id, diag, min(pos) AS start, max(pos) + {WORD} - min(pos) AS bases FROM r GROUP BY doc_id, item_id, diag, g""")
def shared_kmer_blocks(spark, sf_dir):
    """Diagonal runs that reads and passages share on the same strand."""
    reads = K.kmers(reads_of(spark, sf_dir), WORD)
    seeds = K.kmers(seqs.project_reads(Tables(spark, sf_dir).benchmark.withColumnRenamed("item_id", "doc_id")), WORD).select("kmer", "fwd", F.col("doc_id").alias("item_id"), F.col("pos").alias("at"))
    p = reads.join(R.sized(seeds), ["kmer", "fwd"]).select("doc_id", "item_id", "pos", (F.col("pos") - F.col("at")).alias("diag"))
    w = Window.partitionBy("doc_id", "item_id", "diag").orderBy("pos")
    r = p.withColumn("g", F.col("pos") - F.row_number().over(w))
    return r.groupBy("doc_id", "item_id", "diag", "g").agg(F.min("pos").alias("start"), (F.max("pos") + WORD - F.min("pos")).alias("bases")).drop("g")
