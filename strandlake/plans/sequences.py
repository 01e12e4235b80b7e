"""Queries on reads: scalar functions, words and their samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seqs
from ..functions.md5_words import stable_hash
from ..operators import kmers as K
from ..operators import superwords as S
from ..operators import translate
from .registry import READS, Tables, query, words_sql

MD5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def reads_of(spark, sf_dir):
    return seqs.project_reads(Tables(spark, sf_dir).documents)


def shares_of(spark, sf_dir):
    """Shares for the words of all reads, from the texts' sizes."""
    return S.shares_for(Tables(spark, sf_dir).documents, "text")


@query("seq_revcomp", f"WITH {READS} SELECT doc_id, length(seq)::INT AS len, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM reads")
def seq_revcomp(spark, sf_dir):
    return reads_of(spark, sf_dir).select("doc_id", F.length("seq").alias("len"), F.md5(seqs.revcomp(F.col("seq")).cast("binary")).alias("rc_md5"))


@query("kmer_canonical", f"WITH {READS}, {words_sql('k', 'reads', 'doc_id', 21)} SELECT doc_id, count(*) AS kmers, count(DISTINCT w) AS distinct_kmers, min(w) AS first_kmer, max(w) AS last_kmer FROM k GROUP BY 1")
def kmer_canonical(spark, sf_dir):
    """Words of each read, summed up where the read is packed."""

    def summary(read, word, n):
        total, kinds = K.tallies(read, word, n)
        some = np.flatnonzero(total)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = np.cumsum(total)[some]
        low[some], high[some] = word[ends - total[some]], word[ends - 1]
        return {"kmers": total, "distinct_kmers": kinds, "a": low, "b": high}

    out = K.per_read(reads_of(spark, sf_dir), 21, summary, "kmers long, distinct_kmers long, a long, b long").where("kmers > 0")
    return out.select("doc_id", "kmers", "distinct_kmers", seqs.unpack_kmer(F.col("a"), 21).alias("first_kmer"), seqs.unpack_kmer(F.col("b"), 21).alias("last_kmer"))


@query("kmer_strand", f"WITH {READS}, {words_sql('k', 'reads', 'doc_id', 31)} SELECT doc_id, count(*) FILTER (w = x) AS forward, count(*) FILTER (w <> x) AS reverse FROM k GROUP BY 1")
def kmer_strand(spark, sf_dir):
    return K.kmers(reads_of(spark, sf_dir), 31).groupBy("doc_id").agg(F.count_if("fwd").alias("forward"), F.count_if(~F.col("fwd")).alias("reverse"))


@query("forward_kmers", f"WITH {READS}, {words_sql('k', 'reads', 'doc_id', 9, False)} SELECT w AS word, count(*) AS n FROM k GROUP BY 1")
def forward_kmers(spark, sf_dir):
    words = K.kmers(reads_of(spark, sf_dir), 9, canonical=False).groupBy("kmer").count()
    return words.select(seqs.unpack_kmer(F.col("kmer"), 9).alias("word"), F.col("count").alias("n"))


@query("kmer_spectrum", f"WITH {READS}, {words_sql('k', 'reads', 'doc_id', 21)} SELECT n, count(*) AS kmers FROM (SELECT w, count(*) AS n FROM k GROUP BY 1) GROUP BY 1")
def kmer_spectrum(spark, sf_dir):
    return S.spectrum(reads_of(spark, sf_dir), 21, shares_of(spark, sf_dir))


@query("kmer_twice", f"WITH {READS}, {words_sql('k', 'reads', 'doc_id', 21)} SELECT count(*) AS kmers, sum(n)::BIGINT AS occurrences FROM (SELECT w, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2)")
def kmer_twice(spark, sf_dir):
    return S.spectrum(reads_of(spark, sf_dir), 21, shares_of(spark, sf_dir)).where("n >= 2").agg(F.coalesce(F.sum("kmers"), F.lit(0)).alias("kmers"), F.sum(F.col("n") * F.col("kmers")).alias("occurrences"))


@query("kmer_fracminhash", f"""WITH {READS}, {words_sql('k', 'reads', 'doc_id', 21)}
SELECT doc_id, count(*) AS sampled, count(DISTINCT w) AS distinct_sampled FROM k WHERE {MD5.format('w')} % 64 = 0 GROUP BY 1""")
def kmer_fracminhash(spark, sf_dir):
    """One word in 64, by its hash; only those are sorted."""

    def summary(read, word, n):
        total, kinds = K.tallies(read, word, n)
        return {"sampled": total, "distinct_sampled": kinds}

    return K.per_read(reads_of(spark, sf_dir), 21, summary, "sampled long, distinct_sampled long", keep=lambda w: stable_hash(w, 21) % 64 == 0).where("sampled > 0")


@query("syncmer_closed", f"""WITH {READS}, {words_sql('k', 'reads', 'doc_id', 7)}, h AS (SELECT doc_id, pos, {MD5.format('w')} AS h FROM k),
e AS (SELECT r.doc_id, p.pos, h.h FROM reads r, unnest(range(1, length(r.seq) - 5)) AS p(pos) LEFT JOIN h ON h.doc_id = r.doc_id AND h.pos = p.pos),
s AS (SELECT doc_id, pos, h, min(h) OVER a AS low, count(h) OVER a AS n, lead(h, 8) OVER (PARTITION BY doc_id ORDER BY pos) AS last
  FROM e WINDOW a AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))
SELECT doc_id, count(*) AS syncmers, sum(pos)::BIGINT AS place_sum FROM s WHERE n = 9 AND (low = h OR low = last) GROUP BY 1""")
def syncmer_closed(spark, sf_dir):
    """Words of 15 whose least word of 7, by hash, is their first or last; windows over a gap have fewer than nine."""
    words = K.kmers(reads_of(spark, sf_dir), 7)
    hashes = words.select("kmer").distinct().select("kmer", seqs.stable_hash(seqs.unpack_kmer(F.col("kmer"), 7)).alias("h"))
    # at most 4 ** 7 words: small enough to send to every task
    rows = words.join(F.broadcast(hashes), "kmer").select("doc_id", "pos", "h")
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = w.rangeBetween(0, 8)
    s = rows.select("doc_id", "pos", "h", F.min("h").over(ahead).alias("low"), F.count("*").over(ahead).alias("n"), F.lead("h", 8).over(w).alias("last"))
    return s.where("n = 9 and (low = h or low = last)").groupBy("doc_id").agg(F.count("*").alias("syncmers"), F.sum("pos").alias("place_sum"))


@query("hpc_runs", f"""WITH {READS}, c AS (SELECT doc_id, pos, substr(seq, pos, 1) AS b FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM reads)),
r AS (SELECT doc_id, pos, b, pos - row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS g FROM c), s AS (SELECT doc_id, b, g, count(*) AS n, min(pos) AS p0 FROM r GROUP BY ALL)
SELECT doc_id, count(*) AS runs, max(n) AS longest, md5(string_agg(b, '' ORDER BY p0)) AS hpc_md5 FROM s GROUP BY 1""")
def hpc_runs(spark, sf_dir):
    reads = reads_of(spark, sf_dir).where("seq <> ''")
    runs = F.transform(seqs.runs(F.col("seq")), lambda r: F.length(r))
    return reads.select("doc_id", F.size(runs).cast("long").alias("runs"), F.array_max(runs).cast("long").alias("longest"), F.md5(seqs.hpc(F.col("seq")).cast("binary")).alias("hpc_md5"))


@query("hpc_expand", f"WITH {READS} SELECT doc_id, true AS same FROM reads WHERE seq <> ''")
def hpc_expand(spark, sf_dir):
    """Runs of (base, length) spell the read again."""
    pairs = F.transform(seqs.runs(F.col("seq")), lambda r: F.struct(F.left(r, F.lit(1)).alias("b"), F.length(r).alias("n")))
    back = F.array_join(F.transform(pairs, lambda p: F.repeat(p["b"], p["n"])), "")
    return reads_of(spark, sf_dir).where("seq <> ''").select("doc_id", (back == F.col("seq")).alias("same"))


@query("minimizer_window", f"""WITH {READS}, c AS (SELECT doc_id, pos, substr(seq, pos, 1) AS b FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM reads)),
d AS (SELECT doc_id, pos, b, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM c), hr AS (SELECT doc_id, string_agg(b, '' ORDER BY pos) AS seq FROM d WHERE p IS NULL OR p <> b GROUP BY 1),
{words_sql('k', 'hr', 'doc_id', 15)}, s AS (SELECT doc_id, pos, w, min(w) OVER a AS low, count(*) OVER a AS n FROM k WINDOW a AS (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT doc_id, count(DISTINCT low) AS minimizers FROM s WHERE n = 5 GROUP BY 1""")
def minimizer_window(spark, sf_dir):
    """Least words of 15 in five consecutive ones of the compressed read."""
    words = K.kmers(reads_of(spark, sf_dir).withColumn("seq", seqs.hpc(F.col("seq"))), 15)
    ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(0, 4)
    s = words.select("doc_id", F.min("kmer").over(ahead).alias("low"), F.count("*").over(ahead).alias("n")).where("n = 5")
    return s.groupBy("doc_id").agg(F.countDistinct("low").alias("minimizers"))


@query("translate_six_frames", f"""WITH {READS}, strands AS (SELECT doc_id, 1 AS strand, seq FROM reads UNION ALL SELECT doc_id, -1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads),
f AS (SELECT doc_id, strand, unnest([0, 1, 2]) AS frame, seq FROM strands),
c AS (SELECT doc_id, strand, frame, i, substr(seq, frame + 3 * i + 1, 3) AS codon FROM (SELECT doc_id, strand, frame, seq, unnest(range(0, (length(seq) - frame) // 3)) AS i FROM f WHERE length(seq) >= frame + 3)),
g AS (SELECT *, codon IN ('TAA', 'TAG', 'TGA') AS stop, sum((codon IN ('TAA', 'TAG', 'TGA'))::INT) OVER (PARTITION BY doc_id, strand, frame ORDER BY i) AS part FROM c),
s AS (SELECT doc_id, strand, frame, part, count(*) AS n FROM g WHERE NOT stop GROUP BY ALL)
SELECT doc_id, strand, frame, count(*) AS stretches, max(n) AS longest FROM s WHERE n >= 80 GROUP BY ALL""")
def translate_six_frames(spark, sf_dir):
    """Stretches without a stop, of 80 residues or more, in all six frames."""
    s = translate.stretches(reads_of(spark, sf_dir), table=1, shortest=80)
    return s.groupBy("doc_id", "strand", "frame").agg(F.count("*").alias("stretches"), F.max("length").cast("long").alias("longest"))


@query("unit_hash_sample", """WITH u AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '#7'), 1, 15))::BIGINT / 1152921504606846976.0 AS unit FROM documents)
SELECT doc_id, round(unit, 9) AS unit FROM u WHERE unit < 0.1""")
def unit_hash_sample(spark, sf_dir):
    unit = seqs.unit_hash(F.col("doc_id"), "#7")
    return Tables(spark, sf_dir).documents.where(unit < 0.1).select("doc_id", F.round(unit, 9).alias("unit"))


@query("mate_sync_sample", f"SELECT conv_id, count(*) AS records FROM conversations WHERE {MD5.format('conv_id::VARCHAR')} % 5 = 0 GROUP BY 1")
def mate_sync_sample(spark, sf_dir):
    """One in five fragments, with all of their records."""
    return Tables(spark, sf_dir).conversations.where(seqs.stable_hash(F.col("conv_id")) % 5 == 0).groupBy("conv_id").agg(F.count("*").alias("records"))


@query("nested_subsample", f"""WITH u AS (SELECT doc_id, length(text) AS n, {MD5.format('doc_id::VARCHAR')} % 1000 AS h FROM documents)
SELECT f AS fraction, count(*) AS reads, sum(n)::BIGINT AS bases, min(n)::INT AS shortest, max(n)::INT AS longest FROM u, (VALUES (50), (100), (250), (500)) t(f) WHERE h < f GROUP BY 1""")
def nested_subsample(spark, sf_dir):
    """Samples of 5, 10, 25 and 50 per cent, each within the next."""
    rows = Tables(spark, sf_dir).documents.select(F.length("text").alias("n"), (seqs.stable_hash(F.col("doc_id")) % 1000).alias("h"))
    each = rows.select("n", F.explode(F.filter(F.array(*map(F.lit, (50, 100, 250, 500))), lambda f: F.col("h") < f)).alias("fraction"))
    return each.groupBy("fraction").agg(F.count("*").alias("reads"), F.sum("n").alias("bases"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


@query("mod_contexts", f"""WITH {READS}, c AS (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM reads),
x AS (SELECT doc_id, CASE WHEN substr(seq, p, 2) = 'CG' THEN 'CG' WHEN substr(seq, p, 3) IN ('CAG', 'CCG', 'CTG') THEN 'CHG' WHEN substr(seq, p, 3) IN ('CAA', 'CAC', 'CAT', 'CCA', 'CCC', 'CCT', 'CTA', 'CTC', 'CTT') THEN 'CHH' END AS context, '+' AS strand FROM c
 UNION ALL SELECT doc_id, CASE WHEN substr(seq, p, 2) = 'CG' THEN 'CG' END, '-' FROM c UNION ALL SELECT doc_id, CASE WHEN substr(seq, p, 3) IN ('CTG', 'CGG', 'CAG') THEN 'CHG' WHEN substr(seq, p, 3) IN ('TTG', 'GTG', 'ATG', 'TGG', 'GGG', 'AGG', 'TAG', 'GAG', 'AAG') THEN 'CHH' END, '-' FROM c)
SELECT doc_id, context, strand, count(*) AS sites FROM x WHERE context IS NOT NULL GROUP BY ALL""")
def mod_contexts(spark, sf_dir):
    """Cytosine contexts on both strands: CG, CHG, CHH, by overlapping matches."""
    patterns = {("CG", "+"): "C(?=G)", ("CHG", "+"): "C(?=[ACT]G)", ("CHH", "+"): "C(?=[ACT][ACT])", ("CG", "-"): "C(?=G)", ("CHG", "-"): "C(?=[AGT]G)", ("CHH", "-"): "(?=[AGT][AGT]G)"}
    counts = [F.struct(F.lit(c).alias("context"), F.lit(s).alias("strand"), F.regexp_count("seq", F.lit(p)).cast("long").alias("sites")) for (c, s), p in patterns.items()]
    return reads_of(spark, sf_dir).select("doc_id", F.explode(F.array(*counts)).alias("x")).select("doc_id", "x.*").where("sites > 0")


@query("phred_effective_q", """WITH q AS (SELECT doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '!"#$%&()*+,-./0123456789:;<') AS q FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, regexp_replace(q, '[^!-<]', '', 'g') AS q FROM q), e AS (SELECT doc_id, unnest(string_split(q, '')) AS c FROM s WHERE q <> '')
SELECT doc_id, round(-10 * log10(sum(power(10.0, -(ascii(c) - 33) / 10.0)) / count(*)), 6) AS q FROM e GROUP BY 1""")
def phred_effective_q(spark, sf_dir):
    letters = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "!\"#$%&()*+,-./0123456789:;<")
    rows = Tables(spark, sf_dir).documents.where(F.length("text") > 0).select("doc_id", F.regexp_replace(letters, "[^!-<]", "").alias("q")).where("q <> ''")
    return rows.select("doc_id", F.round(seqs.phred_q(F.col("q")), 6).alias("q"))


@query("sha256_binding", "SELECT sha256(text) AS sha256, count(*) AS records, min(doc_id) AS first_id FROM documents GROUP BY 1")
def sha256_binding(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("records"), F.min("doc_id").alias("first_id"))


@query("parse_bases", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1000 WHEN 2 THEN o_custkey * 1000000 ELSE o_custkey * 1000000000 END::BIGINT AS bases FROM orders""")
def parse_bases(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, ("", "k", "M", "g"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", seqs.parse_bases(F.concat(F.col("o_custkey").cast("string"), suffix)).alias("bases"))


@query("mask_tandem")
def mask_tandem(spark, sf_dir):
    """Bases of microsatellites (period up to six, at least 24 bases) in each read."""
    runs = F.regexp_extract_all("seq", F.lit(r"((.{1,6}?)\2{3,})"), F.lit(1))
    long = F.filter(runs, lambda r: F.length(r) >= 24)
    return reads_of(spark, sf_dir).select("doc_id", F.aggregate(long, F.lit(0), lambda a, r: a + F.length(r)).alias("masked"))
