"""Quality rules on DataFrame functions only: counts of words, symbols and repeats, and a hashed n-gram likelihood ratio.

Word unigrams and bigrams of all documents are hashed into a fixed number of buckets.  Two multinomials over the buckets are
counted: one from trusted documents, one from the whole raw corpus.  A document's verdict is the log-likelihood ratio of its
n-grams under the two, divided by their number, against a fixed threshold.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: The trusted multinomial is fitted on at most so many labelled documents, the first by a hash of their id; so they can be broadcast.
TRUSTED_ROWS = 20_000
SMOOTHING = 1.0
#: Kept from this mean log-likelihood ratio on.
LLR_FLOOR = -0.08
_SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, also where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def _indices(n: Column) -> Column:
    """0 to n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """Words that stand in windows of ``width`` words found twice or more in the text, the first included."""

    def among(hashes: Column) -> Column:
        def found(sorted_: Column) -> Column:
            # windows whose neighbour in hash order has the same hash
            same = F.filter(sorted_, lambda e, i: (e["h"] == F.get(sorted_, i - 1)["h"]) | (e["h"] == F.get(sorted_, i + 1)["h"]))
            at = F.sort_array(F.transform(same, lambda e: e["p"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
            step = lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, start, step, lambda s: s["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, found))

    def windows(w: Column) -> Column:
        return F.transform(_indices(F.size(w) - (width - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    return let(words, lambda w: let(windows(w), among))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's word unigrams, then of its bigrams."""

    def of(w: Column) -> Column:
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.transform(_indices(F.size(w) - 1), lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, two)

    return let(words, of)


def fit_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``ratios``: by bucket, the log of its share among trusted n-grams over its share in the corpus.

    ``trusted``: doc_id of trusted documents, at most TRUSTED_ROWS rows.  Every n-gram of every document is counted; partial counts
    meet bucket by bucket.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id").distinct().withColumn("trusted", F.lit(1))), "doc_id", "left")
    grams = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(ngram_buckets(words_of(F.col("text")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    listed = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    share = lambda n, total: (n + F.lit(smoothing)) / (total + F.lit(smoothing * buckets))
    return listed.select(F.transform("c", lambda c: F.log(share(c["good"], F.col("good"))) - F.log(share(c["raw"], F.col("raw")))).alias("ratios"))


def rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, floor: float = LLR_FLOOR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of each row's whole text.

    A null or empty text has no words, so it fails the base rules.  Null ids stay null; repeated rows are judged each; other
    columns are left aside.  Without trusted documents every ratio comes from the smoothing alone.
    """
    # a fixed number of buckets comes to the driver and goes out as one constant
    ratios = F.from_json(F.lit(json.dumps(fit_ratios(docs, trusted, buckets).first()["ratios"])), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    words, n = F.col("words"), F.size("words").cast("long")
    sums = lambda grams: let(grams, lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.greatest(F.size(g), F.lit(1)))
    out = base.select(
        "doc_id", n.alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_window_words(words).alias("n_repeat_words"), sums(ngram_buckets(words, buckets)).alias("llr"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= floor))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good, at most ``limit``, the first by a hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
