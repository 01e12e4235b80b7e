"""Text sinks: FASTQ, FASTA, tables with headers, variant and interval files.  Each is a table of lines, or writes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quality written for records that have none.
NEUTRAL = "I"


def fastq_lines(reads: DataFrame) -> DataFrame:
    """(value) of four lines for each read (id, seq, qual); reads without qualities get a neutral one."""
    qual = F.coalesce("qual", F.repeat(F.lit(NEUTRAL), F.length("seq")))
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), qual).alias("value"))


def fasta_lines(records: DataFrame, notes: list[str] = ()) -> DataFrame:
    """(value) of two lines for each record (id, seq); ``notes`` are columns that the header carries as name=value."""
    parts = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in notes]
    return records.select(F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit(">"), "id"), *parts), "seq").alias("value"))


def write_by_target(reads: DataFrame, path: str) -> None:
    """A folder of FASTQ files for each target of reads (id, seq, qual, targets); a read of several goes to each."""
    each = reads.withColumn("target", F.explode("targets"))
    lines = each.select("target", F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), F.coalesce("qual", F.repeat(F.lit(NEUTRAL), F.length("seq")))).alias("value"))
    lines.write.partitionBy("target").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    df.write.option("header", True).option("sep", "\t").csv(path)


def read_table(spark, path: str, schema: str) -> DataFrame:
    """A tab-separated table by its header's names; columns that the schema doesn't name are dropped, missing ones are null."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    kinds = dict(c.strip().split() for c in schema.split(","))
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names))


def vcf_lines(sites: DataFrame, genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """(ord, value): header and a line for each site (chrom, pos, id, ref, alts), with haploid calls (id, sample, allele; null: no call).

    AF and NS count called samples only.
    """
    spark = sites.sparkSession
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="share of called samples">', '##INFO=<ID=NS,Number=1,Type=Integer,Description="called samples">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="haploid call">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    wide = genotypes.groupBy("id").pivot("sample", samples).agg(F.first("allele"))
    j = sites.join(wide, "id", "left")
    calls = F.array(*(F.col(f"`{s}`") for s in samples))
    ns = F.size(F.filter(calls, lambda x: x.isNotNull()))
    af = F.array_join(F.transform(F.sequence(F.lit(1), F.size("alts")), lambda a: F.format_number(F.size(F.filter(calls, lambda x: x == a)) / F.greatest(ns, F.lit(1)), 4)), ",")
    info = F.concat(F.lit("AF="), af, F.lit(";NS="), ns.cast("string"))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("id").cast("string"), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), info, F.lit("GT"), *(F.coalesce(F.col(f"`{s}`").cast("string"), F.lit(".")) for s in samples))
    body = j.select(F.struct(F.lit(1).alias("part"), "chrom", "pos", F.col("id").cast("string").alias("id")).alias("ord"), line.alias("value"))
    top = spark.createDataFrame([((0, "", i, ""), s) for i, s in enumerate(head)], "ord struct<part: int, chrom: string, pos: long, id: string>, value string")
    return top.unionByName(body.select(F.col("ord").cast("struct<part: int, chrom: string, pos: bigint, id: string>").alias("ord"), "value"))


def bed_lines(sites: DataFrame) -> DataFrame:
    """(value) for modified sites (contig, pos from 0, context, strand, mod, unmod); CG sites span two bases and have no strand."""
    cg = F.col("context") == "CG"
    share = F.format_number(F.col("mod") / (F.col("mod") + F.col("unmod")), 4)
    return sites.select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), (F.col("pos") + F.when(cg, 2).otherwise(1)).cast("string"), "context", (F.col("mod") + F.col("unmod")).cast("string"), F.when(cg, ".").otherwise(F.col("strand")), share).alias("value"))
