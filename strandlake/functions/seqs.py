"""Column expressions on nucleotide strings, walks and hashes; all of them stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_CYCLE = ("ACGT" * 7)[:26] + "N" * 10


def project_reads(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq): texts as reads; letters cycle through the bases, digits become N, all else goes."""
    kept = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", "")
    return docs.select(key, F.translate(kept, _LETTERS, _CYCLE).alias("seq"))


def revcomp(s: Column) -> Column:
    """Reverse complement; letters other than the bases stay."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def canonical(s: Column) -> Column:
    return F.least(s, revcomp(s))


def stable_hash(s: Column) -> Column:
    """The first 60 bits of the md5: the same in any engine."""
    return F.conv(F.substring(F.md5(s.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def unit_hash(name: Column, salt: str) -> Column:
    """A number in [0, 1) that a record's name decides."""
    return stable_hash(F.concat(name.cast("string"), F.lit(salt))).cast("double") / F.lit(float(1 << 60))


def hpc(s: Column) -> Column:
    """Homopolymer compression: one base for each run."""
    return F.regexp_replace(s, r"(.)\1+", "$1")


def runs(s: Column) -> Column:
    """Runs of equal characters, in order."""
    return F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))


def unpack_kmer(code: Column, k: int) -> Column:
    """The string of a two-bit packed word."""
    return F.concat(*(F.substring(F.lit(BASES), F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in range(k)))


def phred_q(quality: Column) -> Column:
    """Effective quality: the mean error probability as a Phred value."""
    errors = F.transform(F.split(quality, ""), lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - 33) / F.lit(10.0)))
    return -10 * F.log10(F.aggregate(errors, F.lit(0.0), lambda a, b: a + b) / F.size(errors))


def walk_revcomp(steps: Column) -> Column:
    """The other reading of a walk of (seg, fwd)."""
    return F.reverse(F.transform(steps, lambda s: F.struct(s["seg"].alias("seg"), (~s["fwd"]).alias("fwd"))))


def parse_bases(s: Column) -> Column:
    """Counts like 12k, 3.5M or 2g."""
    number = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)[kKmMgG]?$", 1)
    unit = F.lower(F.right(s, F.lit(1)))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(number != "", F.round(number.cast("double") * scale).cast("long"))
