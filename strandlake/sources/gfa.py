"""Assembly graph text: segments, links, tags and walks as tables; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(lines: DataFrame) -> DataFrame:
    """Lines (value) split at tabs."""
    return lines.select(F.split("value", "\t").alias("f"))


def segments(lines: DataFrame) -> DataFrame:
    """(name, seq, tags) of S lines; sequences in upper case."""
    f = fields(lines).where(F.col("f")[0] == "S")
    return f.select(F.col("f")[1].alias("name"), F.upper(F.col("f")[2]).alias("seq"), F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))).alias("tags"))


def links(lines: DataFrame) -> DataFrame:
    """(a, a_fwd, b, b_fwd, overlap) of L lines, one of each pair of mirrored lines; an overlap is * or <n>M, else an error."""
    f = fields(lines).where(F.col("f")[0] == "L")
    overlap = F.when(F.col("f")[5] == "*", 0).when(F.col("f")[5].rlike("^[0-9]+M$"), F.regexp_replace(F.col("f")[5], "M", "").cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad overlap "), F.col("f")[5])).cast("int"))
    e = f.select(F.col("f")[1].alias("a"), (F.col("f")[2] == "+").alias("a_fwd"), F.col("f")[3].alias("b"), (F.col("f")[4] == "+").alias("b_fwd"), overlap.alias("overlap"))
    one = F.struct("a", "a_fwd", "b", "b_fwd")
    two = F.struct(F.col("b").alias("a"), (~F.col("b_fwd")).alias("a_fwd"), F.col("a").alias("b"), (~F.col("a_fwd")).alias("b_fwd"))
    return e.select(F.least(one, two).alias("k"), "overlap").distinct().select("k.*", "overlap")


def tag(tags: Column, name: str, kind: str) -> Column:
    """A typed tag's value, null where it is missing or no number."""
    found = F.get(F.filter(tags, lambda t: t.startswith(name + ":")), F.lit(0))
    value = F.regexp_replace(found, "^[^:]*:[^:]*:", "")
    return value.try_cast(kind) if kind != "string" else value


def walks(lines: DataFrame) -> DataFrame:
    """(path, ord, seg, fwd) of P and W lines."""
    f = fields(lines).where(F.col("f")[0].isin("P", "W"))
    p = F.transform(F.split(F.col("f")[2], ","), lambda s: F.struct(s.substr(F.lit(1), F.length(s) - 1).alias("seg"), s.endswith("+").alias("fwd")))
    w = F.transform(F.regexp_extract_all(F.get("f", F.lit(6)), F.lit("([<>][^<>]+)"), F.lit(1)), lambda s: F.struct(s.substr(F.lit(2), F.length(s)).alias("seg"), s.startswith(">").alias("fwd")))
    name = F.when(F.col("f")[0] == "P", F.col("f")[1]).otherwise(F.concat_ws("#", F.get("f", F.lit(1)), F.get("f", F.lit(2)), F.get("f", F.lit(3))))
    rows = f.select(name.alias("path"), F.posexplode(F.when(F.col("f")[0] == "P", p).otherwise(w)).alias("ord", "s"))
    return rows.select("path", "ord", "s.seg", "s.fwd")


def to_lines(segments_: DataFrame, links_: DataFrame) -> DataFrame:
    """S and L lines (value) of tables."""
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    s = segments_.select(F.concat_ws("\t", F.lit("S"), "name", "seq", F.array_join("tags", "\t")).alias("value"))
    e = links_.select(F.concat_ws("\t", F.lit("L"), "a", sign("a_fwd"), "b", sign("b_fwd"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    return s.select(F.rtrim("value").alias("value")).unionByName(e)
