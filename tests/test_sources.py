import struct
import zlib

from strandlake.sources import bam, writers


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, seq, qual, tags=b""):
    codes = [bam.BASES.index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    tags = b"MMZC+m,0;\0MLBC" + struct.pack("<I", 2) + bytes([7, 250]) + b"NMi" + struct.pack("<i", 3)
    data = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    data += record("r1", 0, "ACGTC", [30] * 5, tags) + record("r2", bam.REVERSE, "AACG", [10, 20, 30, 40]) + record("r3", bam.SECONDARY, "AC", [1, 1]) + record("r4", 4, "", [])
    (tmp_path / "x.bam").write_bytes(b"".join(block(data[i : i + 40]) for i in range(0, len(data), 40)) + block(b""))
    bam.register(spark)
    got = {r["name"]: tuple(r)[1:] for r in spark.read.format("bam").option("path", str(tmp_path)).load().collect()}
    assert got == {"r1": (0, "ACGTC", "?????", "C+m,0;", [7, 250]), "r2": (16, "CGTT", "I?5+", None, None), "r4": (4, "", None, None, None)}


def test_text_sinks(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACG", None, ["x", "y"]), ("b", "T", "#", ["y"])], "id string, seq string, qual string, targets array<string>")
    assert sorted(r["value"] for r in writers.fastq_lines(reads).collect()) == ["@a\nACG\n+\nIII", "@b\nT\n+\n#"]
    writers.write_by_target(reads, f"{tmp_path}/targets")
    assert spark.read.text(f"{tmp_path}/targets").where("target = 'y' and value like '@%'").count() == 2
    assert writers.fasta_lines(spark.createDataFrame([("m", "AC", 2, True)], "id string, seq string, length int, circular boolean"), ["length", "circular"]).first()["value"] == ">m length=2 circular=true\nAC"
    writers.write_table(reads.select("id", "seq"), f"{tmp_path}/t")
    assert sorted(map(tuple, writers.read_table(spark, f"{tmp_path}/t", "seq string, depth double").collect())) == [("ACG", None), ("T", None)]


def test_variants_and_sites(spark):
    sites = spark.createDataFrame([("c", 5, 1, "A", ["G", "T"])], "chrom string, pos long, id long, ref string, alts array<string>")
    calls = spark.createDataFrame([(1, "s1", 1), (1, "s2", 0), (1, "s3", None)], "id long, sample string, allele int")
    lines = [r["value"] for r in writers.vcf_lines(sites, calls, ["s1", "s2", "s3"]).orderBy("ord").collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-1] == "c\t5\t1\tA\tG,T\t.\tPASS\tAF=0.5000,0.0000;NS=2\tGT\t1\t0\t."
    bed = spark.createDataFrame([("c", 3, "CG", "+", 3, 1), ("c", 9, "CHH", "-", 0, 2)], "contig string, pos long, context string, strand string, mod long, unmod long")
    assert [r["value"] for r in writers.bed_lines(bed).collect()] == ["c\t3\t5\tCG\t4\t.\t0.7500", "c\t9\t10\tCHH\t2\t-\t0.0000"]
