import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import md5_words, seqs
from strandlake.operators import graph, intervals, kmers, models, recruit, stats, superwords, translate
from strandlake.operators.pan import decode_mods
from strandlake.sources import fastx, gfa
from strandlake.streaming import events


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@settings(max_examples=100, deadline=None)
@given(st.text("ACGTNacgt", max_size=60), st.integers(1, 31))
def test_packed_words_are_the_canonical_ones(s, k):
    pos, word, fwd = kmers.pack_words(s.encode(), k, True)
    u = s.upper()
    want = [(i + 1, min(w, rc(w)), w <= rc(w)) for i in range(len(u) - k + 1) if "N" not in (w := u[i : i + k])]
    code = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
    assert [(p, c, bool(f)) for p, c, f in zip(pos, word, fwd)] == [(p, code(w), f) for p, w, f in want]


def test_reverse_complement_changes_no_word(spark):
    s = "ACGGTTACNACCGATTTGCA" * 5
    rows = spark.createDataFrame([(1, s), (2, seqs_rc(s))], "doc_id long, seq string")
    got = kmers.kmers(rows, 7).groupBy("doc_id").agg(F.sort_array(F.collect_list("kmer")).alias("k")).orderBy("doc_id").collect()
    assert got[0]["k"] == got[1]["k"]


def seqs_rc(s):
    return rc(s)


def test_blocks_bridge_gaps(spark):
    hits = spark.createDataFrame([(1, 0, p) for p in (1, 2, 30, 200)], "doc_id long, target int, pos long")
    assert kmers.blocks(hits, 21, 50, ["doc_id", "target"]).first()[2:] == (4, 71, 50)


def test_translation_codes():
    assert translate.genetic_code(1)["TGA"] == "*" and translate.genetic_code(2)["TGA"] == "W" and translate.genetic_code(5)["AGA"] == "S"
    assert [r for _, _, r in translate.frames(b"ATGTAA", translate._table(1))][0] == b"M*"


@pytest.mark.parametrize("values", [[1], [1, 2], [3, 1, 2, 2], list(range(11))])
def test_quantiles_are_nearest_ranks(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    s = sorted(values)
    assert stats.nearest_rank(df, "x", 0.35, [], "q").first()["q"] == s[int((len(s) - 1) * 0.35 + 0.5)]
    assert stats.upper_median(df, "x", [], "m").first()["m"] == s[len(s) // 2]


def test_interval_union_and_depth(spark):
    rng = random.Random(1)
    rows = [(1, a := rng.randrange(100), a + rng.randrange(12)) for _ in range(40)]
    df = spark.createDataFrame(rows, "k long, start long, end long")
    cover = [sum(a <= i < b for _, a, b in rows) for i in range(120)]
    got = intervals.depth(df, ["k"]).collect()
    assert sum((r["end"] - r["start"]) * r["depth"] for r in got) == sum(cover)
    assert sum(r["end"] - r["start"] for r in intervals.union(df, ["k"]).collect()) == sum(c > 0 for c in cover)


def writer(tmp_path, spark):
    def write(df, name):
        df.write.parquet(path := f"{tmp_path}/{name}-{random.random()}")
        return spark.read.parquet(path)

    return write


def test_components_and_unitigs(spark, tmp_path):
    rng = random.Random(2)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    root = list(range(40))
    for _ in range(40):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), writer(tmp_path, spark)).collect()}
    assert got == {x: root[x] for p in pairs for x in p}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 5), (7, 8), (8, 9), (9, 7)], "a long, b long")
    u = {r["node"]: (r["head"], r["place"], r["circular"]) for r in graph.unitigs(e, writer(tmp_path, spark)).collect()}
    assert u[3] == (1, 2, False) and u[4] == (4, 0, False) and u[8][0] == 7 and u[8][2]


def test_long_chains_and_covers_are_followed_to_their_end(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(110)] + [(110, 60), (500, 501)], "a long, b long").coalesce(1)
    got = {r["node"]: r["round"] for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node long"), writer(tmp_path, spark)).collect()}
    assert got == {i: i for i in range(111)}
    sets = spark.createDataFrame([(i, i) for i in range(55)] + [(None, 99), (3, None)], "set long, item long").coalesce(1)
    assert models.greedy_cover(sets, writer(tmp_path, spark)) == [(i, 1) for i in range(55)]


def test_recruitment_reaches_by_growth(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    reads = [(i, genome[p : p + 400]) for i, p in enumerate(range(0, 2600, 50))] + [(1000, "".join(rng.choice("ACGT") for _ in range(400)))]
    df = spark.createDataFrame(reads, "doc_id long, seq string")
    seeds = spark.createDataFrame([(0, genome[:300])], "doc_id long, seq string")
    bait = recruit.bait_of(seeds, F.col("doc_id") % 8, 21)
    got = {r["doc_id"] for r in recruit.fixpoint(df, bait, 8, 21, writer(tmp_path, spark)).collect()}
    assert 1000 not in got and len(got) > 20
    # looked up by shares, the bait hits the same reads
    near = sorted(map(tuple, recruit.target_counts(df, bait, 8, 21).collect()))
    monkeypatch.setattr(recruit, "BROADCAST_BAIT", 10)
    assert near and sorted(map(tuple, recruit.target_counts(df, bait, 8, 21).collect())) == near


@pytest.mark.parametrize("k", [12, 21, 31])
def test_words_are_counted_by_shares(spark, k, monkeypatch):
    rng = random.Random(k)
    some = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(12)]
    reads = [(i, i % 3, "N".join(rng.choice([s, rc(s), s[5:70]]) for s in rng.sample(some, 3))) for i in range(40)] + [(40, 0, "A" * 200), (41, 1, None), (42, 2, ""), (43, 2, "ACGTN")]
    df = spark.createDataFrame(reads, "doc_id long, g int, seq string").repartition(3)
    monkeypatch.setattr(superwords, "SHARE_WORDS", 700)
    monkeypatch.setattr(superwords, "BATCH_WORDS", 900)
    monkeypatch.setattr(kmers, "PIECE", 97)
    words = {i: [min(w, rc(w)) for p in range(len(s or "") - k + 1) if "N" not in (w := s[p : p + k])] for i, _, s in reads}
    total, once = Counter(w for ws in words.values() for w in ws), Counter(w for ws in words.values() for w in set(ws))
    for got, want in ((superwords.spectrum(df, k, 9), total), (superwords.spectrum(df, k, 9, once=True), once)):
        assert {r["n"]: r["kmers"] for r in got.collect()} == Counter(want.values())
    sets = [{w for i, g, _ in reads for w in words[i] if g == x} for x in range(3)]
    found = superwords.shared(superwords.packets(df.withColumn("g", F.col("g").cast("string")), k, 9, group="g"), k).groupBy("a", "b").agg(F.sum("n")).collect()
    assert {(r[0], r[1]): r[2] for r in found} == {(str(a), str(b)): n for a in range(3) for b in range(a, 3) if (n := len(sets[a] & sets[b]))}
    f = lambda read, n, kinds: {"kinds": kinds, "sum": np.bincount(read, n, len(kinds)).astype(int), "windows": np.bincount(read, minlength=len(kinds))}
    got = {r["doc_id"]: tuple(r)[1:] for r in superwords.looked_up(df, k, superwords.shares_for(df), f, "kinds long, sum long, windows long").collect()}
    assert got == {i: (len(set(ws)), sum(total[w] for w in ws), len(ws)) for i, ws in words.items()}
    assert superwords.spectrum(df.where("doc_id = 42"), k, 9).count() == 0 and superwords.looked_up(df.limit(0), k, 2, f, "kinds long, sum long, windows long").count() == 0


def test_hashes_of_packed_words_are_md5():
    for k in (1, 7, 8, 21, 31):
        words = np.array([random.Random(i).randrange(4**k) for i in range(50)])
        letters = ["".join("ACGT"[int(w) >> 2 * (k - 1 - i) & 3] for i in range(k)) for w in words]
        assert md5_words.stable_hash(words, k).tolist() == [int(hashlib.md5(s.encode()).hexdigest()[:15], 16) for s in letters]


def test_peaks_see_empty_neighbours_and_merge(spark):
    # the empty bin between has the greatest sum, so neither is a peak
    peaks = lambda rows: sorted(r["bin"] for r in stats.octave_peaks(spark.createDataFrame(rows, "bin long, n long"), 10).collect())
    assert peaks([(3, 100), (5, 10)]) == [] and peaks([(3, 100), (9, 10)]) == [3, 9] and peaks([(1, 4)]) == []
    merged = lambda bins: sorted(r["centre"] for r in stats.merged_peaks(spark.createDataFrame([(b,) for b in bins], "bin long")).collect())
    assert merged([3, 6, 20]) == [(0.875 + 1.625) / 2, 5.125] and merged([3, 7]) == [0.875, 1.875]


def test_mosaic_models_by_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(30):
        runs, sites = int(rng.integers(1, 4)), int(rng.integers(1, 6))
        panel = rng.integers(-1, 3, (runs, sites))
        observed = [None if x < 0 else int(x) for x in rng.integers(-1, 3, sites)]
        e = lambda t, s: 1.0 if observed[t] is None or panel[s, t] < 0 else 0.99 if panel[s, t] == observed[t] else 0.01
        step = lambda a, b: 0.001 / runs + 0.999 * (a == b)
        weigh = lambda p, skip=None: math.prod(step(a, b) for a, b in zip(p, p[1:])) * math.prod(e(t, s) for t, s in enumerate(p) if t != skip)
        paths = list(itertools.product(range(runs), repeat=sites))
        assert weigh(tuple(models.viterbi(observed, panel))) == pytest.approx(max(map(weigh, paths)))
        got = models.forward_backward(observed, panel)
        for t in range(sites):
            want = np.array([sum(weigh(p, t) for p in paths if p[t] == s) for s in range(runs)])
            assert got[:, t] == pytest.approx(want / want.sum())
    assert models.viterbi([None, None], np.zeros((3, 2), int)) == [2, 2]


def test_run_lengths_and_votes():
    h = lambda **n: np.array([n.get(f"c{i}", 0) for i in range(65)])
    runs = [h(c5=9, c4=1)] * 6 + [h(c4=6, c5=4)] + [h(c8=9, c7=2)] * 3
    assert models.em_lengths(runs, [5] * 6 + [4] + [8] * 3)[:6] == [5] * 6
    assert set(models.em_lengths(runs, [5] * 7 + [8] * 3)) <= {5, 8}  # a length that no run has doesn't win
    a, b, n = np.array([0.9, 0.2]), np.array([0.5, 0.5]), np.array([30, 10])
    assert models.rho(a, b, n) == pytest.approx(models.rho(np.repeat(a, n), np.repeat(b, n), np.ones(40)))


def test_modified_bases():
    assert decode_mods("C", [0, 1], "ACCTC") == [1, 4] and decode_mods("C", [5], "CC") == []


def test_fastx_round_trip(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\n\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1\nACGT\n+\nIIII\n")
    fastx.register(spark)
    got = sorted(map(tuple, spark.read.format("fastx").option("path", str(tmp_path)).load().collect()))
    assert got == [("one", "ACGTAC", None), ("r1", "ACGT", "IIII"), ("two", "", None)]


def test_gfa_rejects_odd_overlaps(spark):
    lines = spark.createDataFrame([("L\ta\t+\tb\t-\t5S",)], "value string")
    with pytest.raises(Exception, match="bad overlap"):
        gfa.links(lines).collect()
    both = spark.createDataFrame([("L\ta\t+\tb\t-\t5M",), ("L\tb\t+\ta\t-\t5M",), ("W\ts\t1\tc\t0\t9\t>a<b",)], "value string")
    assert gfa.links(both).count() == 1
    assert [tuple(r) for r in gfa.walks(both).orderBy("ord").collect()] == [("s#1#c", 0, "a", True), ("s#1#c", 1, "b", False)]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    order = ["start", "event_type"]
    strip = lambda df: [(r["start"], r["event_type"], r["n"]) for r in df.orderBy(*order).collect()]
    assert strip(spark.table("tumbling")) == strip(events.tumbling(src))


def test_canonical_expression(spark):
    r = spark.range(1).select(seqs.canonical(F.lit("TTTA")).alias("a"), seqs.parse_bases(F.lit("3.5M")).alias("b"), seqs.parse_bases(F.lit("x")).alias("c")).first()
    assert tuple(r) == ("TAAA", 3_500_000, None)
