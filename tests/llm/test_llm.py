"""The training-data operators against libraries, brute force or held-out rows, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import ann, bpe, lexicon, ngram_lm, packing, pii, quality_model, quality_rules, queries, simhash, suffix_dedup, tokencount
from strandlake.llm.common import materialize
from strandlake.llm.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  B ", "\n\na\tb\n c", "日本語 テキスト 🎉", "<|endoftext|>a <|startoftext|> b <s>", "a▁b ▁▁", "\x00a", "x" * 3000, "É ñ\xa0z", "ΑΣ ΣΑΣ", "don't we'll 'S", "①²½ 12 ٣x", "a\x1cb", "İs é Å", "a \n b", "1.2.3.4 +1 (017) 555-7713 4845168114407329 a@b.cd"]
#: Rows with nulls, repeats, ties and further columns whose names clash with those used within.
SCHEMA = "doc_id long, text string, key long, words string, batch int, fp string, spans int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id here"), (101, "again and again and again"), (101, "again and again and again")]
    return spark.createDataFrame([(i, t, 1, "w", 2, "f", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


# 3 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_piece_counts(text):
    sp, counter = piece()
    assert counter.count(text) == len(sp.encode(text))


def piece(held=[]):  # noqa: B006
    if not held:
        path = P.path("piece_bpe_32k.model")
        held.append((sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PieceCounter(path)))
    return held[0]


def test_token_counts(odd, empty, docs, texts):
    sp, _ = piece()
    path = P.path("piece_bpe_32k.model")
    got = rows_of(tokencount.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((i, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts.items()), key=repr)
    assert tokencount.count_tokens(odd, path).count() == odd.count() and tokencount.count_tokens(empty, path).count() == 0
    assert {(r["n_tokens"], r["n_bytes"]) for r in tokencount.count_tokens(odd, path).where("doc_id = 100").collect()} == {(0, 0)}


# 1, 2 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abehilnorst 'é.1\n", max_size=40), max_size=5))
def test_tokenizers_agree(batch):
    batch = batch + ODD
    word, byte, codec, packer = tokenizers()
    assert [x.tolist() for x in codec.encode_batch(batch)] == [byte.encode(t, add_special_tokens=False).ids for t in batch]
    assert [np.frombuffer(x, "<u4").tolist() for x in packer.encode_batch(batch)] == [word.encode(t, add_special_tokens=False).ids for t in batch]


def tokenizers(held=[]):  # noqa: B006
    if not held:
        w, b = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
        lex = lexicon.Lexicon.compile(bpe.ByteMerger(b).merge([b" the", b" then", b" thin", b" bin", b" nation", b" ration"]))
        held.append((Tokenizer.from_file(w), Tokenizer.from_file(b), lexicon.LexiconCodec(b, lexicon.Lexicon.map(lex.to_bytes())), packing.WordTokenizer(w)))
    return held[0]


def test_lexicon_is_minimal_and_exact():
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops"]
    entries = {w: np.array([i, i + 100], "<u4").tobytes() for i, w in enumerate(words)}
    lex = lexicon.Lexicon.compile(entries)
    found, missing = lex.look_up([*words, b"to", b"topss", b"", b"x"])
    assert found == entries and sorted(missing) == [b"", b"to", b"topss", b"x"]
    # states are the distinct sets of endings: of nothing, s, st, t, ta and to, tap and its like, and with the s after it
    assert lex.n_states == len({tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for x in words for p in (x[:i] for i in range(len(x) + 1))})
    assert lexicon.Lexicon.map(lex.to_bytes()).look_up(words)[0] == entries


def test_heap_equals_rounds():
    m = bpe.ByteMerger(P.path("byte_bpe_50k.json"))
    rng = random.Random(0)
    for n in (1, 2, 39, 40, 41, 90):
        w = "".join(rng.choice("ationhers") for _ in range(n)).encode()
        left, merges = bpe.heap_merge([*m.first[list(w)].tolist()], m.pair)
        assert np.frombuffer(m.merge([w])[w], "<u4").tolist() == left and len(left) == n - merges


def test_codec_round_trip(spark, odd, empty, docs, texts):
    path = P.path("byte_bpe_50k.json")
    lex = lexicon.build_lexicon(docs, path, 500)
    t = Tokenizer.from_file(path)
    for r in lexicon.encode_decode(docs, path, lex, texts=True).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert lexicon.encode_decode(odd, path, lex).count() == odd.count()
    assert lexicon.encode_decode(empty, path, lexicon.build_lexicon(empty, path)).count() == 0


def check_packing(rows, ids, window):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(0 if (n := sum(r["length"] for r in p)) & (n - 1) == 0 else window - n for p in by_seq.values())


@pytest.mark.parametrize("window,salt", [(2048, 50), (256, 7)])
def test_packing(spark, docs, texts, empty, monkeypatch, window, salt):
    monkeypatch.setattr(packing, "SALT_ROWS", salt)
    _, _, _, packer = tokenizers()
    ids = {i: [*np.frombuffer(x, "<u4").tolist(), 1] for i, x in zip(texts, packer.encode_batch(list(texts.values())))}
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), window).collect()
    padding = check_packing(rows, ids, window)
    assert padding < 0.05 * sum(map(len, ids.values()))
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_word_ids_of_every_code_point():
    path = P.path("word_bpe_49k.json")
    mine, library = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for low in range(0, 0x38000, 1 << 15):  # planes above hold no letters
        texts = [f"a{chr(c)}b {chr(c)}" for c in range(low, low + (1 << 15)) if not 0xD800 <= c < 0xE000]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert mine.encode_batch(texts) == want


def test_packing_odd_rows(odd):
    rows = packing.pack_documents(odd, P.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 101) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 101)
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 100] == [(1, 1)]


def test_nnls_uses_up_a_solvable_histogram():
    h = np.zeros(33, np.int64)
    h[[10, 12, 32]] = 40, 20, 5  # 10 + 10 + 12
    combos, counts = packing.repeat_counts(h)
    assert {tuple(c): n for c, n in zip(combos.tolist(), counts.tolist())} == {(12, 10, 10): 20, (32, 0, 0): 5}
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, (12, 3)), rng.random(6)
    x = packing.nnls(a, b)
    dense = np.zeros((6, 12))
    for j, c in enumerate(a):
        np.add.at(dense[:, j], c, 1)
    g = dense.T @ (b - dense @ x)
    assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g[x > 1e-9]).max(initial=0) < 1e-6


# 4 ------------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, docs, texts, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = quality_rules.trusted_ids(labels)
    import re

    words = re.compile(r"[^\x20\x09-\x0D]+")

    def want(t):
        w = words.findall(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_rules.rules(docs, trusted).collect()
    assert all(tuple(r[n] for n in names) == want(texts[r["doc_id"]]) for r in out)
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(r["kept"], good[r["doc_id"]]) for r in out if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([k for k, q in judged if q == 1]) > 0.95
    for r in quality_rules.rules(odd, trusted.limit(0)).collect():
        assert r["base_failed"] == want({**dict(enumerate(ODD)), None: "no id here", 101: "again and again and again"}.get(r["doc_id"]) or "")[5]
    assert quality_rules.rules(empty, trusted).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    bad = spark.createDataFrame([(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [None] + [1.0] * 63), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    both = e.select("vec_id", "embedding").unionByName(bad)
    got = ann.search(both, both.where("vec_id % 100 = 0")).collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len({r["vec_id"] for r in mine} & set(ids[order].tolist()))
    assert hit >= 0.9 * 10 * len(ids[ids % 100 == 0])
    few = both.where("vec_id in (0, 1, 2)")
    assert rows_of(ann.search(few, few.where("vec_id = 0")), "query_id", "rank")[0:2] == [(0, 1), (0, 2)]
    assert ann.search(e.limit(0), e.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.search(copies, copies.where("vec_id = 100")).orderBy("rank").collect()] == list(range(10))


def test_double_vectors_keep_their_precision(spark):
    e = spark.createDataFrame([(i, [1.0 + i * 1e-12, 2.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.search(e, e.where("vec_id = 0")).orderBy("rank").collect()] == list(range(1, 11))


def test_every_query_gets_all_it_can(spark):
    rng = np.random.default_rng(4)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = lambda df, **kw: collections.Counter(r["query_id"] for r in ann.search(df, df, **kw).collect())
    for n in (2, 3, 7, 15, 20):
        x = np.concatenate([rng.normal(size=(n - 1, 8)), np.full((1, 8), 50.0)])
        assert found(frame(x)) == {i: min(10, n - 1) for i in range(n) if n > 1}
    centres = rng.normal(size=(20, 8)) * 10
    x = np.concatenate([centres[rng.integers(0, 20, 1200)] + rng.normal(size=(1200, 8)), rng.normal(size=(40, 8)) * 300])
    rows = frame(x)
    rows = rows.unionByName(frame(x[-1:]).withColumn("vec_id", F.lit(7777).cast("long"))).unionByName(rows.where("vec_id = 1239")).unionByName(rows.where("vec_id = 1239"))
    got = found(rows)
    assert set(got.values()) == {10} and len(got) == 1241
    # a list of one row, and one of copies of the query
    sizes, index = np.array([1, 2000, 2000]), ann.Index(np.array([[0.0], [5.0], [50.0]]), [], [])
    assert index.visits(np.zeros((1, 1)), sizes, np.array([11]))[1].tolist() == [0, 1]
    assert index.visits(np.zeros((1, 1)), sizes, np.array([2011]))[1].tolist() == [0, 1, 2]


# 6 ------------------------------------------------------------------------------------------------------------------


def brute_components(ids, fps, distance=4):
    u = np.array(fps, np.uint64)
    forest = simhash._Forest(len(u))
    forest.join(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= distance))
    root = forest.find(np.arange(len(u)))
    least = {}
    for r, i in zip(root.tolist(), ids):
        least[r] = min(i, least.get(r, i))
    return [least[r] for r in root.tolist()]


def test_simhash_documents(docs, odd, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert [r["component_id"] for r in rows] == brute_components([r["doc_id"] for r in rows], [int(r["fingerprint"], 16) for r in rows])
    assert simhash.near_duplicates(empty).count() == 0
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 101").count() == 1


def test_hash_is_sparks(spark):
    assert simhash.fingerprint("A b") == spark.sql("select xxhash64('a b') h").first()["h"] % 2**64


@pytest.mark.parametrize("large", [4096, 3])
def test_links_connect_what_brute_force_does(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_CELL", large)
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        b = rng.getrandbits(64)
        for _ in range(25):
            fps.add(b)
            for _ in range(rng.randrange(1, 6)):
                b ^= 1 << rng.randrange(64)
    u = np.array(sorted(fps), np.uint64)
    c = simhash.segment_counts(u)
    d = np.bitwise_count(u[:, None] ^ u[None, :])
    assert (simhash.manhattan(c[:, None], c[None, :]) <= d).all()
    a, b = simhash.connect(np.zeros(len(u), np.int64), u.view(np.int64), 4)
    want = brute_components(u.tolist(), u.tolist())
    forest = simhash._Forest(len(u))
    at = {int(x): i for i, x in enumerate(u.view(np.int64))}
    forest.join(np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    assert [int(u[i]) for i in forest.find(np.arange(len(u)))] == want
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
    groups = collections.defaultdict(set)
    for x, w in zip(u.view(np.int64).tolist(), want):
        groups[w].add(x)
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def brute_kept(texts, similarity=0.8, width=5):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))))
    forest = simhash._Forest(len(texts))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= similarity * len(x | y) - 1e-9:
                forest.join(np.array([i]), np.array([j]))
    return {int(i) for i in forest.find(np.arange(len(texts)))}


def test_parities_drop_no_similar_pair(monkeypatch):
    monkeypatch.setattr(simhash, "PARITY_BITS", (64, 1 << 10))
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(pool[:n]) for n in (1, 2, 30, 34, 64, 65, 300, 320, 900, 1200, 4000)]
    for s in list(sets):  # a part exchanged, so that similarities lie on both sides of 0.8
        for share in (0.05, 0.1, 0.12, 0.3):
            other = s.copy()
            other[: int(share * len(s))] = rng.integers(0, 1 << 63, int(share * len(s)))
            sets.append(np.unique(other))
    parity = simhash._Parities(np.array([len(s) for s in sets]), [simhash.parities(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    jaccard = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    for similarity in (0.5, 0.8, 1.0):
        ok = parity.allow(i, j, similarity)
        assert ok[jaccard >= similarity].all()
        assert not ok[jaccard < similarity - 0.3].any()


def test_pipeline_drops_near_copies_of_five_word_shingles(spark, odd, empty):
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for n, edits in [(n, e) for n in (100, 300, 1000) for e in (0.003, 0.008, 0.012, 0.02, 0.026, 0.04) for _ in range(12)]:
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(2):
            again = list(words)
            for at in rng.sample(range(n), max(1, round(edits * n))):
                again[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(again))
    line = " ".join(f"line{i}" for i in range(20))  # a common line makes no near copies
    texts += [line + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(50)] + ["", " ", "a b c", "A  b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = brute_kept(texts)
    assert len(kept) < 0.75 * len(texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == kept
    few = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    at = [(r["doc_id"], r["text"]) for r in few.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, few, SF).collect()} == {at[i][0] for i in brute_kept([t for _, t in at])}
    out = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert out.columns == odd.columns and out.where("doc_id = 101").count() == 1 and corpus_pipeline.near_duplicates(spark, empty, SF).count() == 0


@pytest.mark.parametrize("large", [4096, 3])
def test_grids_of_segment_counts_hold_similar_sets(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_CELL", large)
    rng = np.random.default_rng(6)
    # pairs of sets at 0.8 or little more: in common, only in one, only in the other
    kinds = [(4, 0, 1), (8, 2, 0), (8, 1, 1), (12, 2, 1), (40, 5, 5), (40, 10, 0), (200, 25, 25), (600, 150, 0), (900, 50, 40)]
    sets = []
    for c, x, y in [k for k in kinds for _ in range(20)]:
        h = np.unique(rng.integers(0, 1 << 63, c + x + y).astype(np.uint64))
        rng.shuffle(h)
        sets += [np.sort(h[: c + x]), np.sort(np.concatenate([h[:c], h[c + x :]]))]
    grids = simhash.Grids(0.8, len(sets))
    assert grids.missed <= simhash.MISS and simhash.Grids(0.8, 10**7).missed <= simhash.MISS and simhash.Grids(1.0, 5).words
    words = np.array([simhash.set_words(s, grids.words) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    for w in range(3):  # the bound
        c = simhash.segment_counts(words[:, w])
        assert (simhash.manhattan(c[i], c[j]) <= np.bitwise_count(words[i, w] ^ words[j, w])).all()
    # by brute force: links of some cell within the distance
    forest = simhash._Forest(len(sets))
    for w, masks in enumerate(grids.masks):
        near = sum(np.bitwise_count(words[i, v] ^ words[j, v]) for v in (w, (w + 1) % grids.words)) <= grids.distance
        c = simhash.segment_counts(words[:, w])
        for m in masks:
            ok = near & ((c[i] ^ c[j]) & np.uint64(m) == 0)
            forest.join(i[ok], j[ok])
    df = spark.createDataFrame([(n, w) for n, w in enumerate(words.view(np.int64).tolist())], "node long, words array<long>")
    got = {r["node"]: r["root"] for r in connected_components(simhash.similar_links(df, grids)).collect()}
    roots = [got.get(n, n) for n in range(len(sets))]
    assert roots == forest.find(np.arange(len(sets))).tolist()
    assert all(roots[n] == roots[n + 1] for n in range(0, len(sets), 2))
    assert len(set(roots)) > len(sets) / 2 - 5


def test_near_copies_are_found_by_the_grid_join_only(spark, monkeypatch):
    words = [f"w{n}" for n in range(60)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:59])), (2, "a b c")], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one_similar(df).collect()} == {0, 2}
    monkeypatch.setattr(simhash, "similar_links", lambda nodes, grids: spark.createDataFrame([], "a long, b long"))
    assert {r["doc_id"] for r in simhash.keep_one_similar(df).collect()} == {0, 1, 2}


def test_near_copies_in_chains_take_rounds_of_components_once(spark, monkeypatch):
    words = [f"w{n}" for n in range(2000)]
    # 200 words each, six further than the one before: only up to three steps apart they are similar
    chains = [[(100 * c + n, " ".join(f"{c}{w}" for w in words[6 * n : 6 * n + 200])) for n in range(40)] for c in range(3)]
    df = spark.createDataFrame([r for chain in chains for r in chain[::-1]] + [(1000, "a b c")], "doc_id long, text string")
    calls, plain = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: calls.append(1) or plain(links))
    assert {r["doc_id"] for r in simhash.keep_one_similar(df).collect()} == {0, 100, 200, 1000}
    assert len(calls) == 1


def test_links_join_roots_of_cells(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, (2, 400)) + 100 * (cell := rng.integers(0, 40, 400))
    forest = simhash._Forest(4000)
    forest.join(a, b)
    root = forest.find(np.arange(4000))
    want = {n: int(root[n]) for n in {*a.tolist(), *b.tolist()} if root[n] != n}
    df = spark.createDataFrame([(int(c), int(x), int(y)) for c, x, y in zip(cell, a, b)], "cell long, ra long, rb long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = simhash._joined(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["root"]: r["to"] for r in rows} == want and len(rows) == len(want)
    assert simhash._joined(df.limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text("ab1.@-_+% 2", max_size=40))
def test_base_patterns_are_plain_regular_expressions(t):
    import re

    assert list(pii._emails(t)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    assert [m.span() for m in pii._IP.finditer(t)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)]


def test_spans(odd, empty):
    t = "mail x.y+z@mail.example.com or 10.0.0.256 10.0.0.255, card 4845 1681-14407329, call +1 (017) 555-7713; IBAN DE89 3704 0044 0532 0130 00. no 4845168114407320"
    base, more = pii.find(t)
    assert [k for k, _, _ in base] == ["email", "ip", "card", "phone"] and [k for k, _, _ in more] == ["iban"]
    assert pii.redact(t) == "mail <email> or 10.0.0.256 <ip>, card <card>, call <phone>; IBAN <iban>. no 4845168114407320"
    assert [k for k, _, _ in pii.find("ssn 078-05-1120")[1]] == ["ssn"] and not pii.find("part 078-05-1120")[1]
    assert pii.scan(odd).count() == odd.count() and pii.scan(empty).count() == 0
    row = pii.scan(odd).where("doc_id = 100").first()
    assert row["spans"] == "" and row["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.redact_column(odd).where("doc_id = 100").first()["text"] is None


@pytest.mark.parametrize("word", ["key", "token", "secret", "password", "api", "aws", "credential"])
def test_secrets_by_every_context_word(word):
    digits = "0123456789abcdef" * 2
    for w in (word, word.title(), word.upper(), word[0] + word[1:].upper()):
        assert [k for k, _, _ in pii.find(f"{w}: {digits} on")[1]] == ["secret"]
        assert pii.redact(f"{w} {digits}") == f"{w} <secret>"
    assert not pii.find(f"colour: {digits}")[1]


# 8 ------------------------------------------------------------------------------------------------------------------


def test_account_numbers():
    spans = lambda t: [t[s:e] for _, s, e in pii.more_spans(t)]
    assert spans("pay BE68 5390 0754 7034 EURO now") == ["BE68 5390 0754 7034"] == spans("BE68 5390 0754 7034")
    assert spans("BE69 5390 0754 7034") == [] == spans("xBE68 5390 0754 7034")
    # words against it outweigh the check alone, a word for it does not give way
    assert spans("example: BE68 5390 0754 7034") == [] and spans("example iban: BE68 5390 0754 7034") == ["BE68 5390 0754 7034"]


def luhn_plain(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4845 1681 1440 7329", "4845168114407329", "4111-1111-1111-1111", "+1 (017) 555-7713", "+49.30 1234567", "1.2.3.4", "300.1.1.1", "a@b.cd", " ", "7", "-", "+", ")", "x"]), max_size=8))
def test_base_spans_by_brute_force(parts):
    t = "".join(parts)
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn_plain(d)]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert list(pii.base_spans(t)) == want


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 3), (900, 50), (3000, 10**9), (2000, 2**62)):
        v = np.sort(rng.integers(0, top, n))
        e = ngram_lm.EliasFano.build(v)
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top, 500)])
        at = np.searchsorted(v, q)
        assert e.find(q).tolist() == [int(i) if i < n and v[i] == x else -1 for i, x in zip(at, q)]


def brute_lm(texts):
    tok = {i: [*ngram_lm.words_of(t or ""), b"<end>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c = collections.Counter(w for i, t in tok.items() if not held[i] for w in t)
    pairs = collections.Counter(p for i, t in tok.items() if not held[i] for p in zip([b"<end>", *t], t))
    total, kinds = collections.Counter(), collections.Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        kinds[v] += 1
    size = sum(c.values())
    uni = lambda w: (c[w] + 1) / (size + len(c) + 1)
    p = lambda v, w: (pairs[v, w] - 0.75) / total[v] if pairs[v, w] else uni(w) * (0.75 * kinds[v] / total[v] if total[v] else 1)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), size, sum(math.log10(uni(w)) for w in t), sum(math.log10(p(v, w)) for v, w in zip([b"<end>", *t], t))) for i, t in tok.items()}


@pytest.mark.parametrize("share,batch", [(10**9, 10**9), (60_000, 90_000), (10_000, 50_000)])
def test_language_model(docs, texts, odd, empty, monkeypatch, share, batch):
    """The least shares split the frequent words' contexts."""
    monkeypatch.setattr(ngram_lm, "SHARE_CHARS", share)
    monkeypatch.setattr(ngram_lm, "BATCH_CHARS", batch)
    want = brute_lm(texts)
    out = ngram_lm.score(docs).collect()
    assert len(out) == len(want)
    for r in out:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and r["base_score"] == pytest.approx(w[4])
        assert r["score"] == pytest.approx(w[5], rel=0.01)  # codes of one byte
    assert sum(r["score"] for r in out) == pytest.approx(sum(w[5] for w in want.values()), rel=0.002)
    assert sum(r["score"] for r in out if r["held_out"]) > sum(r["base_score"] for r in out if r["held_out"])
    assert ngram_lm.score(odd).count() == odd.count() and ngram_lm.score(empty).count() == 0


def test_language_model_exactly(spark, monkeypatch):
    """With few distinct probabilities the codebook holds them all, so scores are exact; one context is in most texts, and split."""
    monkeypatch.setattr(ngram_lm, "SHARE_CHARS", 400)
    monkeypatch.setattr(ngram_lm, "BATCH_CHARS", 300)
    rng = random.Random(9)
    texts = {i: " ".join(x for _ in range(rng.randrange(30)) for x in ("the", rng.choice("abcdefghijk") * rng.randrange(1, 3))) for i in range(80)} | {500: "the " * 700}
    out = ngram_lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    want = brute_lm(texts)
    assert {r["doc_id"]: tuple(r)[1:5] for r in out} == {i: w[:4] for i, w in want.items()}
    for r in out:
        assert (r["base_score"], r["score"]) == (pytest.approx(want[r["doc_id"]][4]), pytest.approx(want[r["doc_id"]][5], rel=1e-6))


# 9 ------------------------------------------------------------------------------------------------------------------


def brute_repeats(raw):
    c = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if c[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("piece,rows", [(1 << 20, 4096), (500, 3)])
def test_repeats(spark, monkeypatch, odd, empty, piece, rows):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "ROWS", rows)
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    shared = [draw("abcdefgh é", rng.choice([150, 190, 199, 200, 201, 230, 400, 900])) for _ in range(25)]
    t = ["".join(rng.choice([rng.choice(shared), draw("xyzuvw ", rng.randrange(120))]) for _ in range(rng.randrange(7))) for _ in range(80)]
    t += ["a" * 1000, "ab" * 300, t[5], t[5], "", t[7][:300] + "Q" + t[7][300:], "z" * 199, "z" * 200]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(t))] == brute_repeats([x.encode() for x in t])
    assert suffix_dedup.remove_repeats(odd).count() == odd.count() and suffix_dedup.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q1" * 150), (1, "q1" * 150), (2, "w" + draw("mnop", 300))], "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(twice), "doc_id", "n_removed") == [(1, 300), (1, 300), (2, 0)]
    stripped = suffix_dedup.strip_repeats(odd)
    assert stripped.columns == odd.columns and stripped.where("text is null").count() == 1


# 10 -----------------------------------------------------------------------------------------------------------------


def test_classifier(spark, odd, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(d, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [r for r in quality_model.score(d, model).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    scored = quality_model.score(odd, model)
    assert scored.count() == odd.count() and scored.where("score is null or isnan(score)").count() == 0
    assert quality_model.score(empty, model).count() == 0
    none = quality_model.train(d, labels.limit(0))
    assert quality_model.score(odd, none).select("score").distinct().count() == 1
    assert quality_model.keep_good(odd, none).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    at, counts = d, [d.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = materialize(stage(spark, at, SF), "test")
        if i < 4:
            assert at.columns == d.columns
            counts.append(at.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert at.count() >= counts[-1]
