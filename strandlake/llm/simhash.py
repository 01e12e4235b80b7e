"""SimHash near-duplicates by a grid join over segment bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments.  The Manhattan distance of two such vectors is
never more than the fingerprints' Hamming distance, so it is a lower bound to filter by before the exact test.  For the range join
at distance d the segments are dealt into d + 3 groups: where the Manhattan distance is at most d, at least three whole groups
agree.  Every choice of three groups makes a grid whose cells are the counts in these groups; two fingerprints within
the distance share a cell of some grid.  Within a cell, pairs pass the Manhattan bound and then the exact test.

Only links that connect what isn't connected yet leave a cell, so a cell of n fingerprints gives at most n - 1 links
for a whole group of near copies, whatever its size.

``keep_one_similar`` decides by the Jaccard similarity of shingle sets, and finds pairs by the same grid join.  At 0.8 fingerprints
differ by about 15 % of their bits, for which three whole groups of one word don't tell pairs apart.  So a set has several words of
64 bits, and a grid's cells are the counts in some of one word's segments, drawn at random: as many segments as hold a cell to
about MATES unlike sets, and as many grids as a pair at that similarity misses altogether with probability MISS.  Within a
cell pairs pass the Manhattan bound, then the exact distance, both over the grid's word and the next.  What such links connect is compared
further: fingerprints within WIDE bits, sets whose sizes and parity vectors allow the similarity, and the exact similarity of
both sets decides.  Sets differ in at least as many shingles as their parity vectors in bits, so these drop no similar pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, repeat
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, free_name, map_texts, materialize
from .components import connected_components

SEED = 42
BITS = 64
_PAIRS = 0x5555555555555555
#: A pair of sets at just the similarity asked for shares no grid's cell with this probability at most.
MISS = 1e-6
#: Unlike sets that a cell holds at most, of random fingerprints; grids of one round, whose rows are on disk at the same time.
MATES, ROUND = 128, 64
#: Passes over the pairs that would connect a cell, at most, before all that are still apart are tested.
ORDERS = 6
#: Bits that fingerprints of shingle sets may differ by before the exact test; at similarity 0.8 about 10, with a deviation of 3.
WIDE = 24
#: Bits of a parity vector: at least two for each shingle, from the first to the last of these.
PARITY_BITS = 64, 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """Majority bits of the hashes of the text's ``width``-word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-width])]
    counts, total = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, total, 50_000):
        cut = zip(starts[at : at + 50_000], ends[at + width - 1 : at + 50_000 + width - 1], strict=False)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in cut], repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row's whole text; a null text has none of the words."""

    def kernel():
        def f(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            return pa.record_batch([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

        return f

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, fp long")


def shingle_set(text: str, width: int) -> np.ndarray:
    """Distinct hashes of the text's ``width``-word shingles in order; one of all words if they are fewer, of nothing without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    cut = zip([0, *(e + 1 for e in ends[:-width])], ends[width - 1 :], strict=True)
    hashes = np.sort(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut), np.uint64))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def set_fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of a shingle set."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 50_000):
        counts += np.unpackbits(hashes[at : at + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def set_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """Majority bits of a shingle set in so many words of 64 bits, each of the hashes mixed in its own way."""
    counts, salts = np.zeros(BITS * words, np.int64), np.random.default_rng(SEED).integers(0, 1 << 63, words, np.uint64)
    for at in range(0, len(hashes), 255):  # counts of so many fit a byte
        x = (hashes[at : at + 255, None] ^ salts) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(32)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def parities(hashes: np.ndarray) -> bytes:
    """By bit, whether an odd number of the hashes falls on it.

    A vector folded in halves (exclusive or) is that of half as many bits.  At any width two sets' vectors differ in no more bits
    than the sets in hashes.
    """
    least, most = PARITY_BITS
    size = min(max(least, 1 << (2 * len(hashes) - 1).bit_length()), most)
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


class _Parities:
    """Parity vectors of sets of so many hashes each; tells which pairs of sets may be similar."""

    def __init__(self, sizes: np.ndarray, vectors: list[bytes]) -> None:
        self.sizes, self.width = sizes, np.array([len(v) // 8 for v in vectors])
        self.own = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.own[w] = rows, np.frombuffer(b"".join([vectors[r] for r in rows.tolist()]), np.uint64).reshape(-1, w)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Each set's place in a table of vectors folded to ``w`` words, and the table."""
        if w not in self.folded:
            wide = [(rows, np.bitwise_xor.reduce(m.reshape(len(m), -1, w), axis=1)) for x, (rows, m) in self.own.items() if x >= w]
            place = np.zeros(len(self.width), np.int64)
            place[np.concatenate([rows for rows, _ in wide])] = np.arange(sum(len(rows) for rows, _ in wide))
            self.folded[w] = place, np.concatenate([m for _, m in wide])
        return self.folded[w]

    def allow(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """False where sets i and j are certainly less similar."""
        a, b = self.sizes[i], self.sizes[j]
        ok = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
        limit = (a + b) * (1 - similarity) / (1 + similarity) + 1e-6
        level = np.minimum(self.width[i], self.width[j])
        for w in np.unique(level[ok]).tolist():
            at = np.flatnonzero(ok & (level == w))
            place, table = self.at(w)
            step = max(1, (1 << 20) // w)
            for part in (at[x : x + step] for x in range(0, len(at), step)):
                apart = np.bitwise_count(table[place[i[part]]] ^ table[place[j[part]]]).sum(1, dtype=np.int64)
                ok[part] = apart <= limit[part]
        return ok


def segment_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, in two bits each of a 64-bit integer."""
    x = x.view(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(_PAIRS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed count vectors: the low and high bit of |a - b| per segment, for counts 0, 1, 2."""
    low, high = np.uint64(_PAIRS), np.uint64(_PAIRS << 1)
    x = a ^ b
    # equal: 0; 0 and 1 (01), 1 and 2 (11): one apart; 0 and 2 (10): two apart
    odd = np.bitwise_count(x & low)
    two = np.bitwise_count((x & high) & ~((x & low) << np.uint64(1)))
    return odd.astype(np.int64) + 2 * two


def grid_masks(distance: int) -> list[int]:
    """Masks over packed counts, one for each choice of three of distance + 3 groups of segments."""
    groups = np.array_split(np.arange(BITS // 2), distance + 3)
    parts = [sum(3 << (2 * int(s)) for s in g) for g in groups]
    return [a | b | c for a, b, c in combinations(parts, 3)]


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        while True:
            r = self.up[i]
            rr = self.up[r]
            if (r == rr).all():
                return r
            self.up[i] = rr

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


LARGE_CELL = 4096


def connect(cell: np.ndarray, fps: np.ndarray, distance: int, other: np.ndarray | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least connected one of its cell) over rows sorted by ``cell`` and distinct within it.

    ``other``: a second word of each fingerprint; distances are then of both.  ``names``: what links are to hold instead.
    """
    n, names = len(fps), fps if names is None else names
    counts, forest = segment_counts(fps), _Forest(n)
    bits = fps.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, n])
    big = sizes > LARGE_CELL
    ends = np.repeat(starts + sizes, sizes)

    words = [bits] if other is None else [bits, other.view(np.uint64)]
    bounds = [counts, *(segment_counts(w) for w in words[1:])]

    def test(i: np.ndarray, j: np.ndarray) -> None:
        ok = sum(manhattan(c[i], c[j]) for c in bounds) <= distance
        i, j = i[ok], j[ok]
        ok = sum(np.bitwise_count(w[i] ^ w[j]) for w in words) <= distance
        forest.join(i[ok], j[ok])

    i = np.flatnonzero(np.repeat(~big & (sizes > 1), sizes))
    step = 1
    while len(i):
        i = i[i + step < ends[i]]
        if len(i):
            test(i, i + step)
        step += 1
    for start, size in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
        # a large cell: neighbours at one bit first; then all pairs but those within the largest part so far
        at = np.arange(start, start + size)
        order = at[np.argsort(bits[at], kind="stable")]
        ranked = bits[order]
        if other is not None:  # near copies are more than one bit apart there: with some rows and the next one
            for x in at[:: max(1, size // 8)].tolist():
                test(np.full(size, x), at)
            test(order[:-1], order[1:])
        for b in range(BITS if other is None else 0):
            flipped = ranked ^ np.uint64(1 << b)
            k = np.minimum(np.searchsorted(ranked, flipped), size - 1)
            hit = ranked[k] == flipped
            forest.join(order[hit], order[k[hit]])
        roots = forest.find(at)
        values, inverse, many = np.unique(roots, return_inverse=True, return_counts=True)
        rest = at[inverse != many.argmax()]
        for x in rest.tolist():
            others = at[forest.find(at) != forest.find(np.array([x]))[0]]
            if len(others):
                test(np.full(len(others), x), others)
    root = forest.find(np.arange(n))
    linked = root != np.arange(n)
    return names[linked], names[root[linked]]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fps`` (fp) as all pairs within ``distance`` bits do."""
    if not 0 <= distance <= 8:
        raise ValueError("distance must be from 0 to 8")
    packed = _packed(F.col("fp"))
    cells = F.array(*(F.struct(F.lit(c).cast("short").alias("grid"), packed.bitwiseAND(F.lit(_signed(m))).alias("cell")) for c, m in enumerate(grid_masks(distance))))
    dealt = fps.select("fp", F.explode(cells).alias("at")).select("at.grid", "at.cell", "fp")
    return _linked(dealt.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp"), distance)


def _linked(dealt: DataFrame, distance: int) -> DataFrame:
    """Distinct links (a, b) by ``connect`` of each cell; dealt (grid, cell, fp and maybe other, node) has cells in one piece."""
    width = len(dealt.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last cell so far

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            number = np.cumsum(np.r_[0, (rows[:2, 1:] != rows[:2, :-1]).any(0)])
            # cells of one row have nothing to link
            alone = np.bincount(number)[number] == 1
            if not alone.all():
                fp, *more = (np.ascontiguousarray(x) for x in rows[2:, ~alone])
                a, b = connect(number[~alone], fp, distance, *more)
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)])
            if not rows.shape[1]:
                continue
            new = (rows[:2, 1:] != rows[:2, :-1]).any(0)
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if held and (held[-1][:2, -1] != rows[:2, 0]).any():
                yield from flush(np.concatenate(held, axis=1))
                held = []
            if cut:
                yield from flush(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from flush(np.concatenate(held, axis=1))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


class Grids:
    """Grids for sets of at least ``similarity``, below 1, among so many; each set has ``words`` words.

    ``masks``: by word, one over its packed counts for each grid.  ``distance``: bits that two words of such sets differ by at
    most, but for 3.5 deviations.  ``missed``: the probability that a pair at the similarity is in no cell together.
    """

    def __init__(self, similarity: float, sets: int) -> None:
        n = BITS // 2
        flip = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
        same = (1 - flip) ** 2 + flip**2 / 2  # a segment's count
        k = min(max(8, ceil(log(max(sets, 1) / MATES) / log(8 / 3))), n // 2)  # unlike segments have the same count 3 times in 8
        grids = ceil(1.3 / same**k)
        one = sum(comb(n, x) * same**x * (1 - same) ** (n - x) * (1 - comb(x, k) / comb(n, k)) ** grids for x in range(n + 1))
        one = max(one, MISS**2)
        self.words = max(2, ceil(log(MISS) / log(one)))
        self.missed = one**self.words
        self.distance = int(2 * BITS * flip + 3.5 * sqrt(2 * BITS * flip * (1 - flip)))
        rng = np.random.default_rng(SEED)
        self.masks = [[sum(3 << (2 * int(s)) for s in rng.choice(n, k, replace=False)) for _ in range(grids)] for _ in range(self.words)]


def similar_links(nodes: DataFrame, grids: Grids) -> DataFrame:
    """Links (a, b) that connect ``nodes`` (node, words) as all pairs within the grids' distance in a cell do."""
    each = max(1, ROUND // len(grids.masks[0]))
    out = []
    for at in range(0, grids.words, each):
        part = range(at, min(at + each, grids.words))
        word = lambda w: F.col("words")[w % grids.words]
        wide = nodes.select("node", *(word(w).alias(f"w{w}") for w in (*part, part[-1] + 1)), *(_packed(word(w)).alias(f"p{w}") for w in part))
        cells = [(w, m) for w in part for m in grids.masks[w]]
        cells = F.array(*(F.struct(F.lit(c).cast("short").alias("grid"), F.col(f"p{w}").bitwiseAND(F.lit(_signed(m))).alias("cell"), F.col(f"w{w}").alias("fp"), F.col(f"w{w + 1}").alias("other")) for c, (w, m) in enumerate(cells)))
        dealt = wide.select("node", F.explode(cells).alias("at")).select("at.grid", "at.cell", "at.fp", "at.other", "node")
        out.append(materialize(_linked(dealt.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "node"), grids.distance), "simhash-grids"))
        del dealt
        nodes.sparkSession._jvm.System.gc()  # Spark deletes a shuffle's files once nothing on the driver's heap refers to it
    return reduce(DataFrame.unionByName, out).distinct()


def _packed(x):
    """segment_counts on a column: in halves of 32 bits, as long arithmetic must not overflow."""
    half = F.lit(0x55555555)
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    count = lambda h: h - F.shiftright(h, 1).bitwiseAND(half)
    return F.shiftleft(count(high), 32).bitwiseOR(count(low))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links).

    Texts without words, nulls among them, have fingerprint zero and are linked like any other.  Rows with equal fingerprints
    are one node, so copies aren't expanded; a row with a null id keeps it and is reachable; repeated rows come out each;
    an empty table gives none; other columns are left aside.
    """
    rows = materialize(fingerprints(docs, width), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    placed = _roots(nodes, distance)
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _roots(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes`` (fp and more) with root, the least fingerprint of the component."""
    parts = connected_components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    return nodes.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last); of rows with the same id and text one."""
    own = free_name(docs, "key")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", F.lit("/"), "text"))
    rows = materialize(fingerprints(keyed.select(F.col(own).alias("doc_id"), "text"), width).withColumnRenamed("doc_id", "key"), "simhash")
    ids = keyed.select(F.col(own).alias("key"), "doc_id").distinct()
    least = rows.distinct().join(ids, "key").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    placed = _roots(materialize(least, "simhash-nodes"), distance)
    stays = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(own))
    return keyed.join(stays, own, "left_semi").dropDuplicates([own]).drop(own)


def _across(cells: DataFrame, similarity: float, forest: bool, order: int = 0) -> DataFrame:
    """(cell, a, b, ra, rb), a < b: pairs of nodes of a cell that have different roots (ra, rb), fingerprints within WIDE bits and
    parities that allow the similarity; cells (cell, node, fp, root, size, parity), a node once.  ``forest``: only those that connect
    what no such pair of the cell before them does, in one of several orders.
    """
    dealt = cells.select("cell", "node", "fp", "root", "size", "parity").repartition("cell").sortWithinPartitions("cell", F.xxhash64("node", F.lit(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []  # the last cell so far: (cell, node, fp, root, size), parity

        def flush(parts: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            cell, node, fp, root, size = np.concatenate([rows for rows, _ in parts], axis=1)
            parity = _Parities(size, [v for _, vectors in parts for v in vectors])
            bits, n = fp.view(np.uint64), len(cell)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, n])
            ends = np.repeat(starts + sizes, sizes)
            trees = _Forest(n)
            if forest:  # what has a root in common is connected already
                by = np.lexsort((root, cell))
                same = (cell[by[1:]] == cell[by[:-1]]) & (root[by[1:]] == root[by[:-1]])
                trees.join(by[:-1][same], by[1:][same])
            i, step = np.arange(n), 1
            while len(i):
                i = i[i + step < ends[i]]
                hit = i[(root[i] != root[i + step]) & (np.bitwise_count(bits[i] ^ bits[i + step]) <= WIDE)]
                if forest:
                    hit = hit[trees.find(hit) != trees.find(hit + step)]
                hit = hit[parity.allow(hit, hit + step, similarity)]
                if forest and len(hit):
                    x, y = trees.find(hit), trees.find(hit + step)
                    # one pair for two trees
                    hit = hit[np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)[1]]
                    trees.join(hit, hit + step)
                if len(hit):
                    x, y = np.where(node[hit] < node[hit + step], (hit, hit + step), (hit + step, hit))
                    yield pa.record_batch([pa.array(c) for c in (cell[x], node[x], node[y], root[x], root[y])], ["cell", "a", "b", "ra", "rb"])
                step += 1

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            if not rows.shape[1]:
                continue
            vectors = batch.column(5).to_pylist()
            new = rows[0, 1:] != rows[0, :-1]
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if held and held[-1][0][0, -1] != rows[0, 0]:
                yield from flush(held)
                held = []
            if cut:
                yield from flush([*held, (rows[:, :cut], vectors[:cut])])
                held = []
            held.append((rows[:, cut:], vectors[cut:]))
        if held:
            yield from flush(held)

    return dealt.mapInArrow(run, "cell long, a long, b long, ra long, rb long")


def _joined(links: DataFrame) -> DataFrame:
    """(root, to): for each root that ``links`` (cell, ra, rb) within cells connect with lesser ones, the least of these.

    A cell's links meet in one task, as its nodes do in ``_across``; this takes one shuffle, and no rounds.
    """
    dealt = links.select("cell", "ra", "rb").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # links of the last cell so far

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            names, at = np.unique(rows[1:], return_inverse=True)
            trees, each = _Forest(len(names)), np.arange(len(names))
            trees.join(*at.reshape(2, -1))
            root = trees.find(each)
            moved = root != each
            return pa.record_batch([pa.array(names[moved]), pa.array(names[root[moved]])], ["root", "to"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if not rows.shape[1]:
                continue
            rows = np.concatenate([*held, rows], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if cut:
                yield flush(rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield flush(held[0])

    return dealt.mapInArrow(run, "root long, to long")


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of ``pairs`` (a, b and other longs) whose shingle sets are as similar; texts (node, text)."""
    own = len(pairs.columns)

    def sets():
        def f(batch: pa.RecordBatch, part: list[str]) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in part], pa.binary())], ["node", "set"])

        return f

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(own), batch.column(own + 1), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(range(own)).filter(pa.array(ok, pa.bool_()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = materialize(map_texts(texts.join(asked, "node", "left_semi").select("node", "text"), sets, "node long, set binary"), "simhash-sets")
    one = known.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = known.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select(*pairs.columns, "x", "y")
    out = materialize(both.mapInArrow(test, ", ".join(f"{c} long" for c in pairs.columns)), "simhash-similar")
    drop_materialized(known)
    return out


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each group that pairs of at least ``similarity`` connect, with all its columns: that of the smallest doc_id (null last).

    Similarity is Jaccard's, of the sets of ``width``-word shingles.  Texts without words, nulls among them, are copies of each
    other; rows with equal sets are one node, so copies aren't expanded.  A grid join of the sets' fingerprints tells what may be
    similar; what its links connect is a cell of what follows.  Each node is tested with the least of its cell first.
    Of the pairs that aren't connected by then and whose parity vectors allow the similarity, those that would connect a cell are
    next, in several orders while they find some, and then all that are still apart.
    """
    own = free_name(docs, "key")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", F.lit("/"), "text"))

    def kernel():
        def f(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            sets = [shingle_set(t, width) for t in texts]
            named = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
            # a smaller set has no other one as similar
            words = [set_words(s, count).view(np.int64) if len(s) * (1 - similarity) >= similarity - 1e-6 else None for s in sets]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(named), pa.array(fps), pa.array(words, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary())], ["key", "doc_id", "node", "fp", "words", "size", "parity"])

        return f

    grids = Grids(similarity, docs.count())
    count = grids.words
    ided = keyed.select(F.col(own).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = map_texts(ided, kernel, "key long, doc_id long, node long, fp long, words array<long>, size long, parity binary")
    least = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "fp", "words", "size", "parity")).alias("least"))
    nodes = materialize(least.select("node", F.struct("least.none", "least.doc_id", "least.key").alias("least"), "least.fp", "least.words", "least.size", "least.parity"), "simhash-nodes")
    groups = connected_components(similar_links(nodes.where("words is not null"), grids)).withColumnRenamed("root", "centre")
    cells = materialize(nodes.select("node", "fp").join(groups, "node").select(F.col("centre").alias("cell"), "node", "fp", "centre"), "simhash-cells")
    texts = keyed.select(own, "text").join(nodes.select("node", F.col("least.key").alias(own)), own).dropDuplicates(["node"]).select("node", "text")
    # first with the least of the cell: a group of near copies is one after it
    centres = cells.where("node <> centre").select("node", F.col("centre").alias("a"), "fp")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("afp"))) <= WIDE
    near = nodes.select(F.col("node").alias("a"), F.col("fp").alias("afp"))
    first = materialize(centres.join(near, "a").where(close).select("a", F.col("node").alias("b")), "simhash-pairs")
    linked = _similar(first, texts, similarity, width)
    # these links are stars, so the centre is the root; later links are between roots, which are joined cell by cell
    early = materialize(cells.join(linked.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root")), "simhash-roots")
    drop_materialized(cells)
    mixed = early.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("cell")
    late = materialize(early.join(mixed, "cell", "left_semi").join(nodes.select("node", "fp", "size", "parity"), "node"), "simhash-mixed")
    tested = first
    forest, order = True, 0
    while True:
        rest = materialize(_across(late, similarity, forest, order).join(tested, ["a", "b"], "left_anti"), "simhash-pairs")
        more = _similar(rest, texts, similarity, width)
        found = not more.isEmpty()
        if found:
            last, late = late, materialize(late.join(_joined(more), "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"), "simhash-mixed")
            drop_materialized(last)
        drop_materialized(more)
        if not forest:
            break
        tested = tested.unionByName(rest.select("a", "b"))
        # a pair that isn't similar may stand for some that are; another order has others
        order += 1
        forest = order < ORDERS and found
    placed = nodes.select("node", "least").join(early.select("node", F.col("root").alias("early")), "node", "left").join(late.select("node", F.col("root").alias("late")), "node", "left")
    roots = placed.withColumn("root", F.coalesce("late", "early", "node"))
    stays = roots.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(own))
    return keyed.join(stays, own, "left_semi").dropDuplicates([own]).drop(own)
