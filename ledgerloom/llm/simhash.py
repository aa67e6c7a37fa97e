"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most THRESHOLD bits. The anchors
are the codewords of a covering code: on each of two blocks of 23 bits the perfect
Golay code, whose 4,096 words cover the block with radius 3; so 2**24 anchors cover
46 of the 64 bits. Beyond THIRD distinct fingerprints a perfect Hamming code covers 15 bits
more (radius 1, 2,048 words), so that 2**35 anchors keep the runs of an anchor short, for 2.5
times the replicas. A fingerprint's home is the anchor nearest to it in each block. It
is replicated to every anchor that lies within the radius plus its share of the
threshold in each block (shares summing to THRESHOLD at most). If x and y differ in
at most THRESHOLD bits, they do so in the blocks together, so y lies within the radius plus
its share of x's home in each block: both are at x's home, and comparing every
fingerprint with the homes of an anchor finds each link. No cap is set anywhere.

Equal fingerprints are grouped first, so copies are never paired. Within an anchor
only a spanning forest of the links found is emitted; components are found by
alternating large-star and small-star steps, all in DataFrames, until nothing changes.

Defined results: null and empty texts have fingerprint zero and link like any other; a row
without doc_id links like any other, and the smallest id of its class is that of the rows
that have one (null if none has); rows repeat as they come; the length of a text has no
bound; an empty table gives no rows; columns other than the id and the text don't matter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import bounded, cut, read, small_batches

THRESHOLD, SHINGLE, SEED = 2, 3, 42
_CHUNK = 1 << 14
#: Distinct fingerprints from which a third block is covered; class members (16 bytes each and an entry in a hash table) that may be broadcast.
THIRD, CLASSED = 1 << 24, 500_000
#: Fingerprints that a task replicates, about.
SPREAD = 10_000
#: Runs of an anchor beyond this are searched outward from their members instead of pair by pair.
_RUN = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle))))
        n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED)), np.dtype("<u8"), n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist())


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, sets: bool = False) -> DataFrame:
    """doc_id (what id_col holds) and fp (the 64 bits as a signed long); with sets also sig, n and n_first: signature and sizes of the set of shingles."""
    small_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            cols = {"doc_id": b.column(0), "fp": pa.array(fp, pa.int64())}
            if sets:
                own = [shingles.tokens(t) for t in texts]
                cols["sig"] = pa.array(np.array([shingles.signature(x) for x in own], np.uint64).view(np.int64))
                cols["n"] = pa.array([len(x) for x in own], pa.int64())
                cols["n_first"] = pa.array([int(shingles.in_first(x).sum()) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(work, f"doc_id {kind}, fp bigint" + (", sig bigint, n bigint, n_first bigint" if sets else ""))


class Code:
    """A perfect cyclic code: n bits, of which `check` low ones follow from the others by the polynomial."""

    def __init__(self, n: int, check: int, poly: int, radius: int, excess: int):
        self.n, self.check = n, check
        unit = []
        for i in range(n):
            x = 1 << i
            for b in range(n - 1, check - 1, -1):
                if x >> b & 1:
                    x ^= poly << (b - check)
            unit.append(x)
        #: Syndromes of the low 12 and the high bits.
        self.low, self.high = self._table(unit[:12]), self._table(unit[12:])
        near: list[list[tuple[int, int]]] = [[] for _ in range(1 << check)]
        for w in range(radius + excess + 1):
            for bits in itertools.combinations(range(n), w):
                s = 0
                for i in bits:
                    s ^= unit[i]
                near[s].append((max(0, w - radius), sum(1 << i for i in bits)))
        #: For each syndrome the error patterns that lead to anchors, by their excess over the radius.
        self.errors = [[np.array([e for x, e in rows if x == k], np.int64) for rows in near] for k in range(excess + 1)]
        self.leader = np.array([rows[0][1] for rows in near], np.int64)

    @staticmethod
    def _table(unit: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for u in unit:
            out = np.concatenate([out, out ^ u])
        return out

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.leader[self.syndrome(x)]) >> self.check


#: Bits, check bits, polynomial and radius of the binary Golay code of length 23 and the Hamming code of length 15.
GOLAY, HAMMING = (23, 11, 0xC75, 3), (15, 4, 0x13, 1)
_CODES: dict[tuple, Code] = {}


def _code(kind: tuple, excess: int) -> Code:
    if (kind, excess) not in _CODES:
        _CODES[kind, excess] = Code(*kind, excess)
    return _CODES[kind, excess]


def _blocks(fp: np.ndarray, third: bool, excess: int) -> list[tuple[Code, np.ndarray]]:
    golay = _code(GOLAY, excess)
    out = [(golay, fp & 0x7FFFFF), (golay, fp >> 23 & 0x7FFFFF)]
    return [*out, (_code(HAMMING, excess), fp >> 46 & 0x7FFF)] if third else out


def home(fp: np.ndarray, excess: int = THRESHOLD, third: bool = False) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for code, x in _blocks(fp, third, excess):
        out = out << (code.n - code.check) | code.home(x)
    return out


def anchors(fp: np.ndarray, excess: int = THRESHOLD, third: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for every anchor within the radius plus the threshold."""
    blocks = [(code, x, code.syndrome(x)) for code, x in _blocks(fp, third, excess)]
    at, out = [], []
    for i in range(len(fp)):
        had = [np.zeros(1, np.int64)]  # the words so far, by their share of the threshold
        for code, x, s in blocks:
            words = [(x[i] ^ code.errors[k][s[i]]) >> code.check for k in range(excess + 1)]
            had = [
                np.concatenate([(a[:, None] << (code.n - code.check) | words[k - j][None, :]).ravel() for j, a in enumerate(had[: k + 1])])
                for k in range(excess + 1)
            ]
        both = np.concatenate(had)
        at.append(np.full(len(both), i))
        out.append(both)
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(anchor: np.ndarray, fp: np.ndarray, limit: int, third: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the links that have a home of their anchor at one end; anchors are sorted."""
    n = len(anchor)
    own = home(fp, limit, third) == anchor
    bits = np.ascontiguousarray(fp).view(np.uint64)  # of a signed number numpy would count the bits of its absolute value
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if n else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [n]]))
    parent = np.arange(n)
    run = np.repeat(length, length)
    pi, pj = [], []
    left = np.flatnonzero(run <= _RUN)
    for k in range(1, _RUN):
        left = left[left + k < n]
        left = left[anchor[left + k] == anchor[left]]
        if not len(left):
            break
        hit = left[(own[left] | own[left + k]) & (np.bitwise_count(bits[left] ^ bits[left + k]) <= limit)]
        pi.append(hit)
        pj.append(hit + k)
    for a, m in zip(first[length > _RUN], length[length > _RUN]):
        todo = np.arange(a, a + m)
        while len(todo):  # outward from each member not yet reached
            front, todo = [todo[0]], todo[1:]
            while front and len(todo):
                x = front.pop()
                near = (np.bitwise_count(bits[x] ^ bits[todo]) <= limit) & (own[x] | own[todo])
                if near.any():
                    got = todo[near]
                    todo = todo[~near]
                    pi.append(np.full(len(got), x))
                    pj.append(got)
                    front.extend(got.tolist())
    if not pi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(pi), np.concatenate(pj)
    while len(i):
        low = np.minimum(parent[i], parent[j])
        before = parent.copy()
        np.minimum.at(parent, i, low)
        np.minimum.at(parent, j, low)
        np.minimum.at(parent, before[i], low)
        np.minimum.at(parent, before[j], low)
        parent = parent[parent]
        if np.array_equal(parent, before):
            break
    member = np.flatnonzero(parent != np.arange(n))
    return fp[member], fp[parent[member]]


def links(nodes: DataFrame, threshold: int = THRESHOLD, third: bool | None = None) -> DataFrame:
    """(u, v), u > v: fingerprints that link, enough of them to connect all that do.

    nodes: fp (distinct). third: whether a third block is covered (None: by their number)."""
    total = nodes.count()
    third = total > THIRD if third is None else third

    def spread(batches):
        for b in batches:
            fp = np.asarray(b.column(0))
            for k in range(0, len(fp), 4096):
                at, anchor = anchors(fp[k : k + 4096], threshold, third)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[k : k + 4096][at])], names=["anchor", "fp"])

    def compare(batches):
        def edges(parts):
            a, f = (np.concatenate(x) for x in zip(*parts))
            u, v = _forest(a, f, threshold, third)
            key = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1])], names=["u", "v"])

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = tuple(np.asarray(b.column(k)).astype(np.int64) for k in range(2))
            held.append(cols)
            if sum(len(x[0]) for x in held) < 1 << 18 or cols[0][0] == cols[0][-1] and held[0][0][0] == cols[0][0]:
                continue
            a = [np.concatenate(x) for x in zip(*held)]
            stop = int(np.searchsorted(a[0], a[0][-1]))  # the last anchor may go on in the next batch
            if stop:
                yield edges([tuple(x[:stop] for x in a)])
            held = [tuple(x[stop:] for x in a)]
        if held:
            yield edges(held)

    # Fingerprints are small and each becomes many replicas: they are dealt by their number, not by their bytes.
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-total // SPREAD))
    spots = nodes.select("fp").repartition(parts, "fp").mapInArrow(spread, "anchor bigint, fp bigint")
    dealt = spots.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every id in edges (u, v), u > v.

    Large-star joins every larger neighbour to the smallest, small-star the smaller
    ones; the rounds needed grow with the logarithm of a component's size. The rows of
    a hub meet its minimum in a sort-merge join, which the engine can split."""
    e = cut(edges)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = cut(both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        up = large.join(low, F.col("u") == F.col("k"))
        new = cut(up.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        if e.exceptAll(new).isEmpty() and new.exceptAll(e).isEmpty():
            break
        e = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def group(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similar: bool = True) -> DataFrame:
    """doc_id (what id_col holds, of any type that can be ordered), fp, component_id for every row.

    similar: texts also link whose sets of shingles are similar (see `shingles`), however far their fingerprints lie apart."""
    fps = cut(fingerprints(docs, text, id_col, shingle, similar))
    node = "sig" if similar else "fp"
    same = cut(fps.select("fp").distinct())
    edges = links(same, threshold)
    if similar:
        pairs = cut(fps.select("fp", "sig").distinct())
        first = pairs.groupBy("fp").agg(F.min("sig").alias("first"))  # stands for its fingerprint
        for end in ("u", "v"):
            edges = edges.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_sig")), end)
        edges = edges.select(F.col("u_sig").alias("u"), F.col("v_sig").alias("v"))
        edges = edges.unionByName(pairs.join(first, "fp").select(F.col("sig").alias("u"), F.col("first").alias("v")))
        sets = fps.groupBy("sig").agg(F.first("n").alias("n"), F.first("n_first").alias("n_first"))
        edges = edges.unionByName(shingles.links(docs.select(F.col(text).cast("string").alias("text")), sets))
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    comps = components(edges)
    comps = bounded(cut(comps.unionByName(comps.select(F.col("root").alias("id"), "root").distinct())), CLASSED)
    # Copies are summed up by node first; only nodes that link with others have more to look up.
    lows = cut(fps.groupBy(node).agg(F.min("doc_id").alias("low")).join(comps, F.col(node) == F.col("id"), "left").select(node, "low", "root"))
    of_class = cut(lows.where("root is not null").groupBy("root").agg(F.min("low").alias("least")))
    named = lows.join(bounded(of_class, CLASSED), "root", "left").select(F.col(node).alias("_node"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(named, F.col(node) == F.col("_node")).select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = group(read(spark, sf_dir, "documents"), similar=False)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
