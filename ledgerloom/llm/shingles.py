"""Pairs of texts whose sets of shingles have a Jaccard similarity of SHARE or more: an exact join.

The tokens of a text are the XXH64 values of its shingles of WORDS words. They are put in
one order for all texts, the rarest first. Two texts of n and m tokens at a similarity of
SHARE or more have a token in common among the first n - ceil(SHARE n) + 1 of the one
and as many of the other (prefix filter), so only texts that meet at such a token are
compared, and a text of which less than SHARE of the tokens occur elsewhere meets none.
So the tokens of one part of the hash range, 1 of PARTS, are counted first: a text with
more tokens there that no other has than it may lack at all is out, and the rest are
counted among the texts that remain. Partners remain together, and a token's part and count
are the same for all texts, so the order holds.
Texts that meet are compared by their whole sets. No cap, sample or sketch is used.

Texts that meet at tokens with the same smallest text are one group. Groups of more than
BLOCK texts are dealt into blocks and each pair of blocks is compared on its own, with at
most BLOCKS blocks; only a spanning forest of the pairs found is emitted.

Defined results: texts of fewer than WORDS words have one shingle; empty texts have none
and are one set; words are those of `simhash.fingerprint` (A-Z in lower case, ASCII blanks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, small_batches

WORDS, SHARE, SEED = 5, (4, 5), 42
BLOCK, BLOCKS, PARTS = 64, 32, 4
#: Signatures (8 bytes each and an entry in a hash table) that may be broadcast.
KNOWN = 1_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII blanks


def grams(w: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """XXH64 of every shingle in order (of all words if they are fewer), and their number."""
    if not w:
        return np.zeros(0, np.dtype("<u8")), 0
    n = max(1, len(w) - size + 1)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), SEED) for i in range(n)), np.dtype("<u8"), n), n


def tokens(text: str | None) -> np.ndarray:
    return np.unique(grams(words(text), WORDS)[0])


def signature(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), SEED)


def in_first(tokens: np.ndarray) -> np.ndarray:
    """Which of the tokens are of the part that is counted first."""
    return tokens % PARTS == 0


def _spread(texts: DataFrame, first: bool) -> DataFrame:
    """(sig, hs) for every text: its tokens of the first part or of the others. Copies within a task are left out."""

    def work(batches):
        seen: set[int] = set()
        for b in batches:
            new = {}
            for t in b.column(0).to_pylist():
                own = tokens(t)
                if (k := signature(own)) not in seen:
                    seen.add(k)
                    new[k] = own
            sig = np.array(list(new), np.uint64).view(np.int64)
            sets = [s[in_first(s) == first] for s in new.values()]
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.ListArray.from_arrays(at, flat)], names=["sig", "hs"])

    return texts.mapInArrow(work, "sig bigint, hs array<bigint>")


def _shared(spread: DataFrame) -> DataFrame:
    """(h, sig, df) of the tokens that two texts or more have. Copies become one row where all rows of a token meet."""
    rows = spread.select(F.explode("hs").alias("h"), "sig").repartition("h").groupBy("h", "sig").agg(F.count("*").alias("c"))
    return cut(rows.select("h", "sig", F.count("*").over(Window.partitionBy("h")).alias("df")).where("df > 1"))


def _forest(n: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that are similar and of different sides, enough to connect all such pairs; with one side, all count."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    crossed = side.min() != side.max()
    num, den = SHARE
    pi, pj, todo = [], [], np.arange(len(n))
    mark = np.zeros(flat.max() + 1, np.int64)
    while len(todo):  # outward from each member not yet reached
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            x = front.pop()
            own = flat[start[x] : start[x + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], start[:-1])[todo]
            mark[own] = 0
            near = (num + den) * common >= num * (n[x] + n[todo])
            if crossed:
                near &= side[todo] != side[x]
            got, todo = todo[near], todo[~near]
            pi.append(np.full(len(got), x))
            pj.append(got)
            front.extend(got.tolist())
    return np.concatenate([*pi, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*pj, np.zeros(0, np.int64)]).astype(np.int64)


def _compared(groups: DataFrame) -> DataFrame:
    """groups: rows of key, side, sig, n and hs, the rows of a key (an array) together."""

    def edges(rows):
        n, side = (np.array([r[k] for r in rows], np.int64) for k in (2, 1))
        i, j = _forest(n, side, [r[4] for r in rows])
        return [(max(a, b), min(a, b)) for a, b in zip((rows[x][3] for x in i), (rows[x][3] for x in j))]

    def batch(out):
        out = np.array(sorted(set(out)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    def work(batches):
        held, out = [], []
        for b in batches:
            hs, at = b.column(4).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(4).value_lengths().to_numpy())])
            for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3)))):
                if held and held[0][0] != row[0]:
                    out += edges(held)
                    held = []
                held.append((*row, hs[at[k] : at[k + 1]]))
            if len(out) > 1 << 16:
                yield batch(out)
                out = []
        if held:
            out += edges(held)
        yield batch(out)

    return groups.mapInArrow(work, "u bigint, v bigint").distinct()


def links(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, v), u > v: signatures of similar texts, enough of them to connect all that are.

    texts: one column of text; sizes: sig (distinct), n and n_first, the number of its tokens and of those in the first part."""
    small_batches(texts.sparkSession)
    num, den = SHARE
    need = F.floor((F.col("n") * num + den - 1) / den)
    one = _shared(_spread(texts, True))
    left = sizes.join(one.groupBy("sig").agg(F.count("*").alias("k")), "sig", "left")
    left = cut(left.where(F.col("n_first") - F.coalesce("k", F.lit(0)) <= F.col("n") - need).select("sig", "n"))
    two = _shared(_spread(texts, False).join(bounded(left.select("sig"), KNOWN), "sig", "left_semi"))
    shared = one.unionByName(two)
    held = shared.groupBy("sig").agg(F.count("*").alias("k")).join(left, "sig").where(F.col("k") >= need)
    held = cut(held.select("sig", "n", (F.col("k") - need + 1).alias("p")))
    mine = cut(shared.join(held, "sig"))
    first = mine.withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("df", "h"))).where("r <= p").select("h", "sig")
    by_token = Window.partitionBy("h")
    met = first.select("sig", F.min("sig").over(by_token).alias("g"), F.count("*").over(by_token).alias("m")).where("m > 1")
    met = met.select("g", "sig").distinct()
    blocks = F.least(F.ceil(F.col("m") / BLOCK), F.lit(BLOCKS)).cast("int")
    met = met.withColumn("m", F.count("*").over(Window.partitionBy("g"))).select("g", "sig", blocks.alias("b"))
    met = met.select("g", "sig", "b", F.pmod(F.xxhash64("sig", "g"), F.col("b")).cast("int").alias("side"))
    met = met.select("g", "sig", "side", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    key = F.array("g", F.least("side", "other").cast("long"), F.greatest("side", "other").cast("long"))
    met = met.select(key.alias("key"), "side", "sig")
    sets = mine.groupBy("sig").agg(F.first("n").alias("n"), F.collect_list("h").alias("hs"))
    met = met.join(sets, "sig").select("key", "side", "n", "sig", "hs")
    return _compared(met.repartition("key").sortWithinPartitions("key"))
