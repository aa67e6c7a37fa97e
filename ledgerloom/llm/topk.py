"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components are whole numbers, floor(SCALE * x). The vectors are dealt into shards by a
hash of a row number; in a shard, each dimension has posting segments, one for each of
LEVELS steps between its least and largest value, that list the vectors with a value in
that step. For a query the impact of a segment is the query's component times the middle
of the step, and its error half a step. Segments are processed by descending size of the
impact, adding impacts to accumulators. A vector that has c segments left can change by at
most c times the size of the next impact, and by the sum of errors. Processing stops only
when these bounds prove that at most a part FEW of the shard's vectors can reach the
threshold (or when all segments are done); these are then scored exactly.

The threshold is a score that k vectors are known to have: of the query, its k-th best
score among a bounded sample of SAMPLE vectors (found by the same index), and within a
shard the k-th best exact score of the vectors whose accumulators lead so far.

Each shard's index is built once: its vectors come first, then its queries in a stream, so
that memory holds one shard and a batch of queries. Each shard gives at most k rows a query.

Defined results: vectors that are null or hold a null, NaN or infinite component take no
part; an empty vector scores 0; missing components of a shorter vector count as zero; every
row whose id is divisible is a query of its own, and every other row a candidate, also one
with the same id; a row without id is a candidate with a null id, after all others of its
score; equal scores of equal ids are one rank each; a component or a returned score that no
long can hold is an error; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

K, SCALE, STEP = 10, 1024, 100
#: Vectors of a shard, about, and the fewest shards; vectors of the sample for the threshold, and queries that meet one copy of it.
SHARD, LEAST_SHARDS, SAMPLE, ASKED = 8192, 24, 8192, 64
#: Steps of a dimension, parts of the postings between two proofs, and the part of a shard that may be scored exactly.
LEVELS, PARTS, FEW = 64, 10, 0.09
_LONG = (1 << 63) - 1


class Index:
    """The posting segments of one shard. `seen` counts what searches did: postings, postings processed, rows scored exactly."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        self.f = vectors.astype(np.float64)
        n, dims = vectors.shape
        self.low = self.f.min(0) if n else np.zeros(dims)
        self.width = ((self.f.max(0) if n else self.low) - self.low) / LEVELS
        level = np.floor((self.f - self.low) / np.where(self.width > 0, self.width, 1)).clip(0, LEVELS - 1).astype(np.int64)
        posts, dim, lev, bounds = [np.zeros(0, np.int64)], [], [], [0]
        for d in range(dims):
            posts.append(np.argsort(level[:, d], kind="stable"))
            counts = np.bincount(level[:, d], minlength=LEVELS)
            values = np.flatnonzero(counts)
            dim += [d] * len(values)
            lev += values.tolist()
            bounds += (bounds[-1] + counts[values].cumsum()).tolist()
        self.posts = np.concatenate(posts)
        self.dim, self.bounds = np.array(dim, np.int64), np.array(bounds, np.int64)
        self.mid = self.low[self.dim] + (np.array(lev, np.float64) + 0.5) * self.width[self.dim]
        self.size = np.abs(self.f).max(0) if n else np.zeros(dims)
        self.seen = {"postings": 0, "processed": 0, "scored": 0, "vectors": 0}

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact: as longs where no sum can leave them, else as Python's whole numbers."""
        self.seen["scored"] += len(rows)
        most = float(np.abs(q.astype(np.float64)) @ self.size) if len(q) else 0.0
        if most < 2.0**52:
            return (self.f[rows] @ q.astype(np.float64)).astype(np.int64)
        if most < 2.0**62:
            return self.v[rows] @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(self.v[r], q)) for r in rows], object)

    def search(self, q: np.ndarray, k: int, floor: int | None = None, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of a set that holds the k best (ties included) of those of score floor or more; skip: a row that takes no part."""
        n, dims = self.v.shape
        self.seen["postings"] += len(self.posts)
        self.seen["vectors"] += n
        few = max(4 * k, int(n * FEW))
        alive = np.arange(n)
        if skip >= 0:
            alive = np.delete(alive, skip)
        if len(alive) <= few:
            return alive, self.scores(alive, q)
        at = q.astype(np.float64)
        impact = at[self.dim] * self.mid
        order = np.argsort(-np.abs(impact), kind="stable")
        sizes = np.abs(impact[order])
        counts = (self.bounds[1:] - self.bounds[:-1])[order]
        done = counts.cumsum()
        most = float((np.abs(at) * self.size).sum())
        # One sum for both accumulators: each posting adds its impact and ONE, more than all impacts together.
        one = 2.0 ** np.ceil(np.log2(max(most, 1.0)) + 3)
        # Half a step in every dimension, and what rounding can add.
        error = float((np.abs(at) * (self.width / 2)).sum()) * (1 + 1e-9) + dims * dims * one * 2.0**-52 + 1e-6
        both = np.zeros(n)
        least = -np.inf if floor is None else float(floor)
        cuts = np.searchsorted(done, np.linspace(0, done[-1], PARTS + 1)[1:]) + 1
        begin = 0
        for stop in np.minimum(cuts, len(order)):
            chunk = order[begin:stop]
            if len(chunk):
                each = counts[begin:stop]
                rows = self.posts[np.repeat(self.bounds[chunk] - (each.cumsum() - each), each) + np.arange(each.sum())]
                both += np.bincount(rows, np.repeat(impact[chunk] + one, each), n)
                self.seen["processed"] += len(rows)
                begin = stop
            if begin < len(order) // 5:
                continue  # too early for a proof
            met = np.rint(both[alive] / one)
            have = both[alive] - met * one
            if len(alive) > k:  # a score that k vectors have
                lead = alive[np.argpartition(-have, k - 1)[:k]]
                least = max(least, float(min(self.scores(lead, q))))
            rest = (dims - met) * (sizes[begin] if begin < len(order) else 0.0)
            alive = alive[have + rest + error >= least]
            if len(alive) <= few:
                break
        return alive, self.scores(alive, q)


def best(index: Index, q: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int, floor: int | None = None, skip: int = -1) -> list[tuple]:
    """(id or None, score) of the k best vectors, ties to the smaller id, no id last; scores under floor may lack."""
    rows, scores = index.search(q, k, floor, skip)
    if scores.dtype == object:
        top = np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], not known[rows[i]], ids[rows[i]]))[:k], np.int64)
    else:
        top = np.lexsort((ids[rows], ~known[rows], -scores))[:k]
    out = [(int(ids[r]) if known[r] else None, int(s)) for r, s in zip(rows[top], scores[top])]
    if any(abs(s) > _LONG for _, s in out):
        raise OverflowError("a score is larger than a long")
    return out


def prepare(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v, whole numbers, of the vectors that take part. A component beyond a long is an error."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    large = F.raise_error(F.lit("a component is larger than a long")).cast("long")
    whole = lambda c: F.when(odd(c), None).when(F.abs(c * scale) < 2.0**63, F.floor(c * scale)).otherwise(large)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(col, lambda c: c.cast("double")).alias("x"))
    # One expression, so that no row that takes no part reaches the check of its size.
    return src.select("id", F.when(~F.exists("x", odd), F.transform("x", whole)).alias("v")).where(F.col("v").isNotNull())


def search(vectors: DataFrame, step: int = STEP, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; vectors as `prepare` gives them, queries those whose id step divides."""
    # The row number names a row, whatever its id; the checkpoint holds it fast.
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v"))
    total = rows.count()
    shards = max(LEAST_SHARDS, -(-total // SHARD))
    deal = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    queries = rows.where(F.col("id") % step == 0)
    # The sample is bounded whatever the number of rows.
    chosen = rows if total <= SAMPLE else rows.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(-(-total // SAMPLE))) == 0)
    none = F.lit(None).cast("long")
    put = lambda df, shard, query, floor: df.select(shard.cast("int").alias("shard"), F.lit(query).alias("query"), "row", "id", "v", floor.alias("floor"))
    copies = max(1, -(-queries.count() // ASKED))
    spread = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    first = put(spread, F.col("part"), False, none).unionByName(put(queries, F.pmod(F.xxhash64("row"), F.lit(copies)), True, none))
    floors = _searched(first, k).groupBy("row").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    floors = floors.select("row", F.when(F.col("n") >= k, F.col("low")).alias("low"))
    asked = cut(queries.join(floors, "row", "left")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = put(rows, deal, False, none).unionByName(put(asked, F.col("shard"), True, F.col("low")))
    rank = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = _searched(both, k).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """row and query_id of the query, vec_id, score: the k best of each shard. rows: shard, query, row, id, v, floor."""

    def matrix(lists: pa.Array, dims: int) -> np.ndarray:
        n, flat = len(lists), np.asarray(lists.flatten(), dtype=np.int64)
        length = np.asarray(lists.value_lengths(), dtype=np.int64)
        if n and (length == dims).all():
            return flat.reshape(n, dims)
        out = np.zeros((n, max(dims, int(length.max()) if n else 0)), np.int64)
        r = np.repeat(np.arange(n), length)
        out[r, np.arange(len(flat)) - np.repeat(length.cumsum() - length, length)] = flat
        return out

    def work(batches):
        shard, held, index, row, ids, known = None, [], None, None, None, None

        def build():
            nonlocal held, index, row, ids, known
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            held = []
            lists = t["v"].combine_chunks() if t is not None else pa.array([], pa.list_(pa.int64()))
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            index = Index(matrix(lists, max([0, *lists.value_lengths().to_pylist()])))
            row = np.asarray(t["row"]) if t is not None else np.zeros(0, np.int64)
            known = np.asarray(t["id"].is_valid()) if t is not None else np.zeros(0, bool)
            ids = np.asarray(t["id"].fill_null(0)) if t is not None else np.zeros(0, np.int64)

        for b in batches:
            numbers, kinds = np.asarray(b.column(0)), np.asarray(b.column(1).to_pylist(), bool)
            edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])])) if b.num_rows else []
            out: list[tuple] = []
            for a, z in zip(edges, [*edges[1:], b.num_rows]):
                if numbers[a] != shard:
                    shard, held, index = numbers[a], [], None
                part = b.slice(a, z - a)
                if not kinds[a]:
                    held.append(part)
                    continue
                if index is None:
                    build()
                where = {r: i for i, r in enumerate(row.tolist())} if len(row) else {}
                for r, qid, v, floor in zip(*(part.column(c).to_pylist() for c in (2, 3, 4, 5))):
                    dims = index.v.shape[1]
                    q = np.array((v + [0] * dims)[:dims], np.int64)
                    out += [(r, qid, i, s) for i, s in best(index, q, ids, known, k, floor, where.get(r, -1))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "query")
    return dealt.mapInArrow(work, "row long, query_id long, vec_id long, score long")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return search(prepare(read(spark, sf_dir, "embeddings")))
