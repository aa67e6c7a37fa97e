"""Quality classifier: histogram gradient-boosted trees over document statistics.

`features` turns a whole text into FEATURES numbers. `fit` trains on the driver
from a bounded sample of labelled rows: at most SAMPLE of them (documented bound),
those with the smallest hash of their id, so that the sample doesn't depend on
partitioning. The trees are complete binary trees, flattened to three arrays
(feature, cut, leaf value) that numpy walks for a whole batch at once.

Defined results: null and empty texts have the statistics of an empty text and get
the score that these have; rows repeat as they come; a label that is null, or an id
that is null, takes no part in training; with no label, or one class only, every
score is the share of label 1 (0.5 without labels); extra columns don't matter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, free, read, small_batches

#: Labelled rows to train on at most, and the trees' parameters.
SAMPLE, TREES, DEPTH, BINS, RATE, L2 = 20_000, 60, 4, 64, 0.2, 1.0
#: Score from which a document counts as good.
CUT = 0.7
FEATURES = 24

# Classes of UTF-8 bytes: letters, capitals, digits, blanks, line ends, marks, bytes of other letters.
_CLASS = np.full(256, 5, np.int64)
_CLASS[128:] = 6
for _a, _b, _k in ((97, 123, 0), (65, 91, 1), (48, 58, 2), (9, 14, 3), (32, 33, 3), (10, 11, 4)):
    _CLASS[_a:_b] = _k


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    c = np.bincount(_CLASS, by, 7)
    letters = max(1.0, c[0] + c[1] + c[6])
    words = raw.split()
    nw = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nl = max(1, len(lines))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    marks = by[[33, 35, 36, 37, 38, 42, 124, 60, 62, 123, 125, 64]]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), c[1] / letters, c[2] / n, c[3] / n, c[5] / n, c[6] / n,
        lens.mean(), lens.std(), float(lens.max()), kinds / nw, pairs / max(1, len(words) - 1), len(set(lines)) / nl, len(raw) / nl, nw / nl,
        marks[0] / nw, marks[1:6].sum() / nw, marks[6] / nw, marks[7:11].sum() / nw, (by[46] + by[44]) / nw, float((lens == 1).sum()) / nw,
        len(zlib.compress(raw, 1)) / n, by[34] / nw,
    ]


@dataclass
class Trees:
    """feature, cut: per tree the inner nodes, level by level; leaf: per tree the values of the 2**DEPTH leaves."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(f):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting by the logistic loss with second-order gains over BINS quantile bins."""
    share = float(y.mean()) if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share == 1 else -40.0), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or not 0 < share < 1:
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    total, out = np.full(len(y), none.start), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            where = np.zeros((many, 2), np.int64) - 1
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * (BINS + 1) + binned[:, j]
                gs = np.bincount(key, g, many * (BINS + 1)).reshape(many, -1).cumsum(1)
                hs = np.bincount(key, h, many * (BINS + 1)).reshape(many, -1).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
                gain = gain[:, : len(c)]
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best
                best = np.where(better, gain[np.arange(many), k], best)
                where[better] = np.stack([np.full(many, j), k], 1)[better]
            for i, (j, k) in enumerate(where):
                if j >= 0:
                    feature[first + i], cut[first + i] = j, cuts[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        gl, hl = np.bincount(node - inner, g, leaves), np.bincount(node - inner, h, leaves)
        leaf = -RATE * gl / (hl + L2)
        total += leaf[node - inner]
        for o, v in zip(out, (feature, cut, leaf)):
            o.append(v)
    return Trees(none.start, *map(np.array, out))


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col("text").cast("string").alias("text"))
    at = len(keep)

    def work(batches):
        for b in batches:
            rows = [features(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(work, f"{fields}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: tuple[int, int] | None = (4, 2)) -> Trees:
    """Train on labelled documents outside the held-out fold: (modulus, remainder) of crc32(id).

    At most `sample` labels are used, by the hash of the id; an id with several
    labels counts with the smallest."""
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if held_out:
        lab = lab.where(fold(F.col("doc_id"), held_out[0]) != held_out[1])
    # xxhash64 order with a limit: TakeOrdered keeps `sample` rows a task and on the driver, no more.
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is bounded by its parameter (16 bytes a row), so that it can be broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
    got = _featured(picked, ["doc_id", "y"]).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), FEATURES)
    return train(x, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, model: Trees, keep: list[str] | None = None, name: str = "_score") -> DataFrame:
    """keep (all columns by default) and `name`, the model's probability of label 1."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(free(docs, "_text")))
    at = len(keep)

    def work(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(model.score(x), pa.float64())], names=[*keep, name])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(work, f"{fields}, `{name}` double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= CUT).cast("int").alias("predicted"),
    )
