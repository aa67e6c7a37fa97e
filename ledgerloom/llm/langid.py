"""Language identification by rank-order profiles.

A text is lower-cased, everything but letters becomes one blank, and its n-grams of
one to three characters (words padded by a blank, none across words) are ranked by
frequency. A language's profile are the TOP n-grams of all its learning texts; a
text's distance from it is the sum, over the text's own TOP n-grams, of how far each
is out of place, TOP for one that the profile lacks. The least distance wins (ties: the
language first in order), and the score is 1 - distance / greatest possible distance.

Learning counts are exact over all learning texts: partial counts leave each task,
are summed by (language, n-gram), and each language's TOP are picked within SALTS
parts first, so that no task sees all n-grams of a language. The driver gets at most
TOP x SALTS rows a language.

Defined results: a null text, or one without letters, is `und` with score 0; with
nothing to learn from, everything is `und`; null languages are not learned from; rows
repeat as they come; texts are counted whole; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, read, small_batches

TOP, SALTS = 400, 16
#: Distinct n-grams that a task holds before it hands on its partial counts.
HELD = 1 << 20
UND = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, ascending; counts)."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ok = _letters()[cp]
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[32], np.where(ok, cp, 32), [32]])
    keep = s != 32
    keep[1:] |= s[:-1] != 32  # one blank after each word
    keep[0] = True
    s = s[keep]
    three = s[:-2] | s[1:-1] << 21 | s[2:] << 42
    all_ = np.concatenate([s[s != 32], s[:-1] | s[1:] << 21, three[s[1:-1] != 32]])
    all_.sort()
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first], np.diff(np.concatenate([first, [len(all_)]]))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    def __init__(self, ranks: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(ranks), top
        self.codes = np.unique(np.concatenate([*ranks.values(), np.zeros(0, np.int64)]))
        self.place = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.codes, ranks[lang])] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UND, 0.0
        own = ranked(codes, counts, self.top)
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        place = self.place[:, np.where(known, at, len(self.codes))]
        far = np.where(place < 0, self.top, np.abs(place - np.arange(len(own)))).sum(1)
        i = int(far.argmin())
        return self.langs[i], float(1 - far[i] / (self.top * len(own)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> Profiles:
    small_batches(docs.sparkSession)

    def merged(parts):
        codes, n = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(codes, kind="stable")
        codes, n = codes[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(n, first)

    def rows(held):
        for name, parts in held.items():
            codes, n = merged(parts)
            for i in range(0, len(codes), 1 << 16):
                c = codes[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(c), pa.array(n[i : i + (1 << 16)])], names=["lang", "code", "n"])

    def work(batches):
        held: dict[str, list] = {}
        size = 0
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, n = grams(t)
                if len(codes):
                    held.setdefault(name, []).append((codes, n))
                    size += len(codes)
            if size > HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    counts = src.mapInArrow(work, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.xxhash64("code"), F.lit(SALTS))
    w = Window.partitionBy("lang", "_salt").orderBy(F.desc("n"), "code")
    kept = counts.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("lang", "code", "n")
    by: dict[str, list] = {}
    for r in kept.collect():  # TOP x SALTS rows a language at most
        by.setdefault(r["lang"], []).append((-r["n"], r["code"]))
    return Profiles({k: np.array([c for _, c in sorted(v)[:top]], np.int64) for k, v in by.items()}, top)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, lang_pred, score."""
    small_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            got = [profiles.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string")).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn(docs.where(fold(F.col("doc_id"), 3) != 1))
    out = identify(docs, profiles)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
