"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Tokens are runs of letters and digits, lower-cased. A mask fixes which positions of a
window are hashed; the others may hold anything, so a window with
substitutions at ignored positions still meets its counterpart. Every window of every
benchmark item and of every document is hashed under each mask, the hashes are
joined, and each diagonal (document position minus item position) that was hit is
verified over its whole overlap: token by token, a segment scores +1 for an equal and
-SLIP for a substituted token, and counts as an overlap if it holds MATCHED equal tokens
or more at a score of 0 or more (so that SLIP/(1+SLIP) = 0.8 of it or more are equal).
The best segment that counts is reported.

COVER misses no such segment, whatever its substitutions: with a run of four equal tokens it
meets the first mask. Without one, of n equal and k substituted tokens, 4k <= n <= 3(k+1) and
n >= 8 leave runs of 3-3-2, 2-3-3, 3-2-3, 3-3-3 and 3-3-3-3, which hold the second or the
third (tests: at each rate of substitution, all overlaps that the verification accepts are
found). What it accepts ends at a share of 0.8 equal and at MATCHED equal tokens: an overlap
with more substitutions, an insertion inside, or fewer equal tokens isn't one. MASKS are seeds
of SPAN tokens, those of the SQL, which finds fewer; COVER finds all that they do.

The windows of a document are generated, hashed and probed in one generated loop while the
benchmark's seeds are broadcast, which they are when their counted number is at most SEEDS.
Beyond it both sides are shuffled by hash and salt: a window moves as (row key, position,
hash), without its tokens, a frequent hash is dealt to SALTS tasks, and the tokens are
fetched by row key for the diagonals that were hit. A row's key is its id and a hash of its
text, so that rows that repeat an id, or have none, are each verified on their own text.

Defined results: null, empty and short texts (fewer than SPAN tokens) have no
overlap; rows repeat as they come and give one result per id; rows without id are
reported together under null; items without id take no part; extra columns don't matter;
with an empty table on either side there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

#: 1: the token is hashed, 0: it is ignored.
MASKS = ("11011011", "11101101", "10110111")
COVER = ("1111", "1110111", "1110110111")
SPAN = 8
#: An overlap holds at least so many equal tokens; a substitution costs so many of them.
MATCHED, SLIP = 8, 4
#: Seeds (24 bytes each and an entry in a hash table) that may be broadcast.
SEEDS = 1_000_000
#: Tasks that a hash is dealt to where seeds are shuffled.
SALTS = 16


def tokens(text: Column) -> Column:
    """The last one may be empty; the first is not, as marks before it are cut off."""
    return F.split(F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+")


def _seeds(words: str, at: Column) -> Column:
    hashed = [F.xxhash64(F.lit(m), *[F.get(F.col(words), at + k) for k, x in enumerate(mask) if x == "1"]) for m, mask in enumerate(COVER)]
    return F.array(*hashed)


def _windows(df: DataFrame, words: str, keep: list[str], at: str) -> DataFrame:
    """A row for each window and mask: keep, at, seed."""
    df = df.where(F.size(words) >= SPAN)
    df = df.select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - len(COVER[0]))).alias(at))
    return df.select(*keep, at, F.explode(_seeds(words, F.col(at))).alias("seed"))


def overlaps(docs: DataFrame, bench: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, item_id, n_equal, n_aligned, doc_start, item_start (in tokens) of the best
    verified overlap of each pair that has one."""
    items = bench.where("item_id is not null").select("item_id", F.filter(tokens(F.col(text)), lambda w: w != "").alias("b"))
    seeds = _windows(items, "b", ["item_id"], "bpos").select("seed", "item_id", "bpos").distinct()
    longest = items.agg(F.count("*").alias("n"), F.max(F.size("b")).alias("m")).first()
    small = longest["m"] is None or (seeds.count() <= SEEDS and longest["n"] <= SEEDS)
    d = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text)).alias("a"), F.xxhash64(F.col(text).cast("string")).alias("key"))
    # The document's tokens opposite the item's: from its first on, as many as the longest item has.
    start = F.col("pos") - F.col("bpos")
    opposite = F.slice("a", F.greatest(F.col("start"), F.lit(0)) + 1, F.lit(int(longest["m"] or 0))).alias("a")
    if small:
        hits = _windows(d, "a", ["doc_id", "a"], "pos").join(F.broadcast(seeds), "seed")
        hits = hits.select("doc_id", "item_id", start.alias("start"), "a").select("doc_id", "item_id", "start", opposite).distinct()
        hits = hits.join(F.broadcast(items), "item_id")
    else:
        hits = _shuffled(_windows(d, "a", ["doc_id", "key"], "pos"), seeds).select("doc_id", "key", "item_id", start.alias("start")).distinct()
        own = d.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "a")
        hits = hits.join(own, (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
        hits = hits.select("doc_id", "item_id", "start", opposite).distinct().join(items, "item_id")
    skip = F.greatest(-F.col("start"), F.lit(0))
    pairs = F.zip_with("a", F.slice("b", skip + 1, F.size("b")), lambda x, y: x == y)
    hits = hits.select("doc_id", "item_id", "start", skip.alias("skip"), F.filter(pairs, lambda x: x.isNotNull()).alias("eq"))
    return _best(hits).withColumnRenamed("doc_id", id_col)


def _shuffled(windows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Windows that meet seeds, joined by hash and salt: the benchmark's side, by far the smaller, is repeated for each salt."""
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
    spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["seed", "salt"])


def _best(hits: DataFrame) -> DataFrame:
    """The best segment that counts of each diagonal, then of each pair.

    at: the positions of the equal tokens. From the u-th to the t-th of them a segment scores v(t) - v(u) + 1,
    v(t) = (1 + SLIP) t - SLIP at[t]. A fold keeps the last smallest v(u) of u <= t - (MATCHED - 1)
    and (best score, first, last) of the segments so far, the earliest end of equal scores."""
    hits = hits.withColumn("at", F.filter(F.transform("eq", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())).where(F.size("at") >= MATCHED)
    v = lambda t: (1 + SLIP) * t - SLIP * F.get("at", t)
    kind = "struct<v:int,u:int,bs:int,bu:int,bt:int>"
    zero = F.struct(F.lit(2**30).alias("v"), *[F.lit(x).alias(k) for k, x in (("u", 0), ("bs", -1), ("bu", 0), ("bt", 0))]).cast(kind)

    def step(acc, t):
        u = t - (MATCHED - 1)
        low = v(u) <= acc["v"]
        least, first = F.when(low, v(u)).otherwise(acc["v"]), F.when(low, u).otherwise(acc["u"])
        s = v(t) - least + 1
        better = s > acc["bs"]
        pick = lambda a, b: F.when(better, a).otherwise(acc[b]).alias(b)
        return F.struct(least.alias("v"), first.alias("u"), pick(s, "bs"), pick(first, "bu"), pick(t, "bt")).cast(kind)

    out = hits.withColumn("r", F.aggregate(F.sequence(F.lit(MATCHED - 1), F.size("at") - 1), zero, step)).where(F.col("r.bs") >= 0)
    out = out.select("doc_id", "item_id", "start", "skip", F.col("r.bs").alias("s"), (F.col("r.bt") - F.col("r.bu") + 1).alias("n"), F.get("at", F.col("r.bu")).alias("f"), (F.get("at", F.col("r.bt")) + 1).alias("e"))
    best = F.struct("s", "n", (-(F.greatest("start", F.lit(0)) + F.col("f"))).alias("d"), (-(F.col("skip") + F.col("f"))).alias("b"), (F.col("e") - F.col("f")).alias("len"))
    out = out.groupBy("doc_id", "item_id").agg(F.max(best).alias("m"))
    return out.select(
        "doc_id",
        "item_id",
        F.col("m.n").cast("long").alias("n_equal"),
        F.col("m.len").cast("long").alias("n_aligned"),
        (-F.col("m.d")).cast("long").alias("doc_start"),
        (-F.col("m.b")).cast("long").alias("item_start"),
    )


def op4_decontam(spark, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
