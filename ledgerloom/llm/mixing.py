"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Sources have integer weights; a source of weight w out of a total of q holds the share
w/q of the slots. Its k-th block (from 1) is released at slot floor((k-1)q/w) and due by
slot ceil(kq/w); in each slot the released block that is due first is taken (ties: the
source first in order). With one block a slot and full use this meets every deadline, so
at any time each source has had less than one block more or less than its share. The
schedule repeats every q slots, so one period of q slots is made from the weights alone
(q is bounded by PERIOD) and every block's slot follows from its number.

Blocks hold BLOCK rows. Rows are numbered within their source in the order of a hash of
the id, in two levels so that no task holds a whole source: within (source, range of the
hash), and by the sums over the ranges before. Sources without a weight form one class,
`OTHER`, with its own weight (1 unless given); a null source counts as one of them. A
source without rows has no share.

All rows are kept: when a source has run out, its slots are left out and the others go on
in turn; up to the first such slot (`in_target`) the shares hold to less than a block.

Defined results: null ids and texts are rows like others; equal rows follow one another
in any order; an empty table gives an empty result; the columns source, text and doc_id
are read, all pass through `mix`, texts of any length too; where the caller has a column named
like one that it adds, the added one gets a low line behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, literal_rows, read

OTHER = "(other)"
PERIOD, BLOCK = 10_000, 8
#: Rows of a source's hash range, about; the ranges grow in number with the input.
RANGE_ROWS, LEAST_RANGES = 20_000, 256
#: Sizes of ranges (about 40 bytes each) that may be broadcast.
STARTS = 200_000
#: Production weights: the large source is held to a fifth, the others share the rest.
WEIGHTS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, OTHER: 4}


def schedule(weights: dict[str, int]) -> list[dict]:
    """One period: slot, source, k (its block's number in the period, from 0), and before,
    the blocks that each source (in order) has had before the slot."""
    names = sorted(weights)
    q = sum(weights.values())
    if not names or min(weights.values()) < 1 or q > PERIOD:
        raise ValueError(f"weights must be whole numbers from 1 and sum to {PERIOD} at most")
    had, out = dict.fromkeys(names, 0), []
    for slot in range(q):
        free = [s for s in names if had[s] * q // weights[s] <= slot and had[s] < weights[s]]
        s = min(free, key=lambda s: (-(-(had[s] + 1) * q // weights[s]), names.index(s)))
        out.append({"slot": slot, "source": s, "k": had[s], "before": [had[x] for x in names]})
        had[s] += 1
    return out


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """docs with block (number in its source), slot, in_target and position (from 0, over all rows).

    Rows of a block stay together: position counts the rows of the blocks in earlier slots."""
    spark = docs.sparkSession
    given, p = docs, "_mix_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    weights = {OTHER: 1} | weights
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(""))).cast("binary"))
    cls = F.when(F.col("source").isin(*[x for x in weights if x != OTHER]), F.col("source")).otherwise(OTHER)
    total = {r["s"]: r["n"] for r in docs.groupBy(cls.alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each weight
    ranges = max(LEAST_RANGES, sum(total.values()) // RANGE_ROWS)
    part = F.floor(F.conv(F.substring(f"{p}key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")
    rows = docs.withColumn(f"{p}key", key).withColumn(f"{p}source", cls).withColumn(f"{p}part", part)
    # Sizes of the ranges: at most (number of weights) x ranges rows, summed before they move.
    sizes = rows.groupBy(f"{p}source", f"{p}part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(f"{p}source").orderBy(f"{p}part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(f"{p}source", f"{p}part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{p}first"))
    weights = {s: w for s, w in weights.items() if total.get(s)} or weights  # a source without rows has no share
    names, q = sorted(weights), sum(weights.values())
    blocks = [-(-total.get(s, 0) // block) for s in names]
    sched = schedule(weights)
    table = literal_rows(spark, sched, "slot long, source string, k long, before array<long>")
    table = table.select(F.col("slot").alias(f"{p}slot"), F.col("source").alias(f"{p}s"), F.col("k").alias(f"{p}k"), F.col("before").alias(f"{p}before"))
    inside = Window.partitionBy(f"{p}source", f"{p}part").orderBy(f"{p}key", "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if _hashable(docs, c)]))
    # A row for each class and range at most: broadcast up to STARTS of them, else joined by a shuffle.
    starts = F.broadcast(starts) if (len(weights) + 1) * ranges <= STARTS else starts
    out = rows.withColumn(f"{p}n", F.row_number().over(inside)).join(starts, [f"{p}source", f"{p}part"])
    out = out.withColumn(f"{p}n", F.col(f"{p}n") - 1 + F.col(f"{p}first"))
    share = F.element_at(F.create_map(*[x for s in names for x in (F.lit(s), F.lit(weights[s]))]), F.col(f"{p}source"))
    out = out.withColumn(f"{p}block", F.floor(F.col(f"{p}n") / block).cast("long")).withColumn(f"{p}w", share.cast("long"))
    out = out.withColumn(f"{p}round", F.floor(F.col(f"{p}block") / F.col(f"{p}w")).cast("long"))
    # The table has q rows, PERIOD at most.
    out = out.join(F.broadcast(table), (F.col(f"{p}source") == F.col(f"{p}s")) & (F.col(f"{p}block") % F.col(f"{p}w") == F.col(f"{p}k")))
    # Rows in earlier slots: of each source, its blocks before this slot, the last of which may be short.
    had = [F.least(F.lit(total.get(s, 0)).cast("long"), F.lit(block) * (F.col(f"{p}round") * weights[s] + F.get(f"{p}before", F.lit(i)))) for i, s in enumerate(names)]
    ends = [q * (n // weights[s]) + next(x["slot"] for x in sched if x["source"] == s and x["k"] == n % weights[s]) for s, n in zip(names, blocks)]
    slot = F.col(f"{p}round") * q + F.col(f"{p}slot")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(f"{p}source").alias(free(given, "mix_class")),
        F.col(f"{p}block").alias(free(given, "block")),
        slot.alias(free(given, "slot")),
        (slot < F.lit(min(ends))).alias(free(given, "in_target")),
        (sum(had[1:], had[0]) + F.col(f"{p}n") % block).cast("long").alias(free(given, "position")),
    )


def _hashable(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString() and "variant" not in df.schema[column].dataType.simpleString()


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    # The order needs no text but where an id is missing.
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"))
    return mix(docs).select("doc_id", "source", "mix_class", "block", "slot", "in_target", "position")
