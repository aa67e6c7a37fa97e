"""Entity resolution: tiers of evidence, and a gap rather than a guess.

Every matcher gives (left_id, right_id or null, tier, n_candidates). Candidates are made
within blocks by equality joins; an ambiguous tier leaves a gap. Sides that grow with the
squads are merged by hint: from the size of compressed files the planner would broadcast them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shares_word
from ..streaming.run import shared


def tiered(left: DataFrame, right: DataFrame, block: list[str], tiers: list[Column], left_id: str, right_id: str) -> DataFrame:
    """The first tier with candidates decides; several candidates in it leave a gap."""
    r = right.select(*block, *[F.col(c) for c in right.columns if c not in block])
    tier = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers, 1))):
        tier = F.when(F.coalesce(t, F.lit(False)), F.lit(i)).otherwise(tier)
    cand = left.join(r, block).withColumn("tier", tier).where("tier is not null")
    # Combined before it moves: per left row the best tier, how many it has, and its only member.
    by = cand.groupBy(left_id, "tier").agg(F.countDistinct(right_id).alias("n_candidates"), F.min(right_id).alias("r"))
    best = by.groupBy(left_id).agg(F.min(F.struct("tier", "n_candidates", "r")).alias("m"))
    picked = best.select(F.col(left_id).alias("_l"), F.when(F.col("m.n_candidates") == 1, F.col("m.r")).alias(right_id), F.col("m.tier").alias("tier"), F.col("m.n_candidates").alias("n_candidates"))
    out = left.select(left_id).distinct().join(picked, F.col(left_id) == F.col("_l"), "left")
    return out.select(left_id, right_id, "tier", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def single_owner(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that exactly one owner holds."""
    g = df.groupBy(key).agg(F.countDistinct(owner).alias("_n"), F.min(owner).alias(owner))
    return g.where("_n = 1").drop("_n")


def containing(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, block: tuple[str, ...] = ()) -> DataFrame:
    """left_id, right_id: pairs whose token sets contain one another, each once; empty sets have none.

    The inner set meets the outer one at its rarest token, so frequent tokens make no candidates but
    for sets that hold nothing else. The ids may be structs, which carries further columns along."""
    keys = [*block, "_t"]
    l, r = left.select(*block, left_id, F.col(tokens).alias("_l")), right.select(*block, right_id, F.col(tokens).alias("_r"))
    every_l, every_r = l.withColumn("_t", F.explode("_l")), r.withColumn("_t", F.explode("_r"))
    seen = every_l.select(*keys).unionByName(every_r.select(*keys)).groupBy(*keys).agg(F.count("*").alias("_n"))

    def rarest(every: DataFrame, name: str, words: str) -> DataFrame:
        g = every.join(seen.hint("merge"), keys).groupBy(*block, name, words).agg(F.min(F.struct("_n", "_t")).alias("_m"))
        return g.select(*block, name, words, F.col("_m._t").alias("_t"))

    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    up = rarest(every_l, left_id, "_l").join(every_r.hint("merge"), keys).where(inside("_l", "_r"))
    down = every_l.join(rarest(every_r, right_id, "_r").hint("merge"), keys).where(inside("_r", "_l"))
    return up.select(left_id, right_id).union(down.select(left_id, right_id)).distinct()


def unique_subset(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str) -> DataFrame:
    """Left rows with partners by containment; the partner where it is the only one."""
    g = containing(left, right, left_id, right_id, tokens).groupBy(left_id).agg(F.count("*").cast("int").alias("n_candidates"), F.min(right_id).alias("_r"))
    return g.select(left_id, F.when(F.col("n_candidates") == 1, F.col("_r")).alias(right_id), "n_candidates")


def token_link(names: DataFrame, teams: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, how: an equal token set (the first name, then the smallest id), else the only
    partner by containment over all names. names: left_id, pos, words; teams: right_id, words; words sorted."""
    exact = names.where(F.size("words") > 0).join(teams.hint("merge"), "words").groupBy(left_id).agg(F.min(F.struct("pos", right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias("_e"))
    near = containing(names, teams, left_id, right_id, "words").groupBy(left_id).agg(F.count("*").alias("_n"), F.min(right_id).alias("_s"))
    j = near.where("_n = 1").join(exact.hint("merge"), left_id, "full")
    return j.select(left_id, F.coalesce("_e", "_s").alias(right_id), F.when(F.col("_e").isNotNull(), "exact").otherwise("subset").alias("how"))


def squad_link(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id or null, how: the only partner by containment of words; of several the only one
    of the same age; else the last row with the shirt, unless the ages are known and over a year apart.
    Both sides: block, id, words, age, shirt; an age of 0 breaks no tie."""
    l = left.select(block, F.struct(left_id, F.nullif("age", F.lit(0)).alias("_a")).alias("_p"), "words")
    r = right.select(block, F.struct(right_id, F.col("age").alias("_b")).alias("_q"), "words")
    hits = containing(l, r, "_p", "_q", "words", (block,)).select("_p.*", "_q.*")
    same = F.when(F.col("_a") == F.col("_b"), F.col(right_id))
    g = hits.groupBy(left_id).agg(F.count("*").alias("_n"), F.min(right_id).alias("_r"), F.count(same).alias("_m"), F.min(same).alias("_s"))
    last = right.where("shirt is not null").groupBy(block, "shirt").agg(F.max(F.struct(right_id, "age")).alias("_w"))
    j = left.join(g.hint("merge"), left_id, "left").join(last.hint("merge"), [block, "shirt"], "left")
    near = F.col("_w").isNotNull() & F.coalesce(F.abs(F.col("age") - F.col("_w.age")) <= 1, F.lit(True))
    how = F.when(F.col("_n") == 1, "name").when((F.col("_n") > 1) & (F.col("_m") == 1), "age").when(near, "shirt")
    return j.select(left_id, F.when(how == "name", F.col("_r")).when(how == "age", F.col("_s")).when(how == "shirt", F.col(f"_w.{right_id}")).alias(right_id), how.alias("how"))


def official_link(people: DataFrame, rows: DataFrame, known: DataFrame, block: list[str]) -> DataFrame:
    """block, ext, id or null, how, learned: by shirt, refused where the name points at another row of the
    block only; else by the known id; else the only row that shares a word of the name.
    people: block, ext, shirt, words; rows: block, shirt, id, words; known: ext, id. A block is one team in one match."""
    r = rows.select(*block, F.col("shirt").alias("_s"), F.col("id").alias("_i"), F.col("words").alias("_w"))
    j = people.join(r, block, "left").withColumn("_o", F.coalesce(shares_word(F.col("words"), F.col("_w")), F.lit(False)))
    like = F.when(F.col("_o"), F.col("_i"))
    g = j.groupBy(*block, "ext").agg(F.max(F.when(F.col("shirt") == F.col("_s"), F.struct("_i", "_o"))).alias("h"), F.count(like).alias("n"), F.min(like).alias("one"))
    x = g.join(known.select("ext", F.col("id").alias("_k")), "ext", "left")
    how = F.when(F.col("h").isNotNull() & (F.col("h._o") | (F.col("n") == 0)), "shirt").when(F.col("_k").isNotNull(), "known").when(F.col("n") == 1, "name")
    hit = F.when(how == "shirt", F.col("h._i")).when(how == "known", F.col("_k")).when(how == "name", F.col("one"))
    return x.select(*block, "ext", hit.alias("id"), how.alias("how"), F.coalesce(how.isin("shirt", "name"), F.lit(False)).alias("learned"))


def discover(ours: DataFrame, listed: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, score of the best listed match under equal keys (days exploded by the caller): each side 2 for
    equal words, 1 for a shared one; an orientation counts as its weaker side; from 1 on; ties: the smallest id.
    ours: words `home`, `away`; listed: words `a`, `b`."""
    side = lambda x, y: F.when(F.col(x) == F.col(y), 2).when(F.arrays_overlap(x, y), 1).otherwise(0)
    score = F.greatest(F.least(side("a", "home"), side("b", "away")), F.least(side("a", "away"), side("b", "home")))
    j = ours.join(listed, keys).select(left_id, right_id, score.alias("score")).where("score >= 1")
    return j.groupBy(left_id).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(right_id))).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), (-F.col("m.s")).alias("score"))


def _by_block(df: DataFrame, block: str, name: str) -> DataFrame:
    """One row for each block: its rows as an array. Blocks are small by nature (the fixtures of a
    round, the players of a team), and a plain loop over an array costs far less than a frame for each."""
    return df.groupBy(block).agg(F.collect_list(F.struct(*[c for c in df.columns if c != block])).alias(name))


def _mutual_rounds(s: DataFrame, block: str, left: str, right: str, score: str) -> DataFrame:
    """The same pairs without a task that holds a block: a pair that is the best of both its sides is
    taken, then what is left of the rest goes into the next round, by a written table."""
    spark, out, n = s.sparkSession, shared(s.sparkSession, "greedy"), 0
    best = lambda df, mine, other: df.groupBy(block, mine).agg(F.min(F.struct((-F.col(score)).alias("k"), F.col(other))).alias("m"))
    while True:
        s.write.parquet(f"{out}/left/{n}")
        s = spark.read.parquet(f"{out}/left/{n}")
        if s.isEmpty():
            return spark.read.schema(s.schema).parquet(*[f"{out}/taken/{i}" for i in range(n)]) if n else s
        a = best(s, left, right).select(block, left, F.col(f"m.{right}").alias(right), (-F.col("m.k")).alias(score))
        b = best(s, right, left).select(block, F.col(f"m.{left}").alias(left), right)
        a.join(b, [block, left, right]).select(block, left, right, score).write.parquet(f"{out}/taken/{n}")
        taken = spark.read.parquet(f"{out}/taken/{n}")
        s, n = s.join(taken.select(block, left), [block, left], "left_anti").join(taken.select(block, right), [block, right], "left_anti"), n + 1


def greedy_pairs(scored: DataFrame, block: str, left: str, right: str, score: str, small: int = 20_000) -> DataFrame:
    """One-to-one within each block, by descending score (ties: left, then right); pairs without a score don't count.

    Blocks of up to `small` candidates (counted) are a row each; larger ones take rounds of mutual best pairs."""
    s = scored.select(block, left, right, score).where(F.col(block).isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull())
    large = s.groupBy(block).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(block)
    if not large.isEmpty():
        few = _in_arrays(s.join(large, block, "left_anti"), block, left, right, score)
        return few.unionByName(_mutual_rounds(s.join(large, block, "left_semi"), block, left, right, score))
    return _in_arrays(s, block, left, right, score)


def _in_arrays(s: DataFrame, block: str, left: str, right: str, score: str) -> DataFrame:

    def work(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for key, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ls, rs = set(), set()
                for r in sorted(rows, key=lambda r: (-r[score], r[left], r[right])):
                    if r[left] not in ls and r[right] not in rs:
                        ls.add(r[left])
                        rs.add(r[right])
                        for col, x in zip(out, (key, r[left], r[right], r[score])):
                            col.append(x)
            item = b.schema.field(1).type.value_type
            types = [b.schema.field(0).type, *(item.field(c).type for c in (left, right, score))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[block, left, right, score])

    return _by_block(s, block, "rows").mapInArrow(work, s.schema)


def _linked(ratings: list[dict], roster: list[dict]) -> list[tuple]:
    """(pos, id, tier, candidates) for each rating, in order; see link_in_order."""
    twice = lambda xs: {x for x, n in Counter(x for x in xs if x is not None).items() if n > 1}
    bad_names = twice(r["name"] for r in ratings) | twice(r["name"] for r in roster)
    bad_ids = twice(r["ext_id"] for r in ratings) | twice(r["ext_id"] for r in roster)
    by_ext = {r["ext_id"]: r["id"] for r in roster if r["ext_id"] is not None and r["ext_id"] not in bad_ids}
    by_name = {r["name"]: r["id"] for r in roster if r["name"]}
    free = {r["id"] for r in roster}
    split = {r["id"]: (r["words"] or "").split() for r in roster}
    out = []
    for x in sorted(ratings, key=lambda r: r["pos"]):
        hit, tier, n = None, None, 0
        named = x["name"] and x["name"] not in bad_names
        if x["ext_id"] not in bad_ids and by_ext.get(x["ext_id"]) in free:
            hit, tier, n = by_ext[x["ext_id"]], 1, 1
        elif x["alias_id"] in free:
            hit, tier, n = x["alias_id"], 2, 1
        elif named and by_name.get(x["name"]) in free:
            hit, tier, n = by_name[x["name"]], 3, 1
        elif named:
            mine = (x["words"] or "").split()
            like = lambda r: r["name"] in x["name"] or x["name"] in r["name"] or (mine and (mine[-1:] == split[r["id"]][-1:] or set(mine) == set(split[r["id"]])))
            found = [r["id"] for r in roster if r["id"] in free and r["name"] and r["name"] not in bad_names and like(r)]
            tier, n = (4, len(found)) if found else (None, 0)
            hit = found[0] if n == 1 else None
        free.discard(hit)
        out.append((x["pos"], hit, tier, n))
    return out


def link_in_order(ratings: DataFrame, roster: DataFrame, block: str) -> DataFrame:
    """Ratings to roster rows of the same block, each row used once, in rating order.

    ratings: block, pos, name, ext_id, alias_id; roster: block, id, name, ext_id; names are
    normalised. Tiers: (1) external id that one row holds, (2) learned alias, (3) equal name,
    (4) the only candidate by containment, last word or word set (words stand in `words`).
    Names that occur twice on a side are never linked by name, external ids that occur twice
    among the ratings are not trusted."""
    both = _by_block(ratings, block, "ratings").join(_by_block(roster, block, "roster"), block, "left").select(block, "ratings", "roster")

    def work(batches):
        for b in batches:
            keys, rows = [], []
            for key, x, r in zip(*(c.to_pylist() for c in b.columns)):
                got = _linked(x, r or [])
                keys += [key] * len(got)
                rows += got
            cols = list(zip(*rows)) or [()] * 4
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, types))], names=[block, "pos", "id", "tier", "n_candidates"])

    kind = ratings.schema[block].dataType.simpleString()
    return both.mapInArrow(work, f"{block} {kind}, pos int, id long, tier int, n_candidates int")


def first_in_window(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, days: int, value: str) -> DataFrame:
    """For each left row the first right row within `days` days after it. An equality join on
    day blocks: a window looks into the blocks that it touches, no more, and equal windows once."""
    block = lambda c: F.floor(F.unix_timestamp(c) / (86400 * days)).cast("long")
    l = left.select(left_time).distinct().withColumn("_b", F.explode(F.array(block(F.col(left_time)), block(F.col(left_time)) + 1)))
    r = right.select(F.col(right_time).alias("_t"), F.col(value).alias("_v"), block(F.col(right_time)).alias("_b"))
    j = l.join(r, "_b").where((F.col("_t") >= F.col(left_time)) & (F.col("_t") <= F.col(left_time) + F.make_interval(days=F.lit(days))))
    found = j.groupBy(left_time).agg(F.min(F.struct("_t", "_v")).alias("m"), F.count("*").alias("n"))
    return left.select(key, left_time).join(found, left_time).select(key, F.col("m._v").alias(value), "n")


def dedupe(df: DataFrame, key: list[str], order: list[str], first: bool) -> DataFrame:
    """The first or last row of each key: one aggregate with partial combination, no window."""
    pick = F.min if first else F.max
    rest = [c for c in df.columns if c not in key and c not in order]
    g = df.groupBy(*key).agg(pick(F.struct(*order, *rest)).alias("m"))
    return g.select(*key, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
