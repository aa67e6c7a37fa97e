"""Edit-aware token counts: segment trees over pre-tokens.

A text is split into pre-tokens by the tokenizer's pattern; merges never cross them, so
a text's count is the sum over its pre-tokens. The state of a document is the list of
its leaves, runs of about LEAF pre-tokens with their characters and tokens; a segment tree
over the leaves holds the sums and each leaf its piece of the text, so that an edit copies
and splits only what lies around it. An edit (start, end, replacement; code points, held to
the text) finds the leaf where it starts by descending the sums, splits and encodes anew
from that leaf's start, until a split meets the end of an old leaf behind the edit: from
there on nothing can differ, as the pattern looks to the right only. The leaf is chosen so
that CONTEXT characters lie between its start and the edit, more than the pattern looks ahead.

The region is cut into leaves of LEAF pre-tokens again, a small one being joined with the
next. Leaves stand in slots with gaps between them: where new leaves need more slots than
the old ones had, the smallest subtree that is sparse enough is spread out evenly (or the
tree doubled), so leaves keep their size however many edits fall on one place.

Defined results: null and empty texts have no tokens; edits apply one after another,
each to the text that the one before left; null edits are none, a null start is 0, a null
end the start, a null replacement empty; rows repeat as they come; texts are counted whole;
an empty table gives no rows; of the other columns those in `keep` pass, but for names that
the result adds (`text`, `leaves`, `edits`, the counts): these can't be kept.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, read, small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, CONTEXT, CACHE = 32, 4, 1 << 18
_MADE: dict[int, "Counter"] = {}


class Counter:
    """Counts the tokens of pre-tokens, with a bounded memory of those seen."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        try:
            return [seen[p] for p in pieces]
        except KeyError:
            for p in pieces:
                if p not in seen:
                    seen[p] = len(self.encoding.encode_ordinary(p))
        return [seen[p] for p in pieces]

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(characters, tokens) of each leaf, and the number of pre-tokens."""
        pieces = self.pattern.findall(text)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        first = np.arange(0, len(pieces), LEAF)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.add.reduceat(chars, first), np.add.reduceat(np.array(self.count(pieces), np.int64), first), len(pieces)


def counter(ranks: bytes) -> Counter:
    """One for each worker and table."""
    key = hash(ranks)
    if key not in _MADE:
        _MADE[key] = Counter(ranks)
    return _MADE[key]


class Tree:
    """Characters, tokens and number of leaves, summed over slots; node i has the children 2i and 2i+1."""

    def __init__(self, text: str = "", chars=(), tokens=()):
        chars, tokens = np.asarray(chars, np.int64), np.asarray(tokens, np.int64)
        ends = chars.cumsum().tolist()
        self._lay([text[a:b] for a, b in zip([0, *ends], ends)], tokens)

    def _lay(self, texts: list[str], tokens) -> None:
        """All leaves, spread out evenly over twice as many slots at most."""
        n = len(texts)
        self.size = 1 << max(0, (n + n // 3 - 1)).bit_length() if n else 1
        self.texts, self.sums = [""] * self.size, np.zeros((2 * self.size, 3), np.int64)
        self._put(0, self.size, texts, tokens)

    def _put(self, a: int, b: int, texts: list[str], tokens) -> None:
        """These leaves and no others in the slots from a to b; then the sums above."""
        n = len(texts)
        at = (a + np.arange(n) * (b - a) // max(1, n)).tolist()
        self.texts[a:b] = [""] * (b - a)
        rows = self.sums[self.size + a : self.size + b]
        rows[:] = 0
        for i, t, k in zip(at, texts, tokens):
            self.texts[i] = t
            rows[i - a] = (len(t), k, 1)
        low, high = self.size + a, self.size + b
        while low > 1:
            low, high = low // 2, (high + 1) // 2
            self.sums[low:high] = self.sums[2 * low : 2 * high].reshape(-1, 2, 3).sum(1)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(slot, its start): the leaf that holds the position, or the last one."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if position - start < left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                start, node = start + left, 2 * node + 1
        return node - self.size, start

    def after(self, slot: int) -> int | None:
        """The next slot that holds a leaf."""
        node = slot + self.size
        while node > 1 and (node % 2 or not self.sums[node + 1, 0]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if self.sums[2 * node, 0] else 2 * node + 1
        return node - self.size

    def splice(self, first: int, last: int, texts: list[str], tokens: list[int]) -> None:
        """The leaves in the slots first to last give way to these."""
        a, b = first, last + 1
        if len(texts) > b - a:  # too few slots: the smallest subtree around that stays sparse
            level = 1
            while True:
                level *= 2
                if level > self.size:
                    break
                a, b = first // level * level, -(-(last + 1) // level) * level
                if b - a == level and self._within(a, first) + len(texts) + self._within(last + 1, b) <= 3 * level // 4:
                    break
            a, b = (0, self.size) if level > self.size else (a, b)
            texts = [*filter(None, self.texts[a:first]), *texts, *filter(None, self.texts[last + 1 : b])]
            old = lambda x, y: self.sums[self.size + x : self.size + y]
            left, right = old(a, first), old(last + 1, b)
            tokens = [*left[left[:, 2] > 0, 1].tolist(), *tokens, *right[right[:, 2] > 0, 1].tolist()]
            if level > self.size:
                self._lay(texts, tokens)
                return
        self._put(a, b, texts, tokens)

    def _within(self, a: int, b: int) -> int:
        return int(self.sums[self.size + a : self.size + b, 2].sum())

    def leaves(self) -> np.ndarray:
        out = self.sums[self.size :]
        return out[out[:, 2] > 0, :2]


def edit(tree: Tree, start: int, end: int, new: str, count: Counter) -> int:
    """Applies one edit to the tree: the number of pre-tokens encoded anew."""
    start = min(max(start, 0), tree.chars)
    end = min(max(end, start), tree.chars)
    first, at = tree.leaf_at(max(0, start - CONTEXT))
    parts, last, bound = [tree.texts[first]], first, at + len(tree.texts[first])  # the leaves taken in, and their end
    ends = {bound: first}
    following = tree.after(first)

    def take() -> str:
        nonlocal last, bound, following
        last = following
        bound += len(tree.texts[last])
        ends[bound] = last
        following = tree.after(last)
        return tree.texts[last]

    while bound < end and following is not None:
        parts.append(take())
    old = "".join(parts)
    text = old[: start - at] + new + old[end - at :]
    shift, behind = len(new) - (end - start), start - at + len(new)
    pieces, pos, done = [], 0, False
    while not done:
        for m in count.pattern.finditer(text, pos):
            if following is not None and m.end() + CONTEXT > len(text):
                break  # what follows may still change it
            pieces.append(m[0])
            pos = m.end()
            if pos >= behind and (slot := ends.get(at + pos - shift)) is not None and (len(pieces) >= LEAF // 2 or tree.after(slot) is None):
                last, done = slot, True
                break
        if not done:
            if following is None:
                break  # the end of the text: all leaves from the first on are replaced
            text += "".join([take() for _ in range(max(1, len(text) // 4096)) if following is not None])
    tokens = count.count(pieces)
    leaves = max(1, (len(pieces) + LEAF // 2) // LEAF) if pieces else 0
    cuts = [len(pieces) * i // leaves for i in range(leaves + 1)] if leaves else []
    tree.splice(first, last, ["".join(pieces[a:b]) for a, b in zip(cuts, cuts[1:])], [sum(tokens[a:b]) for a, b in zip(cuts, cuts[1:])])
    return len(pieces)


def edited(tree: Tree, edits: list[dict | None] | None, count: Counter) -> tuple[int, int]:
    """Applies edits in order: (their number, pre-tokens encoded anew)."""
    n = again = 0
    for e in edits or []:
        if e is not None:
            start = e["start"] or 0
            again += edit(tree, start, start if e["end"] is None else e["end"], e["text"] or "", count)
            n += 1
    return n, again


def load(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_STATE = "leaves array<struct<chars:int,tokens:int>>"


def build(docs: DataFrame, ranks: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """keep, text, leaves (the trees' state), n_pretokens, n_tokens."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, about 1 MB
    at = len(keep)
    src = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def work(batches):
        c = counter(shared.value)
        for b in batches:
            got = [c.leaves(t) for t in b.column(at).to_pylist()]
            flat = [np.concatenate([*(g[k] for g in got), np.zeros(0, np.int64)]).astype(np.int32) for k in (0, 1)]
            offsets = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["chars", "tokens"]))
            yield pa.RecordBatch.from_arrays([*b.columns, leaves, pa.array([g[2] for g in got], pa.int64()), pa.array([int(g[1].sum()) for g in got], pa.int64())], names=[*keep, "text", "leaves", "n_pretokens", "n_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(work, f"{fields}, text string, {_STATE}, n_pretokens long, n_tokens long")


def apply_edits(state: DataFrame, ranks: bytes, keep: list[str], with_state: bool = False) -> DataFrame:
    """state: keep, text, leaves, edits (array of start, end, text). Gives keep, n_edits,
    n_tokens_after, n_reencoded and, with_state, the new text and leaves."""
    small_batches(state.sparkSession)
    shared = state.sparkSession.sparkContext.broadcast(ranks)
    at = len(keep)
    leaf = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))

    def work(batches):
        c = counter(shared.value)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, (text, edits) in enumerate(zip(b.column(at).to_pylist(), b.column(at + 2).to_pylist())):
                values = b.column(at + 1)[i].values
                tree = Tree(text or "", np.asarray(values.field("chars")), np.asarray(values.field("tokens"))) if values is not None else Tree()
                n, again = edited(tree, edits, c)
                row = [n, tree.tokens, again, tree.text() if with_state else None, [{"chars": int(x), "tokens": int(y)} for x, y in tree.leaves()] if with_state else None]
                for col, x in zip(cols, row):
                    col.append(x)
            arrays = [pa.array(x, pa.int64()) for x in cols[:3]] + ([pa.array(cols[3], pa.string()), pa.array(cols[4], leaf)] if with_state else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *arrays], names=[*keep, "n_edits", "n_tokens_after", "n_reencoded", *(["text", "leaves"] if with_state else [])])

    fields = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in keep)
    return state.select(*keep, "text", "leaves", "edits").mapInArrow(work, f"{fields}, n_edits long, n_tokens_after long, n_reencoded long" + (f", text string, {_STATE}" if with_state else ""))


def count_edited(docs: DataFrame, ranks: bytes, keep: list[str], text: str = "text", edits: str = "edits") -> DataFrame:
    """`build` and `apply_edits` in one pass, without the state: keep, n_tokens, n_pretokens, n_edits, n_tokens_after, n_reencoded."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    at, names = len(keep), ["n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_reencoded"]

    def work(batches):
        c = counter(shared.value)
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for t, todo in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist()):
                chars, tokens, n = c.leaves(t or "")
                tree = Tree(t or "", chars, tokens)
                before = tree.tokens
                done, again = edited(tree, todo, c)
                for col, x in zip(cols, (before, n, done, tree.tokens, again)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array(x, pa.int64()) for x in cols)], names=[*keep, *names])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    src = docs.select(*keep, F.col(text).cast("string").alias(free(docs, "_t")), F.col(edits).alias(free(docs, "_e")))
    return src.mapInArrow(work, fields + ", " + ", ".join(f"{x} long" for x in names))


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    """Counts of every document, and after three edits: ten characters at a third are cut,
    a word is put in at half, a line is added at the end."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    one = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    docs = docs.withColumn("edits", F.array(one(F.floor(n / 3), F.floor(n / 3) + 10, ""), one(F.floor(n / 2), F.floor(n / 2), " edited"), one(n, n, "\nEnd.")))
    out = count_edited(docs, load(), ["doc_id"])
    return out.select("doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_reencoded")
