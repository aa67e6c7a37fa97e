"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. The formatter never
looks inside it: it renders each prefix of the conversation, and what a prefix adds to
the one before is the span of its last turn. Where the text lies inside its turn is told by
the same prefixes with MARK for every text: what a turn adds there is its frame, and the
frame's two ends are the template's. Frames depend on the roles alone and are remembered,
so that a turn costs one render; where a frame doesn't fit (a template that looks at the
texts), the turn is rendered again with MARK for its text alone.

Where the earlier output isn't a prefix of the later one, the template rewrites history:
`rewrites` tells. Spans of prefixes then mean nothing, so turns have none (null), and each
text is looked for in the last render, by rendering the whole with MARK for it: it has a span
if MARK stands there once, alone, and null otherwise (dropped, repeated, or used elsewhere).
`verbatim` tells whether a span, read back, is the turn's text: a template that trims or
rewords texts is seen there. Only texts with a span are under the loss mask.

`TEMPLATE` marks turns as <s>role, line end, text, </s>, line end. Control strings cannot
occur inside: backslash, < and [ are escaped by a backslash and a letter, reversibly.

Conversations stream through a task sorted by (conv_id, turn): one conversation is in memory
at a time. Rendering all prefixes costs turns x length a conversation, as the method says: 400
turns of 60 characters take 0.4 s here, 4,000 take 32 s, and a conversation can't be split.

Defined results: turns are ordered by turn (null first), then role, then text; null roles
and texts are empty; a row without conv_id is a conversation of its own, with null id;
repeated rows are turns of their own; texts may be as long as a row holds; other columns
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import literal_rows, read, small_batches

LOSS = "assistant"
#: Fixed value: a character for private use; texts that hold it are rendered with the next one.
MARK = 0xE000
_ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}


def escape(text: str) -> str:
    """Short texts are remembered, as every prefix renders them again."""
    return _remembered(text) if len(text) < 1 << 12 else _escape(text)


def _escape(text: str) -> str:
    for a, b in _ESCAPES:
        text = text.replace(a, b)
    return text


_remembered = functools.lru_cache(4096)(_escape)


def unescape(text: str) -> str:
    head, *rest = text.split("\\")
    out, rest = [head], iter(rest)
    for part in rest:
        if part:
            out += [_BACK[part[0]], part[1:]]
        else:  # two backslashes: one, and then the next part as it is
            out += ["\\", next(rest)]
    return "".join(out)


def TEMPLATE(turns: list[tuple[str, str]]) -> str:  # noqa: N802
    return "".join(f"<s>{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}</s>\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from what TEMPLATE gives."""
    out = []
    for part in formatted.split("<s>")[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape(role), unescape(rest[: rest.rindex("</s>\n")])))
    return out


class Formatter:
    """A template with the frames that it puts around texts; read: from what stands in a span to the text."""

    def __init__(self, template=TEMPLATE, read=None):
        self.template = template
        self.read = read or (unescape if template is TEMPLATE else lambda x: x)
        self.seen: dict[tuple, tuple[str, list[tuple[str, str] | None]]] = {}

    def _frames(self, roles: tuple[str, ...]) -> list[tuple[str, str] | None]:
        """What stands before and after the text of each turn; None where the frames don't tell."""
        if roles in self.seen:
            return self.seen[roles]
        if len(self.seen) >= 256:
            self.seen.clear()
        mark, out, before = chr(MARK), [], self.template([])
        for i in range(len(roles)):
            now = self.template([(r, mark) for r in roles[: i + 1]])
            ends = now[len(before) :].split(mark) if now.startswith(before) else []
            out.append((ends[0], ends[1]) if len(ends) == 2 else None)
            before = now
        if sum(map(len, roles)) < 1 << 12:
            self.seen[roles] = out
        return out

    def _probe(self, turns: list[tuple[str, str]], i: int, out: str) -> tuple[int, int] | None:
        """Where the text of turn i lies in out, the render of turns; None if it isn't there once."""
        code = MARK
        while chr(code) in out:
            code += 1
        got = self.template([*turns[:i], (turns[i][0], chr(code)), *turns[i + 1 :]])
        head, sep, tail = got.partition(chr(code))
        fits = sep and chr(code) not in tail and len(head) + len(tail) <= len(out) and out.startswith(head) and out.endswith(tail)
        return (len(head), len(out) - len(tail)) if fits else None

    def spans(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple], bool]:
        """(output, for each turn (start, end, start of its text, end of its text, verbatim), whether history was rewritten)."""
        frames = self._frames(tuple(r for r, _ in turns))
        before, where, rewrites = self.template([]), [], False
        for i, (_, text) in enumerate(turns):
            now, start = self.template(turns[: i + 1]), len(before)
            if not rewrites and now.startswith(before):
                f = frames[i]
                if f and len(now) - start >= len(f[0]) + len(f[1]) and now.startswith(f[0], start) and now.endswith(f[1]):
                    at = (start + len(f[0]), len(now) - len(f[1]))
                else:
                    at = self._probe(turns[: i + 1], i, now)
                where.append((start, len(now), at))
            else:
                rewrites = True
            before = now
        if rewrites:
            where = [(None, None, self._probe(turns, i, before)) for i in range(len(turns))]
        out = []
        for (a, b, at), (_, text) in zip(where, turns):
            out.append((a, b, *at, self._reads(before[at[0] : at[1]], text)) if at else (a, b, None, None, False))
        return before, out, rewrites

    def _reads(self, piece: str, text: str) -> bool:
        try:
            return self.read(piece) == text
        except (KeyError, IndexError, StopIteration, ValueError):
            return False


def spans(turns: list[tuple[str, str]], template=TEMPLATE, read=None) -> tuple[str, list[tuple], bool]:
    return Formatter(template, read).spans(turns)


def convert(rows: DataFrame, template=TEMPLATE, loss: str = LOSS, read=None) -> DataFrame:
    """conv_id, formatted, rewrites, turns: array of (role, start, end, text_start, text_end, verbatim, in_loss)."""
    small_batches(rows.sparkSession)
    item = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("verbatim", pa.bool_()), ("in_loss", pa.bool_())])
    kind = rows.schema["conv_id"].dataType.simpleString()
    src = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows without id are dealt by a number of their own.
    src = src.withColumn("own", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    src = src.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "role", "text")

    def work(batches):
        id_type, form = None, Formatter(template, read)

        def stream():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield from zip(zip(b.column(0).to_pylist(), b.column(4).to_pylist()), b.column(2).to_pylist(), b.column(3).to_pylist())

        def batch(part):
            cols = list(zip(*part))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.list_(item))], names=["conv_id", "formatted", "rewrites", "turns"])

        part, size = [], 0
        for (conv, _), got in itertools.groupby(stream(), key=lambda r: r[0]):
            turns = [(r, t) for _, r, t in got]
            text, where, rewrites = form.spans(turns)
            part.append((conv, text, rewrites, [dict(zip(("role", "start", "end", "text_start", "text_end", "verbatim", "in_loss"), (r, *w, r == loss and w[2] is not None))) for (r, _), w in zip(turns, where)]))
            size += len(text)
            if size > 1 << 22:
                yield batch(part)
                part, size = [], 0
        if part:
            yield batch(part)

    return src.mapInArrow(work, f"conv_id {kind}, formatted string, rewrites boolean, turns array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,verbatim:boolean,in_loss:boolean>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    small_batches(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    def work(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text, turns in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                back = parse(text)
                under = "".join(unescape(text[t["text_start"] : t["text_end"]]) for t in turns if t["in_loss"])
                for c, x in zip(cols, (len(back), sha("".join(f"{r}\n{t}\n" for r, t in back)), len(under), sha(under), len(text))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names[1:], cols))], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "turns").mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = literal_rows(spark, [{"conv_id": -1, "turn": i, "role": r, "text": said} for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(convert(rows.unionByName(more)))
