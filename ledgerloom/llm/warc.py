"""WARC archives: a writer with revisits and a salvage reader.

`plan` decides which pages are responses and which revisit one with the same payload.
`write` puts one gzip member per record into archives in a folder that all executors
share; the names of an archive tell its partition and attempt, so that a late attempt of a
lost executor touches no other file, and the list that `write` returns has those that count.

`salvage` reads archives (compressed, with one record or many in a member, or plain). Blocks
pass through in pieces, whatever their size: digests and sizes are counted, a payload is
kept up to KEEP bytes. A record is good if its block digest (sha256 or sha1) holds or, if it
has none, its end mark stands where its length says. After a failed check, a record whose
length leads to an end mark and then to the next record or the end of the file is left out
whole, so that nothing quoted inside is taken for a record; otherwise the next gzip member
or version line is searched for. What is left out is reported as gaps. Work is linear: a
false sign costs a look at where its length leads, or at the start of its member.

Defined results: a null payload is empty; pages without id are responses that no page
revisits (their record id says null); rows that repeat the id of a group's response are
responses too; payloads under LEAST bytes are never revisits; extra columns don't matter; an
empty table gives no archives and no rows; payloads and headers may be as long as a row holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, scratch, small_batches

LEAST, ROLL, LEVEL = 100, 256 << 20, 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads (48 bytes each) that may be broadcast; more are joined by a shuffle.
GROUPS = 200_000
_SIGNS = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/1\.[01]\r\n")
_SIGN = 10  # bytes of the longest sign
#: Payloads up to so many bytes are given back by the reader; larger ones by size and digest alone.
KEEP = 64 << 20
_PIECE, _END = 1 << 20, b"\r\n\r\n"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    # Counts and smallest ids are combined before they move, so that a payload held by many pages is no burden.
    first = p.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(first.where("n > 1").select(F.col("payload_digest").alias("d"), "first"))
    first = F.broadcast(first) if first.count() <= GROUPS else first
    p = p.join(first, F.col("payload_digest") == F.col("d"), "left")
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; payload is empty for a revisit, size and digest are of the whole."""
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Writes archives below folder (a URI of a shared file system): archive, records, bytes. Runs at once."""
    small_batches(planned.sparkSession)
    src = planned.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")

    def work(batches):
        where, root = pafs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        ctx, done = TaskContext.get(), []
        out, path, n, size = None, None, 0, 0
        temp = f"{root}/.{ctx.partitionId()}-{ctx.taskAttemptId()}"

        def close():
            out.close()
            where.move(temp, path)
            done.append((f"{folder}/{path.rpartition('/')[2]}", n, size))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, n, size = f"{root}/pages-{ctx.partitionId():06d}-{ctx.taskAttemptId():08d}-{len(done):04d}.warc.gz", 0, 0
                    out = where.open_output_stream(temp, compression=None)
                page_id, url, payload, *rest = row
                data = _packed(record(page_id, url, (payload or "").encode("utf-8", "replace"), *rest))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "records", "bytes"])

    return cut(src.mapInArrow(work, "archive string, records long, bytes long"))


class Block(NamedTuple):
    payload_bytes: int
    payload_digest: str
    payload: bytes | None  # None: over KEEP bytes
    said_bytes: int | None  # the length in the HTTP header


class _File:
    """Bytes of a seekable file, by position, through one buffer."""

    def __init__(self, f):
        self.f, self.base, self.buf = f, 0, b""
        f.seek(0, 2)
        self.size = f.tell()
        self.marks = (1, 0)  # no end mark lies from the first to before the second

    def get(self, at: int, n: int) -> bytes:
        if not (self.base <= at and at + n <= self.base + len(self.buf)):
            self.f.seek(at)
            self.base, self.buf = at, self.f.read(max(n, _PIECE))
        return self.buf[at - self.base : at - self.base + n]

    def sign(self, at: int) -> bool:
        return bool(_SIGNS.match(self.get(at, _SIGN)))

    def next_sign(self, at: int) -> int:
        """Where the next sign at this position or later begins, or the end of the file."""
        while at < self.size:
            self.get(at, min(_PIECE // 2, self.size - at))
            if m := _SIGNS.search(self.buf, at - self.base):
                return self.base + m.start()
            at = max(at + 1, self.base + len(self.buf) - _SIGN + 1) if self.base + len(self.buf) < self.size else self.size
        return self.size

    def end_mark(self, at: int) -> int:
        """Where the next end mark begins; the size if there is none."""
        low, high = self.marks
        if not low <= at <= high:
            high = at
            while high < self.size:
                self.get(high, min(_PIECE // 2, self.size - high))
                k = self.buf.find(_END, high - self.base)
                if k >= 0:
                    high = self.base + k
                    break
                high = max(high + 1, self.base + len(self.buf) - 3) if self.base + len(self.buf) < self.size else self.size
            self.marks = (at, high)
        return self.marks[1]

    def pieces(self, at: int, n: int):
        while n > 0 and (piece := self.get(at, min(n, _PIECE))):
            yield piece
            at, n = at + len(piece), n - len(piece)


class _Member:
    """The inflated bytes of the gzip member at a position, in order."""

    def __init__(self, file: _File, at: int):
        self.file, self.at, self.step, self.d, self.buf, self.rest = file, at, 512, zlib.decompressobj(31), bytearray(), b""

    def fill(self, n: int) -> bool:
        while len(self.buf) < n and not self.d.eof:
            if not self.rest:
                self.rest = self.file.get(self.at, min(self.step, self.file.size - self.at))
                if not self.rest:
                    raise ValueError("member cut short")
                self.at += len(self.rest)
                self.step = min(2 * self.step, 1 << 16)
            self.buf += self.d.decompress(self.rest, _PIECE)
            self.rest = self.d.unconsumed_tail
        return len(self.buf) >= n

    def take(self, n: int) -> bytes:
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def head(self) -> bytes:
        """Up to the next end mark, which is dropped; raises where there is none."""
        seen = 0
        while (k := self.buf.find(_END, max(0, seen - 3))) < 0:
            seen = len(self.buf)
            if not self.fill(seen + 1):
                raise ValueError("header cut short")
        out = self.take(k)
        self.take(4)
        return out

    def pieces(self, n: int):
        while n > 0 and (self.fill(1) or self.buf):
            piece = self.take(min(n, _PIECE))
            yield piece
            n -= len(piece)

    def skip_to_sign(self) -> bool:
        while True:
            if m := re.search(rb"WARC/1\.[01]\r\n", self.buf):
                self.take(m.start())
                return True
            if not self.fill(len(self.buf) + 1):
                return False
            self.take(max(0, len(self.buf) - _PIECE))

    @property
    def end(self) -> int:
        return self.at - len(self.d.unused_data)


def _fields(head: bytes) -> tuple[dict[str, str], int]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no version line")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    said = fields.get("content-length", "")
    if not (said.isascii() and said.isdigit() and len(said) < 19):
        raise ValueError("no length")
    return fields, int(said)


def _block(fields: dict[str, str], size: int, pieces) -> tuple[Block | None, bool | None]:
    """(block, whether its digest holds; None: it has none); no block: the pieces end too early."""
    kind, _, said = fields.get("warc-block-digest", "").partition(":")
    check = hashlib.new(kind.lower()) if kind.lower() in ("sha1", "sha256") else None
    payload, kept, n, got = hashlib.sha256(), [], 0, 0
    http = b"" if fields.get("content-type", "").lower().startswith("application/http") else None
    said_bytes, tail = None, b""
    for piece in pieces:
        got += len(piece)
        if check:
            check.update(piece)
        if http is not None:  # the payload begins behind the HTTP header
            joined = tail + piece
            k = joined.find(_END)
            if k < 0:
                http, tail = (http + piece)[: 1 << 16], joined[-3:]
                continue
            http = (http + piece[: max(0, k - len(tail))])[: 1 << 16]
            m = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})", http)
            said_bytes, http, piece = int(m[1]) if m else None, None, joined[k + 4 :]
        payload.update(piece)
        n += len(piece)
        kept = kept + [piece] if kept is not None and n <= KEEP else None
    if got < size:
        return None, None
    holds = None
    if check:
        raw = check.digest()
        holds = said.lower() == raw.hex() or said.upper() == base64.b32encode(raw).decode()
    return Block(n, payload.hexdigest(), b"".join(kept) if kept is not None else None, said_bytes), holds


def _plain(s: _File, at: int) -> tuple[int, dict[str, str] | str, Block | None]:
    """(end, fields, block) of a good record, (end, why, None) of one that is left out whole; raises where no record lies."""
    mark = s.end_mark(at)
    if mark >= s.size:
        raise ValueError("header cut short")
    fields, size = _fields(s.get(at, mark - at))
    begin = mark + 4
    if begin + size > s.size:
        raise ValueError("block cut short")
    end = begin + size
    marked = s.get(end, 4) == _END
    after = end + 4 * marked
    sound = marked and (after == s.size or s.sign(after)) or end == s.size
    if not sound and not marked and "warc-block-digest" not in fields:
        raise ValueError("no end mark")
    if not sound and size > 64 * _PIECE and not marked:
        raise ValueError("no end mark")
    block, holds = _block(fields, size, s.pieces(begin, size))
    if block and (holds or holds is None and marked):
        return after, fields, block
    if sound:
        return after, "block digest differs" if holds is False else "no end mark", None
    raise ValueError("block digest differs")


def _member(s: _File, at: int):
    """(fields, block) of each good record of a member, (why, None) of each gap; the last item is its end alone."""
    m, held = _Member(s, at), None
    while m.fill(1) or m.buf:
        try:
            fields, size = _fields(m.head())
            block, holds = _block(fields, size, m.pieces(size))
            if block is None:
                raise ValueError("block cut short")
            m.fill(4)
            marked = m.buf[:4] == _END
            if marked:
                m.take(4)
            elif not holds:
                raise ValueError("no end mark")
            got = ("block digest differs", None) if holds is False else (fields, block)
        except ValueError as e:
            got = (str(e), None)
            if str(e) == "member cut short":
                raise
            m.skip_to_sign()
        m.fill(1)  # a member that breaks off here holds no more good records
        if held:
            yield held
        held = got
    if held is None:
        raise ValueError("empty member")
    yield held
    yield m.end


def salvage(f):
    """(offset, length, fields, block) for each good record, (offset, length, reason, None) for each gap, of a seekable file.

    The records of a member have its offset; the last of them has its length, the others 0."""
    s, at, gap, why = _File(f), 0, None, ""
    while at < s.size:
        try:
            m = _SIGNS.match(s.get(at, _SIGN))
            if not m:
                raise ValueError("no record starts here")
            found = []
            if m[0][:1] == b"\x1f":
                for got in _member(s, at):
                    if isinstance(got, int):
                        end = got
                        break
                    if len(found) == 1:
                        yield from _closed(s, gap, at, why)
                        gap = None
                        yield at, 0, *found.pop()
                    found.append(got)
            else:
                end, *got = _plain(s, at)
                found.append(tuple(got))
        except (ValueError, zlib.error) as e:
            if gap is None:
                gap, why = at, str(e)
            at = s.next_sign(at + 1)
            continue
        yield from _closed(s, gap, at, why)
        gap = None
        yield at, end - at, *found[-1]
        at = end
    yield from _closed(s, gap, at, why)


def _closed(s: _File, gap: int | None, at: int, why: str):
    if gap is not None:
        yield gap, at - gap, why, None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record and each gap of the archives (column archive: URIs).

    archive, offset, length, gap (why, else null), record_type, record_id, refers_to, url,
    payload_bytes and payload_digest (of the whole payload, also for revisits), payload (null: revisit,
    over KEEP bytes, or not asked for)."""
    small_batches(archives.sparkSession)
    schema = "archive string, offset long, length long, gap string, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(archive, at, size, fields, block):
        if block is None:
            return (archive, at, size, fields, *[None] * 7)
        revisit = fields.get("warc-type") == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else block.payload_digest
        n = block.said_bytes if revisit and block.said_bytes is not None else block.payload_bytes
        return (archive, at, size, None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), n, digest, None if revisit or not payloads else block.payload)

    def work(batches):
        for b in batches:
            for archive in b.column(0).to_pylist():
                where, path = pafs.FileSystem.from_uri(archive)
                part, held = [], 0
                with where.open_input_file(path) as f:
                    for got in salvage(f):
                        part.append(row(archive, *got))
                        held += got[1]
                        if held > 1 << 22 or len(part) > 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)
                            part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    return archives.select("archive").mapInArrow(work, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    archives = write(plan(read(spark, sf_dir, "pages")), scratch(spark, "warc"))
    back = read_archives(archives, payloads=False).where("gap is null")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:x-page:(-?[0-9]+)', 1) as bigint)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
