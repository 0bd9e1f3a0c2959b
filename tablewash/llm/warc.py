"""WARC archives: writing with revisit records, and reading by verified chains of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import fresh, materialize
from tablewash.session import scratch_dir

MAGIC, GZIP = b"WARC/1.0\r\n", b"\x1f\x8b\x08"
#: A new file begins when one has this many bytes; a file is read in splits of SPLIT bytes.
FILE_BYTES, SPLIT = 1 << 30, 4 << 20
#: Bytes handed to Spark at a time.
BATCH_BYTES = 8 << 20
NAME = "urn:tablewash:page:"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes | None, size: int, sha1: str, first: str | None) -> bytes:
    """A response record, or with ``first`` a revisit of that page's record, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{page}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <{NAME}{first}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(
    df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0,
    compress: bool = True, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row of ``df`` and return the files: ``path``, ``bytes``, ``records``.

    The payload is the html in UTF-8, empty if NULL. Of rows with equal payloads of at least
    ``revisit_from`` bytes those with the smallest page (NULL pages last) are responses, the others
    are revisits that name it and have no payload. A page is written as text; a NULL page as
    nothing. White space in a url becomes ``%20``, a NULL url is empty.

    Payloads are compared by SHA-1. Only digests that occur twice or more meet the rows, one small
    row each, and a digest that a third of the rows share is counted before the shuffle. Each task
    writes files of its own into the session's shared folder, each record a gzip member unless
    ``compress`` is off. The returned table is written after the files, so what a lost or repeated
    task left behind is not in it. An empty table gives no file.
    """
    pages, sha, first, times = fresh(df, "page", "sha", "first", "times")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = df.select(F.col(page).alias(pages), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias(sha))
    repeated = df.select(F.col(page).alias(pages), F.sha1(payload).alias("of"), F.length(payload).alias("n")).where(
        F.col("n") >= revisit_from).groupBy("of").agg(F.min(pages).alias(first), F.count(F.lit(1)).alias(times)).where(F.col(times) > 1)
    told = rows.join(repeated, F.col(sha) == F.col("of"), "left").select(
        F.coalesce(F.col(pages).cast("string"), F.lit("")).alias("page"),
        F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("")).alias("url"), "payload",
        F.when(F.col(times).isNotNull() & ~F.col(pages).eqNullSafe(F.col(first)), F.coalesce(F.col(first).cast("string"), F.lit(""))).alias("first"))
    folder = f"{scratch_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    where, inside = _open(folder)
    where.create_dir(inside, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    system, name = _open(path)
                    out, size, count = system.open_output_stream(name, compression=None), 0, 0
                body = row["payload"]
                data = record(row["page"], row["url"], body if row["first"] is None else None, len(body), digest(body), row["first"])
                if compress:
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = member.compress(data) + member.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return materialize(told.mapInArrow(write, "path string, bytes long, records long"))


#: Tasks that read archives; beyond, a task reads several splits.
MOST_TASKS = 50_000


class Window:
    """Bytes of a file from ``start`` on, read when they are asked for."""

    def __init__(self, path: str, start: int, size: int):
        system, name = _open(path)
        self.file, self.start, self.size, self.data = system.open_input_file(name), start, size, b""

    def upto(self, end: int) -> bytes:
        """The bytes read so far, which reach ``end`` at least, or the end of the file."""
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.file.seek(have)
            # What is held is doubled, so that the bytes of a large record are copied a few times only.
            self.data += self.file.read(min(max(end - have, len(self.data), 1 << 20), self.size - have))
        return self.data

    def drop(self, before: int) -> None:
        self.data, self.start = self.data[max(0, before - self.start) :], max(before, self.start)


def _next_plain(window: Window, at: int) -> tuple[int, bytes] | None:
    """Where the record at ``at`` ends, and the record; None if there is no whole record."""
    i, reach = at - window.start, 4096
    while True:
        data = window.upto(at + reach)
        if data[i : i + len(MAGIC)] != MAGIC:
            return None
        head = data.find(b"\r\n\r\n", i)
        if head >= 0:
            break
        if window.start + len(data) >= window.size or reach > 1 << 20:
            return None
        reach *= 4
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", data[i : head + 2], re.I)
    if not length:
        return None
    end = head + 4 + int(length[1]) + 4
    if window.start + end > window.size:
        return None
    data = window.upto(window.start + end)
    return (window.start + end, data[i:end]) if data[end - 4 : end] == b"\r\n\r\n" else None


def _next_member(window: Window, at: int) -> tuple[int, bytes] | None:
    """The same for a gzip member that holds one record."""
    i, reach, unpack, out = at - window.start, 0, zlib.decompressobj(31), []
    try:
        while not unpack.eof:
            step = 1 << 16
            data = window.upto(at + reach + step)
            piece = data[i + reach : i + reach + step]
            if not piece:
                return None
            out.append(unpack.decompress(piece))
            if not reach and not MAGIC.startswith(out[0][: len(MAGIC)]) and not out[0].startswith(MAGIC):
                return None
            reach += len(piece)
    except zlib.error:
        return None
    text = b"".join(out)
    return (at + reach - len(unpack.unused_data), text) if text.startswith(MAGIC) and text.endswith(b"\r\n\r\n") else None


def candidates(path: str, size: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(offset, exit) for each place of [start, end) that looks like a record: where the chain of
    successors from it leaves [start, end). A chain that breaks inside gives nothing."""
    window, packed = Window(path, start, size), path.endswith(".gz")
    magic, following = (GZIP, _next_member) if packed else (MAGIC, _next_plain)
    data = window.upto(min(size, end + len(magic) - 1))
    places, at = [], data.find(magic)
    while 0 <= at < end - start:
        places.append(start + at)
        at = data.find(magic, at + 1)
    leaves: dict[int, int] = {}
    for place in reversed(places):
        found = following(window, place)
        if found:
            after = found[0]
            if after >= end or after >= size:
                leaves[place] = after
            elif after in leaves:
                leaves[place] = leaves[after]
    yield from leaves.items()


def record_starts(spark, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, bytes, offset) of the first record of each split that holds the start of one.

    Every split is scanned on its own for places that look like records. Each candidate points to
    where its chain of records leaves the split. Pointer jumping from the start of each file then
    keeps the candidates that real records lead to: in round k the reached set takes one step of
    2 ** k links, and the links are joined with themselves to double in length. Magic bytes
    inside a payload may look like a record, but no chain from the start of the file reaches them.
    Raises if the chain of a file does not end at the file's end.
    """
    most = files.agg(F.max("bytes")).first()[0] or 0
    splits = files.select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split).cast("long"))).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["bytes"], row["start"] + split)
                found = list(candidates(row["path"], row["bytes"], row["start"], end))
                if found:
                    offset, leave = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["path"]] * len(found)), pa.array(offset), pa.array(leave)], ["path", "offset", "leave"])

    links = materialize(splits.repartition(_tasks(files, split), "path", "start").mapInArrow(scan, "path string, offset long, leave long"))
    reached = files.select("path", F.lit(0).cast("long").alias("offset"))
    for k in range(math.ceil(math.log2(max(1, -(-most // split)))) + (most > split)):
        step = reached.join(links, ["path", "offset"]).select("path", F.col("leave").alias("offset"))
        reached = materialize(reached.union(step).distinct())
        onward = links.select("path", F.col("offset").alias("leave"), F.col("leave").alias("further"))
        links = materialize(links.join(onward, ["path", "leave"], "left").select(
            "path", "offset", F.coalesce("further", "leave").alias("leave")))
    # With a link of full length from offset 0, the last leave of a whole file is its end.
    ends = links.where("offset = 0").join(files.select("path", "bytes"), "path", "right")
    broken = ends.where("leave IS NULL OR leave <> bytes").agg(F.count(F.lit(1)), F.min("path")).first()
    if broken[0]:
        raise ValueError(f"{broken[0]} archives have no whole chain of records, one is {broken[1]}")
    return reached.join(files.select("path", "bytes"), "path").where("offset < bytes").select("path", "bytes", "offset")


def _tasks(files: DataFrame, split: int) -> int:
    """As many tasks as splits: a split's row is tiny but stands for megabytes, so a number is given,
    which adaptive execution does not merge."""
    splits = files.agg(F.sum(F.ceil(F.greatest("bytes", F.lit(1)) / split))).first()[0] or 1
    return int(min(splits, MOST_TASKS))


def read_warc(spark, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of ``files`` (``path``, ``bytes``): ``path``, ``offset``, ``record_type``, ``record_id``,
    ``url``, ``payload`` (NULL in revisits), ``payload_bytes``, ``payload_digest`` and ``refers_to``.

    Records are found by ``record_starts``, so a file of any size is read by many tasks and magic
    bytes inside payloads are not taken for records. A response whose payload does not have the
    digest of its header raises. An empty list of files gives an empty table.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                at, end = row["offset"], (row["offset"] // split + 1) * split
                window = Window(row["path"], at, row["bytes"])
                following = _next_member if row["path"].endswith(".gz") else _next_plain
                while at < min(end, row["bytes"]):
                    after, data = following(window, at)
                    held.append((row["path"], at, *parse(data)))
                    size += len(data)
                    window.drop(after)
                    at = after
                    if size >= BATCH_BYTES:
                        yield _records(held)
                        held, size = [], 0
        if held:
            yield _records(held)

    starts = record_starts(spark, files, split)
    return starts.repartition(_tasks(files, split), "path", "offset").mapInArrow(read, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


FIELDS = {"path": "string", "offset": "long", "record_type": "string", "record_id": "string", "url": "string",
          "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "refers_to": "string"}


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), FIELDS.values())], list(FIELDS))


def parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest(body) != sha1:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
    return (fields["warc-type"], fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri", ""),
            None if revisit else body, int(size[1]) if revisit else len(body), sha1,
            fields["warc-refers-to"].strip("<>") if revisit else None)
