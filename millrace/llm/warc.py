"""WARC archives written from a table and read back by byte ranges.

Writing: each task writes gzip members, one a record, into files of bounded size. A payload that another page holds is
stored once; the others are revisit records that name it. Reading: a file is cut into ranges of equal size. A task looks
for gzip magic in its range, takes a candidate as a member if its header and its decoded head are those of a WARC record
and each member after it starts where the last one ended, until the range is left or the file ends. It owns the records
that start in its range.

The places that all tasks find are held against each other before any record is read: each range must begin where the
ranges before it ended, and the last must end with the file. A file where they don't (a payload may hold a whole archive)
is walked from its first byte by one task, which finds the same places or, if a member is broken or cut off, raises an
error. So no record of a file is lost without a word.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, open_fs, shared_dir

#: Payloads under this many bytes are never revisits. Fixed by the format of the results.
LEAST_SHARED = 100

#: Bytes after which a writer starts another file, bytes of a reader's range, of a read, and of a record's head.
FILE_BYTES, RANGE_BYTES, READ_BYTES, HEAD_BYTES = 64 << 20, 4 << 20, 1 << 18, 1 << 16

_MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page ``refers_to`` without the payload, as one gzip member."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a decoded record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record length")
    return fields, rest[:length]


class Members:
    """The gzip members of an open file, found from any byte on."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def member(self, at: int, whole: bool = True) -> tuple[bytes, int] | None:
        """What the member at a byte decodes to, and where it ends; None if there is none. Unless whole, its head alone."""
        unpack, out, place = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                data = self.source.read_at(min(READ_BYTES if whole else 4096, self.size - place), place) if place < self.size else b""
                if not data:
                    return None
                out.append(unpack.decompress(data) if whole else unpack.decompress(data, HEAD_BYTES))
                place += len(data)
                if not whole:
                    return b"".join(out), place
        except zlib.error:
            return None
        return b"".join(out), place - len(unpack.unused_data)

    def chain(self, at: int, end: int) -> tuple[int, bool]:
        """Where the members that follow each other from a byte lead, at most past the end of the range, and if they do."""
        while at < min(end, self.size):
            found = self.member(at)
            if found is None or not found[0].startswith(b"WARC/1."):
                return at, False
            at = found[1]
        return at, True

    def bounds(self, start: int, end: int) -> tuple[int | None, int | None]:
        """The byte at which the first member of the range starts, and where the range's last member ends; None without any."""
        if start == 0:
            return (0, self.chain(0, end)[0]) if self.size else (None, None)
        at = start
        while at < min(end, self.size):
            data = self.source.read_at(min(READ_BYTES, end + 2 - at, self.size - at), at)
            place = data.find(_MAGIC)
            while place >= 0:
                head = self.member(at + place, whole=False) if at + place < end else None
                if head is not None and head[0].startswith(b"WARC/1."):
                    stop, sound = self.chain(at + place, end)
                    if sound:
                        return at + place, stop
                place = data.find(_MAGIC, place + 1)
            at += max(1, len(data) - 2)
        return None, None

    def walk(self, step: int) -> Iterator[tuple[int, int | None, int | None]]:
        """Start, first and end of each range of ``step`` bytes, from the members of the whole file in turn."""
        at = 0
        for start in range(0, max(1, self.size), step):
            first = at if at < min(start + step, self.size) else None
            at, sound = self.chain(at, start + step)
            if not sound:
                raise ValueError(f"broken member at byte {at}")
            yield start, first, None if first is None else at

    def records(self, first: int | None, end: int) -> Iterator[bytes]:
        """The decoded records that start from ``first``, a member's start, to before ``end``."""
        at = first
        while at is not None and at < min(end, self.size):
            found = self.member(at)
            if found is None:
                raise ValueError(f"broken member at byte {at}")
            yield found[0]
            at = found[1]


def shared_payloads(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per page whose payload an earlier page holds: page_id and refers_to, the smallest page_id with that payload."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_n"))
    rows = rows.filter((F.col("_n") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    first = rows.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_pages")).filter("_pages > 1")
    first = first.select(F.col("_digest").alias("_d"), "refers_to")
    joined = rows.join(first, F.col("_digest") == F.col("_d")).filter(F.col("page_id") != F.col("refers_to"))
    return joined.select("page_id", "_digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record a page into ``folder`` (a URI that all executors reach); return the list of files (path, size)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    later = shared_payloads(pages, key, html).select(F.col("page_id").alias("_page"), F.col("_digest").alias("_d"), "refers_to")
    rows = rows.join(later, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        task, part, sink, name, own = TaskContext.get().partitionId(), 0, None, "", ""
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if sink is None:
                    name = f"{root}/pages-{task:06d}-{part:04d}.warc.gz"
                    own = f"{name}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(own, compression=None)
                sink.write(record_bytes(*row))
                if sink.tell() >= FILE_BYTES:
                    yield _closed(fs, sink, own, name)
                    sink, part = None, part + 1
        if sink is not None:
            yield _closed(fs, sink, own, name)

    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return materialize(rows.mapInArrow(write, "path string, size long"))


def _closed(fs, sink, own: str, name: str) -> pa.RecordBatch:
    size = sink.tell()
    sink.close()
    fs.move(own, name)
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], names=["path", "size"])


_BOUNDS = "path string, size long, start long, first long, stop long"


def _ranges(files: DataFrame, folder: str, range_bytes: int) -> DataFrame:
    """path, size, start, first and stop of all ranges of the files: where the first member starts and the last one ends."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), [pa.string(), *[pa.int64()] * 4], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "size", "start", "first", "stop"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with fs.open_input_file(path) as source:
                    yield rows([(path, size, start, *Members(source, size).bounds(start, start + range_bytes))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with fs.open_input_file(path) as source:
                    try:
                        for found in Members(source, size).walk(range_bytes):
                            yield rows([(path, size, *found)])
                    except ValueError as e:
                        raise ValueError(f"{e} of {path}") from None

    def spread(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(max(1, min(df.count(), 4 * df.sparkSession.sparkContext.defaultParallelism)), *keys)

    ranges = files.select("path", "size", F.explode(starts).alias("start"))
    found = materialize(spread(ranges, "path", "start").mapInArrow(locate, _BOUNDS))
    before = F.coalesce(F.max("stop").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.greatest(F.col("_before"), F.coalesce("stop", F.lit(0)))
    end = F.least(F.col("start") + range_bytes, F.col("size"))
    fits = (F.coalesce("first", "_before") == F.col("_before")) & (after >= end) & ((end < F.col("size")) | (after == end))
    broken = materialize(found.withColumn("_before", before).filter(~fits).select("path", "size").distinct())
    if broken.isEmpty():
        return found
    walked = materialize(spread(broken, "path").mapInArrow(walk, _BOUNDS))
    return found.join(broken.select("path"), "path", "left_anti").unionByName(walked)


def read_warc(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the listed files (path, size), whatever their order: page_id, payload_bytes, payload_digest,
    record_type, refers_to and, if asked for, payload (null for revisits). A broken or truncated file raises an error."""
    ranges = _ranges(files, folder, range_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fs, _ = open_fs(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

        def number(urn: str | None) -> int | None:
            name = (urn or "").strip("<>").removeprefix(_ID)
            return int(name) if name else None

        for batch in batches:
            for path, size, start, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out: list[list] = [[] for _ in names]
                with fs.open_input_file(path) as source:
                    for raw in Members(source, size).records(first, start + range_bytes):
                        fields, block = parse_record(raw)
                        digest, length = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                        if fields["warc-type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != length):
                            raise ValueError(f"payload of {fields['warc-record-id']} in {path} doesn't match its digest")
                        values = (number(fields["warc-record-id"]), length, digest, fields["warc-type"], number(fields.get("warc-refers-to")),
                                  block if fields["warc-type"] == "response" else None)
                        for column, value in zip(out, values, strict=False):
                            column.append(value)
                        if len(out[0]) >= 512:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
                            out = [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)

    ranges = ranges.filter("first IS NOT NULL").select("path", "size", "start", "first")
    n = max(1, min(ranges.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return ranges.repartition(n, "path", "start").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages as WARC archives and read them back.

    A null html is an empty payload. A page without an id is a response and nothing refers to it. Rows repeated with the
    smallest id of their payload are all responses. A null url is left out of the record. An empty table writes nothing
    and gives an empty result; other columns are left out.
    Ties of payloads go to the smallest id. A very long page is one record, written and read in one task.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(pages, folder, key, url, html), folder)
