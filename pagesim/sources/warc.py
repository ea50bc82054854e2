"""WARC files as a Spark data source: ``spark.read.format("warc")`` and back."""

from __future__ import annotations

import gzip
import re
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
)

from .files import (
    READ_ERRORS, ByteReader, StagedFiles, Written, file_partitions, first_rows, plain_size, range_tasks, read_ahead,
    record_batches,
)

SUFFIXES = (".warc", ".warc.gz")
# Fixed values ---------------------------------------------------------------
VERSION = "WARC/1.0"
HEADER_LINE = re.compile(r"([a-zA-Z_\-]+): *(.*)")
# ----------------------------------------------------------------------------
RECORD_START = re.compile(rb"WARC/\d+\.\d+\r\n")

SCHEMA = (
    "file string, offset bigint, size bigint, member_offset bigint, version string, "
    "headers map<string,string>, record_type string, record_id string, url string, "
    "ip_address string, date timestamp, content_length bigint, checksum string, "
    "payload binary, error string"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("size", pa.int64()),
        ("member_offset", pa.int64()),
        ("version", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("ip_address", pa.string()),
        ("date", pa.timestamp("us", tz="UTC")),
        ("content_length", pa.int64()),
        ("checksum", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


#: With ``splitGzip``: the range of the file in which a record begins, from where its ``offset`` counts.
RANGE = "range bigint"
#: With ``rangeSizes``: the plain bytes of each range of a gzip file.
RANGE_SIZES = "file string, range bigint, size bigint"


def ranged(schema: pa.Schema, options: dict) -> pa.Schema:
    return schema.append(pa.field("range", pa.int64())) if "splitGzip" in options else schema


def range_schema(schema: str, options: dict) -> str:
    if "rangeSizes" in options:
        return RANGE_SIZES
    return f"{schema}, {RANGE}" if "splitGzip" in options else schema


def range_sizes(parts, mark: re.Pattern) -> pa.RecordBatch:
    columns = [[p.path for p in parts], [p.start for p in parts], [plain_size(p, mark) for p in parts]]
    return pa.RecordBatch.from_pydict(dict(zip(("file", "range", "size"), columns)))


class BadRecord(ValueError):
    """Bytes that break the record grammar."""


def _timestamp(text):
    try:
        when = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return when if when.tzinfo else when.replace(tzinfo=timezone.utc)


def parse_head(block: bytes) -> dict[str, str]:
    """The fields of a record's head: its first line, its header lines and the empty one."""
    first, *lines = block.decode("utf-8").split("\r\n")
    if first != VERSION:
        raise BadRecord(f"no {VERSION} record begins here: {first[:80]!r}")
    if lines[-2:] != ["", ""]:
        raise BadRecord("the file ends inside a record's head")
    fields = [HEADER_LINE.fullmatch(line) for line in lines[:-2]]
    if None in fields:
        raise BadRecord(f"not a header field: {lines[fields.index(None)][:80]!r}")
    return {field[1].lower(): field[2] for field in fields}


class WarcReader(DataSourceReader):
    """What is not wanted is asked for by options and not by pushed filters: Spark keeps
    the filters of a data source written in Python with the scan, and a table
    that was filtered once would lack those rows in all that is read from it later."""

    def __init__(self, options):
        self.options = options
        self.failfast = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.payload_limit = int(options.get("payloadLimit", -1))
        self.record_type = options.get("recordType")
        self.longer_than = int(options.get("longerThan", -1))
        self.most = int(options["maxRecords"]) if "maxRecords" in options else None

    def partitions(self):
        return range_tasks(file_partitions(self.options, SUFFIXES))

    def _wanted(self, kind, length):
        return self.record_type in (None, kind) and length > self.longer_than

    def _record(self, data: ByteReader, start: int, block: bytes) -> dict | None:
        """The row of the record whose head was read; None if no filter wants it."""
        headers = parse_head(block)
        if not headers.get("content-length", "").isdecimal():
            raise BadRecord(f"no length in the head: {headers.get('content-length')!r}")
        length, kind = int(headers["content-length"]), headers.get("warc-type")
        wanted = self._wanted(kind, length)
        keep = length if self.payload_limit < 0 else min(length, self.payload_limit)
        payload = data.take(keep) if wanted and self.with_payload else None
        got = len(payload or b"")
        got += data.skip(length - got)
        if got != length:
            raise BadRecord(f"the payload has {got} of {length} bytes")
        if (end := data.take(4)) != b"\r\n\r\n":
            raise BadRecord(f"the record does not end after its payload: {end!r}")
        return {
            "size": data.offset - start,
            "version": VERSION.removeprefix("WARC/"),
            "headers": list(headers.items()),
            "record_type": kind,
            "record_id": headers.get("warc-record-id"),
            "url": headers.get("warc-target-uri"),
            "ip_address": headers.get("warc-ip-address"),
            "date": _timestamp(headers.get("warc-date")),
            "content_length": length,
            "checksum": headers.get("warc-payload-digest"),
            "payload": payload,
        } if wanted else None

    def _rows(self, part):
        data = ByteReader(part.path, part.packed, part.start, RECORD_START, read_ahead(part))
        here = {"file": part.path, "range": part.start if part.packed else None}
        try:
            if part.start and not part.packed and not self._find(data, part.start):
                return
            while True:
                start = data.offset
                try:
                    block = data.block()
                    member = data.member_offset(start)
                    begins = member if part.packed else start
                    if part.stop is not None and begins is not None and begins >= part.stop:
                        return
                    if data.broken:
                        raise BadRecord(data.broken)
                    if not block:
                        return
                    row = self._record(data, start, block)
                    if data.broken and row is None:
                        raise BadRecord(data.broken)
                except READ_ERRORS as e:
                    reason = data.broken or str(e)
                    if self.failfast:
                        raise BadRecord(f"{part.path} at {start}: {reason}") from e
                    # told whatever the filters ask for: it stands for records that are not known
                    yield here | {"offset": start, "error": reason}
                    if not data.go_on(start, RECORD_START):
                        return
                    continue
                if row is not None:
                    yield row | here | {"offset": start, "member_offset": member}
        finally:
            data.close()

    def _find(self, data: ByteReader, start: int) -> bool:
        """Stand at the first record of a plain file at or after ``start``.

        A line in a payload may look like a record's first; it is none unless a
        whole head follows, and its length leads to the next record or the end.
        """
        after = start - 2
        while data.go_on(after, RECORD_START):
            after = data.offset
            try:
                length = int(parse_head(data.block())["content-length"])
                ended = data.skip(length) == length and data.take(4) == b"\r\n\r\n"
                head = data.line()
            except (ValueError, KeyError):
                ended = False
            if ended and (not head or RECORD_START.match(head)):
                break
        else:
            return False
        data.seek(after)
        return True

    def read(self, partition):
        if partition is None:  # there is nothing to read
            return
        if "rangeSizes" in self.options:
            yield range_sizes(partition.parts, RECORD_START)
        else:
            rows = (row for part in partition.parts for row in first_rows(self._rows(part), self.most))
            yield from record_batches(rows, ranged(_ARROW, self.options))

    def at(self, batches):
        """The records at places given as ``file, offset, member_offset`` and columns to pass on.

        A record of a gzip file that does not begin its member is reached from the
        beginning of the file.
        """
        data, opened = None, None

        def rows(batch):
            nonlocal data, opened
            for place in batch.to_pylist():
                path, member = place["file"], place["member_offset"]
                given = self.options.get("compression", "").lower()
                packed = given == "gzip" if given else path.endswith(".gz")
                if packed or opened != path:
                    if data is not None:
                        data.close()
                    data, opened = ByteReader(path, packed, member or 0), path
                if not packed:
                    data.seek(place["offset"])
                elif member is None:
                    data.skip(place["offset"])
                yield self._record(data, data.offset, data.block()) | place

        try:
            for batch in batches:
                yield from record_batches(rows(batch), pa.schema([*_ARROW, *list(batch.schema)[3:]]))
        finally:
            if data is not None:
                data.close()


class WarcWriter(DataSourceArrowWriter):
    """Writes the ``record`` column, already in record form, one file per task."""

    def __init__(self, options, overwrite):
        self.files = StagedFiles(options["path"], overwrite)
        self.gzip = options.get("compression", "none").lower() == "gzip"

    def write(self, iterator):
        suffix = ".warc.gz" if self.gzip else ".warc"
        part = TaskContext.get().partitionId()
        out, staged, final = self.files.open(f"part-{part:05d}-{uuid.uuid4().hex}{suffix}")
        count = 0
        with out:
            for batch in iterator:
                for record in batch.column("record"):
                    data = record.as_buffer()
                    # One gzip member per record, so records stay addressable.
                    out.write(gzip.compress(data, mtime=0) if self.gzip else data)
                    count += 1
        return Written(staged, final, count)

    def commit(self, messages):
        self.files.commit(messages)

    def abort(self, messages):
        self.files.abort()


class WarcDataSource(DataSource):
    """``warc``: options ``path``, ``mode`` (FAILFAST, PERMISSIVE), ``payload``
    (false skips payloads), ``payloadLimit`` (bytes kept), ``compression`` (gzip, none),
    ``recordType`` and ``longerThan`` (other records are passed over, their payloads not read),
    ``maxRecords`` (of each file or range, the first ones), ``splitBytes`` (range of a file that is read on its own; small ones share a task); ``splitGzip`` and ``rangeSizes``
    are for :func:`pagesim.sources.read_archive`."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return range_schema(SCHEMA, self.options)

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)
