"""ARC files (versions 1 and 2) as a Spark data source."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

import gzip

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
)

from .files import (
    READ_ERRORS, ByteReader, StagedFiles, Written, file_partitions, first_rows, range_tasks, read_ahead, record_batches,
)
from .warc import range_schema, range_sizes, ranged

SUFFIXES = (".arc", ".arc.gz")
# Fixed values ---------------------------------------------------------------
DATE_FORMAT = "%Y%m%d%H%M%S"
FIELDS = {
    1: "url ip_address date content_type length".split(),
    2: (
        "url ip_address date content_type result_code checksum location offset "
        "filename length"
    ).split(),
}
FILE_PAYLOAD = {
    1: "1 0 {org}\nURL IP-address Archive-date Content-type Archive-length",
    2: (
        "2 0 {org}\nURL IP-address Archive-date Content-type Result-code Checksum "
        "Location Offset Filename Archive-length"
    ),
}
DEFAULT_ORG = "Unknown"
DEFAULT_IP = "127.0.0.1"
# ----------------------------------------------------------------------------

SCHEMA = (
    "file string, file_offset bigint, version int, "
    "file_headers struct<ip_address: string, date: timestamp, org: string>, "
    "file_meta string, url string, ip_address string, date timestamp, "
    "content_type string, result_code string, checksum string, location string, "
    "offset bigint, filename string, length bigint, payload binary, error string"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("file_offset", pa.int64()),
        ("version", pa.int32()),
        (
            "file_headers",
            pa.struct(
                [
                    ("ip_address", pa.string()),
                    ("date", pa.timestamp("us", tz="UTC")),
                    ("org", pa.string()),
                ]
            ),
        ),
        ("file_meta", pa.string()),
        ("url", pa.string()),
        ("ip_address", pa.string()),
        ("date", pa.timestamp("us", tz="UTC")),
        ("content_type", pa.string()),
        ("result_code", pa.string()),
        ("checksum", pa.string()),
        ("location", pa.string()),
        ("offset", pa.int64()),
        ("filename", pa.string()),
        ("length", pa.int64()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


def _date(text: str) -> datetime:
    return datetime.strptime(text, DATE_FORMAT).replace(tzinfo=timezone.utc)


#: A line that can only be a record's: address, date and, last, a length.
RECORD_LINE = re.compile(rb"\S+ \S+ \d{14} .*\d\r?\n\Z")
#: The same at the start of a gzip member.
MEMBER_START = re.compile(rb"\S+ \S+ \d{14} [^\n]*\d\r?\n")


def _text(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it is none: old crawlers wrote addresses as they came."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def record_fields(line: bytes, version: int) -> dict[str, str]:
    values = _text(line).split()
    names = FIELDS[version]
    # counted from both ends, so that blanks inside an address stay in it
    if len(values) < len(names):
        raise ValueError(f"a record line of version {version} has {len(names)} fields: {line[:80]!r}")
    cut = len(values) - len(names) + 1
    return dict(zip(names, [" ".join(values[:cut]), *values[cut:]]))


class ArcReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.failfast = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.payload_limit = int(options.get("payloadLimit", -1))
        self.longer_than = int(options.get("longerThan", -1))
        self.most = int(options["maxRecords"]) if "maxRecords" in options else None
        wanted = options.get("version")
        self.version = int(wanted) if wanted else None
        if self.version not in (None, 1, 2):
            raise ValueError("ARC version has to be 1 or 2")

    def partitions(self):
        return range_tasks(file_partitions(self.options, SUFFIXES))

    def _about(self, data: ByteReader) -> dict:
        """What the first record says of the file: version, headers and free text.

        Its payload is taken by its length and on to the end of the line, as
        some writers count it short.
        """
        line = data.line()
        if not line.startswith(b"filedesc:"):
            raise ValueError(f"the file does not begin with a filedesc record: {line[:80]!r}")
        length = line.split()[-1]
        text = data.take(int(length))
        text += b"" if text.endswith(b"\n") else data.line()
        about, _, rest = _text(text).partition("\n")
        number, _, org = about.partition(" ")
        org = org.partition(" ")[2].strip()
        if number not in ("1", "2"):
            raise ValueError(f"no ARC version: {about[:80]!r}")
        version = int(number)
        if self.version not in (None, version):
            raise ValueError(f"version {self.version} was requested, the file has {version}")
        head = record_fields(line, version)
        return {
            "version": version,
            "file_headers": {"ip_address": head["ip_address"], "date": _date(head["date"]), "org": org or None},
            "file_meta": rest.partition("\n")[2],
        }

    @staticmethod
    def _next_line(data: ByteReader) -> tuple[int, bytes]:
        """(offset, line) of the next record, past empty lines and metadata elements."""
        inside = False
        while True:
            start = data.offset
            line = data.line()
            inside |= line.startswith(b"<arcmetadata")
            if not line or not inside and line.strip():
                return start, line
            if line.rstrip().endswith(b"</arcmetadata>"):
                inside = False

    def _record(self, data: ByteReader, line: bytes, version: int) -> dict | None:
        row = record_fields(line, version)
        length = int(row["length"])
        wanted = length > self.longer_than
        keep = length if self.payload_limit < 0 else min(length, self.payload_limit)
        payload = data.take(keep) if wanted and self.with_payload else None
        got = len(payload or b"")
        got += data.skip(length - got)
        if got != length:
            raise ValueError(f"the payload has {got} of {length} bytes")
        return row | {
            "date": _date(row["date"]),
            "offset": int(row["offset"]) if row.get("offset", "").isdecimal() else None,
            "length": length,
            "payload": payload,
        } if wanted else None

    def _find(self, data: ByteReader, start: int, version: int) -> bool:
        """Stand at the first record of a plain file at or after ``start``.

        A line in a payload may look like a record's; it is none unless its length
        leads to another record's line or to the end of the file.
        """
        after = start - 2
        while data.go_on(after, RECORD_LINE):
            after = data.offset
            try:
                length = int(record_fields(data.line(), version)["length"])
                ended = data.skip(length) == length
                line = self._next_line(data)[1]
            except ValueError:
                ended = False
            if ended and (not line or RECORD_LINE.match(line)):
                break
        else:
            return False
        data.seek(after)
        return True

    def _file_record(self, part) -> dict:
        """What the first record of the file says, for a range that begins after it."""
        data = ByteReader(part.path, part.packed, ahead=read_ahead(part))
        try:
            return self._about(data)
        finally:
            data.close()

    def _rows(self, part, said: dict):
        """Rows of a range; ``said`` keeps what the first record says of the file, for the ranges after this one."""
        start, about = 0, None
        here = {"file": part.path, "range": part.start if part.packed else None}
        if part.start:
            try:
                if "about" not in said:
                    said["about"] = self._file_record(part)
                about = said["about"]
            except READ_ERRORS:
                return  # told by the range that begins the file
        data = ByteReader(part.path, part.packed, part.start, MEMBER_START, read_ahead(part))
        try:
            if part.start and not part.packed and not self._find(data, part.start, about["version"]):
                return
            while True:
                try:
                    if about is None:
                        about = self._about(data)
                    start, line = self._next_line(data)
                    begins = data.member_offset(start) if part.packed else start
                    if part.stop is not None and begins is not None and begins >= part.stop:
                        return
                    if data.broken:
                        raise ValueError(data.broken)
                    if not line:
                        return
                    row = self._record(data, line, about["version"])
                except READ_ERRORS as e:
                    reason = data.broken or str(e)
                    if self.failfast:
                        raise ValueError(f"{part.path} at {start}: {reason}") from e
                    yield here | {"file_offset": start, "error": reason}
                    if about is None or not data.go_on(start, RECORD_LINE):
                        return
                    continue
                if row is not None:
                    yield row | about | here | {"file_offset": start}
        finally:
            data.close()

    def read(self, partition):
        if partition is None:  # there is nothing to read
            return
        if "rangeSizes" in self.options:
            yield range_sizes(partition.parts, MEMBER_START)
        else:
            said: dict = {}
            rows = (row for part in partition.parts for row in first_rows(self._rows(part, said), self.most))
            yield from record_batches(rows, ranged(_ARROW, self.options))


class ArcWriter(DataSourceArrowWriter):
    """Writes the ``record`` column after each file's filedesc record."""

    def __init__(self, options, overwrite):
        self.files = StagedFiles(options["path"], overwrite)
        self.version = int(options.get("version", 2))
        if self.version not in (1, 2):
            raise ValueError("ARC version has to be 1 or 2")
        self.gzip = options.get("compression", "none").lower() == "gzip"
        self.org = options.get("org", DEFAULT_ORG)
        self.ip_address = options.get("ip_address", DEFAULT_IP)
        self.date = options.get("date") or datetime.now(timezone.utc).strftime(DATE_FORMAT)
        _date(self.date)

    def file_record(self, name: str) -> bytes:
        payload = FILE_PAYLOAD[self.version].format(org=self.org).encode()
        middle = f"200 - - 0 {name} " if self.version == 2 else ""
        line = f"filedesc://{name} {self.ip_address} {self.date} text/plain {middle}{len(payload)}"
        return line.encode() + b"\n" + payload + b"\n\n"

    def write(self, iterator):
        part = TaskContext.get().partitionId()
        suffix = ".arc.gz" if self.gzip else ".arc"
        name = f"part-{part:05d}-{uuid.uuid4().hex}{suffix}"
        out, staged, final = self.files.open(name)
        pack = (lambda b: gzip.compress(b, mtime=0)) if self.gzip else (lambda b: b)
        count = 0
        with out:
            out.write(pack(self.file_record(name)))
            for batch in iterator:
                for record in batch.column("record"):
                    out.write(pack(record.as_buffer()))
                    count += 1
        return Written(staged, final, count)

    def commit(self, messages):
        self.files.commit(messages)

    def abort(self, messages):
        self.files.abort()


class ArcDataSource(DataSource):
    """``arc``: read options ``path``, ``version``, ``mode``, ``payload``, ``payloadLimit``,
    ``compression``, ``longerThan``, ``maxRecords``, ``splitBytes``; write options
    ``version``, ``org``, ``ip_address``, ``date`` (yyyyMMddHHmmss), ``compression``."""

    @classmethod
    def name(cls):
        return "arc"

    def schema(self):
        return range_schema(SCHEMA, self.options)

    def reader(self, schema):
        return ArcReader(self.options)

    def writer(self, schema, overwrite):
        return ArcWriter(self.options, overwrite)
