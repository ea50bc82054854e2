"""File access shared by the archive sources: listing, streams, staged writes."""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

STAGING = "_staging-"


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, whichever storage it names."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


_GLOB = {"*": "[^/]*", "?": "[^/]", "[": "[", "]": "]"}


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the visible files with one of ``suffixes`` that ``path`` names.

    ``path`` is a file, a folder, or either with ``*``, ``?`` or ``[...]`` in it.
    """
    filesystem, root = resolve(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    wild = re.search(r"[*?\[]", root)
    base = root[: wild.start()].rpartition("/")[0] or ("/" if root.startswith("/") else ".") if wild else root
    info = filesystem.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    like = re.compile("".join(_GLOB.get(c, re.escape(c)) for c in root) + r"(?:/.*)?\Z") if wild else None
    names = []
    for item in filesystem.get_file_info(pafs.FileSelector(base, recursive=True)):
        below = item.path[len(base):].strip("/").split("/")
        hidden = any(part.startswith(("_", ".")) for part in below)
        wanted = item.path.endswith(suffixes) and (like is None or like.match(item.path))
        if item.type == pafs.FileType.File and not hidden and wanted:
            names.append((prefix + item.path, item.size))
    dropped = dropped_files(filesystem, base) if wild is None else set()
    return sorted(n for n in names if n[0].rpartition("/")[2] not in dropped)


READ_ERRORS = (ValueError, EOFError, zlib.error)
SPLIT_BYTES = 256 << 20
HEAD = 1 << 13  # bytes in which the beginning of a record shows


@dataclass
class FilePartition(InputPartition):
    """The records of an archive file that begin in a range of its bytes."""

    path: str
    packed: bool
    start: int = 0
    stop: int | None = None


TASK_BYTES = 4 << 20  # ranges smaller than this share a task


@dataclass
class RangeTask(InputPartition):
    """Ranges of a file that one task reads, each searched on its own."""

    parts: list[FilePartition]


def range_tasks(parts: list[FilePartition]) -> list[RangeTask]:
    """Tasks for the partitions of a scan: neighbours of a file together, up to ``TASK_BYTES``.

    So small ranges don't make a task each, which would take longer to start than to run.
    """
    out, held = [], 0
    for part in parts:
        size = TASK_BYTES if part.stop is None else part.stop - part.start
        if out and out[-1].parts[-1].path == part.path and held + size <= TASK_BYTES:
            out[-1].parts.append(part)
            held += size
        else:
            out.append(RangeTask([part]))
            held = size
    return out


def file_partitions(options: dict, suffixes: tuple[str, ...]) -> list[FilePartition]:
    """What a scan reads: the files under ``path``, or exactly those of ``pathList`` (JSON).

    ``compression`` (``gzip`` or ``none``) says how files are packed; without it
    the suffix does. Plain files are cut to ranges of ``splitBytes``; gzip files
    only with ``splitGzip``, since offsets then count from where a range begins.
    ``rangeSizes`` asks for the ranges of gzip files alone.
    """
    if "pathList" in options:
        files = [(path, None) for path in json.loads(options["pathList"])]
    else:
        files = list_files(options["path"], suffixes if "compression" not in options else ("",))
    given = options.get("compression", "").lower()
    step = int(options.get("splitBytes", SPLIT_BYTES))
    sizes_only = "rangeSizes" in options
    out = []
    for path, size in files:
        packed = given == "gzip" if given else path.endswith(".gz")
        if packed and "splitGzip" not in options and not sizes_only:
            out.append(FilePartition(path, packed))
            continue
        if sizes_only and not packed:
            continue
        if size is None:
            filesystem, name = resolve(path)
            size = filesystem.get_file_info(name).size
        starts = range(0, max(size, 1), step)
        out += [FilePartition(path, packed, at, at + step) for at in starts]
    return out


class GzipMembers(io.RawIOBase):
    """Plain bytes of a gzip file from its member at or after ``start``.

    With ``mark``, from the first one there whose plain bytes it matches: one that
    begins a record, where a record may go on in the members after it. ``starts`` maps where a member's plain bytes begin to where the member begins
    in the file. A damaged member ends the stream and is told in ``broken``;
    :meth:`go_on` continues at the next member.
    """

    MAGIC = b"\x1f\x8b\x08"

    def __init__(self, raw, start: int = 0, mark: re.Pattern | None = None, ahead: int = 1 << 18):
        self._raw = raw
        self._ahead = min(ahead, 1 << 18)
        self._plain = 0
        self._member, self._data, self.broken = None, b"", None
        self.starts: dict[int, int] = {}
        self._packed = 0
        if start:
            self._search(start, mark)

    def readable(self):
        return True

    def _search(self, start: int, mark: re.Pattern | None = None) -> bool:
        """Stand at the first member that begins at ``start`` or later and opens, with what ``mark`` matches."""
        self._member, self._data, at = None, b"", start
        while True:
            self._raw.seek(at)
            chunk = self._raw.read(self._ahead)
            found = chunk.find(self.MAGIC)
            if found < 0:
                if len(chunk) < self._ahead:
                    self._packed = at + len(chunk)
                    return False
                at += len(chunk) - len(self.MAGIC) + 1
                continue
            at += found
            self._raw.seek(at)
            try:
                head = zlib.decompressobj(31).decompress(self._raw.read(HEAD), HEAD)
            except zlib.error:
                head = None
            if head is None or mark is not None and not mark.match(head):
                at += 1
                continue
            self._raw.seek(at)
            self._packed = at
            return True

    def go_on(self, after: int) -> bool:
        """Continue at the first member whose plain bytes begin after ``after``."""
        self.broken = None
        known = [(plain, packed) for plain, packed in self.starts.items() if plain > after]
        if known:
            self._plain, packed = min(known)
            self.starts = {}
            return self._search(packed)
        last = max(self.starts.values(), default=self._packed)
        return self._search(last + 1)

    def readinto(self, view):
        """Bytes of one member; of its first ones at least ``HEAD`` if it holds that many."""
        done = 0
        while True:
            if not self._data:
                self._data = self._raw.read(self._ahead)
                if not self._data:
                    if self._member is not None and not self.broken:
                        self.broken = "the file ends inside a gzip member"
                    return done
            if self._member is None:
                self._member = zlib.decompressobj(31)
                self.starts[self._plain] = self._packed
            try:
                out = self._member.decompress(self._data, len(view) - done)
            except zlib.error as e:
                self.broken, self._data = f"damaged gzip member: {e}", b""
                return done
            rest = self._member.unused_data if self._member.eof else self._member.unconsumed_tail
            self._packed += len(self._data) - len(rest)
            self._data = rest
            view[done : done + len(out)] = out
            done += len(out)
            self._plain += len(out)
            ended = self._member.eof
            if ended:
                self._member = None
            if done and (ended or done >= min(HEAD, len(view))):
                return done

    def close(self):
        self._raw.close()
        super().close()


def read_ahead(part: FilePartition) -> int:
    """Bytes that are asked of the store at once: not many more than the range holds."""
    return 1 << 20 if part.stop is None else min(max(part.stop - part.start, 1 << 16), 1 << 20)


def plain_size(part: FilePartition, mark: re.Pattern) -> int:
    """Plain bytes from the first member in a range of a gzip file that begins a
    record, as ``mark`` matches it, to the first such one behind the range."""
    filesystem, name = resolve(part.path)
    data = GzipMembers(filesystem.open_input_file(name), part.start, mark, read_ahead(part))
    view = memoryview(bytearray(1 << 20))
    try:
        while True:
            at = data._plain
            size = data.readinto(view)
            begins = data.starts.get(at)
            if size and begins is not None and begins >= part.stop and mark.match(view[:size]):
                return at
            if not size and not (data.broken and data.go_on(at)):
                return data._plain
            if len(data.starts) > 1:
                data.starts = {data._plain: data.starts[data._plain]} if data._plain in data.starts else {}
    finally:
        data.close()


class ByteReader:
    """Lines and byte runs of a plain or gzip file, with the uncompressed offset."""

    def __init__(self, path: str, packed: bool, start: int = 0, mark: re.Pattern | None = None, ahead: int = 1 << 20):
        filesystem, name = resolve(path)
        raw = filesystem.open_input_file(name)
        self.packed = packed
        self._ahead = ahead
        self._raw = GzipMembers(raw, start, mark, ahead) if packed else raw
        self.offset = 0
        if not packed and start:
            self._raw.seek(start)
            self.offset = start
        self._file = io.BufferedReader(self._raw, ahead)

    @property
    def broken(self) -> str | None:
        """Why the bytes end here, if not because the file does."""
        return self._raw.broken if self.packed else None

    def member_offset(self, offset: int) -> int | None:
        """Where the gzip member begins whose plain bytes begin at ``offset``.

        Known once bytes from there on have been read; None for a plain file.
        """
        return self._raw.starts.get(offset) if self.packed else None

    def go_on(self, after: int, mark: re.Pattern) -> bool:
        """Move to the next gzip member, or to the next line of a plain file that ``mark`` matches."""
        if self.packed:
            found = self._raw.go_on(after)
            self.offset = self._raw._plain
            self._file.detach()  # it would close the file behind it
            self._file = io.BufferedReader(self._raw, self._ahead)
            return found
        self.offset = self._file.seek(after + 1)
        self.line()  # the rest of the line in which the bad record begins
        while True:
            start = self.offset
            line = self.line()
            if not line or mark.match(line):
                self.offset = self._file.seek(start)
                return bool(line)

    def line(self, limit: int = 1 << 24) -> bytes:
        data = self._file.readline(limit)
        self.offset += len(data)
        return data

    def seek(self, offset: int):
        """Stand at ``offset`` of a plain file."""
        self.offset = self._file.seek(offset)

    def block(self) -> bytes:
        """Lines up to and with the first empty one."""
        held = self._file.peek(1)
        ends = [at + len(gap) for gap in (b"\n\r\n", b"\n\n") if (at := held.find(gap, 0, HEAD)) >= 0]
        if ends and held[:1] not in b"\r\n":
            return self.take(min(ends))
        lines = []
        while line := self.line():
            lines.append(line)
            if not line.strip(b"\r\n"):
                break
        return b"".join(lines)

    def take(self, size: int) -> bytes:
        data = self._file.read(size)
        self.offset += len(data)
        return data

    def skip(self, size: int) -> int:
        """Move on by ``size`` bytes without keeping them."""
        if not self.packed:
            end = min(self._file.seek(self.offset + size), self._raw.size())
            moved = end - self.offset
            self.offset = end
            return moved
        left = size
        while left:
            data = self._file.read(min(left, 1 << 20))
            if not data:
                break
            left -= len(data)
        self.offset += size - left
        return size - left

    def close(self):
        self._file.close()


def first_rows(rows, count: int | None):
    """Rows up to the ``count``-th record; what could not be read is not counted."""
    for row in rows:
        if count is not None and "error" not in row:
            if not count:
                return
            count -= 1
        yield row


def record_batches(rows, schema: pa.Schema, max_bytes: int = 16 << 20, max_rows: int = 1024):
    """Group row dicts into Arrow batches bounded by payload bytes and rows."""
    columns, count, size = [[] for _ in schema], 0, 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        for column, field in zip(columns, schema):
            column.append(row.get(field.name))
        count += 1
        size += len(row.get("payload") or b"")
        if size >= max_bytes or count >= max_rows:
            yield batch()
            columns, count, size = [[] for _ in schema], 0, 0
    if count:
        yield batch()


@dataclass
class Written(WriterCommitMessage):
    staged: str
    final: str
    records: int


DROPPED = "_dropped-"


def dropped_files(filesystem, root: str) -> set[str]:
    """Names of part files that an overwrite has replaced but not yet removed."""
    if filesystem.get_file_info(root).type != pafs.FileType.Directory:
        return set()
    out: set[str] = set()
    for item in filesystem.get_file_info(pafs.FileSelector(root)):
        if item.base_name.startswith(DROPPED):
            with filesystem.open_input_stream(item.path) as f:
                out |= set(json.loads(f.read()))
    return out


class StagedFiles:
    """Part files of one write job: written under final, unique names in a hidden
    folder, made visible by one move each when all tasks are done.

    An overwrite removes nothing before its own files are in place. It first
    notes the names it replaces in a ``_dropped-`` file, from when on readers
    leave them out, and then deletes them; a job that fails leaves the old files.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def open(self, name: str):
        filesystem, root = resolve(self.path)
        folder = f"{root}/{STAGING}{self.job}"
        filesystem.create_dir(folder, recursive=True)
        staged = f"{folder}/{uuid.uuid4().hex}-{name}"
        return filesystem.open_output_stream(staged, compression=None), staged, f"{root}/{name}"

    def commit(self, messages):
        filesystem, root = resolve(self.path)
        filesystem.create_dir(root, recursive=True)
        old = [i for i in filesystem.get_file_info(pafs.FileSelector(root)) if i.base_name != f"{STAGING}{self.job}"]
        with ThreadPoolExecutor(16) as pool:  # moves only wait for the store
            list(pool.map(lambda m: filesystem.move(m.staged, m.final), [m for m in messages if m is not None and m.records]))
        if self.overwrite and old:
            note = f"{root}/{DROPPED}{self.job}"
            with filesystem.open_output_stream(note, compression=None) as f:
                f.write(json.dumps([i.base_name for i in old]).encode())
            for item in old:
                if item.type == pafs.FileType.Directory:
                    filesystem.delete_dir(item.path)
                else:
                    filesystem.delete_file(item.path)
            filesystem.delete_file(note)
        self._drop_staging(filesystem, root)

    def abort(self):
        filesystem, root = resolve(self.path)
        self._drop_staging(filesystem, root)

    def _drop_staging(self, filesystem, root):
        folder = f"{root}/{STAGING}{self.job}"
        if filesystem.get_file_info(folder).type == pafs.FileType.Directory:
            filesystem.delete_dir(folder)
