"""Archive sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .arc import SUFFIXES as ARC_SUFFIXES, ArcDataSource
from .files import list_files
from .warc import SCHEMA as WARC_SCHEMA, SUFFIXES as WARC_SUFFIXES, WarcDataSource, WarcReader


def register(spark: SparkSession) -> SparkSession:
    """Make the ``warc`` and ``arc`` formats known to the session."""
    spark.dataSource.register(WarcDataSource)
    spark.dataSource.register(ArcDataSource)
    return spark


def detect_format(path: str) -> str:
    """``warc`` or ``arc`` by file suffix, else ``unknown``."""
    if path.endswith(WARC_SUFFIXES):
        return "warc"
    return "arc" if path.endswith(ARC_SUFFIXES) else "unknown"


def archive_formats(path: str | list[str]) -> dict[str, str | list[str]]:
    """What to read by format: ``path`` itself where it names archives of one, else lists of files."""
    files = [path] if isinstance(path, str) else list(path)
    kinds = {f: detect_format(f) for f in files}
    if set(kinds.values()) == {"unknown"}:
        try:
            found = [name for f in files for name, _ in list_files(f, WARC_SUFFIXES + ARC_SUFFIXES)]
        except FileNotFoundError as e:
            raise ValueError(f"no archive at {path}") from e
        kinds = {name: detect_format(name) for name in found}
        if not kinds:
            raise ValueError(f"no archive at {path}")
    if len(set(kinds.values())) == 1:
        return {next(iter(kinds.values())): path}
    return {kind: [f for f, k in kinds.items() if k == kind] for kind in sorted(set(kinds.values()))}


def read_archive(spark: SparkSession, path: str | list[str], format: str = "auto",
                 **options) -> DataFrame:
    """Records of an archive file, a list of files, or the archives of a folder or pattern.

    ``auto`` goes by the files' suffixes; what it finds must be of one format.
    ``splitBytes`` cuts files to ranges for tasks of their own. Plain files are cut
    anyway, to a larger size; gzip files only with that option, as each of their
    ranges is unpacked twice: once for its size, by which offsets are made to count from
    the beginning of the file.
    """
    kinds = set(archive_formats(path)) if format in ("auto", None) else {format}
    if len(kinds) != 1 or not kinds <= {"warc", "arc"}:
        raise ValueError(f"Don't know how to open {sorted(kinds)} files: {path}")
    files = [path] if isinstance(path, str) else list(path)
    kind = kinds.pop()

    def scan(**more) -> DataFrame:
        reader = register(spark).read.format(kind).options(**options, **more)
        return reader.load(path) if isinstance(path, str) else reader.option("pathList", json.dumps(files)).load()

    return _with_file_offsets(scan, _OFFSETS[kind]) if "splitBytes" in options else scan()


_OFFSETS = {"warc": "offset", "arc": "file_offset"}


def _with_file_offsets(scan: Callable[..., DataFrame], offset: str) -> DataFrame:
    """A scan of ranges, offsets counted from the beginning of each file.

    A range of a gzip file begins where the plain bytes of those before it end.
    """
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = scan(rangeSizes="true").select("file", "range", F.sum("size").over(before).alias("begins"))
    begins = materialize(begins, "range-starts")  # of a known size for the join
    rows = scan(splitGzip="true")
    whole = F.col(offset) + F.coalesce("begins", F.lit(0))
    return rows.join(begins, ["file", "range"], "left").select(
        *[whole.alias(c) if c == offset else F.col(c) for c in rows.columns if c != "range"]
    )


def warc_index(spark: SparkSession, path: str, payload_bytes: int = 1 << 20, **options) -> DataFrame:
    """Where each record lies: file, offset, size, its columns and the payload's first MiB.

    Offsets count uncompressed bytes.
    """
    return read_archive(spark, path, "warc", payloadLimit=str(payload_bytes), **options)


NEAR = 64 << 20  # bytes of a file whose records are looked up by one task


def warc_records(places: DataFrame, **options) -> DataFrame:
    """The whole records at ``places``: ``file, offset, member_offset`` of a WARC scan.

    Only the places are shuffled, those near each other in a file to one task; it
    reads the records from where they begin and nothing between them. Other
    columns of ``places`` are kept.
    """
    names = ("file", "offset", "member_offset")
    kept = [f for f in places.schema.fields if f.name not in names]
    start = F.coalesce("member_offset", "offset")
    near = places.repartition("file", F.floor(start / NEAR)).sortWithinPartitions("file", start)
    schema = ", ".join([WARC_SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    return near.select(*names, *(f.name for f in kept)).mapInArrow(WarcReader(options).at, schema)


def write_warc(df: DataFrame, path: str, mode: str = "append", compression: str = "none"):
    """Write records (``headers`` map, ``payload``) as WARC files, one per task."""
    from ..functions.headers import warc_record_bytes

    register(df.sparkSession)
    records = df.select(warc_record_bytes(F.col("headers"), F.col("payload")).alias("record"))
    records.write.format("warc").option("compression", compression).mode(mode).save(path)


def write_arc(df: DataFrame, path: str, version: int = 2, mode: str = "append", **options):
    """Write ARC records; columns are the fields of the version, and ``payload``.

    ``length`` is taken from the payload when the column is absent.
    """
    from ..functions.headers import arc_header_line, arc_record_bytes

    register(df.sparkSession)
    fields = {name: F.col(name) for name in df.columns if name != "payload"}
    fields.setdefault("length", F.octet_length("payload"))
    record = arc_record_bytes(arc_header_line(fields, version), F.col("payload"))
    writer = df.select(record.alias("record")).write.format("arc")
    writer.option("version", str(version)).options(**options).mode(mode).save(path)
