"""Building, saving and opening an index; ingest from archives or page tables.

A version of an index is a folder per table; in it, each append has a folder of
its own, cut into shards by a hash of the key that the table is looked up by. A
lookup joins on the shard too, so that Spark prunes the shards it does not need.
An append counts once its name is listed under ``live``, after its tables are
whole. Appends of one run are merged as they become many; a merged folder covers
those whose numbers it spans.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import sketch as fn
from ..functions.vocabulary import REFERENCE, Vocabulary
from ..operators import records
from ..operators.lsh import SHARD, Index, shard_of
from ..operators.sketches import band_index, members_table, sketches_table
from ..session import mark, materialize, names_in, remove
from ..sources import archive_formats, read_archive
from .stage import chain
from .stages import feature_stages

BATCH = "batch"  # each append writes folders of its own, named by its run and batch
TABLES = ("members", "sketches", "bands")
COUNTS = "counts"  # what went into each append, of a run that counts
LIVE = "live"
SHARDS = 16  # of each table; a large index takes as many as make a shard some GB
FAN = 4  # appends of one size that are merged
SETTINGS = "settings"  # one row per version: what its cells and keys mean
MEMBERS = "url string, sketch_id string, grams array<string>, vec map<int,bigint>, errors array<string>"
SKETCHES = "sketch_id string, grams array<string>, sig array<bigint>"
BANDS = "band int, band_hash bigint, sketch_id string"
COUNTED = "run string, number bigint, processed bigint, failed bigint, inserted bigint"


def ingest_counters(df: DataFrame, observation: Observation, maximum: int | None = None) -> DataFrame:
    """Count what passes through, without a job of its own.

    After an action on the result ``observation.get`` holds ``processed``,
    ``failed`` and ``maximum``. Rows that go into the index are counted by
    :func:`insert_counter`, after URLs were made unique.
    """
    errors = F.size("errors") > 0 if "errors" in df.columns else F.lit(False)
    return df.observe(
        observation,
        F.count(F.lit(1)).alias("processed"),
        F.count_if(errors).alias("failed"),
        F.lit(maximum if maximum is not None else -1).alias("maximum"),
    )


def insert_counter(members: DataFrame, observation: Observation) -> DataFrame:
    """Count the members that are stored; ``observation.get`` holds ``inserted``."""
    return members.observe(observation, F.count(F.lit(1)).alias("inserted"))


def archive_pages(spark: SparkSession, path: str | list[str], format: str = "auto",
                  min_length: int = records.MIN_LENGTH, max_records: int | None = None, **options) -> DataFrame:
    """Pages of archive files: filtered, split, stripped, first ``max_records`` if set.

    ``path`` is a file, a folder, a pattern or a list of files. With ``auto`` it may hold
    both WARC and ARC files. ``options`` are those of the scan.
    """
    kinds = archive_formats(path) if format in ("auto", None) else {format: path}
    found = []
    for kind, files in kinds.items():
        wanted = {"recordType": "response"} if kind == "warc" else {}
        rows = read_archive(spark, files, kind, longerThan=str(min_length), **wanted, **options)
        found.append(records.extract_html(rows if kind == "warc" else records.arc_responses(rows), min_length))
    pages = reduce(DataFrame.unionByName, found)
    return pages if max_records is None else records.limit_records(pages, max_records)


def page_table(features: DataFrame, order: tuple[str, ...] = ("url",)) -> DataFrame:
    """Features with one row per URL, the first in ``order``.

    Runs on the features, which are far smaller than the pages behind them.
    """
    first = F.min_by(
        F.struct("grams", "vec", "errors"), F.struct(*order, "grams", "errors")
    ).alias("_f")
    return features.groupBy("url").agg(first).select("url", "_f.*")


@dataclass(frozen=True)
class Settings:
    """What must be the same for all rows of an index: appending other rows fails."""

    bands: int = fn.BANDS
    rows: int = fn.ROWS
    vocabulary: str | None = None
    num_perm: int = fn.NUM_PERM
    seed: int = fn.SEED
    shards: int = SHARDS


_SETTINGS = (
    "version string, number bigint, bands int, rows int, vocabulary string, num_perm int, seed int, shards int"
)


def vocabulary_key(vocab: Vocabulary) -> str:
    """Names a vocabulary by its tags, exclusions and numbering."""
    text = "\n".join([str(vocab.first_id), *vocab.tags, "", *sorted(vocab.excluded)])
    return hashlib.md5(text.encode()).hexdigest()


def build_index(pages: DataFrame, path: str, vocab: Vocabulary = REFERENCE,
                bands: int = fn.BANDS, rows: int = fn.ROWS,
                order: tuple[str, ...] | None = None,
                observation: Observation | None = None,
                inserted: Observation | None = None, shards: int = SHARDS) -> Index:
    """Pages (``url, html``, extracted or a plain table) to a stored index.

    Of several pages with one URL the first in ``order`` counts: file and
    offset when the pages come from archives. An index that is already at
    ``path`` is replaced, streamed batches included: the tables go to a new
    version, which readers see once it is whole.

    Pages are read and parsed once: the members are written to the work folder, and
    the distinct sketches and their bands come from reading them back.
    """
    spark = pages.sparkSession
    version = uuid.uuid4().hex
    if "transformations" not in pages.columns:
        pages = records.pages_as_records(pages)
    features = chain(pages, *feature_stages(vocab))
    if observation is not None:
        features = ingest_counters(features, observation)
    if order is None:
        order = tuple(c for c in ("file", "offset") if c in pages.columns) or ("url",)
    members = members_table(page_table(features, order)).select(
        "url", "sketch_id", "grams", "vec", "errors"
    )
    if inserted is not None:
        members = insert_counter(members, inserted)
    folder = f"{path}/{version}"
    members = materialize(members, "build-members")
    sketches = materialize(sketches_table(members), "build-sketches")
    tables = {"bands": band_index(sketches, bands, rows), "sketches": sketches, "members": members}
    write_batch(spark, folder, "built", shards, tables)
    publish(spark, path, version, Settings(bands, rows, vocabulary_key(vocab), shards=shards))
    return open_index(spark, path)


def save_index(index: Index, path: str, mode: str = "overwrite", shards: int = SHARDS):
    """Store index tables as a new version; ``append`` adds what is not stored yet.

    An append that fails leaves nothing that is read; it can be made again.
    """
    spark = index.bands.sparkSession
    if mode == "overwrite":
        version = uuid.uuid4().hex
        write_batch(spark, f"{path}/{version}", "built", shards, {name: getattr(index, name) for name in TABLES})
        publish(spark, path, version, Settings(index.n_bands, index.n_rows, index.vocabulary, shards=shards))
        return
    folder, settings = version_folder(spark, path, Settings(index.n_bands, index.n_rows, index.vocabulary))
    members = materialize(index.members, "append-members")
    sketches = materialize(index.sketches, "append-sketches")
    new = materialize(not_stored(sketches, stored(spark, folder, "sketches"), "sketch_id"), "append-new")
    tables = {
        "bands": index.bands.join(new.select("sketch_id"), "sketch_id", "left_semi"),
        "sketches": new,
        "members": not_stored(members, stored(spark, folder, "members"), "url"),
    }
    write_batch(spark, folder, uuid.uuid4().hex, settings.shards, tables)


def read_settings(spark: SparkSession, path: str) -> tuple[str, Settings] | None:
    """Version and settings of the index at ``path``, None where there is no index."""
    try:
        stored = spark.read.schema(_SETTINGS).parquet(f"{path}/{SETTINGS}")
        row = stored.orderBy(F.desc("number"), "version").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else (row.version, Settings(*row[2:]))


def publish(spark: SparkSession, path: str, version: str, settings: Settings):
    """Make ``version`` the one that readers open; older versions stay on disk until removed."""
    known = read_settings(spark, path)
    number = 0
    if known:
        number = spark.read.schema(_SETTINGS).parquet(f"{path}/{SETTINGS}").agg(F.max("number")).first()[0] + 1
    row = spark.createDataFrame([(version, number, *astuple(settings))], _SETTINGS).coalesce(1)
    row.write.mode("append").parquet(f"{path}/{SETTINGS}")


def version_folder(spark: SparkSession, path: str, settings: Settings) -> tuple[str, Settings]:
    """The folder to append to and its settings; a new index gets its first version.

    Rows of another vocabulary, banding, number of permutations or seed can't be
    compared with what is stored, so they are refused. The number of shards is
    that of the stored index.
    """
    known = read_settings(spark, path)
    if known is None:
        version = uuid.uuid4().hex
        publish(spark, path, version, settings)
        return f"{path}/{version}", settings
    version, stored = known
    if stored != replace(settings, shards=stored.shards):
        raise ValueError(f"the index at {path} has {stored}, not {settings}")
    return f"{path}/{version}", stored


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index, as it was built plus every batch appended to it."""
    known = read_settings(spark, path)
    if known is None:
        raise FileNotFoundError(f"no index at {path}")
    return open_version(spark, f"{path}/{known[0]}", known[1])


def open_version(spark: SparkSession, folder: str, settings: Settings) -> Index:
    live = live_batches(spark, folder)
    tables = {name: read_batches(spark, folder, name, live) for name in TABLES}
    members = tables["members"].select("url", "sketch_id", "vec", SHARD)
    return Index(
        members, tables["sketches"], tables["bands"], settings.bands, settings.rows, settings.vocabulary,
        settings.shards,
    )


_SCHEMAS = {"members": MEMBERS, "sketches": SKETCHES, "bands": BANDS, COUNTS: COUNTED}
_KEYS = {"members": "sketch_id", "sketches": "sketch_id", "bands": "band_hash", COUNTS: "run"}


def _span(name: str) -> tuple[str, int, int] | None:
    """Run, first and last number of an append's name; None for one without numbers."""
    found = re.fullmatch(r"(.+?)-(\d+)(?:-(\d+))?", name)
    return found and (found[1], int(found[2]), int(found[3] or found[2]))


def _covered(names: list[str]) -> set[str]:
    """Names whose numbers lie within those of another append of their run."""
    spans = {name: _span(name) for name in names}
    out = set()
    for name, own in spans.items():
        for other in spans.values():
            if own and other and own != other and own[0] == other[0] and other[1] <= own[1] and own[2] <= other[2]:
                out.add(name)
    return out


def live_batches(spark: SparkSession, folder: str) -> list[str]:
    """The appends whose rows are the index: those listed and not covered by a merged one."""
    names = names_in(spark, f"{folder}/{LIVE}")
    hidden = _covered(names)
    return [name for name in names if name not in hidden]


def stored(spark: SparkSession, folder: str, table: str, but: str | None = None) -> DataFrame:
    """Rows of an index table, but for those of one append; none where nothing is stored."""
    live = [name for name in live_batches(spark, folder) if name != but]
    return read_batches(spark, folder, table, live)


def read_batches(spark: SparkSession, folder: str, table: str, names: list[str]) -> DataFrame:
    schema = f"{_SCHEMAS[table]}, {BATCH} string, {SHARD} int"
    if not names:
        return spark.createDataFrame([], schema).drop(BATCH)
    reader = spark.read.schema(schema).option("basePath", f"{folder}/{table}")
    return reader.parquet(*[f"{folder}/{table}/{BATCH}={name}" for name in names]).drop(BATCH)


def ingest_counts(spark: SparkSession, path: str) -> DataFrame:
    """``run, number, processed, failed, inserted`` of each batch that streams added to the index."""
    known = read_settings(spark, path)
    if known is None:
        raise FileNotFoundError(f"no index at {path}")
    folder = f"{path}/{known[0]}"
    counted = set(names_in(spark, f"{folder}/{COUNTS}"))
    names = [name for name in live_batches(spark, folder) if f"{BATCH}={name}" in counted]
    return read_batches(spark, folder, COUNTS, names).drop(SHARD)


def not_stored(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh``, a table just written, whose key is not stored yet.

    The stored keys are cut to the batch's before the anti join. ``fresh`` has a
    known size, so a small batch is broadcast to the scan of the stored keys and
    these are not shuffled; a large one is joined by shuffle.
    """
    hits = stored.select(key).join(fresh.select(key).distinct(), key, "left_semi")
    return fresh.join(hits, key, "left_anti")


def write_batch(spark: SparkSession, folder: str, name: str, shards: int, tables: dict[str, DataFrame]):
    """Write the tables of an append, then list it. The same name again replaces it."""
    remove(spark, f"{folder}/{LIVE}/{name}")
    with ThreadPoolExecutor(len(tables)) as pool:  # a small append is some small jobs
        list(pool.map(lambda table: write_table(tables[table], folder, table, name, shards), tables))
    mark(spark, f"{folder}/{LIVE}/{name}")


def write_table(df: DataFrame, folder: str, table: str, name: str, shards: int):
    """One folder per shard, rows in the order of the table's key.

    The rebalancing puts a shard into as many tasks as its size asks for, so
    that a hot key spans files and small shards share a task.
    """
    key = _KEYS[table]
    rows = df.withColumn(SHARD, shard_of(F.col(key), shards)).hint("rebalance", SHARD)
    columns = [f.split()[0] for f in _SCHEMAS[table].split(", ")]
    rows = rows.select(*[c for c in columns if c in rows.columns], SHARD).sortWithinPartitions(SHARD, key)
    rows.write.mode("overwrite").partitionBy(SHARD).parquet(f"{folder}/{table}/{BATCH}={name}")


def merge_batches(spark: SparkSession, folder: str, run: str, before: int, shards: int, fan: int = FAN):
    """Merge the appends of a run that are numbered below ``before``, ``fan`` of one size at a time.

    Of ``n`` appends at most ``fan - 1`` of each of ``log(n)`` sizes stay, and each
    row is written again once per size. A run merges only its own appends, so
    writers of one index need not know of each other. A merged folder hides what
    it covers as soon as it is listed, and a failure before that changes nothing.
    What was covered already when this is called is removed: a reader has the time
    between two merges to finish.
    """
    for name in _covered(names_in(spark, f"{folder}/{LIVE}")):
        if _span(name)[0] == run:
            remove(spark, f"{folder}/{LIVE}/{name}")
            for table in (*TABLES, COUNTS):
                remove(spark, f"{folder}/{table}/{BATCH}={name}")

    def size(span: tuple) -> int:
        left, level = span[2] - span[1] + 1, 0
        while left >= fan:
            left, level = left // fan, level + 1
        return level

    while True:
        spans = {name: _span(name) for name in live_batches(spark, folder)}
        own = sorted((s, name) for name, s in spans.items() if s and s[0] == run and s[2] < before)[-fan:]
        if len(own) < fan or len({size(span) for span, _ in own}) > 1:
            return
        names = [name for _, name in own]
        merged = f"{run}-{own[0][0][1]}-{own[-1][0][2]}"
        tables = {t: read_batches(spark, folder, t, names) for t in TABLES}
        counted = set(names_in(spark, f"{folder}/{COUNTS}"))  # an append need not count
        if counted := [name for name in names if f"{BATCH}={name}" in counted]:
            tables[COUNTS] = read_batches(spark, folder, COUNTS, counted)
        write_batch(spark, folder, merged, shards, tables)
