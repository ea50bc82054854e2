"""Incremental indexing and lookup with Structured Streaming.

The index on disk is the state: every micro-batch is an append of its own, named
by the run and the batch. The run is noted beside the stream's checkpoint, so a
batch that is replayed after a failure replaces what it wrote before, and two
streams into one index never touch each other's batches. Before a batch is
added, those before it are merged where there are many of one size; they are
done, and are not replayed any more.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import sketch as fn
from ..functions.vocabulary import REFERENCE, Vocabulary
from ..operators import records
from ..operators.lsh import SELF_MARK, Index, expand_pairs, look_up, self_rows, similar_classes
from ..operators.sketches import band_index, members_table, sketches_table
from ..plans import index as store
from ..plans.stage import chain
from ..plans.stages import feature_stages
from ..session import materialize

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint folder belongs to; made when first asked for."""
    path = f"{checkpoint}/index-run"
    try:
        return spark.read.schema("run string").parquet(path).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    run = uuid.uuid4().hex
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.parquet(path)
    return run


def batch_features(pages: DataFrame, vocab: Vocabulary, seen: Observation | None = None) -> DataFrame:
    """Features of a batch, one row per URL, written once; ``seen`` counts the pages."""
    if "transformations" not in pages.columns:
        pages = records.pages_as_records(pages)
    order = tuple(c for c in ("file", "offset") if c in pages.columns) or ("url",)
    features = chain(pages, *feature_stages(vocab))
    if seen is not None:
        features = store.ingest_counters(features, seen)
    return materialize(members_table(store.page_table(features, order)), "batch")


def add_features(fresh: DataFrame, batch: int, run: str, folder: str, settings: store.Settings,
                 fan: int = store.FAN, seen: Observation | None = None) -> DataFrame:
    """Add a batch's features to an index version; returns the members it added.

    With ``seen``, the counters of the pages behind the features, what went in is
    counted too and kept with the batch: a batch that is replayed counts once.
    """
    spark, name = fresh.sparkSession, f"{run}-{batch}"
    store.merge_batches(spark, folder, run, batch, settings.shards, fan)
    added, counted = store.not_stored(fresh, store.stored(spark, folder, "members", name), "url"), Observation()
    added = materialize(store.insert_counter(added, counted), "batch-members")
    known = store.stored(spark, folder, "sketches", name)
    new = store.not_stored(added.select("sketch_id", "grams"), known, "sketch_id")
    sketches = materialize(sketches_table(new), "batch-sketches")
    tables = {"bands": band_index(sketches, settings.bands, settings.rows), "sketches": sketches, "members": added}
    if seen is not None:
        counts = (run, batch, seen.get["processed"], seen.get["failed"], counted.get["inserted"])
        tables[store.COUNTS] = spark.createDataFrame([counts], store.COUNTED)
    store.write_batch(spark, folder, name, settings.shards, tables)
    return added


def index_batch(pages: DataFrame, batch: int, path: str, vocab: Vocabulary = REFERENCE,
                bands: int = fn.BANDS, rows: int = fn.ROWS, run: str = "direct",
                fan: int = store.FAN) -> DataFrame:
    """Add one batch of pages to the index at ``path``; returns the members it added.

    A URL that is stored already is not indexed again, and a sketch that is
    stored is not banded again. The same run and batch again replace what they
    wrote.
    """
    settings = store.Settings(bands, rows, store.vocabulary_key(vocab))
    folder, settings = store.version_folder(pages.sparkSession, path, settings)
    seen = Observation()
    return add_features(batch_features(pages, vocab, seen), batch, run, folder, settings, fan, seen)


def stream_index(pages: DataFrame, path: str, checkpoint: str, vocab: Vocabulary = REFERENCE,
                 bands: int = fn.BANDS, rows: int = fn.ROWS, fan: int = store.FAN) -> StreamingQuery:
    """Index a stream of ``url, html`` as it arrives; one index batch per micro-batch.

    Runs through what is available and stops; start it again to go on from
    its checkpoint. ``fan`` appends of one size are merged to one.
    """
    run = run_of(pages.sparkSession, checkpoint)

    def step(batch_df: DataFrame, batch: int):
        index_batch(batch_df, batch, path, vocab, bands, rows, run, fan)

    return (
        pages.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_archives(spark: SparkSession, folder: str, path: str, checkpoint: str,
                    min_length: int = records.MIN_LENGTH, files_per_batch: int = 100,
                    vocab: Vocabulary = REFERENCE, bands: int = fn.BANDS,
                    rows: int = fn.ROWS) -> StreamingQuery:
    """Index WARC and ARC files as they land in a folder, ``files_per_batch`` at a time.

    Spark's file stream keeps the log of files it has handed out; only their
    names pass through it, and the archive scan reads the records in parallel.
    """
    names = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.{warc,warc.gz,arc,arc.gz}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder).select("path")
    )

    run = run_of(spark, checkpoint)

    def step(batch_df: DataFrame, batch: int):
        files = [r.path for r in batch_df.collect()]  # at most files_per_batch names
        index_batch(store.archive_pages(spark, files, "auto", min_length), batch, path, vocab, bands, rows, run)

    return (
        names.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def page_answers(fresh: DataFrame, added: DataFrame, earlier: DataFrame, index: Index,
                 min_jaccard: float | None = None) -> DataFrame:
    """Per page of a batch all pages before it that share a band, scored, and itself as ``url*``.

    Rows as :func:`~pagesim.operators.lsh.similar_pages` gives them. ``earlier`` are the members of the batches
    before, ``added`` those of this one, of which the URL has to sort before the page's own.
    """
    queries, found = similar_classes(fresh, index, min_jaccard)
    found = materialize(found, "found-sketches")
    keys = materialize(found.select("sketch_id").distinct(), "found-keys")
    stored = look_up(keys, earlier, ["sketch_id"], "sketch_id", index.shards)
    columns = ["url", "sketch_id", "vec"]
    members = stored.select(*columns, F.lit(False).alias("own")).unionByName(
        keys.join(added, "sketch_id").select(*columns, F.lit(True).alias("own"))
    )
    before = (F.col("url") != F.col("query_url")) & (~F.col("own") | (F.col("url") < F.col("query_url")))
    pages = queries.members.select(*columns)
    met = expand_pairs(found, pages, materialize(members, "found-members"), before, ["own"])
    named = pages.filter("url is not null")
    return met.unionByName(self_rows(
        named.select(F.col("url").alias("query_url"), fn.square_sum(F.col("vec")).alias("_qn")), True
    ))


def class_answers(fresh: DataFrame, added: DataFrame, earlier: DataFrame, index: Index,
                  min_jaccard: float | None = None) -> DataFrame:
    """Per page of a batch the sketches of the pages before it, scored, and its own under ``*``.

    ``query_url, query_sketch, sketch_id, jaccard_est, jaccard_exact``: one row per page and
    sketch, however many pages carry it. ``earlier`` are the members of the batches before,
    ``added`` those of this one. A sketch is answered if another page that carries it is
    among the earlier ones, or is one of the batch whose URL sorts before the page's own.
    """
    queries, found = similar_classes(fresh, index, min_jaccard)
    found = materialize(found, "found-sketches")
    keys = materialize(found.select("sketch_id").distinct(), "found-keys")
    stored = look_up(keys, earlier, ["sketch_id"], "sketch_id", index.shards)
    stored = stored.groupBy("sketch_id").agg(F.min("url").alias("_low"), F.max("url").alias("_high"))
    own = added.groupBy("sketch_id").agg(F.min("url").alias("_first"))
    # written: pages of a hot sketch can be split only in a join of two scans
    carried = materialize(
        found.join(stored, "sketch_id", "left").join(own, "sketch_id", "left"), "found-carried"
    )
    pages = queries.members.select(F.col("url").alias("query_url"), F.col("sketch_id").alias("query_sketch"))
    before = (F.col("_low") != F.col("query_url")) | (F.col("_high") != F.col("query_url"))
    met = pages.join(carried, "query_sketch").filter(before | (F.col("_first") < F.col("query_url")))
    columns = ["query_url", "query_sketch", "sketch_id", "jaccard_est", "jaccard_exact"]
    one = F.lit(1.0)
    itself = pages.select("query_url", "query_sketch", F.lit(SELF_MARK), one, one).toDF(*columns)
    return met.select(*columns).unionByName(itself)


def stream_similar(pages: DataFrame, path: str, results: str, checkpoint: str,
                   vocab: Vocabulary = REFERENCE, min_jaccard: float | None = None,
                   bands: int = fn.BANDS, rows: int = fn.ROWS, expand: bool = True) -> StreamingQuery:
    """Look each new page up among all pages that came before it, then add it.

    Before it are the pages of earlier batches and those of its own batch whose
    URL sorts before its own, so that how pages are cut into batches does not
    change which pairs are answered. A page whose URL is stored is looked up too.
    Answers go to ``results/batch=<run>-<id>``.

    With ``expand`` they name every such page, so pages built alike are answered in
    all pairs. Without it they name the sketches of these pages, see :func:`class_answers`.
    """
    run = run_of(pages.sparkSession, checkpoint)
    settings = store.Settings(bands, rows, store.vocabulary_key(vocab))

    def step(batch_df: DataFrame, batch: int):
        spark, name = batch_df.sparkSession, f"{run}-{batch}"
        folder, known = store.version_folder(spark, path, settings)
        counted = Observation()
        fresh = batch_features(batch_df, vocab, counted)
        added = add_features(fresh, batch, run, folder, known, seen=counted)
        seen = store.open_version(spark, folder, known)
        earlier = store.stored(spark, folder, "members", name)
        answers = (page_answers if expand else class_answers)(fresh, added, earlier, seen, min_jaccard)
        answers.write.mode("overwrite").parquet(f"{results}/{store.BATCH}={name}")

    return (
        pages.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
