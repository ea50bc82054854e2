"""Stages, streaming and the entry points."""

import pytest
from pyspark.sql import functions as F

from pagesim.operators import records
from pagesim.plans import index as store, queries as q
from pagesim.plans.stage import Stage, chain, require, with_stage
from pagesim.plans.stages import HtmlParse, TreeGrams, TreeReduce, TreeString, feature_stages
from pagesim.session import work_dir
from pagesim.streaming import ingest


def test_requirements_fail_while_planning(spark):
    bare = spark.createDataFrame([("<html>",)], "html string")
    with pytest.raises(RuntimeError, match="'extract' not met for HtmlParse"):
        bare.transform(HtmlParse())


def test_requirements_fail_with_the_data(spark):
    df = records.pages_as_records(spark.createDataFrame([("u", "<html>")], "url string, html string"))
    assert require(df, "x", ["extract"]).count() == 1
    with pytest.raises(Exception, match="'tree_parse' not met for x"):
        require(df, "x", ["extract", "tree_parse"]).collect()


def test_stages_leave_lineage_and_errors(spark):
    df = records.pages_as_records(
        spark.createDataFrame([("u", "<html><ul>"), ("v", "")], "url string, html string"))
    out = {r.url: r for r in chain(df, HtmlParse(), TreeReduce(), TreeString(), TreeGrams()).collect()}
    labels = ["extract", "html_parse", "tree_parse", "tree_stringify", "tree_to_matrix"]
    assert out["u"].transformations == labels and out["u"].errors == [] and out["u"].preorder == "3.7"
    assert out["v"].errors == ["HtmlParser: Document is empty", "TreeParser: NoneType object",
                               "TreeStringify: NoneType object"]
    assert out["v"].grams == ["None.0.0"]


def test_own_stages(spark):
    class Shout(Stage):
        requirements, label = ("extract",), "shout"

        def transform(self, df):
            return df.withColumn("url", F.upper("url"))

    df = with_stage(spark.createDataFrame([("u",)], "url string"), "extract")
    quiet = Stage.of("quiet", lambda d: d.withColumn("url", F.lower("url")), ["shout"])
    r = chain(df, Shout(), quiet).first()
    assert r.url == "u" and r.transformations == ["extract", "shout", "quiet"]
    with pytest.raises(RuntimeError, match="'shout' not met"):
        df.transform(quiet)
    with pytest.raises(NotImplementedError):
        df.transform(Stage())


def test_stream_equals_batch_and_replay_changes_nothing(spark, folder):
    path = work_dir(spark, "index")
    pages = q.pages(spark, folder).select("url", "html")
    first, second = pages.filter("length(url) % 2 = 0"), pages
    ingest.index_batch(first, 0, path, q.BLOCK)
    ingest.index_batch(second, 1, path, q.BLOCK)
    ingest.index_batch(second, 1, path, q.BLOCK)  # the same batch again
    got = store.open_index(spark, path)
    batch = store.build_index(pages, work_dir(spark, "index"), q.BLOCK)
    for table in ("sketches", "bands"):
        a, b = getattr(got, table), getattr(batch, table)
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0
    a, b = got.members.select("url", "sketch_id"), batch.members.select("url", "sketch_id")
    assert a.count() == b.count() == 50 and a.exceptAll(b).count() == 0


def test_stream_similar_does_not_depend_on_batches(spark, tmp_path):
    rows = [(f"u{i}", "<html><ul><ol>" if i % 3 else "<html><table>") for i in range(7)]
    df = spark.createDataFrame(rows, "url string, html string")
    want = {(f"u{j}", f"u{i}") for i in range(7) for j in range(i) if (i % 3 == 0) == (j % 3 == 0)}
    want |= {(f"u{i}", f"u{i}*") for i in range(7)}
    for files in (1, 3, 7):
        path, out, check = (work_dir(spark, n) for n in ("index", "answers", "progress"))
        source = str(tmp_path / f"in{files}")
        df.repartition(files).write.parquet(source)
        stream = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(source)
        ingest.stream_similar(stream, path, out, check, q.vc.FULL).awaitTermination()
        got = [tuple(sorted((r.query_url, r.url))) for r in spark.read.parquet(out).collect()]
        assert sorted(got) == sorted(want)
    # a stored URL is answered too
    again = spark.readStream.schema("url string, html string").parquet(str(tmp_path / "in1"))
    ingest.stream_similar(again, path, str(tmp_path / "again"), work_dir(spark, "progress"), q.vc.FULL).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "again")).select("query_url").distinct().count() == 7


def test_stream_similar_by_class_grows_with_the_pages(spark, tmp_path):
    """What the expanded answers link, with one row per page and class and not one per pair."""
    body = ["<html><ul><ol>", "<html><table>", "<html><table><ul><ul>"]
    rows = [(f"u{i:02d}", body[i % 2] if i < 30 else body[2]) for i in range(31)]
    df = spark.createDataFrame(rows, "url string, html string")
    for files in (1, 4):
        path, check, source, out = (str(tmp_path / f"{n}{files}") for n in ("index", "check", "in", "out"))
        df.repartition(files).write.parquet(source)
        stream = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(source)
        ingest.stream_similar(stream, path, out, check, q.vc.FULL, expand=False).awaitTermination()
        got = spark.read.parquet(out).collect()
        assert sorted(r.query_url for r in got if r.sketch_id == "*") == sorted(u for u, _ in rows)
        links = [(r.query_url, r.sketch_id) for r in got if r.sketch_id == r.query_sketch]
        # all of a class but the one that came first
        assert len(links) == len(set(links)) == 31 - len({r.query_sketch for r in got}) == 28
        assert {r.jaccard_exact for r in got} == {1.0}
    # pages that come again meet the others of their class, and not themselves
    again = spark.readStream.schema("url string, html string").parquet(str(tmp_path / "in1"))
    ingest.stream_similar(again, path, str(tmp_path / "again"), str(tmp_path / "more"), q.vc.FULL, expand=False).awaitTermination()
    links = [r.query_url for r in spark.read.parquet(str(tmp_path / "again")).collect() if r.sketch_id == r.query_sketch]
    assert sorted(links) == [f"u{i:02d}" for i in range(30)]


@pytest.mark.parametrize("query", [q.stream_similar, q.stream_similar_small_batches])
def test_stream_similar_query_names_all_pairs(spark, tmp_path, query):
    """Every two pages that share a band, copies too, and each page with itself."""
    body = ["<html><body><div><p>a</p></div></body></html>", "<html><body><ul><li>a<li>b</ul></body></html>"]
    rows = [(i, f"u{i:02d}", body[i % 3 == 0]) for i in range(12)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {(a, b) for _, a, x in rows for _, b, y in rows if a < b and x == y} | {(u, f"{u}*") for _, u, _ in rows}
    assert len(want) == 28 + 6 + 12
    got = [tuple(r) for r in query(spark, str(tmp_path)).select("url_a", "url_b").collect()]
    assert sorted(got) == sorted(want)


def test_stream_similar_scores_pages_as_a_lookup_does(spark, tmp_path):
    body = ["<html><body><div><p>a</p></div></body></html>", "<html><body><div><p>a</p></div><div><p>b</p></div></body></html>"]
    rows = [(f"u{i}", body[i % 3 == 0] + "<p>c</p>" * (i % 2)) for i in range(8)] + [(None, body[0])]
    df = spark.createDataFrame(rows, "url string, html string")
    path, source, out = (str(tmp_path / n) for n in ("index", "in", "out"))
    df.repartition(2).write.parquet(source)
    stream = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(source)
    ingest.stream_similar(stream, path, out, str(tmp_path / "check"), q.BLOCK).awaitTermination()
    ordered = [F.least("query_url", "url").alias("a"), F.greatest("query_url", "url").alias("b")]
    scores = [F.round(c, 9) for c in ("jaccard_est", "jaccard_exact", "cosine_distance")]
    idx = store.build_index(df, str(tmp_path / "built"), q.BLOCK)
    every = q.lsh.similar_pages(q.tree.page_features(df, "html", q.BLOCK), idx).filter("query_url <> url")
    want = sorted({tuple(r) for r in every.select(*ordered, *scores).collect()})
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*ordered, *scores).collect())
    assert got == want and len(want) > 8 and len({r[4] for r in want}) > 1


def test_streams_builds_and_appends_lose_and_double_nothing(spark, folder):
    from pagesim.plans.oracle import ORACLE  # noqa: F401  the SQL of these runs is the index of all pages

    pages = q.pages(spark, folder).select("url", "html")
    want = sorted(tuple(r) for r in q._index_rows(store.build_index(pages, work_dir(spark, "i"), q.BLOCK)).collect())
    for query in (q.two_streams_disjoint, q.two_streams_overlap, q.rebuild_over_stream, q.append_overlap):
        assert sorted(tuple(r) for r in query(spark, folder).collect()) == want, query.__name__


def test_an_index_refuses_rows_that_cannot_be_compared(spark, folder):
    path = work_dir(spark, "index")
    pages = q.pages(spark, folder).select("url", "html")
    idx = store.build_index(pages, path, q.BLOCK)
    for change in (dict(vocab=q.vc.FULL), dict(vocab=q.BLOCK, bands=5)):
        with pytest.raises(ValueError, match="the index at"):
            ingest.index_batch(pages, 0, path, **change)
    other = store.build_index(pages, work_dir(spark, "other"), q.vc.FULL)
    with pytest.raises(ValueError, match="different vocabularies"):
        q.lsh.similar_pages(other, idx)
    with pytest.raises(FileNotFoundError):
        store.open_index(spark, work_dir(spark, "none"))


def test_a_failed_build_leaves_the_index(spark, folder):
    path = work_dir(spark, "index")
    pages = q.pages(spark, folder).select("url", "html")
    store.build_index(pages, path, q.BLOCK)
    with pytest.raises(Exception):
        store.build_index(pages.withColumn("html", F.raise_error(F.lit("stop"))), path, q.BLOCK)
    assert store.open_index(spark, path).members.count() == 50


def test_sets_with_separators_in_their_items_differ(spark):
    from pagesim.operators.sketches import members_table

    rows = spark.createDataFrame([(["a", "b | c"],), (["a | b", "c"],), (["a", "b", "c"],)], "grams array<string>")
    assert members_table(rows).select("sketch_id").distinct().count() == 3


def test_ready_stages_equal_the_direct_features(spark, folder):
    pages = q.pages(spark, folder).select("url", "html")
    staged = chain(records.pages_as_records(pages), *feature_stages(q.BLOCK)).select("url", "grams")
    direct = q.features(spark, folder).select("url", "grams")
    assert staged.exceptAll(direct).count() == 0 and staged.count() == 50


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(q.QUERIES) <= set(entry.queries()) and set(q.QUERIES) <= set(entry.oracle_sql())
    rows = entry.entry(spark).collect()
    assert rows and {"query_url", "url", "jaccard_est", "jaccard_exact", "cosine_distance"} == set(rows[0].asDict())


def test_query_matches_its_sql(spark, folder):
    """A sample of the registered pairs end to end; all of them run in the checks."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for key in ("g1_structural_grams_block", "m1_minhash_pages", "f4_project_html", "k2_warc_header_names"):
        df = entry.queries()[key](spark, folder)
        cols = sorted(df.columns)
        mine = sorted(tuple(r[c] for c in cols) for r in df.collect())
        cur = con.execute(entry.oracle_sql()[key])
        names = [d[0] for d in cur.description]
        theirs = sorted(tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall())
        assert mine == theirs, key


def test_archives_stream_in_like_one_batch(spark, folder):
    source = q._warc_folder(spark, folder, "gzip")
    path, check = work_dir(spark, "index"), work_dir(spark, "progress")
    run = lambda: ingest.stream_archives(
        spark, source, path, check, min_length=0, files_per_batch=2, vocab=q.BLOCK).awaitTermination()
    run()
    first = store.open_index(spark, path).members
    assert first.count() == 50
    run()  # nothing new
    assert store.open_index(spark, path).members.count() == 50
    whole = store.build_index(store.archive_pages(spark, source, "warc", min_length=0), work_dir(spark, "i"), q.BLOCK)
    assert first.select("url", "sketch_id").exceptAll(whole.members.select("url", "sketch_id")).count() == 0


def test_a_saved_pipeline_gives_the_same_rows(spark, folder, tmp_path):
    from pyspark.ml import PipelineModel

    from pagesim.plans import transformers as ml

    pages = records.pages_as_records(q.pages(spark, folder).select("url", "html"))
    model = ml.feature_pipeline(q.BLOCK)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [type(s) for s in again.stages] == [type(s) for s in model.stages]
    assert again.stages[1].getVocabulary() == q.BLOCK and again.stages[3].getOrDefault("numPerm") == 128
    want = q.lsh.minhash_sets(chain(pages, *feature_stages(q.BLOCK)))
    keep = ["url", "grams", "sig", F.map_entries("vec").alias("vec"), "errors"]
    got = again.transform(pages)
    assert sorted(map(str, got.select(keep).collect())) == sorted(map(str, want.select(keep).collect()))
    assert got.first().transformations == ["extract", "html_parse", "tree_parse", "tree_to_matrix", "minhash"]
    with pytest.raises(RuntimeError, match="'extract' not met"):
        ml.HtmlParser().transform(pages.drop("transformations"))
    # params can be set anew for one call, and each stage saved by itself
    one = ml.HtmlExtractor(minLength=5)
    assert one.copy({one.minLength: 9}).stage().min_length == 9
    one.write().save(str(tmp_path / "one"))
    assert ml.HtmlExtractor.load(str(tmp_path / "one")).stage().min_length == 5


def test_batches_are_counted_once(spark, folder):
    path = work_dir(spark, "index")
    pages = q.pages(spark, folder).select("url", "html")
    some = pages.filter("length(url) % 2 = 0").unionByName(pages.limit(0).select("url", F.lit("").alias("html")))
    ingest.index_batch(some, 0, path, q.BLOCK)
    ingest.index_batch(pages, 1, path, q.BLOCK)
    ingest.index_batch(pages, 1, path, q.BLOCK)  # the same batch again
    counts = {r.number: (r.run, r.processed, r.failed, r.inserted) for r in store.ingest_counts(spark, path).collect()}
    n = some.count()
    assert counts == {0: ("direct", n, 0, n), 1: ("direct", 50, 0, 50 - n)}
    with pytest.raises(FileNotFoundError):
        store.ingest_counts(spark, work_dir(spark, "none"))
