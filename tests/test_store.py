"""The stored index: shards, appends that are whole or not there, merged appends."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pagesim.operators import lsh, tree
from pagesim.plans import index as store, queries as q
from pagesim.session import mark, names_in, work_dir
from pagesim.streaming import ingest


def rows_of(idx):
    return sorted(tuple(r) for r in q._index_rows(idx).collect())


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


@pytest.fixture(scope="module")
def features(spark, folder):
    from pagesim.session import materialize

    return materialize(q.features(spark, folder).select("url", "grams", "vec", "errors"), "features")


def test_a_lookup_reads_the_shards_of_its_keys_only(spark, folder):
    from pagesim.session import materialize

    # long addresses, so that the keys are the smaller side of each join
    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sha2(F.concat("url", i.cast("string")), 256)), "")
    features = materialize(q.shingles(spark, folder).select(F.concat("url", tail).alias("url"), "grams"), "shingles")
    path, shards = work_dir(spark, "index"), 64
    idx = lsh.stored_index(features)
    store.save_index(idx, path, shards=shards)
    query = features.orderBy("url").limit(1)
    lookup = lambda: lsh.similar_pages(query, store.open_index(spark, path), include_self=False)
    want = sorted(tuple(r) for r in lookup().collect())
    assert want == sorted(tuple(r) for r in lsh.similar_pages(query, idx, include_self=False).collect())
    # the shards that the page's bands and its candidates' sketches lie in
    own = lsh.index_tables(query).bands.join(idx.bands.withColumnRenamed("sketch_id", "found"), ["band", "band_hash"])
    keys = own.select(
        lsh.shard_of(F.col("band_hash"), shards).alias("bands"), lsh.shard_of(F.col("found"), shards).alias("found")
    ).collect()
    probed = [lsh.shard_of(F.col("band_hash"), shards)]
    probed = {r[0] for r in lsh.index_tables(query).bands.select(*probed).collect()}
    needed = {"bands": probed, "sketches": {r.found for r in keys}, "members": {r.found for r in keys}}
    damaged = 0
    for table, keep in needed.items():
        for file in glob.glob(f"{local(path)}/*/{table}/*/shard=*/*.parquet"):
            if int(file.split("shard=")[1].split("/")[0]) not in keep:
                with open(file, "wb") as f:
                    f.write(b"no parquet file")
                damaged += 1
        for check in glob.glob(f"{local(path)}/*/{table}/*/shard=*/.*.crc"):
            os.unlink(check)
    assert damaged > 20
    assert sorted(tuple(r) for r in lookup().collect()) == want
    with pytest.raises(Exception):
        store.open_index(spark, path).bands.agg(F.sum("band_hash")).collect()


def test_the_plan_of_a_lookup_prunes_shards(spark, features, capsys):
    path = work_dir(spark, "index")
    store.save_index(lsh.index_tables(features), path)
    idx = store.open_index(spark, path)
    queries = lsh.query_index(features.limit(3))
    found = lsh.candidates(queries.bands, idx.bands, idx.shards)
    found.explain()
    assert "dynamicpruningexpression(shard" in capsys.readouterr().out
    lsh.similar_pages(features.limit(3), idx).explain()
    assert "dynamicpruningexpression(shard" in capsys.readouterr().out


def test_stored_tables_hold_every_row_once_per_shard_key(spark, features):
    path = work_dir(spark, "index")
    plain = lsh.index_tables(features)
    store.save_index(plain, path, shards=5)
    idx = store.open_index(spark, path)
    for name, key in (("bands", "band_hash"), ("sketches", "sketch_id"), ("members", "sketch_id")):
        rows = getattr(idx, name)
        assert rows.count() == getattr(plain, name).count()
        assert rows.filter(F.col("shard") != lsh.shard_of(F.col(key), 5)).count() == 0


def test_an_append_that_fails_is_not_seen_and_can_be_repeated(spark, features, monkeypatch):
    path = work_dir(spark, "index")
    store.save_index(lsh.index_tables(features.filter("hash(url) % 2 = 0")), path)
    before, whole = rows_of(store.open_index(spark, path)), rows_of(lsh.index_tables(features))
    write = store.write_table
    for broken in store.TABLES:
        def fails(df, folder, table, name, shards, broken=broken):
            if table == broken:
                raise RuntimeError("lost")
            write(df, folder, table, name, shards)

        monkeypatch.setattr(store, "write_table", fails)
        with pytest.raises(RuntimeError, match="lost"):
            store.save_index(lsh.index_tables(features), path, "append")
        monkeypatch.setattr(store, "write_table", write)
        assert rows_of(store.open_index(spark, path)) == before
    store.save_index(lsh.index_tables(features), path, "append")
    assert rows_of(store.open_index(spark, path)) == whole


def test_merged_appends_are_the_same_index(spark, features, monkeypatch):
    monkeypatch.setattr(ingest, "batch_features", lambda pages, vocab: pages)
    path, settings = work_dir(spark, "index"), store.Settings()
    folder, settings = store.version_folder(spark, path, settings)
    from pagesim.operators.sketches import members_table
    from pagesim.session import materialize

    every = materialize(members_table(features), "members")
    for n in range(5):
        ingest.add_features(every.filter(f"pmod(hash(url), 5) <= {n}"), n, "r", folder, settings, fan=2)
    live = store.live_batches(spark, folder)
    assert live == ["r-0-3", "r-4"]
    want = rows_of(lsh.index_tables(features))
    assert rows_of(store.open_index(spark, path)) == want
    # the last batch again, and a merge that stops half-way
    ingest.add_features(every, 4, "r", folder, settings, fan=2)
    write = store.write_table
    ingest.add_features(every.limit(0), 5, "r", folder, settings, fan=2)

    def fails(df, folder, table, name, shards):
        if table == "bands":
            raise RuntimeError("lost")
        write(df, folder, table, name, shards)

    monkeypatch.setattr(store, "write_table", fails)
    with pytest.raises(RuntimeError, match="lost"):
        store.merge_batches(spark, folder, "r", 6, settings.shards, 2)
    assert rows_of(store.open_index(spark, path)) == want
    monkeypatch.setattr(store, "write_table", write)
    store.merge_batches(spark, folder, "r", 6, settings.shards, 2)
    assert rows_of(store.open_index(spark, path)) == want
    # what is covered is removed one merge later
    store.merge_batches(spark, folder, "r", 6, settings.shards, 2)
    for table in store.TABLES:
        assert names_in(spark, f"{folder}/{table}") == [f"batch={n}" for n in store.live_batches(spark, folder)]
    assert rows_of(store.open_index(spark, path)) == want


def test_the_number_of_folders_stays_small(spark, monkeypatch):
    folder, written = work_dir(spark, "index"), []

    def write(spark, folder, name, shards, tables):
        written.append(name)
        mark(spark, f"{folder}/{store.LIVE}/{name}")

    monkeypatch.setattr(store, "write_batch", write)
    monkeypatch.setattr(store, "read_batches", lambda *a: None)
    mark(spark, f"{folder}/{store.LIVE}/built")
    mark(spark, f"{folder}/{store.LIVE}/other-7")
    for n in range(200):
        store.merge_batches(spark, folder, "r", n, 16)
        mark(spark, f"{folder}/{store.LIVE}/r-{n}")
        live = store.live_batches(spark, folder)
        assert len(live) <= 2 + 3 * 4 + 1 and {"built", "other-7"} < set(live)
        spans = sorted(store._span(name)[1:] for name in live if name.startswith("r-"))
        assert [i for a, b in spans for i in range(a, b + 1)] == list(range(n + 1))
        assert len(names_in(spark, f"{folder}/{store.LIVE}")) <= len(live) + 3 * 4
    assert len(store.live_batches(spark, folder)) <= 10
    rewritten = sum(b - a + 1 for _, a, b in map(store._span, written))
    assert rewritten <= 200 * 3  # each append is written again once per size


def test_names_without_numbers_cover_nothing():
    assert store._covered(["built", "abc", "r-1", "r-2", "s-0-9"]) == set()
    assert store._covered(["r-1", "r-2", "r-1-2", "r-3", "s-1"]) == {"r-1", "r-2"}
