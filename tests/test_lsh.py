import random

import pytest
from pyspark.sql import functions as F
from pagesim.operators import cluster, lsh
from pagesim.plans import index as store, queries as q
from pagesim.session import work_dir


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def corpus(spark):
    """Near copies of a few templates, a hot template with many exact copies."""
    rng = random.Random(11)
    rows = []
    for t in range(4):
        base = [f"{t}.{i}.0" for i in range(60)]
        for c in range(30):
            items = set(base)
            for _ in range(rng.randint(0, 6)):
                items.discard(rng.choice(base))
                items.add(f"{t}.{rng.randint(100, 120)}.1")
            rows.append((f"u{t}-{c}", sorted(items)))
    rows += [(f"hot{i:03d}", ["1.2.3", "4.5.6", "7.8.9"]) for i in range(150)]
    df = spark.createDataFrame(rows, "url string, grams array<string>")
    return rows, lsh.stored_index(df)


def brute_pairs(index):
    bands = {}
    for r in index.bands.collect():
        bands.setdefault((r.band, r.band_hash), set()).add(r.sketch_id)
    return {tuple(sorted((a, b))) for s in bands.values() for a in s for b in s if a < b}


def test_bucket_pairs_match_brute_force_at_any_block_size(corpus):
    wanted = brute_pairs(corpus[1])
    assert len(wanted) > 200
    for block in (1, 2, 3, 7, 512):
        rows = lsh.bucket_pairs(corpus[1].bands, block).collect()
        assert len(rows) == len(wanted)
        assert {(r.a, r.b) for r in rows} == wanted


def test_sizes_bound_the_pairs_of_a_hot_bucket(spark):
    """Sets of all sizes in one bucket: the pairs that can be similar, and no others, are put together."""
    rng = random.Random(4)
    rows = [(f"s{i:03d}", [f"{i}.{j}.0" for j in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 40, 57, 100, 125, 400]))], [0]) for i in range(250)]
    sketches = spark.createDataFrame(rows, "sketch_id string, grams array<string>, sig array<bigint>")
    bands = sketches.selectExpr("0 as band", "7L as band_hash", "sketch_id")
    sizes = {r[0]: len(r[1]) for r in rows}
    every = [(a, b) for a in sizes for b in sizes if a < b]
    for bound in (0.3, 0.7, 0.8, 1.0):
        can = {(a, b) for a, b in every if 0 < min(sizes[a], sizes[b]) >= bound * max(sizes[a], sizes[b])}
        for block in (10, 512):
            met = lsh.bounded_bucket_pairs(bands, sketches, bound, block).collect()
            assert len(met) == len(can) and {(r.a, r.b) for r in met} == can
        assert len(can) < len(every) / (2 if bound < 0.5 else 3)


def test_the_bound_loses_no_similar_pair(corpus):
    idx = corpus[1]
    for bound in (0.5, 0.85, 0.95):
        want = sorted(tuple(r) for r in lsh.similar_sketches(idx).filter(F.col("jaccard_exact") >= bound).collect())
        assert sorted(tuple(r) for r in lsh.similar_sketches(idx, min_exact=bound).collect()) == want
        assert want or bound > 0.9


def test_copies_are_one_sketch(corpus):
    rows, idx = corpus
    hot = lsh.sketch_members(idx.members).filter("urls >= 150").collect()
    assert [(r.first_url, r.urls) for r in hot] == [("hot000", 150)]
    assert idx.sketches.count() == len({tuple(g) for _, g in rows})
    assert idx.bands.count() == 10 * idx.sketches.count()


def test_similar_pages_returns_every_copy(corpus):
    rows, idx = corpus
    query = idx.members.sparkSession.createDataFrame(
        [("ask", ["1.2.3", "4.5.6", "7.8.9"])], "url string, grams array<string>"
    )
    found = lsh.similar_pages(query, idx).collect()
    assert sorted(r.url for r in found) == ["ask*"] + [f"hot{i:03d}" for i in range(150)]
    assert all(r.jaccard_est == 1 and r.jaccard_exact == 1 for r in found)
    alone = lsh.similar_pages(query, idx, include_self=False).count()
    assert alone == 150


def test_similar_pages_matches_brute_force(corpus):
    rows, idx = corpus
    sketch_of = {r.url: r.sketch_id for r in idx.members.collect()}
    linked = brute_pairs(idx)
    wanted = {
        (a, b) for a, x in sketch_of.items() for b, y in sketch_of.items()
        if x == y or tuple(sorted((x, y))) in linked
    }
    found = lsh.similar_pages(idx, idx, include_self=False).collect()
    assert {(r.query_url, r.url) for r in found} == wanted and len(found) == len(wanted)
    sets = {u: set(g) for u, g in rows}
    for r in found:
        a, b = sets[r.query_url], sets[r.url]
        assert abs(r.jaccard_exact - len(a & b) / len(a | b)) < 1e-12


def test_similar_pairs_bounds(corpus):
    got = lsh.similar_pairs(corpus[1], 0.8, 0.85).collect()
    assert got and all(r.jaccard_est >= 0.8 and r.jaccard_exact >= 0.85 for r in got)
    assert all(r.url_a < r.url_b for r in got)


def test_buckets_list_every_url(corpus):
    rows, idx = corpus
    got = lsh.buckets(idx).collect()
    per = {}
    for r in got:
        per.setdefault((r.band, r.band_hash), []).append(r)
    assert all(len(v) == v[0].bucket_size > 1 for v in per.values())
    assert sum(r.url.startswith("hot") for r in got) == 1500


def test_clusters_match_union_find(corpus):
    rows, idx = corpus
    sketch_of = {r.url: r.sketch_id for r in idx.members.collect()}
    root = union_find(brute_pairs(idx), set(sketch_of.values()))
    groups = {}
    for url, s in sketch_of.items():
        groups.setdefault(root[s], []).append(url)
    wanted = {u: (min(g), len(g)) for g in groups.values() for u in g}
    got = {r.url: (r.cluster, r.cluster_size) for r in cluster.cluster_pages(idx).collect()}
    assert got == wanted
    pairs = lsh.similar_sketches(idx)
    got = {r.url: (r.cluster, r.cluster_size) for r in cluster.cluster_pages(idx, pairs).collect()}
    assert got == wanted


def test_components_on_hub_chain_and_random_edges(spark):
    rng = random.Random(2)
    edges = [("hub", f"h{i}") for i in range(300)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    edges += [(f"r{rng.randint(0, 200)}", f"r{rng.randint(0, 200)}") for _ in range(120)]
    df = spark.createDataFrame(edges, "a string, b string")
    real = [(a, b) for a, b in edges if a != b]
    wanted = union_find(real, {n for e in real for n in e})
    got = {r.node: r.root for r in cluster.components(df).collect()}
    assert got == wanted


def test_pages_spelled_out_by_blocks_are_those_of_the_lookup(spark):
    """Hot sketches, several vectors in one, a vector of zeros and none, in blocks of 4 URLs."""
    sets = [[f"{i}.1.1" for i in range(30)], [f"{i}.1.1" for i in range(29)], ["9.9.9"]]
    vecs = [{1: 2, 2: 1}, {2: 1, 1: 2}, {1: 1}, {}, None]
    rows = [(f"u{i:02d}", sets[i % 7 // 3], vecs[i % 5]) for i in range(40)]
    idx = lsh.stored_index(spark.createDataFrame(rows, "url string, grams array<string>, vec map<int,bigint>"))
    _, found = lsh.similar_classes(idx, idx)
    pages = idx.members.select("url", "sketch_id", "vec")
    before = F.col("url") < F.col("query_url")
    want = lsh.similar_pages(idx, idx, include_self=False).filter(before)
    got = lsh.expand_pairs(found, pages, pages.withColumn("own", F.lit(True)), before & F.col("own"), ["own"], block=4)
    assert got.columns == want.columns
    want, got = (sorted(map(repr, df.collect())) for df in (want, got))
    assert got == want and len(want) > 40 * 39 / 4
    blocks, lines = lsh.url_blocks(pages, [], block=4)
    assert sorted(u for r in blocks.collect() for u in r.urls) == [u for u, _, _ in rows]
    # equal vectors share rows; each sketch has lines of about four
    assert {(r.urls, r.lines) for r in lines.collect()} == {(18, 5), (17, 5), (5, 2)}
    assert blocks.groupBy("sketch_id", "form").count().count() == 3 * 4


def test_saved_index_answers_like_the_built_one(spark, folder):
    path = work_dir(spark, "index")
    idx = store.build_index(q.pages(spark, folder).select("url", "html"), path, q.BLOCK)
    again = store.open_index(spark, path)
    query = q.features(spark, folder).orderBy("url").limit(2)
    key = ["query_url", "url"]
    a = lsh.similar_pages(query, idx).orderBy(*key).collect()
    b = lsh.similar_pages(query, again).orderBy(*key).collect()
    assert a == b and len(a) == 2 * 50 + 2


def test_index_keeps_its_banding(spark, corpus):
    idx = corpus[1]
    path = work_dir(spark, "index")
    df = spark.createDataFrame([("a", ["1.0.0"]), ("b", ["1.0.0", "2.0.0"])], "url string, grams array<string>")
    small = lsh.stored_index(df.withColumn("vec", F.create_map().cast("map<int,bigint>")), 18, 7)
    store.save_index(small, path)
    again = store.open_index(spark, path)
    assert (again.n_bands, again.n_rows) == (18, 7) and again.bands.count() == 36
    with pytest.raises(ValueError, match="bands=18, rows=7"):
        store.save_index(idx, path, "append")


def test_page_table_keeps_one_row_per_url(spark):
    df = spark.createDataFrame(
        [("u", 2, "<html><ul>"), ("u", 1, "<html><ol>"), ("v", 3, "<html>")], "url string, at int, html string"
    )
    from pagesim.operators.tree import page_features

    rows = {r.url: r for r in store.page_table(page_features(df), ("at",)).collect()}
    assert rows["u"].grams == ["3.8.0", "8.0.0"] and rows["v"].grams == ["3.0.0"]


def test_a_hot_centre_is_split_between_tasks(spark):
    """The joins of the star steps: one node has nearly all edges."""
    from pagesim.operators import cluster

    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 20001, 1, 8).selectExpr("'a' AS a", "concat('n', id) AS b")
        edges = cluster.materialize(edges, "edges")
        both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        joined = cluster._with_low(both.filter("v > u"), low)
        assert joined.count() == 20000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_sets_that_are_compared_are_shuffled(spark):
    """A stored index is written as it comes, copies and all, and pairs fetch the sets they need."""
    base = [f"w{i}" for i in range(60)]
    rows = [("a", base), ("b", base[1:] + ["x"]), ("c", base), ("none", [])]
    rows += [(f"apart{i}", [f"{i}.{k}" for k in range(5)]) for i in range(40)]
    df = spark.createDataFrame([(u, sorted(g)) for u, g in rows], "url string, grams array<string>")
    idx = lsh.stored_index(df, 32, 4)
    assert idx.rows.count() == 44 and idx.sketches.count() == 43 and idx.bands.count() == 43 * 32
    near = {r.url: r.sketch_id for r in idx.members.collect()}
    pairs = spark.createDataFrame([(near["a"], near["b"])], "a string, b string")
    one = lsh._attached(pairs, lsh._sets(idx), "a", "grams", "set")
    assert [sorted(r.set) for r in one.collect()] == [sorted(base)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [xxhash64(sketch_id" in plan and "LeftSemi" in plan
    got = {(r.query_url, r.url): r.jaccard_exact for r in lsh.similar_pages(idx, idx, 0.5, include_self=False).collect()}
    same = {(u, u): 1.0 for u, _ in rows} | {("none", "none"): None, ("a", "c"): 1.0, ("c", "a"): 1.0}
    links = {(x, y): 59 / 61 for u in ("a", "c") for x, y in ((u, "b"), ("b", u))}
    assert got == same | links
