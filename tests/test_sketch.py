import hashlib
import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from pagesim.functions import sketch as fn
from pagesim.operators import dom, lsh, sketches
from pagesim.plans import queries as q


def slow_minhash(items):
    a, b = fn.permutations()
    sig = []
    for x, y in zip(a.tolist(), b.tolist()):
        low = fn.MAX_HASH
        for item in items:
            h = struct.unpack("<I", hashlib.sha1(item.encode()).digest()[:4])[0]
            low = min(low, ((x * h + y) % 2**64) % fn.MERSENNE_PRIME % 2**32)
        sig.append(low)
    return sig


SETS = {"a": ["3.9.0", "9.7.21", "7.0.0"], "b": ["ñ", "x y"], "c": [], "d": ["3.9.0"]}


def test_minhash_matches_exact_arithmetic(spark):
    df = spark.createDataFrame(list(SETS.items()), "k string, items array<string>")
    got = {r.k: r.sig for r in df.withColumn("sig", fn.minhash(F.col("items"))).collect()}
    for k, items in SETS.items():
        assert got[k] == slow_minhash(items)
    assert got["c"] == [fn.MAX_HASH] * 128


def test_row_form_equals_array_form(spark):
    rows = [(k, i) for k, items in SETS.items() for i in items * 3]
    df = spark.createDataFrame(rows, "k string, item string").repartition(4)
    got = {r.k: r.sig for r in sketches.minhash_rows(df, "k", "item").collect()}
    assert got == {k: slow_minhash(v) for k, v in SETS.items() if v}


def test_null_set_has_no_signature(spark):
    df = spark.createDataFrame([(1, None)], "k int, items array<string>")
    assert df.select(fn.minhash(F.col("items"))).first()[0] is None


def test_estimate_is_near_exact_on_documents(spark, folder):
    idx = lsh.stored_index(q.shingles(spark, folder))
    s = idx.sketches.select("sketch_id", "grams", "sig")
    left = s.select(F.col("grams").alias("g"), F.col("sig").alias("s"))
    pairs = s.join(left, F.abs(F.hash("sketch_id") % 8) == F.abs(F.hash(F.md5(F.array_join("g", ""))) % 8))
    scored = pairs.select(
        fn.jaccard_est(F.col("sig"), F.col("s")).alias("est"),
        fn.jaccard_exact(F.col("grams"), F.col("g")).alias("exact"),
    ).collect()
    assert len(scored) > 1000
    far = [r for r in scored
           if abs(r.est - r.exact) > 4 * math.sqrt(max(r.exact * (1 - r.exact), 0.002) / 128)]
    assert len(far) <= len(scored) * 0.002


def test_band_hit_rate_follows_the_curve():
    """P(share a band) = 1 - (1 - s^r)^b, for signatures that agree per value with s."""
    rng = np.random.default_rng(3)
    for s in (0.7, 0.8, 0.9):
        same = rng.random((20000, fn.BANDS, fn.ROWS)) < s
        hit = same.all(axis=2).any(axis=1).mean()
        assert abs(hit - (1 - (1 - s**fn.ROWS) ** fn.BANDS)) < 0.02
    assert fn.BANDS_ROWS[0.7] == (fn.BANDS, fn.ROWS)


def test_band_hashes_follow_the_slices(spark):
    df = spark.createDataFrame([(list(range(128)), list(range(127)) + [0])], "a array<bigint>, b array<bigint>")
    r = df.select(fn.band_hashes(F.col("a")).alias("a"), fn.band_hashes(F.col("b")).alias("b")).first()
    assert len(r.a) == 10 and r.a == r.b  # positions 120..127 are in no band
    text = ",".join(map(str, range(12)))
    assert r.a[0] == int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_scores(spark):
    df = spark.createDataFrame(
        [({1: 2, 2: 1}, {1: 2, 3: 5}, ["x", "y"], ["y", "z"]), ({1: 1}, {}, [], [])],
        "a map<int,bigint>, b map<int,bigint>, s array<string>, t array<string>",
    )
    rows = df.select(
        fn.cosine_distance(F.col("a"), F.col("b")).alias("d"),
        fn.cosine_distance(F.col("a"), F.col("a")).alias("z"),
        fn.jaccard_exact(F.col("s"), F.col("t")).alias("j"),
    ).collect()
    assert abs(rows[0].d - (1 - 4 / math.sqrt(5 * 29))) < 1e-12
    assert rows[0].z == 0 and abs(rows[0].j - 1 / 3) < 1e-12
    assert math.isnan(rows[1].d) and rows[1].j is None


def test_weighted_minhash_estimates_weighted_jaccard(spark):
    rng = random.Random(5)
    a = {i: rng.randint(1, 9) for i in range(60)}
    b = {i: max(1, w + rng.choice([-1, 0, 0, 1])) for i, w in a.items() if i > 5}
    df = spark.createDataFrame([("a", a), ("b", b), ("c", {})], "k string, vec map<int,bigint>")
    got = {r.k: r.samples for r in sketches.weighted_minhash_vectors(df).collect()}
    assert got["c"] is None and len(got["a"]) == 128
    same = sum(x == y for x, y in zip(got["a"], got["b"])) / 128
    keys = set(a) | set(b)
    exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs(same - exact) < 4 * math.sqrt(exact * (1 - exact) / 128)


def test_sketching_after_parsing_keeps_the_plan_small(spark, folder):
    df = sketches.minhash_sets(q.features(spark, folder))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_batch(") == 1 and plan.count("sort_array(") < 10


def test_node_rows_of_documents_cover_all_items(spark, folder):
    df = q.shingles(spark, folder)
    rows = dom.array_rows(df, "grams", "doc_id", value="item").count()
    assert rows == df.agg(F.sum(F.size("grams"))).first()[0]


def test_long_and_empty_sets_across_chunks():
    rng = np.random.default_rng(1)
    sizes = [0, 3, 0, 40000, 1, 0, 17000, 16384, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = rng.integers(0, 2**32, offsets[-1], dtype=np.uint32)
    got = fn.min_hashes(words, offsets, 8, 12)
    for i, (a, b) in enumerate(zip(*fn.permutations(8, 12))):
        for row, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
            exact = [((int(a) * int(w) + int(b)) % 2**64) % fn.MERSENNE_PRIME % 2**32 for w in words[lo:hi]]
            assert got[row, i] == min(exact, default=fn.MAX_HASH)
