import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesim.llm import manifest, periodic_runs as pr, quality

EMPTY = hashlib.sha256(b"").hexdigest()


def brute_runs(words, min_length=6, exponent=4):
    """All maximal stretches of each period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def listed(runs):
    return [(r["start"], r["length"], r["period"]) for r in runs]


@pytest.mark.parametrize("min_length, exponent", [(6, 4), (1, 2), (10, 3), (3, 2)])
def test_runs_equal_brute_force(min_length, exponent):
    rnd = random.Random(min_length)
    for _ in range(120):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            kinds, size = rnd.choice([1, 2, 3, 5]), rnd.choice([0, 1, 5, 6, 7, 30, 80])
            words = [rnd.choice("abcdefg"[:kinds]) for _ in range(size)]
            for _ in range(rnd.randint(0, 3)):
                at, period = rnd.randint(0, len(words)), rnd.randint(1, 6)
                words[at:at] = [rnd.choice("abcx") for _ in range(period)] * rnd.randint(2, 9)
            texts.append(words)
        runs, collapsed = pr._piece(pa.array([" ".join(t) for t in texts]), min_length, exponent)
        for words, got, rest in zip(texts, runs.to_pylist(), collapsed.to_pylist()):
            want = brute_runs(words, min_length, exponent)
            assert listed(got) == sorted(want, key=lambda r: (r[0], r[2]))
            assert rest == brute_collapsed(words, want)


def test_maximal_pairs_are_those_of_the_definition():
    """The tree gives each pair of maximal occurrences within reach once, and no other."""
    rnd = random.Random(5)
    for _ in range(100):
        words = [rnd.choice("ab") for _ in range(rnd.randint(2, 40))]
        codes, places = pr.word_codes(pa.array(words), np.zeros(len(words), dtype=np.int64), np.array([len(words)]))
        levels, near = pr.ranked(codes, 2)
        marked = np.flatnonzero(near)
        if not len(marked):
            got = []
        else:
            order = marked[np.argsort(levels[-1][marked])]
            lcps = np.append(0, pr.common_words(levels, order[:-1], order[1:]))
            got = pr.maximal_pairs(order.tolist(), lcps.tolist(), codes[order - 1].tolist(), 2, 2)
        want, n = set(), len(words)
        for i in range(n):
            for j in range(i + 1, n):
                size = next((k for k in range(n - j) if words[i + k] != words[j + k]), n - j)
                if size >= 2 and j - i <= size / 2 and (i == 0 or words[i - 1] != words[j - 1]):
                    want.add((places[i], places[j], size))
        assert len(got) == len(set(got)) and set(got) == want


def test_words_are_cut_at_ascii_space_only():
    text = "a b\x1cc a b\x1cc\ta b\x1cc\x0ba b\x1cc\x0ca b\x1cc\r\na b\x1cc"
    runs, collapsed = pr._piece(pa.array([text, None, "", " \t ", "é " * 6]), 6, 4)
    assert [listed(r) for r in runs.to_pylist()] == [[(0, 6, 1)], [], [], [], [(0, 6, 1)]]
    assert collapsed.to_pylist() == ["a b\x1cc", "", "", "", "é"]


def test_long_periodic_texts():
    texts = [["a"] * 50_000, list("ab") * 25_000, [w for i in range(3_000) for w in [f"x{i}", *["ha"] * 9]]]
    runs, _ = pr._piece(pa.array([" ".join(t) for t in texts]), 6, 4)
    assert listed(runs[0].as_py()) == [(0, 50_000, 1)]
    assert listed(runs[1].as_py()) == [(0, 50_000, 2)]
    assert listed(runs[2].as_py()) == [(10 * i + 1, 9, 1) for i in range(3_000)]


def test_pieces_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(pr, "PIECE", 10)
    texts = pa.array(["a b", None, "c" * 40, "", "d", "e f g h i j k"])
    pieces = list(pr._pieces(texts))
    assert [t for p in pieces for t in p.to_pylist()] == texts.to_pylist() and len(pieces) > 2


def test_odd_rows_of_runs(spark):
    rows = [(1, "x " * 8, "r"), (1, "x " * 8, "r"), (None, "x " * 8, None), (2, None, "r"), (3, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = sorted((str(r.doc_id), listed(r.runs), r.collapsed) for r in pr.periodic_runs(docs).collect())
    one = [(0, 8, 1)]
    assert got == [("1", one, "x"), ("1", one, "x"), ("2", [], ""), ("3", [], ""), ("None", one, "x")]
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, exponent=1)


def test_op11_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pr.op11_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        h = zlib.crc32(str(doc.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        row = got[doc.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        text = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        assert row.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_levels(hexes):
    levels = [hexes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def brute_path(levels, at):
    path = []
    for level in levels[:-1]:
        run = at // 16 * 16
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return path


def brute_manifest(rows):
    """``(doc_id, leaf, subroot, root, path)`` of rows of doc_id, source, lang, n_chars, text."""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_levels([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names}
    top = brute_levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        above = brute_path(top, place)
        for at, row in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            out.append((row[3], row[2], trees[s][-1][0], top[-1][0], brute_path(trees[s], at) + above))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [256], [257], [1, 16, 17, 300], [1] * 18])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(i, f"s{k}", "en", i, f"text {i}") for k, size in enumerate(sizes) for i in range(size)]
    check_manifest(spark, rows)


def test_manifest_of_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (1, None, None, None, None), (None, None, "en", 1, ""), (None, "", "en", 1, "x"),
        (2, "", "en", 1, "x"), (2, "", "en", 1, "y"), (-3, "é", "en", 1, "ü" * 70_000), (4, "-", None, 0, "1:a"),
    ] + [(None, "s", None, None, "same")] * 40
    check_manifest(spark, rows)
    assert manifest.merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0


def check_manifest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("hex", F.lit("extra")).withColumn("group", F.lit(1))
    got = manifest.merkle_manifest(docs).select(
        "kept", "leaf", "subroot", "root", "path",
        manifest.folded(F.col("leaf"), F.col("path")).alias("folded"),
        manifest.folded(F.sha2("leaf", 256), F.col("path")).alias("other"),
    ).collect()
    assert all(r.folded == r.root and r.other != r.root for r in got)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    found = [(r.kept, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in got]
    assert sorted(found, key=order) == sorted(brute_manifest(rows), key=order)


def test_op12_equals_its_sql_and_finds_all_tampering(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(manifest.OP12_SQL).fetchall())
    found = manifest.op12_merkle_manifest(spark, folder)
    got = sorted(tuple(r) for r in found.collect())
    assert found.columns == [c[0] for c in con.description] and got == want
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for doc_id, *_, verified in got:
        changed = zlib.crc32(str(doc_id).encode()) % 5 == 0 and re.search("[A-Z]", texts[doc_id] or "")
        assert verified is not bool(changed)


def test_quality_on_rows_kept_from_training(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    scored = quality.op13_quality(spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").dropna()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def labelled_values(n=600, seed=3):
    rnd = np.random.default_rng(seed)
    values = rnd.normal(size=(n, 5)).round(2)
    return values, rnd


def test_model_is_the_sum_of_its_tables():
    values, rnd = labelled_values()
    labels = values[:, 0] + rnd.normal(size=len(values)) / 2 > 0
    model = quality.fit(values, labels, np.arange(len(values)) % 10 == 0)
    assert model.pairs
    for row, score in zip(values[:50], model.score(values[:50])):
        odds = model.base
        for j, v in enumerate(row):
            odds += model.tables[j][sum(v >= c for c in model.cuts[j])]
        for (a, b), own in model.pairs.items():
            odds += own[sum(row[a] >= c for c in model.pair_cuts[a]), sum(row[b] >= c for c in model.pair_cuts[b])]
        assert score == pytest.approx(1 / (1 + np.exp(-odds)))


def test_pairs_learn_what_no_single_feature_shows():
    values, _ = labelled_values(3_000)
    labels = (values[:, 1] > 0) != (values[:, 3] > 0)
    model = quality.fit(values, labels, np.arange(len(values)) % 10 == 0)
    assert (1, 3) in model.pairs
    fresh, _ = labelled_values(1_000, seed=9)
    want = (fresh[:, 1] > 0) != (fresh[:, 3] > 0)
    assert ((model.score(fresh) >= 0.5) == want).mean() > 0.9
    model.pairs = {}
    assert ((model.score(fresh) >= 0.5) == want).mean() < 0.65


def test_best_tree_of_a_pair_is_the_best_of_all():
    rnd = np.random.default_rng(2)
    g, h, n = rnd.normal(size=(3, 4)), rnd.random((3, 4)), np.full((3, 4), 9.0)
    best = 0.0
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            gain = -quality._gain(g.sum(), h.sum())
            for side in (slice(0, cut), slice(cut, None)):
                x, y = a[side].sum(axis=0), b[side].sum(axis=0)
                gain += max(
                    sum(quality._gain(x[p].sum(), y[p].sum()) for p in (slice(0, at), slice(at, None)))
                    for at in range(len(x))
                )
            best = max(best, gain)
    assert quality.pair_steps(g, h, n, 1.0)[0] == pytest.approx(best)


def test_quality_of_odd_rows(spark):
    rows = [(1, "a good text.", 0), (1, "a good text.", 0), (2, None, 1), (3, "", 1), (4, "   ", 1), (None, "x", 1),
            (5, "\x00 ퟿ é" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    marks = [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (5, 7)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.score_quality(docs, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1
    none = quality.score_quality(docs, docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.score_quality(docs.limit(0), docs.limit(0), labels).count() == 0


def test_features_are_finite_and_scale_free():
    text = "One two three. Four five six!\n" * 3
    values = np.array([quality.features(t) for t in (text, "", None, "!!!", "1 2 3", "é" * 100_000)])
    assert np.isfinite(values).all() and values.shape[1] == len(quality.FEATURES)
    assert (values[1] == 0).all() and (values[2] == 0).all()
