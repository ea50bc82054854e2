"""Language id, token counts, secret scans and context-mixing scores against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesim.llm import common, context_mix, language, secrets, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", None, 1.0, 2) for i, t, l in rows], DOCS)


ODD = [
    (1, None, None), (2, "", "en"), (3, "   \n\t", None), (4, "12 34 !!", "en"), (5, "the cat and the dog", "en"),
    (5, "the cat and the dog", "en"), (None, "le chat et le chien", "fr"), (7, "le chat et le chien", "fr"),
    (8, "word " * 30000, None), (9, "\0 x\0", None), (10, "É İ ſ   漢字😀", None),
]


def test_segments_cover_every_text_once():
    texts = ["", "abc", "x" * 25, "de"]
    seen = collections.defaultdict(str)
    for group in common.segments(texts, 10, 3):
        assert sum(len(p) for _, p, _ in group) <= 23
        for row, part, skip in group:
            assert seen[row].endswith(part[:skip])
            seen[row] += part[skip:]
    assert [seen[i] for i in range(4)] == texts


# --- language


def test_language_held_out_accuracy(spark, folder):
    got = language.op5_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert held.score.between(0, 1).all()


def test_language_matches_counting_by_hand(spark):
    labelled = [("ab ab", "x"), ("zq", "y"), ("abab", "x")]
    names, logs, priors = language.train(spark.createDataFrame(labelled, "text string, lang string"))
    counts = {name: np.zeros(language.BUCKETS) for name in "xy"}
    for text, lang in labelled:
        buckets, _, _ = language.features([(0, text, 0)])
        np.add.at(counts[lang], buckets, 1)
    for i, name in enumerate(names):
        want = np.log((counts[name] + 0.5) / (counts[name].sum() + 0.5 * language.BUCKETS))
        assert np.allclose(logs[:, i], want, atol=1e-5)
    assert np.allclose(np.exp(priors), [2 / 3, 1 / 3])
    picked, score = language.classify(["ab", "zq zq", "", "42"], names, logs, priors)
    assert picked == ["x", "y", "und", "und"] and score[2] == score[3] == 0


def test_language_cut_texts_score_as_whole_ones(monkeypatch):
    texts = ["abc def " * 40, "xyz", ""]
    whole = language.features([(i, t, 0) for i, t in enumerate(texts)])
    cut = [language.features(g) for g in common.segments(texts, 64, 3)]
    # a cut adds one blank at its end, nothing else
    assert abs(sum(len(c[0]) for c in cut) - len(whole[0])) <= 3 * len(cut)


def test_language_odd_rows(spark):
    table = docs(spark, ODD)
    got = language.identify(table, table).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (None, "fr"), (7, "fr")} <= by
    assert language.identify(table.limit(0), table).count() == 0
    assert {r.lang_pred for r in language.identify(table, table.limit(0)).collect()} == {"und"}


# --- tokens


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_tokens_equal_the_library(path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    merges, special = tokens.load(path)
    counter = tokens.WordCounter(merges)
    pick = random.Random(5)
    letters = "aaaeeesdmtlrv'''' \n\té漢ñ12٣.,!?😀\x00\x85AThe<|endoftext|>"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 80))) for _ in range(3000)]
    texts += ["it's we're 's 're", "a<|endoftext|>b<|endoftext|>", "", "  x", "\n\n a", "a" * 3000, "the" * 2000, "x'r"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.texts(texts, special).tolist() == want
    counter.forget()  # compiled anew in the middle of the work
    assert counter.texts(texts, special).tolist() == want


def test_state_maps_compose_to_the_same_words():
    pick = np.random.default_rng(3)
    kinds = pick.integers(0, 12, 5000).astype(np.uint8)
    whole = tokens.word_starts(kinds, 5000)
    for chunk in (1, 7, 64, 256):
        assert (tokens.word_starts(kinds, chunk) == whole).all()


def test_tokens_odd_rows(spark, path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    got = tokens.token_counts(docs(spark, ODD), path).collect()
    assert len(got) == len(ODD)
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, _ in ODD)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(docs(spark, ODD).limit(0), path).count() == 0


# --- secrets


def plain_spans(text):
    """The base spans by searching with the patterns as they are stated."""
    text = text or ""
    found = [
        ("assign", m.start(), m.end())
        for m in re.finditer(secrets.ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 12
    ]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_match_plain_search():
    scanner = secrets.Scanner()
    pick = random.Random(1)
    words = ["token", "Secret", "PASSWORD", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA",
             "A1B2C3D4E5F6G7H8", "0123456789abcdef", "abcdefghijkl", "secret=token:abcdefghijklm", "É", "İ", "ſecret", "K", "x"]
    for _ in range(4000):
        text = "".join(pick.choice(words) for _ in range(pick.randint(0, 14)))
        assert [s for s in scanner.spans(text) if s[0] in secrets.BASE] == plain_spans(text), text


def test_secrets_checksum():
    body = "A" * 30
    good = body + secrets._base62(zlib.crc32(body.encode()), 6)
    scanner = secrets.Scanner()
    assert ("github", 2, 42) in scanner.spans(f"x ghp_{good} y")
    assert ("npm", 0, 40) in scanner.spans(f"npm_{good}")
    assert not [s for s in scanner.spans(f"ghp_{body}000000") if s[0] == "github"]


def test_secrets_query(spark, folder):
    got = {r.doc_id: r for r in secrets.op9_secret_scan(spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = plain_spans(row.text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[row.doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert got[row.doc_id].n_hex == sum(k == "hex" for k, _, _ in spans)


def test_secrets_odd_rows(spark):
    table = docs(spark, [*ODD, (11, "token=abcdefghijklmnop " * 20000, None)])
    got = secrets.scan_secrets(table).select("doc_id", F.size("secrets").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in got if r.n) == [(11, 20000)]
    assert len(got) == len(ODD) + 1
    assert secrets.scan_secrets(table.limit(0)).count() == 0


# --- context mixing


def base_by_hand(texts, held):
    words = [(t or "").encode().lower().split() + [b""] for t in texts]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return [
        (len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws))
        for ws in words
    ]


def test_context_mix_base_and_model(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    got = context_mix.op1_context_mix(spark, folder).orderBy("doc_id").collect()
    assert [r.held_out for r in got] == held
    for r, want in zip(got, base_by_hand([r.text for r in rows], held)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert math.isclose(r.base_score, want[3], rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    # far better than a code of eight bits, on texts it has not seen too
    assert np.mean([r.bits_per_byte for r in got if r.held_out]) < 4


def test_context_mix_bytes_sum_to_one():
    weights, cells = context_mix.first_weights(), context_mix.first_cells()
    pick = np.random.default_rng(0)
    mixer = context_mix.Mixer(pick.integers(0, 1 << 16, context_mix.OFFSETS[-1]).astype(np.uint16), weights, cells)
    context = np.uint64(0x6162636465) << np.uint64(8)
    windows = np.stack([context | np.arange(256, dtype=np.uint64), np.full(256, 99, dtype=np.uint64)])
    assert math.isclose(np.exp2(mixer.log2(windows)).sum(), 1, rel_tol=1e-5)


def test_context_mix_tables_do_not_depend_on_partitions(spark, monkeypatch):
    texts = spark.createDataFrame([(f"text {i} of {i % 3} words",) for i in range(40)], "text string")
    whole = context_mix.count_tables(texts.coalesce(1))
    monkeypatch.setattr(context_mix, "FAN", 2)
    assert (context_mix.count_tables(texts.repartition(7)) == whole).all() and whole.any()


def test_context_mix_predicts_white_space():
    assert context_mix.text_bytes(" A\n\tb  c ") == b" a\n\tb  c \0\0"
    untrained = context_mix.Mixer(
        np.zeros(context_mix.OFFSETS[-1], dtype=np.uint16), context_mix.first_weights(), context_mix.first_cells()
    )
    short, padded = context_mix.scores(untrained, ["word", "word" + " " * 1000])
    assert padded < short - 1000  # a model that knows nothing pays eight bits for each blank


def test_context_mix_learns_alike_however_texts_are_split(spark, monkeypatch):
    rows = [f"text {i} of {i % 7} words" for i in range(900)]
    texts = spark.createDataFrame([(t,) for t in rows], "text string")
    tables = context_mix.count_tables(texts)
    weights, cells, count = context_mix.learn(tables, texts.repartition(3))
    assert (weights != context_mix.first_weights()).any() and ((cells > 0) & (cells < 1)).all()
    bytes_ = sum(len(context_mix.text_bytes(t)) for t in rows)
    assert 0 < count < bytes_ / 4
    monkeypatch.setattr(context_mix, "PIECE", 100)
    again = context_mix.learn(tables, texts.repartition(8))
    assert (again[0] == weights).all() and (again[1] == cells).all() and again[2] == count


def test_context_mix_chosen_windows_are_a_share_of_the_distinct_ones(spark):
    texts = spark.createDataFrame([(f"one{i} two{i * i} three{i * 7919}",) for i in range(3000)], "text string")
    found, count = context_mix.chosen_windows(texts.union(texts))
    every = np.unique(context_mix.text_windows([context_mix.text_bytes(t) for (t,) in texts.collect()])[0], axis=1).shape[1]
    assert abs(count * context_mix.SHARE / every - 1) < 0.2
    assert {r.times % 2 for r in found.collect()} == {0}


def windows_by_hand(texts):
    """How often each window occurs in texts."""
    windows = context_mix.text_windows([context_mix.text_bytes(t) for t in texts])[0]
    return collections.Counter(zip(*windows.tolist()))


def test_context_mix_learns_from_every_window(spark, monkeypatch):
    rows = [f"one{i % 50} two{i * i} three{i % 7} É\0" for i in range(300)] + ["", "same text"] * 20
    texts = spark.createDataFrame([(t,) for t in rows], "text string").repartition(5)
    want = windows_by_hand(rows)
    for size in (1 << 23, 1000):
        monkeypatch.setattr(context_mix, "PART", size)
        chosen, count = context_mix.chosen_windows(texts)
        got = chosen.collect()
        found = collections.Counter()
        for r in got:
            _, windows, times = context_mix.unpack_windows(bytes(r.data), r.n)
            assert len(times) == r.n and times.sum() == r.times
            found.update(dict(zip(zip(*windows.tolist()), times.tolist())))
        assert found == want and count == len(want) == sum(r.n for r in got)
        assert len(got) == len({r.part for r in got}) and (len(got) > 1) == (size == 1000)
    assert context_mix.learn(context_mix.count_tables(texts), texts)[2] == len(want)


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_context_mix_held_windows_are_those_given(monkeypatch, bits):
    monkeypatch.setattr(context_mix, "HELD_BITS", bits)
    groups = [[f"text {i} of {i % k} words " * 2 for i in range(40)] for k in (3, 5, 3)]
    gathered = context_mix.Gathered()
    pick = np.random.default_rng(0)
    mixer = context_mix.Mixer(
        pick.integers(0, 1 << 16, context_mix.OFFSETS[-1]).astype(np.uint16), context_mix.first_weights(), context_mix.first_cells()
    )
    scored, found = context_mix.Scored(mixer), collections.Counter()
    for number, group in enumerate(groups):
        windows = context_mix.text_windows([context_mix.text_bytes(t) for t in group])[0]
        gathered.add(windows)
        assert np.allclose(scored.log2(windows), mixer.log2(windows), rtol=1e-6)
        if number == 1:
            spare, times = gathered.take_spare()
            found.update(dict(zip(zip(*spare.tolist()), times.tolist())))
    rest, times = gathered.take_all()
    for window, n in zip(zip(*rest.tolist()), times.tolist()):
        found[window] += n
    assert found == windows_by_hand(sum(groups, []))


class Counting:
    """A mixer that counts the windows it predicts."""

    def __init__(self, mixer):
        self.mixer, self.predicted = mixer, 0

    def log2(self, windows):
        self.predicted += windows.shape[1]
        return self.mixer.log2(windows)


def random_mixer():
    pick = np.random.default_rng(0)
    return context_mix.Mixer(
        pick.integers(0, 1 << 16, context_mix.OFFSETS[-1]).astype(np.uint16), context_mix.first_weights(), context_mix.first_cells()
    )


def test_context_mix_frequent_windows_are_not_predicted_again(monkeypatch):
    monkeypatch.setattr(context_mix, "HELD_BITS", 12)
    texts = [context_mix.text_bytes(f"text {i} of {i % 5} words") for i in range(200)]
    windows = context_mix.text_windows(texts)[0]
    known = context_mix._distinct(context_mix.text_windows(texts[:100])[0])[0]
    mixer = random_mixer()
    for frequent, held in ((None, 0), ((context_mix.window_keys(known), mixer.log2(known)), known.shape[1])):
        counting = Counting(mixer)
        scored = context_mix.Scored(counting, frequent)
        for _ in range(2):
            assert np.allclose(scored.log2(windows), mixer.log2(windows), rtol=1e-6)
        every = context_mix._distinct(windows)[0].shape[1]
        if frequent is None:
            alone = counting.predicted
        assert counting.predicted >= every - held
    assert counting.predicted < alone


def test_context_mix_frequent_windows_are_the_most_frequent(spark, monkeypatch):
    rows = ["often said"] * 50 + ["seldom said"] * 3 + [f"once {i * 7919}" for i in range(100)]
    texts = spark.createDataFrame([(t,) for t in rows], "text string").repartition(4)
    every = windows_by_hand(rows)
    times = dict(zip(context_mix.window_keys(np.array(list(every), dtype=np.uint64).T).tolist(), every.values()))
    for most in (1 << 20, 20, 5, 0):
        monkeypatch.setattr(context_mix, "FREQUENT", most)
        sent, weights, cells, (keys, logs) = context_mix._model(texts)
        assert len(set(keys.tolist())) == len(keys) == len(logs) <= most
        held = [times[k] for k in keys.tolist()]
        assert held == sorted(held)
        # a class of windows that occur about as often is taken as a whole or not at all
        least = min(held, default=math.inf)
        assert sorted(held) == sorted(n for n in times.values() if n >= max(least, 2))
        assert most < 1 << 20 or least == 2
        if held:
            windows = np.array(list(every), dtype=np.uint64).T
            want = dict(zip(context_mix.window_keys(windows).tolist(), context_mix.Mixer(sent.value, weights, cells).log2(windows)))
            assert np.allclose([want[k] for k in keys.tolist()], logs)


def test_context_mix_learner_steps_do_not_depend_on_the_group(monkeypatch):
    texts = [context_mix.text_bytes(f"text {i} of {i * i % 50} words") for i in range(300)]
    windows, times, _ = context_mix._distinct(context_mix.text_windows(texts)[0])
    monkeypatch.setattr(context_mix, "STEP", 16)
    got = []
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(context_mix, "CHUNK", size)
        learner = context_mix.Learner(random_mixer().tables, context_mix.first_weights(), np.full((context_mix.SETS, context_mix.TABLES), 1e-8))
        learner.run(windows, times)
        got.append(learner)
        assert (learner.mixer.weights == got[0].mixer.weights).all() and (learner.past == got[0].past).all()
        assert np.allclose(learner.sums(), got[0].sums())
    assert (got[0].mixer.weights != context_mix.first_weights()).any() and got[0].often.sum() == len(times)


def test_context_mix_gathered_windows_leave_no_table(monkeypatch):
    monkeypatch.setattr(context_mix, "HELD_BITS", 8)
    gathered = context_mix.Gathered()
    gathered.add(context_mix.text_windows([b"some text, some more\0\0"])[0])
    gathered.take_all()
    assert not [v for v in vars(gathered).values() if isinstance(v, np.ndarray)]


def test_context_mix_coded_words_are_those_split_by_hand():
    texts = ["A b  a", "", " \n", "É\u00a0x É \x1f \x1c q", "tail\t\r", "\v\fa", "w" * 15 + " " + "W" * 16 + " " + "w" * 16, "é" * 8, "\0 z"]
    for column in (pa.array(texts), pa.array(["drop me", *texts, "x"]).slice(1, len(texts))):
        rows, codes, keys = context_mix.coded_words(column)
        got = collections.Counter((int(r), keys[int(c)].as_py()) for r, c in zip(rows, codes))
        want = collections.Counter(
            (i, context_mix.token_key(w)) for i, t in enumerate(texts) for w in [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b""]
        )
        assert got == want
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])] * 2
    counted = collections.Counter()
    for batch in context_mix._count_words(iter(batches)):
        counted.update(dict(zip(batch["token"].to_pylist(), batch["c"].to_pylist())))
    assert counted == collections.Counter(k for _, k in want.elements()) + collections.Counter(k for _, k in want.elements())


def test_context_mix_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(context_mix, "WORD_ROWS", 4)
    monkeypatch.setattr(context_mix, "WORD_BYTES", 10)
    texts = ["abc", "", "x" * 30, "y" * 10, "z" * 9, "", "", "", "", "é", "q" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(["cut", *texts])], names=["key", "text"]).slice(1)
    parts = [part["text"].to_pylist() for part in context_mix._slices(batch, 1)]
    assert sum(parts, []) == texts and all(parts)
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len(t.encode()) for t in p) <= 10) for p in parts)
    assert not list(context_mix._slices(batch.slice(0, 0), 1))


def test_context_mix_words_of_many_slices(monkeypatch):
    monkeypatch.setattr(context_mix, "WORD_ROWS", 2)
    monkeypatch.setattr(context_mix, "KEPT_WORDS", 5)
    texts = [f"w{i % 3} x{i}" + " w0" * (i % 4) for i in range(40)]
    counts = collections.Counter()
    for batch in context_mix._count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for token, c in zip(batch["token"].to_pylist(), batch["c"].to_pylist()):
            counts[token] += c
    assert counts == collections.Counter(w for t in texts for w in [*t.encode().split(), b""])


def test_context_mix_numbers_that_add_up_past_32_bits():
    windows, times = np.arange(10, dtype=np.uint64).reshape(2, 5), np.array([1, 1 << 31, 1 << 31, 5, 1 << 40])
    got = list(context_mix._limited(windows, times))
    assert all(int(t.sum(dtype=np.int64)) < 1 << 32 for _, t in got)
    assert np.concatenate([t for _, t in got]).tolist() == [1, 1 << 31, 1 << 31, 5, (1 << 32) - 1]
    assert (np.concatenate([w for w, _ in got], axis=1) == windows).all()


M, A, D = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def slots_by_hand(data, at):
    """``(slot, bit)`` per bit and table of the byte ``at`` of a text, from the whole text before it."""
    word = at
    while word and data[word - 1] not in b" \t\n\r\v\f\0":
        word -= 1
    root = pow(D, -1, 1 << 64)
    total = sum((c + 1) * pow(root, i, 1 << 64) for i, c in enumerate(data[word:at])) & M
    hashes = []
    for number in range(5):
        past = int.from_bytes(data[max(0, at - number - 1) : at], "big")
        mixed = (past + number) * A & M
        hashes.append(mixed ^ mixed >> 31)
    hashes.append((total ^ total >> 29) * A & M)
    byte = data[at]
    for k in range(8):
        half = 0 if k < 4 else 4
        before = byte >> 8 - half | 1 << half
        inner = (byte >> 8 - k) % (1 << k - half) | 1 << k - half
        own = []
        for number, (h, bits) in enumerate(zip(hashes, context_mix.TABLE_BITS)):
            start = ((h ^ pow(D, before + 1, 1 << 64)) * A & M) >> 64 - bits
            own.append(sum(1 << b for b in context_mix.TABLE_BITS[:number]) + (start ^ inner))
        yield k, byte >> 8 - k | 1 << k, own, byte >> 7 - k & 1


def score_by_hand(data, counts, weights, cells):
    """log10 of the probability of a text, bit by bit."""
    total = 0.0
    for at in range(len(data)):
        for k, before, own, bit in slots_by_hand(data, at):
            odds, details = [], []
            for slot in own:
                zeros, ones = (2 ** (min(255, round(8 * math.log2(1 + n))) / 8) - 1 for n in counts[slot])
                odds.append(math.log((ones + 0.05) / (zeros + 0.05)) if zeros + ones > 0.01 else 0)
                seen = zeros + ones
                details.append(1 + int(min(math.log2(max(seen, 1)) / 2, 3)) if seen > 0.5 else 0)
            known = max((n for n in range(5) if details[n]), default=None)
            gate = (0 if known is None else known * 4 + details[known]) * 5 + details[5]
            rows = gate, context_mix.GATES + before, context_mix.GATES + 256 + details[5] * 8 + k
            mixed = max(-12, min(12, sum(o * sum(weights[r][n] for r in rows) for n, o in enumerate(odds))))
            place = (max(-7.999, min(7.999, mixed)) + 8) * 2
            low = int(place)
            mapped = cells[gate][low] * (1 - place + low) + cells[gate][low + 1] * (place - low)
            one = max(1e-6, min(1 - 1e-6, (1 / (1 + math.exp(-mixed)) + mapped) / 2))
            total += math.log10(one if bit else 1 - one)
    return total


def test_context_mix_against_a_plain_version(spark):
    texts = ["the cat sat on the mat", "The dog  sat\non the cat", "", "É 漢字", "the cat sat on the mat"] * 3
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    model = context_mix.train(table)
    counts = collections.defaultdict(lambda: [0, 0])
    for text in texts:
        data = context_mix.text_bytes(text)
        for at in range(len(data)):
            for _, _, own, bit in slots_by_hand(data, at):
                for slot in own:
                    counts[slot][bit] += 1
    tests = [*texts[:5], "a new text on cats", "word " * 20]
    got = context_mix.scores(context_mix.Mixer(*model), tests)
    for text, score in zip(tests, got):
        assert math.isclose(score, score_by_hand(context_mix.text_bytes(text), counts, *model[1:]), rel_tol=1e-4)


def test_word_hashes_do_not_depend_on_the_place():
    flat = np.frombuffer(b"the cat the", dtype=np.uint8)
    got, _ = context_mix.word_hashes(flat)
    assert (got[:3] == got[8:11]).all() and len({*got[:4].tolist(), *got[5:8].tolist()}) == 7


@pytest.mark.parametrize("size", [1, 3, 17, 64])
def test_context_mix_pieces_of_long_texts(monkeypatch, size):
    texts = [b"abc def ghi " * 10, b"x", b"", b"one very" + b"long" * 40 + b" word"]
    whole = [context_mix.text_windows([t])[0] for t in texts if t]
    monkeypatch.setattr(context_mix, "PIECE", size)
    seen = collections.defaultdict(list)
    for first, windows, sizes in context_mix.pieces(texts):
        for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
            seen[first + i].append(windows[:, a : a + n])
    for i, want in zip((0, 1, 3), whole):
        assert (np.concatenate(seen[i], axis=1) == want).all()


def test_context_mix_odd_rows(spark):
    table = docs(spark, ODD)
    got = context_mix.score_texts(table, common.remainder("doc_id", 7) == 2).collect()
    assert len(got) == len(ODD)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in ODD]
    want = collections.Counter((i, *b[:3]) for (i, _, _), b in zip(ODD, base_by_hand([t for _, t, _ in ODD], held)))
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    same = [r.score for r in got if r.doc_id == 5]
    assert same[0] == same[1]
    assert context_mix.score_texts(table.limit(0), F.lit(False)).count() == 0
    untrained = context_mix.score_texts(table, F.lit(True)).collect()
    assert {r.n_known for r in untrained} == {0} and all(math.isfinite(r.score) for r in untrained)
