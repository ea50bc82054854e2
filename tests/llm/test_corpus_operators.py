"""Operators that compare or rewrite rows, and the pipeline, against plain versions."""

import collections
import html
import re
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagesim.llm import decontaminate, embedding_graph, main_text, poisson_mix, simhash, surrogates

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, row int, key string"
FILL = ("en", "s", None, 1, "d", 2, "k")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *FILL) for i, t in rows], DOCS)


# --- SimHash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum((2 * n > len(shingles)) << i for i, n in enumerate(ones))


def components_by_hand(keys, prints, radius=3):
    prints = np.array(prints, dtype=np.uint64)
    label = list(range(len(keys)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= radius):
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    groups = collections.defaultdict(list)
    for i, key in enumerate(keys):
        groups[root(i)].append(key)
    first = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [first[root(i)] for i in range(len(keys))]


def test_simhash_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    got = simhash.op10_simhash_neardup(spark, folder).orderBy("doc_id").collect()
    prints = [fingerprint(r.text) for r in rows]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == components_by_hand([r.doc_id for r in rows], prints)


def test_simhash_trees_keep_every_pair(spark):
    pick = np.random.default_rng(2)
    points = pick.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = points[:700] ^ (np.uint64(1) << pick.integers(0, 64, 700).astype(np.uint64))
    tight = points[0] ^ pick.integers(0, 1 << 12, 600).astype(np.uint64)  # a group that no vantage point cuts
    points = np.unique(np.concatenate([points, flips, tight]))
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    edges = simhash.links(table, cell=100).collect()
    order = np.argsort(points.view(np.int64))
    keys = points.view(np.int64)[order].tolist()
    want = components_by_hand(keys, points[order])
    label = {k: k for k in keys}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in edges:
        assert np.bitwise_count(np.uint64(a & (1 << 64) - 1) ^ np.uint64(b & (1 << 64) - 1)) >= 0
        x, y = sorted((root(a), root(b)))
        label[y] = x
    assert [root(k) for k in keys] == want


def test_simhash_odd_rows(spark):
    rows = [(3, None), (2, ""), (5, "a b c d e f"), (4, "A b C d e f"), (None, "a b c d e f"), (4, "a b c d e f"),
            (7, "one"), (8, "x " * 50000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    want = components_by_hand([k for k, _ in rows], [fingerprint(t) for _, t in rows])
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter(zip((k for k, _ in rows), want))
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


# --- decontamination

ITEM = "A train leaves Boston at 60 km/h and Alice has 12 apples. How many apples does Alice keep after giving 5 kg away?"


def test_decontamination_finds_new_numbers_and_names(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "two words"), (3, None), (4, ""), (9, ITEM)], "item_id long, text string")
    other = ITEM.replace("60", "75").replace("12", "30").replace("Alice", "Bob").replace("Boston", "Denver")
    rows = [(10, f"Intro here. {other} And so on."), (11, "Intro. " + other.replace("does Bob", "does Carol")),
            (12, "xx two words yy"), (13, None), (14, ""), (15, ITEM), (15, ITEM), (None, ITEM),
            (16, "A train leaves the station and nobody has apples at all in the end of this story"),
            (17, "well " * 20000 + ITEM)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 2), (15, 1), (17, 1)}
    assert not got[10, 1].verbatim and got[10, 1].covered == got[10, 1].words
    assert got[15, 1].verbatim and got[17, 1].verbatim
    assert got[11, 1].covered < got[11, 1].words  # the slot that contradicts the others is left out
    assert decontaminate.leaks(docs(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_rejects_inconsistent_fillings(spark):
    item = "if x has NAME apples then y eats".replace("NAME", "7") + " 7 pears and 7 plums with 7 nuts for 7 days"
    wild = item.replace("7 pears", "8 pears").replace("7 plums", "9 plums").replace("7 nuts", "3 nuts").replace("7 days", "4 days")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, [(1, item.replace("7", "5")), (2, wild)]), bench)
    assert [r.doc_id for r in got.collect()] == [1]


def test_decontamination_finds_copies_that_are_all_slots(spark):
    items = ["The Quick Brown Fox Jumps Over Every Lazy Dog In Town", "a plain item with nothing but words of no note in it",
             "2 4 6 8 10 12 14 16 18 20", "Which Paris River 7", "Mary Ann Gave Tom Lee The Old Red Boat At Noon"]
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    rows = [(f"d{i}", f"So it goes on here. {t} and then some") for i, t in enumerate(items)]
    rows += [("up", items[1].upper()), ("low", items[0].lower()), ("no", "2 4 6 9 10 12 15 16 18 21 Which Paris Museum 8")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id string, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(f"d{i}", f"i{i}") for i in range(5)} | {("up", "i1"), ("low", "i0")}
    assert all(r.verbatim for r in got)


def brute_template_windows(words, slots, size):
    """The windows of a text as tuples of words and placeholders, by plain Python."""
    return {at: tuple("#" if s else w for w, s in zip(words[at : at + size], slots[at : at + size])) for at in range(len(words) - size + 1)}


def test_template_windows_equal_brute_force(spark):
    texts = ["we bought 12 apples and 3 plums today for Anna and for Tom in Rome", "no slot is in these nine words at all"]
    want = collections.Counter()
    for key, text in enumerate(texts):
        words = text.split()
        slots = [w[0].isdigit() or (w[0].isupper() and i > 0) for i, w in enumerate(words)]
        for at, window in brute_template_windows(words, slots, decontaminate.WINDOW).items():
            want[key, at, tuple(w if s else "" for w, s in zip(words[at:], slots[at : at + 8]))] += 1
            if any(slots[at : at + 8]):
                want[key, at, ("",) * 8] += 1  # the window by its own words
    table = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = decontaminate.windows(table).collect()
    lower = lambda slots: tuple(s.lower() for s in slots)
    assert collections.Counter((r.key, r.at, lower(r.slots)) for r in got) == collections.Counter(
        {(k, a, lower(s)): n for (k, a, s), n in want.items()}
    )
    by_form = {}
    for r in got:
        by_form.setdefault(r.hash, set()).add((r.key, r.at, r.literals))
    assert all(len(places) == 1 for places in by_form.values())


def test_decontamination_covers_plain_passages(spark, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    plain = lambda t: " ".join(t.lower().split())
    want = {
        r.doc_id for r in rows for b in bench
        if (words := plain(b.text).split()) and " ".join(words[1:-1]) in plain(r.text)
    }
    got = {r.doc_id for r in decontaminate.op6_decontamination(spark, folder).collect()}
    assert want <= got
    shared = lambda r: any(" ".join(b[i : i + 6]) in plain(r.text) for b in split for i in range(len(b) - 5))
    split = [plain(b.text).split() for b in bench]
    assert all(shared(r) for r in rows if r.doc_id in got)


# --- PII


def test_pii_keeps_type_format_gender_and_identity(spark):
    rows = [
        (1, "Mail A.Bee.23@mail3.example.com or a.bee.23@mail3.example.com, +1 (017) 555-7713, +10175557713."),
        (2, "card 4485275742308327 not 1234567812345678 at 10.2.3.4 or 999.2.3.4"),
        (3, "Mrs. Anna Berg met Frau Berg and JOHN BERG; John Smith, г-жа Анна Иванова"),
        (4, None), (5, ""), (6, "nothing here"), (6, "nothing here"), (None, "card 4485-2757-4230-8327"),
        (7, "x@y.co " * 3000),
    ]
    got = surrogates.replace_pii(docs(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "fp", "digest", "row", "key", "n_replaced"}
    by = {r.doc_id: r for r in got}
    mails = re.findall(r"\S+@[\w.]+\w", by[1].text)
    assert mails[0] == mails[1] and re.fullmatch(r"[a-z]\.[a-z]{3}\.\d\d@.*\.com", mails[0]) and "bee" not in mails[0]
    spaced, plain = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[1].text)[0], re.search(r"\+1\d{10}", by[1].text)[0]
    assert re.sub(r"\D", "", spaced) == plain[1:] != "10175557713"
    card = re.search(r"card (\d{16}) not 1234567812345678", by[2].text)[1]
    assert card != "4485275742308327" and re.sub("-", "", by[None].text) == f"card {card}"
    digits = [int(d) for d in card][::-1]
    assert sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    assert "999.2.3.4" in by[2].text and "10.2.3.4" not in by[2].text.replace("999.2.3.4", "")
    title, given, surname = re.match(r"(Mrs\.) (\S+) (\S+) met Frau", by[3].text).groups()
    assert given in surrogates.GIVEN["f", "latin"] and f"Frau {surname}" in by[3].text and surname != "Berg"
    russian = re.search(r"г-жа (\S+) (\S+)$", by[3].text)
    assert russian[1] in surrogates.GIVEN["f", "cyrillic"] and re.fullmatch(r"[а-яА-Я]+", russian[2])
    assert by[4].text is None and by[5].text == "" and by[6].n_replaced == 0
    assert by[7].n_replaced == 3000 and len(set(by[7].text.split())) == 1
    assert surrogates.replace_pii(docs(spark, rows).limit(0)).count() == 0


def test_pii_finds_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 05/27", f"{card} 123", f"12 {card}", f"1234 {card} 5500-0000-0000-0004.", "3782 822463 10005 12", f"{card} 05x"]
    texts += ["7 " * 30000 + card, "2001 2002 2003 2004 2005", "0 4111111111111111 9"]
    got = {r.doc_id: r for r in surrogates.replace_pii(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i].n_replaced for i in range(9)] == [1, 1, 1, 2, 1, 1, 1, 0, 1]
    for i, kept in enumerate((r"{} 05/27", r"{} 123", r"12 {}", r"1234 {} \d{{4}}-\d{{4}}-\d{{4}}-\d{{4}}\.")):
        assert re.fullmatch(kept.format(r"(?!4111 1111)\d{4} \d{4} \d{4} \d{4}"), got[i].text)
    assert re.fullmatch(r"\d{4} \d{6} \d{5} 12", got[4].text) and got[6].text.startswith("7 7 ") and got[7].text == texts[7]


def test_pii_surrogates_stay_distinct(spark):
    names = surrogates.GIVEN["f", "latin"]
    rows = [("given", "f", "latin", n.lower()) for n in names] + [("ip", "n", "latin", f"10.0.{i}.1") for i in range(200)]
    entities = spark.createDataFrame(rows, "type string, gender string, script string, norm string")
    drawn = surrogates.draw_distinct(entities, "k").collect()
    assert len({(r.type, r.surrogate) for r in drawn}) == len(rows) == len(drawn)
    assert not {(r.type, r.surrogate) for r in drawn} & {(t, n) for t, _, _, n in rows}
    other = surrogates.draw_distinct(entities, "another key").collect()
    assert {(r.norm, r.surrogate) for r in drawn} != {(r.norm, r.surrogate) for r in other}


def test_pii_ends_where_all_numbers_of_a_length_are_taken(spark):
    rows = [("phone", "n", "latin", f"1{i:02d}") for i in range(100)] + [("ssn", "n", "latin", str(i)) for i in range(10)]
    entities = spark.createDataFrame(rows, "type string, gender string, script string, norm string")
    drawn = surrogates.draw_distinct(entities, "k").collect()
    assert len({(r.type, r.surrogate) for r in drawn}) == len(rows)
    assert not {(r.type, r.surrogate) for r in drawn} & {(r[0], r[3]) for r in rows}


def test_pii_longer_numbers_are_written_whole(spark):
    row = spark.createDataFrame([("+1 23-45", "9876543")], "raw string, new string")
    assert row.select(surrogates._written(F.col("raw"), F.col("new"), F.lit("phone")).alias("x")).first().x == "+9 87-6543"


def test_pii_gives_up_when_nothing_is_left(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "DRAWS", 3)
    entities = spark.createDataFrame([("ssn", "n", "latin", str(i)) for i in range(10)], "type string, gender string, script string, norm string")
    with pytest.raises(RuntimeError, match="3 draws"):
        surrogates.draw_distinct(entities, "k")


def test_pii_one_gender_per_name(spark):
    texts = ["Dr Kim Berg and Mrs Kim Berg met Mr James Roth.", "Prof Kim Stein, Mrs Kim Stein", "Mail JOHN@EXAMPLE.COM or john@example.com", None]
    got = [r.text for r in surrogates.replace_pii(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    first, second = re.fullmatch(r"Dr (\S+ \S+) and Mrs (\S+ \S+) met Mr \S+ \S+\.", got[0]).groups()
    assert first == second and first.split()[0] in surrogates.GIVEN["f", "latin"]
    assert first.split()[0] in got[1] and got[1].count(first.split()[0]) == 2
    upper, lower = re.fullmatch(r"Mail (\S+) or (\S+)", got[2]).groups()
    assert upper == lower.upper() and lower != "john@example.com" and got[3] is None


def test_pii_leaves_the_rest_alone(spark, folder):
    got = {r.doc_id: r for r in surrogates.op2_pii_surrogates(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(rows)
    found = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}")
    for r in rows:
        assert not set(found.findall(r.text)) & set(found.findall(got[r.doc_id].text))
        if not got[r.doc_id].n_replaced:
            assert got[r.doc_id].text == r.text


# --- Poisson mixing


def test_mix_draws_follow_the_distribution(spark):
    rows = [(i, "t", "en", f"s{i % 4}" if i % 4 else None, None, 1, "d", 2, "k") for i in range(20000)]
    table = spark.createDataFrame(rows, DOCS)
    weights = {None: 0.1, "s1": 20.0, "s2": 0.0}
    got = poisson_mix.replicate(table, weights).select("doc_id", "source", "copy", "mix_key")
    sizes = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    total = 0.1 + 20 + 1
    for source, weight in ((None, 0.1), ("s1", 20.0), ("s3", 1.0)):
        mean = 20000 * weight / total
        assert abs(sizes[source] - mean) < 5 * np.sqrt(mean)
    assert "s2" not in sizes
    counts = collections.Counter(r.doc_id for r in got.filter("source = 's1'").collect())
    values = np.array([counts[i] for i in range(20000) if i % 4 == 1])
    rate = 20000 * 20 / total / 5000
    assert abs(values.var() / rate - 1) < 0.1
    assert got.select("mix_key").distinct().count() == got.count()


def test_mix_odd_rows(spark):
    table = docs(spark, [(1, None), (1, None), (None, ""), (2, "x")])
    again = poisson_mix.replicate(table, {"s": 1.0}).collect()
    assert again == poisson_mix.replicate(table, {"s": 5.0}).collect()
    assert table.columns + ["copy", "mix_key"] == list(again[0].asDict() if again else table.columns + ["copy", "mix_key"])
    assert poisson_mix.replicate(table.limit(0)).count() == 0
    assert poisson_mix.replicate(table, {"s": 0.0}).count() == 0


def test_mix_rows_without_a_key_reach_their_weights(spark):
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i % 3 == 0 else i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(6000)]
    got = poisson_mix.replicate(spark.createDataFrame(rows, plain), {"s0": 1.0, "s1": 9.0})
    sizes = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(sizes["s0"] - 600) < 5 * 600**0.5 and abs(sizes["s1"] - 5400) < 5 * 5400**0.5
    null = got.filter("doc_id is null").count()
    assert abs(null - 2000) < 5 * 2000**0.5
    assert got.select("mix_key").distinct().count() == got.count()


def test_mix_equals_its_sql_on_odd_rows(spark):
    import duckdb

    rows = [(1, "a", "en", "src1", 1)] * 500 + [(None, None, None, None, None)] * 300 + [(None, "", "en", "src3", 0)] * 3
    rows += [(i % 40, f"t{i % 90}", "en", f"src{i % 5}", i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("odd", table.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = con.execute(poisson_mix.OP4_SQL.format(docs="odd")).fetchall()
    got = [tuple(r) for r in poisson_mix.replicate(table, poisson_mix.WEIGHTS).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r[-1] for r in got}) == len(got) > 100


def test_mix_keeps_columns_of_any_name(spark):
    names = ["digest", "number", "row", "pieces", "cdf", "name", "count", "a.b", "source"]
    table = spark.createDataFrame([(*range(8), "s")] * 50 + [(*range(1, 9), None)] * 50, names)
    got = poisson_mix.replicate(table)
    assert got.columns == [*names, "copy", "mix_key"] and 40 < got.count() < 180
    assert {tuple(r)[:-2] for r in got.collect()} == {(*range(8), "s"), (*range(1, 9), None)}


# --- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a>More, here.</a></ul></nav><div class="ad">Buy, now. And more, much more of it.</div>
<article class="post comments-open"><h1>Head &amp; line</h1><p><b>First, part.<br>Second   line.<p>Third &copy; &#233;, is here.
<ul><li>One, item.</ul></article><aside>Side, bar. Text.</aside><section id="comments"><p>I, too. Like it, a lot. Really.</p></section>
<form>Sign, up. <input></form><footer>&copy; foot, note.</footer>"""


def test_main_text_of_a_page():
    assert main_text.main_text(PAGE) == "Head & line First, part. Second line. Third © é, is here. One, item."


def test_main_text_query(spark, folder):
    got = {r.page_id: r for r in main_text.op8_main_text(spark, folder).collect()}
    for page in spark.read.parquet(f"{folder}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page.html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", body))).split())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("<nav>a</nav>", ""), ("<!-- x", ""), ("<p>a<", "a<"),
    ("<p>a, b.<script>x", "a, b."), ("&lt;b&gt; it, is.", "<b> it, is."),
])
def test_main_text_odd_pages(page, want):
    assert main_text.main_text(page) == want


@pytest.mark.parametrize("icon", [
    "<svg class='i'/>", "<math/>", "<svg><path d='M0'><text>icon</text>", "<svg><style/></svg>", "<select><option>one<option>two",
    "<div><object data=x>no plug-in</div>", "<svg><title>icon</title><g>drawn</g></svg>", "<div><svg><path></div>",
])
def test_main_text_goes_on_after_icons(icon):
    assert main_text.main_text(f"<article>{icon}<p>First, part.</p><p>Second, part.</p></article>") == "First, part. Second, part."


def test_main_text_broken_markup_takes_linear_time():
    for page in ("<" * 200000, '<a "' * 50001, "<p>" * 50000 + "x", "<div><b>" * 40000, "</div>" * 50000, "<!--" * 50000):
        main_text.main_text(page)


PARAGRAPHS = "<p>First, part of a text, with words.</p><p>Second part, which is longer, has words. It has two sentences, too.</p><p>Short.</p>"
PLAIN = "First, part of a text, with words. Second part, which is longer, has words. It has two sentences, too. Short."
AROUND = (
    '<nav><a href="/">Home</a> <a href="/b">Blog</a></nav><div class="ad">Buy now, cheap.</div>%s<div class="comments">'
    "<p>I, too, think so. Thanks, all.</p><p>No, I do not think so; it is bad.</p></div><footer>Copyright, us.</footer>"
)


@pytest.mark.parametrize("names", [True, False])
@pytest.mark.parametrize("article", [
    '<div class="entry-content social-share-on">%s</div>', '<div id="content" class="with-sidebar side">%s</div>',
    '<main><div class="post legal">%s</div></main>', '<article><div class="tags-post">%s</div></article>',
])
def test_main_text_is_not_barred_by_names(article, names):
    page = article % PARAGRAPHS
    got = main_text.main_text(AROUND % page if names else page)
    assert got == PLAIN


def test_main_text_is_found_where_its_name_speaks_against_it():
    assert main_text.main_text(f'<div class="sidebar">{PARAGRAPHS}</div>') == PLAIN
    assert PLAIN in main_text.main_text(AROUND % f'<div class="sidebar">{PARAGRAPHS}</div>')


def test_main_text_keeps_lists_of_an_article():
    assert main_text.main_text(AROUND % f"<div>{PARAGRAPHS}<ul><li>one</li><li>two</li></ul></div>") == PLAIN + " one two"


def test_main_text_without_a_list_of_names(spark, folder, monkeypatch):
    pages = [p.html for p in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    with_names = [main_text.main_text(p) for p in pages]
    monkeypatch.setattr(main_text, "lowers", lambda names: False)
    assert [main_text.main_text(p) for p in pages] == with_names
    # without the article element too, the ratios alone lose nothing; an advert stays on 24 % of these 50 pages, 12 % of sf0.01
    plain = [main_text.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert all(w in g for g, w in zip(plain, with_names))
    # and they decide: with equal scores it stays far more often
    monkeypatch.setattr(main_text, "path_scores", lambda lengths, marks, paths: np.ones(len(lengths)))
    even = [main_text.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert sum(g != w for g, w in zip(plain, with_names)) < sum(g != w for g, w in zip(even, with_names)) / 2


def test_main_text_deep_nesting_is_linear():
    for page in ('<div class="content row">' * 200000 + "x", "<p>a<div>" * 100000):
        begin = time.process_time()
        tracemalloc.start() if page.endswith("<div>") else None
        main_text.main_text(page)
        if tracemalloc.is_tracing():
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 300 << 20
        else:
            assert time.process_time() - begin < 10  # about 2 s


def test_main_text_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert len(main_text.extract(pages).collect()) == 3
    assert main_text.extract(pages.limit(0)).count() == 0


# --- embeddings


def links_by_hand(vectors, least=0.9):
    rows = np.array([[0.0] * 8 if v is None or any(x is None or not np.isfinite(x) for x in v) else v + [0.0] * (8 - len(v)) for v in vectors])
    norms = np.linalg.norm(rows, axis=1)
    unit = rows / np.where(norms > 0, norms, 1)[:, None]
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    return linked


def check_links(spark, vectors, **settings):
    table = spark.createDataFrame([(i, v, 0, 5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, n int")
    got = embedding_graph.near_duplicates(table, **settings).orderBy("vec_id").collect()
    linked = links_by_hand([None if v is None else [x if x is None else float(np.float32(x)) for x in v] for v in vectors])
    assert [r.n_links for r in got] == linked.sum(axis=1).tolist()
    label = np.arange(len(vectors))
    for _ in range(len(vectors)):
        low = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    assert [r.component_id for r in got] == label.tolist()
    assert [r.kept for r in got] == (label == np.arange(len(label))).tolist()


def test_embedding_odd_rows(spark):
    one = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    check_links(spark, [
        one, one, [2.0] + one[1:], None, [], [0.0] * 8, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0],
        [1.0, 0.2] + [0.0] * 6, [0.0, 1.0], [0.0, 3.0], [1e-30, 0.0],
    ])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_graph.near_duplicates(empty).count() == 0


def test_embedding_groups_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "SHARD", 60)
    pick = np.random.default_rng(4)
    base = pick.normal(size=(300, 8))
    hot = base[0] + 0.05 * pick.normal(size=(150, 8))
    pairs = base[50:120] * 1.7 + 0.1 * pick.normal(size=(70, 8))
    check_links(spark, np.concatenate([base, hot, pairs, base[:20]]).tolist())


def test_embedding_effort_is_widened_and_then_all_is_compared(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "SHARD", 20)
    tried, search = [], embedding_graph._search
    monkeypatch.setattr(embedding_graph, "_search", lambda *given: tried.append(given[2]) or search(*given))
    pick = np.random.default_rng(6)
    around = pick.normal(size=(40, 8))
    spread = np.repeat(around, 10, axis=0) + 0.25 * pick.normal(size=(400, 8))  # links cross shards
    narrow = embedding_graph.Effort(*[1] * 6)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(spread.tolist())], "vec_id long, embedding array<double>")
    got = embedding_graph.near_duplicates(table, effort=narrow).orderBy("vec_id").collect()
    wanted, counts = links_by_hand(spread.tolist()).sum(axis=1), np.array([r.n_links for r in got])
    assert (counts <= wanted).all() and embedding_graph.recall_of(wanted[wanted > 0], counts[wanted > 0]) >= 0.99
    assert tried[0] == narrow and len(tried) > 1
    # no effort at all: the bound on angles loses nothing and spares some shards
    monkeypatch.setattr(embedding_graph, "ROUNDS", -1)
    tried.clear()
    check_links(spark, spread.tolist(), effort=narrow)
    assert tried == [None]


def test_embedding_recall_is_per_vector():
    recall = embedding_graph.recall_of
    assert recall(np.array([]), np.array([])) == 1
    # a hot group of 50 rows that all found its 1,000 links hides nothing, nor do small groups hide it
    wanted = np.array([1000] * 50 + [1] * 60)
    assert recall(wanted, np.array([1000] * 50 + [0] * 60)) == 0
    assert recall(wanted, np.array([0] * 50 + [1] * 60)) == 0
    assert recall(wanted, wanted) == 1


def edges_of(unit, effort):
    found = embedding_graph.robust_prune(unit, effort)
    a, k = np.nonzero(found >= 0)
    both = np.unique(np.concatenate([np.stack([a, found[a, k]]), np.stack([found[a, k], a])], axis=1), axis=1)
    return both[0], both[1]


def test_embedding_walk_decides_for_queries_that_are_no_nodes(monkeypatch):
    pick = np.random.default_rng(8)
    unit = embedding_graph._unit(pick.normal(size=(1500, 12)))
    asked = embedding_graph._unit(unit[::5] + 0.05 * pick.normal(size=(300, 12)))
    effort = embedding_graph.Effort()
    stored = {"ids": np.arange(1500), "n": np.ones(1500, dtype=int), "unit": unit, "places": np.zeros((1500, 1), dtype=int), "edges": edges_of(unit, effort)}
    queries = {"ids": np.arange(5000, 5300), "unit": asked, "places": np.zeros((300, 1), dtype=int)}
    wanted = (asked @ unit.T >= 0.9).sum(axis=1)
    got = embedding_graph.search_block(stored, queries, 0, 0.9, effort)[0]
    assert (got <= wanted).all() and got.sum() >= 0.97 * wanted.sum()
    still = embedding_graph.search_block(stored, queries, 0, 0.9, effort._replace(steps=0))[0]
    assert still.sum() < 0.5 * wanted.sum()
    assert embedding_graph.search_block(stored, queries, 0, 0.9, None)[0].tolist() == wanted.tolist()


def test_embedding_hubs_are_pruned_again():
    pick = np.random.default_rng(9)
    rim = pick.normal(size=(2000, 16))
    unit = embedding_graph._unit(np.concatenate([np.ones((1, 16)), 1 + 0.3 * rim]))
    effort = embedding_graph.Effort()
    row, to = edges_of(unit, effort)
    row, to = np.concatenate([np.zeros(2000, dtype=int), row]), np.concatenate([np.arange(1, 2001), to])
    order = np.argsort(row, kind="stable")
    graph = embedding_graph.walk_graph(unit, row[order], to[order], effort)
    assert graph.shape[1] <= 2 * effort.degree
    hub = graph[0][graph[0] >= 0]
    assert len(set(hub)) == len(hub) > 0 and 0 not in hub
    short = np.flatnonzero(np.bincount(row, minlength=2001) <= 2 * effort.degree)[:50]
    assert all(set(graph[r][graph[r] >= 0]) == set(to[row == r]) for r in short)


# --- pipeline


def test_pipeline_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    kept = documents
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        assert after.columns == documents.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}
    mixed = pipeline.run(spark, folder)
    assert mixed.columns == documents.columns + ["copy", "mix_key"]
    assert mixed.count() > 0


def test_pipeline_odd_rows(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, new int"
    rows = [(1, None, None, None, None, 1.0, 1, 1), (2, "the cat sat on the mat here", "en", "s", 27, 1.0, 1, 1),
            (3, "the cat sat on the mat here", "en", "s", 27, 1.0, 1, 1), (3, "the cat sat on the mat here", "en", "s", 27, 1.0, 1, 1),
            (None, "le chien est la avec moi", "fr", "s", 3, None, 1, 1), (5, "call +1 (017) 555-7713 now please", "en", "t", 33, 1.0, 1, 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES:
            table = stage(spark, table, folder)
            assert set(schema.replace(",", "").split()[::2]) <= set(table.columns), name
            table.collect()
    # different texts under one id, or under none, are different documents
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    same = [(7, "one text that stands here alone", "en", "s", 1, 1.0, 1, 1), (7, "quite another set of words altogether", "en", "s", 1, 1.0, 1, 1),
            (7, bench, "en", "s", 1, 1.0, 1, 1), (None, bench, "en", "s", 1, 1.0, 1, 1), (None, "nothing of note", "en", "s", 1, 1.0, 1, 1)]
    same = spark.createDataFrame(same, schema)
    left = pipeline.keep_one_of_copies(spark, same, folder)
    assert sorted(r.text for r in left.collect()) == sorted({r.text for r in same.collect()})
    assert left.filter("doc_id is null").count() == 1
    clean = pipeline.drop_leaks(spark, same, folder).collect()
    assert sorted(r.text for r in clean) == sorted(r.text for r in same.collect() if r.text != bench)
    kept = pipeline.keep_one_of_copies(spark, spark.createDataFrame(rows, schema), folder).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 5]
    assert len(pipeline.keep_known_languages(spark, spark.createDataFrame(rows, schema), folder).collect()) == 5
