"""Archive files read in ranges: the same records at the same offsets."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from pagesim.operators import records
from pagesim.sources import files, read_archive, warc, warc_records

HEAD = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://pages.test/%d\r\nContent-Length: %d\r\n\r\n"


def record(number, payload):
    return HEAD % (number, len(payload)) + payload + b"\r\n\r\n"


def payloads(count, seed=1):
    rnd = random.Random(seed)
    return [bytes(rnd.choice(b"abcdef \n") for _ in range(rnd.choice([3, 40, 900]))) for _ in range(count)]


def write_warc_files(folder):
    parts = [record(i, p) for i, p in enumerate(payloads(120))]
    # a payload that holds lines like a record's first, and one that holds a whole record
    parts[40] = record(40, b"text\r\nWARC/1.0\r\nno head\r\n" * 30)
    parts[41] = record(41, b"a line\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nabcdefghij" + b"x" * 700)
    (folder / "plain.warc").write_bytes(b"".join(parts))
    (folder / "single.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    # members that hold half a record, three, or none at all
    data, cuts = b"".join(parts), [0]
    rnd = random.Random(2)
    begins = {0}
    for p in parts:
        begins.add(max(begins) + len(p))
    while cuts[-1] < len(data):
        cuts.append(min(len(data), rnd.choice([cuts[-1] + rnd.randint(1, 900), min(b for b in begins if b > cuts[-1])])))
    members = [gzip.compress(data[a:b]) for a, b in zip(cuts, cuts[1:])]
    members.insert(7, gzip.compress(b""))
    (folder / "odd.warc.gz").write_bytes(b"".join(members))
    (folder / "one.warc.gz").write_bytes(gzip.compress(data))


def rows_of(df):
    keep = [c for c in df.columns if c != "headers"]
    return sorted((tuple(r) for r in df.select(*keep).collect()), key=str)


@pytest.mark.parametrize("step", [900, 10_000_000])
def test_warc_ranges_equal_the_whole_scan(spark, tmp_path, step):
    write_warc_files(tmp_path)
    whole, cut = read_archive(spark, str(tmp_path)), read_archive(spark, str(tmp_path), splitBytes=str(step))
    assert cut.columns == whole.columns
    got = rows_of(cut)
    assert got == rows_of(whole) and len(got) == 480
    assert cut.select("file", "offset").distinct().count() == 480
    longer = read_archive(spark, str(tmp_path), splitBytes=str(step), longerThan="500")
    assert rows_of(longer) == rows_of(whole.filter("content_length > 500"))


def test_records_of_split_gzip_files_are_told_apart(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, p)) for i, p in enumerate(payloads(40))))
    df = read_archive(spark, str(tmp_path), splitBytes="1000")
    assert records.limit_records(df, 5).count() == 5
    assert [r.url for r in records.limit_records(df, 3).orderBy("offset").collect()] == [f"https://pages.test/{i}" for i in range(3)]
    assert records.dedupe_urls(df).count() == 40
    # without the ranges' sizes a gzip file is not cut
    assert spark.read.format("warc").option("splitBytes", "1000").load(str(tmp_path)).rdd.getNumPartitions() == 1


def test_damage_in_one_range_costs_no_other(spark, tmp_path):
    parts = [gzip.compress(record(i, p)) for i, p in enumerate(payloads(60))]
    parts[30] = parts[30][:20] + b"\xff\xff\xff\xff" + parts[30][24:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    df = read_archive(spark, str(tmp_path), mode="PERMISSIVE", splitBytes="700")
    rows = df.collect()
    assert {r.url for r in rows if r.error is None} == {f"https://pages.test/{i}" for i in range(60) if i != 30}
    assert sum(r.error is not None for r in rows) == 1
    good = [(r.offset, r.member_offset) for r in rows if r.error is None]
    assert len(set(good)) == 59 and sorted(good) == sorted(good, key=lambda x: x[1])


def test_sizes_of_ranges_add_up(tmp_path):
    write_warc_files(tmp_path)
    plain = (tmp_path / "plain.warc").stat().st_size
    for name in ("single.warc.gz", "odd.warc.gz", "one.warc.gz"):
        for step in (150, 1_000, 50_000):
            parts = files.file_partitions(
                {"path": str(tmp_path / name), "splitBytes": str(step), "rangeSizes": "true"}, warc.SUFFIXES
            )
            assert sum(files.plain_size(p, warc.RECORD_START) for p in parts) == plain


def test_small_ranges_share_tasks(spark, tmp_path):
    """As many tasks as the bytes ask for, not as many as there are ranges; each range is still searched on its own."""
    write_warc_files(tmp_path)
    names = ("plain.warc", "single.warc.gz", "odd.warc.gz", "one.warc.gz")
    for options in ({"splitGzip": "true"}, {"rangeSizes": "true"}):
        parts = files.file_partitions({"path": str(tmp_path), "splitBytes": "150", **options}, warc.SUFFIXES)
        tasks = warc.WarcReader({"path": str(tmp_path), "splitBytes": "150", **options}).partitions()
        assert [p for t in tasks for p in t.parts] == parts and len(parts) > 100
        assert len(tasks) == len({p.path for p in parts}) <= len(names)
    wide = [files.FilePartition("a", False, at, at + files.TASK_BYTES // 2) for at in range(0, 5 * files.TASK_BYTES // 2, files.TASK_BYTES // 2)]
    assert [len(t.parts) for t in files.range_tasks(wide)] == [2, 2, 1]
    cut = read_archive(spark, str(tmp_path), splitBytes="150")
    assert rows_of(cut) == rows_of(read_archive(spark, str(tmp_path)))


ARC_HEAD = {
    1: b"filedesc://f.arc 127.0.0.1 20200102030405 text/plain %d\n",
    2: b"filedesc://f.arc 127.0.0.1 20200102030405 text/plain 200 - - 0 f.arc %d\n",
}
ARC_ABOUT = {
    1: b"1 0 Example Org\nURL IP-address Archive-date Content-type Archive-length\n",
    2: b"2 0 Example Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}


def arc_parts(version):
    out = [ARC_HEAD[version] % len(ARC_ABOUT[version]) + ARC_ABOUT[version] + b"\n"]
    middle = b"" if version == 1 else b"200 abc - 7 f.arc "
    line = b"http://pages.test/%d 10.0.0.1 20200102030405 text/html " + middle + b"%d\n"
    for i, payload in enumerate(payloads(100, version)):
        if i == 50:  # lines in a payload that look like records
            payload = b"text\n" + b"http://in.test/ 1.1.1.1 20200102030405 text/html 44\nmore\n" * 20
        out.append(line % (i, len(payload)) + payload + b"\n")
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("step", [900])
def test_arc_ranges_equal_the_whole_scan(spark, tmp_path, version, step):
    parts = arc_parts(version)
    (tmp_path / "plain.arc").write_bytes(b"".join(parts))
    (tmp_path / "members.arc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "one.arc.gz").write_bytes(gzip.compress(b"".join(parts)))
    whole, cut = read_archive(spark, str(tmp_path)), read_archive(spark, str(tmp_path), splitBytes=str(step))
    got = rows_of(cut)
    assert got == rows_of(whole) and len(got) == 300
    assert {(r.version, r.file_headers.org) for r in cut.collect()} == {(version, "Example Org")}
    longer = read_archive(spark, str(tmp_path), splitBytes=str(step), longerThan="500")
    assert rows_of(longer) == rows_of(whole.filter("length > 500"))
    assert cut.select("file", "file_offset").distinct().count() == 300


def test_a_bad_file_record_is_told_once(spark, tmp_path):
    (tmp_path / "bad.arc").write_bytes(b"no file record\n" + b"".join(arc_parts(1)[1:]))
    rows = read_archive(spark, str(tmp_path), mode="PERMISSIVE", splitBytes="500").collect()
    assert len(rows) == 1 and rows[0].error is not None
    with pytest.raises(Exception):
        read_archive(spark, str(tmp_path), splitBytes="500").collect()


def test_records_are_looked_up_where_they_begin(spark, tmp_path):
    write_warc_files(tmp_path)
    whole = read_archive(spark, str(tmp_path))
    places = whole.filter("hash(url) % 3 = 0").select("file", "offset", "member_offset", F.lit(7).alias("mine"))
    found = warc_records(places)
    assert "Exchange" in found._jdf.queryExecution().executedPlan().toString() and set(found.select("mine").distinct().collect()) == {(7,)}
    assert rows_of(found.drop("mine")) == rows_of(whole.filter("hash(url) % 3 = 0"))
    assert warc_records(places.limit(0)).count() == 0


def test_first_records_scan_once_and_stop_early(spark, tmp_path, capsys):
    write_warc_files(tmp_path)
    whole = read_archive(spark, str(tmp_path))
    for n in (1, 7, 200):
        assert rows_of(records.first_records(spark, str(tmp_path), n)) == rows_of(records.limit_records(whole, n))
    # damage behind the first records is not met
    data = (tmp_path / "plain.warc").read_bytes()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(data[: len(data) // 2] + b"no record" * 50)
    first = records.first_records(spark, str(cut), 5)
    assert first.count() == 5
    first.explain()
    assert capsys.readouterr().out.count("BatchScan") == 1


def test_one_record_per_url_without_payloads_in_a_shuffle(spark, tmp_path):
    write_warc_files(tmp_path)
    no_url = record(0, b"x").replace(b"WARC-Target-URI: https://pages.test/0\r\n", b"")
    (tmp_path / "none.warc").write_bytes(no_url * 3)
    want = records.dedupe_urls(read_archive(spark, str(tmp_path)))
    got = records.first_of_urls(spark, str(tmp_path))
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and got.count() == 123
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("payload" not in line for line in plan.splitlines() if "Exchange" in line)
    split = records.first_of_urls(spark, str(tmp_path), splitBytes="900")
    assert rows_of(split) == rows_of(want)


def test_first_records_of_an_archive_that_no_task_writes_alone(spark, folder, monkeypatch):
    from pagesim.plans import queries as q

    made = []
    monkeypatch.setattr(q, "work_dir", lambda *a, f=q.work_dir: made.append(f(*a)) or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r.url for r in q.first_records(spark, folder).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = read_archive(spark, made[0], "warc").orderBy("file", "offset").select("file", "url").collect()
    assert len({r.file for r in written}) > 1
    urls = sorted((r.url for r in q.pages(spark, folder).collect()), reverse=True)
    assert [r.url for r in written] == urls and sorted(got) == sorted(urls[:100])
