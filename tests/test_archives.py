"""WARC and ARC sources, sinks and record operators."""

import gzip
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagesim.functions import headers as hd
from pagesim.operators import records
from pagesim.plans import index as store
from pagesim.sources import detect_format, read_archive, warc_index, write_arc, write_warc

RECORD = (
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://pages.test/one?x=1\r\n"
    b"WARC-Record-ID: <urn:uuid:0b0d3f6e-3c1c-4a57-9d3e-1f7a5c2e9b44>\r\n"
    b"Content-Type: application/http; msgtype=response\r\nWARC-Date: 2024-06-05T04:03:02Z\r\n"
    b"Content-Length: 12\r\n\r\nfew bytes...\r\n\r\n"
)


def save(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return str(path)


@pytest.mark.parametrize("name", ["one.warc", "one.warc.gz"])
def test_one_record(spark, tmp_path, name):
    r = read_archive(spark, save(tmp_path, name, RECORD)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.version, r.record_type, r.url) == ("1.0", "response", "https://pages.test/one?x=1")
    assert r.record_id == "<urn:uuid:0b0d3f6e-3c1c-4a57-9d3e-1f7a5c2e9b44>"
    assert r.content_length == 12 and bytes(r.payload) == b"few bytes..."
    assert r.headers["warc-date"] == "2024-06-05T04:03:02Z" and r.headers["content-length"] == "12"
    assert (r.offset, r.size) == (0, len(RECORD)) and r.ip_address is None and r.checksum is None
    got = read_archive(spark, str(tmp_path), "warc").select(F.date_format("date", "yyyyMMddHHmmss")).first()[0]
    assert got == "20240605040302"


def test_many_records_in_members_and_index(spark, tmp_path):
    path = tmp_path / "five.warc.gz"
    path.write_bytes(b"".join(gzip.compress(RECORD) for _ in range(5)))
    rows = warc_index(spark, str(path), payload_bytes=4).orderBy("offset").collect()
    assert [r.offset for r in rows] == [i * len(RECORD) for i in range(5)]
    assert all(bytes(r.payload) == b"few " and r.size == len(RECORD) for r in rows)
    data = path.read_bytes()
    for r in rows:
        assert gzip.decompress(data[r.member_offset:])[: r.size] == RECORD
    whole = save(tmp_path, "whole.warc.gz", RECORD * 2)
    assert [r.member_offset for r in warc_index(spark, whole).orderBy("offset").collect()] == [0, None]


def test_empty_file_and_folder_rules(spark, tmp_path):
    save(tmp_path, "none.warc", b"")
    save(tmp_path, "_hidden.warc", RECORD)
    save(tmp_path, "other.txt", b"x")
    assert read_archive(spark, str(tmp_path), "warc").count() == 0


@pytest.mark.parametrize("data, message", [
    (RECORD.replace(b"WARC/1.0", b"HTTP/1.0"), "no WARC/1.0 record"),
    (RECORD.replace(b"WARC/1.0", b"WARC/0.9"), "no WARC/1.0 record"),
    (RECORD.replace(b"WARC-Date:", b"WARC-Date2:"), "not a header field"),
    (RECORD.replace(b"few bytes...", b"few"), "does not end|the payload has"),
    (RECORD[:-8], "the payload has"),
])
def test_bad_records(spark, tmp_path, data, message):
    path = save(tmp_path, "bad.warc", RECORD + data)
    with pytest.raises(Exception, match=message):
        read_archive(spark, path).collect()
    rows = read_archive(spark, path, mode="PERMISSIVE").orderBy("offset").collect()
    assert [r.error is None for r in rows] == [True, False]
    assert rows[1].offset == len(RECORD)


def test_cut_gzip_file(spark, tmp_path):
    path = tmp_path / "cut.warc.gz"
    path.write_bytes((gzip.compress(RECORD) + gzip.compress(RECORD))[:-20])
    rows = read_archive(spark, str(path), mode="PERMISSIVE").orderBy("offset").collect()
    assert [r.error is None for r in rows] == [True, False]
    with pytest.raises(Exception, match="ends inside a gzip member"):
        read_archive(spark, str(path)).collect()


def test_header_line_across_a_read_boundary(spark, tmp_path):
    long = RECORD.replace(b"WARC-Type:", b"X-Pad: " + b"p" * 1000 + b"\r\nWARC-Type:")
    r = read_archive(spark, save(tmp_path, "long.warc.gz", long)).first()
    assert len(r.headers["x-pad"]) == 1000 and r.record_type == "response"


def test_filters_reach_the_scan(spark, tmp_path):
    other = RECORD.replace(b"WARC-Type: response", b"WARC-Type: request")
    path = save(tmp_path, "mixed.warc", RECORD + other + RECORD)
    for options, count in (({"recordType": "response", "longerThan": "11"}, 2), ({"longerThan": "12"}, 0), ({"recordType": "request"}, 1)):
        assert read_archive(spark, path, **options).count() == count
    # a scan that was filtered is whole again in the next query, and in the same one
    df = read_archive(spark, path)
    assert records.filter_responses(df, 11).count() == 2 and df.count() == 3
    assert df.filter("record_type = 'request'").select("offset").join(df.select("offset"), "offset", "right").count() == 3
    assert read_archive(spark, path, payload="false").filter("payload is null").count() == 3


def test_format_detection(spark):
    names = ["a.warc", "a.warc.gz", "a.arc", "a.arc.gz", "a.txt"]
    assert [detect_format(n) for n in names] == ["warc", "warc", "arc", "arc", "unknown"]
    with pytest.raises(ValueError):
        read_archive(spark, "a.txt")


def test_warc_write_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [({"warc-type": "resource", "x-new-header": "42"}, bytearray(b"\x00\r\n\r\nWARC/1.0\r\n\xff")),
         ({"warc-target-uri": "http://b/"}, None)],
        "headers map<string,string>, payload binary",
    )
    full = records.fill_warc_defaults(df)
    for packing in ("none", "gzip"):
        path = str(tmp_path / packing)
        write_warc(full, path, compression=packing)
        write_warc(full, path, compression=packing)
        assert read_archive(spark, path, "warc").count() == 4
        write_warc(full, path, mode="overwrite", compression=packing)
        rows = {r.record_type: r for r in read_archive(spark, path, "warc").collect()}
        assert len(rows) == 2 and not [f for f in os.listdir(path) if f.startswith("_")]
        r = rows["resource"]
        assert bytes(r.payload) == b"\x00\r\n\r\nWARC/1.0\r\n\xff" and r.headers["x-new-header"] == "42"
        assert r.headers["content-type"] == "application/octet-stream"
        assert r.checksum.startswith("sha1:") and r.record_id.startswith("<urn:uuid:")
        assert rows["response"].content_length == 0


def test_warc_header_text(spark):
    df = spark.createDataFrame([({},), ({"warc-type": "response"},)], "h map<string,string>")
    got = [r[0] for r in df.select(hd.warc_header_text(F.col("h"))).collect()]
    assert got == ["WARC/1.0\r\n\r\n", "WARC/1.0\r\nWARC-Type: response\r\n\r\n"]
    names = spark.createDataFrame(
        [("warc-ip-address",), ("WARC-RECORD-ID",), ("warc-identified-payload-type",), ("content-length",),
         ("warc-target-uri",), ("x1a-b",)], "n string")
    got = [r[0] for r in names.select(hd.warc_header_name(F.col("n"))).collect()]
    assert got == ["WARC-IP-Address", "WARC-Record-ID", "WARC-IDentified-Payload-Type", "Content-Length",
                   "WARC-Target-URI", "X1A-B"]
    kinds = spark.createDataFrame([(k,) for k in ("response", "request", "warcinfo", "metadata", "new")], "k string")
    got = [r[0] for r in kinds.select(hd.default_content_type(F.col("k"))).collect()]
    assert got == ["application/http; msgtype=response", "application/http; msgtype=request",
                   "application/warc-fields", "application/warc-fields", "application/octet-stream"]


def test_header_block(spark):
    df = spark.createDataFrame([("WARC-Type: a\r\nx-y:  b: c\r\nwarc-TYPE: d\r\n",)], "b string")
    assert df.select(hd.warc_headers(F.col("b"))).first()[0] == {"x-y": "b: c", "warc-type": "d"}
    with pytest.raises(Exception, match="Bad header line"):
        df.select(hd.warc_headers(F.concat(F.col("b"), F.lit("X1: no\r\n")))).collect()


ADDRESS = b"http://two.test/a 10.1.2.3 20190807060504 text/html"
V1 = (b"filedesc://own.arc 10.1.2.3 20190807060504 text/plain 69\n1 0 Small Crawler\n"
      b"URL IP-address Archive-date Content-type Archive-length\n\n"
      + ADDRESS + b" 6\nfirst.\n\n" + ADDRESS + b" 7\nsecond.\n\n")
V2_LINE = ADDRESS + b" 200 k9 http://two.test/b 41 own.arc.gz %d\n"


def v2(short):
    """A version 2 file whose filedesc record is said to be ``short`` bytes shorter than it is."""
    about = (b"2 0 Small Crawler\nURL IP-address Archive-date Content-type Result-code Checksum "
             b"Location Offset Filename Archive-length")
    return (b"filedesc://own.arc 10.1.2.3 20190807060504 text/plain 200 - - 0 own.arc %d\n" % (len(about) - short)
            + about + b"\n\n\n" + V2_LINE % 6 + b"first.\n" + V2_LINE % 7 + b"second.")


def test_arc_v1_read(spark, tmp_path):
    rows = read_archive(spark, save(tmp_path, "a.arc", V1)).orderBy("file_offset").collect()
    assert [bytes(r.payload) for r in rows] == [b"first.", b"second."]
    r = rows[0]
    assert (r.version, r.url, r.ip_address, r.content_type, r.length) == (
        1, "http://two.test/a", "10.1.2.3", "text/html", 6)
    assert r.file_headers.org == "Small Crawler" and r.result_code is None and r.offset is None


@pytest.mark.parametrize("short", [0, 8, 9])
def test_arc_v2_read(spark, tmp_path, short):
    rows = read_archive(spark, save(tmp_path, "a.arc.gz", v2(short)), version="2").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"first.", b"second."]
    r = rows[0]
    assert (r.version, r.result_code, r.checksum, r.location, r.offset, r.filename) == (
        2, "200", "k9", "http://two.test/b", 41, "own.arc.gz")


def test_arc_meta_block_and_version_mismatch(spark, tmp_path):
    meta = V1.replace(b"text/plain 69", b"text/plain 79").replace(
        b"Archive-length\n\n", b"Archive-length\nfree text\n\n", 1)
    lump = meta.replace(b"html 6\nfirst.\n\n", b"html 6\nfirst.\n\n<arcmetadata a='1'>\nx\n</arcmetadata>\n\n", 1)
    rows = read_archive(spark, save(tmp_path, "m.arc", lump)).collect()
    assert len(rows) == 2 and rows[0].file_meta == "free text\n"
    with pytest.raises(Exception, match="requested"):
        read_archive(spark, str(tmp_path / "m.arc"), version="2").collect()
    bad = read_archive(spark, str(tmp_path / "m.arc"), version="2", mode="PERMISSIVE").collect()
    assert len(bad) == 1 and "requested" in bad[0].error


def test_arc_file_text(spark, tmp_path):
    df = spark.createDataFrame(
        [("http://two.test/w", "10.1.2.3", datetime(2019, 8, 7, 6, 5, 4), "text/html", bytearray(b"written."))],
        "url string, ip_address string, date timestamp, content_type string, payload binary",
    ).withColumn("date", F.to_timestamp(F.lit("2019-08-07 06:05:04")))
    for version, org, length in ((1, None, 67), (1, "Small Crawler", 73), (2, "Small Crawler", 119)):
        path = str(tmp_path / f"v{version}{org}")
        options = {"date": "20190807060504", **({"org": org} if org else {})}
        write_arc(df.coalesce(1), path, version, **options)
        (name,) = [f for f in os.listdir(path) if f.endswith(".arc")]
        lines = open(os.path.join(path, name)).read().split("\n")
        middle = f"200 - - 0 {name} " if version == 2 else ""
        assert lines[0] == f"filedesc://{name} 127.0.0.1 20190807060504 text/plain {middle}{length}"
        assert lines[1] == f"{version} 0 {org or 'Unknown'}" and lines[3] == ""
        fields = "text/html 8" if version == 1 else "text/html      8"
        assert lines[4:] == [f"http://two.test/w 10.1.2.3 20190807060504 {fields}", "written.", "", ""]


def test_arc_header_lines_and_fields(spark):
    v2_fields = dict(url="http://two.test/h", ip_address="10.1.2.3", content_type="text/html", result_code="200",
                     checksum="k9", location="http://two.test/b", offset="41",
                     filename="own.arc.gz", length="500")
    fields = {k: F.lit(v) for k, v in v2_fields.items()}
    fields["date"] = F.to_timestamp(F.lit("2018-02-03 04:05:06"))
    one = spark.range(1)
    line1, line2 = one.select(hd.arc_header_line(fields, 1), hd.arc_header_line(fields)).first()
    assert line1 == "http://two.test/h 10.1.2.3 20180203040506 text/html 500"
    assert line2 == ("http://two.test/h 10.1.2.3 20180203040506 text/html 200 k9 "
                     "http://two.test/b 41 own.arc.gz 500")
    for version, line in ((1, line1), (2, line2)):
        for gap in ("\n", "\n\n"):
            r = one.select(hd.arc_fields(F.lit(line + gap + "some text"), version).alias("r")).first().r
            assert (r.url, r.length, r.payload) == ("http://two.test/h", 500, "some text")
    assert (r.offset, r.checksum) == (41, "k9")


def test_extract_html(spark):
    rows = [
        ("a", "response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n \t<html>\r\n\r\n\xe9\x0b\n"),
        ("b", "response", b"HTTP/1.1 301 Moved Permanently\r\n\r\n<html>"),
        ("c", "request", b"GET /\r\n\r\n"),
        ("d", "response", b"no blank line"),
        ("e", "response", b"HTTP/1.1 302 Found\r\n\r\n"),
    ]
    df = spark.createDataFrame([(u, k, bytearray(p), len(p)) for u, k, p in rows],
                               "url string, record_type string, payload binary, content_length bigint")
    got = {r.url: r for r in records.extract_html(df, 12).collect()}
    assert set(got) == {"a", "d", "e"}
    assert bytes(got["a"].html) == b"<html>\r\n\r\n\xe9" and got["a"].transformations == ["extract"]
    assert got["d"].html is None and got["d"].errors == [records.NO_BLANK_LINE]
    assert bytes(got["e"].html) == b""
    assert {r.url for r in records.extract_html(df, 13).collect()} == {"a", "b", "e"} - {"b"}


def test_limit_and_dedupe_keep_file_order(spark):
    rows = [("f2", 0, "u"), ("f1", 9, "u"), ("f1", 3, "v"), ("f1", 12, "w")] + [("f9", i, "hot") for i in range(500)]
    df = spark.createDataFrame(rows, "file string, offset bigint, url string").repartition(5)
    first = records.limit_records(df, 3).orderBy("file", "offset").collect()
    assert [(r.file, r.offset) for r in first] == [("f1", 3), ("f1", 9), ("f1", 12)]
    kept = {r.url: (r.file, r.offset, r.copies) for r in records.dedupe_urls(df).collect()}
    assert kept == {"u": ("f1", 9, 2), "v": ("f1", 3, 1), "w": ("f1", 12, 1), "hot": ("f9", 0, 500)}


def test_archive_pages_cap(spark, folder, tmp_path):
    from pagesim.plans import queries as q

    path = q._warc_folder(spark, folder)
    every = store.archive_pages(spark, path, "warc", min_length=0)
    assert every.count() == 50
    assert store.archive_pages(spark, path, "warc", min_length=0, max_records=7).count() == 7


@pytest.mark.parametrize("name", ["bad.warc", "bad.warc.gz"])
@pytest.mark.parametrize("fault", ["head", "length", "member"])
def test_a_bad_record_costs_no_other(spark, tmp_path, name, fault):
    bad = {"head": RECORD.replace(b"WARC-Date:", b"WARC Date"), "length": RECORD.replace(b"few bytes...", b"fe"), "member": RECORD}[fault]
    parts = [RECORD.replace(b"one?x=1", b"p%d" % i) for i in range(10)]
    parts[4] = bad
    if name.endswith("gz"):
        parts = [gzip.compress(p) for p in parts]
        if fault == "member":
            parts[4] = parts[4][:20] + b"\xff\xff\xff\xff" + parts[4][24:]
    elif fault == "member":
        parts[4] = b"\0\1\2 no record\r\n\r\n"
    (tmp_path / name).write_bytes(b"".join(parts))
    df = read_archive(spark, str(tmp_path / name), mode="PERMISSIVE")
    want = {f"https://pages.test/p{i}" for i in range(10) if i != 4}
    rows = df.collect()
    assert {r.url for r in rows if r.error is None} == want and sum(r.error is not None for r in rows) == 1
    # a pushed filter hides neither the good records nor the error
    seen = df.filter("record_type = 'response' or error is not null").collect()
    assert len(seen) == 10
    with pytest.raises(Exception):
        read_archive(spark, str(tmp_path / name)).collect()


def test_files_split_between_tasks(spark, tmp_path):
    parts = [RECORD.replace(b"one?x=1", b"p%03d" % i) for i in range(200)]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    for name in ("plain.warc", "members.warc.gz"):
        df = read_archive(spark, str(tmp_path / name), splitBytes="3000")
        assert df.rdd.getNumPartitions() > 5
        assert sorted(r.url for r in df.collect()) == [f"https://pages.test/p{i:03d}" for i in range(200)]
    whole = read_archive(spark, str(tmp_path / "plain.warc")).orderBy("offset").select("offset", "url").collect()
    cut = read_archive(spark, str(tmp_path / "plain.warc"), splitBytes="3000").orderBy("offset").select("offset", "url").collect()
    assert whole == cut


def test_paths_and_compression(spark, tmp_path):
    save(tmp_path, "a.warc", RECORD)
    save(tmp_path, "b.warc.gz", RECORD * 2)
    (tmp_path / "named.bin").write_bytes(gzip.compress(RECORD * 3))
    assert read_archive(spark, str(tmp_path)).count() == 3  # auto on a folder
    assert read_archive(spark, f"{tmp_path}/*.gz").count() == 2
    assert read_archive(spark, f"{tmp_path}/?.warc").count() == 1
    assert read_archive(spark, f"{tmp_path}/named.bin", "warc", compression="gzip").count() == 3
    save(tmp_path, "c.arc", V1)
    with pytest.raises(ValueError):
        read_archive(spark, str(tmp_path))


def test_arc_bad_records_bytes_and_filters(spark, tmp_path):
    odd = V1.replace(b"two.test/a 10", b"two.test/\xe9 b 10", 1).replace(b"html 7", b"html seven")
    odd += ADDRESS + b" 5\nthird\n"
    path = save(tmp_path, "odd.arc", odd)
    rows = read_archive(spark, path, mode="PERMISSIVE").collect()
    assert [(r.url, r.error is None) for r in sorted(rows, key=lambda r: r.file_offset)] == [
        ("http://two.test/\xe9 b", True), (None, False), ("http://two.test/a", True)]
    good = read_archive(spark, save(tmp_path, "good.arc", V1))
    assert [bytes(r.payload) for r in good.filter("length > 6").collect()] == [b"second."]
    assert read_archive(spark, f"{tmp_path}/good.arc", payload="false").filter("payload is null").count() == 2


def test_failed_overwrite_keeps_what_was_there(spark, tmp_path):
    df = spark.createDataFrame([({"warc-type": "response"}, bytearray(b"x"))], "headers map<string,string>, payload binary")
    path = str(tmp_path / "out")
    write_warc(records.fill_warc_defaults(df), path)
    broken = records.fill_warc_defaults(df).withColumn("payload", F.raise_error(F.lit("stop")).cast("binary"))
    with pytest.raises(Exception):
        write_warc(broken, path, mode="overwrite")
    assert read_archive(spark, path).count() == 1


def test_arc_lines_with_blanks_and_bad_dates(spark):
    fields = {"url": F.lit("http://two.test/a b"), "length": F.lit("1"), "date": F.to_timestamp(F.lit("2018-02-03 04:05:06"))}
    line, bad = spark.range(1).select(
        hd.arc_header_line(fields, 1), hd.arc_fields(F.lit("u 1.2.3.4 no-date text/html 5\nabcde"), 1).alias("r")).first()
    assert line.split(" ")[0] == "http://two.test/a%20b"
    assert bad.date is None and bad.payload == "abcde"


def test_list_of_files(spark, tmp_path):
    paths = [save(tmp_path, n, RECORD * 2) for n in ("a.warc", "b.warc.gz", "c.warc")]
    assert read_archive(spark, paths[:2]).count() == 4
    with pytest.raises(ValueError):
        read_archive(spark, [paths[0], "x.arc"])
