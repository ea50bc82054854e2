"""Archive records to pages, and pages to archive records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.headers import WARC_DATE, default_content_type
from ..session import materialize
from ..sources import read_archive, warc_records
from .dom import add_errors

# Fixed values ---------------------------------------------------------------
MIN_LENGTH = 10000
MAX_RECORDS = {"default": 1000, "test": 200, "all": 1000000}
MOVED = "301 Moved Permanently"
BLANKS = " \t\n\r\x0b\x0c"
EXTRACT = "extract"
NO_BLANK_LINE = "HtmlExtractor: no blank line after the HTTP headers"
# ----------------------------------------------------------------------------


def typed_columns(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Add the named accessors of a header map as typed columns; null when missing."""
    h = F.col(headers)
    return df.withColumns(
        {
            "record_type": h["warc-type"],
            "record_id": h["warc-record-id"],
            "url": h["warc-target-uri"],
            "ip_address": h["warc-ip-address"],
            "date": F.try_to_timestamp(h["warc-date"]),
            "content_length": h["content-length"].try_cast("bigint"),
            "checksum": h["warc-payload-digest"],
        }
    )


def filter_responses(df: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Response records longer than ``min_length`` bytes, HTTP headers included."""
    return df.filter(
        (F.col("record_type") == "response") & (F.col("content_length") > min_length)
    )


def split_http(df: DataFrame) -> DataFrame:
    """Add ``http_headers`` (text) and ``body`` (bytes), split at the first blank line.

    Without one both are null and the record gets an error.
    """
    text = F.decode("payload", "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    out = df.withColumn("_at", at).withColumns(
        {
            "http_headers": F.when(
                F.col("_at") > 0, F.substring(text, F.lit(1), F.col("_at") - 1)
            ),
            "body": F.when(
                F.col("_at") > 0,
                F.substring("payload", F.col("_at") + 4, F.octet_length("payload")),
            ),
        }
    )
    missing = F.coalesce(F.col("_at") == 0, F.lit(True))
    errors = F.when(missing, F.array(F.lit(NO_BLANK_LINE))).otherwise(
        F.array().cast("array<string>")
    )
    return add_errors(out, errors).drop("_at")


def drop_moved(df: DataFrame) -> DataFrame:
    """Drop permanent redirects (status 301 with its usual reason)."""
    return df.filter(~F.coalesce(F.contains("http_headers", F.lit(MOVED)), F.lit(False)))


def strip_bytes(value: Column) -> Column:
    """Bytes without leading and trailing ASCII whitespace."""
    text = F.decode(value, "ISO-8859-1")
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(BLANKS)))
    return F.substring(value, lead + 1, F.length(F.trim(text, F.lit(BLANKS))))


def project_html(df: DataFrame) -> DataFrame:
    """``url, html, transformations, errors`` of split records."""
    keep = [c for c in ("file", "offset") if c in df.columns]
    return df.select(
        *keep,
        "url",
        strip_bytes(F.col("body")).alias("html"),
        F.array(F.lit(EXTRACT)).alias("transformations"),
        "errors",
    )


def extract_html(df: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Archive records to pages: responses, long enough, not moved, body stripped."""
    return project_html(drop_moved(split_http(filter_responses(df, min_length))))


def arc_responses(df: DataFrame) -> DataFrame:
    """ARC records in the form of WARC records; those whose payload is an HTTP answer are responses."""
    answer = F.coalesce(F.substring("payload", 1, 5) == F.encode(F.lit("HTTP/"), "UTF-8"), F.lit(False))
    return df.select(
        "file", F.col("file_offset").alias("offset"), "url",
        F.when(answer, "response").otherwise("resource").alias("record_type"),
        F.col("length").alias("content_length"), "payload",
    )


def pages_as_records(df: DataFrame) -> DataFrame:
    """A table of ``url, html`` in the form of extracted pages, unfiltered."""
    return df.select(
        "*",
        F.array(F.lit(EXTRACT)).alias("transformations"),
        F.array().cast("array<string>").alias("errors"),
    )


def limit_records(df: DataFrame, n: int = MAX_RECORDS["default"],
                  order: tuple[str, ...] = ("file", "offset")) -> DataFrame:
    """The first ``n`` records in ``order``, whose columns identify a record.

    Only the order columns go through the global top-n; the records themselves
    stay where they are and are picked by a semi join.
    """
    first = df.select(*order).orderBy(*order).limit(n)
    return df.join(first, list(order), "left_semi")


def first_records(spark: SparkSession, path: str | list[str], n: int = MAX_RECORDS["default"], **options) -> DataFrame:
    """What :func:`limit_records` keeps of the WARC files at ``path``, scanned once and without payloads.

    Each file is left after its ``n``-th record. The places of the first ``n`` of all are
    sorted, and their payloads looked up.
    """
    heads = read_archive(spark, path, "warc", payload="false", maxRecords=str(n), **options)
    places = heads.filter("error is null").select("file", "offset", "member_offset")
    return warc_records(places.orderBy("file", "offset").limit(n), **_packing(options))


def first_of_urls(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """What :func:`dedupe_urls` keeps of the WARC files at ``path``, with no payload in a shuffle.

    The scan passes over the payloads; those of the records that are kept are looked up.
    """
    heads = read_archive(spark, path, "warc", payload="false", **options).filter("error is null")
    place = ("file", "offset", "member_offset")
    first = heads.filter("url is not null").groupBy("url").agg(
        F.min(F.struct(*place)).alias("first"), F.count("*").alias("copies")
    )
    places = first.select("first.*", "copies").unionByName(
        heads.filter("url is null").select(*place, F.lit(1).cast("bigint").alias("copies"))
    )
    return warc_records(places, **_packing(options))


def _packing(options: dict) -> dict:
    return {k: v for k, v in options.items() if k == "compression"}


def dedupe_urls(df: DataFrame, order: tuple[str, ...] = ("file", "offset"),
                url: str = "url") -> DataFrame:
    """Keep the first record of each URL and add ``copies``, the records it stands for.

    The first position per URL is a partial aggregate over the order columns,
    so a URL that holds a large share of the records costs one row per task.
    Records without a URL are all kept.
    """
    first = df.filter(F.col(url).isNotNull()).groupBy(url).agg(
        F.min(F.struct(*order)).alias("_first"), F.count("*").alias("copies")
    )
    keys = first.select("copies", *[F.col("_first")[c].alias(c) for c in order])
    # written for its size: few keys are sent to the records, which then stay where they are
    found = df.join(materialize(keys, "first-records"), list(order), "left")
    found = found.filter(F.col(url).isNull() | F.col("copies").isNotNull())
    return found.withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))


def fill_warc_defaults(df: DataFrame, date: Column | None = None,
                       record_id: Column | None = None) -> DataFrame:
    """Complete ``headers`` for writing: type, id, date, content type, length, digest."""
    h = F.col("headers")
    kind = F.coalesce(h["warc-type"], F.lit("response"))
    payload = F.coalesce("payload", F.lit(b""))
    defaults = {
        "warc-type": kind,
        "warc-record-id": record_id
        if record_id is not None
        else F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")),
        "warc-date": F.date_format(
            F.current_timestamp() if date is None else date, WARC_DATE
        ),
        "content-type": default_content_type(kind),
        "content-length": F.octet_length(payload).cast("string"),
        "warc-payload-digest": F.concat(F.lit("sha1:"), F.sha1(payload)),
    }
    pairs = [x for name, value in defaults.items() for x in (F.lit(name), value)]
    missing = F.map_filter(F.create_map(*pairs), lambda k, _: ~F.map_contains_key(h, k))
    return df.withColumn("headers", F.map_concat(h, missing))


def pages_to_warc(df: DataFrame, body: Column, status: Column | None = None,
                  reason: Column | None = None, http_headers: Column | None = None,
                  **defaults) -> DataFrame:
    """HTTP responses (``url`` and body bytes) as WARC ``response`` records.

    The payload is the status line, the HTTP header lines, an empty line and
    the body.
    """
    head = F.concat(
        F.lit("HTTP/1.1 "),
        F.coalesce(status, F.lit(200)).cast("string") if status is not None else F.lit("200"),
        F.lit(" "),
        reason if reason is not None else F.lit("OK"),
        F.lit("\r\n"),
        http_headers if http_headers is not None else F.lit(""),
        F.lit("\r\n"),
    )
    records = df.withColumn("payload", F.concat(F.encode(head, "UTF-8"), body)).withColumn(
        "headers",
        F.create_map(
            F.lit("warc-type"), F.lit("response"), F.lit("warc-target-uri"), F.col("url")
        ),
    )
    return fill_warc_defaults(records, **defaults)
