"""Archive header text and record bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources.arc import FIELDS as ARC_FIELDS

# Fixed values ---------------------------------------------------------------
WARC_VERSION_LINE = "WARC/1.0"
HEADER_PATTERN = r"^([a-zA-Z_\-]+): *(.*)$"
NAME_FIXES = (("Warc-", "WARC-"), ("-Ip-", "-IP-"), ("-Id", "-ID"), ("-Uri", "-URI"))
CONTENT_TYPES = {
    "warcinfo": "application/warc-fields",
    "response": "application/http; msgtype=response",
    "request": "application/http; msgtype=request",
    "metadata": "application/warc-fields",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
ARC_DATE = "yyyyMMddHHmmss"
WARC_DATE = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# ----------------------------------------------------------------------------


def _last_wins(entries: Column) -> Column:
    """Map of (key, value) structs in which the last of equal keys counts."""
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda found, e: F.map_concat(
            F.map_filter(found, lambda k, _: k != e["key"]),
            F.create_map(e["key"], e["value"]),
        ),
    )


def warc_headers(block: Column) -> Column:
    """Map of the ``Name: value`` lines (CRLF-ended) of a header block.

    Keys in lower case; a line outside the grammar raises.
    """
    lines = F.filter(F.split(block, "\r\n"), lambda x: x != "")
    entry = lambda x: F.when(
        x.rlike(HEADER_PATTERN),
        F.struct(
            F.lower(F.regexp_extract(x, HEADER_PATTERN, 1)).alias("key"),
            F.regexp_extract(x, HEADER_PATTERN, 2).alias("value"),
        ),
    ).otherwise(F.raise_error(F.concat(F.lit("Bad header line: "), x)).cast(
        "struct<key: string, value: string>"))
    return _last_wins(F.transform(lines, entry))


def warc_header_name(name: Column) -> Column:
    """Canonical spelling: title case, then the customary capitals."""
    pieces = F.split(name, "(?<=[^a-zA-Z])")
    out = F.array_join(F.transform(pieces, F.initcap), "")
    for plain, fixed in NAME_FIXES:
        out = F.replace(out, F.lit(plain), F.lit(fixed))
    return out


def warc_header_text(headers: Column) -> Column:
    """Header block of a map: version line, one line per header, empty line."""
    lines = F.transform(
        F.map_entries(headers),
        lambda e: F.concat(warc_header_name(e["key"]), F.lit(": "), e["value"], F.lit("\r\n")),
    )
    return F.concat(
        F.lit(WARC_VERSION_LINE + "\r\n"), F.array_join(lines, ""), F.lit("\r\n")
    )


def warc_record_bytes(headers: Column, payload: Column) -> Column:
    """A whole WARC record."""
    return F.concat(
        F.encode(warc_header_text(headers), "UTF-8"),
        F.coalesce(payload, F.lit(b"")),
        F.lit(b"\r\n\r\n"),
    )


def default_content_type(record_type: Column) -> Column:
    out = F.lit(DEFAULT_CONTENT_TYPE)
    for kind, mime in CONTENT_TYPES.items():
        out = F.when(record_type == kind, mime).otherwise(out)
    return out


def arc_fields(text: Column, version: int) -> Column:
    """Struct of the header fields and payload of a "header line, payload" text.

    One extra newline before the payload is dropped.
    """
    line = F.substring_index(text, "\n", 1)
    names = ARC_FIELDS[version]
    pattern = r"(\S*)\s" * (len(names) - 1) + r"(\S*)"
    fields = []
    for i, name in enumerate(names, 1):
        value = F.regexp_extract(line, pattern, i)
        if name == "date":
            value = F.try_to_timestamp(value, F.lit(ARC_DATE))
        elif name in ("offset", "length"):
            value = value.try_cast("bigint")
        fields.append(value.alias(name))
    rest = F.substring(text, F.instr(text, "\n") + 1, F.length(text))
    payload = F.when(F.startswith(rest, F.lit("\n")), F.substring(rest, F.lit(2), F.length(rest)))
    return F.struct(*fields, payload.otherwise(rest).alias("payload"))


def arc_header_line(fields: dict[str, Column], version: int = 2) -> Column:
    """The space-separated header line of an ARC record."""
    values = []
    for name in ARC_FIELDS[version]:
        value = fields.get(name, F.lit(""))
        text = F.date_format(value, ARC_DATE) if name == "date" else value.cast("string")
        # a blank or a line end inside a field would break the line
        values.append(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]", "%20"), " ", "%20"))
    return F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values])


def arc_record_bytes(header_line: Column, payload: Column) -> Column:
    """A whole ARC record with its separator."""
    return F.concat(
        F.encode(header_line, "UTF-8"), F.lit(b"\n"), payload, F.lit(b"\n\n")
    )
