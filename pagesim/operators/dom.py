"""Pages to DOM nodes.

``parse_html`` adds the page's nodes as one array column next to the page's
other columns, so the steps that follow stay narrow: nothing is shuffled
between the scan and the page's features. ``html_nodes`` is the row form.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from ..functions import html as html_tokens

EMPTY_DOCUMENT = "HtmlParser: Document is empty"
PAGES = 128  # pages of an Arrow batch that are parsed at once

_NODE = StructType(
    [
        StructField("pos", IntegerType()),
        StructField("end", IntegerType()),
        StructField("parent", IntegerType()),
        StructField("depth", IntegerType()),
        StructField("tag", StringType()),
    ]
)
_NODE_WITH_ATTRS = StructType(
    _NODE.fields + [StructField("attrs", MapType(StringType(), StringType()))]
)


def _dom_udf(keep: frozenset[str] | None, attr_names: tuple[str, ...]):
    """Arrow UDF html -> array of nodes; null where there is no tree.

    ``keep`` prunes the emitted nodes to the root and the tags a later step
    asks for, which keeps the Arrow traffic near the size of the answer.
    """
    schema = ArrayType(_NODE_WITH_ATTRS if attr_names else _NODE)

    def parse_batch(html: pa.Array) -> pa.Array:
        # nodes are Python objects only for some pages at a time
        return pa.concat_arrays(
            [parse_some(html.slice(at, PAGES)) for at in range(0, max(len(html), 1), PAGES)]
        )

    def parse_some(html: pa.Array) -> pa.Array:
        pos, end, parent, depth, tag, attrs = [], [], [], [], [], []
        offsets, empty = [0], []
        for text in html:
            page = text.as_py()
            nodes = html_tokens.parse(page, attr_names) if page else None
            found = nodes.tag if nodes else ()
            empty.append(not found)
            picked = [
                i for i, t in enumerate(found) if keep is None or i == 0 or t in keep
            ]
            for out, column in (
                (end, "end"), (parent, "parent"), (depth, "depth"), (tag, "tag")
            ):
                if picked:
                    values = getattr(nodes, column)
                    out.extend([values[i] for i in picked])
            pos.extend(picked)
            if attr_names:
                attrs.extend([nodes.attrs[i] for i in picked])
            offsets.append(len(pos))
        ints = [pa.array(c, pa.int32()) for c in (pos, end, parent, depth)]
        columns = ints + [pa.array(tag, pa.string())]
        names = ["pos", "end", "parent", "depth", "tag"]
        if attr_names:
            columns.append(pa.array(attrs, pa.map_(pa.string(), pa.string())))
            names.append("attrs")
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.StructArray.from_arrays(columns, names),
            mask=pa.array(empty, pa.bool_()),
        )

    parse_batch.__annotations__ = {"html": pa.Array, "return": pa.Array}
    return F.arrow_udf(parse_batch, schema)


def html_text(html: Column, is_binary: bool) -> Column:
    """Text of a page; bytes are read as Latin-1, which never fails and keeps markup intact."""
    return F.decode(html, "ISO-8859-1") if is_binary else html


def parse_html(
    df: DataFrame,
    html: str = "html",
    *,
    keep: Sequence[str] | None = None,
    attrs: Sequence[str] = (),
) -> DataFrame:
    """Add ``dom`` (array of nodes, null without a tree) and grow ``errors``."""
    binary = df.schema[html].dataType.typeName() == "binary"
    udf = _dom_udf(frozenset(keep) if keep is not None else None, tuple(attrs))
    out = df.withColumn("dom", udf(html_text(F.col(html), binary)))
    failed = F.when(F.col("dom").isNull(), F.array(F.lit(EMPTY_DOCUMENT)))
    return add_errors(out, F.coalesce(failed, F.array().cast("array<string>")))


def add_errors(df: DataFrame, errors: Column) -> DataFrame:
    """Append an array of messages to ``errors``, adding the column when absent."""
    if "errors" in df.columns:
        errors = F.concat(F.coalesce("errors", F.array().cast("array<string>")), errors)
    return df.withColumn("errors", errors)


def node_rows(df: DataFrame, *ids: str, dom: str = "dom") -> DataFrame:
    """One row per node: ids, pos, end, parent, depth, tag (and attrs when parsed)."""
    return df.select(*ids, F.inline_outer(dom)).filter("tag IS NOT NULL")


def array_rows(df: DataFrame, array: Column | str, *ids: str, value: str,
               position: str | None = None) -> DataFrame:
    """One row per element of an array without null elements.

    The outer generator keeps Catalyst from filtering on the array's size ahead
    of the explode, which would compute a costly array a second time.
    """
    if position is None:
        rows = df.select(*ids, F.explode_outer(array).alias(value))
    else:
        rows = df.select(*ids, F.posexplode_outer(array).alias(position, value))
    return rows.filter(F.col(value).isNotNull())


def html_nodes(df: DataFrame, *ids: str, html: str = "html", **options) -> DataFrame:
    """Node rows of every page in document order."""
    return node_rows(parse_html(df.select(*ids, html), html, **options), *ids)


def parse_errors(df: DataFrame) -> DataFrame:
    """How often each message occurs."""
    return (
        array_rows(df, "errors", value="error")
        .groupBy("error")
        .agg(F.count("*").alias("pages"))
    )
