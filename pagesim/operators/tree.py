"""Structural tree and 3-grams of a page, as column expressions over its node array.

A node is the interval ``[pos, end)``. Dropping a node leaves every other
interval valid and hands its children to the nearest kept ancestor, so the
splice is a filter. Walking the kept opens and closes in order gives the
binary encoding: what follows a node's opening is its first child, what
follows its closing is its next sibling, and anything else means "absent".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vocabulary import REFERENCE, Vocabulary
from .dom import add_errors, array_rows, node_rows, parse_html

NO_TREE = "TreeParser: NoneType object"
NO_STRING = "TreeStringify: NoneType object"


def _messages(condition: Column, message: str) -> Column:
    return F.when(condition, F.array(F.lit(message))).otherwise(
        F.array().cast("array<string>")
    )


def structural_nodes(df: DataFrame, vocab: Vocabulary = REFERENCE) -> DataFrame:
    """Reduce ``dom`` to ``tree``: nodes with a non-zero tag id, and always the root.

    ``tree`` is an array of ``pos, end, tag_id`` in document order; the root's
    ``tag_id`` is null when its tag is unknown. A page without a tree keeps its
    row with a null ``tree``.
    """
    ids = F.create_map(*[F.lit(x) for item in vocab.ids.items() for x in item])
    labelled = F.transform(
        "dom",
        lambda n: F.struct(
            n["pos"].alias("pos"), n["end"].alias("end"), ids[n["tag"]].alias("tag_id")
        ),
    )
    kept = F.filter(labelled, lambda n: (n["pos"] == 0) | (n["tag_id"] != 0))
    out = df.withColumn("tree", kept).drop("dom")
    return add_errors(out, _messages(F.col("tree").isNull(), NO_TREE))


def structural_tree(
    df: DataFrame, html: str = "html", vocab: Vocabulary = REFERENCE
) -> DataFrame:
    """Parse and reduce; only structural tags leave the parser."""
    return structural_nodes(parse_html(df, html, keep=list(vocab.ids)), vocab)


def node_attributes(df: DataFrame, names: Sequence[str] = ("class", "name")) -> DataFrame:
    """Row per DOM node with ``attributes``: its non-empty (name, value) pairs in ``names`` order.

    Needs a ``dom`` parsed with ``attrs=names``.
    """
    keep = [c for c in df.columns if c not in ("dom", "errors", "transformations")]
    wanted = F.array(*[F.lit(n) for n in names])
    pairs = F.filter(
        F.transform(
            wanted, lambda n: F.struct(n.alias("name"), F.col("attrs")[n].alias("value"))
        ),
        lambda p: p["value"] != "",
    )
    return node_rows(df, *keep).withColumn("attributes", pairs)


def preorder_string(df: DataFrame) -> DataFrame:
    """Add ``preorder``: tag ids in document order joined by dots.

    Empty, with an error, when there is no tree or the root has no id or id 0.
    """
    root = F.get(F.col("tree"), F.lit(0))["tag_id"]
    has_root = F.coalesce(root != 0, F.lit(False))
    text = F.array_join(F.transform("tree", lambda n: n["tag_id"].cast("string")), ".")
    out = df.withColumn("preorder", F.when(has_root, text).otherwise(F.lit("")))
    return add_errors(out, _messages(~has_root, NO_STRING))


def _walk(df: DataFrame) -> DataFrame:
    """Add ``_walk``: the opens (kind 1) and closes (kind 0) of ``tree`` in order."""
    def events(kind, at, inner, tag_id):
        return F.transform(
            "tree",
            lambda n: F.struct(
                at(n).alias("at"),
                F.lit(kind).alias("kind"),
                inner(n).alias("inner"),
                n["pos"].alias("pos"),
                tag_id(n).alias("tag_id"),
            ),
        )

    opens = events(1, lambda n: n["pos"], lambda n: F.lit(0), lambda n: n["tag_id"])
    # At one position closes come before the next open, inner elements first.
    closes = events(
        0, lambda n: n["end"], lambda n: -n["pos"], lambda n: F.lit(None).cast("int")
    )
    return df.withColumn("_walk", F.sort_array(F.concat(opens, closes)))


def structural_rows(df: DataFrame, *ids: str) -> DataFrame:
    """One row per kept node: ids, ``n`` (rank), ``pos``, ``end``, ``depth``, ``tag_id``.

    ``depth`` counts kept ancestors: the node of rank n opens as step t of the
    walk after t - n closes, so n - (t - n) elements are open around it.
    """
    timed = F.transform(
        "_walk",
        lambda e, t: F.struct(e["kind"].alias("kind"), t.alias("t")),
    )
    opened = F.filter(timed, lambda e: e["kind"] == 1)
    depths = F.transform(opened, lambda e, n: 2 * n - e["t"])
    nodes = F.zip_with(
        "tree",
        depths,
        lambda n, depth: F.struct(
            n["pos"].alias("pos"), n["end"].alias("end"), depth.alias("depth"),
            n["tag_id"].alias("tag_id"),
        ),
    )
    rows = array_rows(_walk(df), nodes, *ids, position="n", value="node")
    return rows.select(*ids, "n", "node.*")


def binary_tree(df: DataFrame) -> DataFrame:
    """Add ``binary``: per kept node ``pos, tag_id, left_id, right_id`` in document order.

    ``left_id`` is the first child's id and ``right_id`` the next sibling's, 0
    when there is none.
    """
    walk = _walk(df)
    steps = F.zip_with(
        "_walk",
        F.expr("slice(_walk, 2, greatest(size(_walk) - 1, 0))"),
        lambda e, follower: F.struct(
            e["pos"].alias("pos"),
            e["kind"].alias("kind"),
            e["tag_id"].alias("tag_id"),
            F.coalesce(follower["tag_id"], F.lit(0)).alias("next_id"),
        ),
    )
    walk = walk.withColumn("_walk", steps)
    opened = F.filter("_walk", lambda e: e["kind"] == 1)
    closed = F.sort_array(F.filter("_walk", lambda e: e["kind"] == 0))
    nodes = F.zip_with(
        opened,
        closed,
        lambda o, c: F.struct(
            o["pos"].alias("pos"),
            o["tag_id"].alias("tag_id"),
            o["next_id"].alias("left_id"),
            c["next_id"].alias("right_id"),
        ),
    )
    return walk.withColumn("binary", nodes).drop("_walk")


def structural_grams(df: DataFrame) -> DataFrame:
    """Add ``gram_list``: one "node.left.right" string per node of ``binary``.

    A root without id prints ``None``; a page without a tree has ``None.0.0``.
    """
    text = F.transform(
        "binary",
        lambda n: F.concat_ws(
            ".",
            F.coalesce(n["tag_id"].cast("string"), F.lit("None")),
            n["left_id"].cast("string"),
            n["right_id"].cast("string"),
        ),
    )
    return df.withColumn(
        "gram_list", F.coalesce(text, F.array(F.lit("None.0.0")))
    )


def gram_set(df: DataFrame) -> DataFrame:
    """Add ``grams``: the distinct 3-grams, sorted."""
    return df.withColumn("grams", F.sort_array(F.array_distinct("gram_list")))


def gram_vector(df: DataFrame, n: int) -> DataFrame:
    """Add ``vec``: map from flattened index ``i*n*n + j*n + k`` to count.

    Counting is a run-length encoding of the sorted indexes. Nodes without an
    id have no cell.
    """
    cells = F.transform(
        F.filter("binary", lambda b: b["tag_id"].isNotNull()),
        lambda b: b["tag_id"] * (n * n) + b["left_id"] * n + b["right_id"],
    )
    out = df.withColumn(
        "_cells", F.coalesce(F.sort_array(cells), F.array().cast("array<int>"))
    )
    pairs = F.zip_with(
        "_cells",
        F.concat(F.array(F.lit(-1)), F.col("_cells")),
        lambda cell, before: F.struct(cell.alias("cell"), before.alias("before")),
    )
    indexed = F.transform(
        pairs,
        lambda p, i: F.struct(
            p["cell"].alias("cell"), p["before"].alias("before"), i.alias("at")
        ),
    )
    runs = F.filter(indexed, lambda p: p["cell"] != p["before"])
    out = out.withColumn("_runs", runs)
    counts = F.zip_with(
        F.col("_runs"),
        F.concat(
            F.transform(
                F.expr("slice(_runs, 2, greatest(size(_runs) - 1, 0))"),
                lambda r: r["at"],
            ),
            F.array(F.size("_cells")),
        ),
        lambda run, stop: (stop - run["at"]).cast("bigint"),
    )
    keys = F.transform("_runs", lambda r: r["cell"])
    vec = F.when(F.size("_runs") > 0, F.map_from_arrays(keys, counts)).otherwise(
        F.create_map().cast("map<int,bigint>")
    )
    return out.withColumn("vec", vec).drop("_cells", "_runs")


def page_features(
    df: DataFrame, html: str = "html", vocab: Vocabulary = REFERENCE
) -> DataFrame:
    """Pages to ``grams`` and ``vec`` (and ``errors``), one narrow pass."""
    tree = binary_tree(structural_tree(df, html, vocab))
    features = gram_vector(gram_set(structural_grams(tree)), vocab.size)
    return features.drop("tree", "binary", "gram_list", html)
