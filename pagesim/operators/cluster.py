"""Clusters of similar pages: connected components over sketches.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Each step is a minimum per node,
combined on the map side, joined back to the edges; no neighbour list is ever
collected. Every round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .lsh import Index


def bucket_edges(bands: DataFrame) -> DataFrame:
    """Edges ``a, b`` from each sketch to the smallest sketch of each of its buckets.

    They connect exactly what sharing a bucket connects, with one edge per
    band row in place of one per pair.
    """
    centre = bands.groupBy("band", "band_hash").agg(
        F.min("sketch_id").alias("a"), F.count("*").alias("n")
    )
    # written, so that a hot bucket is a plain key of two scans, which can be split
    edges = bands.join(materialize(centre.filter("n > 1"), "centres"), ["band", "band_hash"])
    return edges.filter("a <> sketch_id").select("a", F.col("sketch_id").alias("b")).distinct()


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Join ``u, v`` with the written minimum ``m`` of each ``u``.

    The centre of a giant component has most edges. Both sides of this join are
    plain scans, so adaptive execution can split that key; it can't when one
    side is an aggregate of the same stage.
    """
    return edges.join(materialize(low, "low"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = _with_low(both.filter("v > u"), low)
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(low, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _fingerprint(edges: DataFrame):
    h = F.xxhash64("a", "b")
    return edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(h).alias("x"),
        F.sum(F.pmod(h, F.lit(1 << 40))).alias("s"),
    ).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge; the root is its component's smallest node."""
    edges = materialize(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
        "edges",
    )
    seen = None
    while (now := _fingerprint(edges)) != seen:  # each step that changes edges lowers one
        seen = now
        starred = materialize(_large_star(edges), "edges")
        edges = materialize(_small_star(starred), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def cluster_pages(index: Index, pairs: DataFrame | None = None) -> DataFrame:
    """``url, cluster, cluster_size`` of every indexed URL.

    Pages are linked when they share an LSH bucket, or, given scored ``pairs``
    (``a, b`` of sketches), when they are in one of those pairs. Copies are
    always together. A cluster is named by its smallest URL.
    """
    linked = components(bucket_edges(index.bands) if pairs is None else pairs.select("a", "b"))
    linked = materialize(linked.withColumnRenamed("node", "sketch_id"), "linked")
    labelled = index.members.select("url", "sketch_id").join(linked, "sketch_id", "left")
    labelled = materialize(labelled.select("url", F.coalesce("root", "sketch_id").alias("root")), "labelled")
    names = labelled.groupBy("root").agg(
        F.min("url").alias("cluster"), F.count("*").alias("cluster_size")
    )
    return labelled.join(materialize(names, "names"), "root").select("url", "cluster", "cluster_size")
