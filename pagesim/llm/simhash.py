"""SimHash near-duplicates, paired exactly with vantage-point trees.

A text's fingerprint has 64 bits: bit i is set if it is set in more than half of
the XXH64 hashes of its word 3-shingles. Fingerprints that differ in at most
``RADIUS`` bits are linked and linked documents form components.

Equal fingerprints are merged first, so a text copied a million times is one
point. Of two points that differ in RADIUS bits, the upper or the lower halves
differ in ``RADIUS // 2`` bits at most, so there is one vantage-point tree per
half, fitted on a bounded sample: a node holds a vantage point and a radius r;
points whose half is at Hamming distance d <= r + RADIUS // 2 go to the near
side, points with d > r to the far side. By the triangle inequality two halves
that close meet on one side at least, so the leaves, which overlap at their
boundaries only, hold every linked pair. The smaller radius of the halves keeps
the boundaries thin: a level copies a seventh of its points, not a third.
Leaves are the shards of the search and compare whole fingerprints. One that
outgrows ``2 * CELL`` points (a tight group that no vantage point cuts) is dealt out
as block-by-block cells, and any two points of the leaf meet in one cell.

A cell returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.cluster import components
from ..session import materialize
from .common import table

RADIUS = 3
HALVES = 2
SHINGLE = 3
SEED = 42
SAMPLE = 1 << 15  # points the tree is fitted on at most (twice that for safety)
CELL = 4096
LEAVES = 1 << 14  # most leaves of a tree

_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle of a text, repeats included."""
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], SEED) for a, b in zip(starts, stops)]


def fingerprint(text: str | None, step: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text; 0 for null and for a text without words."""
    hashes = shingle_hashes(text or "")
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype=np.uint64)
    for at in range(0, len(values), step):
        bits = np.unpackbits(values[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint of a text column, as a signed long."""
    return F.pandas_udf(_simhash, "long")(text)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def half(points: np.ndarray, number: int) -> np.ndarray:
    """One of the ``HALVES`` equal parts of fingerprints."""
    width = 64 // HALVES
    return points >> np.uint64(width * number) & np.uint64((1 << width) - 1)


def grow_tree(sample: np.ndarray, points: int, cell: int = CELL, radius: int = RADIUS // HALVES) -> list:
    """Nodes ``(vantage, r, near, far)`` fitted on a sample of ``points`` points.

    ``near`` and ``far`` are node numbers, or -1 - leaf. The radius of a node is
    the one that leaves the larger side smallest; a node that cuts little off
    becomes a leaf.
    """
    nodes: list = []
    leaves = [0]
    most = max(8, round(cell * len(sample) / max(points, 1)))

    def leaf() -> int:
        leaves[0] += 1
        return -leaves[0]

    def grow(own: np.ndarray) -> int:
        if len(own) <= most or leaves[0] + len(nodes) >= LEAVES // 2:
            return leaf()
        best = None
        for vantage in own[np.linspace(0, len(own) - 1, 16).astype(int)]:
            counts = np.cumsum(np.bincount(distance(own, vantage), minlength=65 + radius))
            near, far = counts[radius : 65 + radius], len(own) - counts[:65]
            larger = np.maximum(near, far)
            r = int(larger.argmin())
            if best is None or larger[r] < best[0]:
                best = (larger[r], vantage, r)
        size, vantage, r = best
        if size > 0.9 * len(own):
            return leaf()
        d = distance(own, vantage)
        number = len(nodes)
        nodes.append(None)
        nodes[number] = (int(vantage), r, grow(own[d <= r + radius]), grow(own[d > r]))
        return number

    root = grow(sample)
    return nodes if nodes else [(0, 64, root, root)]


def leaves_of(points: np.ndarray, nodes: list, radius: int = RADIUS // HALVES) -> tuple[np.ndarray, np.ndarray]:
    """``(position, leaf)`` of every leaf that each point goes to."""
    at, found = [(0, np.arange(len(points)))], []
    while at:
        number, own = at.pop()
        if not len(own):
            continue
        if number < 0:
            found.append((own, np.full(len(own), -1 - number, dtype=np.int32)))
            continue
        vantage, r, near, far = nodes[number]
        d = distance(points[own], np.uint64(vantage))
        at.append((near, own[d <= r + radius]))
        at.append((far, own[d > r]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(points: np.ndarray, radius: int = RADIUS, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``(point, root)`` for the points linked with another one of a cell.

    First the points with a link are found, block by block; then each component
    among them is searched from its first point against what is not yet visited,
    so that a cell of n points needs memory for step * n and returns under n rows.
    """
    points = np.unique(points)
    linked = np.zeros(len(points), dtype=bool)
    for at in range(0, len(points), step):
        near = distance(points[at : at + step, None], points[None, at:]) <= radius
        near[np.arange(len(near)), np.arange(len(near))] = False
        linked[at:] |= near.any(axis=0)
        linked[at : at + step] |= near.any(axis=1)
    rest = points[linked]
    ends, roots = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            head, front = front[:step], front[step:]
            hit = (distance(head[:, None], rest[None, :]) <= radius).any(axis=0)
            got, rest = rest[hit], rest[~hit]
            ends.append(got)
            roots.append(np.full(len(got), root))
            front = np.concatenate([front, got])
    if not ends:
        return points[:0], points[:0]
    return np.concatenate(ends), np.concatenate(roots)


def links(points: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``a, b``: edges that connect what linked pairs of ``points`` (column ``fp``) connect.

    ``points`` must hold distinct fingerprints.
    """
    spark = points.sparkSession
    total = points.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64)).view(np.uint64)
    sample = np.random.default_rng(SEED).permutation(sample)
    reach = radius // HALVES
    trees = spark.sparkContext.broadcast([grow_tree(half(sample, k), total, cell, reach) for k in range(HALVES)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for k, nodes in enumerate(trees.value):
                at, leaf = leaves_of(half(own.view(np.uint64), k), nodes, reach)
                yield pa.RecordBatch.from_arrays([pa.array(leaf + k * LEAVES), pa.array(own[at])], names=["leaf", "fp"])

    dealt = materialize(points.select("fp").mapInArrow(deal, "leaf int, fp long"), "simhash-leaves")
    blocks = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    cells = (
        dealt.join(F.broadcast(blocks), "leaf")  # at most HALVES * LEAVES rows
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )

    def search(group: pa.Table) -> pa.Table:
        end, root = forest(group["fp"].to_numpy().view(np.uint64), radius)
        return pa.table({"a": root.view(np.int64), "b": end.view(np.int64)})

    return cells.groupBy("leaf", "x", "y").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id``: every document's fingerprint and the smallest key of its component.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows
    with a null key are linked too, but a component is named by its smallest
    key that is not null (null if it has none). Repeated rows stay. Columns
    other than the two are not read.
    """
    prints = materialize(docs.select(F.col(key).alias("key"), simhash(F.col(text)).alias("fp")), "simhash-prints")
    points = materialize(prints.groupBy("fp").agg(F.min("key").alias("first")), "simhash-points")
    roots = components(links(points.select("fp"))).withColumnRenamed("node", "fp")
    rooted = materialize(
        points.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    named = materialize(rooted.join(names, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def op10_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
