"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are merged first and carried with their number. Centres from a
bounded sample cut the rest into overlapping shards: a vector is stored in the
shards of its ``overlap`` nearest centres and searched for in those of its
``probes`` nearest. A shard of more than ``BLOCK`` vectors is dealt out as blocks.

Build: each block picks, per vector, neighbours from its nearest candidates and
some random ones by robust pruning (a candidate goes if a kept one is ``ALPHA``
times closer to it). A vector's lists from all its shards are united with the
reverse edges; where that makes more than twice ``degree`` of them, the walk's
list is pruned robustly again, so that a hub is no wider than the rest.

Search: in each block, queries walk greedily from the closest of the block's
medoids, with a beam; a query that is a node of the block starts at itself too.
Where a walk comes within range, its range is expanded over the graph's in-range
edges, the pruned reverse ones included. What the expansion reached is verified by the exact cosine in double
precision, block by block with matrix products; pairs are counted there, never
written. A pair met in several shards counts in the first of the stored vector's
shards that the query probes.

Audit: a bounded sample of vectors is compared with all rows. Each vector has a
recall of its own; their mean is taken among those with few links and among those
with many, and the lower one counts, so that neither a hot group nor many small
ones hide the other. Below ``RECALL`` every number of ``Effort`` is doubled and the
search runs again, at most ``ROUNDS`` times. If that isn't enough, vectors are
compared exactly: each is stored in one shard and asks every shard that the
triangle bound on angles can't rule out, in blocks. That is quadratic where the
bound rules out little, but no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cluster import components
from ..session import materialize
from .common import table

COSINE = 0.9
SHARD = 512  # distinct vectors per centre
CENTRES = 1 << 14  # most centres
SAMPLE = 1 << 14  # vectors the centres are fitted on, or SAMPLE_BYTES of them
SAMPLE_BYTES = 64 << 20
BLOCK, QUERIES = 4096, 8192
RANDOM = 8  # random candidates per vector
ALPHA = 1.2
AUDIT, RECALL = 1024, 0.99
ROUNDS = 3  # times the effort is doubled
CELLS = 1 << 22  # most numbers of a matrix that is made at once


class Effort(NamedTuple):
    """How widely the graph is built and searched."""

    overlap: int = 2  # shards a vector is stored in
    probes: int = 5  # shards it is searched for in
    pool: int = 40  # nearest candidates of a vector
    degree: int = 20  # neighbours it keeps
    beam: int = 12
    steps: int = 12

    def wider(self) -> Effort:
        return Effort(*(2 * number for number in self))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    # by the largest component first: squares of very small or large ones stay in range
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=1e-320)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _lists(column) -> np.ndarray:
    """Equally long lists of an Arrow column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centres(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means on a sample; random members if there are very many centres."""
    rng = np.random.default_rng(7)
    centres = sample[np.sort(rng.permutation(len(sample))[:count])]
    for _ in range(rounds if count <= 2048 else 0):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _choose(unit: np.ndarray, rows: np.ndarray, cut: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of the candidates ``cut`` (-1 for none) of each row, by robust pruning."""
    own = np.einsum("ijd,id->ij", unit[cut], unit[rows])
    own[cut < 0] = -3
    order = np.argsort(-own, axis=1, kind="stable")
    cut, own = np.take_along_axis(cut, order, axis=1), np.take_along_axis(own, order, axis=1)
    alive = (cut >= 0) & (cut != rows[:, None])
    vectors = unit[cut]
    out = np.full((len(rows), degree), -1)
    line = np.arange(len(rows))
    for k in range(min(degree, cut.shape[1])):
        first = alive.argmax(axis=1)
        some = alive[line, first]
        if not some.any():
            break
        out[some, k] = cut[line[some], first[some]]
        among = np.einsum("ijd,id->ij", vectors, vectors[line, first])  # candidates with the kept one
        alive &= ~(ALPHA * (1 - among) <= 1 - own) | ~some[:, None]
        alive[line, first] = False
    return out


def robust_prune(unit: np.ndarray, effort: Effort = Effort()) -> np.ndarray:
    """Neighbours (positions, -1 for none) of every row of a block."""
    size, width = unit.shape
    rng = np.random.default_rng(size)
    out = np.full((size, effort.degree), -1)
    if size < 2:
        return out
    pool = min(effort.pool, size - 1)
    step = int(np.clip(CELLS // ((pool + RANDOM) * width), 1, 256))
    for at in range(0, size, step):
        rows = np.arange(at, min(at + step, size))
        near = unit[rows] @ unit.T
        near[np.arange(len(rows)), rows] = -2
        cut = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        cut = np.concatenate([cut, rng.integers(0, size, (len(rows), RANDOM))], axis=1)
        out[rows] = _choose(unit, rows, cut, effort.degree)
    return out


def walk_graph(unit: np.ndarray, row: np.ndarray, to: np.ndarray, effort: Effort = Effort()) -> np.ndarray:
    """Edges ``row, to`` (by row) as a matrix of at most ``2 * degree`` neighbours, longer lists pruned."""
    size, most = len(unit), 2 * effort.degree
    many = np.bincount(row, minlength=size)
    begin = np.cumsum(many) - many
    graph = np.full((size, max(1, min(most, int(many.max(initial=0))))), -1)
    short = many[row] <= most
    graph[row[short], (np.arange(len(row)) - begin[row])[short]] = to[short]
    hubs = np.flatnonzero(many > most)
    hubs = hubs[np.argsort(many[hubs], kind="stable")[::-1]]
    at = 0
    while at < len(hubs):  # lists of like length, so many at once that the matrix stays small
        width = int(many[hubs[at]])
        rows = hubs[at : at + max(1, CELLS // (width * unit.shape[1]))]
        nth = np.arange(width)[None, :]
        cut = np.where(nth < many[rows][:, None], to[np.minimum(begin[rows][:, None] + nth, len(to) - 1)], -1)
        graph[rows] = _choose(unit, rows, cut, most)
        at += len(rows)
    return graph


def _greedy(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, effort: Effort) -> np.ndarray:
    """The ``beam`` best positions per query that a walk over the graph from ``start`` meets."""
    count, held = len(queries), max(effort.beam, start.shape[1])
    beam = np.full((count, held), -1)
    score = np.full((count, held), -3.0)
    done = np.zeros((count, held), dtype=bool)

    def offer(rows: np.ndarray, found: np.ndarray) -> None:
        gain = np.einsum("ijd,id->ij", unit[found], queries[rows])
        gain[found < 0] = -3
        ids = np.concatenate([beam[rows], found], axis=1)
        values = np.concatenate([score[rows], gain], axis=1)
        past = np.concatenate([done[rows], np.zeros(found.shape, dtype=bool)], axis=1)
        # one entry per node: by node, visited first, then blank out the rest
        order = np.lexsort((~past, ids), axis=1)
        ids, values, past = (np.take_along_axis(x, order, axis=1) for x in (ids, values, past))
        values[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
        best = np.argsort(-values, axis=1, kind="stable")[:, :held]
        beam[rows], score[rows], done[rows] = (np.take_along_axis(x, best, axis=1) for x in (ids, values, past))

    every = np.arange(count)
    offer(every, start)
    for _ in range(effort.steps):
        open_score = np.where(done | (score <= -3), -4, score)
        pick = open_score.argmax(axis=1)
        rows = every[open_score[every, pick] > -4]
        if not len(rows):
            break
        done[rows, pick[rows]] = True
        offer(rows, graph[beam[rows, pick[rows]]])
    return np.where(score > -3, beam, -1)


def _regions(unit: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The region of each node: what in-range edges ``a, b`` connect."""
    step = max(1, CELLS // unit.shape[1])
    near = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        near[part] = np.einsum("id,id->i", unit[a[part]], unit[b[part]]) >= least
    a, b = a[near], b[near]
    label = np.arange(len(unit))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    # regions whose first members are in range are one
    heads = np.unique(label[np.bincount(label, minlength=len(label))[label] > 1])
    if 1 < len(heads) <= 2048:
        close = unit[heads] @ unit[heads].T >= least
        merged = heads[close.argmax(axis=1)]
        onto = np.arange(len(unit))
        onto[heads] = merged
        label = onto[label]
    return label


def search_block(stored: dict, queries: dict, shard: int, least: float = COSINE, effort: Effort | None = Effort()) -> tuple:
    """``(counts per query, edge ends, edge roots)`` of one block of a shard.

    ``stored`` has ids, n, unit, places and edges (rows and their neighbours, by
    row); ``queries`` ids, unit, places. Without an effort all are compared.
    """
    unit, ids = stored["unit"], stored["ids"]
    counts = np.zeros(len(queries["ids"]), dtype=np.int64)
    if effort is None:
        region = np.zeros(len(unit), dtype=np.int64)
    else:
        graph = walk_graph(unit, *stored["edges"], effort)
        spread = max(1, int(np.sqrt(len(unit)) / 2))
        medoids = np.unique((unit @ fit_centres(unit, spread, 2).T).argmax(axis=0))
        region = _regions(unit, *stored["edges"], least)
    members = np.argsort(region, kind="stable")
    bounds = np.searchsorted(region[members], np.arange(len(unit) + 1))
    step = 1024 if effort is None else int(np.clip(CELLS // (graph.shape[1] * unit.shape[1]), 64, 1024))
    ends, roots = [], []
    for at in range(0, len(counts), step):
        own = slice(at, at + step)
        vectors, own_ids = queries["unit"][own], queries["ids"][own]
        if effort is None:
            who, what = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        else:
            start = np.full((len(vectors), 4), -1)
            close = vectors @ unit[medoids].T
            top = np.argsort(-close, axis=1, kind="stable")[:, :3]
            start[:, : top.shape[1]] = medoids[top]
            here = np.minimum(np.searchsorted(ids, own_ids), len(ids) - 1)
            start[:, 3] = np.where(ids[here] == own_ids, here, -1)
            met = _greedy(unit, graph, vectors, start, effort)
            near = (np.einsum("ijd,id->ij", unit[met], vectors) >= least - 0.02) & (met >= 0)
            who, k = np.nonzero(near)
            hits = np.unique(who * len(unit) + region[met[who, k]])  # query and region
            who, what = hits // len(unit), hits % len(unit)
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        cuts = np.flatnonzero(np.diff(what, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            q, m = who[a:b], members[bounds[what[a]] : bounds[what[a] + 1]]
            exact = vectors[q] @ unit[m].T >= least
            exact &= own_ids[q][:, None] != ids[m][None, :]
            some, any_ = exact.any(axis=1), exact.any(axis=0)
            if not some.any():
                continue
            q, m, exact = q[some], m[any_], exact[some][:, any_]
            # a shard that comes earlier among the stored vector's, and that the query probes, counts the pair
            counted, first = exact.copy(), np.ones(len(m), dtype=bool)
            for places in stored["places"][m].T:
                first &= places != shard
                if not first.any():
                    break
                probed = (places[None, first, None] == queries["places"][own][q][:, None, :]).any(axis=2)
                counted[:, first] &= ~probed
            counts[at + q] += (counted * stored["n"][m][None, :]).sum(axis=1)
            for found in _forest(own_ids[q], ids[m], exact):
                ends.append(found[0])
                roots.append(found[1])
    empty = np.zeros(0, dtype=np.int64)
    return counts, np.concatenate(ends or [empty]), np.concatenate(roots or [empty])


def _forest(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> Iterator[tuple]:
    """Edges that connect what a block of links between two id lists connects."""
    far = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        low = np.minimum(a, np.where(linked, b[None, :], far).min(axis=1))
        new = np.minimum(b, np.where(linked, low[:, None], far).min(axis=0))
        if (low == a).all() and (new == b).all():
            break
        a, b = low, new
    for own, root in ((left, a), (right, b)):
        use = own != root
        yield own[use], root[use]


PLACED = "id long, n long, v array<double>, places array<int>"


def _int_lists(rows: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(rows.astype(np.int32)))


def _nearest(close: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` columns with the largest numbers of each row, largest first."""
    top = np.argpartition(-close, min(count, close.shape[1]) - 1, axis=1)[:, :count]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, axis=1), axis=1, kind="stable"), axis=1)


def _place(centres, count: int, width: int):
    """Batches with ``places``: the nearest ``count`` centres of each vector, nearest first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(centres.value))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                top = _nearest(_unit(_matrix(part.column(2), width)) @ centres.value.T, count)
                places = _int_lists(top.ravel(), np.full(len(top), top.shape[1]))
                yield pa.RecordBatch.from_arrays([*part.columns, places], names=[*part.schema.names, "places"])

    return place


def _within(placed: DataFrame, centres, width: int, least: float) -> DataFrame:
    """``placed`` with ``asks``: the shards whose vectors, by their angles to the centre, can be in range.

    Only the first of ``places`` counts as the shard a vector is stored in.
    """
    norms = np.linalg.norm(centres.value, axis=1)

    def close_to(batch: pa.RecordBatch) -> np.ndarray:
        return _unit(_matrix(batch.column(2), width)) @ centres.value.T / norms

    step = max(1, CELLS // len(norms))

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full(len(norms), 2.0)
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                own = _lists(part.column(3))[:, 0]
                np.minimum.at(low, own, close_to(part)[np.arange(len(own)), own])
        held = np.flatnonzero(low < 2)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(low[held])], names=["shard", "low"])

    found = placed.mapInArrow(widest, "shard long, low double").groupBy("shard").agg(F.min("low").alias("low")).toArrow()
    reach = np.full(len(norms), 3.0)  # at most CENTRES numbers; an empty shard is asked by none
    angle = np.arccos(np.clip(found["low"].to_numpy(), -1, 1)) + np.arccos(np.clip(least, -1, 1)) + 1e-6
    reach[found["shard"].to_numpy()] = np.where(angle >= np.pi, -2, np.cos(np.minimum(angle, np.pi)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                asked, shards = np.nonzero(close_to(part) >= reach[None, :])
                asks = _int_lists(shards, np.bincount(asked, minlength=len(part)))
                yield pa.RecordBatch.from_arrays([*part.columns, asks], names=[*part.schema.names, "asks"])

    return placed.mapInArrow(ask, f"{PLACED}, asks array<int>")


def _search(vectors: DataFrame, centres, effort: Effort | None, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``id, n_links`` and edges ``a, b`` of distinct vectors (``id, n, v``); exactly without an effort."""
    overlap, probes = (effort.overlap, effort.probes) if effort else (1, 1)
    placed = materialize(vectors.mapInArrow(_place(centres, max(overlap, probes), width), PLACED), "graph-placed")
    if effort:
        placed = placed.withColumn("asks", F.slice("places", 1, probes))
    else:
        placed = materialize(_within(placed, centres, width, least), "graph-asking")
    wide = F.slice("places", 1, overlap)
    sizes = placed.select(F.explode(wide).alias("shard")).groupBy("shard").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    seekers = placed.select(F.explode("asks").alias("shard")).groupBy("shard").agg(
        F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")
    )
    sizes = F.broadcast(materialize(sizes.join(seekers, "shard"), "graph-sizes"))  # at most CENTRES rows
    stored = placed.select("id", "n", "v", wide.alias("places"), F.explode(wide).alias("shard")).join(sizes, "shard")
    stored = materialize(stored.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "graph-stored")

    def build(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        found = robust_prune(_unit(_matrix(group["v"], width)), effort)
        # robust pruning keeps one direction; the other end gets the edge too
        a, k = np.nonzero(found >= 0)
        b = found[a, k]
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "near": np.concatenate([ids[b], ids[a]])})

    if not effort:
        listed = stored.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        edges = stored.select("shard", "block", "id", "v").groupBy("shard", "block").applyInArrow(build, "id long, near long")
        # a block gives a vector at most one edge per other one, so a list has at most overlap * BLOCK or so
        lists = materialize(edges.groupBy("id").agg(F.collect_set("near").alias("near")), "graph-lists")
        listed = stored.join(lists, "id", "left")
    kept = listed.select(
        "shard", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_stored"),
        "id", "n", "v", "places", F.coalesce("near", F.array().cast("array<long>")).alias("near"),
    )
    # where all are compared a vector is stored once, so that who asks where need not go along
    asks = F.col("asks") if effort else F.col("places")
    asked = placed.select("id", "n", "v", asks.alias("places"), F.explode("asks").alias("shard"))
    asked = asked.join(sizes, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int").alias("part"), F.lit(False).alias("is_stored"),
        "id", "n", "v", "places", F.array().cast("array<long>").alias("near"),
    )

    def search(key: tuple, group: pa.Table) -> pa.Table:
        mask = group["is_stored"].to_numpy()
        nodes, asking = group.filter(pa.array(mask)), group.filter(pa.array(~mask))
        counts, ends, roots = np.zeros(len(asking), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(nodes) and len(asking):
            nodes = nodes.sort_by("id")
            ids = nodes["id"].to_numpy()
            near = nodes["near"].combine_chunks()
            row = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy(zero_copy_only=False))
            flat = near.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            row, at = row[ids[at] == flat], at[ids[at] == flat]  # neighbours that are in this block
            counts, ends, roots = search_block(
                {
                    "ids": ids, "n": nodes["n"].to_numpy(), "unit": _unit(_matrix(nodes["v"], width)),
                    "places": _lists(nodes["places"]), "edges": (row, at),
                },
                {"ids": asking["id"].to_numpy(), "unit": _unit(_matrix(asking["v"], width)), "places": _lists(asking["places"])},
                key[0].as_py(), least, effort,
            )
        return pa.table(
            {
                "id": np.concatenate([asking["id"].to_numpy(), ends]),
                "n_links": pa.array([*counts.tolist(), *[None] * len(ends)], pa.int64()),
                "root": pa.array([*[None] * len(counts), *roots.tolist()], pa.int64()),
            }
        )

    cells = kept.unionByName(asked).groupBy("shard", "block", "part")
    out = materialize(cells.applyInArrow(search, "id long, n_links long, root long"), "graph-found")
    links = out.filter("n_links > 0").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    return links, out.filter("root is not null").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()


def _audit(vectors: DataFrame, links: DataFrame, total: int, width: int, least: float) -> float:
    """The lower mean recall, of vectors with few links or with many, in a bounded sample compared with all rows."""
    spark = vectors.sparkSession
    share = min(1.0, 4 * AUDIT / max(total, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = picked.select("id", "v").limit(AUDIT).toArrow()
    if not len(picked):
        return 1.0
    ids = picked["id"].to_numpy()
    sample = spark.sparkContext.broadcast(_unit(_matrix(picked["v"], width)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                linked = sample.value @ _unit(_matrix(part.column(2), width)).T >= least
                linked &= ids[:, None] != part.column(0).to_numpy()[None, :]
                sums += (linked * part.column(1).to_numpy()[None, :]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["id", "wanted"])

    wanted = vectors.mapInArrow(compare, "id long, wanted long").groupBy("id").agg(F.sum("wanted").alias("wanted"))
    both = wanted.filter("wanted > 0").join(links, "id", "left")
    both = both.select("wanted", F.coalesce("n_links", F.lit(0)).alias("got")).toArrow()  # at most AUDIT rows
    return recall_of(both["wanted"].to_numpy(), both["got"].to_numpy())


def recall_of(wanted: np.ndarray, got: np.ndarray) -> float:
    """Mean share found per vector, the lower one of those with at most the median number of links and those with more."""
    if not len(wanted):
        return 1.0
    share = np.minimum(wanted, got) / wanted
    few = wanted <= np.median(wanted)
    return float(min(share[part].mean() for part in (few, ~few) if part.any()))


def near_duplicates(
    table_: DataFrame, least: float = COSINE, key: str = "vec_id", vector: str = "embedding", effort: Effort = Effort()
) -> DataFrame:
    """``key, n_links, component_id, kept, audit_recall`` of every row.

    ``n_links`` counts the other rows at a cosine of ``least`` or more,
    ``component_id`` is the smallest key reachable by links (the row's own for
    one without). Vectors that are null, empty or zero or hold a null or a
    non-finite component link with nothing. Shorter vectors compare as if filled
    up with zeros. Rows with a null key are returned without links. Keys are
    taken to be unique; rows that share one are returned each with its links.
    Other columns are not read.
    """
    spark = table_.sparkSession
    rows = table_.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = materialize(rows.withColumn("v", F.when(usable, F.col("v"))), "graph-rows")
    good = rows.filter("v is not null")
    distinct = materialize(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v"), "graph-vectors")
    total, width = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return rows.select(
            F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"),
        )
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, 1.2 * size / total)
    sample = distinct.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(size).toArrow()
    count = int(min(CENTRES, max(1, -(-total // SHARD)), max(1, len(sample))))
    units = _unit(_matrix(sample["v"], width)) if len(sample) else np.ones((1, width))
    centres = spark.sparkContext.broadcast(fit_centres(units, count))
    for left in range(ROUNDS, -2, -1):
        # with every shard stored and asked, wider walks are all that is left to widen
        now = effort._replace(overlap=min(effort.overlap, count), probes=min(effort.probes, count)) if left >= 0 else None
        links, edges = _search(distinct, centres, now, width, least)
        links = materialize(links, "graph-links")
        recall = _audit(distinct, links, total, width, least)
        if recall >= RECALL:
            break
        effort = effort.wider()
    roots = components(edges)
    named = distinct.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(
        named.select(
            "v", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")
        ),
        "graph-named",
    )
    joined = rows.join(named, "v", "left")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
        F.lit(recall).alias("audit_recall"),
    )


def op3_embedding_graph(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
