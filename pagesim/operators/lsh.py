"""LSH lookups and scored similarity, on the index tables.

An index is three tables: ``members`` (url, sketch_id and, for pages, the count
vector), ``sketches`` (one row per distinct set: grams, sig) and ``bands`` (one
row per sketch and band). Everything that can blow up on copies works on
sketches; URLs are attached last.

The tables of a stored index are cut into shards by a hash of the key they are
looked up by. A lookup joins on the shard too: where its side is small enough to
be broadcast, only the shards that it names are read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sketch as fn
from ..session import materialize
from .sketches import band_index, members_table, minhash_sets, sketches_table

BUCKET_BLOCK = 512
TASK_PAIRS = 1 << 19  # pairs of pages that a task spells out
EMPTY_SET = hashlib.md5(b"").hexdigest()  # the sketch_id of a set without items
SELF_MARK = "*"
SHARD = "shard"


@dataclass(frozen=True)
class Index:
    members: DataFrame
    sketches: DataFrame
    bands: DataFrame
    n_bands: int = fn.BANDS
    n_rows: int = fn.ROWS
    vocabulary: str | None = None  # names the vocabulary behind the items, if known
    shards: int = 0  # of the stored tables; 0 for tables that are not cut
    rows: DataFrame | None = None  # a written table of the sketches in which copies are not merged yet


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def look_up(keys: DataFrame, table: DataFrame, on: list[str], key: str, shards: int) -> DataFrame:
    """Join a written table of keys to an index table that is sharded by ``key``.

    The filter keeps all rows: Spark prunes the partitions of one side of a join
    only if the other side is filtered.
    """
    if not shards:
        return keys.join(table, on)
    placed = keys.withColumn(SHARD, shard_of(F.col(key), shards)).filter(F.col(SHARD) >= 0)
    return placed.join(table, [*on, SHARD])


def index_tables(features: DataFrame, bands: int = fn.BANDS, rows: int = fn.ROWS,
                 items: str = "grams") -> Index:
    """Index of ``url``, a sorted set column ``grams`` and optionally ``vec``."""
    members = members_table(features, items)
    sketches = sketches_table(members, items)
    kept = members.select("url", "sketch_id", *(["vec"] if "vec" in features.columns else []))
    return Index(kept, sketches, band_index(sketches, bands, rows), bands, rows)


def stored_index(features: DataFrame, bands: int = fn.BANDS, rows: int = fn.ROWS,
                 items: str = "grams") -> Index:
    """Like :func:`index_tables`, written once to the shared work folder.

    For an index that several steps read: features and sketches are computed
    once, in one pass, and a lost executor costs no recomputation of what is written.
    Sets are not shuffled to merge copies; only those that are compared are.
    """
    keep = ["url", items, *(["vec"] if "vec" in features.columns else [])]
    written = materialize(minhash_sets(members_table(features.select(*keep), items), items), "members")
    band_rows = materialize(band_index(written, bands, rows).distinct(), "bands")
    every = written.select("sketch_id", F.col(items).alias("grams"), "sig")
    return Index(
        written.drop(items, "sig"), every.dropDuplicates(["sketch_id"]), band_rows, bands, rows, rows=every
    )


def query_index(features: DataFrame, bands: int = fn.BANDS, rows: int = fn.ROWS,
                items: str = "grams") -> Index:
    """Index of the pages of one lookup: a single table is written, which holds their sketches.

    Its size is known, so the planner sees whether the lookup can be pruned.
    """
    keep = ["url", items, *(["vec"] if "vec" in features.columns else [])]
    members = materialize(minhash_sets(members_table(features.select(*keep), items), items), "queries")
    sketches = members.select("sketch_id", F.col(items).alias("grams"), "sig").dropDuplicates(["sketch_id"])
    return Index(members.drop(items, "sig"), sketches, band_index(sketches, bands, rows), bands, rows)


def candidates(query_bands: DataFrame, bands: DataFrame, shards: int = 0) -> DataFrame:
    """Distinct ``query_sketch, sketch_id`` pairs that share a band.

    The distinct is partial before its shuffle; whether the query side is
    broadcast is left to adaptive execution, which knows its size.
    """
    queries = query_bands.withColumnRenamed("sketch_id", "query_sketch")
    met = look_up(queries.drop(SHARD), bands, ["band", "band_hash"], "band_hash", shards)
    return met.select("query_sketch", "sketch_id").distinct()


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str,
                n_bands: int, n_rows: int, shards: int = 0, min_jaccard: float | None = None) -> DataFrame:
    """Attach both sketches to sketch pairs; add ``jaccard_est`` and ``jaccard_exact``.

    Band keys are 60-bit hashes, so the shared band is checked on the signatures.
    The pairs are written first: few pairs are then broadcast to a scan of the
    sketches, many are shuffled to them. ``shards`` are those of ``right``.

    Tables that are not sharded may hold a sketch several times. Pairs meet the short
    signatures first; the sets follow for pairs that pass ``min_jaccard`` by them.
    """
    pairs = materialize(pairs, "pairs")
    if not shards:
        return _above(_score_apart(pairs, left, right, a, b, n_bands, n_rows, min_jaccard), "jaccard_est", min_jaccard)
    l = left.select(F.col("sketch_id").alias(a), F.col("sig").alias("_sa"), F.col("grams").alias("_ga"))
    r = right.select(F.col("sketch_id").alias(b), F.col("sig").alias("_sb"), F.col("grams").alias("_gb"), SHARD)
    both = look_up(pairs, r, [b], b, shards).join(l, a)
    both = both.filter(fn.shares_band(F.col("_sa"), F.col("_sb"), n_bands, n_rows))
    scored = both.select(
        *pairs.columns,
        fn.jaccard_est(F.col("_sa"), F.col("_sb")).alias("jaccard_est"),
        fn.jaccard_exact(F.col("_ga"), F.col("_gb")).alias("jaccard_exact"),
    )
    return _above(scored, "jaccard_est", min_jaccard)


def _attached(pairs: DataFrame, sketches: DataFrame, on: str, column: str, name: str) -> DataFrame:
    """A column of the sketches that ``on`` names, joined to written pairs.

    Which sketches are asked for is sent to them as 64-bit hashes where these are few enough, so
    that the others are not shuffled. The join goes by the whole id.
    """
    asked = materialize(pairs.select(F.xxhash64(on).alias("_key")).distinct(), "asked")
    near = sketches.join(asked, F.xxhash64("sketch_id") == F.col("_key"), "left_semi")
    one = near.select(F.col("sketch_id").alias(on), F.col(column).alias(name)).dropDuplicates([on])
    return pairs.join(one, on)


def _score_apart(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str,
                 n_bands: int, n_rows: int, min_jaccard: float | None) -> DataFrame:
    columns = pairs.columns
    # a sketch is itself, whatever it holds; of an empty set the exact similarity is null
    whole = F.when(F.col(a) != EMPTY_SET, 1.0)
    same = pairs.filter(F.col(a) == F.col(b)).select("*", F.lit(1.0).alias("jaccard_est"), whole.alias("jaccard_exact"))
    signed = materialize(pairs.filter(F.col(a) != F.col(b)), "pairs-apart")
    signed = _attached(_attached(signed, left, a, "sig", "_sa"), right, b, "sig", "_sb")
    signed = signed.filter(fn.shares_band(F.col("_sa"), F.col("_sb"), n_bands, n_rows))
    signed = signed.select(*columns, fn.jaccard_est(F.col("_sa"), F.col("_sb")).alias("jaccard_est"))
    signed = materialize(_above(signed, "jaccard_est", min_jaccard), "pairs-estimated")
    both = _attached(_attached(signed, left, a, "grams", "_ga"), right, b, "grams", "_gb")
    exact = fn.jaccard_exact(F.col("_ga"), F.col("_gb")).alias("jaccard_exact")
    return both.select(*columns, "jaccard_est", exact).unionByName(same)


def _sets(index: Index) -> DataFrame:
    """The sketches of an index as they were written."""
    return index.sketches if index.rows is None else index.rows


def _above(df: DataFrame, column: str, bound: float | None) -> DataFrame:
    return df if bound is None else df.filter(F.col(column) >= bound)


def similar_classes(queries: DataFrame | Index, index: Index, min_jaccard: float | None = None,
                    items: str = "grams") -> tuple[Index, DataFrame]:
    """The sketches of the index that share a band with each sketch of the queries, scored.

    Returns the index of the queries and ``query_sketch, sketch_id, jaccard_est, jaccard_exact``:
    copies are one sketch on both sides, so its size does not depend on how many there are.
    """
    if not isinstance(queries, Index):
        queries = query_index(queries, index.n_bands, index.n_rows, items)
    if queries.vocabulary and index.vocabulary and queries.vocabulary != index.vocabulary:
        raise ValueError("the query pages and the index were made with different vocabularies")
    if (queries.n_bands, queries.n_rows) != (index.n_bands, index.n_rows):
        raise ValueError("the query pages and the index are banded differently")
    met = candidates(queries.bands, index.bands, index.shards)
    if queries is index:  # each pair is met in both orders, and scored in one
        met = met.filter("query_sketch <= sketch_id")
    found = score_pairs(
        met, _sets(queries), _sets(index),
        "query_sketch", "sketch_id", index.n_bands, index.n_rows, index.shards, min_jaccard,
    )
    if queries is index:
        found = materialize(found, "found-once")
        turned = found.filter("query_sketch < sketch_id").select(
            F.col("sketch_id").alias("query_sketch"), F.col("query_sketch").alias("sketch_id"), *found.columns[2:]
        )
        found = found.unionByName(turned)
    return queries, found


def similar_pages(queries: DataFrame | Index, index: Index, min_jaccard: float | None = None,
                  max_cosine: float | None = None, include_self: bool = True,
                  items: str = "grams") -> DataFrame:
    """Pages of the index that share a band with each query page, scored.

    ``queries`` has ``url`` and the features the index was built from, or is an
    index itself. Returns ``query_url, url, jaccard_est, jaccard_exact`` and, with vectors,
    ``cosine_distance``. ``include_self`` adds the query itself as ``url*``.
    Without bounds every candidate is returned.
    """
    queries, found = similar_classes(queries, index, min_jaccard, items)
    query = queries.members
    with_vec = "vec" in index.members.columns and "vec" in query.columns
    q = query.select(
        F.col("url").alias("query_url"),
        F.col("sketch_id").alias("query_sketch"),
        *([F.col("vec").alias("_qv"), fn.square_sum(F.col("vec")).alias("_qn")] if with_vec else []),
    )
    # Written for its size too: the member table is the large one.
    hits = look_up(
        materialize(found.join(q, "query_sketch"), "found"), index.members, ["sketch_id"], "sketch_id", index.shards
    )
    columns = ["query_url", "url", "jaccard_est", "jaccard_exact"]
    if with_vec:
        columns.append("cosine_distance")
        hits = hits.withColumn(
            "cosine_distance", fn.cosine_distance(F.col("vec"), F.col("_qv"), squares_b=F.col("_qn"))
        )
    hits = hits.select(*columns)
    if include_self:
        hits = hits.unionByName(self_rows(q, with_vec))
    if max_cosine is not None:
        hits = hits.filter(F.col("cosine_distance") <= max_cosine)
    return hits


def self_rows(q: DataFrame, with_vec: bool) -> DataFrame:
    """Each query page as ``url*``; ``q`` has ``query_url`` and, with vectors, their squared length ``_qn``."""
    return q.select(
        "query_url",
        F.concat("query_url", F.lit(SELF_MARK)).alias("url"),
        F.lit(1.0).alias("jaccard_est"),
        F.lit(1.0).alias("jaccard_exact"),
        *(
            [F.when(F.col("_qn") == 0, F.lit(float("nan"))).otherwise(0.0)
             .alias("cosine_distance")]
            if with_vec else []
        ),
    )


def url_blocks(pages: DataFrame, carried: list[str], block: int = BUCKET_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pages of one sketch and one vector in rows of about ``block`` URLs, and the lines they are dealt to.

    ``pages`` is a written table of ``url, sketch_id, vec`` and the ``carried`` columns, by which
    rows are kept apart too. Returns ``sketch_id, vec, urls, form, slot`` with ``carried``, and per
    sketch its ``urls`` and ``lines``, of about ``block`` URLs each.
    """
    form = ["sketch_id", "form", *carried]
    named = pages.filter("url is not null").withColumn("form", fn.vector_id(F.col("vec")))
    sizes = named.groupBy(*form).agg(F.count("*").alias("copies")).filter(F.col("copies") > block)
    # written: a hot form can be split only in a join of two scans
    sized = named.join(materialize(sizes, "form-sizes"), form, "left")
    slot = F.pmod(F.xxhash64("url"), F.ceil(F.coalesce("copies", F.lit(1)) / block))
    rows = sized.withColumn("slot", slot).groupBy(*form, "slot")
    blocks = materialize(rows.agg(F.any_value("vec").alias("vec"), F.collect_list("url").alias("urls")), "url-blocks")
    lines = blocks.groupBy("sketch_id").agg(F.sum(F.size("urls")).alias("urls"))
    return blocks, lines.withColumn("lines", F.ceil(F.col("urls") / block).cast("int"))


def expand_pairs(found: DataFrame, queries: DataFrame, members: DataFrame, kept: Column,
                 carried: list[str] | None = None, block: int = BUCKET_BLOCK) -> DataFrame:
    """The pages behind scored pairs of sketches, with the distance of their vectors.

    All are written tables: ``found`` as :func:`similar_classes` gives it, the pages as ``url,
    sketch_id, vec``, the members with the ``carried`` columns. ``kept`` is a condition on
    ``query_url``, ``url`` and the carried columns. Returns ``query_url, url, jaccard_est,
    jaccard_exact, cosine_distance``.

    Pages of one sketch and one vector stand together, so that a distance is computed per pair
    of blocks and spelled out for their URLs. The blocks of a sketch are dealt to lines and the
    pairs of two sketches to line-by-line cells, so that no task gets all of a hot sketch. There are
    tasks by the number of pairs, which the bytes of the blocks don't tell.
    """
    carried = carried or []
    left, rows = url_blocks(queries, [], block)
    right, cols = url_blocks(members, carried, block)
    rows = rows.select(F.col("sketch_id").alias("query_sketch"), F.col("urls").alias("_an"), F.col("lines").alias("rows"))
    cols = cols.select("sketch_id", F.col("urls").alias("_bn"), F.col("lines").alias("cols"))
    met = materialize(found.join(rows, "query_sketch").join(cols, "sketch_id"), "found-lines")
    weight = met.agg(F.sum(F.col("_an") * F.col("_bn") + 16)).first()[0] or 0
    tasks = min(1 + weight // TASK_PAIRS, 1 << 14)
    cell = ["query_sketch", "sketch_id", "row", "col"]

    def line(lines: str) -> Column:
        return F.pmod(F.xxhash64("form", "slot"), F.col(lines)).cast("int")

    def every(lines: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(lines) - 1))

    a = met.join(left.withColumnRenamed("sketch_id", "query_sketch"), "query_sketch").select(
        "query_sketch", "sketch_id", line("rows").alias("row"), every("cols").alias("col"),
        "jaccard_est", "jaccard_exact", F.col("urls").alias("_au"), F.col("vec").alias("_av"),
    )
    b = met.select("query_sketch", "sketch_id", "rows", "cols").join(right, "sketch_id").select(
        "query_sketch", "sketch_id", every("rows").alias("row"), line("cols").alias("col"),
        *carried, F.col("urls").alias("_bu"), F.col("vec").alias("_bv"),
    )
    both = a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell)
    distance = fn.cosine_distance(F.col("_bv"), F.col("_av")).alias("cosine_distance")
    both = both.select("jaccard_est", "jaccard_exact", distance, *carried, "_au", "_bu")
    spelled = both.withColumn("query_url", F.explode("_au")).withColumn("url", F.explode("_bu"))
    return spelled.filter(kept).select("query_url", "url", "jaccard_est", "jaccard_exact", "cosine_distance")


def bucket_pairs(bands: DataFrame, block: int = BUCKET_BLOCK) -> DataFrame:
    """Every unordered pair of distinct sketches that share a bucket, once."""
    return _met(bands, ["band", "band_hash"], block)


def bounded_bucket_pairs(bands: DataFrame, sketches: DataFrame, min_exact: float,
                         block: int = BUCKET_BLOCK) -> DataFrame:
    """The same, but for pairs whose sets differ too much in size to be ``min_exact`` similar.

    Two sets are that similar only if the smaller has ``min_exact`` times the items
    of the larger. A bucket is cut by size, each class of sizes ``1 / min_exact`` as wide
    as its least one, and a sketch meets those of its own class and the next; sets
    of other classes are never put together, however many share the bucket.
    """
    sizes = sketches.select("sketch_id", F.size("grams").alias("items")).filter("items > 0").distinct()
    sizes = materialize(sizes, "set-sizes")
    # a little wider than needed, so that rounding separates no pair by two classes
    width = max(-math.log(min_exact), 1e-3) * (1 + 1e-9)
    own = F.floor(F.log(F.col("items").cast("double")) / width)
    sized = bands.join(sizes.withColumn("own", own), "sketch_id")
    placed = sized.select(
        "band", "band_hash", "sketch_id", "items", "own", F.explode(F.array("own", F.col("own") - 1)).alias("class")
    )
    near = F.least("a_items", "b_items") >= F.greatest("a_items", "b_items") * (min_exact - 1e-9)
    lower = (F.col("a_own") == F.col("class")) | (F.col("b_own") == F.col("class"))
    return _met(placed, ["band", "band_hash", "class"], block, ["items", "own"], near & lower)


def _met(rows: DataFrame, bucket: list[str], block: int, carried: list[str] | None = None,
         wanted: Column | None = None) -> DataFrame:
    """Pairs of sketches that share a bucket, once each.

    A bucket of m sketches is cut into ceil(m / block) slices and the pair
    space into slice-by-slice cells; a sketch goes to the cells of its slice,
    each pair meets in exactly one cell, and no cell outgrows a task. Pairs
    that share several buckets are merged by a partial, then final, distinct.
    ``wanted`` sees the ``carried`` columns of both sketches, as ``a_`` and ``b_``.
    """
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("members")).filter("members > 1")
    # written: a hot bucket can be split only in a join of two scans
    sized = rows.join(materialize(sizes, "bucket-sizes"), bucket)
    slices = F.ceil(F.col("members") / block).cast("int")
    slot = F.pmod(F.hash("sketch_id"), slices)
    placed = sized.withColumn("slot", slot).withColumn("last", slices - 1)
    cell = [*bucket, "row", "col"]
    a = placed.select(
        *bucket, F.col("sketch_id").alias("a"), F.col("slot").alias("row"),
        *[F.col(c).alias(f"a_{c}") for c in carried or []], F.explode(F.sequence("slot", "last")).alias("col"),
    )
    b = placed.select(
        *bucket, F.col("sketch_id").alias("b"), F.col("slot").alias("col"),
        *[F.col(c).alias(f"b_{c}") for c in carried or []], F.explode(F.sequence(F.lit(0), F.col("slot"))).alias("row"),
    )
    met = a.join(b, cell).filter((F.col("row") != F.col("col")) | (F.col("a") < F.col("b")))
    met = met if wanted is None else met.filter(wanted)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sketches(index: Index, min_jaccard: float | None = None,
                     min_exact: float | None = None, block: int = BUCKET_BLOCK) -> DataFrame:
    """All pairs of distinct sketches that share a band, scored: ``a, b, jaccard_est, jaccard_exact``."""
    if min_exact:
        met = bounded_bucket_pairs(index.bands, _sets(index), min_exact, block)
    else:
        met = bucket_pairs(index.bands, block)
    pairs = score_pairs(met, _sets(index), _sets(index), "a", "b", index.n_bands, index.n_rows, min_jaccard=min_jaccard)
    return _above(pairs, "jaccard_exact", min_exact)


def sketch_members(members: DataFrame) -> DataFrame:
    """Per sketch its first URL and how many URLs carry it."""
    return members.groupBy("sketch_id").agg(
        F.min("url").alias("first_url"), F.count("*").alias("urls")
    )


def similar_pairs(index: Index, min_jaccard: float | None = None,
                  min_exact: float | None = None) -> DataFrame:
    """The similarity join: one row per pair of distinct sketches, and one per copy.

    A pair of sketches is named by their first URLs and carries the number of
    URLs behind each. Copies are a star: the first URL of their sketch with each
    of the others, at similarity 1, so that every URL that is like another one is
    in the answer and no group is paired with itself.
    """
    pairs = similar_sketches(index, min_jaccard, min_exact)
    names = materialize(sketch_members(index.members), "sketch-names")
    left = names.select(F.col("sketch_id").alias("a"), F.col("first_url").alias("x"), F.col("urls").alias("xn"))
    right = names.select(F.col("sketch_id").alias("b"), F.col("first_url").alias("y"), F.col("urls").alias("yn"))
    named = pairs.join(left, "a").join(right, "b")
    swap = F.col("x") > F.col("y")
    between = named.select(
        F.least("x", "y").alias("url_a"),
        F.greatest("x", "y").alias("url_b"),
        F.when(swap, F.col("yn")).otherwise(F.col("xn")).alias("copies_a"),
        F.when(swap, F.col("xn")).otherwise(F.col("yn")).alias("copies_b"),
        "jaccard_est",
        "jaccard_exact",
    )
    copies = index.members.join(names.filter("urls > 1"), "sketch_id").filter("url <> first_url")
    return between.unionByName(
        copies.select(
            F.col("first_url").alias("url_a"), F.col("url").alias("url_b"),
            F.col("urls").alias("copies_a"), F.col("urls").alias("copies_b"),
            F.lit(1.0).alias("jaccard_est"), F.lit(1.0).alias("jaccard_exact"),
        )
    )


def first_pages_report(features: DataFrame, index: Index, n: int = 11,
                       order: str = "url") -> DataFrame:
    """The candidates of the first ``n`` pages in ``order``, scored (a fixed-size report)."""
    return similar_pages(features.orderBy(order).limit(n), index, include_self=False)


def buckets(index: Index, min_size: int = 2) -> DataFrame:
    """Bucket contents: one row per band key and URL, with the bucket's URL count."""
    per_sketch = materialize(index.members.groupBy("sketch_id").agg(F.count("*").alias("urls")), "sketch-urls")
    sizes = materialize(
        index.bands.join(per_sketch, "sketch_id")
        .groupBy("band", "band_hash")
        .agg(F.sum("urls").alias("bucket_size"))
        .filter(F.col("bucket_size") >= min_size),
        "bucket-sizes",
    )
    return (
        index.bands.join(sizes, ["band", "band_hash"])
        .join(index.members.select("url", "sketch_id"), "sketch_id")
        .select("band", "band_hash", "bucket_size", "url")
    )
