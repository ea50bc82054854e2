"""Merkle manifest of a dataset: a tree per group, and one over the groups' roots.

Leaves get their place in a group by a range sort and the counts of its parts.
Aligned blocks of 256 places then keep a level of the tree as one hex string:
fixed-width substrings of it, 16 digests wide, hash to the parents, which are
joined to the next level's string, and what stands beside a digest in its
substring are its siblings. The roots of blocks are the leaves of the next turn,
until one is left per group. The way back down hands each block the siblings
above it. Nothing but digests is shuffled, a group of any size is cut into
blocks, and each turn's table is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .common import table

WIDTH = 16  # children of a node
HEX = 64  # characters of a digest
RUN = WIDTH * HEX
BLOCK = WIDTH * WIDTH  # places of a block: two levels
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(columns: Iterable[Column]) -> Column:
    """Digest of values, each as its byte count, ``:`` and itself; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]))


def group_key(group: Column) -> Column:
    """A group as text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(leaves: DataFrame) -> DataFrame:
    """Add ``place`` and ``total`` to ``group, order, hex, row``: places ascend by order, then digest.

    ``leaves`` is a written table. Rows of equal order and digest can trade places, as
    their digests are the same; they are spread by a number of their own.
    """
    keys = ["group", "order", "hex", "turn"]
    spread = leaves.withColumn("turn", F.hash("row", F.monotonically_increasing_id()))
    # the id counts the rows of a sorted part, below the part's number
    ranged = spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("id", F.monotonically_increasing_id()).drop("turn", "order"), "manifest-sorted")
    part = F.shiftright("id", 33).alias("part")
    sizes = ranged.groupBy("group", part).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "group",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("group")).alias("total"),
    )
    starts = materialize(starts, "manifest-starts")  # of a known size for the join
    found = ranged.withColumn("part", part).join(starts, ["group", "part"])
    return found.select("group", (F.col("id") + F.col("shift")).alias("place"), "total", "hex", "row")


def _runs(level: Column) -> Column:
    """The substrings of a level that have one parent each."""
    last = F.floor((F.length(level) - 1) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.substring(level, r * RUN + 1, F.lit(RUN)))


def _parents(runs: Column) -> Column:
    return F.array_join(F.transform(runs, digest), "")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """``group, block, total, members, low, high, hex``: nodes by blocks, with their levels.

    ``low`` and ``high`` hold the runs of the block's first level and of their
    parents, null where the group is that small; ``hex`` is the block's root.
    """
    held = nodes.groupBy("group", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.first("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("place", "hex", "row"))).alias("members"),
    )
    level = held.withColumn("level", F.array_join("members.hex", ""))
    low = level.withColumn("low", F.when(F.col("total") > 1, _runs(F.col("level"))))
    high = low.withColumn("parents", _parents(F.col("low")))
    high = high.withColumn("high", F.when(F.col("total") > WIDTH, _runs(F.col("parents"))))
    root = F.coalesce(_parents(F.col("high")), "parents", "level")
    return high.select("group", "block", "total", "members", "low", "high", root.alias("hex"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of all turns from the leaves up, and ``group, hex`` of the roots."""
    turns = []
    while True:
        blocks = materialize(blocks_of(nodes), "manifest-blocks")
        turns.append(blocks)
        if blocks.agg(F.max("block")).first()[0] in (0, None):
            return turns, blocks.select("group", "hex")
        nodes = blocks.select(
            "group",
            F.col("block").alias("place"),
            F.ceil(F.col("total") / BLOCK).alias("total"),
            "hex",
            F.lit(None).cast("int").alias("row"),
        )


def _beside(runs: Column, place: Column) -> Column:
    """What stands before and after the digest at ``place`` of a level."""
    run, at = F.get(runs, F.floor(place / WIDTH).cast("int")), (place % WIDTH * HEX).cast("int")
    return F.struct(
        F.substring(run, F.lit(1), at).alias("before"),
        F.substring(run, at + HEX + 1, F.lit(RUN)).alias("after"),
    )


def descended(turns: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first turn with their siblings on all levels.

    ``above`` holds, per ``group``, ``path`` and more columns to hand down.
    """
    keep = [c for c in above.columns if c not in ("group", "path")]
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for turn, blocks in reversed(list(enumerate(turns))):
        if turn < len(turns) - 1:
            above = materialize(above, "manifest-above")
        joined = blocks.drop("hex", "total").join(above, ["group", "block"])

        def own(member: Column) -> Column:
            at = member["place"] % BLOCK
            levels = F.array(
                F.when(F.col("low").isNotNull(), _beside(F.col("low"), at)),
                F.when(F.col("high").isNotNull(), _beside(F.col("high"), F.floor(at / WIDTH))),
            )
            return F.struct(
                member["place"].alias("place"), member["hex"].alias("hex"), member["row"].alias("row"),
                F.filter(levels, lambda level: level.isNotNull()).alias("near"),
            )

        each = joined.select("group", "path", *keep, F.explode(F.transform("members", own)).alias("m"))
        above = each.select(
            "group", F.col("m.place").alias("block"), F.concat("m.near", "path").alias("path"), *keep,
            F.col("m.hex").alias("hex"), F.col("m.row").alias("row"),
        )
        if turn:
            above = above.drop("hex", "row")
    return above


def merkle_manifest(docs: DataFrame, columns: Iterable[str] = LEAF_COLUMNS, group: str = "source",
                    order: str = "doc_id", keep: Column | None = None) -> DataFrame:
    """``kept, leaf, subroot, root, path`` of every row of ``docs``.

    A leaf is the digest of ``columns``. Leaves of a group, ascending by ``order`` (null
    first, equal ones by digest), are hashed sixteen by sixteen until one digest, the
    ``subroot``, is left, and the subroots by group (null first, as bytes) likewise
    to ``root``. ``path`` lists, from the leaf up, what stands ``before`` and ``after``
    a node among the children of its parent; :func:`folded` gives the root back.
    ``kept`` is ``keep``, any expression on the rows, by default ``order``.

    Each repeated row is a leaf of its own. Null values, null groups and empty
    tables need no care; columns that are not named are ignored.
    """
    kept = F.col(order) if keep is None else keep
    leaves = docs.select(
        group_key(F.col(group)).alias("group"), F.col(order).alias("order"),
        leaf_digest(F.col(c) for c in columns).alias("hex"), kept.alias("row"),
    )
    turns, subroots = climbed(placed(materialize(leaves, "manifest-leaves")))
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("order"), "hex", F.col("group").alias("row"))
    top_turns, root = climbed(placed(materialize(named, "manifest-subroots")))
    root = root.select("group", F.col("hex").alias("root"), F.array().cast(_PATH).alias("path"))
    above = descended(top_turns, root).select(
        F.col("row").alias("group"), F.col("hex").alias("subroot"), "root", "path"
    )
    found = descended(turns, materialize(above, "manifest-above"))
    return found.select(F.col("row").alias("kept"), F.col("hex").alias("leaf"), "subroot", "root", "path")


_PATH = "array<struct<before: string, after: string>>"


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, level: digest(F.concat(level["before"], h, level["after"])))


def siblings(path: Column) -> Column:
    """All siblings' digests, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lowered = F.translate("text", CAPITALS, SMALL)
    changed = leaf_digest(lowered if c == "text" else F.col(c) for c in LEAF_COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    found = merkle_manifest(docs, keep=F.struct("doc_id", tampered.alias("tampered")))
    again = found.withColumn("folded_root", folded(F.coalesce("kept.tampered", "leaf"), F.col("path")))
    return again.select(
        "kept.doc_id", "leaf", "subroot", "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: Levels that the SQL builds: enough for 16 ** 6 rows of a source and for as many sources.
SQL_LEVELS = 6


def _sql_levels(name: str, key: str) -> list[str]:
    """Tables ``{name}0``, ... (a level's nodes) and ``{name}p0``, ... (their parents with the children's digests)."""
    out = []
    for k in range(SQL_LEVELS):
        out.append(
            f"{name}p{k} AS (SELECT {key}, pos // 16 AS pos, string_agg(hex, '' ORDER BY pos) AS run "
            f"FROM {name}{k} WHERE n > 1 GROUP BY {key}, pos // 16)"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT {key}, pos, sha256(run) AS hex, count(*) OVER (PARTITION BY {key}) AS n FROM {name}p{k})"
        )
    return out


def _sql_fold(name: str, key: str, after: str) -> tuple[list[str], str]:
    """Tables that fold the rows of ``after`` (``place`` in its tree, ``cur``, ``proof``) up a tree."""
    out = []
    for k in range(SQL_LEVELS):
        at = f"64 * (a.place // {16**k} % 16)"
        out.append(
            f"{name}f{k} AS (SELECT a.* REPLACE ("
            f"CASE WHEN p.run IS NULL THEN a.cur ELSE sha256(substring(p.run, 1, {at}) || a.cur || substring(p.run, {at} + 65)) END AS cur, "
            f"a.proof || CASE WHEN p.run IS NULL THEN '' ELSE substring(p.run, 1, {at}) || substring(p.run, {at} + 65) END AS proof) "
            f"FROM {after} a LEFT JOIN {name}p{k} p ON p.{key} IS NOT DISTINCT FROM a.{key} AND p.pos = a.place // {16 ** (k + 1)})"
        )
        after = f"{name}f{k}"
    return out, after


def _sql() -> str:
    piece = lambda t: f"coalesce(strlen({t})::VARCHAR || ':' || {t}, '-')"
    leaf = lambda t: "sha256(" + " || ".join(piece(c) for c in (*(f"{c}::VARCHAR" for c in LEAF_COLUMNS[:-1]), t)) + ")"
    bits = "list_reduce(list_prepend({}, range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        f"lambda x, b: {bits.format('xor(x, b)')}), 4294967295)"
    )
    lowered = f"translate(text, '{CAPITALS}', '{SMALL}')"
    folds, last = _sql_fold("s", "source", "started")
    tops, final = _sql_fold("r", "one", "entered")
    parts = [
        f"hashed AS (SELECT doc_id, source, {leaf('text')} AS hex, "
        f"CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM documents)",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hex) - 1 AS pos, "
        "count(*) OVER (PARTITION BY source) AS n FROM hashed)",
        "s0 AS (SELECT source, pos, hex, n FROM numbered)",
        *_sql_levels("s", "source"),
        "tops AS (" + " UNION ALL ".join(f"SELECT source, hex FROM s{k} WHERE n = 1" for k in range(SQL_LEVELS + 1)) + ")",
        "r0 AS (SELECT 1 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, hex, count(*) OVER () AS n FROM tops)",
        *_sql_levels("r", "one"),
        "whole AS (" + " UNION ALL ".join(f"SELECT hex AS root FROM r{k} WHERE n = 1" for k in range(SQL_LEVELS + 1)) + ")",
        "started AS (SELECT doc_id, source, hex AS leaf, pos AS place, coalesce(tampered, hex) AS cur, '' AS proof FROM numbered)",
        *folds,
        f"entered AS (SELECT a.doc_id, a.leaf, 1 AS one, r0.hex AS subroot, r0.pos AS place, a.cur, a.proof FROM {last} a "
        "JOIN r0 ON r0.source IS NOT DISTINCT FROM a.source)",
        *tops,
    ]
    return (
        "WITH " + ", ".join(parts) + " SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, "
        f"cur AS folded_root, cur = root AS verified FROM {final}, whole"
    )


OP12_SQL = _sql()
