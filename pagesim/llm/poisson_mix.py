"""Mixing sources to target weights by Poisson replication.

The share of each source in the output follows a target weight. A source with
``n`` documents, weight ``w`` (of a total ``W``) and a corpus of ``T`` documents
gets the mean repetition rate ``r = T * (w / W) / n``. Every document draws its
number of copies from a Poisson distribution of that mean: a keyed hash of the
document is read as a uniform number in [0, 1) and the distribution function is
inverted at it. The draw depends on nothing but seed and document, so a retried
task draws the same number again. A document is the digest of its row; rows that
are the same in all columns are counted, and each has a number of its own.

A mean above ``STEP`` is cut into equal parts whose draws, each with a hash of
its own, are added: a sum of Poisson variables is Poisson. The distribution
function is therefore a short array per source, whatever the mean.

Only DataFrame functions are used. Sources meet the documents in one join on the
source name; the rates are written before it, so that a small table of sources
is broadcast by its true size and a large one is shuffled with hot sources split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import table

STEP = 8.0
TERMS = 64  # P(X >= 64) < 2^-53 for a mean of 8 or less


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts joined by ``:``."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict | None, source: str = "source") -> DataFrame:
    """``source, rate, pieces, cdf`` for every source of ``docs``.

    ``weights`` maps a source to its target weight; a source that it does not
    name has weight 1, a weight of 0 drops the source. Null is a source too.
    ``cdf`` is the distribution function for the mean ``rate / pieces``.
    """
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    sizes = materialize(sizes.withColumn("weight", weight), "mix-sizes")
    total, of = sizes.agg(F.sum("n"), F.sum("weight")).first()  # two numbers, null for an empty table
    rate = F.lit(total) * (F.col("weight") / F.lit(of)) / F.col("n") if of else F.lit(0.0)
    rated = sizes.select("source", rate.cast("double").alias("rate"))
    rated = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    # term k from term k-1; the running sum is the distribution function
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.array(F.exp(-mean)),
        lambda got, k: F.concat(got, F.array(F.element_at(got, -1) * mean / k)),
    )
    sums = F.aggregate(
        F.slice("terms", 2, TERMS),
        F.array(F.element_at("terms", 1)),
        lambda got, term: F.concat(got, F.array(F.element_at(got, -1) + term)),
    )
    return rated.withColumn("terms", terms).select("source", "rate", "pieces", sums.alias("cdf"))


def row_digest(columns: list[Column]) -> Column:
    """MD5 of a row's values, each as its byte count, ``:`` and itself; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.md5(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary")
    )


def numbered(packed: DataFrame) -> DataFrame:
    """Add ``number``, from 1 among equal rows, to ``row, source, digest``.

    Only digests are grouped, and rows that repeat: of each group one row and
    its size go through the shuffle, however many there are.
    """
    repeated = materialize(packed.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "mix-repeated")
    if repeated.isEmpty():
        return packed.withColumn("number", F.lit(1).cast("bigint"))
    single = packed.join(repeated.select("digest"), "digest", "left_anti").withColumn("number", F.lit(1).cast("bigint"))
    groups = packed.join(repeated, "digest").groupBy("digest").agg(
        F.first("row").alias("row"), F.first("source").alias("source"), F.first("n").alias("n")
    )
    several = groups.select(
        "row", "source", "digest", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("number")
    )
    return single.unionByName(several)


def replicate(docs: DataFrame, weights: dict | None = None, seed: str = "mix", source: str = "source") -> DataFrame:
    """Every document as often as its Poisson draw says, in a shuffled order.

    Columns of ``docs`` come first and keep their names; ``copy`` (from 1) and
    ``mix_key`` (where the copy comes in the order, a 52-bit number in [0, 1))
    follow. A column of that name in ``docs`` is replaced; other names don't matter.
    Copies are dealt to partitions by a hash of ``mix_key`` and sorted by it there,
    so each partition holds a random part of the corpus in random order, however few
    documents or sources there are.

    Every row draws for itself, with or without a key, a text or a source, and so
    does each of several equal rows. An empty table gives an empty table.
    """
    plain = docs.drop("copy", "mix_key")
    columns = [F.col(f"`{c}`") for c in plain.columns]
    rates = materialize(source_rates(plain, weights, source), "mix-rates").withColumnRenamed("source", "name")
    packed = plain.select(
        F.struct(*columns).alias("row"), F.col(f"`{source}`").alias("source"), row_digest(columns).alias("digest")
    )
    joined = numbered(packed).join(rates, F.col("source").eqNullSafe(F.col("name")))
    ident = [F.col("digest"), F.col("number").cast("string")]
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")),
        F.lit(0),
        lambda total, k: total + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), k.cast("string"), *ident))),
    )
    drawn = joined.select("row", *ident[:1], "number", count.alias("count")).filter("count > 0")
    copies = drawn.select("row", "digest", "number", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    order = uniform(F.lit(seed), F.lit("order"), *ident, F.col("copy").cast("string"))
    placed = copies.select("row", "copy", order.alias("mix_key"))
    dealt = placed.repartition("mix_key").sortWithinPartitions("mix_key", "copy")
    return dealt.select(*[F.col("row")[c].alias(c) for c in plain.columns], "copy", "mix_key")


#: Target weights of the query: the largest source is taken down, two small ones up.
WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 0.5, "src3": 12.0}


def op4_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to ``WEIGHTS``: document columns, ``copy``, ``mix_key``."""
    return replicate(table(spark, folder, "documents"), WEIGHTS)


def _weight_sql() -> str:
    cases = " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in WEIGHTS.items())
    return f"CAST(CASE {cases} ELSE 1.0 END AS DOUBLE)"


_DIGEST = "md5(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "text", "lang", "source", "n_chars")
) + ")"

#: The distribution function is summed row by row here and met by counting.
OP4_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, {_weight_sql()} AS weight FROM {{docs}} GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM sizes) * (weight / (SELECT sum(weight) FROM sizes)) / n AS rate FROM sizes),
cut AS (
  SELECT source, greatest(CAST(ceil(rate / {STEP}) AS INT), 1) AS pieces, rate FROM rates),
cdf AS (
  SELECT source, pieces, rate / pieces AS mean, 0 AS k, exp(-(rate / pieces)) AS term, exp(-(rate / pieces)) AS total
  FROM cut
  UNION ALL
  SELECT source, pieces, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1)
  FROM cdf WHERE k < {TERMS}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY digest) AS number FROM (SELECT *, {_DIGEST} AS digest FROM {{docs}})),
draws AS (
  SELECT d.digest, d.number, d.source, p.piece,
    CAST('0x' || substr(md5('mix:' || p.piece || ':' || d.digest || ':' || d.number), 1, 13) AS BIGINT)
      / 4503599627370496.0::DOUBLE AS u
  FROM numbered d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source, unnest(range(1, c.pieces + 1)) AS p(piece)),
counts AS (
  SELECT w.digest, w.number, count(*) AS copies
  FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.total <= w.u GROUP BY ALL)
SELECT d.* EXCLUDE (digest, number), x.copy,
  CAST('0x' || substr(md5('mix:order:' || d.digest || ':' || d.number || ':' || x.copy), 1, 13) AS BIGINT)
    / 4503599627370496.0::DOUBLE AS mix_key
FROM numbered d JOIN counts c ON d.digest = c.digest AND d.number = c.number, unnest(range(1, c.copies + 1)) AS x(copy)
"""
