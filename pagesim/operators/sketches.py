"""Sketches of item sets: the row form of MinHash and the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sketch as fn
from ..session import fence
from .dom import array_rows


def minhash_rows(df: DataFrame, id: str, item: str, num_perm: int = fn.NUM_PERM,
                 seed: int = fn.SEED) -> DataFrame:
    """``id, sig`` from rows of (id, item).

    Each task reduces its rows of an id to partial minima before the shuffle,
    so an id with a large share of all items sends one row per batch.
    """
    def partial(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, codes = np.unique(
                batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True
            )
            order = np.argsort(codes, kind="stable")
            words = fn.read_words(batch.column(1))[order]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(ids)))])
            sig = fn.min_hashes(words, offsets, num_perm, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), fn._list_column(sig, None)],
                ["id", "sig"],
            )

    kind = df.schema[id].dataType.simpleString()
    hashed = df.select(F.col(id).alias("id"), fn.item_word(F.col(item)).alias("h")).filter("h IS NOT NULL")
    parts = hashed.mapInArrow(partial, f"id {kind}, sig array<bigint>")
    merged = parts.groupBy("id").agg(
        *[F.min(F.get(F.col("sig"), F.lit(i))).alias(f"_{i}") for i in range(num_perm)]
    )
    return merged.select(
        F.col("id").alias(id), F.array(*[F.col(f"_{i}") for i in range(num_perm)]).alias("sig")
    )


def minhash_sets(df: DataFrame, items: str = "grams", num_perm: int = fn.NUM_PERM,
                 seed: int = fn.SEED) -> DataFrame:
    """Add ``sig``, the MinHash of an array column of strings. No shuffle."""
    return fence(df).withColumn("sig", fn.minhash(F.col(items), num_perm, seed))


def weighted_minhash_vectors(df: DataFrame, vec: str = "vec", num_samples: int = fn.NUM_PERM,
                             seed: int = fn.SEED) -> DataFrame:
    """Add ``samples``, the consistent weighted samples of a count map. No shuffle."""
    return fence(df).withColumn("samples", fn.weighted_minhash(F.col(vec), num_samples, seed))


def set_id(items: Column) -> Column:
    """Identity of a set given as a sorted array without duplicates.

    Each item is written after its length, so no two sets read the same.
    """
    return F.md5(F.array_join(F.transform(items, lambda i: F.concat(F.length(i).cast("string"), F.lit(":"), i)), ""))


def members_table(df: DataFrame, items: str = "grams") -> DataFrame:
    """Add ``sketch_id``: rows with the same item set share it."""
    return df.withColumn("sketch_id", set_id(F.col(items)))


def sketches_table(members: DataFrame, items: str = "grams") -> DataFrame:
    """One row per distinct item set: ``sketch_id, grams, sig``.

    Copies are merged before anything is sketched, partially on the map side,
    so a template behind a third of all pages is sketched and banded once.
    """
    distinct = members.select("sketch_id", F.col(items).alias("grams")).distinct()
    return distinct.withColumn("sig", fn.minhash(F.col("grams")))


def band_index(sketches: DataFrame, bands: int = fn.BANDS, rows: int = fn.ROWS) -> DataFrame:
    """LSH index rows ``band, band_hash, sketch_id``."""
    keys = fn.band_hashes(F.col("sig"), bands, rows)
    out = array_rows(sketches, keys, "sketch_id", position="band", value="band_hash")
    return out.select("band", "band_hash", "sketch_id")
