"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """``crc32`` of the key as text, modulo ``modulus``; 0 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0))


def segments(texts: list, size: int, overlap: int = 0) -> Iterator[list[tuple]]:
    """Lists of ``(row, part, skip)`` that together hold about ``size`` characters.

    A text of more than ``size`` characters is cut; each part after the first
    starts with the last ``overlap`` characters of the one before, and ``skip``
    is how many of its characters were already in that part. Every row has at
    least one part, so working memory follows ``size`` and not the longest text.
    """
    group: list[tuple] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            start = max(0, at - overlap)
            part = text[start : at + size]
            group.append((row, part, at - start))
            held += len(part) + 1
            if held >= size:
                yield group
                group, held = [], 0
            at += size
            if at >= len(text):
                break
    if group:
        yield group
