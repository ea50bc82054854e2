"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters per language, hashed into a
fixed number of buckets, in NumPy per task; the partial counts are added by a
shuffle on (language, bucket). The log-probability matrix, buckets by languages,
is broadcast: its size is ``BUCKETS * languages * 4`` bytes and is checked.
Scoring is one narrow pass: the rows of the matrix at a batch's n-grams are
gathered and added up per text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import remainder, segments, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MODEL_BYTES = 256 << 20  # most that is broadcast
PIECE = 1 << 19  # characters handled at once
UNKNOWN = "und"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@functools.cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of a group of segments: buckets, their rows, rows with a letter.

    Characters are lower-cased; all but letters count as one blank. An n-gram
    counts where its last character is a letter or a blank right after one.
    """
    parts = [part.lower() for _, part, _ in group]
    sizes = np.array([len(p) + 2 for p in parts])
    joined = "  ".join(parts) + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = letter_table()[codes]
    codes = np.where(letters, codes, np.uint32(32)).astype(np.uint64)
    use = letters.copy()
    use[1:] |= letters[:-1]
    rows = np.repeat(np.array([row for row, _, _ in group]), sizes)
    starts = np.cumsum(sizes) - sizes
    # lowering can change the length by a few characters: the overlap is in lowered ones
    skips = [len(part[:skip].lower()) for _, part, skip in group]
    for start, skip in zip(starts, skips):
        if skip:
            use[start : start + skip] = False
    at = np.flatnonzero(use)
    seen = np.zeros(int(rows[-1]) + 1, dtype=bool)
    seen[rows[letters]] = True
    found = []
    mixed = np.zeros(len(at), dtype=np.uint64)
    for order in ORDERS:
        back = np.maximum(at - (order - 1), 0)
        mixed = (mixed ^ (codes[back] + np.uint64(order))) * _ODD[order - 1]
        found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found), np.tile(rows[at], len(ORDERS)), np.flatnonzero(seen)


_COUNTS = "lang string, bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            total = totals.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
            own = [t for t, l in zip(texts, langs) if l == lang]
            total[BUCKETS] += len(own)
            for group in segments(own, PIECE, max(ORDERS)):
                total[:BUCKETS] += np.bincount(features(group)[0], minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])],
            names=["lang", "bucket", "n"],
        )


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (bucket by language) and log-priors of labelled rows.

    Rows without text or label teach nothing. The counts collected are at most
    one per bucket and language.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counts = labelled.mapInArrow(_count, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-counts")  # read twice
    names = sorted(r[0] for r in counts.filter(F.col("bucket") == BUCKETS).select("lang").collect())
    if 4 * BUCKETS * len(names) > MODEL_BYTES:
        raise ValueError(f"{len(names)} languages need a model of more than {MODEL_BYTES} bytes")
    got = counts.toArrow()
    column = {name: i for i, name in enumerate(names)}
    matrix = np.zeros((BUCKETS + 1, len(names)))
    matrix[got["bucket"].to_numpy(), [column[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    grams, rows = matrix[:BUCKETS], matrix[BUCKETS]
    logs = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=0) + SMOOTHING * BUCKETS)
    return names, logs.astype(np.float32), np.log(rows / max(rows.sum(), 1))


def classify(texts: list, names: list[str], logs: np.ndarray, priors: np.ndarray) -> tuple[list, np.ndarray]:
    """The most probable language of each text and its probability."""
    sums = np.zeros((len(texts), len(names)))
    known = np.zeros(len(texts), dtype=bool)
    for group in segments(texts, PIECE, max(ORDERS)):
        buckets, rows, seen = features(group)
        known[seen] = True
        for k in range(len(ORDERS)):  # rows ascend within an order
            size = len(rows) // len(ORDERS)
            own, at = rows[k * size : (k + 1) * size], buckets[k * size : (k + 1) * size]
            if size:
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[first]] += np.add.reduceat(logs[at], first, axis=0, dtype=np.float64)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sums += priors
    best = sums.argmax(axis=1)
    odds = np.exp(sums - sums.max(axis=1, keepdims=True))
    score = np.where(known, 1 / odds.sum(axis=1), 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best, known)], score


def predictor(spark: SparkSession, model: tuple) -> Callable:
    """A column function: text to ``lang_pred, score``."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = classify([t or "" for t in texts], *sent.value)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row, by a model of the labelled rows.

    Null texts and texts without a letter give ``und`` and 0, as all texts do if
    nothing is labelled. Of equally probable languages the first by name is
    given. Repeated rows are answered each for itself; other columns are ignored.
    """
    predict = predictor(docs.sparkSession, train(labelled))
    return docs.select(F.col(key), predict(F.col(text)).alias("p")).select(key, "p.lang_pred", "p.score")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = remainder("doc_id", 4) == 2
    predict = predictor(spark, train(docs.filter(~held)))
    return docs.select("doc_id", held.alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
