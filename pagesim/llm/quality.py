"""Document quality: a generalised additive model with pairwise interactions.

The log-odds of a document are a constant plus one table entry per feature, by
the bin that its value falls in, plus one entry per chosen pair of features, by
both bins. The tables are learnt by cyclic boosting: round after round
every feature in turn gets a shallow tree of Newton steps, fitted to the sums of
gradients by bin and added at a small rate; then pairs are ranked by what a
cut of both features gains on what is left, and the best are boosted alike.

Features and scores are narrow passes in Arrow batches; scoring is a search for
the bin and an addition per table. The model is fitted on a bounded sample of
labelled rows, chosen by hash, of which only the features leave their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import remainder, table

SAMPLE = 20_000  # labelled rows that the model is fitted on
BINS = 24  # most bins of a feature
ROUNDS = 300  # most rounds; rows kept aside say when to stop
RATE = 0.08
LEAVES = 3  # of a tree on one feature
PAIRS = 6  # interactions
PAIR_BINS = 8  # most bins of a feature in a pair
LEAST = 5.0  # rows of a leaf, or their share of the whole in a small sample
RIDGE = 1.0
PATIENCE = 20  # rounds without gain before boosting stops
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "longest_word", "letters", "capitals", "digits", "stops", "shouts",
    "symbols", "bars", "wide", "spaces", "distinct_words", "commonest_word", "short_words", "odd_words",
    "capital_words", "repeated_pairs", "repeated_triples", "repeated_lines", "line_words", "ended_lines",
    "byte_entropy",
)


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123)))
_DIGIT, _STOP, _SHOUT = _bytes(b"0123456789"), _bytes(b".,;:?'\"-()"), _bytes(b"!")
_SPACE, _WIDE, _BAR = _bytes(b" \t\n\v\f\r"), _bytes(bytes(range(128, 256))), _bytes(b"|<>{}[]\\/")
_SYMBOL = 1 - _UPPER - _LOWER - _DIGIT - _STOP - _SHOUT - _SPACE - _WIDE - _BAR
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _STOP, _SHOUT, _SPACE, _WIDE, _BAR, _SYMBOL], axis=1)


def _repeated(codes: np.ndarray, size: int, kinds: int) -> float:
    """Share of the sequences of ``size`` words that occurred before in the text."""
    n = len(codes) - size + 1
    if n < 2:
        return 0.0
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(size):  # wraps around beyond two million kinds, which then share keys
        keys = keys * np.uint64(kinds) + codes[k : k + n]
    return 1 - len(np.unique(keys)) / n


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES``; all 0 for a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, lower, digit, stop, shout, space, wide, bar, symbol = counts @ _CLASSES
    size = float(len(raw))
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    n = len(words)
    lengths = np.array([len(w) for w in words])
    lines = [line for line in text.split("\n") if line.strip()]
    line_sizes = {line: len(line) for line in lines}
    share = counts[counts > 0] / size
    return [
        np.log1p(n),
        lengths.mean(),
        np.log1p(lengths.max()),
        (upper + lower + wide) / size,
        upper / max(upper + lower, 1),
        digit / size,
        stop / size,
        shout / size,
        symbol / size,
        bar / size,
        wide / size,
        space / size,
        len(ids) / n**0.8,
        np.bincount(codes.astype(np.int64)).max() / n,
        (lengths < 4).mean(),
        sum(not w.strip(".,;:?!'\"-()").isalpha() for w in words) / n,
        sum(w.isupper() for w in words) / n,
        _repeated(codes, 2, len(ids)),
        _repeated(codes, 3, len(ids)),
        1 - sum(line_sizes.values()) / max(sum(map(len, lines)), 1),
        np.log1p(n / max(len(lines), 1)),
        sum(line.rstrip().endswith((".", "!", "?", ":", ";", '"')) for line in lines) / max(len(lines), 1),
        -(share * np.log2(share)).sum(),
    ]


def matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Cuts between bins and tables of log-odds by bin."""

    base: float
    cuts: list[np.ndarray]  # per feature
    tables: list[np.ndarray]  # per feature, by bin
    pair_cuts: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]  # by both bins

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of feature values."""
        odds = np.full(len(values), self.base)
        for column, cut, own in zip(values.T, self.cuts, self.tables):
            odds += own[np.searchsorted(cut, column, side="right")]
        for (a, b), own in self.pairs.items():
            odds += own[
                np.searchsorted(self.pair_cuts[a], values[:, a], side="right"),
                np.searchsorted(self.pair_cuts[b], values[:, b], side="right"),
            ]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts between values, at about equal shares of the rows."""
    values, counts = np.unique(column, return_counts=True)
    if len(values) < 2:
        return np.zeros(0)
    below = np.cumsum(counts)[:-1]
    wanted = np.arange(1, bins) * len(column) / bins
    at = np.unique(np.clip(np.searchsorted(below, wanted), 0, len(values) - 2))
    return (values[at] + values[at + 1]) / 2


def _gain(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    gl, hl, nl = (np.cumsum(x)[:-1] for x in (g, h, n))
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= least) & (n.sum() - nl >= least), gain, 0.0)
    best = int(gain.argmax()) if len(gain) else 0
    return (float(gain[best]), best + 1) if len(gain) else (0.0, 0)


def tree_steps(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Newton steps by bin of a tree with ``LEAVES`` leaves over ordered bins."""
    leaves = [(0, len(g))]
    for _ in range(LEAVES - 1):
        found = [(*_best_cut(g[a:b], h[a:b], n[a:b], least), a, b) for a, b in leaves]
        gain, at, a, b = max(found)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_steps(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts one feature, then each side by the other."""
    best, steps = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for turn in (False, True):
        g2, h2, n2 = (x.T if turn else x for x in (g, h, n))
        for cut in range(1, len(g2)):
            gain, own = -whole, np.zeros_like(g2)
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs, ns = g2[side].sum(axis=0), h2[side].sum(axis=0), n2[side].sum(axis=0)
                if ns.sum() < least:
                    break
                more, at = _best_cut(gs, hs, ns, least)
                gain += _gain(gs.sum(), hs.sum()) + more
                for part in (slice(0, at), slice(at, None)) if more > 0 else (slice(None),):
                    own[side, part] = gs[part].sum() / (hs[part].sum() + RIDGE)
            else:
                if gain > best:
                    best, steps = gain, own.T if turn else own
    return best, steps


def _sums(where: np.ndarray, size: int, gradient: np.ndarray, hessian: np.ndarray):
    return (
        np.bincount(where, gradient, size),
        np.bincount(where, hessian, size),
        np.bincount(where, minlength=size).astype(float),
    )


def _loss(odds: np.ndarray, labels: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(labels, -odds, odds)).mean()) if len(labels) else 0.0


def fit(values: np.ndarray, labels: np.ndarray, aside: np.ndarray) -> Model:
    """The model of labelled rows; those ``aside`` only say after which round to stop.

    Without labelled rows every score is 0.5; with one label only, near it.
    """
    width = values.shape[1]
    learn = ~aside
    own, y = values[learn], labels[learn].astype(float)
    # smoothed by half a row of each label
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    least = min(LEAST, len(y) / 20)
    cuts = [cut_points(own[:, j], BINS) for j in range(width)]
    small = [cut_points(own[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(cuts)]
    small_bins = [np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(small)]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], small, {})
    odds = np.full(len(values), base)
    if not len(y):
        return model

    def boost(tables: list[np.ndarray], where: list[np.ndarray], steps: Callable):
        """Rounds over ``tables`` in turn; they end up as they were after the best round."""
        nonlocal odds
        best, since = _loss(odds[aside], labels[aside]), 0
        kept, kept_odds = [t.copy() for t in tables], odds.copy()
        for _ in range(ROUNDS):
            for one, at in zip(tables, where):
                p = 1 / (1 + np.exp(-odds[learn]))
                sums = _sums(at[learn], one.size, y - p, p * (1 - p))
                step = RATE * steps(*(s.reshape(one.shape) for s in sums))
                one += step
                odds += step.ravel()[at]
            loss = _loss(odds[aside], labels[aside])
            if not aside.any() or loss < best - 1e-6:
                best, since = loss, 0
                kept, kept_odds = [t.copy() for t in tables], odds.copy()
            else:
                since += 1
                if since >= PATIENCE:
                    break
        for one, was in zip(tables, kept):
            one[:] = was
        odds = kept_odds

    boost(model.tables, bins, lambda g, h, n: tree_steps(g, h, n, least))
    p = 1 / (1 + np.exp(-odds[learn]))
    ranked = []
    for a, b in combinations(range(width), 2):
        shape = (len(small[a]) + 1, len(small[b]) + 1)
        if min(shape) > 1:
            at = small_bins[a] * shape[1] + small_bins[b]
            sums = _sums(at[learn], shape[0] * shape[1], y - p, p * (1 - p))
            ranked.append((pair_steps(*(s.reshape(shape) for s in sums), least)[0], a, b))
    chosen = [(a, b) for gain, a, b in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
    model.pairs = {(a, b): np.zeros((len(small[a]) + 1, len(small[b]) + 1)) for a, b in chosen}
    where = [small_bins[a] * model.pairs[a, b].shape[1] + small_bins[b] for a, b in chosen]
    boost(list(model.pairs.values()), where, lambda g, h, n: pair_steps(g, h, n, least)[1])
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the rows of ``docs`` that ``labels`` marks 0 or 1.

    ``sample`` labelled ids, and of their rows ``sample`` again, are taken by hash;
    of an id with several labels the larger counts. A tenth of the ids, by hash,
    says when to stop.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna()
    marks = marks.filter(F.col("label").isin(0, 1)).groupBy("key").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(sample)
    marks = materialize(marks, "quality-marks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(3).to_pylist())
            listed = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), listed.cast(pa.list_(pa.float64()))],
                names=["turn", "aside", "label", "values"],
            )

    # ``sample`` rows at most: of a proven size for the broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marks), "key")
    rows = rows.select(
        F.xxhash64(F.col("key").cast("string"), "text").alias("turn"),
        (F.crc32(F.concat(F.lit("aside"), F.col("key").cast("string"))) % 10 == 0).alias("aside"),
        "label",
        "text",
    )
    found = materialize(
        rows.mapInArrow(measure, "turn long, aside boolean, label int, values array<double>"), "quality-values"
    )
    got = found.orderBy("turn", "label", "values").limit(sample).toArrow()
    values = np.array(got["values"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(
        values,
        got["label"].to_numpy().astype(bool),
        got["aside"].to_numpy(zero_copy_only=False).astype(bool),
    )


def scorer(spark: SparkSession, model: Model) -> Callable:
    """A column function: text to the probability of label 1. The tables are sent once."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score(matrix(texts.tolist())))

    return score


def score_quality(docs: DataFrame, labelled: DataFrame, labels: DataFrame, key: str = "doc_id",
                  text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, score, predicted`` of every row of ``docs``, by a model of the rows of ``labelled``.

    Null, empty and blank texts share one score. Repeated rows are answered each
    for itself; other columns are ignored. Without labels every score is 0.5.
    """
    score = scorer(docs.sparkSession, train(labelled, labels, key, text))
    return docs.select(F.col(key), score(F.col(text)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = remainder("doc_id", 5) == 0
    score = scorer(spark, train(docs.filter(~held), labels.filter(~held)))
    return docs.select("doc_id", held.alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
