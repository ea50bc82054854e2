"""Periodic runs of words, by enumerating maximal pairs.

A run of period ``q`` and length ``l`` that starts at word ``s`` is the maximal
pair ``(s, s + q)`` of length ``l - q``: two occurrences of the same words, with
different words before them and after them. Maximal pairs of a text are read off
its LCP-interval tree, bottom-up. An interval of LCP value ``L`` holds the
occurrences of ``L`` words; two occurrences from different children differ in the
word after, two from different left-word classes in the word before. Only
pairs at a distance of at most ``L / (exponent - 1)`` are asked for, and
these are the runs: nothing has to be extended or checked. A run is met once per
multiple of its period that still fits; the smallest is the period.

Texts are handled in Arrow batches, some MB at a time: suffixes are sorted by
doubling in NumPy, over all texts of a group at once; the tree is walked only
over those that have a like one near enough. No shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

MIN_LENGTH = 6  # words
EXPONENT = 4  # a run is at least so many periods long
PIECE = 1 << 21  # bytes of text handled at once; a longer text is handled alone
SPACES = r"[\x20\x09-\x0D]+"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shortest_match(min_length: int, exponent: int) -> int:
    """Least length of a maximal pair that is a run."""
    return min(max((exponent - 1) * q, min_length - q) for q in range(1, max(min_length, 2)))


def ranked(codes: np.ndarray, reach: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all places by their first 1, 2, 4, ... words, and where a run may begin or recur.

    ``codes`` are dense numbers; those of separators occur once. The last ranks
    are those of a suffix array. A place is marked if, for some ``k``, the same
    ``k`` words stand at most ``(2 * k - 1) // reach`` places from it: of the two
    places of a maximal pair of length ``L`` and distance at most ``L / reach``
    both are, for the largest power ``k`` up to ``L``.
    """
    size = len(codes)
    counts = np.bincount(codes, minlength=1)
    rank = (np.cumsum(counts) - counts)[codes]
    levels, near = [rank.astype(np.int32)], np.zeros(size, dtype=bool)
    active = np.flatnonzero(counts[codes] > 1)
    span = 1
    if reach == span:
        twice = np.flatnonzero(codes[1:] == codes[:-1])
        near[twice] = near[twice + 1] = True
    while len(active):
        key = rank[active] * (size + 1) + rank[active + span]
        order = np.argsort(key, kind="stable")  # places ascend within equal keys
        at, key = active[order], key[order]
        old = rank[at]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(at)))
        group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        begin = np.repeat(group, np.diff(np.append(group, len(at))))
        rank[at] = old + np.repeat(first, sizes) - begin
        levels.append(rank.astype(np.int32))
        span *= 2
        same = np.append(False, key[1:] == key[:-1])
        close = np.flatnonzero(same)
        close = close[at[close] - at[close - 1] <= (2 * span - 1) // reach]
        near[at[close]] = near[at[close - 1]] = True
        shared = np.zeros(size, dtype=bool)
        shared[at[np.repeat(sizes > 1, sizes)]] = True
        active = np.flatnonzero(shared)
    return levels, near


def common_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on are the same."""
    a, b = a.copy(), b.copy()
    begin = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - begin


class Occurrences:
    """The places of an LCP interval in order: all, and by left-word class."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}

    def others(self, place: int, left: int, reach: int) -> Iterator[int]:
        """Places at most ``reach`` from ``place`` that are not of the class ``left``."""
        places = self.places
        at, stop = bisect_left(places, place - reach), bisect_right(places, place + reach)
        own = self.classes.get(left)
        if own is None:
            yield from places[at:stop]
            return
        mine = bisect_left(own, place - reach)
        while at < stop:
            if mine < len(own) and places[at] == own[mine]:
                # pass over the places up to the next one of another class
                low, high = 1, min(stop - at, len(own) - mine)
                while low < high:
                    middle = (low + high + 1) // 2
                    if places[at + middle - 1] == own[mine + middle - 1]:
                        low = middle
                    else:
                        high = middle - 1
                at, mine = at + low, mine + low
            else:
                yield places[at]
                at += 1

    def add(self, other: Occurrences):
        for place in other.places:
            insort(self.places, place)
        for left, places in other.classes.items():
            own = self.classes.get(left)
            if own is None:
                self.classes[left] = places
            else:
                for place in places:
                    insort(own, place)


def joined(a: Occurrences, b: Occurrences, lcp: int, reach: int, pairs: list) -> Occurrences:
    """One interval of two children; their maximal pairs go to ``pairs``."""
    if len(a.places) < len(b.places):
        a, b = b, a
    within = lcp // reach
    for left, places in b.classes.items():
        for place in places:
            for other in a.others(place, left, within):
                pairs.append((place, other, lcp) if place < other else (other, place, lcp))
    a.add(b)
    return a


def maximal_pairs(suffixes: list[int], lcps: list[int], lefts: list[int], least: int, reach: int) -> list:
    """``(i, j, L)`` for all maximal pairs with ``L >= least`` and ``j - i <= L / reach``.

    ``lcps[t]`` belongs to ``suffixes[t - 1]`` and ``suffixes[t]``. The stack holds
    the open intervals from the root down.
    """
    pairs: list = []
    stack: list = []
    child = None
    for place, lcp, left in zip(suffixes, lcps, lefts):
        while stack and stack[-1][0] > lcp:
            value, interval = stack.pop()
            child = joined(interval, child, value, reach, pairs)
        if lcp < least:
            stack.clear()
        elif stack and stack[-1][0] == lcp:
            stack[-1][1] = joined(stack[-1][1], child, lcp, reach, pairs)
        else:
            stack.append([lcp, child])
        child = Occurrences(place, left)
    while stack:
        value, interval = stack.pop()
        child = joined(interval, child, value, reach, pairs)
    return pairs


def find_runs(codes: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Rows ``start, length, period`` of the runs in ``codes``, by start, then period.

    ``codes`` are dense word numbers; a code that occurs once ends a text, and
    one stands before the first.
    """
    reach = exponent - 1
    least = shortest_match(min_length, exponent)
    levels, near = ranked(codes, reach)
    places = np.flatnonzero(near)
    if not len(places):
        return np.zeros((0, 3), dtype=np.int64)
    suffixes = places[np.argsort(levels[-1][places])]
    lcps = np.append(0, common_words(levels, suffixes[:-1], suffixes[1:]))
    pairs = maximal_pairs(
        suffixes.tolist(), lcps.tolist(), codes[suffixes - 1].tolist(), least, reach
    )
    found = np.array(pairs, dtype=np.int64).reshape(-1, 3)
    period = found[:, 1] - found[:, 0]
    rows = np.stack([found[:, 0], period + found[:, 2], period], axis=1)
    rows = rows[rows[:, 1] >= min_length]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # multiples of a period give the same words; the smallest is kept
    again = np.zeros(len(rows), dtype=bool)
    again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    rows = rows[~again]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def word_codes(words: pa.Array, docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes of words, other ones in each text, with separators; and where each word stands.

    A separator stands before each text and one after the last.
    """
    known = words.dictionary_encode()
    kinds = len(known.dictionary) + 1
    texts = len(counts)
    places = np.arange(len(words)) + docs + 1
    keys = np.empty(len(words) + texts + 1, dtype=np.int64)
    separators = np.append(0, np.cumsum(counts + 1))
    keys[separators] = np.arange(texts + 1) * kinds + kinds - 1
    keys[places] = docs * kinds + known.indices.to_numpy()
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64), places


def _piece(texts: pa.Array, min_length: int, exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words = split.flatten()
    docs = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    full = pc.greater(pc.binary_length(words), 0)
    words, docs = words.filter(full), docs[full.to_numpy(zero_copy_only=False)]
    counts = np.bincount(docs, minlength=len(texts))
    codes, places = word_codes(words, docs, counts)
    runs = find_runs(codes, min_length, exponent)
    # from places, with a separator before each text, to words
    word = np.full(len(codes) + 1, len(words), dtype=np.int64)
    word[places] = np.arange(len(words))
    first = word[runs[:, 0]]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, first + runs[:, 2], 1)
    np.add.at(change, first + runs[:, 1], -1)
    kept = np.cumsum(change)[: len(words)] == 0
    own = docs[first]
    begins = np.append(0, np.cumsum(counts))
    columns = [first - begins[own], runs[:, 1], runs[:, 2]]
    offsets = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
    found = pa.ListArray.from_arrays(
        offsets(np.bincount(own, minlength=len(texts))),
        pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_RUN)),
    )
    rest = pa.ListArray.from_arrays(offsets(np.bincount(docs[kept], minlength=len(texts))), words.filter(pa.array(kept)))
    return found, pc.binary_join(rest, " ")


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of ``PIECE`` bytes or one text."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy()
    start = 0
    while start < len(texts):
        held = np.cumsum(sizes[start:])
        stop = start + max(1, int(np.searchsorted(held, PIECE, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``key, runs, collapsed`` of every row: its runs, and its text with each run cut to one period.

    Words are what stands between ASCII white space, numbered from 0. ``runs`` is
    an array of ``start, length, period`` by start, then period: stretches of
    smallest period ``period`` with at least ``max(min_length, exponent * period)``
    words that no word beside them extends. Exponents below 2 are refused.
    ``collapsed`` holds, joined by one blank, the words that no run contains
    after its first period.

    Null and empty texts have no runs and collapse to the empty text. Repeated
    rows and keys are answered each for itself; other columns are ignored. A text
    is handled whole, in memory of some 200 bytes for each of its words.
    """
    if exponent < 2 or min_length < 1:
        raise ValueError("a run has two periods at least, and a word")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in _pieces(batch.column(1)):
                runs, collapsed = _piece(piece, min_length, exponent)
                ids = batch.column(0).slice(at, len(piece))
                yield pa.RecordBatch.from_arrays([ids, runs, collapsed], names=[key, "runs", "collapsed"])
                at += len(piece)

    kind = docs.schema[key].dataType.simpleString()
    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        find, f"`{key}` {kind}, runs {run}, collapsed string"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the contract's periods written into a tenth of the texts.

    Of a text of ``n`` words chosen by its id, those from word ``a`` on repeat the
    first ``p`` from there.
    """
    h = F.crc32(F.col("doc_id").cast("string"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        picked = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")),
        )
        return F.when(n > 0, F.array_join(picked, " "))

    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    # bound to a variable of a lambda, the words are split once
    text = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda b, r: F.when(
            b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r
        ).otherwise(b),
    )
    listed = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
