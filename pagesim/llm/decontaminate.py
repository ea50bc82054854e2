"""Benchmark decontamination by template windows.

Texts are canonicalised word by word: a number becomes ``<num>``, a unit after a
number ``<unit>``, a capitalised word inside a sentence ``<name>``; all other
words are lower-cased and lose punctuation at their ends. A *template window* is
the canonical form of ``WINDOW`` words in a row. A benchmark item that was copied
with other numbers or names has the windows of the original.

Windows of documents and benchmark meet in one hash join. Before it, documents
drop the windows that no benchmark item has, with a Bloom filter of fixed size,
so what is shuffled is about as large as what matches, whatever the size of the
benchmark. Joined windows are then put together per document, item and
*diagonal* (place in the document minus place in the item), and the fillings of
their slots are compared: a copy may rename, but one value of the item must stand
for one value everywhere. Windows on a diagonal with contradictory fillings
don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import table

WINDOW = 8
LITERALS = 4  # words of a window that must not be slots
SHARE = 0.5  # of an item's words that a document must hold
RUN = 13  # or so many words of it in a row
FILTER_BITS = 26  # the Bloom filter has 2^26 bits, 8 MB
KEPT_WORDS = 200_000

# Units that may follow a number.
UNITS = set(
    """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
    kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres
    mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons
    ml cl dl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes
    h hr hrs hour hours day days week weeks month months year years percent % dollar dollars euro euros
    cent cents usd eur gbp kmh mph degree degrees celsius fahrenheit joule joules watt watts volt volts""".split()
)
_EDGES = re.compile(r"^[^\w]+|[^\w%]+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|[A-Za-z]{1,3})?")
_ENDS = ".!?:;\"'”»|"
NUM, UNIT, NAME = (np.uint64(2 * k) for k in (1, 2, 3))  # codes of the placeholders; those of words are odd


class Words(dict):
    """Place of each word in arrays of what is known about words; filled when a word is met."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self):
        self.clear()
        self.facts: list[tuple] = []  # of words met since the arrays were made
        kinds = (np.uint64, bool, bool, bool, bool)
        self.arrays = [np.zeros(0, dtype=kind) for kind in kinds]

    def columns(self) -> list[np.ndarray]:
        """Code, is a number, is a unit, begins with a capital, ends a sentence: by place."""
        if self.facts:
            self.arrays = [
                np.concatenate([old, np.array(new, dtype=old.dtype)]) for old, new in zip(self.arrays, zip(*self.facts))
            ]
            self.facts = []
        return self.arrays

    def __missing__(self, word: str) -> int:
        bare = _EDGES.sub("", word)
        lower = bare.lower()
        self.facts.append(
            (
                xxhash.xxh64_intdigest(lower.encode("utf-8", "surrogatepass")) | 1,
                bool(_NUMBER.fullmatch(bare)),
                lower in UNITS,
                bare[:1].isupper(),
                word[-1:] in _ENDS or not bare,
            )
        )
        self[word] = len(self)
        return len(self) - 1


def bare(word: str) -> str:
    """The filling that a word gives its slot."""
    return _EDGES.sub("", word).lower()


def canonical(known: Words, words: list[str], first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The code of each word's canonical form, whether it is a slot, where texts start in a capital, and its own code.

    ``first`` holds the places where a text starts. A word at the start of a text
    or after one that ends a sentence is never taken for a name.
    """
    if len(known) > KEPT_WORDS:
        known.forget()
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    codes, number, unit, upper, ends = known.columns()
    begins = np.zeros(len(words), dtype=bool)
    begins[first] = True
    before = np.concatenate([at[:1], at[:-1]])
    number_here, after_number = number[at], number[before] & ~begins
    is_unit = unit[at] & after_number & ~number_here
    is_name = upper[at] & ~begins & ~ends[before] & ~number_here & ~is_unit
    out = codes[at]
    out[number_here], out[is_unit], out[is_name] = NUM, UNIT, NAME
    return out, number_here | is_unit | is_name, first[upper[at[first]] & ~number_here[first]], codes[at]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` codes from each place on."""
    out = np.zeros(max(len(codes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out = (out ^ codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def hashes_at(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The same from the places ``at`` on only."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = (out ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def filter_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the Bloom filter that each hash sets."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return hashes & mask, (hashes >> np.uint64(64 - FILTER_BITS)) & mask


def _is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


_ROWS = "hash long, key {}, at int, literals int, slots array<string>"


def _rows(known: Words, keys: pa.Array, texts: list, lengths: list[int] | None, bits: np.ndarray | None) -> pa.RecordBatch:
    """Window rows of texts: of the lengths given, or of ``WINDOW`` words or the whole text if it has fewer.

    Besides its canonical form, a window of an item is also given by its own words;
    one of a document where the canonical form has too few of them to tell
    anything. So copies are met whatever is taken for a name or a number in them.
    """
    kind, keys = keys.type, keys.to_pylist()
    own = [(key, text.split()) for key, text in zip(keys, texts)]
    own = [(key, words) for key, words in own if words]
    words = [w for _, text in own for w in text]
    columns: list[list] = [[], [], [], [], []]
    if words:
        sizes = np.array([len(text) for _, text in own])
        first = np.cumsum(sizes) - sizes
        codes, slot, capital, plain = canonical(known, words, first)
        slots_before = np.append(0, np.cumsum(slot))
        owner = np.repeat(np.arange(len(own)), sizes)
        left = np.repeat(first + sizes, sizes) - np.arange(len(words))  # words up to the end of the text
        variants = [(codes, slot, None)]
        if not lengths:  # inside a sentence of a document an item's first word passes for a name
            variants.append((codes.copy(), slot.copy(), capital))
            variants[1][0][capital], variants[1][1][capital] = NAME, True

        def add(at: np.ndarray, found: np.ndarray, is_slot: np.ndarray, size: int):
            if bits is not None:
                a, b = filter_places(found)
                met = _is_set(bits, a) & _is_set(bits, b)
                at, found = at[met], found[met]
            for i, value in zip(at.tolist(), found):
                here = is_slot[i : i + size].tolist()
                fillings = [bare(w) if s else "" for w, s in zip(words[i : i + size], here)]
                row = (value, own[owner[i]][0], i - first[owner[i]], size - sum(here), fillings)
                for column, part in zip(columns, row):
                    column.append(part)

        for size in lengths or sorted({min(WINDOW, n) for n in sizes.tolist()}):
            for code, is_slot, only in variants:
                found = window_hashes(code, size)
                use = left[: len(found)] >= size
                if not lengths and size < WINDOW:
                    use &= sizes[owner[: len(found)]] == size
                held = slots_before[size:] - slots_before[: len(found)]  # slots of each window
                if lengths:
                    use &= size - held >= min(LITERALS, size)
                at = np.flatnonzero(use) if only is None else only[only < len(found)][use[only[only < len(found)]]]
                add(at, found[at], is_slot, size)
            use = left[: len(held)] >= size
            use &= size - held < min(LITERALS, size) if lengths else held > 0
            if not lengths and size < WINDOW:
                use &= sizes[owner[: len(held)]] == size
            at = np.flatnonzero(use)
            add(at, hashes_at(plain, at, size), np.zeros(len(words), dtype=bool), size)
    hashes, *rest = columns
    kinds = (kind, pa.int32(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), *(pa.array(c, k) for c, k in zip(rest, kinds))],
        names=["hash", "key", "at", "literals", "slots"],
    )


def windows(texts: DataFrame, lengths: list[int] | None = None, bits=None) -> DataFrame:
    """Window rows of ``key, text``; ``bits`` is a broadcast filter, ``lengths`` the sizes to try."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        seen = np.frombuffer(bits.value, dtype=np.uint8) if bits is not None else None
        for batch in batches:
            for at in range(0, len(batch), 512):
                own = batch.column(1).slice(at, 512).to_pylist()
                yield _rows(known, batch.column(0).slice(at, 512), own, lengths, seen)

    return texts.mapInArrow(make, _ROWS.format(texts.schema["key"].dataType.simpleString()))


def bloom(spark: SparkSession, hashes: DataFrame):
    """The filter over a column ``hash``: one partial bit set per task, united on the way."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
        for batch in batches:
            for place in filter_places(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].astype(np.int16))], names=["at", "bits"])

    set_bits = hashes.mapInArrow(fill, "at int, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = set_bits.toArrow()  # at most 2^23 rows
    whole = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    whole[got["at"].to_numpy()] = got["bits"].to_numpy()
    return spark.sparkContext.broadcast(whole.tobytes())


def consistent(doc_slots: list, item_slots: list) -> list[bool]:
    """Which windows of one diagonal agree: each value of the item stands for one value.

    The filling seen most often for a value is its filling (ties: the smallest);
    windows that use another one don't agree.
    """
    seen: dict[tuple[str, str], int] = {}
    for own, theirs in zip(doc_slots, item_slots):
        for a, b in zip(own, theirs):
            if b:
                seen[b, a] = seen.get((b, a), 0) + 1
    stands: dict[str, str] = {}
    for (b, a), n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        stands.setdefault(b, a)
    return [all(stands[b] == a for a, b in zip(own, theirs) if b) for own, theirs in zip(doc_slots, item_slots)]


def _verify(group: pa.Table) -> pa.Table:
    """One row for the windows of one document and item: what of the item they cover."""
    rows = sorted(zip(*(group[c].to_pylist() for c in ("diagonal", "item_at", "doc_slots", "item_slots"))), key=lambda r: r[:2])
    words = group["words"][0].as_py()
    covered, verbatim, run, at = np.zeros(words, dtype=bool), True, 0, 0
    while at < len(rows):
        stop = at
        while stop < len(rows) and rows[stop][0] == rows[at][0]:
            stop += 1
        part = rows[at:stop]
        good = [r for r, ok in zip(part, consistent([r[2] for r in part], [r[3] for r in part])) if ok]
        own = np.zeros(words, dtype=bool)
        for _, place, mine, theirs in good:
            own[place : place + len(theirs)] = True
            verbatim &= mine == theirs
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
        run = max([run, *(edges[1::2] - edges[::2]).tolist()])
        covered |= own
        at = stop
    return pa.table(
        {
            "key": group["key"].slice(0, 1),
            "item_id": group["item_id"].slice(0, 1),
            "words": pa.array([words], pa.int32()),
            "covered": pa.array([int(covered.sum())], pa.int32()),
            "longest": pa.array([run], pa.int32()),
            "verbatim": pa.array([verbatim and bool(covered.any())]),
        }
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """``key, item_id, words, covered, longest, verbatim`` of documents that hold an item.

    A document holds an item if consistent windows cover at least ``SHARE`` of
    the item's words, or ``RUN`` of them in a row. ``verbatim`` tells copies with
    the item's own numbers and names from re-parameterised ones. A window with
    fewer than ``LITERALS`` words that aren't slots (in a shorter item: with a slot)
    says nothing as a template and counts by its own words instead.

    Rows with a null text or key, and items with a null text or id, take no
    part. Of benchmark items with the same words the smallest id is reported.
    Repeated document rows give one row. Keys of any type that sorts are kept as
    they are. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("key"), F.col(text).alias("text")).dropna()
    items = items.groupBy("text").agg(F.min("key").alias("key")).select("key", "text")
    made = materialize(windows(items), "bench-windows")
    made = made.filter(F.col("literals") >= F.least(F.lit(LITERALS), F.size("slots")))
    lengths = sorted(r[0] for r in made.select(F.size("slots")).distinct().collect())  # at most WINDOW
    bits = bloom(spark, made.select("hash"))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    held = materialize(windows(own, lengths or [WINDOW], bits), "doc-windows")
    held = held.filter(F.col("literals") >= F.least(F.lit(LITERALS), F.size("slots")))
    sizes = items.select("key", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
    theirs = made.join(sizes, "key").select(
        "hash", F.col("key").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "words"
    )
    theirs = materialize(theirs, "bench-sized")
    met = held.join(theirs, "hash").filter(F.size("slots") == F.size("item_slots")).select(
        "key", "item_id", "words", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at",
        F.col("slots").alias("doc_slots"), "item_slots",
    )
    kinds = [f"{name} {met.schema[name].dataType.simpleString()}" for name in ("key", "item_id")]
    found = met.groupBy("key", "item_id").applyInArrow(
        _verify, ", ".join([*kinds, "words int, covered int, longest int, verbatim boolean"])
    )
    return found.filter((F.col("covered") >= F.col("words") * SHARE) | (F.col("longest") >= RUN)).withColumnRenamed("key", key)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, item_id, words, covered, longest, verbatim`` of every leak."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
