"""Language-model scoring by logistic context mixing.

A text is predicted bit by bit. For each bit, one predictor per context (the 1 to
5 bytes before, and the word so far) looks its counts of zeros and ones up in a
hashed table, under the context and the bits of this byte so far (those of half a
byte stand together, so that its four bits cost one hash). Their log odds are added with
weights that gates select (how long a context is known and how well; which bits
of the byte are known) and the sum is refined by an adaptive map from (gate,
quantised odds) to what followed. The eight bits of a byte multiply to its
probability, those of all bytes and an end mark to that of the text.

A *window* is a byte that is predicted and the bytes before it. The windows of all
training texts are added up once: a task holds its distinct windows with their
numbers in a hashed table of fixed size, what finds its slot taken is handed on as
it is, and one shuffle of packed windows makes each occur once in the corpus. They
are dealt by their hash into one part per ``PART`` bytes of training text, so that a
part and what is learned from it depend on the corpus and not on how it is split.

*Counts* come from all windows. Each task adds its parts up in tables of its own;
their blocks are packed and summed in a shuffle, 64 at a time. The model is one
table per context with ``2^TABLE_BITS`` slots of two bytes, which is the bound of
what is broadcast (30 MB).

*Weights and map* are learned online from all windows too, each by how often it
occurs. Each part runs through its windows in small steps, predicts each with counts
that leave it out and corrects the weights by the error. The weights of the parts
are averaged, each set by how often a part used it, and what the map saw is added
up, for ``ROUNDS`` rounds; only these sums, of fixed size, leave a task. Weights and
map are then fixed, so that a score depends on the text and the training texts
alone, not on retried tasks or on the rows scored with it.

*Scoring* is one narrow pass. A task keeps the scores of windows in a hashed table
of fixed size, so that one met again is not predicted again. Those of the windows
that are most frequent in the corpus, at most ``FREQUENT``, are predicted once and
broadcast (16 MB); they are the same numbers that a task would find.

The base score is a smoothed unigram model of words. Words are split and numbered
as Arrow arrays, some texts at a time. Word counts of the corpus are added up by a shuffle. The pass that scores adds up the most frequent words,
at most ``HEAD`` of which are broadcast; all other words, each of them rare, meet
their counts in a join, so no key of it is hot and no vocabulary is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import remainder, table

ORDERS = 5
TABLES = ORDERS + 1  # the last one is for the word so far
TABLE_BITS = (16, 19, 21, 22, 22, 22)
OFFSETS = [0, *np.cumsum([1 << bits for bits in TABLE_BITS]).tolist()]
BLOCK_BITS = 16  # slots packed together for the broadcast
FAN = 64  # packed blocks that one group adds up
WORD_ROWS, WORD_BYTES = 1024, 1 << 22  # texts whose words are looked up at once at most, and their bytes, but for a longer one
HEAD = 1 << 18  # words whose counts are broadcast at most
KEPT_WORDS = 1 << 20  # distinct words that a counting task holds before it hands them on
ROUNDS = 2
RATE = 0.03
STEP, STEPS = 256, 512  # windows of one online step at least, eight times that at most; steps a part is cut into
PIECE = 1 << 17  # bytes handled at once
ROWS = 512  # texts handled at once
SHARE = 1  # one distinct window in so many teaches the weights: all do
PART = 1 << 23  # bytes of training text whose windows one learner runs through, about
HELD_BITS = 22  # of the number of windows that a task holds in a hashed table
SPARE = 1 << 19  # windows that found their slot taken, held before they are handed on
FREQUENT = 1 << 20  # windows at most that are predicted once for all tasks
CHUNK = 8192  # windows predicted at once
LEVELS = 8  # counts are kept as eighths of powers of two
GATES = (1 + ORDERS * 4) * 5  # by the longest context known, how often it was seen, and how often the word so far
SETS = GATES + 256 + 40  # weights by gate, by the bits before, by how well the word is known and bit position
CELLS = 33  # of the map, over odds from -8 to 8

_COUNT = np.exp2(np.arange(256) / LEVELS) - 1  # of a level
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _level(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(LEVELS * np.log2(1.0 + count)), 255).astype(np.uint16)


def _odds_table(less: int) -> np.ndarray:
    """Log odds of a one by the levels of zeros and ones, ``less`` ones left out."""
    zeros, ones = _COUNT[:, None], np.maximum(_COUNT[None, :] - less, 0)
    return np.where(zeros + ones > 0.01, np.log((ones + 0.05) / (zeros + 0.05)), 0).astype(np.float32).ravel()


def _detail_table(less: int) -> np.ndarray:
    """0 for a context not seen, else 1 to 4 by how often, by the levels of zeros and ones."""
    total = _COUNT[:, None] + _COUNT[None, :] - less
    return np.where(total > 0.5, 1 + np.minimum(np.log2(np.maximum(total, 1)) / 2, 3).astype(np.int8), 0).astype(np.int8).ravel()


def text_bytes(text: str) -> bytes:
    """What is predicted of a text: all its bytes in lower case (A to Z), white space too, then an end mark of two zeros."""
    # bytes.lower knows ASCII letters only
    return text.encode("utf-8", "surrogatepass").lower().replace(b"\0", b"\0\1") + b"\0\0"


_ROOT = pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E), 0]] = True


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """The first powers of a number, which are kept, as every piece needs them."""
    if len(_KEPT_POWERS.get(base, ())) < count:
        with np.errstate(over="ignore"):
            _KEPT_POWERS[base] = np.cumprod(np.full(count, base, dtype=np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
    return _KEPT_POWERS[base][:count]


def word_hashes(flat: np.ndarray, carried: tuple[int, int] = (0, 0), begins: np.ndarray | None = None) -> tuple[np.ndarray, tuple[int, int]]:
    """A hash of the bytes between the last white space and each place, and what the next bytes carry on.

    With a running sum of byte * root^place, the sum over a word so far is a
    difference of two of its values; times 1 / root^start it does not depend on
    where the word stands. ``carried`` is that sum, and the number of bytes, of
    a word that began before ``flat``. At ``begins`` a word begins, whatever is before.
    """
    size = len(flat)
    powers = _powers(0xD6E8FEB86659FD93, size)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_ROOT, size), out=sums[1:])
    first = np.empty(size, dtype=bool)
    first[0], first[1:] = True, _SPACE.take(flat[:-1])
    if begins is not None:
        first[begins] = True
    start = np.flatnonzero(first)
    lengths = np.diff(start, append=size)
    part = (sums[:-1] - np.repeat(sums[start], lengths)) * np.repeat(powers[start], lengths)
    total, length = carried
    shift = np.uint64(pow(_ROOT, length, 1 << 64))
    ahead = int(lengths[0])  # places of the word that is carried on
    part[:ahead] = sums[:ahead] * shift + np.uint64(total)
    last = int(start[-1])
    if _SPACE[flat[-1]]:
        after = (0, 0)
    elif last:
        after = ((int(sums[-1]) - int(sums[last])) * int(powers[last]) & (1 << 64) - 1, size - last)
    else:
        after = (int(sums[-1]) * int(shift) + total & (1 << 64) - 1, length + size)
    part ^= part >> np.uint64(29)
    part *= _MIX
    return part, after


_BEFORE = 7  # bytes that stand before those of which windows are made: a window is cut out of eight


def _last_bytes(raw: bytes) -> np.ndarray:
    """Each byte after the first ``_BEFORE`` with the ORDERS bytes before it as a number."""
    eights = np.ndarray((len(raw) - _BEFORE,), dtype=">u8", buffer=raw, strides=(1,))
    return eights.astype(np.uint64) & np.uint64((1 << 8 * (ORDERS + 1)) - 1)


def text_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows that end at each byte of each text, and the number of bytes per text.

    A window is a row: six bytes as a number, and the hash of the word so far.
    """
    sizes = np.array([len(t) for t in texts])
    raw = b"".join([b"\0" * _BEFORE, *texts])
    if len(raw) == _BEFORE:
        return np.zeros((2, 0), dtype=np.uint64), sizes
    last, begins = _last_bytes(raw), np.cumsum(sizes) - sizes
    for k in range(ORDERS):  # nothing of the text before
        last[begins[sizes > k] + k] &= np.uint64((1 << 8 * (k + 1)) - 1)
    words, _ = word_hashes(np.frombuffer(raw, dtype=np.uint8, offset=_BEFORE), begins=begins[sizes > 0])
    return np.stack([last, words]), sizes


def _long_windows(text: bytes) -> Iterator[np.ndarray]:
    """The windows of one text, PIECE bytes at a time, the same as those of ``text_windows``."""
    carried = 0, 0
    for at in range(0, len(text), PIECE):
        raw = text[max(0, at - _BEFORE) : at].rjust(_BEFORE, b"\0") + text[at : at + PIECE]
        words, carried = word_hashes(np.frombuffer(raw, dtype=np.uint8, offset=_BEFORE), carried)
        yield np.stack([_last_bytes(raw), words])


def pieces(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, windows, bytes per row)`` of rows that together have about PIECE bytes.

    A longer text comes in several pieces of one row, which don't change its windows.
    """
    group, first, held = [], 0, 0
    for row, text in enumerate(texts):
        if group and held + len(text) > PIECE:
            yield first, *text_windows(group)
            group, held = [], 0
        if not group:
            first = row
        if len(text) > PIECE:
            for windows in _long_windows(text):
                yield row, windows, np.array([windows.shape[1]])
            continue
        group.append(text)
        held += len(text)
    if group:
        yield first, *text_windows(group)


def _batch_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The windows of the texts of a task, a piece at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            for _, windows, _ in pieces([text_bytes(t) for t in batch.column(0).slice(at, ROWS).to_pylist()]):
                yield windows


def window_keys(windows: np.ndarray) -> np.ndarray:
    """One number per window, for sorting out equal ones."""
    return (windows[0] * _MIX ^ windows[1]) * _MIX


_UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def windows_of(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Windows by their keys and bytes: the word's hash follows from both."""
    return np.stack([first, keys * _UNMIX ^ first * _MIX])


def _distinct(windows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows, how often each occurs, and the number of each one given."""
    keys = window_keys(windows)
    codes, known = pd.factorize(keys.view(np.int64))
    first = np.zeros(len(known), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    sums = np.bincount(codes, weights=counts, minlength=len(known)).astype(np.int64)
    return windows[:, first], sums, codes


def _held(kind: type) -> np.ndarray:
    """A hashed table of keys and values that holds nothing: no key in it is one that is looked up there."""
    # side by side, so that both are met at once
    held = np.zeros(1 << HELD_BITS, dtype=[("key", np.uint64), ("value", kind)])
    held["key"][0] = 1 << 63
    return held


def _held_slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - HELD_BITS)).view(np.int64)


class Gathered:
    """Distinct windows and how often each occurs; what finds its slot taken is spare."""

    def __init__(self):
        self.held = _held(np.int64)
        self.bytes = np.zeros(1 << HELD_BITS, dtype=np.uint64)
        self.spare: list = []
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        keys = window_keys(windows)
        slots = _held_slots(keys)
        met = self.held.take(slots)["key"] == keys
        np.add.at(self.held["value"], slots[met], 1)
        known, times, _ = _distinct(windows.take(np.flatnonzero(~met), axis=1))
        keys = window_keys(known)
        slots = _held_slots(keys)
        free = self.held.take(slots)["value"] == 0
        self.held["key"][slots[free]] = keys[free]  # the last of several with one slot stays
        met = self.held.take(slots)["key"] == keys
        at = slots[met]
        self.held["value"][at] = times[met]
        self.bytes[at] = known[0, met]
        self.spare.append((known[:, ~met], times[~met]))
        self.size += len(times) - len(at)

    def take_spare(self) -> tuple[np.ndarray, np.ndarray]:
        windows = np.concatenate([w for w, _ in self.spare] or [np.zeros((2, 0), dtype=np.uint64)], axis=1)
        times = np.concatenate([t for _, t in self.spare] or [np.zeros(0, dtype=np.int64)])
        self.spare, self.size = [], 0
        return _distinct(windows, times)[:2]

    def take_all(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.held["value"])
        held, first = self.held[at], self.bytes[at]
        del self.held, self.bytes, at  # nothing is added any more, and what follows needs the room
        windows, times = self.take_spare()
        first = np.concatenate([windows_of(held["key"], first), windows], axis=1)
        return first, np.concatenate([held["value"], times])


def pack_windows(keys: np.ndarray, first: np.ndarray, times: np.ndarray) -> bytes:
    """Windows in the order of their keys: steps of the key, the bytes, how often; the word's hash follows from the key."""
    planes = np.empty((3, 8, len(keys)), dtype=np.uint8)
    for number, own in enumerate((np.diff(keys, prepend=np.uint64(0)), first, times.astype(np.uint64))):
        for k in range(8):
            planes[number, k] = own.view(np.uint8)[k::8]
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack_windows(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, windows and how often each occurs."""
    raw = pa.decompress(data, decompressed_size=24 * count, codec="zstd", asbytes=True)
    planes, own = np.frombuffer(raw, dtype=np.uint8).reshape(3, 8, count), np.empty((3, 8 * count), dtype=np.uint8)
    for k in range(8):
        own[:, k::8] = planes[:, k]
    steps, first, times = own.view(np.uint64)
    keys = np.cumsum(steps, dtype=np.uint64)
    return keys, windows_of(keys, first), times.astype(np.int64)


_WINDOWS = "part long, n long, times long, data binary"


def _packed_rows(rows: list[tuple]) -> pa.Table:
    kinds = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("times", pa.int64()), ("data", pa.binary())])
    return pa.Table.from_pylist([dict(zip(kinds.names, row)) for row in rows], kinds)


def _gather(parts: int):
    """The distinct windows of the texts of a task, packed by part."""

    def packed(windows: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = window_keys(windows)
        order = np.argsort(keys)
        keys, first, times = keys[order], windows[0][order], times[order]
        del windows, order
        # parts are ranges of the keys
        part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        ends = np.searchsorted(part, np.arange(1, parts + 1, dtype=np.uint64))
        rows, size = [], 0
        for number, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if a < b:
                data = pack_windows(keys[a:b], first[a:b], times[a:b])
                rows.append((number, b - a, int(times[a:b].sum()), data))
                size += len(data)
            if rows and size > 1 << 22:
                yield from _packed_rows(rows).to_batches()
                rows, size = [], 0
        if rows:
            yield from _packed_rows(rows).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        for windows in _batch_pieces(batches):
            gathered.add(windows)
            if gathered.size > SPARE:
                yield from packed(*gathered.take_spare())
        pa.default_memory_pool().release_unused()
        yield from packed(*gathered.take_all())

    return run


def _merge(group: pa.Table) -> pa.Table:
    """One row of the packed windows of one part."""
    found = [unpack_windows(d.as_py(), n.as_py()) for d, n in zip(group["data"], group["n"])]
    keys, first, times = (np.concatenate(c) for c in zip(*((k, w[0], t) for k, w, t in found)))
    order = np.argsort(keys, kind="stable")
    keys, first, times = keys[order], first[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.add.reduceat(times, starts)
    return _packed_rows([(group["part"][0].as_py(), len(starts), int(times.sum()), pack_windows(keys[starts], first[starts], times))])


def chosen_windows(texts: DataFrame) -> tuple[DataFrame, int]:
    """``part, n, times, data``: all windows of a column ``text``, each once, packed by part, and their number."""
    # the end mark has two bytes
    size = texts.agg(F.sum(F.octet_length("text") + F.lit(2).cast("long"))).first()[0] or 0
    parts = -(-size // PART) or 1
    # files of about two parts, as a reader takes the rows of a file at once
    rows = texts.mapInArrow(_gather(parts), _WINDOWS).repartition(-(-parts // 2), "part")
    chosen = materialize(rows.groupBy("part").applyInArrow(_merge, _WINDOWS), "mix-windows")
    return chosen, chosen.agg(F.sum("n")).first()[0] or 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and how often each occurs, part by part."""
    for batch in batches:
        for data, count in zip(batch.column("data"), batch.column("n").to_pylist()):
            yield unpack_windows(data.as_py(), count)[1:]


_PREFIX = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, dtype=np.uint64))


def contexts(windows: np.ndarray, number: int) -> np.ndarray:
    """Hashes of the windows' contexts for table ``number``."""
    if number == TABLES - 1:
        return windows[1]
    context = windows[0] >> np.uint64(8) & np.uint64((1 << 8 * (number + 1)) - 1)
    context = (context + np.uint64(number)) * _MIX
    return context ^ context >> np.uint64(31)


def starts(context: np.ndarray, number: int, prefix: np.ndarray | int) -> np.ndarray:
    """A slot of table ``number`` for context hashes and the bits before a half byte.

    The slot of a bit in that half differs from it by the half's bits before that bit.
    """
    mixed = (context ^ _PREFIX[prefix]) * _MIX >> np.uint64(64 - TABLE_BITS[number])
    return mixed.view(np.int64) + OFFSETS[number]


def _halves(windows: np.ndarray) -> Iterator[tuple[int, np.ndarray | int, list]]:
    """For the halves of the last byte of windows: the first bit's number, the bits before, and for each
    bit the bits before it in the byte and in the half, each with a leading one, and the bit."""
    byte = (windows[0] & np.uint64(255)).astype(np.int64)
    for first in (0, 4):
        bits = [(byte >> 8 - k | 1 << k, (byte >> 8 - k) & (1 << k - first) - 1 | 1 << k - first, byte >> 7 - k & 1) for k in range(first, first + 4)]
        yield first, byte >> 4 | 16 if first else 1, bits


def _blocks(counts: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a pair of count tables that hold anything, packed."""
    size = 1 << BLOCK_BITS
    for block in range(counts.shape[1] // size):
        part = counts[:, block * size : (block + 1) * size]
        if part.any():
            data = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([group]), pa.array([data], pa.binary())], names=["block", "part", "data"]
            )


_PACKED = "block int, part long, data binary"
_MOST = np.iinfo(np.uint32).max


def _limited(windows: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows some at a time, such that their numbers add up to one of 32 bits."""
    if len(times) > 1 << 16 or len(times) > 1 and times.sum() > _MOST:
        half = len(times) // 2
        yield from _limited(windows[:, :half], times[:half])
        yield from _limited(windows[:, half:], times[half:])
    elif len(times):
        yield windows, np.minimum(times, _MOST).astype(np.uint32)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of zeros and ones by slot of the windows of one task."""
    counts = np.zeros((2, OFFSETS[-1]), dtype=np.uint32)
    flat, task, added = counts.reshape(-1), TaskContext.get().partitionId(), 0
    for part in _parts(batches):
        for known, times in _limited(*part):
            added += int(times.sum())
            if added > _MOST:
                yield from _blocks(counts, task)
                counts[:] = 0
                added = int(times.sum())
            hashes = [contexts(known, number) for number in range(TABLES)]
            for _, before, bits in _halves(known):
                for number, context in enumerate(hashes):
                    start = starts(context, number, before)
                    for _, inner, bit in bits:
                        np.add.at(flat, (start ^ inner) + bit * OFFSETS[-1], times)
    yield from _blocks(counts, task)


def _unpack(data: bytes) -> np.ndarray:
    size = 1 << BLOCK_BITS
    raw = pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=np.uint32).reshape(2, size)


def count_tables(texts: DataFrame) -> np.ndarray:
    """Levels of zeros (upper byte) and ones (lower byte) by slot of all tables, of fixed size."""
    return _tables_of(chosen_windows(texts)[0])


def _tables_of(chosen: DataFrame) -> np.ndarray:

    def add_up(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros((2, 1 << BLOCK_BITS), dtype=np.uint64)
        for data in group["data"]:
            total += _unpack(data.as_py())
        total = np.minimum(total, _MOST).astype(np.uint32)
        data = pa.compress(total.tobytes(), codec="zstd", asbytes=True)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    packed = chosen.mapInArrow(_fold, _PACKED)
    parts = (chosen.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN:
        packed = packed.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(add_up, _PACKED)
        parts = -(-parts // FAN)
    packed = packed.withColumn("part", F.lit(0).cast("long")).groupBy("block", "part").applyInArrow(add_up, _PACKED)
    levels = np.zeros(OFFSETS[-1], dtype=np.uint16)
    size = 1 << BLOCK_BITS
    got = packed.toArrow()  # at most OFFSETS[-1] / 2^BLOCK_BITS rows
    for block, data in zip(got["block"].to_pylist(), got["data"]):
        zeros, ones = _level(_unpack(data.as_py()))
        levels[block * size : (block + 1) * size] = zeros << 8 | ones
    return levels


def bit_slots(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all first bits of the windows' last bytes, then all second ones, ...: the slot in each table, the bits
    before with a leading one, and the bit."""
    size = windows.shape[1]
    slots = np.empty((TABLES, 8, size), dtype=np.int64)
    prefixes, ones = np.empty((8, size), dtype=np.int64), np.empty((8, size), dtype=np.int64)
    hashes = [contexts(windows, number) for number in range(TABLES)]
    for first, before, bits in _halves(windows):
        for number, context in enumerate(hashes):
            start = starts(context, number, before)
            for k, (_, inner, _) in enumerate(bits, first):
                np.bitwise_xor(start, inner, out=slots[number, k])
        for k, (prefix, _, bit) in enumerate(bits, first):
            prefixes[k], ones[k] = prefix, bit
    return slots.reshape(TABLES, -1), prefixes.reshape(-1), ones.reshape(-1)


_PLACE = np.array([0, *(p.bit_length() - 1 for p in range(1, 256))])  # of a bit, by the bits before


class Mixer:
    """Count tables, weights and map; predicts windows."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, cells: np.ndarray):
        self.tables, self.weights, self.cells = tables, weights, cells
        self.added: np.ndarray | None = None  # rows of the weights, which stay when windows are predicted
        self.odds = _odds_table(0), _odds_table(1)
        self.details = _detail_table(0), _detail_table(1)

    def inputs(self, slots: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds per table, and the gate.

        With ``bit``, one occurrence of it is left out: the table of ones left
        out serves zeros too, with the sides exchanged.
        """
        odds = np.empty(slots.shape, dtype=np.float32)
        gate = np.zeros(slots.shape[1], dtype=np.int8)
        less = 0 if bit is None else 1
        for number, own in enumerate(slots):
            both = self.tables.take(own)
            if bit is not None:
                both = np.where(bit == 1, both, both << 8 | both >> 8)
            self.odds[less].take(both, out=odds[number], mode="clip")
            detail = self.details[less].take(both)
            if number < ORDERS:
                np.copyto(gate, detail + np.int8(number * 4), where=detail > 0)
        if bit is not None:
            odds *= np.where(bit == 1, np.float32(1), np.float32(-1))
        return odds, gate.astype(np.int64) * 5 + detail  # the last table is the word's

    def rows(self) -> np.ndarray:
        """The added weights by gate and bits before: the gate tells how well the word is known, those bits the place."""
        own = self.weights.astype(np.float32)
        gates, prefixes = np.arange(GATES)[:, None], np.arange(256)[None, :]
        out = own[:GATES][:, None, :] + own[GATES : GATES + 256][None, :, :]
        out += own[GATES + 256 + gates % 5 * 8 + _PLACE[prefixes]]
        return out.reshape(-1, TABLES)

    def place(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell below the odds, and how far they are to the next."""
        at = (np.clip(mixed, -7.999, 7.999) + 8) * ((CELLS - 1) / 16)
        low = at.astype(np.int64)
        return low, at - low

    def refine(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        low, part = self.place(mixed)
        at = gate * CELLS + low
        flat = self.cells.ravel()
        mapped = flat.take(at) * (1 - part) + flat.take(at + 1) * part
        return np.clip((1 / (1 + np.exp(-mixed)) + mapped) / 2, 1e-6, 1 - 1e-6)

    def log2(self, windows: np.ndarray) -> np.ndarray:
        """The log probability of the last byte of each window after the others, in bits."""
        if self.added is None:
            self.added = self.rows()
        rows, out = self.added, np.empty(windows.shape[1])
        for at in range(0, len(out), CHUNK):
            slots, prefix, bit = bit_slots(windows[:, at : at + CHUNK])
            odds, gate = self.inputs(slots, None)
            mixed = np.clip(np.einsum("nk,kn->n", rows.take(gate * 256 + prefix, axis=0), odds), -12, 12)
            one = self.refine(mixed, gate)
            out[at : at + CHUNK] = np.log2(np.where(bit == 1, one, 1 - one).reshape(8, -1).prod(axis=0))
        return out


def first_weights() -> np.ndarray:
    weights = np.zeros((SETS, TABLES))
    weights[:GATES] = 0.25
    return weights


def first_cells() -> np.ndarray:
    return np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, CELLS))), (GATES, 1))


OFTEN = 8 * 64  # classes of windows by how often they occur, eight per power of two


def how_often(times: np.ndarray) -> np.ndarray:
    return (8 * np.log2(times)).astype(np.int64)


class Learner:
    """Online steps over windows of one part, each with itself left out of the counts."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, past: np.ndarray):
        self.mixer, self.past = Mixer(tables, weights.copy(), first_cells()), past.copy()
        self.seen = np.zeros(GATES * CELLS * 2)
        self.used = np.zeros(SETS)
        self.often = np.zeros(OFTEN, dtype=np.int64)

    def run(self, windows: np.ndarray, times: np.ndarray) -> None:
        """Learn from distinct windows, by how often each occurs."""
        count = windows.shape[1]
        self.often += np.bincount(how_often(times), minlength=OFTEN)
        order = np.random.default_rng(1).permutation(count)
        step = min(max(STEP, count // STEPS), 8 * STEP)
        group = step * max(1, CHUNK // step)
        for at in range(0, count, group):
            own = order[at : at + group]
            self.steps(windows.take(own, axis=1), times[own].astype(float), step)

    def steps(self, windows: np.ndarray, times: np.ndarray, step: int) -> None:
        """Some online steps: what does not depend on the weights is found for all of them at once."""
        mixer, size = self.mixer, len(times)
        slots, prefix, bit = bit_slots(windows)
        odds, gate = mixer.inputs(slots, bit)
        sets = np.stack([gate, GATES + prefix, GATES + 256 + gate % 5 * 8 + _PLACE[prefix]]).reshape(3, 8, size)
        odds, ones, mixed = odds.reshape(TABLES, 8, size), bit.reshape(8, size), np.empty((8, size))
        for at in range(0, size, step):
            own = slice(at, at + step)
            mixed[:, own] = self.step(odds[:, :, own].reshape(TABLES, -1), sets[:, :, own].reshape(3, -1), ones[:, own].reshape(-1), times[own])
        often, mixed = np.tile(times, 8), mixed.reshape(-1)
        for rows in sets.reshape(3, -1):
            self.used += np.bincount(rows, often, SETS)
        low, part = mixer.place(mixed)
        at = (gate * CELLS + low) * 2 + bit
        self.seen += np.bincount(at, often * (1 - part), self.seen.size)
        self.seen += np.bincount(at + 2, often * part, self.seen.size)

    def step(self, odds: np.ndarray, sets: np.ndarray, bit: np.ndarray, times: np.ndarray) -> np.ndarray:
        mixer, own = self.mixer, self.mixer.weights.astype(np.float32)
        chosen = own.take(sets[0], axis=0) + own.take(sets[1], axis=0) + own.take(sets[2], axis=0)
        mixed = np.clip(np.einsum("nk,kn->n", chosen, odds), -12, 12)
        error = np.tile(times, 8) / times.sum() * (bit - 1 / (1 + np.exp(-mixed)))
        change = np.zeros((SETS, TABLES))
        for number, o in enumerate(odds):
            steep = error * o
            for rows in sets:
                change[:, number] += np.bincount(rows, steep, SETS)
        self.past += change * change
        mixer.weights += RATE * change / np.sqrt(self.past)
        return mixed.reshape(8, -1)

    def sums(self) -> np.ndarray:
        """What is added up over tasks: uses of each set, weights and past by use, what the map saw, windows by how often they occur."""
        by_use = (self.used[:, None] * x for x in (self.mixer.weights, self.past))
        return np.concatenate([self.used, *(x.ravel() for x in by_use), self.seen, self.often])


def _learner(tables, weights: np.ndarray, past: np.ndarray):
    """What each part of the windows teaches: ``at, value`` of its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for windows, times in _parts(batches):
            learner = Learner(tables.value, weights, past)
            learner.run(windows, times)
            sums = learner.sums()
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "value"])

    return run


def learn(tables: np.ndarray, texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights and map from all windows of a column ``text``, and the number of distinct windows learned from."""
    chosen, count = chosen_windows(texts)
    weights, cells, _ = _learn_from(chosen.sparkSession.sparkContext.broadcast(tables), chosen)
    return weights, cells, count


def _learn_from(sent, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, map, and the number of windows by how often they occur."""
    weights, cells, past = first_weights(), first_cells(), np.full((SETS, TABLES), 1e-8)
    for _ in range(ROUNDS):
        sums_of = _learner(sent, weights, past)
        # decimals, as their sum does not depend on the order
        added = chosen.mapInArrow(sums_of, "at int, value double").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,14)")).cast("double").alias("value"))
        got = added.toArrow()  # one row per sum at most
        sums = np.zeros(SETS * (1 + 2 * TABLES) + GATES * CELLS * 2 + OFTEN)
        sums[got["at"].to_numpy()] = got["value"].to_numpy()
        used, of_weights, of_past, seen, often = np.split(sums, np.cumsum([SETS, SETS * TABLES, SETS * TABLES, GATES * CELLS * 2]))
        known = used > 0
        weights, past = weights.copy(), past.copy()
        weights[known] = of_weights.reshape(SETS, TABLES)[known] / used[known, None]
        past[known] = np.maximum(of_past.reshape(SETS, TABLES)[known] / used[known, None], 1e-8)
        seen = seen.reshape(GATES, CELLS, 2)
        cells = (seen[..., 1] + 20 * first_cells()) / (seen.sum(axis=2) + 20)
    return weights, cells, often


def _frequent(tables, weights: np.ndarray, cells: np.ndarray, often: np.ndarray, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and log probabilities of the most frequent windows, at most ``FREQUENT``, by how often they occur."""
    held = np.cumsum(often[::-1])[::-1]  # windows of a class and of all above
    least = int(np.argmax(held <= FREQUENT)) if held[-1] <= FREQUENT else OFTEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(tables.value, weights, cells)
        for windows, times in _parts(batches):
            own = np.flatnonzero((times > 1) & (how_often(times) >= least))
            known, times = windows.take(own, axis=1), times[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(window_keys(known).view(np.int64)), pa.array(mixer.log2(known)), pa.array(times)], names=["key", "log", "times"]
            )

    got = chosen.mapInArrow(run, "key long, log double, times long").toArrow()
    # the last of several with one slot stays
    order = np.lexsort((got["key"].to_numpy(), got["times"].to_numpy()))
    return got["key"].to_numpy()[order].view(np.uint64), got["log"].to_numpy()[order]


def _model(texts: DataFrame) -> tuple:
    """Tables, as they were sent to the tasks, weights and map, and what is known of frequent windows."""
    chosen, _ = chosen_windows(texts)
    sent = chosen.sparkSession.sparkContext.broadcast(_tables_of(chosen))
    weights, cells, often = _learn_from(sent, chosen)
    return sent, weights, cells, _frequent(sent, weights, cells, often, chosen)


def train(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables, weights and map learned from a column ``text``."""
    sent, weights, cells, _ = _model(texts)
    return sent.value, weights, cells


class Scored:
    """Log probabilities of windows that a mixer predicted, in bits.

    Those of ``frequent``, keys and log probabilities, are known beforehand and stay.
    """

    def __init__(self, mixer: Mixer, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        self.mixer, self.held = mixer, _held(np.float64)
        self.fixed = np.zeros(1 << HELD_BITS, dtype=bool)
        if frequent:
            self.fixed[self.keep(*frequent)] = True

    def keep(self, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
        slots = _held_slots(keys)
        free = ~self.fixed.take(slots)
        keys, logs, slots = keys[free], logs[free], slots[free]
        self.held["key"][slots] = keys
        met = self.held.take(slots)["key"] == keys  # the last of several with one slot stays
        self.held["value"][slots[met]] = logs[met]
        return slots

    def log2(self, windows: np.ndarray) -> np.ndarray:
        keys = window_keys(windows)
        met = self.held.take(_held_slots(keys))
        out = met["value"].copy()
        new = np.flatnonzero(met["key"] != keys)
        if len(new):
            known, _, codes = _distinct(windows[:, new])
            logs = self.mixer.log2(known)
            out[new] = logs[codes]
            self.keep(window_keys(known), logs)
        return out


def scores(mixer: Mixer | Scored, texts: list[str]) -> np.ndarray:
    """The log10 probability of each text."""
    out = np.zeros(len(texts))
    for first, windows, sizes in pieces([text_bytes(t) for t in texts]):
        out[first : first + len(sizes)] += np.add.reduceat(mixer.log2(windows), np.cumsum(sizes) - sizes)
    return out * np.log10(2)


# --- the base score -------------------------------------------------------------

END = b""  # the key of the end token; no word is empty


def token_key(word: bytes) -> bytes:
    """A word of under 16 bytes, or the MD5 digest of a longer one."""
    return word if len(word) < 16 else hashlib.md5(word).digest()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of each word of texts, the number of its key, and the keys; then the end of each text, the last key."""
    # these know ASCII letters and ASCII white space only
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().dictionary_encode()
    rows, codes = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), words.indices.to_numpy()
    keys = words.dictionary.cast(pa.binary())
    sizes = pc.binary_length(keys).to_numpy()
    long = sizes >= 16
    if long.any():
        digests = [token_key(w) for w in keys.filter(pa.array(long)).to_pylist()]
        keys = pc.replace_with_mask(keys, pa.array(long), pa.array(digests, pa.binary()))
    if not sizes.all():  # beside white space at either end of a text
        words = sizes[codes] > 0
        rows, codes = rows[words], codes[words]
    keys = pa.concat_arrays([keys, pa.array([END], pa.binary())])
    return np.concatenate([rows, np.arange(len(texts))]), np.concatenate([codes, np.full(len(texts), len(keys) - 1)]), keys


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some at a time, by their number and the bytes of a column."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(batch):
        stop = min(max(int(np.searchsorted(ends, done + WORD_BYTES, "right")), at + 1), at + WORD_ROWS)
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[min(stop, len(ends)) - 1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def added() -> list[pa.Table]:
        return [pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns(["token", "c"])]

    for batch in batches:
        for part in _slices(batch, 0):
            _, codes, keys = coded_words(part.column(0))
            counts = np.bincount(codes, minlength=len(keys))
            held.append(pa.table([keys, pa.array(counts, pa.int64())], names=["token", "c"]).filter(pa.array(counts > 0)))
            if sum(map(len, held)) > KEPT_WORDS:
                held = added()
                if len(held[0]) > KEPT_WORDS // 2:
                    yield from held[0].to_batches()
                    held = []
    if held:
        yield from added()[0].to_batches()
    held = []
    pa.default_memory_pool().release_unused()  # the worker stays


def word_counts(texts: DataFrame) -> tuple[DataFrame, int, int, dict[bytes, int]]:
    """Counts ``token, c`` of all words, their sum and number, and the counts of the most frequent."""
    counts = materialize(texts.mapInArrow(_count_words, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "mix-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count of which no more than HEAD words have as much, from sizes by power of two
    sizes = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().collect()
    held, least = 0, None
    for power, size in sorted(map(tuple, sizes), reverse=True):
        held += size
        if held > HEAD:
            break
        least = 1 << power
    if not least:
        return counts, total, kinds, {}
    head = counts.filter(F.col("c") >= least).toArrow()
    return counts, total, kinds, dict(zip(head["token"].to_pylist(), head["c"].to_pylist()))


_SCORED = "uid long, n_tokens long, n_known long, base_score double, score double, bytes long, rare array<binary>"


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row by models of the rows that are not held out.

    ``key, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte``. A null text is an empty one: its end is scored. Rows of the
    same text have the same scores. Without training rows all counts are 0 and
    the models say nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), own.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = rows.filter(~F.col("held_out")).select("text")
    counts, total, kinds, head = word_counts(learned)
    tables, *model = _model(learned)
    sent = spark.sparkContext.broadcast((model, head))
    # the total of a token's smoothed counts is N + V + 1
    whole = np.log10(total + 1.0 * (kinds + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, cells, known_windows), frequent = sent.value
        mixer, task, done = Scored(Mixer(tables.value, weights, cells), known_windows), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _slices(batch, 1):
                texts, size = part.column(1), len(part)
                row, codes, keys = coded_words(texts)
                counts = np.array([frequent.get(k, 0) for k in keys.to_numpy(zero_copy_only=False).tolist()])[codes]
                known, rare = counts > 0, np.flatnonzero(counts == 0)
                logs = np.bincount(row[known], np.log10(counts[known] + 1.0), size)
                rare = rare[np.argsort(row[rare], kind="stable")]
                ends = np.cumsum(np.bincount(row[rare], minlength=size))
                tokens = keys.take(pa.array(codes[rare]))
                sizes = np.bincount(row, minlength=size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array((task << 40) + done + np.arange(size)),
                        pa.array(sizes), pa.array(np.bincount(row[known], minlength=size)), pa.array(logs - sizes * whole),
                        pa.array(scores(mixer, texts.to_pylist())), pc.binary_length(texts).cast(pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), tokens),
                    ],
                    names=["key", "held_out", "uid", "n_tokens", "n_known", "base_score", "score", "bytes", "rare"],
                )
                done += size

    kind = rows.schema["key"].dataType.simpleString()
    scored = materialize(rows.select("key", "text", "held_out").mapInArrow(score, f"key {kind}, held_out boolean, {_SCORED}"), "mix-scores")
    rest = scored.select("uid", F.explode("rare").alias("token")).join(counts, "token")
    rest = rest.groupBy(F.col("uid").alias("id")).agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("add"))
    joined = scored.drop("rare").join(rest, F.col("uid") == F.col("id"), "left")
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.greatest("bytes", F.lit(1))
    return joined.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        "score", bits.alias("bits_per_byte"),
    )


def op1_context_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Base and model score of every document; one in seven is held out."""
    return score_texts(table(spark, folder, "documents"), remainder("doc_id", 7) == 2)
