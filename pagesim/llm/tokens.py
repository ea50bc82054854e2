"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE tokenizer is run as two deterministic transducers whose
transitions carry output.

*Words.* The splitting pattern is a transducer over character classes with
twelve states; a transition says whether a word starts at this character or at
the one before. A batch is cut into equal chunks. All chunks are run side by
side from every state, which gives each chunk's map from entry to exit state;
the maps are composed by a parallel prefix scan, and a second run from the true
entry states emits the words. No chunk waits for another, so a very long text
costs what many short ones do.

*Tokens.* Inside a word the transducer reads bytes and each transition carries
the change of the number of tokens. It is compiled from the merge table: the
BPE encoding of a word is the only path of vocabulary tokens in which every two
neighbours encode to themselves, so a state holds the open starting points (trie
node, last token before it, tokens so far relative to now) and is bounded by the
longest token. States and transitions are compiled when first met and kept.

The merge table (about a megabyte, fixed) is read on the driver and broadcast.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

PIECE = 1 << 18  # characters handled at once
CHUNK = 256  # characters of a chunk of the scan
KEPT_WORDS = 500_000  # words whose counts a worker keeps
KEPT_STATES = 200_000  # states a worker keeps before it compiles anew
LIMIT = 512

# Character classes.
LETTER, SDMT, E, L, R, V, DIGIT, BLANK, SPACE, QUOTE, OTHER, BREAK = range(12)
# States: after nothing open; in letters, digits, others; in white space of one or
# of more characters that ends in a blank or not; after a quote that began a word,
# alone or with r, v, l.
(
    OPEN, LETTERS, DIGITS, OTHERS, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE,
    QUOTED, QUOTED_R, QUOTED_V, QUOTED_L,
) = range(12)
HERE, BEFORE = 1, 2  # output: a word starts here, a word started one character ago
ALPHA = (LETTER, SDMT, E, L, R, V)


def _begin(kind: int) -> int:
    """The state after a character that begins a word."""
    if kind in ALPHA:
        return LETTERS
    return {DIGIT: DIGITS, BLANK: ONE_BLANK, SPACE: ONE_SPACE, QUOTE: QUOTED, OTHER: OTHERS}.get(kind, OPEN)


def _step(state: int, kind: int) -> tuple[int, int]:
    if kind == BREAK:  # between texts
        return OPEN, HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    run = {BLANK: RUN_BLANK, SPACE: RUN_SPACE}
    spaces = (ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE)
    if state in spaces and kind in run:
        return run[kind], 0
    if state in (ONE_BLANK, RUN_BLANK):  # the last blank belongs to the word after it
        joined = OTHERS if kind == QUOTE else _begin(kind)
        return joined, BEFORE if state == RUN_BLANK else 0
    if state == RUN_SPACE:
        return _begin(kind), HERE | BEFORE
    if state == QUOTED:
        if kind == SDMT:
            return OPEN, 0
        if kind in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
        if kind in (QUOTE, OTHER):
            return OTHERS, 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return OPEN, 0
        after, start = _step(LETTERS, kind)
        return after, start | BEFORE
    if (
        state == LETTERS and kind in ALPHA
        or state == DIGITS and kind == DIGIT
        or state == OTHERS and kind in (QUOTE, OTHER)
    ):
        return state, 0
    return _begin(kind), HERE


STATES = 12
_MOVES = np.array([[_step(s, k) for s in range(STATES)] for k in range(12)], dtype=np.uint8)
NEXT, STARTS = _MOVES[..., 0].ravel(), _MOVES[..., 1].ravel()  # by 12 * class + state


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    major = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    kinds[major == ord("L")] = LETTER
    kinds[major == ord("N")] = DIGIT
    # The code points with the property White_Space.
    space = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[space] = SPACE
    kinds[ord(" ")] = BLANK
    kinds[ord("'")] = QUOTE
    kinds[[ord(c) for c in "sdmt"]] = SDMT
    for char, kind in zip("elrv", (E, L, R, V)):
        kinds[ord(char)] = kind
    return kinds


def compose(maps: np.ndarray) -> np.ndarray:
    """Entry states of all chunks from their state maps: an inclusive prefix scan.

    ``maps[c, s]`` is the state after chunk ``c`` entered in ``s``. In round k
    each map is composed with the one 2^k chunks before it.
    """
    scanned, shift = maps.copy(), 1
    while shift < len(scanned):
        scanned[shift:] = np.take_along_axis(scanned[shift:], scanned[:-shift].astype(np.intp), axis=1)
        shift *= 2
    return np.concatenate([[np.uint8(OPEN)], scanned[:-1, OPEN]])


def word_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which the words of a class sequence start."""
    count = -(-len(kinds) // chunk)
    padded = np.full(count * chunk, BREAK, dtype=np.int16)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray((padded * STATES).reshape(count, chunk).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (count, 1))
    for at, column in enumerate(columns):
        # a few characters lead all entry states to one; from there one is run for all
        if at % 16 == 0 and maps.shape[1] > 1 and (maps == maps[:, :1]).all():
            maps = maps[:, :1]
        maps = NEXT[column[:, None] + maps]
    state = compose(np.broadcast_to(maps, (count, STATES)))
    out = np.empty((chunk, count), dtype=np.uint8)
    for at, column in enumerate(columns):
        move = column + state
        out[at], state = STARTS[move], NEXT[move]
    flags = out.T.ravel()
    starts = (flags & HERE).astype(bool)
    starts[:-1] |= (flags[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts[: len(kinds)])


@functools.cache
def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class WordCounter:
    """The lazily compiled transducer from bytes of a word to its number of tokens.

    Tokens are numbered: 0 to 255 the bytes, then one per merge in order of rank,
    so a smaller number is joined earlier.
    """

    def __init__(self, merges: list[tuple[str, str]]):
        of = byte_letters()
        number = dict(of)
        self.parts = [(0, 0)] * 256  # of each token: the two it is joined from
        self.joins: dict[int, int] = {}
        spelt = [bytes([b]) for b in range(256)]
        for a, b in merges:
            left, right = number[a], number[b]
            self.joins.setdefault(left << 20 | right, len(self.parts))
            number.setdefault(a + b, len(self.parts))
            self.parts.append((left, right))
            spelt.append(spelt[left] + spelt[right])
        self.edges: dict[int, int] = {}  # node << 8 | byte to node
        self.token: list[int] = [-1]  # of each node
        self.inner = bytearray(1)  # whether a node has children
        whole = [True] * 256
        for token, word in enumerate(spelt):
            if token >= 256:
                left, right = self.parts[token]
                whole.append(whole[left] and whole[right] and self.apart(left, right, token))
            if not whole[token]:
                continue  # no text ever encodes to it
            node = 0
            for b in word:
                at = node << 8 | b
                if at not in self.edges:
                    self.edges[at] = len(self.token)
                    self.inner[node] = 1
                    self.token.append(-1)
                    self.inner.append(0)
                node = self.edges[at]
            self.token[node] = token
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self):
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def apart(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        """Whether no join crosses the border of neighbours ``a`` and ``b`` before join ``limit``.

        Joins are undone from the last one: whichever of the two was made later is
        replaced by its half at the border, and the two now at the border must
        not join before that. Of equal joins the left one comes first.
        """
        while True:
            if self.joins.get(a << 20 | b, limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` on ``byte``: next state, change of the count."""
        change, last, moved = None, -1, []
        for node, before, count in self.states[state]:
            child = self.edges.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if change is None and token >= 0:
                if before < 0:
                    fits = True
                elif (fits := self.pairs.get(before << 20 | token)) is None:
                    fits = self.pairs[before << 20 | token] = self.apart(before, token)
                if fits:
                    change, last = count + 1, token
            if self.inner[child]:
                moved.append((child, before, count))
        after = (*((n, t, c - change) for n, t, c in moved), (0, last, 0))
        number = self.numbers.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self.moves[state << 8 | byte] = number, change
        return number, change

    def count(self, word: str) -> int:
        state = total = 0
        moves = self.moves
        for byte in word.encode("utf-8", "surrogatepass"):
            move = moves.get(state << 8 | byte)
            state, change = move if move else self.compile(state, byte)
            total += change
        if len(self.states) > KEPT_STATES:
            self.forget()
        if len(self.pairs) > 4 * KEPT_STATES:
            self.pairs.clear()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        self.words[word] = total
        return total

    def texts(self, texts: list[str], special: list[str]) -> np.ndarray:
        """Tokens of each text. Special strings are one token each and split the text."""
        counts = np.zeros(len(texts), dtype=np.int64)
        rows, parts = [], []
        for row, text in enumerate(texts):
            pieces = [text]
            for string in special:
                cut = [p.split(string) for p in pieces]
                counts[row] += sum(len(c) - 1 for c in cut)
                pieces = [p for c in cut for p in c]
            rows += [row] * len(pieces)
            parts += pieces
        for group in self._groups(parts):
            self._add(group, rows, counts)
        return counts

    @staticmethod
    def _groups(parts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Whole texts up to PIECE characters together; a longer text for itself."""
        group, held = [], 0
        for i, part in enumerate(parts):
            if group and held + len(part) > PIECE:
                yield group
                group, held = [], 0
            group.append((i, part))
            held += len(part) + 1
        if group:
            yield group

    def _add(self, group: list[tuple[int, str]], rows: list[int], counts: np.ndarray) -> None:
        joined = "\n".join(["", *(part for _, part in group), ""])
        kinds = class_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        sizes = np.array([len(part) + 1 for _, part in group])
        ends = np.cumsum(sizes)  # positions of the breaks after each text
        kinds[0] = BREAK
        kinds[ends] = BREAK
        starts = word_starts(kinds)
        stops = np.append(starts[1:], len(kinds))
        word = kinds[starts] != BREAK
        starts, stops = starts[word], stops[word]
        get, count = self.words.get, self.count
        words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        tokens = np.fromiter((n if (n := get(w)) is not None else count(w) for w in words), np.int64, len(words))
        totals = np.bincount(np.searchsorted(ends, starts), weights=tokens, minlength=len(group))
        np.add.at(counts, [rows[i] for i, _ in group], totals.astype(np.int64))


def load(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges and special strings of a byte-level BPE ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
    return merges, [t["content"] for t in data["added_tokens"] if t["special"]]


_counters: dict[str, WordCounter] = {}  # one compiled transducer per Python worker


def counter(spark: SparkSession, path: str) -> Callable:
    """A column function: text to its number of tokens; null counts as empty."""
    sent, name = spark.sparkContext.broadcast(load(path)), uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges, special = sent.value
        if name not in _counters:
            _counters.clear()
            _counters[name] = WordCounter(merges)
        for texts in batches:
            yield pd.Series(_counters[name].texts([t or "" for t in texts], special))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted each
    for itself; other columns are not read.
    """
    count = counter(docs.sparkSession, path)
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key), F.octet_length(own).cast("long").alias("n_bytes"), count(own).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
